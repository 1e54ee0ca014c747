"""Operations along an order (the row before, running sums, last value seen) that don't put a group into one task.

Rows are laid out once in ranges of (group, order), so a group of any size is spread over ranges; a window within range and group does the
work there, and what a range has to know of the ranges before it is one value per range and group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.runtime import write_out

PART, CARRY = "__part", "__carry"


@dataclass
class Ordered:
    """Rows of `df` in ranges; `by` may hold nulls, which form a group, `order` has no ties within a group."""

    rows: DataFrame
    by: list[str]
    order: list[str]

    @classmethod
    def of(cls, df: DataFrame, by: list[str], order: list[str]) -> Ordered:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(write_out(df.repartitionByRange(parts, *by, *order).withColumn(PART, F.spark_partition_id())), by, order)

    def here(self):
        return Window.partitionBy(PART, *self.by).orderBy(*self.order)

    def _carried(self, value: Column, fold: Callable[[Column], Column]) -> DataFrame:
        """Rows with CARRY: `fold` of the values that the ranges before have for the row's group."""
        per = self.rows.groupBy(PART, *self.by).agg(value.alias(CARRY))
        before = Window.partitionBy(*self.by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        names = {c: f"__{c}" for c in (PART, *self.by)}
        per = per.select(*(F.col(c).alias(n) for c, n in names.items()), fold(F.col(CARRY)).over(before).alias(CARRY))
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
        return self.rows.join(per, same, "left").drop(*names.values())

    def _next(self, rows: DataFrame) -> Ordered:
        return Ordered(rows.drop(CARRY), self.by, self.order)

    def previous(self, *columns: str) -> Ordered:
        """Adds previous_<c> of the row before in the group, and `is_first`."""
        held = F.struct(*(F.col(c) for c in columns))
        rows = self._carried(F.max_by(held, F.struct(*self.order)), lambda v: F.last(v))
        before = F.coalesce(F.lag(held).over(self.here()), F.col(CARRY))
        rows = rows.withColumn("__before", before)
        rows = rows.withColumn("is_first", F.col("__before").isNull())
        for c in columns:
            rows = rows.withColumn(f"previous_{c}", F.col(f"__before.{c}"))
        return self._next(rows.drop("__before"))

    def running(self, value: Column, name: str) -> Ordered:
        """Adds the sum of `value` over the group up to the row."""
        held = Ordered(self.rows.withColumn("__value", value.cast("long")), self.by, self.order)
        rows = held._carried(F.sum("__value"), lambda v: F.sum(v))
        total = F.sum("__value").over(self.here().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self._next(rows.withColumn(name, total + F.coalesce(CARRY, F.lit(0))).drop("__value"))

    def filled(self, value: Column, name: str) -> Ordered:
        """Adds the last value that isn't null, the row's own included."""
        held = Ordered(self.rows.withColumn("__value", value), self.by, self.order)
        rows = held._carried(F.max_by(F.col("__value"), F.when(F.col("__value").isNotNull(), F.struct(*self.order))), lambda v: F.last(v, ignorenulls=True))
        last = F.last("__value", ignorenulls=True).over(self.here().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self._next(rows.withColumn(name, F.coalesce(last, CARRY)).drop("__value"))

    def islands(self, starts: Column, name: str = "island") -> Ordered:
        """Numbers the runs of each group from 1: a first row, or one for which `starts` holds, opens a run. `starts` may use what `previous` added."""
        return self.running((F.col("is_first") | F.coalesce(starts, F.lit(False))).cast("int"), name)

    def done(self) -> DataFrame:
        return self.rows.drop(PART)
