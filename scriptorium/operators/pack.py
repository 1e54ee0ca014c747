"""Packing paragraphs to a token budget and merging small units, as expressions over sizes.

What is ever folded in order is a short array of sizes: the sentences of one paragraph, the paragraphs of one unit, the units between
two barriers. A barrier is a place where nothing carries over: another document or group, a unit that doesn't merge, the unit
after an oversized one. Texts are never part of a fold that spans units, and no Python runs.

Defined results: null texts are no paragraphs; units without paragraphs vanish, as if they weren't there; repeated unit ids count
once; a word over the budget stays whole; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.ordered import Ordered

MAX_TOKENS, MIN_TAIL = 400, 50
#: Fixed value: where a sentence of a long paragraph ends.
SENTENCE_GAP = r"(?<=[.;:])\s+(?=[A-Z(\"'])"
PARAGRAPHS = "array<struct<text:string,pdf_page:int,printed_page:string>>"


def greedy_groups(lengths: Column, budget: int = MAX_TOKENS) -> Column:
    """Array of 0-based window numbers of an array of lengths: a length that doesn't fit into the open window opens the next."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        new = (F.size(acc["out"]) > 0) & (acc["used"] + n > budget)
        k = F.when(new, acc["k"] + 1).otherwise(acc["k"])
        return F.struct(F.when(new, n).otherwise(acc["used"] + n).alias("used"), k.alias("k"), F.concat(acc["out"], F.array(k)).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def joined(parts: Column, budget: int = MAX_TOKENS) -> Column:
    """Neighbouring texts of an array put together by blanks as long as they fit the budget."""

    def texts(numbered: Column) -> Column:
        last = F.coalesce(F.element_at(numbered["k"], -1), F.lit(-1))
        return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.trim(F.array_join(F.filter(numbered["parts"], lambda _, i: F.get(numbered["k"], i) == k), " ")),
        ))

    numbered = F.struct(parts.alias("parts"), greedy_groups(F.transform(parts, tx.token_count), budget).alias("k"))
    return tx.let(numbered, texts)


def shortened(text: Column, budget: int = MAX_TOKENS) -> Column:
    """A text over the budget in pieces within it: whole sentences, and of a sentence that is over it by itself whole words."""
    words = lambda s: joined(F.filter(F.split(s, r"\s+"), lambda w: w != ""), budget)
    sentences = joined(F.split(text, SENTENCE_GAP), budget)
    pieces = F.flatten(F.transform(sentences, lambda s: F.when(tx.token_count(s) > budget, words(s)).otherwise(F.array(s))))
    return F.when(tx.token_count(text) > budget, pieces).otherwise(F.array(text))


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)


def windows_in_unit(sizes: Column, budget: int = MAX_TOKENS, least: int = MIN_TAIL) -> Column:
    """Window numbers of the pieces of an oversized unit: greedy, but a last window under `least` tokens goes to the one before."""

    def folded(numbers: Column) -> Column:
        last = F.element_at(numbers, -1)
        tail = total(F.filter(sizes, lambda _, i: F.get(numbers, i) == last))
        return F.when((last > 0) & (tail < least), F.transform(numbers, lambda k: F.least(k, last - 1))).otherwise(numbers)

    return tx.let(greedy_groups(sizes, budget), folded)


def heads(units: Column, budget: int = MAX_TOKENS, least: int = MIN_TAIL) -> Column:
    """For units (unit_id, size, mergeable) between two barriers in order, the unit that opens the window each belongs to.

    Units join while their sum fits and all of them merge. An oversized one takes in what waits before it if that is a stub of under `least` tokens.
    """
    start = F.struct(F.lit(-1).alias("used"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("head"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        waits, over = acc["used"] >= 0, u["size"] > budget
        joins = waits & F.when(over, acc["used"] < least).otherwise(acc["open"] & u["mergeable"] & (acc["used"] + u["size"] <= budget))
        used = F.when(over, -1).when(joins, acc["used"] + u["size"]).otherwise(u["size"])
        head = F.when(joins, acc["head"]).otherwise(u["unit_id"].cast("long"))
        return F.struct(used.alias("used"), u["mergeable"].alias("open"), head.alias("head"), F.concat(acc["out"], F.array(head)).alias("out"))

    return F.aggregate(units, start, step, lambda acc: acc["out"])


def sized_units(units: DataFrame, budget: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, unit_id, unit_key, unit_group, title, mergeable, pieces, sizes, size) of the units that have paragraphs; paragraphs over the budget are in pieces."""
    kept = F.filter(F.coalesce("paragraphs", F.array().cast(PARAGRAPHS)), lambda p: p["text"].isNotNull())
    pieces = F.flatten(F.transform(kept, lambda p: F.transform(shortened(p["text"], budget), lambda t: F.struct(t.alias("text"), p["pdf_page"].alias("pdf_page"), p["printed_page"].alias("printed_page")))))
    one = units.dropDuplicates(["unit_id"]).select("doc_id", "unit_id", "unit_key", "unit_group", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("mergeable", F.lit(False)).alias("mergeable"), pieces.alias("pieces"))
    sized = one.filter(F.size("pieces") > 0).withColumn("sizes", F.transform("pieces", lambda p: tx.token_count(p["text"])))
    return sized.withColumn("size", total(F.col("sizes")))


def merging(sized: DataFrame, budget: int = MAX_TOKENS, least: int = MIN_TAIL) -> DataFrame:
    """(doc_id, unit_id, head): the first unit of the window that each unit belongs to (an oversized unit: of its first part)."""
    slim = sized.select("doc_id", "unit_id", F.col("unit_group").alias("grp"), "mergeable", "size")
    rows = Ordered.of(slim, ["doc_id"], ["unit_id"]).previous("grp", "size")
    alone = ~F.col("mergeable") & (F.col("size") <= budget)
    barrier = ~F.col("grp").eqNullSafe(F.col("previous_grp")) | alone | (F.col("previous_size") > budget)
    spans = rows.islands(barrier, "span").done()
    listed = spans.groupBy("doc_id", "span").agg(F.array_sort(F.collect_list(F.struct("unit_id", "size", "mergeable"))).alias("units"))
    both = F.zip_with(F.col("units.unit_id"), heads(F.col("units"), budget, least), lambda i, h: F.struct(i.alias("unit_id"), h.alias("head")))
    return listed.select("doc_id", F.explode(both).alias("u")).select("doc_id", "u.*")


def windows_of(units: DataFrame, budget: int = MAX_TOKENS, least: int = MIN_TAIL) -> DataFrame:
    """(doc_id, first_unit, keys, title, paragraphs, part_no, part_count) from units in the order of unit_id."""
    sized = sized_units(units, budget)
    rows = sized.join(merging(sized, budget, least), ["doc_id", "unit_id"])
    over = F.col("size") > budget
    numbers = F.when(over, windows_in_unit(F.col("sizes"), budget, least)).otherwise(F.transform("sizes", lambda _: F.lit(0)))
    rows = rows.withColumn("numbers", numbers).withColumn("parts", F.element_at("numbers", -1) + 1).withColumn("over", over)
    each = rows.select(
        "doc_id", "head", "unit_id", "unit_key", "title", "parts", "over", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"), "pieces", "numbers",
    )
    own = F.filter("pieces", lambda _, i: F.get(F.col("numbers"), i) == F.col("k"))
    # The first part shares its window with what joined before it; later parts begin with the unit itself.
    begins = F.when(F.col("k") == 0, F.col("head")).otherwise(F.col("unit_id"))
    each = each.select("doc_id", begins.alias("first_unit"), "k", "unit_id", "unit_key", "title", "parts", "over", own.alias("own"))
    held = F.array_sort(F.collect_list(F.struct("unit_id", "unit_key", "title", "own", "parts", "over"))).alias("held")
    windows = each.groupBy("doc_id", "first_unit", "k").agg(held)
    first, last = F.element_at("held", 1), F.element_at("held", -1)
    # An oversized unit keeps its own title unless the stub in front of it has one; merged units go by the first.
    title = F.when(last["over"] & (first["title"] == ""), last["title"]).otherwise(first["title"])
    return windows.select(
        "doc_id", "first_unit", F.col("held.unit_key").alias("keys"), title.alias("title"), F.flatten(F.col("held.own")).alias("paragraphs"),
        (F.col("k") + 1).alias("part_no"), F.array_max(F.col("held.parts")).alias("part_count"),
    )
