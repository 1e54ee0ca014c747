"""Operators on positioned blocks (page, x0, y0, x1, y1, text) and on rows in document order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import sections
from scriptorium.operators.ordered import Ordered


def forward_fill(df: DataFrame, column: str, by: list[str], order: str, blank_is_null: bool = True) -> DataFrame:
    """Fills nulls (and empty strings) with the last value before, within `by`, as <column>_filled."""
    value = F.nullif(F.col(column), F.lit("")) if blank_is_null else F.col(column)
    return Ordered.of(df, by, [order]).filled(value, f"{column}_filled").done()


def islands(df: DataFrame, starts: Column, by: list[str], order: str, name: str = "island") -> DataFrame:
    """Numbers runs from 1: a row for which `starts` holds, or the first one, opens a new run. `starts` may use lag over (by, order).

    For groups that fit a task (a user, a unit); runs of whole documents go by `Ordered`.
    """
    w = Window.partitionBy(*by).orderBy(order)
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("__s", (first | F.coalesce(starts, F.lit(False))).cast("int"))
    return flagged.withColumn(name, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__s")


def previous(column: str, by: list[str], order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(order))


def line_groups(blocks: DataFrame, indent: float = 10, gap: float = 38) -> DataFrame:
    """Paragraph groups of (doc_id, ord, page, x0, y0, text): a new one at a numbered start, another page, another indent or a wide gap."""
    moved = (F.col("page") != F.col("previous_page")) | (F.abs(F.col("x0") - F.col("previous_x0")) > indent) | (F.col("y0") - F.col("previous_y0") > gap)
    grouped = Ordered.of(blocks, ["doc_id"], ["ord"]).previous("page", "x0", "y0").islands(F.col("text").rlike(r"^\d{1,3}\.\s") | moved, "grp")
    return grouped.done().drop("previous_page", "previous_x0", "previous_y0", "is_first")


def noise_free(blocks: DataFrame, top: float = 80, bottom: float = 760) -> DataFrame:
    """Drops headers, page numbers, rulers, unreadable fonts and empty blocks."""
    t = F.trim("text")
    return blocks.filter((F.col("y1") >= top) & (F.col("y0") <= bottom) & (t != "") & ~tx.is_ruler(t) & ~tx.looks_broken(t))


def framed(blocks: DataFrame, mark: str, header: float = 50, footer: float = 70) -> DataFrame:
    """Drops, by the height of the page (`height`), the running header that holds `mark` and numbers alone at the foot."""
    t = F.trim("text")
    head = (F.col("y1") < header) & F.contains(t, F.lit(mark))
    foot = (F.col("y0") > F.col("height") - footer) & t.rlike(r"^\d+$")
    return blocks.filter((t != "") & ~head & ~foot)


def without_stamps(blocks: DataFrame, left: float, right: float) -> DataFrame:
    """Drops page numbers and stamps that stand outside the text between `left` and `right`."""
    return blocks.filter((F.col("x1") > left) & (F.col("x0") < right))


def signatures(lines: DataFrame) -> DataFrame:
    """Drops the lines of a signature block: names with dots for a place to sign, (SIGNED), date stamps."""
    return lines.filter(~F.trim("text").rlike(r"(?i)^(?:[.…_ ]{4,}.*|\(?\s*(?:sd/?-?|signed|signature)\b.*|dated?\s*:.*)$"))


def reading_order(blocks: DataFrame, middle: float = 300, slack: float = 15) -> DataFrame:
    """`ord` of two-column pages: bands begin at headings of tables and appendices that span both columns (as all do where blocks have no x1); in a band the left column goes before the right one."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("text").rlike(r"^(?:TABLE|APPENDIX)\s")
    if "x1" in blocks.columns:
        head = head & (F.col("x0") < middle - slack) & (F.col("x1") > middle + slack)
    banded = blocks.withColumn("band", F.sum(head.cast("int")).over(w)).withColumn("side", F.when(head, 0).when(F.col("x0") < middle - slack, 1).otherwise(2))
    ranked = Ordered.of(banded, ["doc_id"], ["page", "band", "side", "y0", "x0"]).running(F.lit(1), "ord")
    return ranked.done()


def sequential_numbers(paragraphs: Column) -> Column:
    """For an array of texts, the number each opens with if it is the next expected one (from 1), else NULL."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n = F.nullif(F.regexp_extract(p, r"^(\d{1,3})\.\s", 1), F.lit("")).cast("int")
        ok = n == acc["next"]
        return F.struct(F.when(ok, acc["next"] + 1).otherwise(acc["next"]).alias("next"), F.concat(acc["out"], F.array(F.when(ok, n))).alias("out"))

    return F.aggregate(paragraphs, start, step, lambda acc: acc["out"])


def clause_segments(lines: DataFrame, gap: int = 2) -> DataFrame:
    """(doc_id, ord, starts): the clause that a line opens, if its number may follow the last one accepted; top-level ones need a dot and capitals."""
    rows = lines.select("doc_id", "ord", "text", F.lit(0).alias("piece")).filter(F.col("text").rlike(rf"^{sections.NUMBER}"))
    found = sections.accepted(sections.candidates(rows), gap)
    return found.select("doc_id", "ord", F.array_join(F.transform("key", lambda k: k.cast("string")), ".").alias("starts"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, text) of the block elements of (doc_id, html), in order; their place stands in for a position."""
    from html.parser import HTMLParser

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"p", "li", "h1", "h2", "h3", "h4", "title", "footer", "header", "nav", "td", "th", "pre", "blockquote"}

        class Blocks(HTMLParser):
            def __init__(self) -> None:
                super().__init__()
                self.found, self.open = [], []

            def handle_starttag(self, tag, attrs):
                if tag in kinds:
                    self.open.append((tag, []))

            def handle_endtag(self, tag):
                if tag in kinds and any(t == tag for t, _ in self.open):
                    while self.open:
                        kind, parts = self.open.pop()
                        text = " ".join("".join(parts).split())
                        if text:
                            self.found.append((kind, text))
                        if kind == tag:
                            break

            def handle_data(self, data):
                if self.open:
                    self.open[-1][1].append(data)

        for pdf in batches:
            rows = []
            for doc, html in zip(pdf.doc_id, pdf.html):
                parser = Blocks()
                parser.feed(html or "")
                parser.close()
                rows += [(doc, i + 1, kind, text) for i, (kind, text) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "kind", "text"])

    return pages.select("doc_id", "html").mapInPandas(run, "doc_id string, ord long, kind string, text string")
