"""Problem 2: splitting oversized items at natural boundaries.

A token is a run of ASCII letters, a run of ASCII digits, or any other single character that is no
white space. Counting is a codegen'd expression on all rows; only rows over the limit, few of them,
go to Python, where each is cut by recursive bisection: at the strongest boundary near the midpoint,
then again while a half exceeds limit minus overlap, and the overlaps are attached last.

Defined results: null texts are one piece of 0 tokens and NULL text; null paragraphs are skipped; a
text within the limit is one piece, unchanged; a text without boundaries is cut between tokens, so no
piece ever exceeds the limit; repeated rows count once; part numbers run from 1 without gaps and
part_count is the number of pieces. Pieces without their overlaps, put together, give the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.runtime import read_table

LIMIT, OVERLAP = 400, 40
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
TOKEN_JAVA = r"(?U)[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"
PARAGRAPH_GLUE = "\n\n"
#: Boundary strengths: paragraph, sentence, line, white space, between two tokens.
PARAGRAPH, SENTENCE, LINE, SPACE, NONE = 4, 3, 2, 1, 0
GAPS = re.compile(r"(?P<p>\n[ \t]*\n\s*)|(?P<s>(?<=[.!?।。！？…])[\"”’»)\]]*\s+|(?<=[。！？।]))|(?P<l>\s*\n\s*)|(?P<b>\s+)")


def token_count(text: Column) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_JAVA)), F.lit(0))


def paragraphs_text(paragraphs: Column) -> Column:
    """The texts of the paragraphs, joined by an empty line. Tokens never span the glue, so counts add up."""
    return F.array_join(F.transform(paragraphs, lambda p: p["text"]), PARAGRAPH_GLUE)


def boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """Strength of the cut before each token."""
    strength = np.zeros(len(starts), np.int8)
    for m in GAPS.finditer(text):
        k = int(np.searchsorted(starts, m.end()))
        if 0 < k < len(starts) and starts[k] == m.end():
            s = PARAGRAPH if m["p"] is not None else SENTENCE if m["s"] is not None else LINE if m["l"] is not None else SPACE
            strength[k] = max(strength[k], s)
    return strength


def bisect(strength: np.ndarray, first: int, end: int, most: int) -> list[int]:
    """Cuts (token numbers) of [first, end) into parts of at most `most` tokens."""
    if end - first <= most:
        return []
    mid, reach = (first + end) // 2, max(1, (end - first) // 4)
    lo, hi = max(first + 1, mid - reach), min(end - 1, mid + reach)
    zone = strength[lo : hi + 1]
    best = np.flatnonzero(zone == zone.max()) + lo
    cut = int(best[np.argmin(np.abs(best - mid))])
    return [*bisect(strength, first, cut, most), cut, *bisect(strength, cut, end, most)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, overlap tokens) of each piece, in characters of the text."""
    marks = [m.span() for m in TOKEN.finditer(text)]
    n = len(marks)
    if n <= limit:
        return [(0, len(text), n, 0)]
    starts = np.array([a for a, _ in marks])
    strength = boundaries(text, starts)
    cuts = [0, *bisect(strength, 0, n, limit - overlap), n]
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        back = a
        if k:
            zone = strength[max(cuts[k - 1] + 1, a - overlap) : a]
            if len(zone):  # the overlap begins at the strongest boundary in reach, the farthest of them
                back = a - len(zone) + int(np.argmax(zone == zone.max()))
        out.append((int(starts[back]) if k else 0, int(starts[b]) if b < n else len(text), b - back, a - back))
    return out


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, record_id, text) to (src, record_id, part_no, part_count, text, start_char, n_tokens, overlap_tokens)."""
    sized = items.select("src", "record_id", "text", token_count(F.col("text")).alias("n_tokens"))
    one, columns = F.lit(1), ["src", "record_id", "part_no", "part_count", "text", "start_char", "n_tokens", "overlap_tokens"]
    whole = sized.filter(F.col("n_tokens") <= limit).select("src", "record_id", one.alias("part_no"), one.alias("part_count"), "text", F.lit(0).alias("start_char"), "n_tokens", F.lit(0).alias("overlap_tokens"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for src, rid, text in zip(pdf.src, pdf.record_id, pdf.text):
                found = pieces(text, limit, overlap)
                rows += [(src, rid, i + 1, len(found), text[a:b], a, n, o) for i, (a, b, n, o) in enumerate(found)]
            yield pd.DataFrame(rows, columns=columns)

    kinds = "src string, record_id string, part_no int, part_count int, text string, start_char int, n_tokens int, overlap_tokens int"
    return whole.unionByName(sized.filter(F.col("n_tokens") > limit).select("src", "record_id", "text").mapInPandas(cut, kinds))


def recount(windows: DataFrame) -> DataFrame:
    """(window_id, part_no, part_count, right_no, right_count): numbers of each window within its unit, by part_no then window_id."""
    from pyspark.sql import Window

    w = Window.partitionBy("unit_id")
    rows = windows.select("window_id", "unit_id", "part_no", "part_count").dropDuplicates(["window_id"])
    # A unit has a few dozen windows; windows without a unit are each their own.
    rows = rows.withColumn("unit_id", F.coalesce(F.col("unit_id").cast("string"), F.concat(F.lit("none:"), F.col("window_id").cast("string"))))
    return rows.select(
        "window_id", "part_no", "part_count",
        F.row_number().over(w.orderBy(F.col("part_no").asc_nulls_last(), "window_id")).alias("right_no"),
        F.count(F.lit(1)).over(w).cast("int").alias("right_count"),
    )


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, record_id, text) of chunks, units and windows."""
    chunks = read_table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("record_id"), "text")
    units = read_table(spark, sf_dir, "units").select(F.lit("unit").alias("src"), F.col("unit_id").cast("string").alias("record_id"), paragraphs_text(F.col("paragraphs")).alias("text"))
    windows = read_table(spark, sf_dir, "windows").select(F.lit("window").alias("src"), F.col("window_id").cast("string").alias("record_id"), paragraphs_text(F.col("paragraphs")).alias("text"))
    return chunks.unionByName(units).unionByName(windows)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all items."""
    return split(all_items(spark, sf_dir).dropDuplicates(["src", "record_id"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut, and windows whose part_count was wrong."""
    cut = split(all_items(spark, sf_dir)).filter("part_count > 1").select("src", "record_id")
    counts = recount(read_table(spark, sf_dir, "windows")).filter("NOT part_count <=> right_count")
    return cut.unionByName(counts.select(F.lit("window_count").alias("src"), F.col("window_id").cast("string").alias("record_id"))).distinct()


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
_TOKENS = "len(regexp_extract_all({}, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]'))"
_JOINED = "array_to_string(list_transform(paragraphs, lambda p: p.text), chr(10))"
ORACLE = {
    "p2_found": f"""
SELECT DISTINCT 'chunk' AS src, chunk_id AS record_id FROM chunks WHERE {_TOKENS.format('text')} > {LIMIT}
UNION SELECT 'unit', CAST(unit_id AS VARCHAR) FROM units WHERE {_TOKENS.format(_JOINED)} > {LIMIT}
UNION SELECT 'window', CAST(window_id AS VARCHAR) FROM windows WHERE {_TOKENS.format(_JOINED)} > {LIMIT}
UNION SELECT 'window_count', CAST(w.window_id AS VARCHAR) FROM windows w
  JOIN (SELECT unit_id, count(DISTINCT window_id) AS n FROM windows GROUP BY unit_id) c ON w.unit_id IS NOT DISTINCT FROM c.unit_id
  WHERE w.part_count IS DISTINCT FROM c.n""",
}
