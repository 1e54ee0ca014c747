"""Rule-based additions to hit lists: pinned identifiers, parts of the same table, amendments.

A hit list is (qid, ord, pos, score, reason) with ord from 1. Each addition sees what the ones before it added.
Budgets are running counts per query over candidates in list order, the first occurrence of a passage first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.operators import rank
from scriptorium.runtime import cut_lineage

MAX_PINNED, RARE_MAX = 2, 3
MAX_SIBLINGS, MAX_AMENDMENTS = 3, 4


def _numbered(hits: DataFrame, *order: str | Column) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return hits.withColumn("new_ord", F.row_number().over(w)).select("qid", F.col("new_ord").alias("ord"), "pos", "score", "reason")


def _within_budget(candidates: DataFrame, hits: DataFrame, budget: int, *order: str) -> DataFrame:
    """Candidates that aren't hits yet, each passage once (where it comes first), the first `budget` of each query."""
    new = candidates.join(hits.select("qid", "pos"), ["qid", "pos"], "left_anti")
    once = Window.partitionBy("qid", "pos").orderBy(*order)
    new = new.withColumn("k", F.row_number().over(once)).filter("k = 1")
    return new.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("k") <= budget)


def rare_holders(terms: DataFrame, posts: DataFrame, stats: DataFrame, avgdl: float) -> DataFrame:
    """(qid, pos, tok, first, score, neg): passages that hold an identifier of the query which at most RARE_MAX passages have."""
    rare = terms.filter(F.col("tok").rlike("[0-9]")).join(stats.filter(F.col("df") <= RARE_MAX).select("tok"), "tok")
    holders = cut_lineage(rare.join(posts.select("tok", "pos"), "tok").select("qid", "pos", "tok", "first"))
    scored = holders.join(rank.bm25_scores_of(holders, terms, posts, stats, avgdl), ["qid", "pos"])
    return scored.withColumn("neg", -F.round("score", 9)).select("qid", "pos", "tok", "first", "score", "neg")


def pin(hits: DataFrame, holders: DataFrame, budget: int = MAX_PINNED) -> DataFrame:
    """Appends holders of rare identifiers: by place of the identifier in the query, then by keyword score."""
    new = _within_budget(holders, hits, budget, "first", "neg", "pos")
    added = new.select("qid", (F.col("k") + 1_000_000).alias("ord"), "pos", "score", F.concat(F.lit("contains '"), F.col("tok"), F.lit("' from the question")).alias("reason"))
    return _numbered(hits.unionByName(added), "ord")


def attach_siblings(hits: DataFrame, chunks: DataFrame, budget: int = MAX_SIBLINGS) -> DataFrame:
    """Inserts the other parts of a split table after its first part that was found."""
    parents = chunks.filter("parent <> ''").select("pos", "parent", "section")
    of_hit = hits.join(parents, "pos").select("qid", F.col("ord").alias("at"), "parent", F.col("section").alias("of"))
    parts = of_hit.join(parents.select(F.col("pos"), "parent"), "parent")
    new = _within_budget(parts, hits, budget, "at", "pos")
    added = new.select("qid", F.col("at").alias("ord"), "pos", F.lit(0.0).alias("score"), F.concat(F.lit("rest of "), "parent", F.lit(": "), "of", F.lit(" was retrieved")).alias("reason"), F.col("k").alias("sub"))
    return _numbered(hits.withColumn("sub", F.lit(0)).unionByName(added), "ord", "sub")


def related(chunks: DataFrame) -> DataFrame:
    """(from_pos, step, pos, reason): what must go with a passage: amendments of what it covers, originals of what it amends."""
    covers = chunks.filter(~F.col("is_amendment")).select(F.col("pos").alias("from_pos"), F.posexplode("covers").alias("step", "target"))
    amends = chunks.filter(F.size("amends") > 0).select("pos", "section", "is_amendment", F.explode("amends").alias("target"))
    forward = covers.join(amends, "target").select("from_pos", "step", "pos", F.concat("section", F.lit(" amends "), "target").alias("reason"))
    originals = covers.select(F.col("from_pos").alias("original"), "target").distinct()
    back = amends.filter("is_amendment").join(originals, "target").groupBy(F.col("pos").alias("from_pos"), "section", F.col("original").alias("pos"))
    back = back.agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("t"))
    back = back.select("from_pos", F.lit(0).alias("step"), "pos", F.concat(F.lit("original text of "), "t", F.lit(", amended by "), "section").alias("reason"))
    return forward.unionByName(back)


def attach_amendments(hits: DataFrame, chunks: DataFrame, budget: int = MAX_AMENDMENTS) -> DataFrame:
    """Inserts amendments after the passage they change, and originals after their amendment."""
    found = hits.select("qid", F.col("ord").alias("at"), F.col("pos").alias("from_pos")).join(related(chunks), "from_pos")
    new = _within_budget(found, hits, budget, "at", "step", "pos")
    added = new.select("qid", F.col("at").alias("ord"), "pos", F.lit(0.0).alias("score"), "reason", F.col("k").alias("sub"))
    return _numbered(hits.withColumn("sub", F.lit(0)).unionByName(added), "ord", "sub")
