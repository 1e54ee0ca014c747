"""Retrieval runs: one row per question with everything measured, stored as JSON Lines, compared only if made on the same questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.operators import evaluate, rank
from scriptorium.operators.search import MODES, Ranked
from scriptorium.sources import records

#: Ranks are told up to here: two lists of `rank.CANDIDATES` hold no more.
DEPTH = 2 * rank.CANDIDATES
FULL = "full"
RUN = (
    "qid STRING, doc STRING, question_type STRING, wording STRING, answerable BOOLEAN, ranks STRUCT<hybrid: INT, bm25: INT, dense: INT>, "
    "found ARRAY<STRING>, fully ARRAY<STRING>, sent ARRAY<STRUCT<config: STRING, n: BIGINT>>, best_cosine DOUBLE"
)


def run_of(ranked: Ranked, gold: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per question (see RUN): ranks of the first evidence passage by mode, and the context configurations in which one or all passages of evidence are sent.

    gold is (qid, pos), labels (qid, doc, question_type, wording). A rank is NULL if no evidence was ranked.
    """
    out = labels.select("qid", "doc", "question_type", "wording", (F.col("question_type") != "unanswerable").alias("answerable"))
    for mode in MODES:
        found = ranked.list_of(mode).filter(F.col("rank") <= DEPTH).join(gold, ["qid", "pos"]).groupBy("qid").agg(F.min("rank").cast("int").alias(mode))
        out = out.join(found, "qid", "left")
    contexts = ranked.hits_of(evaluate.CONFIGS).select("config", "qid", "pos")
    support = evaluate.support(contexts, gold, labels)
    named = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("config")))).alias(c)
    per = support.groupBy("qid").agg(named("found"), named("fully"), F.array_sort(F.collect_list(F.struct("config", F.col("sent").alias("n")))).alias("sent"))
    best = rank.best_cosine(labels, ranked.dense).select("qid", F.round("best_cosine", 4).alias("best_cosine"))
    rows = out.join(per, "qid", "left").join(best, "qid", "left")
    return rows.select("qid", "doc", "question_type", "wording", "answerable", F.struct(*MODES).alias("ranks"), "found", "fully", "sent", "best_cosine")


def write_run(run: DataFrame, folder: str, label: str) -> None:
    records.write_jsonl(run, f"{folder}/retrieval_{label}", "qid")


def read_run(spark: SparkSession, folder: str, label: str) -> DataFrame:
    return records.read_jsonl(spark, f"{folder}/retrieval_{label}", RUN, ("qid", "answerable"))


def compared(base: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, question_type, wording, base, new) of the answerable questions. Runs on different questions are refused."""
    own = lambda df, name: df.filter("answerable").select("qid", "question_type", "wording", F.struct("ranks", "found", "fully").alias(name))
    both = own(base, "base").join(own(new, "new").select("qid", "new"), "qid", "full")
    odd = both.filter("base IS NULL OR new IS NULL").limit(1).count()
    if odd:
        raise ValueError("the two runs were made on different questions")
    return both


def outcome(old: Column, new: Column) -> Column:
    """'win', 'loss' or 'tie' of a rank against an older one: the hit decides, then the reciprocal rank."""
    key = lambda r: F.struct(evaluate.hit_at(r, evaluate.HEADLINE).cast("int"), evaluate.reciprocal(r))
    return F.when(key(new) > key(old), "win").when(key(new) < key(old), "loss").otherwise("tie")


def verdict(both: DataFrame, mode: str = "hybrid") -> DataFrame:
    """One row (wins, losses, ties, broken, ships): the new run ships if it wins more questions than it loses and every question on an amendment that was fully supported still is.

    `broken` counts those that aren't; `outcomes` names the questions.
    """
    full = lambda c: F.array_contains(F.col(f"{c}.fully"), FULL)
    result = outcome(F.col(f"base.ranks.{mode}"), F.col(f"new.ranks.{mode}"))
    broken = (F.col("question_type") == "amendment") & full("base") & ~full("new")
    row = both.select(result.alias("o"), broken.alias("b")).agg(F.count_if(F.col("o") == "win").alias("wins"), F.count_if(F.col("o") == "loss").alias("losses"), F.count_if(F.col("o") == "tie").alias("ties"), F.count_if("b").alias("broken"))
    return row.withColumn("ships", (F.col("wins") > F.col("losses")) & (F.col("broken") == 0))


def outcomes(both: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(qid, outcome, base_rank, new_rank, broken) per question."""
    full = lambda c: F.array_contains(F.col(f"{c}.fully"), FULL)
    a, b = F.col(f"base.ranks.{mode}"), F.col(f"new.ranks.{mode}")
    return both.select("qid", outcome(a, b).alias("outcome"), a.alias("base_rank"), b.alias("new_rank"), ((F.col("question_type") == "amendment") & full("base") & ~full("new")).alias("broken"))
