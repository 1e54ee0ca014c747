"""Evaluation of ranked lists, contexts, cutoffs and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as tx

CUTOFFS, MRR_CUTOFF, HEADLINE = (1, 5, 10), 10, 5
#: Context configurations: name, (pin, siblings, amendments).
CONFIGS = {
    "full": (True, True, True), "no_pin": (False, True, True), "no_siblings": (True, False, True),
    "no_amendments": (True, True, False), "plain": (False, False, False),
}


def hit_at(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False))


def reciprocal(rank: Column, cutoff: int = MRR_CUTOFF) -> Column:
    return F.when(rank <= cutoff, 1.0 / rank).otherwise(0.0)


def first_gold_rank(lists: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank): first place of an evidence passage in each list; NULL if none. gold is (qid, pos)."""
    found = lists.join(gold, ["qid", "pos"]).groupBy(*keys).agg(F.min("rank").alias("rank"))
    return lists.select(*keys).distinct().join(found, keys, "left")


def support(contexts: DataFrame, gold: DataFrame, queries: DataFrame, configs: tuple[str, ...] = tuple(CONFIGS)) -> DataFrame:
    """(config, qid, found, fully, sent) for every query under every configuration named. Without evidence found is false and fully true."""
    n_gold = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    got = contexts.join(gold.withColumn("g", F.lit(1)), ["qid", "pos"], "left").groupBy("config", "qid").agg(F.count("g").alias("n_got"), F.count(F.lit(1)).alias("sent"))
    grid = queries.select("qid", F.explode(F.array(*map(F.lit, configs))).alias("config"))
    rows = grid.join(got, ["config", "qid"], "left").join(n_gold, "qid", "left").na.fill(0, ["n_got", "sent", "n_gold"])
    return rows.select("config", "qid", (F.col("n_got") > 0).alias("found"), (F.col("n_got") >= F.col("n_gold")).alias("fully"), "sent")


def wins_losses(ranks: DataFrame, k: int = HEADLINE, cutoff: int = MRR_CUTOFF) -> DataFrame:
    """(wins, losses, ties) of rank_b against rank_a: the hit decides, then the reciprocal rank."""
    key = lambda c: F.struct(hit_at(F.col(c), k).cast("int"), reciprocal(F.col(c), cutoff))
    a, b = key("rank_a"), key("rank_b")
    return ranks.agg(F.count_if(b > a).alias("wins"), F.count_if(b < a).alias("losses"), F.count_if(b == a).alias("ties"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """One row: the cutoff between neighbouring scores that tells answerable from unanswerable best; fewer false alarms, then the lowest, break ties.

    Running counts over the distinct scores give the count below every cutoff in one pass; the window is over a table of counts per score.
    """
    per = scores.groupBy("score").agg(F.count_if(F.col("answerable")).alias("ok"), F.count_if(~F.col("answerable")).alias("nope"))
    w = Window.orderBy("score")
    mid = F.coalesce(F.bround((F.col("score") + F.lead("score").over(w)) / 2, 3), F.when(F.lag("score").over(w).isNull(), F.col("score")))
    cuts = per.select(mid.alias("threshold")).filter("threshold IS NOT NULL").distinct()
    at = cuts.select(F.col("threshold").alias("score"), F.lit(0).cast("long").alias("ok"), F.lit(0).cast("long").alias("nope"), F.lit(True).alias("cut")).unionByName(per.withColumn("cut", F.lit(False)))
    # A cutoff comes before scores that equal it: only what lies below counts.
    run = Window.orderBy("score", F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = at.select("score", "cut", F.sum("ok").over(run).alias("false_alarms"), F.sum("nope").over(run).alias("flagged"))
    totals = per.agg(F.sum("ok").alias("answerable"), F.sum("nope").alias("unanswerable"))
    correct = F.col("flagged") + F.col("answerable") - F.col("false_alarms")
    rows = seen.filter("cut").crossJoin(F.broadcast(totals)).withColumn("correct", correct)
    return rows.orderBy(F.desc("correct"), "false_alarms", "score").limit(1).select(F.col("score").alias("threshold"), "flagged", "unanswerable", "false_alarms", "answerable")


def score_answers(rows: DataFrame) -> DataFrame:
    """(result_id, abstained, missing, correct) from (result_id, answer, mode, answerable, must_include). correct is NULL where only a person can tell."""
    generated = F.coalesce(F.col("mode") == "generated", F.lit(False))
    answer = F.coalesce("answer", F.lit(""))
    required = F.coalesce("must_include", F.array().cast("array<string>"))
    abstained = generated & tx.is_abstention(answer)
    missing = F.when(generated, tx.missing_values(answer, required)).otherwise(required)
    correct = (
        F.when(~generated, False).when(~F.coalesce("answerable", F.lit(False)), F.col("abstained")).when(F.col("abstained"), False)
        .when(F.size(required) > 0, F.size("missing") == 0)
    )
    return rows.withColumn("abstained", abstained).withColumn("missing", missing).withColumn("correct", correct).select("result_id", "abstained", "missing", "correct")


def failure_source(correct: Column, answerable: Column, found: Column) -> Column:
    """'generation' if evidence reached the context of a wrong answer, else 'retrieval'; '' where nothing is known to have failed."""
    return F.when(~F.coalesce(correct, F.lit(True)) & answerable, F.when(found, "generation").otherwise("retrieval")).otherwise("")
