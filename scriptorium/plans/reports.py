"""Queries of evaluation runs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import evaluate, reports, runs
from scriptorium.plans import answers, retrieval as rt, sqltext as sql
from scriptorium.runtime import read_table


def _labels(spark, sf_dir):
    return read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), "doc", "question_type", "wording")


def _run(spark, sf_dir):
    return runs.run_of(rt.ranked_of(spark, sf_dir), rt.evidence_of(spark, sf_dir), _labels(spark, sf_dir))


def retrieval_run(spark, sf_dir):
    """Everything measured for each question, with evidence or without."""
    run = _run(spark, sf_dir)
    ranks = (F.coalesce(F.col(f"ranks.{m}"), F.lit(0)).alias(f"{m}_rank") for m in ("bm25", "dense", "hybrid"))
    return run.select("qid", "answerable", *ranks, F.array_join("found", ",").alias("found"), F.array_join("fully", ",").alias("fully"), F.aggregate("sent", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("sent"), "best_cosine")


def label_counts(spark, sf_dir):
    return reports.label_counts(read_table(spark, sf_dir, "gold"))


def retrieval_report(spark, sf_dir):
    return reports.retrieval_report(_run(spark, sf_dir), "base")


def run_comparison(spark, sf_dir):
    """The keyword list with its context as a run of its own, against the fused one: outcome per question."""
    ranked, labels, gold = rt.ranked_of(spark, sf_dir), _labels(spark, sf_dir), rt.evidence_of(spark, sf_dir)
    new = runs.run_of(ranked, gold, labels)
    base = new.withColumn("ranks", F.struct(F.col("ranks.bm25").alias("hybrid"), F.col("ranks.bm25").alias("bm25"), F.col("ranks.dense").alias("dense")))
    return runs.outcomes(runs.compared(base, new)).select("qid", "outcome", F.coalesce("base_rank", F.lit(0)).alias("base_rank"), F.coalesce("new_rank", F.lit(0)).alias("new_rank"), "broken")


def checking_sheet(spark, sf_dir):
    return reports.checking_sheet(read_table(spark, sf_dir, "gold"), rt.chunks_of(spark, sf_dir))


def lost_tails(spark, sf_dir):
    """Tokens of passages beyond a window of 512."""
    return reports.lost_tails(rt.chunks_of(spark, sf_dir))


def pairs_report(spark, sf_dir):
    kept = read_table(spark, sf_dir, "pairs").filter("query IS NOT NULL").select("query", "chunk_id", "negative_id")
    return reports.pairs_report(kept, read_table(spark, sf_dir, "dropped").dropDuplicates(["dropped_id"]).select("query", "chunk_id", answers.reason_code(F.col("reason")).alias("reason")), rt.chunks_of(spark, sf_dir))


QUERIES = {f.__name__: f for f in (retrieval_run, label_counts, retrieval_report, run_comparison, checking_sheet, lost_tails, pairs_report)}

_CTX = "".join(", " + sql.expansion(*switches, tag=f"_{name}") for name, switches in evaluate.CONFIGS.items()) + ", ctx AS (" + " UNION ALL ".join(f"SELECT '{name}' AS config, qid, pos FROM hits_{name}" for name in evaluate.CONFIGS) + ")"
_R = "(SELECT min(l.rank) FROM {t} l JOIN ge ON ge.qid = l.qid AND ge.pos = l.pos WHERE l.qid = q.qid)"
ORACLE = {
    "retrieval_run": f"""WITH {sql.RANKING}, {sql.EVIDENCE}{_CTX},
need AS (SELECT q.qid, count(ge.pos) AS n FROM q LEFT JOIN ge ON ge.qid = q.qid GROUP BY q.qid),
per AS (SELECT config, c.qid, count(*) AS sent, count(g.pos) AS got FROM ctx c LEFT JOIN ge g ON g.qid = c.qid AND g.pos = c.pos GROUP BY ALL),
grid AS (SELECT need.*, m.config, coalesce(sent, 0) AS sent, coalesce(got, 0) AS got FROM need CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in evaluate.CONFIGS)}) m(config) LEFT JOIN per ON per.qid = need.qid AND per.config = m.config),
sup AS (SELECT qid, coalesce(string_agg(config, ',' ORDER BY config) FILTER (got > 0), '') AS found, coalesce(string_agg(config, ',' ORDER BY config) FILTER (got >= n), '') AS fully, CAST(sum(sent) AS BIGINT) AS sent FROM grid GROUP BY qid)
SELECT q.qid, gold.question_type <> 'unanswerable' AS answerable, CAST(coalesce({_R.format(t='bm')}, 0) AS INTEGER) AS bm25_rank, CAST(coalesce({_R.format(t='dn')}, 0) AS INTEGER) AS dense_rank, CAST(coalesce({_R.format(t='fu')}, 0) AS INTEGER) AS hybrid_rank,
  found, fully, sent, round(coalesce((SELECT max(score) FROM dn WHERE dn.qid = q.qid), 0), 4) AS best_cosine FROM q JOIN gold ON gold.id = q.qid JOIN sup ON sup.qid = q.qid""",
    "label_counts": "SELECT label, count(*) AS n FROM (SELECT unnest(['doc=' || coalesce(doc, ''), 'type=' || coalesce(question_type, ''), 'wording=' || coalesce(wording, '')]) AS label FROM gold) GROUP BY label",
    "run_comparison": f"""WITH {sql.RANKING}, {sql.EVIDENCE}, r AS (SELECT q.qid, {_R.format(t='bm')} AS a, {_R.format(t='fu')} AS b FROM q JOIN gold ON gold.id = q.qid AND question_type <> 'unanswerable')
SELECT qid, CASE WHEN {rt._KEY.format('b')} > {rt._KEY.format('a')} THEN 'win' WHEN {rt._KEY.format('b')} < {rt._KEY.format('a')} THEN 'loss' ELSE 'tie' END AS outcome, CAST(coalesce(a, 0) AS INTEGER) AS base_rank, CAST(coalesce(b, 0) AS INTEGER) AS new_rank, FALSE AS broken FROM r""",
    "lost_tails": f"SELECT chunk_id, array_to_string(toks[511:], ' ') AS tail FROM (SELECT chunk_id, regexp_extract_all({sql.INDEX_TEXT}, '{sql.COUNTED}') AS toks FROM chunks) WHERE len(toks) > 510",
}
