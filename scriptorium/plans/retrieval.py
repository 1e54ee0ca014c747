"""Queries of the retrieval pipeline: gold questions against chunks, vectors from embeddings (passage pos has vector pos - 1, question n vector n)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import evaluate, index, prompt, rank
from scriptorium.operators.ordered import Ordered
from scriptorium.operators.search import Corpus, Ranked
from scriptorium.plans import sqltext as sql
from scriptorium.runtime import ensure_checkpoint_dir, read_table
from scriptorium.sources import records


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks")


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), "question")


def corpus_of(spark: SparkSession, sf_dir: str) -> Corpus:
    """The passages with their index. It is stored in the shared folder under the files it was made from (names, sizes, times), so an
    application builds it once for each state of the table; another state has another name."""
    chunks, vectors = chunks_of(spark, sf_dir), vectors_of(spark, sf_dir)
    state = hashlib.sha256("\n".join((spark.sparkContext.applicationId, *records.file_states(spark, f"{sf_dir}/chunks.parquet"))).encode()).hexdigest()[:24]
    path = f"{ensure_checkpoint_dir(spark)}/index-{state}"
    if records.exists(spark, f"{path}/totals/_SUCCESS"):
        return Corpus.read(chunks, vectors, path)
    return Corpus.build(chunks, vectors, path)


def query_vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return queries_of(spark, sf_dir).select("qid", F.regexp_extract("qid", r"(\d+)$", 1).cast("long").alias("vec_id")).join(vec, "vec_id").select("qid", "vec")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, vec) of the passages that have a vector."""
    vectors = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("pos"), F.col("embedding").alias("vec"))
    return vectors.join(chunks_of(spark, sf_dir).select("pos"), "pos", "left_semi")


def ranked_of(spark: SparkSession, sf_dir: str, k: int = rank.CANDIDATES) -> Ranked:
    return Ranked.of(corpus_of(spark, sf_dir), queries_of(spark, sf_dir), query_vectors_of(spark, sf_dir), k)


def evidence_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, pos) of evidence passages."""
    ev = read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), F.explode("evidence.chunk_id").alias("chunk_id"))
    return ev.join(chunks_of(spark, sf_dir).select("pos", "chunk_id"), "chunk_id").select("qid", "pos").distinct()


def search_tokens(spark, sf_dir):
    return index.with_tokens(chunks_of(spark, sf_dir)).select("pos", F.array_join("toks", " ").alias("tokens"), F.col("dl").cast("long").alias("dl"))


def term_stats(spark, sf_dir):
    c = corpus_of(spark, sf_dir)
    return c.stats.select("tok", "df", F.round("idf", 6).alias("idf"))


def _listed(df: DataFrame) -> DataFrame:
    return df.select("qid", "pos", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def bm25_topk(spark, sf_dir):
    c, queries = corpus_of(spark, sf_dir), queries_of(spark, sf_dir)
    return _listed(rank.bm25_ranking(rank.query_terms(queries), c.posts, c.stats, c.n, c.avgdl))


def dense_topk(spark, sf_dir):
    return _listed(rank.dense_ranking(query_vectors_of(spark, sf_dir), vectors_of(spark, sf_dir)))


def _best(spark, sf_dir) -> DataFrame:
    return rank.best_cosine(queries_of(spark, sf_dir), rank.dense_ranking(query_vectors_of(spark, sf_dir), vectors_of(spark, sf_dir)))


def best_cosine(spark, sf_dir):
    return _best(spark, sf_dir).select("qid", F.round("best_cosine", 6).alias("best_cosine"), "low_confidence")


def rrf_hybrid(spark, sf_dir):
    return ranked_of(spark, sf_dir).list_of("hybrid").select("qid", "pos", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def _hits(df: DataFrame, chunks: DataFrame) -> DataFrame:
    return df.join(chunks.select("pos", "chunk_id"), "pos").select("qid", F.col("ord").cast("long").alias("ord"), "chunk_id", F.round("score", 6).alias("score"), "reason")


def _expanded(**switches):
    def run(spark, sf_dir):
        r = ranked_of(spark, sf_dir)
        return _hits(r.hits(**switches), r.corpus.chunks)

    return run


def source_blocks(spark, sf_dir):
    r = ranked_of(spark, sf_dir)
    return prompt.source_blocks(r.hits(), r.corpus.chunks).select("qid", F.col("ord").cast("long").alias("ord"), "chunk_id", "block")


def prompts(spark, sf_dir):
    r = ranked_of(spark, sf_dir)
    return prompt.prompts(r.queries, prompt.source_blocks(r.hits(), r.corpus.chunks))


def amendment_links(spark, sf_dir):
    r = ranked_of(spark, sf_dir)
    return prompt.amendment_links(prompt.numbered(r.hits(), r.corpus.chunks)).select("qid", F.col("original").cast("long").alias("original"), F.col("amendment").cast("long").alias("amendment"))


def _mode_lists(r: Ranked) -> DataFrame:
    out = None
    for mode in ("bm25", "dense", "hybrid"):
        part = r.list_of(mode).select(F.lit(mode).alias("mode"), "qid", "pos", F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def _ranks(spark, sf_dir) -> DataFrame:
    """(mode, qid, rank) of answerable questions; NULL rank if no evidence was ranked."""
    r = ranked_of(spark, sf_dir)
    gold = evidence_of(spark, sf_dir)
    asked = gold.select("qid").distinct()
    found = _mode_lists(r).join(gold, ["qid", "pos"]).groupBy("mode", "qid").agg(F.min("rank").alias("rank"))
    modes = spark.createDataFrame([("bm25",), ("dense",), ("hybrid",)], "mode string")
    return asked.crossJoin(F.broadcast(modes)).join(found, ["mode", "qid"], "left")


def retrieval_eval(spark, sf_dir):
    r = _ranks(spark, sf_dir)
    rank_ = F.col("rank")
    return r.groupBy("mode").agg(
        F.count(F.lit(1)).alias("questions"), *(F.count_if(evaluate.hit_at(rank_, k)).alias(f"hit_{k}") for k in evaluate.CUTOFFS), F.round(F.avg(evaluate.reciprocal(rank_)), 6).alias("mrr"),
    )


def breakdown(spark, sf_dir):
    """Hits at 5 per mode by document, type and wording, in one pass over grouping sets."""
    labels = read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), "doc", "question_type", "wording")
    rows = _ranks(spark, sf_dir).join(labels, "qid")
    sets = rows.groupingSets([[F.col("mode"), F.col("doc")], [F.col("mode"), F.col("question_type")], [F.col("mode"), F.col("wording")]], "mode", "doc", "question_type", "wording")
    return sets.agg(F.count(F.lit(1)).alias("questions"), F.count_if(evaluate.hit_at(F.col("rank"), 5)).alias("hits"))


def wins_losses(spark, sf_dir):
    r = _ranks(spark, sf_dir)
    new = r.filter("mode = 'hybrid'").select("qid", F.col("rank").alias("rank_b"))
    old = r.filter("mode <> 'hybrid'").select("mode", "qid", F.col("rank").alias("rank_a"))
    rows = old.join(new, "qid")
    key = lambda c: F.struct(evaluate.hit_at(F.col(c), 5).cast("int"), evaluate.reciprocal(F.col(c)))
    a, b = key("rank_a"), key("rank_b")
    return rows.groupBy("mode").agg(F.count_if(b > a).alias("wins"), F.count_if(b < a).alias("losses"), F.count_if(b == a).alias("ties"))


def context_ablation(spark, sf_dir):
    r, gold = ranked_of(spark, sf_dir), evidence_of(spark, sf_dir)
    contexts = r.hits_of(evaluate.CONFIGS).select("config", "qid", "pos")
    asked = gold.select("qid").distinct()
    rows = evaluate.support(contexts.join(asked, "qid", "left_semi"), gold, asked)
    return rows.groupBy("config").agg(F.count_if("found").alias("found"), F.count_if("fully").alias("fully"), F.round(F.avg("sent"), 4).alias("avg_sent"))


def threshold_calibration(spark, sf_dir):
    kinds = read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), (F.col("question_type") != "unanswerable").alias("answerable"))
    scores = _best(spark, sf_dir).join(kinds, "qid").select(F.round("best_cosine", 4).alias("score"), "answerable")
    return evaluate.best_threshold(scores)


def score_summary(spark, sf_dir):
    """Least, upper median and greatest best cosine of answerable and unanswerable questions."""
    kinds = read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), (F.col("question_type") != "unanswerable").alias("answerable"))
    rows = _best(spark, sf_dir).join(kinds, "qid").select("answerable", F.round("best_cosine", 6).alias("s"))
    # Counts per score and running counts over them: no task holds all scores of a kind.
    per = rows.groupBy("answerable", "s").agg(F.count(F.lit(1)).alias("n"))
    sums = Ordered.of(per, ["answerable"], ["s"]).running(F.col("n"), "upto").done()
    totals = per.groupBy("answerable").agg(F.sum("n").alias("all"), F.min("s").alias("least"), F.max("s").alias("greatest"))
    at = sums.join(F.broadcast(totals), "answerable").filter(F.col("upto") >= F.floor(F.col("all") / 2) + 1)  # two rows
    return at.groupBy("answerable").agg(F.first("least").alias("least"), F.min("s").alias("upper_median"), F.first("greatest").alias("greatest"))


QUERIES = {
    "search_tokens": search_tokens, "term_stats": term_stats, "bm25_topk": bm25_topk, "dense_topk": dense_topk, "best_cosine": best_cosine, "rrf_hybrid": rrf_hybrid,
    "rare_identifier_pin": _expanded(siblings=False, amendments=False), "sibling_expansion": _expanded(pin=False, amendments=False), "amendment_expansion": _expanded(pin=False, siblings=False),
    "search_full": _expanded(), "source_blocks": source_blocks, "prompts": prompts, "amendment_links": amendment_links, "retrieval_eval": retrieval_eval, "breakdown_grouping_sets": breakdown,
    "wins_losses": wins_losses, "context_ablation": context_ablation, "threshold_calibration": threshold_calibration, "score_summary": score_summary,
}

_LISTED = "SELECT qid, pos, rank, round(score, 6) AS score FROM"
_HITS = "SELECT qid, ord, chunk_id, round(score, 6) AS score, reason FROM hits JOIN chunks USING (pos)"
_RANKS = f"""{sql.EVIDENCE},
lists AS (SELECT 'bm25' AS mode, qid, pos, rank FROM bm UNION ALL SELECT 'dense', qid, pos, rank FROM dn UNION ALL SELECT 'hybrid', qid, pos, rank FROM fu),
grid AS (SELECT mode, qid FROM (SELECT DISTINCT qid FROM ge), (VALUES ('bm25'), ('dense'), ('hybrid')) m(mode)),
ranks AS (SELECT g.mode, g.qid, min(l.rank) AS rank FROM grid g LEFT JOIN (SELECT lists.* FROM lists JOIN ge USING (qid, pos)) l ON l.mode = g.mode AND l.qid = g.qid GROUP BY g.mode, g.qid)"""
_BEST = "best AS (SELECT q.qid, coalesce(max(dn.score), 0) AS s FROM q LEFT JOIN dn ON dn.qid = q.qid GROUP BY q.qid)"
_KINDS = "kinds AS (SELECT id AS qid, question_type <> 'unanswerable' AS answerable FROM gold)"
_BLOCKS = f"""
src AS (SELECT h.qid, h.ord, k.chunk_id, k.title, k.text, k.is_amendment, k.covers, k.amends, {sql.CITATION} AS citation FROM hits h JOIN chunks k ON k.pos = h.pos),
links AS (SELECT DISTINCT o.qid, o.ord AS original, a.ord AS amendment, a.text AS change FROM src o JOIN src a ON a.qid = o.qid AND NOT o.is_amendment AND a.is_amendment AND list_has_any(o.covers, a.amends)),
above AS (SELECT qid, original AS ord, string_agg('AMENDED by [S' || amendment || ']: ' || change, chr(10) ORDER BY amendment) AS changes FROM links GROUP BY ALL),
targets AS (SELECT qid, amendment AS ord, string_agg('[S' || original || ']', ', ' ORDER BY original) AS refs FROM links GROUP BY ALL),
blocks AS (SELECT qid, ord, chunk_id, '[S' || ord || '] ' || citation || CASE WHEN title <> '' THEN ' - ' || title ELSE '' END
  || CASE WHEN is_amendment THEN CASE WHEN refs IS NOT NULL THEN chr(10) || 'This is an AMENDMENT to ' || refs || '.' ELSE chr(10) || 'This is an AMENDMENT.' END ELSE '' END || chr(10)
  || CASE WHEN changes IS NOT NULL THEN changes || chr(10) || 'Original text (superseded where the amendment differs):' || chr(10) || text ELSE text END AS block
  FROM src LEFT JOIN above USING (qid, ord) LEFT JOIN targets USING (qid, ord))"""
_W = f"WITH {sql.RANKING}"
_KEY = "(CASE WHEN coalesce({0} <= 5, FALSE) THEN 10 ELSE 0 END + CASE WHEN {0} <= 10 THEN 1.0 / {0} ELSE 0 END)"
_A, _B = _KEY.format("a.rank"), _KEY.format("b.rank")
ORACLE = {
    "search_tokens": f"SELECT pos, coalesce(array_to_string(toks, ' '), '') AS tokens, len(toks) AS dl FROM (SELECT pos, {sql.search_tokens(sql.INDEX_TEXT)} AS toks FROM chunks)",
    "term_stats": f"{_W} SELECT tok, df, round(idf, 6) AS idf FROM stats",
    "bm25_topk": f"{_W} {_LISTED} bm",
    "dense_topk": f"{_W} {_LISTED} dn",
    "best_cosine": f"{_W}, {_BEST} SELECT qid, round(s, 6) AS best_cosine, s < 0.51 AS low_confidence FROM best",
    "rrf_hybrid": f"{_W} SELECT qid, pos, CAST(coalesce(bm25_rank, 0) AS INTEGER) AS bm25_rank, CAST(coalesce(dense_rank, 0) AS INTEGER) AS dense_rank, rank, round(score, 9) AS score FROM fu",
    "rare_identifier_pin": f"{_W}, {sql.expansion(siblings=False, amendments=False)} {_HITS}",
    "sibling_expansion": f"{_W}, {sql.expansion(pin=False, amendments=False)} {_HITS}",
    "amendment_expansion": f"{_W}, {sql.expansion(pin=False, siblings=False)} {_HITS}",
    "search_full": f"{_W}, {sql.expansion()} {_HITS}",
    "source_blocks": f"{_W}, {sql.expansion()}, {_BLOCKS} SELECT qid, ord, chunk_id, block FROM blocks",
    "prompts": f"""{_W}, {sql.expansion()}, {_BLOCKS} SELECT b.qid, 'Question: ' || any_value(question) || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY ord)
  || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || chr(10) || 'Answer (cite sources as [S#]):' AS prompt FROM blocks b JOIN q ON q.qid = b.qid GROUP BY b.qid""",
    "amendment_links": f"{_W}, {sql.expansion()}, {_BLOCKS} SELECT DISTINCT qid, original, amendment FROM links",
    "retrieval_eval": f"""{_W}, {_RANKS} SELECT mode, count(*) AS questions, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM ranks GROUP BY mode""",
    "breakdown_grouping_sets": f"""{_W}, {_RANKS} SELECT mode, doc, question_type, wording, count(*) AS questions, count(*) FILTER (rank <= 5) AS hits FROM ranks JOIN gold ON gold.id = ranks.qid
  GROUP BY GROUPING SETS ((mode, doc), (mode, question_type), (mode, wording))""",
    "wins_losses": f"""{_W}, {_RANKS} SELECT a.mode, count(*) FILTER ({_B} > {_A}) AS wins, count(*) FILTER ({_B} < {_A}) AS losses, count(*) FILTER ({_B} = {_A}) AS ties
  FROM ranks a JOIN ranks b ON a.qid = b.qid AND b.mode = 'hybrid' AND a.mode <> 'hybrid' GROUP BY a.mode""",
    "context_ablation": _W + ", " + sql.EVIDENCE + "".join(
        ", " + sql.expansion(*switches, tag=f"_{name}") for name, switches in evaluate.CONFIGS.items()
    ) + ", ctx AS (" + " UNION ALL ".join(f"SELECT '{name}' AS config, qid, pos FROM hits_{name}" for name in evaluate.CONFIGS) + """),
per AS (SELECT config, c.qid, count(*) AS sent, count(g.pos) AS got FROM ctx c LEFT JOIN ge g ON g.qid = c.qid AND g.pos = c.pos GROUP BY ALL),
need AS (SELECT qid, count(*) AS n FROM ge GROUP BY qid)
SELECT config, count(*) FILTER (got > 0) AS found, count(*) FILTER (got >= n) AS fully, round(avg(sent), 4) AS avg_sent FROM per JOIN need USING (qid) GROUP BY config""",
    "threshold_calibration": f"""{_W}, {_BEST}, {_KINDS}, s AS (SELECT round(s, 4) AS score, answerable FROM best JOIN kinds USING (qid)),
d AS (SELECT DISTINCT score FROM s), m0 AS (SELECT score, lead(score) OVER (ORDER BY score) AS nxt, count(*) OVER () AS n FROM d),
m AS (SELECT DISTINCT CASE WHEN nxt IS NOT NULL THEN round_even((score + nxt) / 2, 3) ELSE score END AS threshold FROM m0 WHERE nxt IS NOT NULL OR n = 1),
e AS (SELECT threshold, count(*) FILTER (NOT answerable AND score < threshold) AS flagged, count(*) FILTER (NOT answerable) AS unanswerable, count(*) FILTER (answerable AND score < threshold) AS false_alarms, count(*) FILTER (answerable) AS answerable FROM m, s GROUP BY threshold)
SELECT * FROM e ORDER BY flagged + answerable - false_alarms DESC, false_alarms, threshold LIMIT 1""",
    "score_summary": f"""{_W}, {_BEST}, {_KINDS}, o AS (SELECT answerable, round(s, 6) AS s, row_number() OVER (PARTITION BY answerable ORDER BY s) AS k, count(*) OVER (PARTITION BY answerable) AS n FROM best JOIN kinds USING (qid))
SELECT answerable, min(s) AS least, max(s) FILTER (k = n // 2 + 1) AS upper_median, max(s) AS greatest FROM o GROUP BY answerable""",
}
