"""Keyword ranking, dense ranking and their fusion, for whole batches of queries.

Queries are (qid, question); passages carry `pos`, their place in the list, which settles all ties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from scriptorium.functions import text as tx
from scriptorium.runtime import cut_lineage

K1, B = 1.5, 0.75
RRF_K, CANDIDATES = 60, 30
#: Vectors per block of the query by passage grid. What is copied for a batch of queries is the index once per QUERY_BLOCK of them, so that is large; a cell
#: works on as many of its queries at a time as CELLS scores allow.
QUERY_BLOCK, PASSAGE_BLOCK = 32768, 16384
#: Query tokens, and postings, of a cell of the keyword grid: as few blocks as that allows, as each side is copied to all blocks of the other.
CELL_ROWS = 1_000_000
#: Scores held at once in a cell; and where they are only looked at once.
CELLS, TILE = 1 << 22, 1 << 20
#: Queries and passages of a cell that only counts.
COUNTED_QUERIES, COUNTED_PASSAGES = 1 << 16, 1 << 16


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, tok, qtf, first): distinct tokens of each query, how often, and where first."""
    toks = queries.select("qid", F.posexplode(tx.search_tokens(F.col("question"))).alias("at", "tok"))
    return toks.groupBy("qid", "tok").agg(F.count(F.lit(1)).alias("qtf"), F.min("at").alias("first"))


def weighted_terms(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, tok, w): a token counts as often as the query has it."""
    return terms.join(stats, "tok").select("qid", "tok", (F.col("qtf") * F.col("idf")).alias("w"))


def saturation(avgdl: float):
    """What a posting is worth before the weight of its token."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))


def bm25_scores_of(pairs: DataFrame, terms: DataFrame, posts: DataFrame, stats: DataFrame, avgdl: float) -> DataFrame:
    """(qid, pos, score) of given pairs (qid, pos) only."""
    rows = pairs.select("qid", "pos").distinct().join(posts, "pos").join(weighted_terms(terms, stats), ["qid", "tok"])
    return rows.groupBy("qid", "pos").agg(F.sum(F.col("w") * saturation(avgdl)).alias("score"))


def bm25_ranking(terms: DataFrame, posts: DataFrame, stats: DataFrame, n: int, avgdl: float, k: int = CANDIDATES, query_block: int | None = None, passage_block: int | None = None) -> DataFrame:
    """(qid, pos, score, rank): the best k passages of each query among those with a score above 0.

    The index is cut by passage: a cell of the grid of query blocks by passage blocks adds up the scores of its passages and
    keeps k per query, so neither all scores nor all matches are ever shuffled, however common a token is.
    """
    spark = posts.sparkSession
    weights = cut_lineage(weighted_terms(terms, stats).select("qid", F.xxhash64("tok").alias("token"), "w"))
    if query_block:
        bq = max(1, -(-weights.agg(F.count_distinct("qid")).first()[0] // query_block))
    else:
        bq = max(1, -(-weights.count() // CELL_ROWS))
    if passage_block:
        bp = max(1, -(-n // passage_block))
    else:  # with few queries the passages are spread over the cores
        bp = max(1, -(-posts.count() // CELL_ROWS), min(-(-spark.sparkContext.defaultParallelism // bq), -(-n // 256)))
    q = weights.withColumn("bq", F.pmod(F.xxhash64("qid"), F.lit(bq)).cast("int")).withColumn("bp", F.explode(F.sequence(F.lit(0), F.lit(bp - 1))))
    # Only postings of tokens that are asked for are copied to the cells of their passages.
    asked = weights.select(F.col("token").alias("term")).distinct()
    posts = posts.withColumn("term", F.xxhash64("tok")).join(asked, "term", "left_semi")
    p = posts.select("pos", "term", saturation(avgdl).alias("sat"), F.pmod(F.xxhash64("pos"), F.lit(bp)).cast("int").alias("pp")).withColumn("pq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame([], columns=["qid", "pos", "score"])
        names, qi = np.unique(left.qid.to_numpy(object), return_inverse=True)
        places, pi = np.unique(right.pos.to_numpy(), return_inverse=True)
        order = np.argsort(right.term.to_numpy(), kind="stable")
        term, pi, sat = right.term.to_numpy()[order], pi[order], right.sat.to_numpy()[order]
        token, w = left.token.to_numpy(), left.w.to_numpy()
        first = np.searchsorted(term, token, side="left")
        many = np.searchsorted(term, token, side="right") - first
        by = np.argsort(qi, kind="stable")
        qi, w, first, many = qi[by], w[by], first[by], many[by]
        out, step = [], max(1, CELLS // max(1, len(places)))
        for low in range(0, len(names), step):
            a, b = np.searchsorted(qi, [low, low + step])
            at = np.repeat(first[a:b] - (np.cumsum(many[a:b]) - many[a:b]), many[a:b]) + np.arange(int(many[a:b].sum()))
            high = min(step, len(names) - low)
            flat = np.repeat(qi[a:b] - low, many[a:b]) * len(places) + pi[at]
            scores = np.bincount(flat, np.repeat(w[a:b], many[a:b]) * sat[at], high * len(places)).reshape(high, len(places))
            scores[scores <= 0] = -np.inf
            best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(scores, best, axis=1)
            row, col = np.nonzero(np.isfinite(top))
            out.append((names[low + row], places[best[row, col]], top[row, col]))
        return pd.DataFrame({"qid": np.concatenate([x for x, _, _ in out]), "pos": np.concatenate([x for _, x, _ in out]), "score": np.concatenate([x for _, _, x in out])})

    kind = dict(terms.dtypes)["qid"]
    met = q.groupBy("bq", "bp").cogroup(p.groupBy("pq", "pp")).applyInPandas(cell, f"qid {kind}, pos long, score double")
    return ranked(met, k)


def ranked(scores: DataFrame, k: int | None) -> DataFrame:
    """(qid, pos, score, rank): by score to nine places, then by pos; the first k of each query if k is given."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pos")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k else out


def dense_ranking(query_vectors: DataFrame, vectors: DataFrame, k: int = CANDIDATES, query_block: int = QUERY_BLOCK, passage_block: int = PASSAGE_BLOCK) -> DataFrame:
    """(qid, pos, score, rank) by dot product of (qid, vec) with (pos, vec).

    Blocks of queries meet blocks of passages in a grid; each cell is one matrix product that keeps its
    best k per query, so what is shuffled for the last cut is k rows per query and block of passages.
    """
    n_q, n_p = query_vectors.count(), vectors.count()
    bq, bp = max(1, -(-n_q // query_block)), max(1, -(-n_p // passage_block))
    q = query_vectors.select("qid", F.col("vec").alias("qvec"), F.pmod(F.xxhash64("qid"), F.lit(bq)).cast("int").alias("bq")).withColumn("bp", F.explode(F.sequence(F.lit(0), F.lit(bp - 1))))
    p = vectors.select("pos", "vec", F.pmod(F.xxhash64("pos"), F.lit(bp)).cast("int").alias("pp")).withColumn("pq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))

    def cell(queries: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or passages.empty:
            return pd.DataFrame([], columns=["qid", "pos", "score"])
        passages = passages.sort_values("pos", ignore_index=True)
        names, places = np.array(list(queries.qid), dtype=object), passages.pos.to_numpy()
        b = np.stack(passages.vec).astype(np.float64).T
        out, step = [], max(1, CELLS // len(places))
        for low in range(0, len(names), step):
            scores = np.stack(queries.qvec.iloc[low : low + step]).astype(np.float64) @ b
            best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
            out.append((np.repeat(names[low : low + step], best.shape[1]), places[best].ravel(), np.take_along_axis(scores, best, axis=1).ravel()))
        return pd.DataFrame({"qid": np.concatenate([x for x, _, _ in out]), "pos": np.concatenate([x for _, x, _ in out]), "score": np.concatenate([x for _, _, x in out])})

    kind = dict(query_vectors.dtypes)["qid"]
    met = q.groupBy("bq", "bp").cogroup(p.groupBy("pq", "pp")).applyInPandas(cell, f"qid {kind}, pos long, score double")
    return ranked(met, k)


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double and in single precision."""
    exact = np.stack(vectors.to_numpy()).astype(np.float64)
    return exact, exact.astype(np.float32)


def _off(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much a product in single precision may be off, for each row of a."""
    return 1e-7 + 2.4e-7 * a.shape[1] * np.linalg.norm(a, axis=1) * (np.linalg.norm(b, axis=1).max() if len(b) else 0.0)


def _tiles(n: int, first: int = 512):
    """Ranges of 0 to n, each twice as long as the one before, up to eight times the first."""
    low, size = 0, first
    while low < n:
        yield low, min(n, low + size)
        low, size = low + size, min(2 * size, 8 * first)


def _near_any(a: np.ndarray, a32: np.ndarray, b: np.ndarray, b32: np.ndarray, least: float) -> np.ndarray:
    """Whether the best product of each row of a with the rows of b, to nine places, the first of equal ones, is `least` or more."""
    off, sure, most = _off(a, b), np.zeros(len(a), bool), np.full(len(a), -np.inf)
    for low, high in _tiles(len(b)):
        left = np.flatnonzero(~sure)
        for i in range(0, len(left), step := max(1, TILE // (high - low))):
            rows = left[i : i + step]
            most[rows] = np.maximum(most[rows], (a32[rows] @ b32[low:high].T).max(axis=1))
        sure = most >= least + off + 1e-9
    close = np.flatnonzero(~sure & (most >= least - off - 1e-9))
    for i in range(0, len(close), step := max(1, CELLS // max(1, len(b)))):
        scores = a[close[i : i + step]] @ b.T
        sure[close[i : i + step]] = scores[np.arange(len(scores)), np.round(scores, 9).argmax(axis=1)] >= least
    return sure


def near_any(query_vectors: DataFrame, vectors: DataFrame, least: float, query_block: int = COUNTED_QUERIES, passage_block: int = COUNTED_PASSAGES) -> DataFrame:
    """(qid) of the queries (qid, vec) with a product of `least` or more with one of (pos, vec). A query is done with as soon as one is found."""
    cores = query_vectors.sparkSession.sparkContext.defaultParallelism
    bq, bp = max(1, cores, -(-query_vectors.count() // query_block)), max(1, -(-vectors.count() // passage_block))
    q = query_vectors.select("qid", F.col("vec").alias("qvec"), F.pmod(F.xxhash64("qid"), F.lit(bq)).cast("int").alias("bq")).withColumn("bp", F.explode(F.sequence(F.lit(0), F.lit(bp - 1))))
    p = vectors.select("pos", "vec", F.pmod(F.xxhash64("pos"), F.lit(bp)).cast("int").alias("pp")).withColumn("pq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))

    def cell(queries: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or passages.empty:
            return pd.DataFrame([], columns=["qid"])
        return queries.loc[_near_any(*_matrix(queries.qvec), *_matrix(passages.sort_values("pos").vec), least), ["qid"]]

    kind = dict(query_vectors.dtypes)["qid"]
    return q.groupBy("bq", "bp").cogroup(p.groupBy("pq", "pp")).applyInPandas(cell, f"qid {kind}").distinct()


def _ahead(a: np.ndarray, a32: np.ndarray, own: np.ndarray, score: np.ndarray, b: np.ndarray, b32: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """How many of the passages, by place, come before the own one of each query, which has this score; k or more may be given as any number from k."""
    off, ahead = _off(a, b), np.zeros(len(a), np.int64)
    limit = np.nextafter((score + off + 2e-9).astype(np.float32), np.float32(np.inf))
    for low, high in _tiles(len(b)):
        left = np.flatnonzero(ahead < k)
        for i in range(0, len(left), step := max(1, TILE // (high - low))):
            rows = left[i : i + step]
            ahead[rows] += np.count_nonzero(a32[rows] @ b32[low:high].T > limit[rows, None], axis=1)
    left, mine = np.flatnonzero(ahead < k), np.round(score, 9)[:, None]
    for i in range(0, len(left), step := max(1, CELLS // max(1, len(b)))):
        rows = left[i : i + step]
        scores = np.round(a[rows] @ b.T, 9)
        ahead[rows] = np.count_nonzero((scores > mine[rows]) | ((scores == mine[rows]) & (places < own[rows, None])), axis=1)
    return ahead


def within(query_vectors: DataFrame, targets: DataFrame, vectors: DataFrame, k: int, query_block: int = COUNTED_QUERIES, passage_block: int = COUNTED_PASSAGES) -> DataFrame:
    """(qid, pos) of the targets (qid, pos) that stand in the first k of `dense_ranking`, without the lists.

    What comes before a target is counted, first in its own block of passages; only where that is fewer than k are the other blocks looked at.
    """
    n_q, n_p = query_vectors.count(), vectors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    bp = max(1, -(-n_p // passage_block))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bp)).cast("int")
    kind = dict(query_vectors.dtypes)["qid"]

    def cell(queries: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        passages = passages.sort_values("pos", ignore_index=True)
        places = passages.pos.to_numpy()
        if queries.score.isna().all():  # their own passages are in this block, if they have vectors
            queries = queries[queries.own.isin(places)]
        if queries.empty or passages.empty:
            return pd.DataFrame([], columns=["qid", "pos", "score", "ahead"])
        a, b, own = _matrix(queries.qvec), _matrix(passages.vec), queries.own.to_numpy()
        if queries.score.isna().all():
            score = np.einsum("ij,ij->i", a[0], b[0][np.searchsorted(places, own)])
        else:
            score = queries.score.to_numpy(float)
        ahead = _ahead(*a, own, score, *b, places, k)
        return pd.DataFrame({"qid": queries.qid.to_numpy(), "pos": own, "score": score, "ahead": ahead})[ahead < k]

    def counted(q: DataFrame, parts: int) -> DataFrame:
        """q is (qid, qvec, own, score, bp)."""
        p = vectors.select("pos", "vec", block("pos").alias("pp")).withColumn("pq", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        q = q.withColumn("bq", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
        return cut_lineage(q.groupBy("bq", "bp").cogroup(p.groupBy("pq", "pp")).applyInPandas(cell, f"qid {kind}, pos long, score double, ahead long"))

    own = targets.select("qid", F.col("pos").cast("long").alias("own")).distinct()
    asked = query_vectors.select("qid", F.col("vec").alias("qvec")).join(own, "qid")
    first = counted(asked.withColumn("score", F.lit(None).cast("double")).withColumn("bp", block("own")), max(1, -(-cores // bp), -(-n_q // (bp * query_block))))
    if bp == 1:
        return first.select("qid", "pos")
    few = asked.join(first.select("qid", F.col("pos").alias("own"), "score"), ["qid", "own"])
    others = few.withColumn("bp", F.explode(F.sequence(F.lit(0), F.lit(bp - 1)))).filter(F.col("bp") != block("own"))
    rest = counted(others, max(1, -(-cores // bp)))
    # A block that gave no row for a target holds k or more that come before it.
    total = rest.groupBy("qid", "pos").agg(F.count(F.lit(1)).alias("blocks"), F.sum("ahead").alias("more"))
    return first.join(total, ["qid", "pos"]).filter((F.col("blocks") == bp - 1) & (F.col("ahead") + F.col("more") < k)).select("qid", "pos")


def dot(a, b):
    """Dot product of two array columns, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def fused(bm25: DataFrame, dense: DataFrame, c: int = RRF_K) -> DataFrame:
    """(qid, pos, score, bm25_rank, dense_rank, rank): reciprocal rank fusion; ties in the order bm25 list, then dense list."""
    both = bm25.select("qid", "pos", F.col("rank").alias("b"), F.lit(None).cast("int").alias("d")).unionByName(dense.select("qid", "pos", F.lit(None).cast("int").alias("b"), F.col("rank").alias("d")))
    one = both.groupBy("qid", "pos").agg(F.max("b").alias("bm25_rank"), F.max("d").alias("dense_rank"))
    score = F.coalesce(1 / (c + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (c + F.col("dense_rank")), F.lit(0.0))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("bm25_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last())
    return one.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def best_cosine(queries: DataFrame, dense: DataFrame, cutoff: float = 0.51) -> DataFrame:
    """(qid, best_cosine, low_confidence): 0 for a query without dense hits."""
    best = dense.groupBy("qid").agg(F.max("score").alias("m"))
    value = F.coalesce("m", F.lit(0.0))
    return queries.select("qid").join(best, "qid", "left").select("qid", value.alias("best_cosine"), (value < cutoff).alias("low_confidence"))
