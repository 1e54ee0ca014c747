"""Mining of training pairs: near-duplicates, hard negatives, the filter cascade, splits and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import keyword, rank
from scriptorium.operators.search import Corpus
from scriptorium.runtime import cut_lineage, widen, write_out
from scriptorium.sources.model import Embedder, embed

NEAR, POOL, TOP_N, LEAK = 0.8, 10, 50, 0.85


#: Sets of at most this many words are joined on pairs of rare words, larger ones on single ones. A word in one of COMMON sets is common: there are at most COMMON
#: times as many of these as a set has words. Pairs that are looked at at once.
SHORT, COMMON, AT_ONCE = 64, 1000, 1 << 20


def _keys(ids: np.ndarray, starts: np.ndarray, words: np.ndarray, common: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, key) of sets given by the hashes of their words, which begin at `starts`."""
    n = np.diff(starts)
    of = np.repeat(np.arange(len(ids)), n)
    at = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
    c = np.where(common[at] == words, counts[at], 0) if len(common) else np.zeros(len(words), np.int64)
    words = words[np.lexsort((words, c, of))].view(np.uint64)  # by set, the rarest first
    spare = n - np.ceil(n * t - 1e-9).astype(np.int64)
    begin, mix, out = starts[:-1], np.uint64(0x9E3779B97F4A7C15), []
    # Words are in one order in all sets, so the two of a pair are too.
    for a in range(int((spare + 2)[n <= SHORT].max(initial=0))):
        for b in range(a + 1, int((spare + 2)[n <= SHORT].max(initial=0))):
            has = np.flatnonzero((n <= SHORT) & (b < np.minimum(n, spare + 2)))
            x, y = words[begin[has] + a], words[begin[has] + b]
            out.append((has, (x ^ (x >> np.uint64(29))) * mix + (y ^ (y >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)))
    for a in range(int((spare + 1)[n >= t * SHORT].max(initial=0))):
        has = np.flatnonzero((n >= t * SHORT) & (a < spare + 1))
        out.append((has, (words[begin[has] + a] + np.uint64(1)) * mix))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]).view(np.int64)


def _close(key: np.ndarray, i: np.ndarray, n: np.ndarray, sketch: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows with one key of which the sketches don't differ by more than alike sets do."""
    by = np.lexsort((i, key))
    key, i, n, sketch = key[by], i[by], n[by], sketch[by].view(np.uint64)
    end = np.searchsorted(key, key, side="right")
    left, step = np.arange(len(key)), 1
    while len(left := left[left + step < end[left]]):
        for low in range(0, len(left), AT_ONCE):
            a = left[low : low + AT_ONCE]
            b = a + step
            near = (i[a] < i[b]) & (np.bitwise_count(sketch[a] ^ sketch[b]) <= share * (n[a] + n[b]) + 1e-9)
            if near.any():
                yield i[a[near]], i[b[near]]
        step += 1


def near_duplicates(questions: DataFrame, t: float = NEAR) -> DataFrame:
    """(i): questions that share at least a part t of their words with an earlier one, kept or not. questions is (i, question).

    Sets of n words that are alike share at least t * n of them, so their n - ceil(t * n) + 2 rarest words (in one order of all words) have two in
    common: short sets are joined on pairs of these, which few sets share however common a word is. Of larger sets one of the
    n - ceil(t * n) + 1 rarest words is the key. Any order of the words will do; common words come last, by count. A sketch (a bit flipped per word)
    bounds the difference before the words are compared, and equal sets are compared once. An empty set is like no other.
    """
    share = (1 - t) / (1 + t)
    spark, kind = questions.sparkSession, dict(questions.dtypes)["i"]
    listed = widen(questions.select("i", "question")).select("i", F.array_sort(F.array_distinct(tx.words(F.col("question")))).alias("ws")).filter(F.size("ws") > 0)
    sketch = F.expr("aggregate(ws, 0L, (acc, w) -> acc ^ shiftleft(1L, cast(pmod(xxhash64(w), 64L) AS int)))")
    sets = listed.groupBy("ws").agg(F.min("i").alias("i"), F.collect_list("i").alias("all")).withColumn("n", F.size("ws")).withColumn("sketch", sketch)
    sets = write_out(sets)
    hashed = sets.select("i", "n", "sketch", F.transform("ws", lambda w: F.xxhash64(w)).alias("h"))
    least = -(-sets.count() // COMMON)
    often = hashed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least).toPandas().sort_values("h")
    often = spark.sparkContext.broadcast((often.h.to_numpy(np.int64), often.c.to_numpy(np.int64)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            starts = lists.offsets.to_numpy().astype(np.int64)
            of, key = _keys(np.arange(b.num_rows), starts - starts[0], lists.flatten().to_numpy(zero_copy_only=False), *often.value, t)
            for low in range(0, len(of), 1 << 16):
                at = pa.array(of[low : low + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(key[low : low + (1 << 16)]), *(b.column(c).take(at) for c in range(3))], names=["key", "i", "n", "sketch"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            for i, j in _close(*(rows.column(c).to_numpy() for c in ("key", "i", "n", "sketch")), share):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["i", "j"])

    pairs = hashed.mapInArrow(keys, f"key long, i {kind}, n int, sketch long").repartition("key").mapInArrow(close, f"i {kind}, j {kind}").distinct()
    x, y = sets.select("i", F.col("ws").alias("wi")), sets.select(F.col("i").alias("j"), F.col("ws").alias("wj"))
    alike = pairs.join(x, "i").join(y, "j").filter(tx.jaccard(F.col("wi"), F.col("wj")) >= t - 1e-9)
    # i is the earlier of the two first appearances; a repetition of a set comes after its first appearance in any case.
    earliest = alike.groupBy("j").agg(F.min("i").alias("first"))
    reach = sets.select("i", "all").join(earliest, F.col("i") == F.col("j"), "left").select(F.least(F.col("i"), F.coalesce("first", F.col("i"))).alias("first"), F.explode("all").alias("i"))
    return reach.filter("i > first").select("i")


def is_related(a_id: Column, a_doc: Column, a_sec: Column, a_parent: Column, a_cov: Column, a_am: Column, b_id: Column, b_doc: Column, b_sec: Column, b_parent: Column, b_cov: Column, b_am: Column) -> Column:
    """Same passage, section family, table, or linked by an amendment."""
    family = (a_doc == b_doc) & (tx.section_family(a_sec) == tx.section_family(b_sec))
    return (a_id == b_id) | family | ((a_parent != "") & (a_parent == b_parent)) | F.arrays_overlap(a_am, b_cov) | F.arrays_overlap(b_am, a_cov)


def hard_negatives(positives: DataFrame, bm25: DataFrame, chunks: DataFrame, pool: int = POOL) -> DataFrame:
    """(qid, negative_id): the best of the first `pool` keyword hits that has nothing to do with the passage of the question. positives is (qid, pos)."""
    cols = ("chunk_id", "doc_id", "section", "parent", "covers", "amends")
    p = chunks.select("pos", *(F.col(c).alias(f"p_{c}") for c in cols))
    n = chunks.select("pos", *(F.col(c).alias(f"n_{c}") for c in cols))
    rows = positives.join(p, "pos").drop("pos").join(bm25.filter(F.col("rank") <= pool).select("qid", "pos", "rank"), "qid").join(n, "pos")
    free = rows.filter(~is_related(*(F.col(f"p_{c}") for c in cols), *(F.col(f"n_{c}") for c in cols)))
    return free.groupBy("qid").agg(F.min_by("n_chunk_id", "rank").alias("negative_id"))


def filter_reason(near: Column, mentions: Column, copies: Column, leaks: Column, retrievable: Column, negative: Column) -> Column:
    """The first reason, in order of cost, to drop a question; NULL to keep it."""
    return (
        F.when(near, "near-duplicate").when(mentions, "refers to 'the passage'").when(copies, "copies a phrase from its passage").when(leaks, "too similar to a gold question")
        .when(~retrievable, f"passage not in BM25 or dense top {TOP_N}").when(negative.isNull(), f"no unrelated hard negative in the BM25 top {POOL}")
    )


def leaks(vectors: DataFrame, gold_vectors: DataFrame, least: float = LEAK) -> DataFrame:
    """(qid, gold, cosine): the gold question nearest to each question, where it is nearer than allowed. Both are (key, vec) of length 1, gold by number `pos`."""
    return rank.dense_ranking(vectors, gold_vectors, 1).filter(F.col("score") >= least).select("qid", F.col("pos").alias("gold"), F.col("score").alias("cosine"))


def filter_cascade(questions: DataFrame, positives: DataFrame, gold: DataFrame, corpus: Corpus, embedder: Embedder, prefix: str = "") -> DataFrame:
    """(qid, reason, negative_id) of questions (qid, question) with a passage (qid, pos): all six checks, each on what the ones before leave.

    gold is (pos, question). A passage counts as found by the keyword list or the dense list. Whether it stands there is settled by counting what comes before
    it, until that is too much; the keyword list of the negative is made for the questions that are left then.
    """
    flag = lambda df, name: df.select("qid", F.lit(True).alias(name)).distinct()
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    every = write_out(questions.join(positives, "qid", "left").select("qid", "pos", "question"))
    near = cut_lineage(flag(near_duplicates(every.select(F.col("qid").alias("i"), "question")).withColumnRenamed("i", "qid"), "near"))
    # The texts come last, so they are moved once.
    rows = every.filter("pos IS NOT NULL").join(near, "qid", "left").join(corpus.chunks.select("pos", "text"), "pos")
    rows = write_out(rows.select("qid", "pos", "question", yes("near").alias("near"), tx.mentions_prompt(F.col("question")).alias("mentions"), tx.copies_phrase(F.col("question"), F.col("text")).alias("copies")))
    left = rows.filter(~(F.col("near") | F.col("mentions") | F.col("copies"))).select("qid", "pos", "question")
    vectors = write_out(embed(widen(left), "qid", "question", embedder, prefix))
    leak = cut_lineage(rank.near_any(vectors, cut_lineage(embed(gold, "pos", "question", embedder, prefix)), LEAK).withColumn("leak", F.lit(True)))
    left = write_out(left.join(leak, "qid", "left_anti"))
    own = left.select("qid", "pos")
    # As many blocks as cores, so that the postings go to one cell each and not to several for different questions.
    cores = questions.sparkSession.sparkContext.defaultParallelism
    grid = keyword.Grid(corpus.posts, corpus.stats, corpus.n, corpus.avgdl, min(keyword.PASSAGES, max(keyword.AT_FIRST, -(-corpus.n // cores))))
    listed = grid.candidates(left, own, TOP_N)
    passages = write_out(embed(widen(corpus.chunks.select("pos", "text")), "pos", "text", embedder))
    dense = cut_lineage(flag(rank.within(vectors.join(left.select("qid"), "qid", "left_semi"), own, passages, TOP_N), "found"))
    asked = left.join(listed.select("qid").union(dense.select("qid")), "qid", "left_semi")
    bm25, places = grid.search(asked, POOL, listed)
    found = dense.unionByName(flag(places.filter(F.col("rank") <= TOP_N), "found")).distinct()
    rows = rows.drop("question", "pos").join(leak, "qid", "left").join(found, "qid", "left").join(hard_negatives(own, bm25, corpus.chunks), "qid", "left")
    reason = filter_reason(F.col("near"), F.col("mentions"), F.col("copies"), yes("leak"), yes("found"), F.col("negative_id"))
    return rows.select("qid", F.coalesce(reason, F.lit("kept")).alias("reason"), F.when(reason.isNull(), F.col("negative_id")).alias("negative_id"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with n0, their place from 0, without gathering them in one task: places within ranges of the first key plus the counts before.

    Rows with equal first key fall in one range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    # One row per shuffle partition.
    return local.join(F.broadcast(before), "__part").withColumn("n0", F.col("__before") + F.col("__k") - 1).drop("__part", "__k", "__before")


def spread_sample(numbered_rows: DataFrame, total: int, limit: int) -> DataFrame:
    """The rows at places i*n // limit: `limit` rows spread evenly; all if there are no more."""
    if limit >= total:
        return numbered_rows
    i = F.floor((F.col("n0") * limit + total - 1) / total)
    return numbered_rows.filter((F.floor(i * total / limit) == F.col("n0")) & (i < limit))


def seeded_split(rows: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with `split`: the round(n * fraction) rows with the smallest hash of seed and key are validation."""
    total = rows.count()
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    n = round(total * fraction)
    return numbered(rows.withColumn("__h", h), "__h", key).withColumn("split", F.when(F.col("n0") < n, "validation").otherwise("train")).drop("__h", "n0")
