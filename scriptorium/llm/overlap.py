"""Problem 6: the same or nearly the same records across splits.

Texts are alike as in problem 1: the sets of their words share at least a part t of the union. Word order plays no part in that, so each
distinct set is written down as a sequence: its words in one fixed order (that of a hash) between a start and an end mark.
The suffixes of all sequences of both sides form a suffix array, partitioned by their first tokens; each part sorts its own suffixes
and compares neighbours: suffixes of different splits with a common prefix of at least `span_for(t)` tokens reveal a shared span. The
spans of a pair are merged to its coverage, in tokens of the evaluation record. Pairs whose coverage is too small for alike sets fall out, the
others are checked exactly on the words.

Why nothing is lost. Alike sets with o common words differ in H <= (1-t)/t * o words, which break the o + 2 common tokens (marks
included) into at most H + 1 runs; the longest has at least (o+2)/(H+1) tokens, and `span_for(t)` is the least that may
come to over all o. Runs that are shorter hold at most H * (span-1) tokens, so the spans of alike sets cover the rest of the o + 2.
Where a suffix goes on alike by chance (a byte stands for each token after the span) a coverage is too large, never too small.

Scale. Training suffixes whose first tokens no evaluation suffix has are dropped where they arise, by a table of BITMAP bits (its size doesn't grow; it
only tells less of more evaluation records). A start that more than `run` training suffixes are expected to share (as a
sample of sets shows, see `similar`) is dealt to blocks: training suffixes go to one, evaluation suffixes to each.

Copies: equal word sets of one side are one sequence. p6_found gives all their ids in all combinations, p6_report counts
them by classes. `overlaps` with a bound gives the first `expand` ids of a class in all combinations; a further evaluation
id is then linked to the smallest training id of each class, and the other way round.

Defined results: texts that are null or have fewer than MIN_WORDS words overlap with nothing; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.llm.similar import BLOCK, EXPAND, MIN_WORDS, RUN, SAMPLE, SEEN, T, TILE, _low_bytes, _number, _take, are_alike, classes, hashed_rows, mix, tau, word_numbers
from scriptorium.runtime import read_table, write_out

#: Tokens after the span by which suffixes are sorted and prefixes measured.
AHEAD = 4
#: Bits of the table of evaluation starts, and of the pieces in which it is put together.
BITMAP, PIECE = 1 << 24, 1 << 18
#: Pairs of a start from which on they are compared in blocks.
LARGE = 1 << 14


def span_for(t: float) -> int:
    """Least length of the longest common run of alike sets, in tokens, over all numbers of common words."""
    return min(-(-(o + 2) // (int((1 - t) / t * o + 1e-9) + 1)) for o in range(1, 2000))


def suffixes(words: np.ndarray, offsets: np.ndarray, span: int) -> dict[str, np.ndarray]:
    """The suffixes of at least `span` tokens of each set of words: number of the first tokens, bytes of those after, record and position."""
    size = np.diff(offsets)
    own = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((words, own))
    # every sequence gets its two marks, and room to look ahead
    wide = 2 + AHEAD
    tokens = np.zeros(len(words) + wide * len(size), np.uint64)
    begins = offsets[:-1] + wide * np.arange(len(size))
    tokens[np.arange(len(words)) + wide * own + 1] = mix(words[order]) | np.uint64(4)
    tokens[begins], tokens[begins + size + 1] = np.uint64(1), np.uint64(2)
    many = np.maximum(0, size + 3 - span)
    start = _take(begins, many)
    row = np.repeat(np.arange(len(size)), many)
    key = np.zeros(len(start), np.uint64)
    for k in range(span):
        key = mix(key * np.uint64(3) + tokens[start + k])
    ahead = np.zeros(len(start), np.uint32)
    for k in range(AHEAD):
        at = np.minimum(start + span + k, begins[row] + size[row] + 2 + k)
        ahead = (ahead << np.uint32(8)) | (mix(tokens[at]) >> np.uint64(24)).astype(np.uint32) & np.uint32(255)
    return {"key": key, "ahead": ahead, "row": row, "pos": start - begins[row]}


def shared_spans(x: dict[str, np.ndarray], t: float, span: int) -> Iterator[dict[str, np.ndarray]]:
    """Spans that suffixes of a part share across the splits, of records that may be alike: names, position in the evaluation record, length, least coverage.

    side 0 is training, 1 evaluation.
    """
    order = np.lexsort((x["ahead"], x["key"]))  # the suffix array of this part
    x = {k: v[order] for k, v in x.items()}
    # Neighbours with a common prefix of `span` tokens or more belong together; longer prefixes are measured on the tokens ahead.
    heads = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]]))
    group = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(order)]])))
    train, evaluation = np.flatnonzero(x["side"] == 0), np.flatnonzero(x["side"] == 1)
    first = np.searchsorted(group[train], group[evaluation], side="left")
    many = np.searchsorted(group[train], group[evaluation], side="right") - first
    met = many > 0
    evaluation, first, many = evaluation[met], first[met], many[met]
    if not len(evaluation):
        return
    size, sketch = x["size"].astype(np.int64), x["sketch"]
    # No partner of a record differs in more words than one of the largest size that may be alike.
    widest = tau(size[evaluation] + (size[evaluation] / t + 1e-9).astype(np.int64), t) + 1

    def spans(i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        both = size[i] + size[j]
        most = tau(both, t)
        ok = (np.bitwise_count(sketch[i] ^ sketch[j]) <= most) & (np.abs(size[i] - size[j]) <= most)
        i, j, both, most = i[ok], j[ok], both[ok], most[ok]
        differ = x["ahead"][i] ^ x["ahead"][j]
        alike_ahead = np.full(len(i), AHEAD)
        for k in range(AHEAD):
            alike_ahead[(differ >> np.uint32(8 * k)) & np.uint32(255) != 0] = AHEAD - 1 - k
        length = np.minimum(span + alike_ahead, size[i] + 2 - x["pos"][i])
        return {"eval_name": x["name"][i], "train_name": x["name"][j], "pos": x["pos"][i], "length": length, "least": np.maximum(span, (both - most) // 2 + 2 - most * (span - 1))}

    runs, at, asked = np.unique(group[evaluation], return_index=True, return_counts=True)
    large = asked * many[at] >= LARGE
    for k in np.flatnonzero(large):  # all of one side with all of the other, by their sketches
        own, theirs = evaluation[at[k] : at[k] + asked[k]], train[first[at[k]] : first[at[k]] + many[at[k]]]
        limit = widest[at[k] : at[k] + asked[k]].astype(np.uint8 if widest.max() < 256 else np.int64)
        step = max(1, TILE // min(len(theirs), TILE))
        for i in range(0, len(own), step):
            for j in range(0, len(theirs), TILE):
                near = np.bitwise_count(sketch[own[i : i + step], None] ^ sketch[None, theirs[j : j + TILE]]) <= limit[i : i + step, None]
                p, q = np.divmod(np.flatnonzero(near), near.shape[1])
                if len(p):
                    yield spans(own[i + p], theirs[j + q])
    small = np.repeat(~large, asked)
    evaluation, first, many, widest = evaluation[small], first[small], many[small], widest[small]
    sums = np.concatenate([[0], np.cumsum(many)])
    ordered = sketch[train]
    a = 0
    while a < len(evaluation):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + BLOCK, side="right")) - 1)
        i = np.repeat(np.arange(a, b), many[a:b])
        j = _take(first[a:b], many[a:b])
        near = np.flatnonzero(np.bitwise_count(sketch[evaluation[i]] ^ ordered[j]) <= widest[i])
        if len(near):
            yield spans(evaluation[i[near]], train[j[near]])
        a = b


def _table_of_starts(sets: DataFrame, span: int) -> np.ndarray:
    """Bits of the first tokens of all suffixes; put together piece by piece, BITMAP bits reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BITMAP, bool)
        for batch in batches:
            lists = batch.column("words")
            offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))])
            bits[(suffixes(np.asarray(lists.flatten()).view(np.uint64), offsets, span)["key"] % np.uint64(BITMAP)).astype(np.int64)] = True
        for k in range(BITMAP // PIECE):
            own = bits[k * PIECE : (k + 1) * PIECE]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["piece", "bits"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(PIECE // 8, np.uint8)
        for raw in pdf.bits:
            out |= np.frombuffer(raw, np.uint8)
        return pd.DataFrame({"piece": [int(pdf.piece.iloc[0])], "bits": [out.tobytes()]})

    pieces = sets.mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInPandas(join, "piece int, bits binary").collect()
    bits = np.zeros(BITMAP, bool)
    for r in pieces:
        bits[r.piece * PIECE : (r.piece + 1) * PIECE] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return bits


def _shared_starts(train: DataFrame, min_words: int, span: int, run: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts that more than `run` training suffixes are expected to share, in order, into how many blocks each is dealt, and the number of rows."""
    n = train.count()
    share = min(1.0, (SAMPLE + n / 2**20) / max(1, n))
    some = train.filter(F.xxhash64("text") <= F.lit(int(-(2**63) + share * 2**64 * (1 - 1e-9)))).dropDuplicates(["text"])
    lists = [np.array(r.words, np.int64).view(np.uint64) for r in hashed_rows(some, min_words).select(word_numbers(F.col("text")).alias("words")).collect()]
    keys = suffixes(np.concatenate([np.zeros(0, np.uint64), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64), span)["key"]
    keys, seen = np.unique(keys, return_counts=True)
    expected = seen * (n / max(1, len(lists)))
    hot = (seen >= SEEN) & (expected > run)
    return keys[hot], np.ceil(expected[hot] / run).astype(np.int64), n


MESSAGE = ("key", "name", "sketch", "ahead", "rest")


def shared(train_sets: DataFrame, eval_sets: DataFrame, hot: tuple[np.ndarray, np.ndarray], parts: int, t: float = T) -> DataFrame:
    """(eval_name, train_name, covered, size) of the pairs of sets that share spans enough, from (name long, words array<long>, ...); size is that of the evaluation sequence in tokens."""
    span = span_for(t)
    known = train_sets.sparkSession.sparkContext.broadcast((_table_of_starts(eval_sets, span), *hot))

    def send(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, hot_keys, hot_blocks = known.value
            for batch in batches:
                names, lists = np.asarray(batch.column("name")), batch.column("words")
                words = np.asarray(lists.flatten()).view(np.uint64)
                offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))])
                x = suffixes(words, offsets, span)
                if side == 0:
                    met = bits[(x["key"] % np.uint64(BITMAP)).astype(np.int64)]
                    x = {k: v[met] for k, v in x.items()}
                if not len(x["key"]):
                    continue
                sketch = np.bitwise_xor.reduceat(np.uint64(1) << (mix(words) >> np.uint64(40) & np.uint64(63)), offsets[:-1])
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, x["key"]), len(hot_keys) - 1)
                    blocks = np.where(hot_keys[at] == x["key"], hot_blocks[at], 1)
                    if side == 0:
                        block = (mix(names[x["row"]]) % blocks.astype(np.uint64)).astype(np.int64)
                    else:
                        copies = np.repeat(np.arange(len(blocks)), blocks)
                        block = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        x = {k: v[copies] for k, v in x.items()}
                    x["key"] = mix(x["key"] + mix(block))
                size = np.diff(offsets)[x["row"]]
                to = (x["key"] >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
                columns: list[list] = [[] for _ in range(2 + len(MESSAGE))]
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    own = order[a:b]
                    rows = x["row"][own]
                    rest = size[own].astype("<i4").tobytes() + x["pos"][own].astype("<i4").tobytes()
                    message = (_low_bytes(x["key"][own], 0, 5), names[rows].astype("<i8").tobytes(), sketch[rows].astype("<u8").tobytes(), x["ahead"][own].astype("<u4").tobytes(), zstandard.compress(rest, 1))
                    for column, v in zip(columns, (int(to[own[0]]), side, *message)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["part", "side", *MESSAGE])

        return run

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[np.ndarray]] = {k: [] for k in ("key", "name", "sketch", "ahead", "size", "pos", "side")}
        for batch in batches:
            for side, key, name, sketch, ahead, rest in zip(batch.column("side").to_pylist(), *(batch.column(k).to_pylist() for k in MESSAGE)):
                n = len(name) // 8
                rest = zstandard.decompress(rest)
                arrays = (_number(key, 5), np.frombuffer(name, "<i8"), np.frombuffer(sketch, "<u8"), np.frombuffer(ahead, "<u4"), np.frombuffer(rest, "<i4", n), np.frombuffer(rest, "<i4", n, 4 * n), np.full(n, side, np.int8))
                for k, v in zip(got, arrays):
                    got[k].append(v)
        if not got["key"]:
            return
        for found in shared_spans({k: np.concatenate(v) for k, v in got.items()}, t, span):
            yield pa.RecordBatch.from_arrays([pa.array(found[k].astype(np.int64)) for k in ("eval_name", "train_name", "pos", "length", "least")], ["eval_name", "train_name", "pos", "length", "least"])

    kinds = "part int, side int, " + ", ".join(f"{k} binary" for k in MESSAGE)
    sent = train_sets.mapInArrow(send(0), kinds).unionByName(eval_sets.mapInArrow(send(1), kinds))
    spans = sent.repartitionById(parts, "part").mapInArrow(pair, "eval_name long, train_name long, pos long, length long, least long")
    spans = spans.groupBy("eval_name", "train_name").agg(F.array_sort(F.collect_set(F.struct("pos", "length"))).alias("spans"), F.max("least").alias("least"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("covered"))

    def merge(acc: Column, s: Column) -> Column:
        stop = s["pos"] + s["length"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["covered"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], s["pos"]))).alias("covered"))

    return spans.select("eval_name", "train_name", F.aggregate("spans", start, merge, lambda acc: acc["covered"]).alias("covered"), "least").filter("covered >= least").drop("least")


def alike(train: DataFrame, evaluation: DataFrame, t: float = T, min_words: int = MIN_WORDS, run: int = RUN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(eval_name, train_name, coverage) of alike classes, written out, and who is in them: (eval_name, kind, eval_id), (train_name, train_id)."""
    one = lambda df: hashed_rows(df.withColumn("kind", F.lit(0)), min_words)  # noqa: E731 - names don't tell tables apart
    train = train.select("id", "text")
    hashed_train, hashed_eval = one(train), one(evaluation.select(F.struct("kind", "id").alias("id"), "text"))
    # Both readers take the same columns, so one exchange serves them.
    train_sets, eval_sets = (classes(x).select("name", "text", "m") for x in (hashed_train, hashed_eval))
    *hot, n = _shared_starts(train.withColumn("kind", F.lit(0)), min_words, span_for(t), run)
    parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 200_000)
    sent = [s.select("name", word_numbers(F.col("text")).alias("words"), "m") for s in (train_sets, eval_sets)]
    found = shared(*sent, hot, parts, t)
    a = eval_sets.select(F.col("name").alias("eval_name"), F.col("text").alias("text_a"), F.col("m").alias("m_a"))
    b = train_sets.select(F.col("name").alias("train_name"), F.col("text").alias("text_b"), F.col("m").alias("m_b"))
    checked = found.join(b, "train_name").join(a, "eval_name").filter(are_alike("a", "b", t))
    share = F.least(F.lit(1.0), F.col("covered") / (F.col("m_a") + 2)).alias("coverage")
    same = write_out(checked.select("eval_name", "train_name", share))
    of_eval = hashed_eval.select(F.col("name").alias("eval_name"), F.col("id.kind").alias("kind"), F.col("id.id").alias("eval_id"))
    of_train = hashed_train.select(F.col("name").alias("train_name"), F.col("id").alias("train_id"))
    some = same.select("train_name").distinct()
    return same, of_eval, of_train.join(some, "train_name", "left_semi")


def overlaps(train: DataFrame, evaluation: DataFrame, t: float = T, min_words: int = MIN_WORDS, expand: int | None = EXPAND, run: int = RUN) -> DataFrame:
    """(kind, eval_id, train_id) of alike rows; train (id long, text), evaluation (kind int > 0, id string, text). All of them if expand is None."""
    same, of_eval, of_train = alike(train, evaluation, t, min_words, run)
    if expand is None:
        return same.join(of_eval.distinct(), "eval_name").join(of_train.distinct(), "train_name").select("kind", "eval_id", "train_id").distinct()
    few_eval = of_eval.withColumn("k", F.dense_rank().over(Window.partitionBy("eval_name").orderBy("kind", "eval_id"))).filter(F.col("k") <= expand).distinct()
    few_train = of_train.withColumn("k", F.dense_rank().over(Window.partitionBy("train_name").orderBy("train_id"))).filter(F.col("k") <= expand).distinct()
    full = same.join(few_eval.drop("k"), "eval_name").join(few_train.drop("k"), "train_name").select("kind", "eval_id", "train_id")
    # Further ids of large classes: each linked to the first id on the other side.
    last_eval = few_eval.filter(F.col("k") == expand).select("eval_name", F.col("kind").alias("last_kind"), F.col("eval_id").alias("last_id"))
    more_eval = of_eval.join(last_eval, "eval_name").filter("kind > last_kind OR kind = last_kind AND eval_id > last_id").select("eval_name", "kind", "eval_id")
    last_train = few_train.filter(F.col("k") == expand).select("train_name", F.col("train_id").alias("last_id"))
    more_train = of_train.join(last_train, "train_name").filter("train_id > last_id").select("train_name", "train_id")
    first_train, first_eval = few_train.filter("k = 1").drop("k"), few_eval.filter("k = 1").drop("k")
    rest = same.join(more_eval, "eval_name").join(first_train, "train_name").select("kind", "eval_id", "train_id")
    rest = rest.unionByName(same.join(more_train, "train_name").join(first_eval, "eval_name").select("kind", "eval_id", "train_id"))
    return full.unionByName(rest).distinct()


def overlap_counts(train: DataFrame, evaluation: DataFrame, t: float = T, min_words: int = MIN_WORDS) -> DataFrame:
    """(kind, eval_id, n, coverage): how many training ids are alike, for each evaluation id with any, without writing down the pairs, and
    the largest share of its tokens that spans shared with one of them cover.

    Ids with the same sets of words, mostly one set an id, are counted as one class, so an id with several texts counts once.
    """
    same, of_eval, of_train = alike(train, evaluation, t, min_words)
    evals = of_eval.groupBy("kind", "eval_id").agg(F.array_sort(F.collect_set("eval_name")).alias("eval_names"))
    trains = of_train.groupBy("train_id").agg(F.array_sort(F.collect_set("train_name")).alias("train_names")).groupBy("train_names").agg(F.count(F.lit(1)).alias("ids"))
    some = evals.select("eval_names").distinct().select("eval_names", F.explode("eval_names").alias("eval_name"))
    met = same.join(some, "eval_name").join(trains.withColumn("train_name", F.explode("train_names")), "train_name")
    met = met.groupBy("eval_names", "train_names", "ids").agg(F.max("coverage").alias("coverage"))
    return evals.join(met.groupBy("eval_names").agg(F.sum("ids").alias("n"), F.max("coverage").alias("coverage")), "eval_names").select("kind", "eval_id", "n", "coverage")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    train = read_table(spark, sf_dir, "pairs").select(F.col("pair_id").alias("id"), F.col("query").alias("text"))
    val = read_table(spark, sf_dir, "val").select(F.lit(1).alias("kind"), F.col("val_id").cast("string").alias("id"), F.col("query").alias("text"))
    gold = read_table(spark, sf_dir, "gold").select(F.lit(2).alias("kind"), "id", F.col("question").alias("text"))
    return train, val.unionByName(gold)


def _table() -> Column:
    return F.when(F.col("kind") == 1, "val").otherwise("gold").alias("eval_table")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows and the training rows like them, all of them."""
    return overlaps(*_sides(spark, sf_dir), expand=None).select(_table(), "eval_id", F.col("train_id").alias("pair_id"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation table and document: rows, rows that overlap with training, overlaps, and the mean coverage of the rows that overlap."""
    val = read_table(spark, sf_dir, "val").select(F.lit("val").alias("eval_table"), F.col("val_id").cast("string").alias("eval_id"), F.lower(F.regexp_extract("chunk_id", "([A-Za-z]+)", 1)).alias("doc"))
    gold = read_table(spark, sf_dir, "gold").select(F.lit("gold").alias("eval_table"), F.col("id").alias("eval_id"), "doc")
    hits = overlap_counts(*_sides(spark, sf_dir)).select(_table(), "eval_id", "n", "coverage")
    rows = val.unionByName(gold).distinct().join(hits, ["eval_table", "eval_id"], "left")
    return rows.groupBy("eval_table", "doc").agg(
        F.count(F.lit(1)).alias("rows"), F.count("n").alias("overlapping_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("overlaps"), F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 4).alias("coverage"),
    )


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
#: A join on the rarest words of each text, as many as alike texts must share one of.
ORACLE = {
    "p6_found": """
WITH t AS (SELECT 'train' AS side, CAST(pair_id AS VARCHAR) AS id, query AS txt FROM pairs UNION ALL SELECT 'val', CAST(val_id AS VARCHAR), query FROM val UNION ALL SELECT 'gold', id, question FROM gold),
w AS (SELECT row_number() OVER () AS r, * FROM (
  SELECT DISTINCT side, id, list_distinct(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS ws FROM t WHERE len(regexp_extract_all(lower(txt), '[a-z0-9]+')) >= 10)),
u AS (SELECT r, side, len(ws) AS n, unnest(ws) AS word FROM w),
f AS (SELECT word, count(*) AS c FROM u GROUP BY word),
p AS (SELECT r, side, word FROM (SELECT u.*, row_number() OVER (PARTITION BY r ORDER BY c, word) AS k FROM u JOIN f USING (word)) WHERE k <= n - ceil(0.7 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.r AS ra, b.r AS rb FROM p a JOIN p b ON a.side <> 'train' AND b.side = 'train' AND a.word = b.word)
SELECT DISTINCT x.side AS eval_table, x.id AS eval_id, CAST(y.id AS BIGINT) AS pair_id FROM c JOIN w x ON x.r = ra JOIN w y ON y.r = rb
WHERE len(list_intersect(x.ws, y.ws)) >= 0.7 * len(list_distinct(list_concat(x.ws, y.ws))) - 1e-9""",
}
