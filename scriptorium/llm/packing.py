"""Problem 8: filling fixed-capacity containers.

Sizes are tokens of the public byte-level vocabulary without merges: one token per UTF-8 byte,
no special tokens, so the size of a text is its octet length.

Plan. (1) The histogram of sizes is one aggregation whose result has at most `capacity` rows,
whatever the number of documents. (2) On that histogram the driver enumerates shallow combinations
of lengths that fill a window below the capacity, solves for their repeat counts by non-negative
least squares, rounds down, and packs what is left greedily, still on counts only. (3) Documents
learn their rank within their length from counts per (length, salt), and rank plus length gives the
container; only ids and sizes are shuffled, over salts, so a common length does not gather in one task.

Defined results: null or empty texts hold no tokens and get container_id NULL; a text longer than
the capacity is cut at character boundaries into pieces of at most `capacity` bytes, each of which
is packed like any other item; repeated rows are items of their own unless dropped before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.runtime import read_table, write_out

CAPACITY = 8192
#: Combinations of at most this many items are enumerated for the least-squares step.
DEPTH = 4
#: A combination counts as full if it leaves at most this share of the capacity unused.
WINDOW = 1 / 512
#: Representative lengths (quantiles of the histogram) that combinations are made of.
BASES = 48
#: Shares of the solved counts that are tried.
ROUNDINGS = (1.0, 0.75, 0.5, 0.25, 0.1)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if n == 0 or passive.all() or w[j] <= 1e-9 * (1 + np.abs(b).max()):
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (z <= 1e-12)
            if not bad.any():
                x = z
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-30))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def combinations_in_window(lengths: np.ndarray, capacity: int, window: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most `depth` lengths whose sum lies in [capacity - window, capacity]; the last
    member is looked up, so the cost is that of depth - 1 nested choices among the bases."""
    ordered = sorted({int(x) for x in lengths if x > 0}, reverse=True)
    rising = ordered[::-1]
    bases = ordered if len(ordered) <= BASES else [ordered[i] for i in np.unique(np.linspace(0, len(ordered) - 1, BASES).astype(int))]
    found: set[tuple[int, ...]] = set()

    def grow(chosen: list[int], room: int, start: int) -> None:
        k = bisect_right(rising, room)
        if k and rising[k - 1] >= room - window:
            found.add(tuple(sorted([*chosen, rising[k - 1]], reverse=True)))
        if len(chosen) + 1 < depth:
            for i in range(start, len(bases)):
                if bases[i] <= room:
                    grow([*chosen, bases[i]], room - bases[i], i)

    grow([], capacity, 0)
    return sorted(found)


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats) with pattern = {length: items of it per container}; uses every item exactly once.

    The solved counts are rounded at several scales (all of a count, three quarters, ...), the rest is packed greedily, and the
    plan with the fewest containers is kept: where items over half the capacity abound, full combinations may take the small items those need.
    """
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0 and k > 0}
    if any(k > capacity for k in counts):
        raise ValueError("lengths over the capacity must be cut first")
    combos = combinations_in_window(np.array(list(counts)), capacity, max(1, int(capacity * WINDOW)), DEPTH)
    if not combos:
        return _greedy(dict(counts), capacity)
    # Lengths are lumped into bins for the least-squares step only; rounding is checked on exact counts.
    edges = np.unique(np.linspace(0, capacity, 129).astype(int))
    lump = lambda x: int(np.searchsorted(edges, x, side="left"))
    a = np.zeros((len(edges), len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[lump(x), j] += 1
    b = np.zeros(len(edges))
    for x, k in counts.items():
        b[lump(x)] += k
    solved = nnls(a, b)
    plans = [_rounded(dict(counts), capacity, combos, solved * scale) for scale in ROUNDINGS]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _rounded(left: dict[int, int], capacity: int, combos: list[tuple[int, ...]], solved: np.ndarray) -> list[tuple[dict[int, int], int]]:
    plan = []
    for j in np.argsort(-solved, kind="stable"):
        if solved[j] < 1:
            break
        pattern: dict[int, int] = {}
        for x in combos[j]:
            pattern[x] = pattern.get(x, 0) + 1
        repeats = min(int(solved[j]), *(left.get(x, 0) // k for x, k in pattern.items()))
        if repeats > 0:
            plan.append((pattern, repeats))
            for x, k in pattern.items():
                left[x] -= k * repeats
    return plan + _greedy(left, capacity)


def _greedy(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Starts with the largest length left, then always takes the largest that still fits. A pattern is repeated as long as its
    counts last, so each step uses up a length: at most `capacity` steps, however many items there are."""
    plan: list[tuple[dict[int, int], int]] = []
    rising = sorted(x for x, k in left.items() if k > 0)
    while rising:
        room, pattern, pos = capacity, {}, len(rising)
        while pos:
            x = rising[pos - 1]
            take = min(left[x], room // x)
            if take:
                pattern[x] = take
                room -= take * x
            pos = min(pos - 1, bisect_right(rising, room))
        repeats = min(left[x] // k for x, k in pattern.items())
        plan.append((pattern, repeats))
        for x, k in pattern.items():
            left[x] -= k * repeats
        rising = [x for x in rising if left[x] > 0]
    return plan


def slot_table(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of containers, first container, items per container."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, repeats in plan:
        for x, k in pattern.items():
            runs.setdefault(x, []).append((used.get(x, 0), first, k))
            used[x] = used.get(x, 0) + k * repeats
        first += repeats
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


def cut_points(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, bytes) in characters of pieces of at most `capacity` bytes, cut between characters."""
    out, start, size = [], 0, 0
    widths = np.where((c := np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)) < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
    ends = np.concatenate([[0], np.cumsum(widths)])
    while start < len(text):
        stop = int(np.searchsorted(ends, ends[start] + capacity, side="right")) - 1
        out.append((start, stop, int(ends[stop] - ends[start])))
        start = stop
    return out


def items(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, start_char, end_char, n_tokens): one row per document, several for longer texts."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    whole = sized.filter(F.col("n_tokens") <= capacity).select(
        "doc_id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("start_char"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("end_char"), "n_tokens",
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i + 1, *p) for d, t in zip(pdf.doc_id, pdf.text) for i, p in enumerate(cut_points(t, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_char", "end_char", "n_tokens"])

    long = sized.filter(F.col("n_tokens") > capacity).select("doc_id", "text")
    return whole.unionByName(long.mapInPandas(cut, "doc_id long, piece_no int, start_char long, end_char long, n_tokens long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, rows_per_task: int = 500_000) -> DataFrame:
    """Contents of every container: (container_id, doc_id, piece_no, start_char, end_char, n_tokens)."""
    spark = docs.sparkSession
    # Written once: the histogram, the offsets and the placing read ids and sizes, not the texts again.
    pieces = write_out(items(docs, capacity).dropDuplicates(["doc_id", "piece_no"]))
    # At most `capacity` rows, however many documents there are.
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}
    slots = spark.sparkContext.broadcast(slot_table(plan_patterns(histogram, capacity)))
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(histogram.values()) // rows_per_task))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    # Ranks run through the salts one after the other: a length held by a third of all rows is spread over all tasks.
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n_tokens", "salt").count().select(F.col("salt").alias("of_salt"), F.col("n_tokens").alias("size"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    def place(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece_no"], ignore_index=True)
        rank = rows.groupby("n_tokens").cumcount().to_numpy() + rows.n_tokens.map(dict(zip(starts["size"], starts["before"]))).to_numpy()
        container = np.full(len(rows), -1, np.int64)
        for size, at in rows.groupby("n_tokens").indices.items():
            if size > 0:
                first_rank, first_container, per = slots.value[int(size)]
                run = np.searchsorted(first_rank, rank[at], side="right") - 1
                container[at] = first_container[run] + (rank[at] - first_rank[run]) // per[run]
        rows["container_id"] = pd.array(container, "Int64")
        rows.loc[container < 0, "container_id"] = pd.NA
        return rows[["container_id", "doc_id", "piece_no", "start_char", "end_char", "n_tokens"]]

    return salted.groupBy("salt").cogroup(offsets.groupBy("of_salt")).applyInPandas(place, "container_id long, doc_id long, piece_no int, start_char long, end_char long, n_tokens long")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with its contents."""
    return pack(read_table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least possible number, and the share of space left empty."""
    total = F.sum("n_tokens")
    return p8_containers(spark, sf_dir).agg(
        F.count_distinct("container_id").alias("containers"), F.ceil(total / CAPACITY).alias("lower_bound"),
        F.round(1 - total / (F.count_distinct("container_id") * CAPACITY), 4).alias("unused_share"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that took more than one piece."""
    return p8_containers(spark, sf_dir).filter("piece_no > 1").select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill}
ORACLE = {"p8_found": f"SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > {CAPACITY}"}
