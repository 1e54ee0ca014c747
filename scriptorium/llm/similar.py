"""Problem 1: near-duplicate records with small edits.

Two texts are alike if their sets of words share at least a part `T` of their union. For sets of a and b
words that is a bound on the Hamming distance of the sets, tau = floor((1-T)/(1+T) * (a+b)).

Pigeonring filter. The words are dealt to m > tau segments on a ring. Of the differences per segment of a pair within tau
there is a start on the ring from which every chain of l segments holds at most l*tau/m of them. So a record is
sent out under each of its m segments: the first of the chain must be equal (l = 1), the first two may differ by one word
(l = 2, exact on hashes of the words), and the chains of three to m segments are tested on a sketch that is laid out
along the ring, a few parity bits for each segment: the bits in which two sketches differ never outnumber the words
in which the segments do. What is left is checked exactly on the words.

Plan of the work. A sample of sets (about SAMPLE and one in 2^20 of the rows, by hash of the name, documented here and in the
README) tells which words go together: each word is dealt to the segment in which it parts most pairs of the sample that still
agree there. It also tells the sizes, from which the levels of tau follow (each with its own number of segments), and the
keys that many rows share. All that steers the work only; every set is sent out, and the result is the same whatever the
plan (tests use bad ones).

Scale. Equal word sets are one row before any key is made (combined map-side). A key that more than `run` rows are expected to
share goes out under the chain of two segments at once; where that is shared too, its rows are dealt to blocks and each pair
of blocks is a key of its own, so no task gets more than about 2 * run rows of a run. Keys travel as packed arrays, about 20 bytes a key.

Copies. Rows with equal sets form a class, named by a 64-bit hash (two sets get one name with a chance of n^2/2^65). All ids of
a class stand in all pairs, but of ids with the very same text (same words in the same order) only the first `EXPAND`: any
further one is linked to the first one of its text. `p1_classes` gives class, size of the class and the exact number of links of every id.

Defined results: texts that are null or have fewer than `min_words` words are in no pair; word order, case and
marks play no part; ties don't arise; repeated ids count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.runtime import read_table, write_out

T = 0.7
MIN_WORDS = 10
#: Ids with the same text that stand in all pairs; the others are linked to the first.
EXPAND = 64
#: Sets of the sample that steers the dealing, and rows a key may be shared by before it is split.
SAMPLE, RUN = 4096, 100_000
#: A key counts as shared if so many sets of the sample have it.
SEEN = 8
#: Bits of a sketch.
BITS = 64


def tau(total: np.ndarray, t: float = T) -> np.ndarray:
    """Largest Hamming distance of alike sets with so many words together; it is odd or even as their sum is."""
    most = np.floor((1 - t) / (1 + t) * total + 1e-9).astype(np.int64)
    return most - ((most ^ total) & 1)


def tau_range(size: int, t: float = T) -> tuple[int, int]:
    """Least and largest tau of a set of so many words and a partner that may be alike."""
    sums = np.arange(size + int(np.ceil(t * size - 1e-9)), size + int(size / t + 1e-9) + 1)
    bounds = tau(sums, t)
    return max(0, int(bounds.min())), max(0, int(bounds.max()))


def levels_for(ranges: list[tuple[int, int]], fitted: int = 64) -> list[tuple[int, int]]:
    """Levels of tau that cover 0, 1, 2, ...: up to `fitted` so that few keys are needed for the given ranges, then by doubling.
    A level ends below twice its start plus three, as its last tau is the number of its segments less one."""
    top = min(fitted, max((hi for _, hi in ranges), default=0))
    lows, highs = np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int64)
    best: dict[int, tuple[float, list[tuple[int, int]]]] = {0: (0.0, [])}
    for end in range(top + 1):
        options = []
        for lo in range(end + 1):
            if lo in best and end <= 2 * lo + 2:
                cost, before = best[lo]
                options.append((cost + (end + 1) * float(((lows <= end) & (highs >= lo)).sum()), [*before, (lo, end)]))
        if options:
            best[end + 1] = min(options)
    levels = best[top + 1][1]
    while levels[-1][1] < 10_000_000:
        levels.append((levels[-1][1] + 1, 2 * levels[-1][1] + 2))
    return levels


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit scramble."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _take(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... n[0] of them, then from first[1] on, and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def deal(own: np.ndarray, word: np.ndarray, words: int, rows: int, m: int) -> np.ndarray:
    """A segment for each of the words 0, 1, ..., most frequent first: the one where it parts most pairs of sample rows that agree so far.
    own, word: the rows of the sample and their words, ordered by word."""
    starts = np.searchsorted(word, np.arange(words + 1))
    cell = np.zeros((m, rows), np.int64)
    held = [np.array([rows]) for _ in range(m)]
    out = np.zeros(words, np.int64)
    for w in range(words):
        having = own[starts[w] : starts[w + 1]]
        gains = []
        for j in range(m):
            ids, n = np.unique(cell[j][having], return_counts=True)
            gains.append(int((n * (held[j][ids] - n)).sum()))
        j = int(np.argmax(gains))
        out[w] = j
        ids, at, n = np.unique(cell[j][having], return_inverse=True, return_counts=True)
        cell[j][having] = len(held[j]) + at
        held[j][ids] -= n
        held[j] = np.concatenate([held[j], n])
    return out


class Plan:
    """Levels, the dealing of words and the shared keys, from a sample of sets (kind, words)."""

    def __init__(self, sample: list[tuple[int, np.ndarray]], rows: int, t: float = T, run: int = RUN) -> None:
        self.t = t
        sizes = [len(w) for _, w in sample]
        per = {n: tau_range(n, t) for n in set(sizes)}
        self.levels = levels_for([per[n] for n in sizes])
        words, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in sample)]), return_counts=True)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 1]
        rank = np.argsort(words[order])
        #: Words of the sample in order, and the segment of each by level.
        self.words = words[order][rank]
        self.segment: dict[int, np.ndarray] = {}
        #: Keys that many rows share, in order, and into how many blocks their rows are dealt (0: they go on to the chain of two).
        self.shared, self.blocks = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not sample:
            return
        own = np.repeat(np.arange(len(sizes)), sizes)
        flat = np.concatenate([w for _, w in sample])
        place = np.full(len(words), -1)
        place[order] = np.arange(len(order))
        w = place[np.searchsorted(words, flat)]
        own, w = own[w >= 0], w[w >= 0]
        by = np.argsort(w, kind="stable")
        for level in sorted({k for n in per for k in self.levels_of(n)}):
            if (m := self.levels[level][1] + 1) <= 64:  # hashing balances well enough where segments are many
                self.segment[level] = deal(own[by], w[by], len(order), len(sizes), m)[rank].astype(np.int16)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        first, chain = [], []
        for s in ring(np.array([k for k, _ in sample]), flat, offsets, self):
            first.append(s["key"])
            chain.append(s["chain"])
        expected = rows / len(sample)
        keys, n = np.unique(np.concatenate(first), return_counts=True)
        hot = (n >= SEEN) & (n * expected > run)
        keys2, n2 = np.unique(np.concatenate(chain), return_counts=True)
        hot2 = (n2 >= SEEN) & (n2 * expected > run)
        found = np.concatenate([keys[hot], keys2[hot2]])
        many = np.concatenate([np.zeros(int(hot.sum()), np.int64), np.ceil(n2[hot2] * expected / run).astype(np.int64)])
        by = np.argsort(found)
        self.shared, self.blocks = found[by], many[by]

    def levels_of(self, size: int) -> list[int]:
        lo, hi = tau_range(size, self.t)
        return [k for k, (a, b) in enumerate(self.levels) if a <= hi and b >= lo]

    def segments(self, words: np.ndarray, level: int) -> np.ndarray:
        seg = (mix(words) % np.uint64(self.levels[level][1] + 1)).astype(np.int64)
        if level in self.segment and len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            seg[known] = self.segment[level][at[known]]
        return seg

    def spread(self, keys: np.ndarray) -> np.ndarray:
        """Blocks of each key; 0 for a first segment that many share, 1 for any key that isn't known as shared."""
        out = np.ones(len(keys), np.int64)
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, keys), len(self.shared) - 1)
            known = self.shared[at] == keys
            out[known] = self.blocks[at[known]]
        return out


def bit_of(segment: np.ndarray, scrambled: np.ndarray, m: int) -> np.ndarray:
    """Number of the sketch bit of a word: each segment has bits of its own, in the order of the ring."""
    low = segment * BITS // m
    width = np.maximum(1, (segment + 1) * BITS // m - low)
    return (low + (scrambled >> np.uint64(40)).astype(np.int64) % width).astype(np.uint64)


def ring(kind: np.ndarray, words: np.ndarray, offsets: np.ndarray, plan: Plan) -> Iterator[dict]:
    """For each level: one entry per record and segment, `rows` by m of them. kind: table of each set; words[offsets[k]:offsets[k+1]]: its words."""
    size = np.diff(offsets)
    scrambled = mix(words)
    per = {int(n): plan.levels_of(int(n)) for n in np.unique(size)}
    for level in sorted({k for v in per.values() for k in v}):
        rows = np.flatnonzero(np.isin(size, [n for n, v in per.items() if level in v]))
        m = plan.levels[level][1] + 1
        own = np.repeat(np.arange(len(rows)), size[rows])
        at = _take(offsets[:-1][rows], size[rows])
        seg = plan.segments(words[at], level)
        cell = own * m + seg
        order = np.argsort(cell, kind="stable")
        held = np.bincount(cell, minlength=len(rows) * m)
        first = np.cumsum(held) - held
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled[at][order])])
        total = sums[first + held] - sums[first]
        sketch = np.zeros(len(rows), np.uint64)
        filled = np.flatnonzero(size[rows])
        if len(filled):
            starts = (np.cumsum(size[rows]) - size[rows])[filled]
            sketch[filled] = np.bitwise_xor.reduceat(np.uint64(1) << bit_of(seg, scrambled[at], m), starts)
        place = np.arange(len(rows) * m)
        row, segment = place // m, place % m
        key = mix(total + mix(((kind[rows[row]].astype(np.int64) * 64 + level) << 20) + segment))
        after = row * m + (segment + 1) % m
        yield {"level": level, "row": rows[row], "segment": segment, "key": key, "chain": mix(key + mix(total[after])), "sketch": sketch[row], "size": size[rows[row]], "n": held[after], "at": first[after], "scrambled": scrambled[at][order], "total": total[after]}


def emit(kind: np.ndarray, name: np.ndarray, words: np.ndarray, offsets: np.ndarray, plan: Plan) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(level, keys) of a batch. `follow` holds a byte for each word of the next segment, `count` of them; a count of -1 or -2 tells
    that the key is that of a chain of two already, whole or lacking a word of the second."""
    for s in ring(kind, words, offsets, plan):

        def pick(at: np.ndarray, key: np.ndarray, count: np.ndarray, follow: np.ndarray) -> dict[str, np.ndarray]:
            return {"key": key, "name": name[s["row"][at]], "sketch": s["sketch"][at], "size": s["size"][at], "segment": s["segment"][at], "count": count, "follow": follow}

        known = plan.spread(s["key"])
        rich = np.flatnonzero(known > 0)
        follow = s["scrambled"][_take(s["at"][rich], s["n"][rich])]
        yield s["level"], pick(rich, s["key"][rich], s["n"][rich], (follow >> np.uint64(8)).astype(np.uint8))
        poor = np.flatnonzero(known == 0)
        if not len(poor):
            continue
        src = np.repeat(poor, s["n"][poor])
        lacking = mix(s["key"][src] + mix(s["total"][src] - s["scrambled"][_take(s["at"][poor], s["n"][poor])]))
        at, chain = np.concatenate([poor, src]), np.concatenate([s["chain"][poor], lacking])
        count = np.concatenate([np.full(len(poor), -1), np.full(len(src), -2)])
        blocks = np.maximum(1, plan.spread(chain))
        copies = np.repeat(np.arange(len(at)), blocks)
        b = blocks[copies]
        mine = (mix(name[s["row"][at[copies]]]) % b.astype(np.uint64)).astype(np.int64)
        other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        block_pair = np.minimum(mine, other) * b + np.maximum(mine, other)
        yield s["level"], pick(at[copies], mix(chain[copies] + mix(block_pair)), count[copies], np.zeros(0, np.uint8))


#: Pairs looked at in one go, rows of a run from which on it is compared in blocks, pairs of a block (its arrays stay in a core's cache).
BLOCK, LARGE_RUN, TILE = 1 << 20, 1 << 7, 1 << 15


def meet(x: dict[str, np.ndarray], level: int, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the pairs of one level whose chains stay within their budgets."""
    low, high = plan.levels[level]
    m = high + 1
    plain = np.flatnonzero(x["count"] >= 0)
    n = x["count"][plain].astype(np.int64)
    scrambled = mix(x["follow"] + np.uint64(1))
    source = np.repeat(np.arange(len(plain)), n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled)])
    ends = np.cumsum(n)
    total = sums[ends] - sums[ends - n]
    chained, lacking = np.flatnonzero(x["count"] == -1), np.flatnonzero(x["count"] == -2)
    apart = np.uint64(1 << 40)  # keys of chains of two and keys of segments are different things
    whole_key = np.concatenate([mix(x["key"][plain] + mix(total)), mix(x["key"][chained] + apart)])
    whole = np.concatenate([plain, chained])
    part_key = np.concatenate([mix(x["key"][plain][source] + mix(total[source] - scrambled)), mix(x["key"][lacking] + apart)])
    part = np.concatenate([plain[source], lacking])
    if not len(whole):
        return
    order = np.argsort(whole_key)
    whole_key, whole = whole_key[order], whole[order]
    heads = np.flatnonzero(np.concatenate([[True], whole_key[1:] != whole_key[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(whole)]]))
    keys = whole_key[heads]
    # Most keys that lack a word meet nothing: a table of bits tells them from the others.
    slot = np.uint64(64 - max(16, int(len(keys)).bit_length() + 3))
    there = np.zeros(1 << (64 - int(slot)), bool)
    there[(keys >> slot).astype(np.int64)] = True
    maybe = there[(part_key >> slot).astype(np.int64)]
    part_key, part = part_key[maybe], part[maybe]
    at = np.minimum(np.searchsorted(keys, part_key), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == part_key)
    part, at = part[hit], at[hit]
    order = np.argsort(at, kind="stable")
    part, at = part[order], at[order]
    l_runs, l_first, l_many = np.unique(at, return_index=True, return_counts=True)

    size, sketch, segment, name = x["size"].astype(np.int64), x["sketch"], x["segment"].astype(np.int64), x["name"]
    steps = np.arange(m + 1)
    edge = steps * BITS // m if m <= BITS else None

    def passed(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = tau(size[i] + size[j], plan.t)
        differ = sketch[i] ^ sketch[j]
        ok = (np.bitwise_count(differ) <= most) & (most >= low) & (most <= high) & (np.abs(size[i] - size[j]) <= most) & (name[i] != name[j])
        i, j, most, differ = i[ok], j[ok], most[ok], differ[ok]
        if edge is not None and len(i):  # every chain from this start on, by the bits of its segments
            shift = edge[segment[i]].astype(np.uint64)
            turned = (differ >> shift) | (differ << (np.uint64(BITS) - shift & np.uint64(BITS - 1)))
            fine = np.ones(len(i), bool)
            for chain in range(3, m):
                width = edge[np.minimum(segment[i] + chain, m)] - edge[segment[i]] + edge[np.maximum(segment[i] + chain - m, 0)]
                mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
                fine &= np.bitwise_count(turned & mask) <= chain * most // m
            i, j = i[fine], j[fine]
        i, j = name[i], name[j]
        return np.minimum(i, j), np.maximum(i, j)

    def blocks(i: np.ndarray, j: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of i with all of j, by their sketches; each pair once if the two are the same."""
        ours, theirs = sketch[i], sketch[j]
        wide = min(len(j), TILE)
        step = max(1, TILE // wide)
        xor, bits = np.empty((step, wide), np.uint64), np.empty((step, wide), np.uint8)
        near_i, near_j, held = [], [], 0
        for a in range(0, len(i), step):
            for b in range(a - a % wide if same else 0, len(j), wide):
                x_, y_ = ours[a : a + step, None], theirs[None, b : b + wide]
                differ = bits[: len(x_), : y_.shape[1]]
                np.bitwise_count(np.bitwise_xor(x_, y_, out=xor[: len(x_), : y_.shape[1]]), out=differ)
                near = np.flatnonzero(differ <= high)
                if not len(near):
                    continue
                p, q = np.divmod(near, y_.shape[1])
                if same:
                    later = b + q > a + p
                    p, q = p[later], q[later]
                near_i.append(i[a + p])
                near_j.append(j[b + q])
                held += len(p)
                if held >= BLOCK:
                    yield passed(np.concatenate(near_i), np.concatenate(near_j))
                    near_i, near_j, held = [], [], 0
        if held:
            yield passed(np.concatenate(near_i), np.concatenate(near_j))

    # whole with whole: every later one of the run; lacking with whole: the whole run
    large = sizes >= LARGE_RUN
    for k in np.flatnonzero(large):
        own = whole[heads[k] : heads[k] + sizes[k]]
        yield from blocks(own, own, True)
    l_large = sizes[l_runs] * l_many >= LARGE_RUN * LARGE_RUN
    for k in np.flatnonzero(l_large):
        r = l_runs[k]
        yield from blocks(part[l_first[k] : l_first[k] + l_many[k]], whole[heads[r] : heads[r] + sizes[r]], False)
    run = np.repeat(np.arange(len(heads)), sizes)
    few = np.flatnonzero(~large[run])
    rest = np.repeat(~l_large, l_many)
    left = np.concatenate([whole[few], part[rest]])
    begin = np.concatenate([few + 1, heads[at[rest]]])
    many = np.concatenate([heads[run[few]] + sizes[run[few]] - few - 1, sizes[at[rest]]])
    sums = np.concatenate([[0], np.cumsum(many)])
    ordered = sketch[whole]
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + BLOCK, side="right")) - 1)
        to = _take(begin[a:b], many[a:b])
        i = np.repeat(np.arange(a, b), many[a:b])
        near = np.flatnonzero(np.bitwise_count(sketch[left[a:b]][i - a] ^ ordered[to]) <= high)
        if len(near):
            yield passed(left[i[near]], whole[to[near]])
        a = b


def _low_bytes(x: np.ndarray, a: int, b: int) -> bytes:
    """Bytes a to b of each number, least first."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, a:b]).tobytes()


def _number(raw: bytes, width: int, high: bytes = b"") -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    if high:
        out[:, width:] = np.frombuffer(high, np.uint8).reshape(n, 8 - width)
    return out.view("<u8").reshape(-1)


#: Columns of a message: three bytes of the key, six of the name, the sketch; what repeats (high bytes of the names, sizes, segments, counts) is compressed.
MESSAGE = ("key", "name", "sketch", "rest", "follow")


def _pack(level: int, found: dict[str, np.ndarray], parts: int) -> pa.RecordBatch | None:
    """One row of arrays for each task that is to get some of the keys."""
    if not len(found["key"]):
        return None
    to = (found["key"] >> np.uint64(24)) % np.uint64(parts)
    order = np.argsort(to, kind="stable")
    n = np.maximum(found["count"], 0).astype(np.int64)
    starts = np.cumsum(n) - n
    cuts = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
    columns: dict[str, list] = {k: [] for k in ("part", "level", *MESSAGE)}
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = order[a:b]
        name = found["name"][own].view(np.uint64)
        rest = _low_bytes(name, 6, 8) + found["size"][own].astype("<i4").tobytes() + found["segment"][own].astype("<i4").tobytes() + found["count"][own].astype("<i4").tobytes()
        row = (int(to[own[0]]), level, _low_bytes(found["key"][own], 0, 3), _low_bytes(name, 0, 6), _low_bytes(found["sketch"][own], 0, BITS // 8), zstandard.compress(rest, 1), found["follow"][_take(starts[own], n[own])].tobytes())
        for k, v in zip(columns, row):
            columns[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array(columns["part"], pa.int32()), pa.array(columns["level"], pa.int32()), *(pa.array(columns[k], pa.binary()) for k in MESSAGE)], list(columns))


def _unpack(messages: list[tuple[bytes, ...]]) -> dict[str, np.ndarray]:
    got: dict[str, list[np.ndarray]] = {k: [] for k in ("key", "name", "sketch", "size", "segment", "count", "follow")}
    for key, name, sketch, rest, follow in messages:
        n = len(key) // 3
        rest = zstandard.decompress(rest)
        got["key"].append(_number(key, 3))
        got["name"].append(_number(name, 6, rest[: 2 * n]).view(np.int64))
        got["sketch"].append(_number(sketch, BITS // 8))
        for i, k in enumerate(("size", "segment", "count")):
            got[k].append(np.frombuffer(rest, "<i4", n, 2 * n + 4 * n * i))
        got["follow"].append(np.frombuffer(follow, np.uint8))
    return {k: np.concatenate(v) for k, v in got.items()}


def candidates(sets: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """(name_a, name_b) from (name long, words array<long>, ...); the kind of a set stands in the low bits of its name. Rows may repeat."""
    shared = sets.sparkSession.sparkContext.broadcast(plan)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = np.asarray(batch.column("name")), batch.column("words")
            words = np.asarray(lists.flatten()).view(np.uint64)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))])
            for level, found in emit(names & KINDS, names, words, offsets, shared.value):
                if (packed := _pack(level, found, parts)) is not None:
                    yield packed

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in MESSAGE]
            for level, *message in zip(batch.column("level").to_pylist(), *columns):
                got.setdefault(level, []).append(tuple(message))
        for level in sorted(got):
            for a, b in meet(_unpack(got.pop(level)), level, shared.value):
                if len(a):
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["name_a", "name_b"])

    keys = sets.mapInArrow(send, "part int, level int, " + ", ".join(f"{k} binary" for k in MESSAGE))
    return keys.repartitionById(parts, "part").mapInArrow(pair, "name_a long, name_b long")


#: Low bits of a name that hold the kind of its rows.
KINDS = 7


def word_list(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def hashed_rows(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(kind, id, text, name, same, m) of the rows (kind int below 8, id, text) with enough words; `same` is a hash of the words in their order, m the number of distinct ones."""
    # Exploded, the list is made once; a filter on a plain column would be pushed below and make it a second time.
    listed = rows.select("kind", "id", "text", F.explode(F.array(F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)))).alias("listed")).filter(F.size("listed") >= min_words)
    words = listed.withColumn("words", F.sort_array(F.array_distinct("listed")))
    return words.select("kind", "id", "text", F.expr(f"(xxhash64(words, kind) & {~KINDS}L) | kind").alias("name"), F.hash("listed").alias("same"), F.size("words").alias("m"))


def word_numbers(text: Column) -> Column:
    """64-bit hashes of the distinct words."""
    return F.array_distinct(F.transform(word_list(text), lambda w: F.xxhash64(w)))


def classes(hashed: DataFrame) -> DataFrame:
    """One row per distinct word set and table: (name, text, rep, n, m). All who read it take all columns, so that one exchange serves them."""
    return hashed.groupBy("name").agg(F.first("text").alias("text"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))


def make_plan(rows: DataFrame, t: float = T, min_words: int = MIN_WORDS, run: int = RUN) -> tuple[Plan, int]:
    """Plan from the sets of about SAMPLE rows, and one in 2^20 of all: those with the smallest hashes of their texts. Also the number of rows."""
    n = rows.count()
    share = min(1.0, (SAMPLE + n / 2**20) / max(1, n))
    some = rows.filter((F.xxhash64("text") >= F.lit(-(2**63))) & (F.xxhash64("text") <= F.lit(int(-(2**63) + share * 2**64 * (1 - 1e-9)))))
    found = hashed_rows(some.dropDuplicates(["kind", "text"]), min_words).select("kind", word_numbers(F.col("text")).alias("words")).collect()
    return Plan([(r.kind, np.array(r.words, np.int64).view(np.uint64)) for r in found], n, t, run), n


def are_alike(x: str, y: str, t: float) -> Column:
    """Whether the words of text_x, m_x of them, and those of text_y share a part t of their union: o >= t * (m_x + m_y - o). Each text is read once."""
    shared = F.size(F.array_intersect(word_list(F.col(f"text_{x}")), word_list(F.col(f"text_{y}"))))
    return shared >= t / (1 + t) * (F.col(f"m_{x}") + F.col(f"m_{y}")) - 1e-9


def alike_classes(hashed: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """(name_a, rep_a, n_a, name_b, rep_b, n_b) of alike classes with name_a < name_b, and of each class of several rows with itself."""
    sets = classes(hashed)
    a, b = (sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("name", "text", "rep", "n", "m"))) for x in "ab")
    sent = sets.select("name", word_numbers(F.col("text")).alias("words"), "rep", "n", "m")
    near = candidates(sent, plan, parts).distinct().join(a, "name_a").join(b, "name_b")
    found = near.filter(are_alike("a", "b", plan.t)).select("name_a", "rep_a", "n_a", "name_b", "rep_b", "n_b")
    own = sets.filter((F.col("n") > 1) & (F.col("m") > 0) & (F.length("text") > 0)).select(*(F.col(c).alias(f"{c}_{x}") for x in "ab" for c in ("name", "rep", "n")))
    return found.unionByName(own)


def _found(rows: DataFrame, t: float, min_words: int, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Alike classes, written out, and the rows of classes with several: (name, same, id)."""
    plan, n = make_plan(rows, t, min_words, run)
    hashed = hashed_rows(rows, min_words)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 200_000)
    found = write_out(alike_classes(hashed, plan, parts))
    several = found.filter("name_a = name_b").select(F.col("name_a").alias("name"))
    return found, hashed.select("name", "same", "id").join(several, "name")


def similar_pairs(rows: DataFrame, t: float = T, min_words: int = MIN_WORDS, expand: int = EXPAND, run: int = RUN) -> DataFrame:
    """(kind, id_a, id_b) with id_a < id_b, from rows (kind int below 8, id long, text string)."""
    found, members = _found(rows, t, min_words, run)
    by = Window.partitionBy("name", "same").orderBy("id")
    few = write_out(members.withColumn("k", F.dense_rank().over(by)).filter(F.col("k") <= expand).distinct())
    kind = F.col("name_a").bitwiseAND(F.lit(KINDS)).cast("int").alias("kind")
    ordered = [kind, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")]
    a, b = (few.select(F.col("name").alias(f"name_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    single = found.filter("n_a = 1 AND n_b = 1").select("name_a", F.col("rep_a").alias("x"), F.col("rep_b").alias("y"))
    many = found.filter("n_a > 1 OR n_b > 1").join(a, "name_a", "left").join(b, "name_b", "left")
    many = many.select("name_a", F.coalesce("id_a", "rep_a").alias("x"), F.coalesce("id_b", "rep_b").alias("y"))
    # Texts with more ids than are expanded: each further id with the first one.
    large = few.groupBy("name", "same").agg(F.min("id").alias("y"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= expand).drop("n")
    rest = members.join(large, ["name", "same"]).filter("id > last").select(F.col("name").alias("name_a"), F.col("id").alias("x"), "y")
    return single.unionByName(many).unionByName(rest).filter("x <> y").select(*ordered).distinct()


def similar_classes(rows: DataFrame, t: float = T, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """(kind, id, class_id, class_size, links) of every id that is like another: the smallest id and the number of ids with the same words, and how
    many ids are like it, copies included. Counted by classes, never by pairs; an id with several texts has a row for each class."""
    found, members = _found(rows, t, min_words, run)
    sizes = members.groupBy("name").agg(F.count_distinct("id").alias("size"))
    both = found.filter("name_a <> name_b")
    sides = both.select(F.col("name_a").alias("name"), F.col("name_b").alias("other"), F.col("rep_a").alias("rep"), "n_b")
    sides = sides.unionByName(both.select(F.col("name_b").alias("name"), F.col("name_a").alias("other"), F.col("rep_b").alias("rep"), F.col("n_a").alias("n_b")))
    counted = sides.join(sizes.withColumnRenamed("name", "other"), "other", "left").groupBy("name").agg(F.min("rep").alias("rep"), F.sum(F.coalesce("size", F.lit(1))).alias("to_others"))
    per = counted.join(sizes, "name", "full").select("name", "rep", F.coalesce("size", F.lit(1)).alias("class_size"), (F.coalesce("to_others", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("links")).filter("links > 0")
    firsts = members.groupBy("name").agg(F.min("id").alias("first"))
    rows_of = members.select("name", "id").distinct()
    ids = per.join(firsts, "name", "left").join(rows_of, "name", "left")
    kind = F.col("name").bitwiseAND(F.lit(KINDS)).cast("int").alias("kind")
    return ids.select(kind, F.coalesce("id", "rep").alias("id"), F.coalesce("first", "rep").alias("class_id"), "class_size", "links").distinct()


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "pairs").select(F.lit(0).alias("kind"), F.col("pair_id").alias("id"), F.col("query").alias("text"))
    return pairs.unionByName(read_table(spark, sf_dir, "dropped").select(F.lit(1).alias("kind"), F.col("dropped_id").alias("id"), F.col("reason").alias("text")))


def _src() -> Column:
    return F.when(F.col("kind") == 0, "pairs").otherwise("dropped").alias("src")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nearly equal queries, and of nearly equal explanations."""
    return similar_pairs(_rows(spark, sf_dir)).select(_src(), "id_a", "id_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that is like another, with its class of equal word sets and its number of links."""
    return similar_classes(_rows(spark, sf_dir)).select(_src(), "id", "class_id", "class_size", "links")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
#: A join on the rarest words of each text, as many as alike texts must share one of.
ORACLE = {
    "p1_found": """
WITH t AS (SELECT 'pairs' AS src, pair_id AS id, query AS txt FROM pairs UNION ALL SELECT 'dropped', dropped_id, reason FROM dropped),
w AS (SELECT row_number() OVER () AS r, * FROM (
  SELECT DISTINCT src, id, list_distinct(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS ws FROM t WHERE len(regexp_extract_all(lower(txt), '[a-z0-9]+')) >= 10)),
u AS (SELECT r, src, id, len(ws) AS n, unnest(ws) AS word FROM w),
f AS (SELECT word, count(*) AS c FROM u GROUP BY word),
p AS (SELECT r, src, id, word FROM (SELECT u.*, row_number() OVER (PARTITION BY r ORDER BY c, word) AS k FROM u JOIN f USING (word)) WHERE k <= n - ceil(0.7 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.r AS ra, b.r AS rb FROM p a JOIN p b ON a.src = b.src AND a.word = b.word AND a.id < b.id)
SELECT DISTINCT x.src, x.id AS id_a, y.id AS id_b FROM c JOIN w x ON x.r = ra JOIN w y ON y.r = rb
WHERE len(list_intersect(x.ws, y.ws)) >= 0.7 * len(list_distinct(list_concat(x.ws, y.ws))) - 1e-9""",
}
