"""Keyword search of many questions at once: the best passages of each, and the place of its own passage.

A cell holds the postings of a block of passages and is sent the questions in chunks, one after the other. Words that many passages hold are rows of
a table in steps of 1 / SCALE, which are added up per question; what comes near the k-th best sum there, or near the score of the own passage, is scored
again in double precision from the postings of the passage. So every passage is weighed, and results are those of `rank.bm25_ranking`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.rank import saturation
from scriptorium.operators.search import Corpus
from scriptorium.runtime import cut_lineage, widen

#: Passages and questions of a cell; postings and questions that travel in one row; a word held by one in DENSE passages is a row of the table.
PASSAGES, QUESTIONS, CHUNK, ASKED, DENSE = 32_768, 262_144, 1 << 17, 1024, 20
#: Every how many-th score is looked at for a first bound of the k-th best; steps of 1 in the table's numbers; what rounding to single precision may do to a
#: sum too large for the table, as a part of it.
STRIDE, SCALE, ROUNDING = 8, 400, 1e-5
#: Passages of a cell that are looked at first where it is only asked whether enough of them come before one.
AT_FIRST = 2048
TERMS, POSTINGS, QUERIES = range(3)


class Cell:
    """Postings of a block of passages: by word, by passage, and as a table of the common words."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, pos: np.ndarray, term: np.ndarray, sat: np.ndarray) -> None:
        order = np.argsort(terms)
        self.terms, idf = terms[order], idf[order]
        self.places = np.unique(pos)
        n, words = len(self.places), len(self.terms)
        place, word = np.searchsorted(self.places, pos), np.searchsorted(self.terms, term)
        worth = idf[word] * sat
        by = np.argsort(place, kind="stable")
        place, word, worth = place[by].astype(np.int32), word[by].astype(np.int32), worth[by]
        self.words_of, self.worth_of = word, worth
        self.from_ = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=n))])
        by = np.argsort(word, kind="stable")
        self.holders, self.worth = place[by], worth[by].astype(np.float32)
        df = np.bincount(word, minlength=words)
        self.low = np.concatenate([[0], np.cumsum(df)])
        self.most = np.zeros(words)
        held = np.flatnonzero(df)
        if len(held):
            self.most[held] = np.maximum.reduceat(np.abs(self.worth), self.low[held])
        self.steps = np.zeros(0, np.uint16) if len(worth) and worth.min() < 0 else np.rint(np.minimum(self.worth * SCALE, 65535)).astype(np.uint16)
        common = np.flatnonzero(df * DENSE >= max(n, 1)) if len(self.steps) else held[:0]
        self.row = np.full(words, -1, np.int32)
        self.row[common] = np.arange(len(common))
        size = -(-n // 8) * 8  # of masks that are read in eights
        self.table = np.zeros((len(common), size), np.uint16)
        for k, w in enumerate(common):
            self.table[k, self.holders[self.low[w] : self.low[w + 1]]] = self.steps[self.low[w] : self.low[w + 1]]
        self.counts, self.sums, self.sums32 = np.zeros(words), np.zeros(size, np.uint16), np.zeros(size, np.float32)

    def asked(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words of a question, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def summed(self, words: np.ndarray) -> tuple[np.ndarray, float, float]:
        """(sums, steps of 1, by how much a sum may be off, in these steps) of all passages."""
        largest = float(self.most[words].sum())
        if len(self.steps) and largest * SCALE + len(words) < 65_000:
            sums = self.sums
            sums.fill(0)
            for w, r in zip(words.tolist(), self.row[words].tolist()):
                if r >= 0:
                    np.add(sums, self.table[r], out=sums)
                else:
                    a, b = self.low[w], self.low[w + 1]
                    sums[self.holders[a:b]] += self.steps[a:b]
            return sums, SCALE, 0.51 * len(words) + 1
        sums = self.sums32
        sums.fill(0)
        for w in words.tolist():
            a, b = self.low[w], self.low[w + 1]
            sums[self.holders[a:b]] += self.worth[a:b]
        return sums, 1, ROUNDING * largest + 1e-9

    def at_least(self, words: np.ndarray, score: float, k: int) -> bool:
        """Whether k passages are sure to come before one of this score, by the common words of the first passages alone; False if they don't tell."""
        if not len(self.steps) or float(self.most[words].sum()) * SCALE + len(words) >= 65_000:
            return False
        rows = self.row[words]
        sums = self.table[rows[rows >= 0], :AT_FIRST].sum(axis=0, dtype=np.uint16)
        return np.count_nonzero(sums > score * SCALE + 0.51 * len(words) + 1) >= k

    def exact(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of the passages at these places."""
        np.add.at(self.counts, words, 1)
        starts = self.from_[at]
        many = self.from_[at + 1] - starts
        ends = np.cumsum(many)
        flat = np.repeat(starts - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = np.bincount(np.repeat(np.arange(len(at)), many), self.counts[self.words_of[flat]] * self.worth_of[flat], len(at))
        self.counts[words] = 0
        return out

    @staticmethod
    def where(mask: np.ndarray) -> np.ndarray:
        """Places of what is true in a mask of which little is."""
        eights = np.flatnonzero(mask.view(np.uint64))
        i, j = np.nonzero(mask.reshape(-1, 8)[eights])
        return eights[i] * 8 + j

    def search(self, words: np.ndarray, k: int, own: list[tuple[int, float]] = ()) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(places, scores) of the best k with a score above 0, and how many passages come before each of `own`, which are (place, score)."""
        none = np.empty(0, np.int64), np.empty(0)
        if not len(words) or not len(self.places):
            return *none, [0] * len(own)
        sums, step, off = self.summed(words)
        before = []
        for place, score in own:
            over, from_ = sums > score * step + off, sums >= score * step - off
            ahead = int(np.count_nonzero(over))
            if ahead < np.count_nonzero(from_):
                at = self.where(from_ & ~over)
                at = at[at < len(self.places)]
                mine, found = np.round(score, 9), np.round(self.exact(words, at), 9)
                ahead += int(np.count_nonzero((found > mine) | ((found == mine) & (self.places[at] < place))))
            before.append(ahead)
        if not k:
            return *none, before
        some = sums[::STRIDE]
        least = float(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else 0.0
        if least > 2 * off:
            at = self.where(sums >= least - 2 * off)
            if len(at) > k:
                values = sums[at]
                at = at[values >= float(np.partition(values, len(at) - k)[len(at) - k]) - 2 * off]
        else:  # few passages hold a word of the question
            at = np.unique(np.concatenate([self.holders[self.low[w] : self.low[w + 1]] for w in words.tolist()]))
        found = self.exact(words, at)
        best = np.lexsort((at, -np.round(found, 9)))[:k]
        best = best[found[best] > 0]
        return self.places[at[best]], found[best], before


def _packed(rows: DataFrame, size: int, schema: str) -> DataFrame:
    """Rows (block, ...) as rows of lists of up to `size`, all of one block; schema is theirs."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        block = t.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        starts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist()]
        ends = pa.array([*starts, len(order)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, c.combine_chunks()) for c in t.take(pa.array(order)).columns[1:]]
        return pa.RecordBatch.from_arrays([pa.array(block[order][starts], pa.int32()), *lists], names=t.column_names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= size:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(pack, schema)


def _flat(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


class Grid:
    """The postings of a corpus in blocks of passages, ready for cells."""

    def __init__(self, posts: DataFrame, stats: DataFrame, n: int, avgdl: float, passages: int = PASSAGES, questions: int = QUESTIONS) -> None:
        self.questions, self.cores = questions, posts.sparkSession.sparkContext.defaultParallelism
        self.blocks = max(1, -(-n // passages))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(self.blocks)).cast("int").alias("block")
        self.block = block
        held = posts.select(block("pos"), F.col("pos").cast("long").alias("a"), F.xxhash64("tok").alias("b"), saturation(avgdl).alias("d"))
        self.postings = cut_lineage(_packed(held, CHUNK, "block int, a array<long>, b array<long>, d array<double>"))
        self.terms = cut_lineage(_packed(stats.select(F.lit(0).alias("block"), F.xxhash64("tok").alias("a"), F.col("idf").alias("d")), CHUNK, "block int, a array<long>, d array<double>"))

    @classmethod
    def of(cls, corpus: Corpus) -> Grid:
        return cls(corpus.posts, corpus.stats, corpus.n, corpus.avgdl)

    def run(self, asked: DataFrame, parts: int, k: int, few: int | None = None) -> DataFrame:
        """asked is (block, part, qids, toks, own, score), each a list of up to ASKED questions; gives (qid, pos, score, own, before), lists but for qid.

        Without scores of the own passages those of the cell are given; with `few` only where they are above 0 and fewer than `few` of its passages come before.
        """
        kind = dict(asked.dtypes)["qid"].removeprefix("array<").removesuffix(">")
        parted = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        none = lambda name, t: F.lit(None).cast(t).alias(name)
        nested = (none("toks", "array<array<long>>"), none("own", "array<array<long>>"), none("score", "array<array<double>>"))
        terms = self.terms.select(F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"), none("part", "int"), F.lit(TERMS).alias("kind"), "a", none("b", "array<long>"), "d", none("qid", f"array<{kind}>"), *nested)
        posts = self.postings.select("block", none("part", "int"), F.lit(POSTINGS).alias("kind"), "a", "b", "d", none("qid", f"array<{kind}>"), *nested)
        held = terms.unionByName(posts).withColumn("part", parted)
        rows = held.unionByName(asked.select("block", "part", F.lit(QUERIES).alias("kind"), none("a", "array<long>"), none("b", "array<long>"), none("d", "array<double>"), "qid", "toks", "own", "score"))
        out = f"qid {kind}, pos array<long>, found array<double>, own array<long>, before array<long>"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, parts_of, cell = [], [], None
            for b in batches:
                c = {name: b.column(i) for i, name in enumerate(b.schema.names)}
                for i, what in enumerate(c["kind"].to_pylist()):
                    if what == TERMS:
                        words.append((_flat(c["a"], i), _flat(c["d"], i)))
                    elif what == POSTINGS:
                        parts_of.append((_flat(c["a"], i), _flat(c["b"], i), _flat(c["d"], i)))
                    elif parts_of:
                        if cell is None:
                            cell = Cell(*(np.concatenate(x) for x in zip(*words)), *(np.concatenate(x) for x in zip(*parts_of)))
                            words, parts_of = [], parts_of[:1]
                        toks, own, score = (c[x][i].values for x in ("toks", "own", "score"))
                        cuts, flat = toks.offsets.to_numpy(), cell.asked(toks.flatten().to_numpy(zero_copy_only=False))
                        found = []
                        for j, (mine, scores) in enumerate(zip(own.to_pylist(), score.to_pylist())):
                            w = flat[cuts[j] - cuts[0] : cuts[j + 1] - cuts[0]]
                            w = w[w >= 0]
                            if scores is None:  # the scores of the own passages are what is wanted
                                at = np.searchsorted(cell.places, mine)
                                there = at < len(cell.places)
                                there[there] = cell.places[at[there]] == np.asarray(mine)[there]
                                mine, worth = np.asarray(mine)[there], cell.exact(w, at[there])
                                if few is not None:
                                    ok = [x > 0 and not cell.at_least(w, x, few) and cell.search(w, 0, [(m, x)])[2][0] < few for m, x in zip(mine.tolist(), worth.tolist())]
                                    mine, worth = mine[ok], worth[ok]
                                found.append((mine, worth, []))
                            else:
                                found.append(cell.search(w, k, list(zip(mine, scores))))
                        lists = lambda parts, t: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x in parts)]), pa.int32()), pa.array(np.concatenate(parts), t))
                        yield pa.RecordBatch.from_arrays([c["qid"][i].values, lists([x for x, _, _ in found], pa.int64()), lists([x for _, x, _ in found], pa.float64()), own, lists([np.asarray(x, np.int64) for _, _, x in found], pa.int64())], names=["qid", "pos", "found", "own", "before"])

        cells = self.blocks * parts
        placed = rows.select((F.col("block") * parts + F.col("part")).alias("cell"), "kind", "a", "b", "d", "qid", "toks", "own", "score")
        return placed.repartitionById(cells, "cell").sortWithinPartitions("kind").drop("cell").mapInArrow(work, out)

    @staticmethod
    def _tokens(questions: DataFrame) -> DataFrame:
        toks = widen(questions.select("qid", "question")).select("qid", F.transform(tx.search_tokens(F.col("question")), lambda t: F.xxhash64(t)).alias("toks"))
        return cut_lineage(toks.groupBy("qid").agg(F.flatten(F.collect_list("toks")).alias("toks")))

    @staticmethod
    def _asked(df: DataFrame) -> DataFrame:
        return _packed(df, ASKED, f"block int, qid array<{dict(df.dtypes)['qid']}>, toks array<array<long>>, own array<array<long>>, score array<array<double>>")

    def _routed(self, toks: DataFrame, targets: DataFrame) -> DataFrame:
        own = targets.select("qid", F.col("pos").cast("long").alias("pos")).distinct()
        return toks.join(own, "qid").select(self.block("pos"), "qid", "toks", F.array("pos").alias("own"), F.lit(None).cast("array<double>").alias("score"))

    def candidates(self, questions: DataFrame, targets: DataFrame, k: int) -> DataFrame:
        """(qid, pos, score) of the targets (qid, pos) with a score above 0 that fewer than k passages of their block come before: all that can stand in the first k, and few others.

        A question meets the block of its target only.
        """
        toks = self._tokens(questions)
        parts = max(1, -(-self.cores // self.blocks), -(-toks.count() // (self.blocks * self.questions)))
        routed = self._asked(self._routed(toks, targets)).withColumn("part", F.pmod(F.xxhash64(F.col("qid")[0]), F.lit(parts)).cast("int"))
        met = self.run(routed, parts, 0, k)
        return cut_lineage(met.select("qid", F.explode(F.arrays_zip("pos", "found")).alias("x")).select("qid", "x.pos", F.col("x.found").alias("score")))

    def search(self, questions: DataFrame, k: int, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Of questions (qid, question): (qid, pos, score, rank) of the best k; and (qid, pos, rank) of the targets (qid, pos) with a score above 0, however far down.

        With k 0 there is no list. Questions of one id count as one text. Targets may come with their score, as `candidates` gives it.
        """
        toks = self._tokens(questions)
        parts, packed = max(1, -(-toks.count() // self.questions), -(-self.cores // self.blocks)), self._asked
        every = F.lit(0).alias("block"), "qid", "toks"
        asked = toks.select(*every, F.array().cast("array<long>").alias("own"), F.array().cast("array<double>").alias("score"))
        if targets is not None:
            if "score" in targets.columns:
                scored = targets.select("qid", F.struct("pos", F.col("score").alias("found")).alias("x"))
            else:
                scored = self.run(packed(self._routed(toks, targets)).withColumn("part", F.lit(0)), 1, 0).select("qid", F.explode(F.arrays_zip("pos", "found")).alias("x")).filter("x.found > 0")
            scored = scored.groupBy("qid").agg(F.collect_list("x").alias("x")).select("qid", F.col("x.pos").alias("own"), F.col("x.found").alias("score"))
            both = toks.join(scored, "qid", "left" if k else "inner")
            asked = both.select(*every, F.coalesce("own", F.array().cast("array<long>")).alias("own"), F.coalesce("score", F.array().cast("array<double>")).alias("score"))
        chunks = packed(asked).withColumn("part", F.pmod(F.xxhash64(F.col("qid")[0]), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        met = cut_lineage(self.run(chunks, parts, k))
        lists = places = None
        if k:
            each = F.transform(F.arrays_zip("pos", "found"), lambda x: F.struct((-F.round(x["found"], 9)).alias("by"), x["pos"].alias("pos"), x["found"].alias("score")))
            best = met.filter(F.size("pos") > 0).groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k).alias("best"))
            lists = best.select("qid", F.posexplode("best").alias("at", "x")).select("qid", "x.pos", "x.score", (F.col("at") + 1).alias("rank"))
        if targets is not None:
            ahead = met.filter(F.size("own") > 0).select("qid", F.explode(F.arrays_zip("own", "before")).alias("x"))
            places = ahead.groupBy("qid", F.col("x.own").alias("pos")).agg((F.sum("x.before") + 1).alias("rank"))
        return lists, places
