"""Problem 10: the language of every document and every line.

Prediction by partial matching: for each language, byte contexts of up to ORDER bytes with frozen counts
and escape probabilities (method C); the exact code length of a line under each language decides, the
shortest wins. Because the statistics are frozen, the code length of a byte depends on its ORDER
predecessors only, so the lengths for all languages are tabulated per byte n-gram once, on the driver, and a
batch of documents is scored with array look-ups: one pass over the corpus, no shuffle.

The classifier is fitted on at most `sample_docs` labelled documents per label (those with the smallest
hash of their id, SAMPLE_CHARS characters of each). Labels are wrong now and then and documents mix languages, so the lines are fitted
twice: lines that a first model gives to another language are left out of the second, and lines in Latin
letters from documents labelled as Hindi that no Latin model explains become a romanised model of Hindi.

Defined results: a null text has no lines; an empty line has language NULL and confidence 0; a document's
language is the one that holds most of its letters, NULL if there are none; labels that name no known
language (null, blank, 'unknown', '??', ...) count as missing; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.runtime import read_table

ORDER = 3
#: Documents per label that the classifier is fitted on, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
MIN_LETTERS = 20
#: Code-length differences are divided by this before they become a confidence; bytes of a line aren't independent.
TEMPER = 8.0
#: A Latin line costing more than this many times a language's own median is foreign to it.
FOREIGN = 1.6
NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french"), "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"), "hi": ("hi", "hin", "hindi"), "zh": ("zh", "zho", "chi", "chinese"), "th": ("th", "tha", "thai"),
}
CODES = {name: code for code, names in NAMES.items() for name in names}
ROMANISED = "hi-Latn"
PAD = b"\n" * ORDER
#: Case and the value of digits say nothing about the language.
FOLD = bytes(ord("0") if 48 <= i <= 57 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Typographic marks, no-break blanks and soft hyphens, with the blanks around them, read as one blank.
LAYOUT = re.compile(rb"\xe2\x80|\xc2[\xa0\xad]")
BLANKS = re.compile(rb"(?: *(?:\xe2\x80[\x80-\xbf]|\xc2[\xa0\xad]))+ *")
ALPHA = np.array([chr(i).isalpha() for i in range(0x110000)])


def code_of(label: Column) -> Column:
    """Two-letter code that a label names, however written; NULL if none."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    return F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[base]


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Number of the n bytes that end at each position from n-1 on."""
    keys = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        keys = (keys << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    return keys


class Contexts:
    """The frozen context trees of all languages, as tables over byte n-grams."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.langs = sorted(k for k, v in samples.items() if v)
        n = len(self.langs)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for lang in self.langs:
            data = np.frombuffer(b"".join(PAD + x for x in samples[lang]) + PAD, np.uint8)
            grams = _grams(data, ORDER + 1)
            grams = grams[(grams & np.uint32(255)) != 10]  # the end of a line isn't predicted
            for k in range(ORDER + 1):
                mask = np.uint32((1 << (8 * (k + 1))) - 1)
                counts[k].append(np.unique(grams & mask, return_counts=True))
        self.tables, lower = [], None
        for k in range(ORDER + 1):
            union = np.unique(np.concatenate([u for u, _ in counts[k]] or [np.zeros(0, np.uint32)]))
            contexts = np.unique(union >> np.uint32(8))
            seen = np.zeros((len(union), n), np.float64)
            for j, (u, c) in enumerate(counts[k]):
                seen[np.searchsorted(union, u), j] = c
            at = np.searchsorted(contexts, union >> np.uint32(8))
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, at, seen)
            np.add.at(kinds, at, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                cost = -np.log2(seen / (total + kinds)[at])
            missing = seen == 0
            down = np.full((len(union), n), 8.0) if lower is None else lower(union & np.uint32((1 << (8 * k)) - 1))
            cost[missing] = (escape[at] + down)[missing]
            self.tables.append((union, cost, contexts, escape))
            lower = lambda g, k=k: self._lookup(g, k)
        self._freeze()

    def _lookup(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code length of the last byte of each gram of k+1 bytes, per language."""
        union, cost, contexts, escape = self.tables[k]
        n = len(self.langs)
        if not len(union):
            return np.full((len(grams), n), 8.0)
        i = np.minimum(np.searchsorted(union, grams), len(union) - 1)
        out = cost[i]
        miss = np.flatnonzero(union[i] != grams)
        if len(miss):
            g = grams[miss]
            c = np.minimum(np.searchsorted(contexts, g >> np.uint32(8)), len(contexts) - 1)
            esc = np.where((contexts[c] == g >> np.uint32(8))[:, None], escape[c], 0.0)
            down = self._lookup(g & np.uint32((1 << (8 * k)) - 1), k - 1) if k else np.full((len(g), n), 8.0)
            out[miss] = esc + down
        return out

    def _freeze(self) -> None:
        """Hash table over the longest grams; its last row holds zeros, for bytes that aren't counted."""
        union, cost = self.tables[ORDER][:2]
        bits = max(10, int(2 * max(1, len(union)) - 1).bit_length() + 1)
        self.shift = np.uint32(32 - min(bits, 28))
        size = 1 << min(bits, 28)
        self.slots, self.keys = np.full(size, -1, np.int32), np.zeros(size, np.uint32)
        todo, at = np.arange(len(union)), self._home(union)
        while len(todo):
            free = self.slots[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.keys[at[put]] = todo[put], union[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & (size - 1)
        self.cost = np.vstack([cost, np.zeros((1, len(self.langs)))]).astype(np.float32)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def rows(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of self.cost for each gram, and the positions of grams without one."""
        at = self._home(grams)
        row = self.slots[at]
        open_ = np.flatnonzero((row >= 0) & (self.keys[at] != grams))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            row[open_] = self.slots[at[open_]]
            open_ = open_[(row[open_] >= 0) & (self.keys[at[open_]] != grams[open_])]
        return row, np.flatnonzero(row < 0)

    def score(self, lines: list[bytes]) -> np.ndarray:
        """Bits of each line (folded, without line ends) under each language."""
        if not lines:
            return np.zeros((0, len(self.langs)))
        data = np.frombuffer(PAD + PAD.join(lines) + PAD, np.uint8)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
        grams = _grams(data, ORDER + 1)
        row, miss = self.rows(grams)
        pad = data[ORDER:] == 10
        row[pad] = len(self.cost) - 1
        miss = miss[~pad[miss]]
        row[miss] = len(self.cost) - 1
        out = np.zeros((len(lines), len(self.langs)))
        step = 1 << 19
        line_of = np.repeat(np.arange(len(lines)), sizes + ORDER)
        for a in range(0, len(row), step):
            block, own = self.cost[row[a : a + step]], line_of[a : a + step]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
            if len(own):
                out[own[heads]] += np.add.reduceat(block[: len(own)], heads, axis=0)
        if len(miss):
            kinds, back = np.unique(grams[miss], return_inverse=True)
            np.add.at(out, line_of[np.minimum(miss, len(line_of) - 1)], self._lookup(kinds, ORDER)[back])
        return out


def folded(text: str) -> bytes:
    raw = text.encode("utf-8", "replace").translate(FOLD)
    return BLANKS.sub(b" ", raw) if LAYOUT.search(raw) else raw


def script_of(line: str) -> str:
    """'latin', 'hi', 'zh' or 'th', by most letters."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = c[ALPHA[np.minimum(c, 0x10FFFF)]]
    n = {"latin": int((c < 0x250).sum()), "hi": int(((c >= 0x900) & (c < 0x980)).sum()), "th": int(((c >= 0xE00) & (c < 0xE80)).sum()), "zh": int(((c >= 0x3400) & (c < 0xA000)).sum())}
    return max(n, key=lambda k: n[k])


def letters(line: str) -> int:
    return int(ALPHA[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())


def fit(samples: list[tuple[str, str]]) -> Contexts:
    """Fits the context trees on (code, text) pairs whose codes may be wrong in part."""
    latin = {"en", "de", "fr", "es", "pt"}
    lines = [(code, script_of(x), x) for code, text in samples for x in text.split("\n") if letters(x) >= MIN_LETTERS]
    trees: dict[str, list[bytes]] = {}
    for code, script, x in lines:
        if script == (code if code not in latin else "latin"):
            trees.setdefault(code, []).append(folded(x))
    first = Contexts(trees)
    own = [i for i, k in enumerate(first.langs) if k in latin]
    pool = [folded(x) for code, script, x in lines if code == "hi" and script == "latin"]
    if pool and own:
        typical = np.array([np.median(first.score(trees[first.langs[i]])[:, i] / [len(x) for x in trees[first.langs[i]]]) for i in own])
        ratio = (first.score(pool)[:, own] / np.array([len(x) for x in pool])[:, None] / typical).min(axis=1)
        trees[ROMANISED] = [x for x, r in zip(pool, ratio) if r > FOREIGN]
    elif pool:
        trees[ROMANISED] = pool
    first = Contexts(trees)
    kept = {k: [x for x, best in zip(v, first.score(v).argmin(axis=1)) if first.langs[best] == k] for k, v in trees.items() if v}
    return Contexts(kept)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Contexts:
    """Fits on at most `sample_docs` documents per label and SAMPLE_CHARS characters of each; no more than that reaches the driver."""
    w = Window.partitionBy("code").orderBy("h", "doc_id")
    rows = (
        docs.select("doc_id", "text", code_of(F.col("lang")).alias("code"))
        .filter("code IS NOT NULL AND length(text) >= 40")
        .select("code", "doc_id", F.xxhash64("doc_id").alias("h"))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= sample_docs)
    )
    chosen = {r.doc_id: r.code for r in rows.collect()}
    if not chosen:
        return Contexts({})
    texts = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).filter(F.col("doc_id").isin(list(chosen))).collect()
    return fit(sorted((chosen[r.doc_id], r.text) for r in texts if r.text))


def label_lines(docs: DataFrame, model: Contexts | None = None) -> DataFrame:
    """(doc_id, label, line_no, lang, confidence, n_letters) for every line of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model if model is not None else train(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([k.partition("-")[0] for k in m.langs] + [""], object)
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                texts = part.text.tolist()
                lines = [x for t in texts for x in folded(t).split(b"\n")]
                per = np.array([t.count("\n") + 1 for t in texts])
                wide = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                sums = np.concatenate([[0], np.cumsum(ALPHA[wide])])
                ends = np.concatenate([np.flatnonzero(wide == 10), [len(wide)]])
                n_letters = sums[ends] - sums[np.concatenate([[0], ends[:-1] + 1])]
                bits = m.score(lines)
                if bits.shape[1]:
                    best = bits.argmin(axis=1)
                    merged = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / TEMPER)
                    same = names[:-1][None, :] == names[best][:, None]
                    conf = (merged * same).sum(axis=1) / merged.sum(axis=1)
                else:
                    best, conf = np.full(len(lines), -1), np.zeros(len(lines))
                none = (n_letters == 0) | (bits.shape[1] == 0)
                lang = names[best].copy()
                lang[none] = None
                yield pd.DataFrame({
                    "doc_id": np.repeat(part.doc_id.to_numpy(), per), "label": np.repeat(part.label.to_numpy(object), per),
                    "line_no": np.concatenate([np.arange(1, k + 1) for k in per]), "lang": lang,
                    "confidence": np.where(none, 0.0, conf.round(6)), "n_letters": n_letters,
                })

    rows = docs.select("doc_id", "text", code_of(F.col("lang")).alias("label")).filter("text IS NOT NULL")
    return rows.mapInPandas(run, "doc_id long, label string, line_no int, lang string, confidence double, n_letters int")


def label_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence): the language with most letters; confidence is its share, weighted by that of the lines."""
    per = label_lines(docs).groupBy("doc_id", "label", "lang").agg(F.sum("n_letters").alias("n"), F.sum(F.col("n_letters") * F.col("confidence")).alias("sure"))
    best = per.groupBy("doc_id", "label").agg(F.max_by(F.struct("lang", "sure"), F.struct("n", "lang")).alias("top"), F.sum("n").alias("all"))
    return best.select("doc_id", "label", F.col("top.lang").alias("lang"), F.coalesce(F.round(F.expr("try_divide(top.sure, all)"), 4), F.lit(0.0)).alias("confidence"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_lines(read_table(spark, sf_dir, "documents"))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(read_table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in another language than the document's label names, or of documents without a label."""
    rows = p10_lines(spark, sf_dir).filter((F.col("n_letters") >= MIN_LETTERS) & F.col("lang").isNotNull() & (F.col("label").isNull() | (F.col("label") != F.col("lang"))))
    return rows.select("doc_id", "line_no", "lang").distinct()


QUERIES = {"p10_found": p10_found, "p10_lines": p10_lines, "p10_documents": p10_documents}
ORACLE: dict[str, str] = {}
