"""Problem 9: evaluation passages inside training documents.

A generalised suffix automaton of the test items' words is built once on the driver and broadcast; documents are streamed
through it in Arrow batches, so the corpus is read once and never shuffled before the leaks, which are few, are made distinct.
The words of the items are counted first: beyond MAX_ITEM_WORDS the items are dealt to as many automata as they need, built
one after the other, and the corpus is read once for each.

A word is a run of a-z and 0-9 after lower-casing. A word broken at a line end counts as whole: its
halves are joined if the joined form occurs in a test item of the automaton, else they stay two words (a compound
that kept its own hyphen). Blanks, marks and case play no part.

Defined results: null and empty texts and passages hold nothing; repeated documents or items count once
per id; an item shorter than `min_words` can't be found; a span that stands in several items is reported
for each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.runtime import read_table

MIN_WORDS = 16
#: Words of one automaton (about 400 MB at most in each worker). More test material is dealt to several, by hash of the item; each streams the corpus once.
MAX_ITEM_WORDS = 2_000_000
WORD = re.compile(r"[a-z0-9]+")
#: A hyphen of any kind between two halves of a word, with a line end after it.
BROKEN = re.compile(r"([a-z0-9]+)(?:[-‐‑­]|‐)[ \t]*\r?\n[ \t]*([a-z0-9]+)")


class ItemAutomaton:
    """Suffix automaton over word numbers; each state knows the items that hold its longest word run."""

    def __init__(self, items: Iterable[tuple[int, str]], min_words: int = MIN_WORDS) -> None:
        self.min_words = min_words
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        held: list[set[int]] = [set()]
        for item_id, text in items:
            last = 0
            for w in WORD.findall(join_broken((text or "").lower(), ())):
                last = self._add(last, self.words.setdefault(w, len(self.words)), held)
                held[last].add(item_id)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                held[self.link[v]] |= held[v]
        #: For each state, the items that hold the last `min_words` words of a match that ended there.
        self.items: list[tuple[int, ...]] = [()] * len(held)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= min_words:
                self.items[v] = self.items[up] if self.length[up] >= min_words else tuple(sorted(held[v]))

    def _add(self, last: int, c: int, held: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the run was seen in an item before
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, held)
        cur = len(nxt)
        nxt.append({}), length.append(length[last] + 1), link.append(0), held.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, held)
        return cur

    def _clone(self, p: int, c: int, q: int, held: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q])), length.append(length[p] + 1), link.append(link[q]), held.append(set())
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def spans(self, words: list[str]) -> list[tuple[int, int, tuple[int, ...]]]:
        """(first word, end, items) of every stretch whose longest match reaches the limit; stretches that touch and hold the same items are one."""
        nxt, link, length, least, known, found = self.next, self.link, self.length, self.min_words, self.words.get, self.items
        out: list[tuple[int, int, tuple[int, ...]]] = []
        state = run = 0
        for i, w in enumerate(words):
            c = known(w, -1)
            if c < 0:
                state = run = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                run += 1
            if run >= least:
                at = (i + 1 - run, i + 1, found[state])
                if out and out[-1][2] == at[2] and at[0] <= out[-1][1]:
                    out[-1] = (min(out[-1][0], at[0]), at[1], at[2])
                else:
                    out.append(at)
        return out


def join_broken(lowered: str, known) -> str:
    """Joins words broken at a line end where the whole word is known."""
    if "\n" not in lowered:
        return lowered
    return BROKEN.sub(lambda m: m[1] + m[2] if not known or m[1] + m[2] in known else m[1] + " " + m[2], lowered)


def _matchers(spark: SparkSession, items: DataFrame, min_words: int, most: int | None = None) -> list:
    """Broadcast automata that hold all items between them, each about `most` words at most."""
    clean = items.select("item_id", "passage").filter("passage IS NOT NULL").dropDuplicates()
    size = clean.agg(F.coalesce(F.sum(F.regexp_count("passage", F.lit("[A-Za-z0-9]+"))), F.lit(0))).first()[0]
    shards = max(1, -(-size // (most or MAX_ITEM_WORDS)))
    out = []
    for k in range(shards):
        own = clean.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(shards)) == k)
        out.append(spark.sparkContext.broadcast(ItemAutomaton(sorted((r.item_id, r.passage) for r in own.collect()), min_words)))
    return out


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, most: int | None = None) -> DataFrame:
    """(doc_id, item_id, first_word, n_words): each stretch of a document that stands in a test item."""

    def scan(automaton):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = automaton.value
            for pdf in batches:
                rows = []
                for doc_id, text in zip(pdf.doc_id, pdf.text):
                    for first, end, held in a.spans(WORD.findall(join_broken(text.lower(), a.words))):
                        rows += [(doc_id, item, first, end - first) for item in held]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "n_words"])

        return run

    rows = docs.select("doc_id", "text").filter("text IS NOT NULL")
    found = [rows.mapInPandas(scan(m), "doc_id long, item_id long, first_word int, n_words int") for m in _matchers(docs.sparkSession, items, min_words, most)]
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_share: float = 0.5, most: int | None = None) -> DataFrame:
    """(doc_id, text, removed_words, dropped): leaked spans cut out; a document of which they make up more than `max_share` is dropped as a whole (text NULL)."""

    def mark(automaton):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = automaton.value
            for pdf in batches:
                spans = []
                for text, before in zip(pdf.text, pdf.spans):
                    own = [dict(s) for s in before]
                    if text is not None:
                        words, places = located(text, a.words)
                        own += [{"first": places[i][0], "stop": places[j - 1][1]} for i, j, _ in a.spans(words)]
                    spans.append(own)
                yield pd.DataFrame({"doc_id": pdf.doc_id, "text": pdf.text, "spans": spans})

        return run

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, spans in zip(pdf.doc_id, pdf.text, pdf.spans):
                if text is None:
                    rows.append((doc_id, None, 0, False))
                    continue
                _, places = located(text, ())
                kept, pos, gone = [], 0, 0
                for first, stop in sorted((s["first"], s["stop"]) for s in spans):
                    if first > pos:
                        kept.append(text[pos:first])
                    pos = max(pos, stop)
                    places, gone = [p for p in places if not first <= p[0] < stop], gone + sum(first <= p[0] < stop for p in places)
                if gone > max_share * max(1, len(places) + gone):
                    rows.append((doc_id, None, gone, True))
                else:
                    rows.append((doc_id, "".join([*kept, text[pos:]]), gone, False))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed_words", "dropped"])

    kind = "array<struct<first:int,stop:int>>"
    rows = docs.select("doc_id", "text", F.array().cast(kind).alias("spans"))
    for m in _matchers(docs.sparkSession, items, min_words, most):
        rows = rows.mapInPandas(mark(m), f"doc_id long, text string, spans {kind}")
    return rows.mapInPandas(cut, "doc_id long, text string, removed_words int, dropped boolean")


def located(text: str, known) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text, broken ones joined, and where each begins and ends in it."""
    lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    words, places = [], []
    for m in WORD.finditer(lowered):
        gap = lowered[places[-1][1] : m.start()] if places else ""
        if "\n" in gap and re.fullmatch(r"[-‐‑­][ \t]*\r?\n[ \t]*", gap) and words[-1] + m[0] in known:
            words[-1] += m[0]
            places[-1] = (places[-1][0], m.end())
        else:
            words.append(m[0])
            places.append((m.start(), m.end()))
    return words, places


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "heldout")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they hold."""
    return leaks(*_inputs(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents that hold it and its longest stretch."""
    return leaks(*_inputs(spark, sf_dir)).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("n_words").alias("longest"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the leaked spans."""
    return decontaminate(*_inputs(spark, sf_dir))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items, "p9_clean": p9_clean}
ORACLE: dict[str, str] = {}
