"""Problem 3: noise in text from scanned pages.

The lines of a text are labelled body, header, page number or break by a hidden Markov model (Viterbi) over
layout features: page-number forms, title words in capitals, line length and end marks. Body lines are put
together again to paragraphs: words cut at a line end are joined, also across a header or page number that stands
between, compounds keep their own hyphen, and misread letters are put right.

The model starts from weights for how such lines look (LOOK, STEP) and is fitted to the corpus by Viterbi training: the likeliest
states of all texts are counted, texts of the same looks together, the first weights standing for PRIOR lines each, and the counts become the weights.

What counts as a word is learned from the corpus: one aggregation counts the words and hyphenated compounds of all texts, which are
broadcast. A word is misread if it is unknown, or rare beside what it should be, and undoing one or two confusions of letters gives
a known word. Running headers are recognised by the titles and codes of the documents. All of this is learned from every text,
word and title, whatever the size of the corpus.

Defined results: null and empty texts stay as they are; a text of one line can't hold a header or page number; numbers
in a running text are no page numbers; repeated rows count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.runtime import read_table, write_out

#: Lines that the first weights of the line model count for, and rounds of its training.
PRIOR, ROUNDS = 200.0, 3
#: A word is rare beside another if that occurs this many times as often.
RARER = 8
#: What a scanner reads in place of a letter. Read, meant.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("c", "e"),
    ("f", "t"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("$", "s"), ("@", "a"),
)
HYPHENS = "-‐‑­"
PART, BLANKS = re.compile(r"[A-Za-z0-9|!$@]+"), re.compile(r"[ \t]+")
CUT, GOES_ON = re.compile(rf"([A-Za-z0-9|!$@]+(?:-[A-Za-z0-9|!$@]+)*)[{HYPHENS}]$"), re.compile(r"[a-z0-9|!$@]+(?:-[A-Za-z0-9|!$@]+)*")
PAGE = re.compile(
    r"(?i)\s*(?:[-–—]\s*\d{1,5}\s*[-–—]|\.\s*\d{1,5}\s*\.|\[\s*\d{1,5}\s*\]|\(\s*\d{1,5}\s*\)|\|?\s*\d{1,5}\s*\|?"
    r"|(?:p\s*a\s*g\s*e|pg|p)\s*[.:|]?\s*\d{1,5}(?:\s*(?:of|/)\s*\d{1,5})?|\d{1,5}\s*(?:of|/)\s*\d{1,5})\s*"
)
SMALL_WORDS = {"of", "for", "and", "the", "in", "to", "on", "no", "part", "vol", "section", "page"}
STATES = ("body", "header", "page_number", "break")
OBSERVED = ("text", "tail", "caps", "title", "page", "blank")
#: Log probabilities of the model: of a line's look under each state, and from state to state.
LOOK = {
    "body": (-0.15, -2.5, -5.0, -7.0, -6.0, -9.0), "header": (-6.0, -7.0, -2.5, -0.2, -5.0, -9.0),
    "page_number": (-9.0, -9.0, -9.0, -9.0, -0.05, -9.0), "break": (-12.0, -12.0, -12.0, -12.0, -12.0, -0.01),
}
STEP = {
    "body": (-0.15, -3.0, -3.0, -3.0), "header": (-0.3, -3.5, -2.5, -2.5),
    "page_number": (-0.3, -2.5, -3.5, -2.5), "break": (-0.3, -2.5, -2.5, -3.0),
}


Weights = tuple[dict[str, tuple[float, ...]], dict[str, tuple[float, ...]]]


def viterbi(looks: list[str], weights: Weights = (LOOK, STEP)) -> list[str]:
    """The likeliest states of a sequence of looks."""
    if not looks:
        return []
    seen, step = weights
    best, back = [seen[s][OBSERVED.index(looks[0])] for s in STATES], []
    for look in looks[1:]:
        o = OBSERVED.index(look)
        came = [max(range(4), key=lambda p, k=k: best[p] + step[STATES[p]][k]) for k in range(4)]
        best = [best[came[k]] + step[STATES[came[k]]][k] + seen[STATES[k]][o] for k in range(4)]
        back.append(came)
    path = [max(range(4), key=best.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    return [STATES[k] for k in reversed(path)]


Counts = tuple[dict[str, list[float]], dict[str, list[float]]]


def tally(texts: Iterable[tuple[list[str], int]], weights: Weights) -> Counts:
    """How often the likeliest states of texts (looks, how many have them) show each look, and follow each other."""
    seen, step = {s: [0.0] * len(OBSERVED) for s in STATES}, {s: [0.0] * len(STATES) for s in STATES}
    for looks, n in texts:
        states = viterbi(looks, weights)
        for state, look in zip(states, looks):
            seen[state][OBSERVED.index(look)] += n
        for a, b in zip(states, states[1:]):
            step[a][STATES.index(b)] += n
    return seen, step


def fitted(counts: Counts) -> Weights:
    """Weights from counts and the first weights."""
    logs = lambda rows, first: {s: tuple(math.log((x + PRIOR * math.exp(w)) / (sum(v) + PRIOR * sum(map(math.exp, first[s])))) for x, w in zip(v, first[s])) for s, v in rows.items()}
    return logs(counts[0], LOOK), logs(counts[1], STEP)


def fit_lines(texts: list[list[str]], rounds: int = ROUNDS) -> Weights:
    """Weights from the looks of the lines of texts, by Viterbi training."""
    weights: Weights = (LOOK, STEP)
    for _ in range(rounds):
        weights = fitted(tally(((looks, 1) for looks in texts), weights))
    return weights


def fit_corpus(texts: DataFrame, reader: Broadcast) -> Weights:
    """The weights of `fit_lines` over all texts (text): looks are found and counted on the executors, and 40 sums of each task come back per round."""

    def looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Reader(*reader.value)
        for pdf in batches:
            yield pd.DataFrame({"looks": ["".join(str(OBSERVED.index(x)) for x in own.looks(t.replace("\r", "").split("\n"))) for t in pdf.text]})

    kinds = write_out(texts.filter("text IS NOT NULL").select("text").mapInPandas(looks, "looks string").groupBy("looks").count())
    weights: Weights = (LOOK, STEP)
    for _ in range(ROUNDS):

        def sums(batches: Iterator[pd.DataFrame], weights: Weights = weights) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                seen, step = tally((([OBSERVED[int(x)] for x in looks], int(n)) for looks, n in zip(pdf["looks"], pdf["count"])), weights)
                yield pd.DataFrame([(k, s, i, x) for k, rows in enumerate((seen, step)) for s, v in rows.items() for i, x in enumerate(v)], columns=["k", "state", "i", "x"])

        counts = {s: [0.0] * len(OBSERVED) for s in STATES}, {s: [0.0] * len(STATES) for s in STATES}
        for r in kinds.mapInPandas(sums, "k int, state string, i int, x double").groupBy("k", "state", "i").agg(F.sum("x").alias("x")).collect():
            counts[r.k][r.state][r.i] = r.x
        weights = fitted(counts)
    return weights


def folded(line: str) -> str:
    """Letters of a line, with digits inside words read as letters."""
    out = []
    for w in re.findall(r"[A-Za-z0-9|!]+", line):
        if re.search("[A-Za-z]", w):
            out.append(w.lower().translate(str.maketrans("01|!5", "olils")))
    return "".join(out)


class Reader:
    """Lexicon, titles and the line model; reads one text."""

    def __init__(self, counts: dict[str, int], titles: list[tuple[str, str]], least: int = 1, weights: Weights = (LOOK, STEP)) -> None:
        self.counts, self.least, self.weights = counts, least, weights
        starts = {folded(" ".join(t.split()[:2])) for _, t in titles if len(t.split()) > 1} | {folded(t) for _, t in titles if t}
        self.starts, self.sizes = starts - {""}, sorted({len(x) for x in starts if x})
        self.codes = {c.lower() for c, _ in titles if c}
        self.code_sizes = sorted({len(c) for c in self.codes})
        self.known: dict[str, str | None] = {}
        #: Words as written that need no correction.
        self.fine: set[str] = set()

    def correct(self, word: str) -> str | None:
        """What a misread word (in lower case) should be; None if it is not misread."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = self._correct(word)
        return self.known[word]

    def look(self, line: str, last: bool, alone: bool) -> str:
        s = line.strip()
        if not s:
            return "blank"
        if alone:
            return "text"
        if len(s) <= 24 and PAGE.fullmatch(s):
            return "page"
        if len(s) <= 60 and s[-1] not in ".;:," and (letters := folded(s)):
            words = [w for w in re.findall(r"[A-Za-z0-9|!]+", s) if re.search("[A-Za-z]", w)]
            raised = all(w[0].isupper() or w.lower() in SMALL_WORDS or len(w) == 1 or w[0].isdigit() for w in words)
            if raised and (any(letters[:n] in self.starts for n in self.sizes) or (words and words[0].isupper() and any(letters[:n] in self.codes for n in self.code_sizes))):
                return "title"
            if sum(c.isupper() for c in s) >= 0.6 * max(1, sum(c.isalpha() for c in s)) and len(letters) > 3:
                return "caps"
        return "tail" if last and len(s) < 30 else "text"

    def looks(self, lines: list[str]) -> list[str]:
        return [self.look(x, i == len(lines) - 1, len(lines) == 1) for i, x in enumerate(lines)]

    def labels(self, lines: list[str]) -> list[str]:
        return viterbi(self.looks(lines), self.weights)

    def _correct(self, word: str) -> str | None:
        """What a misread word (in lower case) should be; None if it is not misread."""
        if len(word) < 4 or word.isdigit() or not any(c.isalpha() for c in word):
            return None
        own = self.counts.get(word, self.least - 1) if word.isalpha() else 0
        best, most, todo, seen = None, max(2, RARER * own), [word], {word}
        for _ in range(2):
            fresh = []
            for w in todo:
                for read, meant in CONFUSIONS:
                    at = w.find(read)
                    while at >= 0:
                        v = w[:at] + meant + w[at + len(read) :]
                        if v not in seen:
                            seen.add(v)
                            fresh.append(v)
                            if v.isalpha() and (n := self.counts.get(v, 0)) > most:
                                best, most = v, n
                        at = w.find(read, at + 1)
            if best:
                return best
            if len(word) < 6 or own:
                return None
            todo = fresh
        return best

    def is_compound(self, head: str, tail: str) -> bool:
        """Whether a word cut after a hyphen kept it as its own."""
        tail = "-".join(self.correct(p) or p for p in tail.split("-"))
        head = "-".join(self.correct(p) or p for p in head.split("-"))
        whole, joined = self.counts.get(f"{head}-{tail}", 0), self.counts.get(head + tail, 0)
        return whole > 0 and whole >= joined

    def read(self, text: str) -> tuple[list[str], set[str]]:
        """(paragraphs, kinds of noise found)."""
        lines = text.replace("\r", "").split("\n")
        states, kinds = self.labels(lines), set()
        paragraphs: list[str] = []
        current = ""
        for line, state in zip(lines, states):
            if state in ("header", "page_number"):
                kinds.add(state)
                continue
            if state == "break":
                if current:
                    paragraphs.append(current)
                current = ""
                continue
            line = line.strip(" \t")
            bare = current.rstrip(" \t")
            m = CUT.search(bare, max(0, len(bare) - 200)) if bare[-1:] and bare[-1] in HYPHENS else None
            n = GOES_ON.match(line)
            if m and n and re.search("[A-Za-z]", m[1]) and re.search("[a-z]", n[0]):
                if bare[-1] in "-‑" and self.is_compound(m[1].lower(), n[0].lower()):
                    current = bare + line
                else:
                    kinds.add("broken_word")
                    current = bare[:-1] + line
            elif m and bare[-1] in "-‑" and line[:1].isupper():
                current = bare + line
            else:
                current = f"{current} {line}" if current else line
        if current:
            paragraphs.append(current)
        def right(m: re.Match) -> str:
            word, rest = m[0], ""
            if word in fine:
                return word
            while word and word[-1] == "!" and not m.string[m.end() : m.end() + 1] in "-‐‑":
                word, rest = word[:-1], "!" + rest
            if not word or word.isupper() or (len(word) < 4 and word.isalpha() and word.lower() in self.counts) or (word[0].isupper() and word.isalpha()):
                return m[0]
            meant = self.correct(word.lower())
            if not meant:
                if len(fine) < 500_000:
                    fine.add(m[0])
                return m[0]
            kinds.add("misread")
            return (meant.capitalize() if word[0].isupper() else meant) + rest

        fine = self.fine
        return [BLANKS.sub(" ", PART.sub(right, p)) for p in paragraphs], kinds


def lexicon(texts: DataFrame) -> dict[str, int]:
    """Counts of the words and compounds of all texts (text)."""
    whole = F.regexp_replace("text", r"[-‐‑­][ \t]*\r?\n", "\n")
    found = F.regexp_extract_all(F.lower(whole), F.lit(r"(?<![a-z0-9|!$@-])[a-z]+(?:-[a-z]+)*(?![a-z0-9|!$@-])"), F.lit(0))
    return {r.word: r["count"] for r in texts.filter("text IS NOT NULL").select(F.explode(found).alias("word")).groupBy("word").count().collect()}


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, record_id, para_no, text) of scanned chunks and of the paragraphs of units."""
    chunks = read_table(spark, sf_dir, "chunks").filter("source = 'pdf'").select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("record_id"), F.lit(0).alias("para_no"), "text")
    units = read_table(spark, sf_dir, "units").select(F.col("unit_id").cast("string").alias("record_id"), F.posexplode("paragraphs.text"))
    return chunks.unionByName(units.select(F.lit("unit").alias("src"), "record_id", (F.col("pos") + 1).alias("para_no"), F.col("col").alias("text")))


def repair(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(src, record_id, para_no, paragraphs, kinds) of rows (src, record_id, para_no, text), with titles (doc_id, doc_title)."""
    spark = rows.sparkSession
    names = sorted((r.doc_id or "", r.doc_title) for r in titles.filter("doc_title IS NOT NULL").select("doc_id", "doc_title").distinct().collect())
    counts = lexicon(rows.select("text"))
    weights = fit_corpus(rows.select("text"), spark.sparkContext.broadcast((counts, names)))
    reader = spark.sparkContext.broadcast((counts, names, 1, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Reader(*reader.value)
        for pdf in batches:
            done = [own.read(t) if t else ([] if t is None else [t], set()) for t in pdf.text]
            yield pd.DataFrame({"src": pdf.src, "record_id": pdf.record_id, "para_no": pdf.para_no, "paragraphs": [p for p, _ in done], "kinds": [sorted(k) for _, k in done]})

    return rows.select("src", "record_id", "para_no", "text").mapInPandas(run, "src string, record_id string, para_no int, paragraphs array<string>, kinds array<string>")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs of every scanned text."""
    return repair(scanned_texts(spark, sf_dir), read_table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with the kinds of noise that were repaired in it."""
    return p3_clean(spark, sf_dir).select("src", "record_id", "para_no", F.explode("kinds").alias("kind")).distinct()


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
ORACLE: dict[str, str] = {}
