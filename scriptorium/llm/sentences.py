"""Problem 7: sentence boundaries across languages and scripts.

The sentence-break rules of the Unicode text segmentation annex, cut down to what a boundary needs: a run of terminators
(by character, for all scripts), closing marks after it, then what follows. Added to them: abbreviations per
language that never, or only before a capital, end a sentence; list numbers, which belong to what follows; ordinals of
German dates; quotations, which end nothing inside and only before a capital after; source markers such as [S1], which
belong to the sentence before; and Thai, which has no terminators and ends at white space.

Texts are independent, so this is one map over Arrow batches. Positions are characters (code points).

Defined results: null texts and texts of white space only have no sentences; a text that breaks off ends its last
sentence; white space after a sentence belongs to none; repeated rows count once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.marks import is_empty, language
from scriptorium.runtime import read_table

THAI = re.compile("[฀-๿]")
TERMINATOR = re.compile(r"[.!?‼⁇⁈⁉…]+|[。！？｡．।॥؟۔።፧၊။។៕᠃᠉܀-܂꓿꘎꘏]+[!?！？]*")
MARKERS = re.compile(r"(?:\s*\[\s*S\s*\d+(?:\s*[,;]\s*S?\s*\d+)*\s*\])+", re.I)
CLOSERS = "\"”“’»)]}」』）】"
OPENERS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›"}
OPENING = re.compile("[\"“«„「『‹]")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
SPACE = " \t\r\n\f\v   ​  　﻿\x85"
#: Abbreviations that never end a sentence, and those that do before a capital. Fixed values, lower case, without last dot.
NEVER = {
    "en": {"rs", "cl", "fig", "figs", "art", "arts", "pvt", "engr", "dy", "approx", "vs", "cf", "i.e", "e.g", "viz", "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vol", "sec", "secs", "para", "paras", "pp", "p", "eq", "ch", "addl", "asst", "govt", "hon", "regd", "ref", "sl", "sq", "dept", "gen", "max", "min", "resp", "nos"},
    "de": {"z", "nr", "ziff", "abs", "bzw", "ca", "dr", "prof", "vgl", "ggf", "evtl", "s", "u", "d", "inkl", "exkl", "str", "hr", "fr", "bspw", "zzgl", "max", "min", "sog", "i", "o"},
    "fr": {"art", "cf", "p", "pp", "m", "mme", "mlle", "me", "dr", "n", "éd", "env", "chap", "vol", "al", "av", "bd"},
    "es": {"art", "pág", "págs", "pag", "sr", "sra", "srta", "dr", "dra", "núm", "num", "n", "p", "aprox", "cap", "vol", "ud", "uds", "ee", "av", "ref"},
    "pt": {"art", "pág", "págs", "pag", "sr", "sra", "dr", "dra", "n", "núm", "p", "aprox", "cap", "vol", "eng", "exmo", "av", "ref"},
    "hi": {"डॉ", "श्री", "रु", "सं", "क्र", "पृ", "प्रो", "कं", "लि", "मि", "नं"},
}
BEFORE_CAPITAL = {"ltd", "etc", "a.m", "p.m", "co", "inc", "corp", "usw", "u.s.w", "ff", "bros", "al", "gmbh", "cía", "cia", "ltda"}
ALL_NEVER = frozenset().union(*NEVER.values())
#: These suppress only before a digit; without one they may be words.
BEFORE_DIGIT = {"no", "nos", "p", "s", "m", "n", "u", "d", "i", "o", "al", "art", "min", "max", "st", "ch", "me", "fr", "ms", "str", "hr", "gen", "ref", "sec", "para", "abs"}
SURE = ALL_NEVER - BEFORE_DIGIT
#: Of the language of a text; where that can't be told, of all.
SURE_IN = {code: frozenset(words - BEFORE_DIGIT) for code, words in NEVER.items()} | {"zh": frozenset(), "th": frozenset(), None: SURE}
GERMAN_MONTHS = ("Januar", "Jänner", "Februar", "März", "Marz", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
GERMAN_DAY = re.compile(r"(?i)(?:^|\s)(?:am|vom|bis|zum|den|dem|seit|ab)\s+\d{1,2}$")
LABELS = {"annex", "table", "clause", "appendix", "schedule", "part", "class", "grade", "type", "item", "section", "exhibit", "form", "block", "anlage", "anexo", "annexe", "tabelle"}
WORD_BEFORE = re.compile(r"[^\s\"“”„«»()\[\]{}‘]+$")
LIST_HEAD = re.compile(r"\(?(?:\d{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,6})$")


def quotations(text: str) -> list[tuple[int, int]]:
    """(opening, closing) positions of quotations; nested ones belong to the outer. A quotation that its paragraph doesn't close is none."""
    out, done = [], 0
    for m in OPENING.finditer(text):
        i = m.start()
        if i < done:
            continue
        if m[0] == '"' and not (i == 0 or text[i - 1] in SPACE or text[i - 1] in "([:—–-，、：,。"):
            continue
        close = OPENERS.get(m[0], '"')
        end = PARAGRAPH.search(text, i)
        stop = min((k for k in (text.find(x, i + 1, end.start() if end else len(text)) for x in close) if k > 0), default=-1)
        if stop > 0:
            out.append((i, stop))
            done = stop + 1
    return out


def is_dense(c: str) -> bool:
    """A character of a script that writes sentences without white space between them."""
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "！" <= c <= "｠"


def suppressed(text: str, start: int, dot: int, nxt: str, sure: frozenset[str] = SURE) -> bool:
    """Whether the single full stop at `dot` of the sentence from `start` belongs to an abbreviation, list number or ordinal."""
    m = WORD_BEFORE.search(text, max(start, dot - 40), dot)
    if not m:
        return False
    word, head = m[0].lstrip("-–—•"), m.start()
    bare = word.lower().rpartition("'")[2].rpartition("’")[2]
    if not text[start:head].strip(SPACE + "([•-–—") and LIST_HEAD.match(word):
        return True
    if word in ("M/s", "M/S") or bare in sure or (bare in BEFORE_DIGIT and nxt.isdigit()):
        return True
    if bare in BEFORE_CAPITAL:
        return not (nxt.isupper() or nxt in "([\"“«„•" or nxt.isdigit())
    before = WORD_BEFORE.search(text, max(start, head - 40), len(text[:head].rstrip(SPACE)))
    if len(word) == 1 and word.isalpha() and word.isupper() and nxt.isupper():
        if before is None or (before[0].endswith(".") and before[0].lower().rstrip(".") not in LABELS):
            return True
    if word.isdigit() and len(word) <= 2:
        rest = text[dot + 1 : dot + 16].lstrip(SPACE)
        if rest.startswith(GERMAN_MONTHS) and GERMAN_DAY.search(text[max(start, head - 8) : dot]):
            return True
    return False


def sentence_ends(text: str) -> list[int]:
    """Ends of the sentences of a text, in characters from its start."""
    n = len(text.rstrip(SPACE))
    if not text.strip(SPACE):
        return []
    quotes = quotations(text)
    opens = [a for a, _ in quotes]
    ends: list[int] = []
    start = 0
    sure = SURE_IN.get(language(text), SURE)
    thai = not text.isascii() and THAI.search(text) is not None
    stops = [(m.start(), m.end(), True) for m in TERMINATOR.finditer(text)]
    if thai:
        stops = sorted(stops + [(m.start(), m.start(), False) for m in re.finditer(r"(?<=\S)\s+(?=\S)", text)])
    for a, b, real in stops:
        if a < start or b <= start and ends:
            continue
        if not real:
            own = text[start:a]
            if not THAI.search(own):
                continue
            if MARKERS.match(text, a):
                end = MARKERS.match(text, a).end()
            else:
                end = a
            last = MARKERS.sub("", own).rstrip(SPACE)
            if last and last[-1] in ",;:" or end >= n:
                continue
            ends.append(end)
            start = end
            continue
        mark = text[a:b]
        k = bisect_right(opens, a) - 1
        quoted = k >= 0 and quotes[k][0] < a < quotes[k][1]
        end = b
        if quoted:
            if text[b : quotes[k][1]].strip(SPACE + ".!?"):
                continue  # inside a quotation
            end = quotes[k][1] + 1
        while end < n and text[end] in CLOSERS and (text[end] != '"' or quoted) and not MARKERS.match(text, end):
            if text[end] in "“" and not quoted:
                break
            end += 1
        m = MARKERS.match(text, end)
        if m:
            end = m.end()
        gap = end
        while gap < len(text) and text[gap] in SPACE:
            gap += 1
        if gap >= n:
            break
        nxt = text[gap]
        dense = mark[0] in "。！？｡．" or is_dense(nxt)
        if gap == end and not m and not dense and not quoted and mark[0] not in "।॥":
            continue  # no white space: a decimal, an address, an abbreviation
        if quoted:
            if gap == end and not m or not (nxt.isupper() or nxt.isdigit() or nxt in "([\"“«„¿¡•-") :
                if not (m and (nxt.isupper() or not nxt.islower()) and not is_dense(nxt) and nxt.isascii()):
                    continue
        elif mark == ".":
            if nxt.islower() or nxt in ",;:)" or suppressed(text, start, a, nxt, sure):
                continue
        elif set(mark) <= {".", "…"}:
            if nxt.islower() or (a > 0 and text[a - 1] in SPACE and not nxt.isupper()):
                continue
        elif nxt in ",;:)":
            continue
        ends.append(end)
        start = end
    if not ends or ends[-1] < n:
        ends.append(n)
    return ends


def split_sentences(rows: DataFrame) -> DataFrame:
    """(src, record_id, text) to (src, record_id, sentence_no, start_pos, end_pos, sentence)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, rid, text in zip(pdf.src, pdf.record_id, pdf.text):
                begin = 0
                for k, end in enumerate(sentence_ends(text)):
                    while begin < end and text[begin] in SPACE:
                        begin += 1
                    out.append((src, rid, k + 1, begin, end, text[begin:end]))
                    begin = end
            yield pd.DataFrame(out, columns=["src", "record_id", "sentence_no", "start_pos", "end_pos", "sentence"])

    return rows.select("src", "record_id", "text").filter("text IS NOT NULL").mapInPandas(run, "src string, record_id string, sentence_no int, start_pos int, end_pos int, sentence string")


def answers_and_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read_table(spark, sf_dir, "generation_finetuned").filter(~is_empty(F.col("answer"))).select(F.lit("answer").alias("src"), F.col("result_id").cast("string").alias("record_id"), F.col("answer").alias("text"))
    chunks = read_table(spark, sf_dir, "chunks").filter("source = 'curated' AND NOT contains(text, '|')").select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("record_id"), "text")
    return answers.unionByName(chunks)


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(answers_and_chunks(spark, sf_dir)).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of every sentence."""
    return split_sentences(answers_and_chunks(spark, sf_dir)).select("src", "record_id", "sentence_no", "end_pos").distinct()


QUERIES = {"p7_found": p7_found, "p7_sentences": p7_sentences}
ORACLE: dict[str, str] = {}
