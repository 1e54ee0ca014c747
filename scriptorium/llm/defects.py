"""Problem 5: broken prompt and response pairs.

Each answer is put to five tests, the first that fails names its defect:
empty; a copy of its question: with the answer as zstandard dictionary the question shrinks to QUESTION_SHARE of what it takes by itself (so it stands in
the answer, whole or nearly), and the answer with the question to COPY_SHARE (so there is little else, however often it is repeated); a refusal, by dictionaries of declining and of not-found phrases;
another language than the question's, by script and dictionaries of function words; truncated, by what stands at its end: open
quotations, brackets or markers, abbreviations, words without an end mark that are no reference, and, for Thai,
an ending that sentences of the corpus don't have (terminal contexts, counted over all answers: those met twice or more, and
by at least one in CONTEXTS of the sentences, so they are at most CONTEXTS).

Answers are independent apart from those counts: two passes over the table, no shuffle of texts.

Defined results: a null question can't be copied and has no language; a null `answerable` counts as false; repeated rows
count once; answers whose language can't be told are in that of their question.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.marks import MARKER_JAVA, is_empty, language
from scriptorium.llm.sentences import BEFORE_DIGIT, LIST_HEAD, OPENERS, SPACE, SURE, sentence_ends
from scriptorium.runtime import read_table

CONTEXTS, CONTEXT_CHARS = 100_000, 5
MARKER = re.compile(MARKER_JAVA)
#: A marker that breaks off.
OPEN_MARKER = re.compile(r"\[\s*[Ss]?[\d,; S]*$")
#: Largest shares of their own compressed sizes that a question takes with its copy as dictionary, and the copy with its question.
QUESTION_SHARE, COPY_SHARE = 0.14, 0.4
#: Bytes that compressed data take besides what they say, and the least question that can be a dictionary.
FRAME, LEAST_DICTIONARY = 9, 8
#: Phrases by which an answer declines; the first group needs a first person in its sentence. Fixed values.
FIRST_PERSON = re.compile(r"\b(?:i|i'm|i'd|i'll|i've|me|my|we|our|us|assistant)\b")
DECLINES = re.compile(
    r"\b(?:can(?:'t|not| not)|won't|will not|unable to|not able to|not allowed|not permitted|must decline|have to decline|decline to|declin\w+|refuse|rather not|prefer not"
    r"|pass on|keep me from|keeps? us from|prevent me|outside what|beyond what|not be right|not be appropriate|no opinion|not comfortable|not in a position|not going to|no comment|abstain|guidelines)\b"
)
DECLINES_ELSEWHERE = re.compile(
    r"\b(?:lo siento|no puedo|je ne peux pas|je regrette|désolée?|es tut mir leid|leider kann ich|ich kann (?:ihnen |dabei |diese )|lamento|não posso|desculpe|mujhe khed)\b|抱歉|无法回答|不能回答|क्षमा करें|खेद है|ขออภัย|ไม่สามารถตอบ"
)
NOT_FOUND = re.compile(
    r"\b(?:could|can)(?:n't| ?not) (?:be )?(?:found|find)\b|\b(?:contain|contains|give|gives|hold|holds|offer|has|have) no (?:answer|information|mention)\b|\bnot (?:stated|mentioned|found|covered|addressed|contained|specified|available|answered) (?:in|by)\b"
    r"|\bdo(?:es)?(?:n't| not) (?:say|state|mention|cover|answer|address|contain)\b|\bsilent (?:on|about)\b|\bno (?:passage|source|document|answer|information|mention)s? (?:covers?|mentions?|answers?|states?|addresses|was found|is given|is stated|found|of this|on this)\b|\bnothing (?:was|is|could be) found\b|\bno \w+(?: \w+){0,2} (?:could|can|was|is) (?:be )?(?:found|located)\b"
)
NOT_FOUND_ABOUT = re.compile(r"\b(?:document|passage|source|text|material|answer|excerpt|context)s?\b|\bit\b")
#: Most words of a not-found statement.
STATEMENT_WORDS = 30
REFERENCE = re.compile(
    r"(?i)(?:(?:see|yes|no|under|per|as per|cf\.?)[,:]?\s+)*(?:(?:see|under|per|in|by|to)\s+)*(?:annex|table|clause|cl\.|art\.|article|fig\.|figure|section|sec\.|part|appendix|schedule|para\.?|page|p\.|rule|§|ziff\.|nr\.|abs\.|pág\.)\s*[\dA-Z][\w.()/-]*"
)
OPENING = re.compile("[\"“«„「『]")
BRACKET, NUMBERED = re.compile("[()]"), re.compile(r"(?:(?<=\s)|^)\(?(?:\d{1,3}|[a-z]|[ivxlc]+)\)")
END_MARK = re.compile(r"[.!?…。！？।॥؟][\"”’»“)\]}」』\s]*$")
WORDS = re.compile(r"\w+(?:[ऀ-ॿ฀-๿]\w*)*")


#: What isn't a letter, digit or mark on a letter.
OTHER = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


@lru_cache(4096)  # questions come many times
def plain(text: str) -> str:
    """Lower case, markers and marks out, single blanks."""
    return OTHER.sub(" ", unicodedata.normalize("NFKC", MARKER.sub(" ", text)).lower()).strip()


#: One compressor serves all texts of a worker; those with a dictionary are made for pairs only that may be copies.
PLAIN = zstandard.ZstdCompressor(level=3, write_content_size=False)


def share_of(text: bytes, dictionary: bytes) -> float:
    """Size of a text compressed with a dictionary, as a share of its size compressed without."""
    free = max(1, len(PLAIN.compress(text)) - FRAME)
    tied = zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return (len(tied.compress(text)) - FRAME) / free


def copies(question: str, answer: str) -> bool:
    """Whether an answer only repeats its question, whole or nearly, once or more, whatever little stands around it."""
    q, a = plain(question), plain(answer)
    if not q or not a:
        return False
    if q == a:
        return True
    raw, known = a.encode(), q.encode()
    # What the question lacks has to be written out: with half of the answer new there is no need to compress.
    asked = set(q.split())
    if min(len(raw), len(known)) < LEAST_DICTIONARY or 2 * len(raw) < len(known) or (q.isascii() and 2 * sum(len(w) + 1 for w in a.split() if w not in asked) > len(raw)):
        return False
    return share_of(known, raw) <= QUESTION_SHARE and share_of(raw, known) <= COPY_SHARE


def refuses(answer: str, answerable: bool) -> bool | None:
    """True for a refusal, False for a rightful not-found statement, None for neither."""
    text = MARKER.sub("", answer).lower().replace("’", "'")
    start = 0
    for k, end in enumerate(sentence_ends(text)):
        sentence, start = text[start:end], end
        if k < 2 and FIRST_PERSON.search(sentence) and DECLINES.search(sentence) and not NOT_FOUND.search(sentence):
            return True
        if k < 2 and DECLINES_ELSEWHERE.search(sentence):
            return True
    if len(text.split()) <= STATEMENT_WORDS and NOT_FOUND.search(text) and NOT_FOUND_ABOUT.search(text):
        return bool(answerable)
    return None


def unclosed(text: str) -> bool:
    """Whether a quotation or bracket is still open at the end."""
    done = 0
    for m in OPENING.finditer(text):
        if m.start() < done:
            continue
        close = '"' if m[0] == '"' else OPENERS[m[0]]
        stop = min((k for k in (text.find(x, m.end()) for x in close) if k > 0), default=-1)
        if stop < 0:
            return True
        done = stop + 1
    depth = 0
    for m in BRACKET.finditer(NUMBERED.sub("", text)) if "(" in text else ():
        depth = depth + 1 if m[0] == "(" else max(0, depth - 1)
    return depth > 0


def truncated(answer: str, thai_endings: frozenset[str]) -> bool:
    """Whether an answer breaks off before its last sentence is complete."""
    text = answer.rstrip(SPACE)
    if OPEN_MARKER.search(text):
        return True
    text = MARKER.sub("", text).rstrip(SPACE)
    if unclosed(text):
        return True
    if re.search("[฀-๿][^a-zA-Zऀ-ॿ]*$", text[-12:]):
        return bool(thai_endings) and text[-CONTEXT_CHARS:] not in thai_endings
    if not END_MARK.search(text):
        return not REFERENCE.fullmatch(text.strip(SPACE))
    last = text[(sentence_ends(text) or [0])[-2] if len(sentence_ends(text)) > 1 else 0 :].strip(SPACE)
    if re.search(r"\s(?:\.\.\.|…)$", text) or LIST_HEAD.match(last.rstrip(".")):
        return True
    m = re.search(r"([^\s\"“”„«»(\[]+)\.$", text)
    if m:
        word = m[1].lower().rpartition("'")[2]
        return word in SURE and word not in {"p", "s"} or m[1] in ("M/s", "No", "Nr") or (word in BEFORE_DIGIT and len(word) == 1 and m[1].islower() and word not in {"m", "s"})
    return False


def thai_endings(answers: DataFrame) -> frozenset[str]:
    """Last characters of Thai sentences that others follow, met twice or more and in one of CONTEXTS sentences."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("answer", MARKER_JAVA, " "), r"(?U)\s+", " "))
    parts = answers.filter(F.col("answer").rlike("[฀-๿]")).select(F.split(bare, " ").alias("p")).filter(F.size("p") > 1)
    ends = parts.select(F.explode(F.slice("p", 1, F.size("p") - 1)).alias("s")).filter(F.length("s") > CONTEXT_CHARS).select(F.col("s").substr(F.lit(-CONTEXT_CHARS), F.lit(CONTEXT_CHARS)).alias("e"))
    counted = ends.groupBy("e").count()
    least = counted.agg(F.sum("count")).first()[0] or 0
    return frozenset(r.e for r in counted.filter((F.col("count") > 1) & (F.col("count") * CONTEXTS >= least)).collect())


def judge(question: str | None, answer: str, answerable: bool, endings: frozenset[str]) -> str | None:
    """Defect of an answer that isn't empty; None if it has none."""
    if question and copies(question, answer):
        return "copies_question"
    if (no := refuses(answer, answerable)) is not None:
        return "refusal" if no else None
    bare = MARKER.sub(" ", answer)
    if question and (a := language(bare)) and (q := language(question)) and a != q and (a in ("zh", "hi", "th") or len(bare.split()) > 4):
        return "other_language"
    return "truncated" if truncated(answer, endings) else None


def flag(answers: DataFrame) -> DataFrame:
    """(result_id, defect) of the defective rows of (result_id, question, answer, answerable)."""
    spark = answers.sparkSession
    shared = spark.sparkContext.broadcast(thai_endings(answers.select("answer")))
    empty = answers.filter(is_empty(F.col("answer"))).select("result_id", F.lit("empty").alias("defect"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [judge(q, a, bool(k) if k is not None and k == k else False, shared.value) for q, a, k in zip(pdf.question, pdf.answer, pdf.answerable)]
            out = pd.DataFrame({"result_id": pdf.result_id, "defect": pd.Series(found, dtype=object, index=pdf.index)})
            yield out[out.defect.notna()]

    rest = answers.filter(~is_empty(F.col("answer"))).select("result_id", "question", "answer", "answerable")
    return empty.unionByName(rest.mapInPandas(run, "result_id long, defect string"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers."""
    return flag(read_table(spark, sf_dir, "generation_finetuned")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of defective answers by defect."""
    return p5_found(spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("answers"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLE: dict[str, str] = {}
