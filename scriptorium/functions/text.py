"""Text expressions: cleaning, tokens, numbers, sentences, citations. All run inside codegen; none calls Python."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

# What results depend on.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or shall that the this to was were which with any such than then there these "
    "those under what when where who will would can does do i me my we our you your how"
).split()
NO_SUFFIX = "of in to is as at on or by be an if it no so up we do he me my us am".split()
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18",
    "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100",
}
TOKEN = r"[a-z]-\d+(?:\.\d+)*|\d+(?:\.\d+)*[a-z]{0,2}|[a-z]+"
WORD = r"[a-z0-9]+(?:[.'-][a-z0-9]+)*"
COUNTED = r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"
MARKER = r"(?i)\[\s*S\s*\d+(?:\s*,\s*S?\s*\d+)*\s*\]"
ABBREVIATIONS = "cl cls no nos p pp para paras sec s fig figs art amd vol ch vs viz rs i.e e.g".split()
NOT_FOUND = "This could not be found in the documents."
DASHES = "-−–"
#: Shapes of tokens in a font that wasn't mapped, of rulers, of a question that talks of its prompt, and of list marks before a question.
ODD_SHAPE, RULER = r"[a-z][A-Z]|[;`~@¼½©®ç]|^[a-z]{1,3}-$", r"^[\d\s]{20,}$"
OF_PROMPT = r"(?i)\b(?:the|this|given) (?:passage|excerpt|text)\b"
LIST_MARK = r"(?i)^\s*(?:[-*•]|\d+\s*[.):]|q\d*\s*[.):])\s*"
ANSWER_GAP, LEADING_MARKS = r"(?<=[.!?])\s+|\n+", r"(?s)^((?:\[[^\]]*\][\s.,;:]*)+)(.*)$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a column that a lambda refers to is computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def normalize(text: Column) -> Column:
    """Typographic characters to plain ones, dot leaders to ' ... ', blanks and tabs to one blank, trimmed."""
    t = F.translate(text, "‘’“”–—\u00a0", "''\"\"-- ")
    t = F.replace(F.replace(t, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    t = F.regexp_replace(t, r"\.{4,}|…{2,}", " ... ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def join_lines(lines: Column) -> Column:
    """One string from wrapped lines; a hyphen at a line end goes unless the next word has one of its own."""

    def step(acc: Column, line: Column) -> Column:
        glue = F.endswith(acc, F.lit("-")) & line.rlike(r"^\p{Ll}")
        keeps = F.contains(F.substring_index(line, " ", 1), F.lit("-"))
        return F.when(line == "", acc).when(glue & keeps, F.concat(acc, line)).when(glue, F.concat(acc.substr(F.lit(1), F.length(acc) - 1), line)).when(acc == "", line).otherwise(F.concat(acc, F.lit(" "), line))

    return normalize(F.aggregate(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), F.lit(""), step))


def is_ruler(line: Column) -> Column:
    return line.rlike(RULER)


def looks_broken(line: Column) -> Column:
    """Three in ten or more of the tokens with a letter have an odd shape (a font that wasn't mapped)."""
    tokens = F.filter(F.split(line, r"\s+"), lambda x: x.rlike(r"\p{L}"))
    odd = F.filter(tokens, lambda x: x.rlike(ODD_SHAPE))
    return (F.size(tokens) >= 2) & (F.size(odd) >= 0.3 * F.size(tokens))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def token_count(text: Column) -> Column:
    """Runs of letters, runs of digits and other visible characters; adds up over joins by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTED)), F.lit(0))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def search_tokens(text: Column) -> Column:
    """Search tokens in order, with repeats: a short suffix is glued to its number, stop words are out."""
    glued = F.regexp_replace(F.lower(text), rf"\b(\d+)\s+(?!(?:{'|'.join(NO_SUFFIX)})\b)([a-z]{{1,2}})\b(?=\s|$|[),.;:])", "$1$2")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(glued, F.lit(TOKEN), F.lit(0)), lambda x: ~F.array_contains(stop, x))


def source_numbers(text: Column) -> Column:
    """Numbers of all sources named in brackets, in order."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"(?i)S\s*(\d+)"), F.lit(1)), lambda n: n.cast("int"))))


def without_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, " ")


def numbers_in(text: Column) -> Column:
    """Distinct numbers, written so that equal ones are equal: 1.00 is 1, 1,000 is 1000, twelve is 12; signs play no part."""
    t = F.regexp_replace(text, r"(?<=\d)['’·](?=\d)", ".")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", "")
    t = functools.reduce(lambda acc, kv: F.regexp_replace(acc, rf"(?i)\b{kv[0]}\b", f" {kv[1]} "), NUMBER_WORDS.items(), t)

    def norm(x: Column) -> Column:
        fraction = F.regexp_replace(F.when(F.contains(x, F.lit(".")), F.substring_index(x, ".", -1)).otherwise(""), "0+$", "")
        whole = F.regexp_replace(F.substring_index(x, ".", 1), "^0+(?=.)", "")
        return F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))

    return F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), norm))


def answer_sentences(text: Column) -> Column:
    """Sentences of an answer. Abbreviations end none; markers that open a piece go to the sentence before if that has none."""
    pieces = F.transform(F.split(text, ANSWER_GAP), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lead = LEADING_MARKS
    ends = r"(?i)(?:^|[\s(\[])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.$"
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def last(acc: Column) -> Column:
        return F.element_at(acc, -1)

    def swap(acc: Column, new: Column) -> Column:
        return F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(new))

    def step(acc: Column, piece: Column) -> Column:
        moved = (F.size(acc) > 0) & piece.rlike(lead) & (F.size(source_numbers(last(acc))) == 0)
        before = F.when(moved, swap(acc, F.concat(last(acc), F.lit(" "), trim(F.regexp_extract(piece, lead, 1))))).otherwise(acc)
        rest = F.when(moved, trim(F.regexp_extract(piece, lead, 2))).otherwise(piece)
        merged = (F.size(before) > 0) & last(before).rlike(ends)
        return F.when(rest == "", before).when(merged, swap(before, F.concat(last(before), F.lit(" "), rest))).otherwise(F.concat(before, F.array(rest)))

    return F.aggregate(pieces, F.array().cast("array<string>"), step)


def tidy_answer(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\[\[\]()]", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def snippet(text: Column, most: int = 300) -> Column:
    """At most `most` characters, cut at the last blank, with ' ...' if cut."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^\s+|\s+$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r"\s\S*$", ""), F.lit(" ...")))


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+.!|~$<>-])", r"\\$1")


def is_abstention(answer: Column) -> Column:
    """Whether an answer opens with the not-found phrase, whatever quotes or marks stand before it."""
    return F.startswith(F.lower(F.regexp_replace(answer, r"^[\s\"'*>_`]+", "")), F.lit(NOT_FOUND.rstrip(".").lower()))


def missing_values(answer: Column, required: Column) -> Column:
    """Required values that an answer doesn't state: numbers by value (negative ones with their sign), others as text."""
    text = F.regexp_replace(answer, r"(?i)\[\s*S\s*\d+[^\]]*\]", " ")

    def absent(v: Column, stated: Column) -> Column:
        magnitude = F.regexp_replace(v, rf"^[{DASHES}]\s*", "")
        signed = F.regexp_like(text, F.concat(F.lit(rf"[{DASHES}]\s*\Q"), magnitude, F.lit(r"\E0*(?!\d)")))
        there = F.size(F.array_except(numbers_in(v), stated)) == 0
        number = F.when(v.rlike(rf"^[{DASHES}]"), there & signed).otherwise(there)
        return ~F.when(v.rlike(rf"^[{DASHES}]?\s*\d[\d.,]*$"), number).otherwise(F.contains(F.lower(text), F.lower(v)))

    values = F.transform(required, lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    return let(numbers_in(text), lambda stated: F.filter(values, lambda v: absent(v, stated)))


def squashed(text: Column) -> Column:
    """Lower case with single blanks, for finding quotes."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", ""))


def parsed_questions(reply: Column, most: int = 2, least_words: int = 4) -> Column:
    """Questions of a reply, one per line: list marks and quotes off, distinct, then the first `most`."""
    bare = F.transform(F.split(reply, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, LIST_MARK, ""))
    bare = F.transform(bare, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", ""), r"^\s+|\s+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: F.endswith(x, F.lit("?")) & (word_count(x) >= least_words))), 1, most)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(ws: Column, n: int) -> Column:
    """Runs of n words, joined by blanks; none if there are fewer words."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))


def copies_phrase(question: Column, passage: Column, n: int = 6) -> Column:
    return F.arrays_overlap(let(words(question), lambda w: ngrams(w, n)), let(words(passage), lambda w: ngrams(w, n)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def section_family(section: Column) -> Column:
    return F.regexp_replace(section, r"\s*\(part \d+/\d+\)$", "")


def mentions_prompt(question: Column) -> Column:
    return question.rlike(OF_PROMPT)


def clause_id(text: Column) -> Column:
    """'Clause 10 cc' alone in a text gives '10CC'; NULL for anything else."""
    m = r"(?i)^clause\s+(\d+)\s*([a-z]{0,3})$"
    return F.when(text.rlike(m), F.concat(F.regexp_extract(text, m, 1), F.upper(F.regexp_extract(text, m, 2))))


def clause_key(text: Column) -> Column:
    """'5.3.2' or 'C-2.1' (letters read as 101, 102, ...; l and I as 1) as an array of numbers."""
    letter = F.regexp_extract(text, r"^([A-D])-", 1)
    digits = F.translate(F.regexp_replace(text, r"^[A-D]-", ""), "lI", "11")
    parts = F.transform(F.filter(F.split(digits, r"\."), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))
    return F.when(letter == "", parts).otherwise(F.concat(F.array(F.ascii(letter) - 65 + 101), parts))


def key_label(key: Column) -> Column:
    head = key[0]
    first = F.when(head > 100, F.concat(F.char(head - 101 + 65), F.lit("-"))).otherwise(F.concat(head.cast("string"), F.lit(".")))
    return F.regexp_replace(F.concat(first, F.array_join(F.slice(key, 2, F.greatest(F.size(key) - 1, F.lit(0))), ".")), r"[.-]$", "")


def is_successor(prev: Column, new: Column, gap: int = 2) -> Column:
    """Whether `new` may follow `prev`: its first child, or a later sibling at some depth, at most `gap` further."""
    child = (F.size(new) == F.size(prev) + 1) & (F.slice(new, 1, F.size(prev)) == prev) & (F.try_element_at(new, F.lit(-1)) == 1)

    def sibling(d: Column) -> Column:
        same = F.slice(new, 1, d) == F.slice(prev, 1, d)
        step = F.try_element_at(new, d + 1) - F.try_element_at(prev, d + 1)
        return same & (step >= 1) & (step <= gap)

    return child | ((F.size(new) >= 1) & (F.size(new) <= F.size(prev)) & sibling(F.greatest(F.size(new) - 1, F.lit(0))))
