"""Source markers, empty answers and the language of a short text, shared by the operators on answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: A source marker such as [S1] or [S1, S2].
MARKER_JAVA = r"(?i)\[\s*S\s*\d+(?:\s*[,;]\s*S?\s*\d+)*\s*\]"


def is_empty(answer: Column) -> Column:
    """Null, or no letter and no digit besides source markers."""
    bare = F.regexp_replace(answer, MARKER_JAVA, "")
    return answer.isNull() | ~bare.rlike(r"[\p{L}\p{N}]")


#: Function words. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and is are was were be been to in that which for not any each if when where shall must may has have had by with from this these on at or an as it no yes see under how what why who does do can after before",
    "de": "der die das den dem des und ist sind war wenn nicht nur für von mit auf bei nach im am wird werden wurde muss darf sein eine ein einer dass obwohl warum innerhalb bereits getrennt zu dabei sobald dann schriftlich",
    "fr": "le la les de des du et est sont était été une un que qui ne pas pour dans sur selon avec lorsque quand il il faut tant reste ouvrage délai pouvait être avec alors pourquoi aux au ce malgré lieu n l d y",
    "es": "el la los las de del y es son fue que en no se por para una un según porque ya estaba cuando debe si quién ha antes ninguna puede mientras dure con hasta quede obra al ser",
    "pt": "o a os as de do da dos das e é são foi que em não se por para uma um conforme porque já estava quando deve quem ainda antes nenhuma pode enquanto durar com até fique obra ao cabe há",
    "hi-Latn": "ka ke ki ko se hai hi nahi aur kya agar to par ne mein bhi liye kar karna chahiye baad bina samay din hoga hogi gaya gayi thi tha hui ho yeh iska",
}
KNOWN = {code: frozenset(words.split()) for code, words in FUNCTION_WORDS.items()}
SPOKEN = {word: tuple(code for code, words in KNOWN.items() if word in words) for words in KNOWN.values() for word in words}
SCRIPTS = {"zh": re.compile("[㐀-鿿豈-﫿぀-ヿ]"), "hi": re.compile("[ऀ-ॿ]"), "th": re.compile("[฀-๿]")}
LATIN_WORD, LATIN = re.compile("[a-zà-ÿ]+"), re.compile("[a-zA-ZÀ-ɏ]")


def language(text: str) -> str | None:
    """Code of the language, by script, else by function words; None if it can't be told."""
    if not text.isascii():
        counts = {code: len(found.findall(text)) for code, found in SCRIPTS.items()}
        # A Latin name doesn't make a text Latin: what another script writes in a third of the letters is its own.
        script = max(counts, key=lambda k: counts[k])
        if counts[script] and 2 * counts[script] > len(LATIN.findall(text)):
            return script
    hits = dict.fromkeys(KNOWN, 0)
    for word in LATIN_WORD.findall(text.lower()):
        for code in SPOKEN.get(word, ()):
            hits[code] += 1
    best = max(hits, key=lambda k: hits[k])
    others = max(v for k, v in hits.items() if k != best)
    return best.partition("-")[0] if hits[best] >= 2 and hits[best] > others else None
