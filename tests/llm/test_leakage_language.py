import random

import pytest

from scriptorium.llm import language, leakage


def test_automaton_against_brute_force():
    rng = random.Random(1)
    vocab = [chr(97 + i) * 2 for i in range(6)]
    for _ in range(150):
        items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for i in range(6)]
        k = rng.randint(2, 5)
        doc = [rng.choice(vocab) for _ in range(30)]
        got = {i for _, _, held in leakage.ItemAutomaton(items, k).spans(doc) for i in held}
        want = {i for i, t in items if any(f" {' '.join(doc[p : p + k])} " in f" {t} " for p in range(len(doc) - k + 1))}
        assert got == want


def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, "too short")], "item_id long, passage string")
    words = passage.split()
    docs = [
        (1, "before " + passage.upper().replace(" ", " - ") + " after"), (2, " ".join(words[:15])), (3, " ".join(words[4:20])), (4, None), (5, ""),
        (6, " ".join(words[:10]) + " wo-\nrd10 " + " ".join(words[11:16])), (7, " ".join(words[:8]) + " gap " + " ".join(words[8:16])),
    ]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, items).collect()} == {(1, 1), (3, 1), (6, 1)}
    clean = {r.doc_id: (r.text, r.dropped) for r in leakage.decontaminate(d, items).collect()}
    assert clean[2] == (docs[1][1], False) and clean[3] == (None, True) and clean[4] == (None, False)
    kept = leakage.decontaminate(d, items, max_share=1.0).filter("doc_id = 1").first()
    assert kept.text == "before  after" and kept.removed_words == 30
    assert leakage.leaks(d.limit(0), items).count() == 0 and leakage.leaks(d, items.limit(0)).count() == 0


def test_several_automata_find_the_same(spark):
    rng = random.Random(5)
    passages = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(40)) for _ in range(30)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    docs = [(i, "x y " + " ".join(passages[i % 30].split()[5:30]) + " z " + " ".join(passages[(i * 7) % 30].split()[:18])) for i in range(60)] + [(90, None), (91, "nothing")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, leakage.leaks(d, items).collect()))
    assert len(leakage._matchers(spark, items, 16, 100)) > 5
    assert sorted(map(tuple, leakage.leaks(d, items, most=100).collect())) == one and len(one) >= 120
    whole = sorted(map(str, leakage.decontaminate(d, items, max_share=1.0).collect()))
    assert sorted(map(str, leakage.decontaminate(d, items, max_share=1.0, most=100).collect())) == whole


SAMPLES = {
    "en": "the contractor shall pay the employer within thirty days of the notice", "de": "der Auftragnehmer muss die Frist innerhalb von zehn Tagen schriftlich einhalten",
    "fr": "le tribunal a jugé que la pénalité ne pouvait être confondue avec la garantie", "es": "el contratista debe devolver la garantía cuando la obra no se presenta a tiempo",
    "th": "ผู้รับจ้างต้องส่งมอบรายงานการวัดภายในกำหนดหลังจากการตรวจรับได้รับการอนุมัติ", "hi": "ठेकेदार को समय पर भुगतान नहीं किया गया क्योंकि माप पुस्तिका पूरी नहीं हुई थी",
}


def shuffled(text, rng):
    w = text.split()
    rng.shuffle(w)
    return " ".join(w)


def test_code_lengths_match_a_plain_model():
    """The tables give the code length that walking the context trees gives."""
    import math

    rng = random.Random(0)
    data = [language.folded(shuffled(SAMPLES["en"], rng)) for _ in range(4)]
    m = language.Contexts({"en": data, "de": [language.folded(SAMPLES["de"])]})
    seen = {}
    for x in data:
        full = language.PAD + x
        for i in range(language.ORDER, len(full)):
            for k in range(language.ORDER + 1):
                ctx = full[i - k : i]
                seen.setdefault(ctx, {}).setdefault(full[i], 0)
                seen[ctx][full[i]] += 1

    def bits(line):
        full, total = language.PAD + line, 0.0
        for i in range(language.ORDER, len(full)):
            for k in range(language.ORDER, -1, -1):
                table = seen.get(full[i - k : i])
                if table is None:
                    continue
                n, d = sum(table.values()), len(table)
                if full[i] in table:
                    total -= math.log2(table[full[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            else:
                total += 8
        return total

    lines = [data[0], language.folded("the notice of the unknown zebra 12"), b""]
    got = m.score(lines)[:, m.langs.index("en")]
    assert got == pytest.approx([bits(x) for x in lines], rel=1e-4)


def test_labels_and_nulls(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(shuffled(SAMPLES[c], rng) for _ in range(6)), c) for i, c in enumerate(list(SAMPLES) * 12)]
    rows += [(900, shuffled(SAMPLES["fr"], rng) + "\n\n" + shuffled(SAMPLES["en"], rng), " EN-GB "), (901, None, "en"), (902, "", None), (903, shuffled(SAMPLES["es"], rng), "??")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, line_no int")
    lines = language.label_lines(df).collect()
    assert {(r.line_no, r.lang, r.label) for r in lines if r.doc_id == 900} == {(1, "fr", "en"), (2, None, "en"), (3, "en", "en")}
    assert not [r for r in lines if r.doc_id == 901] and [(r.lang, r.confidence) for r in lines if r.doc_id == 902] == [(None, 0.0)]
    assert all(r.lang == rows[r.doc_id][2] for r in lines if r.doc_id < 900) and all(0 <= r.confidence <= 1 for r in lines)
    docs = {r.doc_id: r for r in language.label_documents(df).collect()}
    assert docs[903].lang == "es" and docs[903].label is None and docs[902].lang is None
    empty = df.limit(0)
    assert language.label_lines(empty).count() == 0
    none = language.label_lines(spark.createDataFrame([(1, "some text here", None)], "doc_id long, text string, lang string")).first()
    assert none.lang is None


def test_codes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("EN",), (" eng ",), ("en-IN",), ("English",), ("zh_CN",), ("und",), ("",), (None,), ("??",)], "l string")
    assert [r.c for r in df.select(language.code_of(F.col("l")).alias("c")).collect()] == ["en", "en", "en", "en", "zh", None, None, None, None]
