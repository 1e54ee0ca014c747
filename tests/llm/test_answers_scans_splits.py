import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import defects, scans, sentences, splits


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("See Fig. 3.2 for it. Next one.", ["See Fig. 3.2 for it.", "Next one."]),
        ("It is 1.8. [S1][S2] Then more [S3].", ["It is 1.8. [S1][S2]", "Then more [S3]."]),
        ('The letter said: "No fee is due. It stands." and he relied on it. End.', ['The letter said: "No fee is due. It stands." and he relied on it.', "End."]),
        ('He noted: "it was done." The rest follows.', ['He noted: "it was done."', "The rest follows."]),
        ("Im Schreiben Nr. 5 hieß es: „Es ruht. Es bleibt.“ und dabei blieb es. Am 3. März kam er.", ["Im Schreiben Nr. 5 hieß es: „Es ruht. Es bleibt.“ und dabei blieb es.", "Am 3. März kam er."]),
        ("来函写道：“不再支付。照常计算。”双方没有异议。差额为1.5万元！[S2]好。", ["来函写道：“不再支付。照常计算。”双方没有异议。", "差额为1.5万元！[S2]", "好。"]),
        ("पहला वाक्य है। दूसरा वाक्य है [S1]।", ["पहला वाक्य है।", "दूसरा वाक्य है [S1]।"]),
        ("ตามข้อ14.10ของสัญญา คณะเห็นว่า [S1] จบ", ["ตามข้อ14.10ของสัญญา", "คณะเห็นว่า [S1]", "จบ"]),
        ("First in full. 2. the second item. (iii) third", ["First in full.", "2. the second item.", "(iii) third"]),
        ("By M/s. X Pvt. Ltd. on 2 May. The maker was X Ltd. The rate covers a, b etc. Done at 4.15 p.m. near it", ["By M/s. X Pvt. Ltd. on 2 May.", "The maker was X Ltd.", "The rate covers a, b etc.", "Done at 4.15 p.m. near it"]),
        ("It found this ... and went on. A\nline break; a colon: no end", ["It found this ... and went on.", "A\nline break; a colon: no end"]),
        ("¿Quién paga? Nadie.", ["¿Quién paga?", "Nadie."]),
        ("Breaks off in the", ["Breaks off in the"]),
        (" \n", []), ("", []),
    ],
)
def test_sentences(text, parts):
    ends, begin, got = sentences.sentence_ends(text), 0, []
    for e in ends:
        got.append(text[begin:e].strip())
        begin = e
    assert got == parts


def test_sentence_ends_cover_any_text():
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from([*"ab. A!?\"“”[S1]\n。ก(", "[S1]", " No. 5"]), max_size=60).map("".join))
    def check(t):
        e = sentences.sentence_ends(t)
        assert e == sorted(set(e)) and (not e or e[-1] == len(t.rstrip(sentences.SPACE))) and bool(e) == bool(t.strip(sentences.SPACE))

    check()


def test_defects(spark):
    q = "Why was the gantry at the depot released on 3 May 2020 although the auditor had insured it?"
    rows = [
        (1, q, None, True, "empty"), (2, q, " — [S1] ...", True, "empty"), (3, q, "You asked: " + q.lower() + " [S2]", True, "copies_question"), (4, q, "Unfortunately, I must decline to answer.", False, "refusal"),
        (5, q, "This could not be found in the documents.", True, "refusal"), (6, q, "This could not be found in the documents.", False, None), (7, q, "Le tribunal a jugé que la pénalité est due. [S1]", True, "other_language"),
        (8, q, "The gantry was released because the", True, "truncated"), (9, q, "The rate is due [S", True, "truncated"), (10, q, "See Annex E [S1]", True, None), (11, q, "The tribunal is unable to release the gantry.", True, None),
        (12, q, 'The letter said: "No fee is due.', True, "truncated"), (13, q, "The gantry was released under Cl.", True, "truncated"), (14, q, "It was released. [S1]", True, None), (15, None, "It was released.", None, None),
        (16, "谁来承担费用？", "承包人应当提交违约金。", True, None), (17, "谁来承担费用？", "The contractor shall pay it to the employer.", True, "other_language"), (18, q, "Sorry conditions on site do not excuse the kerb.", True, None),
    ]
    df = spark.createDataFrame([(a, b, c, d, "x") for a, b, c, d, _ in rows] + [rows[2][:4] + ("x",)], "result_id long, question string, answer string, answerable boolean, defect string")
    got = {(r.result_id, r.defect) for r in defects.flag(df).distinct().collect()}
    assert got == {(r[0], r[4]) for r in rows if r[4]}
    assert defects.flag(df.limit(0)).count() == 0


def test_repair(spark):
    good = ["The contractor shall pay the employer under the measured award of the gantry", "Any pre-stressed beam and the wind-facing tower of the measured gantry stays here"]
    page = "The contractor shall mea-\nPage 3 of 9\nsure the ga\nGENERAL CONDITIONS FOR WORKS\nntry".replace("ga\n", "gantry\n").replace("\nntry", "")
    noisy = [page, "Any pre-\nstressed beam of the ganfry", "one line 12", "para one\n\npara two", None, ""]
    rows = [("chunk", f"g{i}", 0, good[i % 2] + " measure") for i in range(40)] + [("chunk", f"n{i}", 0, t) for i, t in enumerate(noisy)]
    titles = spark.createDataFrame([("gcw", "General Conditions for Works")], "doc_id string, doc_title string")
    df = spark.createDataFrame(rows, "src string, record_id string, para_no int, text string")
    got = {r.record_id: r for r in scans.repair(df, titles).collect()}
    assert got["n0"].paragraphs == ["The contractor shall measure the gantry"] and set(got["n0"].kinds) == {"broken_word", "page_number", "header"}
    assert got["n1"].paragraphs == ["Any pre-stressed beam of the gantry"] and got["n1"].kinds == ["misread"]
    assert got["n2"].kinds == [] and got["n3"].paragraphs == ["para one", "para two"] and got["n4"].paragraphs == [] and got["n5"].paragraphs == [""]
    assert all(got[f"g{i}"].kinds == [] for i in range(40))
    assert scans.repair(df.limit(0), titles.limit(0)).count() == 0


def test_page_numbers_and_labels():
    for s in ("12", "- 12 -", "P a g e  12", "[384]", "Page 3 of 9", "pg. 4", "Page | 7", ". 9 .", "83/173"):
        assert scans.PAGE.fullmatch(s), s
    for s in ("13.5.", "12 mm.", "Table 9", "9(a).", "in 2015"):
        assert not scans.PAGE.fullmatch(s), s
    assert scans.viterbi(["text", "title", "page", "blank", "tail"]) == ["body", "header", "page_number", "break", "body"] and scans.viterbi([]) == []


def components(rows):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for rid, entities in rows:
        find(rid)
        for e in entities:
            parent[find(e)] = find(rid)
    groups = {}
    for rid, _ in rows:
        groups.setdefault(find(rid), set()).add(rid)
    return {(min(g), r) for g in groups.values() for r in g}


def test_groups_equal_union_find(spark):
    rng = random.Random(4)
    raw = []
    for i in range(1, 300):
        c = rng.choice([None, "", "x", f"gcw:v{rng.randint(1, 90)}-cl-1:{rng.randint(1, 4)}", f"GCW / v{rng.randint(1, 90)}_cl_1 / 2"])
        a = rng.choice(["plain", None, f"see agmt AA {rng.randint(1, 60)}/17", f"Agreement No. aa/{rng.randint(1, 60)}/2017 and agreement AB-{rng.randint(1, 9)}-10"])
        raw.append((i, c, a))
    raw += [(1000 + i, "gcw:hot:1", f"agreement ZZ/{i}/10 and agreement ZZ/{i + 1}/10") for i in range(40)] + [raw[0]]
    df = spark.createDataFrame(raw, "record_id long, chunk_id string, query string")
    import re

    def entities(c, q):
        out = set()
        parts = re.findall("[a-z0-9]+", (c or "").lower())
        if len(parts) > 1:
            out.add("s" + "-".join(parts[:-1]))
        out |= {f"a{m[0].lower()}-{int(m[1])}-{m[2][-2:]}" for m in re.findall(r"(?i)(?:agreement|agmt)\W*(?:no\W*)?([A-Z]{2})\W(\d+)\W(\d+)", q or "")}
        return out

    want = components([(i, entities(c, q)) for i, c, q in raw])
    got = splits.group_labels(df)
    assert {(r.group_id, r.record_id) for r in got.collect()} == want
    assert splits.group_labels(df.limit(0)).count() == 0


def test_copies_edited_repeated_and_wrapped():
    q = "Who bears the cost of the formwork if the tribunal upheld the levy during the inspection at the Oakdale Depot on 3 May 2011?"
    for a in (q, q.upper(), q + " " + q, f"{q}\n{q} [S1]", "You asked: " + q, "The question is as follows. " + q, q.replace("upheld", "upholds"), q[:-1]):
        assert defects.copies(q, a), a
    for a in ("The contractor bears the cost.", "Who pays?", "the formwork", "", q.replace("formwork", "gantry").replace("levy", "curing").replace("Oakdale", "Kelso").replace("3 May 2011", "9 June 1998"), "The cost of the formwork is borne by the tribunal if the levy was upheld, and by the employer if it was refused before the inspection. " * 2):
        assert not defects.copies(q, a), a


def test_long_quotations_end_nothing():
    inner = "No levy is due. " * 200
    text = f"The letter said: “{inner.strip()}” and the tribunal relied on it. It agreed."
    assert [text[:e][-9:] for e in sentences.sentence_ends(text)] == ["ed on it.", "t agreed."]
    assert len(sentences.sentence_ends("He wrote “open. It ended.\n\nA new one starts. Here” it is.")) > 2


def test_abbreviations_go_by_the_language_of_the_text():
    assert len(sentences.sentence_ends("Die Frist ist nicht offen und wird ggf. Montag von der Prüfung verlängert.")) == 1
    assert len(sentences.sentence_ends("They were at the bd. It was not in the plan of the board.")) == 2  # one in French only
    assert len(sentences.sentence_ends("Le plan est dans le bd. Nord et il n'est pas sur la carte.")) == 1


def test_agreements_however_written(spark):
    same = ["as in contract BX0417-16?", "CONTRACT BX 417/2016 said", "under bx-417-16, who pays?", "the BX/417/16 rate", "pays BX 417/16 first", "bx417/16", "Agreement Number: bx.0417.16", "agmt. no BX 417 16 applies", "per agreement no. BX-417/16."]
    other = ["contract BX0417-17", "rate of 417.16 lakh", "pages p12-16 and pp417-16a", "on 4/17/2016", "drops to 417.16", "clause 4.17 of 2016", "BX 417", "of 417/16", "AA-417-16"]
    rows = [(i, None, q) for i, q in enumerate(same)] + [(100 + i, None, q) for i, q in enumerate(other)]
    got = {r.record_id: r.group_id for r in splits.group_labels(spark.createDataFrame(rows, "record_id long, chunk_id string, query string")).collect()}
    assert [got[i] for i in range(len(same))] == [0] * len(same)
    assert [got[100 + i] for i in range(len(other))] == [100 + i for i in range(len(other))]


def test_small_strata_are_dealt_too(spark):
    rows = [(i, i // 2, f"s{i % 40}" if i >= 2000 else "big") for i in range(6000)]
    got = splits.assign(spark.createDataFrame(rows, "record_id long, group_id long, stratum string"), strata=1).collect()
    assert len(got) == 6000 and len({(r.group_id, r.split) for r in got}) == 3000
    for names in (["big"], [f"s{k}" for k in range(40)]):
        part = [r.split for r in got if r.stratum in names]
        assert abs(part.count("train") / len(part) - 0.8) < 0.03 and abs(part.count("test") / len(part) - 0.1) < 0.03
    one = [r.split for r in got if r.stratum == "s7"]
    assert 0.6 < one.count("train") / len(one) < 0.95


def test_long_chain(spark):
    rows = [(i, None, f"agreement AA/{i}/10 and agreement AA/{i + 1}/10") for i in range(1, 60)]
    got = splits.group_labels(spark.createDataFrame(rows, "record_id long, chunk_id string, query string")).select("group_id").distinct().collect()
    assert [r.group_id for r in got] == [1]


def test_very_long_chains(spark):
    n = 400
    places = list(range(1, n + 1))
    turned = sorted(places, key=lambda i: (i != n, abs(i - n // 2)))  # the smallest number stands at the end, the next ones in the middle
    shuffled = random.Random(5).sample(places, n)
    rows = []
    for k, order in enumerate((places, turned, shuffled)):
        number = {place: 1000 * (k + 1) + at for at, place in enumerate(order)}
        rows += [(number[i], None, f"agreement A{'ABC'[k]}/{i}/10 and agreement A{'ABC'[k]}/{i + 1}/10") for i in places]
    df = spark.createDataFrame([*rows, (1, "gcw:alone:1", None), (2, None, None)], "record_id long, chunk_id string, query string")
    got = {(r.group_id, r.record_id) for r in splits.group_labels(df).collect()}
    assert got == {(r[0] // 1000 * 1000, r[0]) for r in rows} | {(1, 1), (2, 2)}
    assert {(r.group_id, r.record_id) for r in splits.groups_of_two(splits.group_labels(df)).collect()} == {(r[0] // 1000 * 1000, r[0]) for r in rows}


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 700) if i > 200 else 5000 + i // 100, rng.choice("abc")) for i in range(4000)]
    df = spark.createDataFrame(rows, "record_id long, group_id long, stratum string").withColumn("stratum", F.when(F.col("record_id") % 50 == 0, None).otherwise(F.col("stratum")))
    got = splits.assign(df).collect()
    assert len(got) == 4000
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(r.split == s for r in got) / 4000 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["validation"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02


def test_line_model_is_fitted_and_keeps_its_states():
    texts = [["text", "page", "title", "text", "blank", "text"], ["text", "caps", "text", "tail"]] * 300
    seen, step = scans.fit_lines(texts)
    for row in (*seen.values(), *step.values()):
        assert abs(sum(math.exp(w) for w in row) - 1) < 1e-9
    assert scans.viterbi(["text", "page", "title", "text", "blank", "text"], (seen, step)) == ["body", "page_number", "header", "body", "break", "body"]
    assert scans.fit_lines([])[0]["body"] != scans.fit_lines(texts)[0]["body"]


def test_rare_words_are_no_errors():
    reader = scans.Reader({"burn": 900, "mortar": 50}, [], least=100)
    assert reader.correct("bum") is None and reader.correct("b0rn") is None  # as frequent as any word that isn't listed
    assert scans.Reader({"mortar": 900}, [], least=100).correct("m0rtar") == "mortar"
    assert scans.Reader({"mortar": 700}, [], least=100).correct("mortaf") is None


def test_rare_words_count_in_a_large_corpus(spark):
    """Beyond a million words a word that occurs once is still known."""
    texts = spark.range(2600).select(F.concat(F.lit("girder " ), F.lit("the beam carries load " * 100)).alias("text")).unionByName(spark.createDataFrame([("a lonely parapet",)], "text string"))
    assert dict(scans.lexicon(texts))["parapet"] == 1


def test_line_model_is_fitted_on_all_texts(spark):
    texts = ["Works\nbody of a text that goes on for long enough here.\n- 4 -"] * 2500 + ["one line of text that is long enough by itself"] * 500
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    own = scans.Reader({}, [("w", "Works")])
    want = scans.fit_lines([own.looks(t.split("\n")) for t in texts])
    got = scans.fit_corpus(df, spark.sparkContext.broadcast(({}, [("w", "Works")])))
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for s in w for a, b in zip(g[s], w[s]))
