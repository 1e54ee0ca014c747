import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import curated, layout, pack
from scriptorium.operators.ordered import Ordered
from scriptorium.sources import model, records
from scriptorium.streaming import resume


UNIT = "unit_id long, doc_id string, unit_key string, unit_group string, title string, paragraphs array<struct<text:string,pdf_page:int,printed_page:string>>, mergeable boolean"


def size(text):
    import re

    return len(re.findall(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]", text or ""))


def test_pack_invariants(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta 12", "Gamma; Delta", "end. Next", "x" * 30]
    rows = []
    for i in range(120):
        paragraphs = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 8, 20, 40, 90]))) for _ in range(rng.randint(0, 6))]
        rows.append((i, f"d{i % 7}", str(i), "g" if rng.random() < 0.8 else None, rng.choice(["", "t", None]), [(t, 1, "1") for t in paragraphs], rng.random() < 0.8))
    got = pack.windows_of(spark.createDataFrame(rows, UNIT), 40, 10).orderBy("doc_id", "first_unit", "part_no").collect()
    for d in range(7):
        ours = " ".join(p.text for w in got if w.doc_id == f"d{d}" for p in w.paragraphs).split()
        assert ours == " ".join(t[0] for r in rows if r[1] == f"d{d}" for t in r[5]).split()
    assert all(sum(size(p.text) for p in w.paragraphs) <= 40 + 10 + 9 for w in got)
    assert all(w.part_no <= w.part_count for w in got) and max(w.part_count for w in got) > 3


def test_group_units(spark):
    p = lambda n: [("word " * n, 1, "1")]
    units = [("1", "a", p(10), True), ("2", "b", p(10), True), ("3", "c", p(10), False), ("4", "d", [], True), ("5", "e", p(100), True), ("6", "f", p(5), True), ("7", "g", p(5), True), ("7", "h", p(5), False)]
    df = spark.createDataFrame([(i, "d", k, "x", t, ps, m) for i, (k, t, ps, m) in enumerate(units)], UNIT)
    got = [(r.first_unit, r["keys"], r.title, r.part_no, r.part_count) for r in pack.windows_of(df, 40, 12).orderBy("first_unit", "part_no").collect()]
    assert got == [(0, ["1", "2"], "a", 1, 1), (2, ["3", "5"], "c", 1, 3), (4, ["5"], "e", 2, 3), (4, ["5"], "e", 3, 3), (5, ["6", "7"], "f", 1, 1), (7, ["7"], "h", 1, 1)]


def test_ordered_scans_equal_plain_windows(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    o = Ordered.of(spark.createDataFrame(rows, "doc string, ord long, v int"), ["doc"], ["ord"])
    got = {r.ord: r for r in o.previous("v", "ord").running(F.coalesce("v", F.lit(0)), "total").filled(F.col("v"), "last").islands(F.col("v") == 1, "run").done().collect()}
    state = {}
    for doc, i, v in rows:
        before, total, last, run = state.get(doc, ((None, None), 0, None, 0))
        total, last, run = total + (v or 0), v if v is not None else last, run + (doc not in state or v == 1)
        r = got[i]
        assert (r.previous_v, r.previous_ord, r.total, r["last"], r.run, r.is_first) == (*before, total, last, run, doc not in state)
        state[doc] = ((v, i), total, last, run)
    assert Ordered.of(spark.createDataFrame(rows, "doc string, ord long, v int").limit(0), ["doc"], ["ord"]).previous("v").done().count() == 0


def test_windows_of(spark):
    para = lambda n: [("word " * n, 1, "1")]
    rows = [(1, "d", "1", "g", "t", para(10), True), (1, "d", "1", "g", "t", para(10), True), (2, "d", "2", "g", "t", para(10), True), (3, "d", "3", "h", "t", para(10), True), (4, "d", "4", "h", None, None, None)]
    u = spark.createDataFrame(rows, "unit_id long, doc_id string, unit_key string, unit_group string, title string, paragraphs array<struct<text:string,pdf_page:int,printed_page:string>>, mergeable boolean")
    assert sorted(tuple(r.keys) for r in pack.windows_of(u).collect()) == [("1", "2"), ("3",)]
    assert pack.windows_of(u.limit(0)).count() == 0


def test_layout(spark):
    df = spark.createDataFrame([("d", 1, "A"), ("d", 2, ""), ("d", 3, None), ("d", 4, "B"), ("e", 1, None)], "doc_id string, ord long, part string")
    got = [r.part_filled for r in layout.forward_fill(df, "part", ["doc_id"], "ord").orderBy("doc_id", "ord").collect()]
    assert got == ["A", "A", "A", "B", None]
    b = spark.createDataFrame([("d", 1, 1, 10.0, 100.0, "1. One"), ("d", 2, 1, 10.0, 110.0, "more"), ("d", 3, 1, 10.0, 200.0, "far"), ("d", 4, 2, 10.0, 100.0, "page"), ("d", 5, 2, 40.0, 110.0, "indent")], "doc_id string, ord long, page int, x0 double, y0 double, text string")
    assert [r.grp for r in layout.line_groups(b).orderBy("ord").collect()] == [1, 1, 2, 3, 4]
    cols = spark.createDataFrame([("d", 1, 10.0, 10.0, "l1"), ("d", 1, 400.0, 5.0, "r1"), ("d", 1, 10.0, 50.0, "TABLE 1"), ("d", 1, 400.0, 60.0, "r2"), ("d", 1, 10.0, 70.0, "l2")], "doc_id string, page int, x0 double, y0 double, text string")
    assert [r.text for r in layout.reading_order(cols).orderBy("ord").collect()] == ["l1", "r1", "TABLE 1", "l2", "r2"]
    noise = spark.createDataFrame([("h", 10.0, 20.0), ("ok text", 100.0, 110.0), ("12345 12345 12345 12345", 200.0, 210.0), (" ", 300.0, 310.0), ("foot", 770.0, 780.0)], "text string, y0 double, y1 double")
    assert [r.text for r in layout.noise_free(noise).collect()] == ["ok text"]


def test_numbering(spark):
    n = spark.createDataFrame([(["1. a", "b", "3. c", "2. d", "3. e"],)], "p array<string>").select(layout.sequential_numbers(F.col("p")).alias("n")).first().n
    assert n == [1, None, None, 2, 3]
    lines = [("d", i, t) for i, t in enumerate(["1. SCOPE of it", "1.1 First", "2 Not dotted", "1.5 Too far", "1.2 Second", "2. WIND loads", "l Bad"])]
    got = layout.clause_segments(spark.createDataFrame(lines, "doc_id string, ord long, text string")).orderBy("ord").collect()
    assert [r.starts for r in got] == ["1", "1.1", "1.2", "2"]


def test_html_blocks(spark):
    df = spark.createDataFrame([("d", "<title>T</title><p>One <b>two</b></p><ul><li>x<li>y</ul><p> </p>"), ("e", None)], "doc_id string, html string")
    assert [(r.kind, r.text) for r in layout.html_blocks(df).orderBy("ord").collect()][:2] == [("title", "T"), ("p", "One two")]


def test_curated(spark):
    df = spark.createDataFrame([("Madras and Madras [now Chennai]",), ("none",)], "t string")
    got = [r.a for r in df.select(curated.annotate(F.col("t"), {"Madras": "Chennai"}, "note").alias("a")).collect()]
    assert got == ["Madras [now Chennai] and Madras [now Chennai]\nnote", "none"]
    t = spark.createDataFrame([("Table 2", "K", None, "head", [("a", "1"), ("b", "2")], ""), ("Table 3", "L", "whole", None, None, None)], "section string, title string, text string, header string, parts array<struct<label:string,text:string>>, footer string")
    assert sorted(tuple(r) for r in curated.table_parts(t).collect()) == [("Table 2 (part 1/2)", "K (a)", "head\n\n1", "Table 2"), ("Table 2 (part 2/2)", "K (b)", "head\n\n2", "Table 2"), ("Table 3", "L", "whole", "")]
    a = spark.createDataFrame([(1, "May 2000", [9], [(["Cl. 1"], "new", "why"), ([], "all", None)])], curated.AMENDMENTS)
    got = curated.amendment_items(a, "doc", "The Code").orderBy("section").collect()
    assert got[0].text == "Amendment No. 1 (May 2000) to The Code. new [Curator's explanation: why]" and got[0].chunk_id == "doc:amd1:item-1" and got[0].title == "Amendment No. 1 (May 2000) - amends Cl. 1"
    assert got[1].amends == [] and got[1].title.endswith("all clauses") and got[1].text.endswith("The Code. all")
    c = spark.createDataFrame([(1, ["Cl. 5"], "has sign here"), (2, ["Cl. 5"], "no")], "pos long, covers array<string>, text string")
    p = spark.createDataFrame([("Fig. 9", "Cl. 5", "sign")], "provision string, host string, signature string")
    assert curated.absorb(c, p).filter("array_contains(covers, 'Fig. 9')").select("pos").first().pos == 1
    with pytest.raises(ValueError):
        curated.absorb(c, p.withColumn("signature", F.lit("absent")))


def test_curated_files_become_passages(spark, tmp_path):
    (tmp_path / "curated.yaml").write_text("""
tables:
  - {section: Table 2, title: Factors, part: Tables, pdf_pages: [7], printed_pages: ['3'], header: head, footer: foot, parts: [{label: a, text: 'Madras 50'}, {label: b, text: two}]}
  - {section: Appendix A, title: Speeds, pdf_pages: [8], printed_pages: ['4'], covers: [Appendix A, Fig. 1], text: ' Madras 50 '}
amendments:
  - {number: 2, date: May 1998, pdf_pages: [64], items: [{amends: [Table 2], text: 'Substitute it.', explanation: It changes.}]}
""")
    rows = {r.section: r for r in records.read_curated(spark, str(tmp_path), "d", "The Code").collect()}
    assert rows["Appendix A"].text == "Madras 50" and rows["Appendix A"].covers == ["Appendix A", "Fig. 1"] and rows["Table 2 (part 1/2)"].text == "head\n\nMadras 50\n\nfoot"
    assert rows["Table 2 (part 2/2)"].parent == "Table 2" and rows["Table 2 (part 2/2)"].covers == ["Table 2"] and rows["Amendment No. 2, item 1"].is_amendment
    (tmp_path / "aliases.yaml").write_text("{apply_to: [Appendix A], legend: note, aliases: {Madras: Chennai}}")
    rows = {r.section: r.text for r in records.read_curated(spark, str(tmp_path), "d", "The Code").collect()}
    assert rows["Appendix A"] == "Madras [now Chennai] 50\nnote" and "now" not in rows["Table 2 (part 1/2)"]
    (tmp_path / "aliases.yaml").write_text("{apply_to: [Appendix Z]}")
    with pytest.raises(ValueError, match="Appendix Z"):
        records.read_curated(spark, str(tmp_path), "d", "The Code")


def test_jsonl(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    row = {"id": "g", "question": "q", "doc": "gcw", "question_type": "fact", "wording": "natural", "answer": "a"}
    path.write_text(json.dumps(row) + "\n\n")
    assert records.read_gold(spark, str(path)).first().answerable is True
    path.write_text(json.dumps(row) + "\n{broken\n")
    with pytest.raises(Exception, match="malformed record"):
        records.read_gold(spark, str(path)).collect()
    path.write_text(json.dumps({"id": "g"}) + "\n")
    with pytest.raises(Exception, match="malformed record"):
        records.read_gold(spark, str(path)).collect()
    assert records.read_jsonl(spark, str(tmp_path / "none"), records.PAIR, missing_ok=True).count() == 0
    records.write_jsonl(spark.createDataFrame([("q", "c", "n")], records.PAIR), str(tmp_path / "p"), "query")
    assert records.read_jsonl(spark, str(tmp_path / "p"), records.PAIR).first().negative_id == "n"


def test_index_and_snapshots(spark, tmp_path):
    fp = lambda x: spark.createDataFrame([(x,)], "fingerprint string")
    v = model.embed(spark.createDataFrame([(1, "a b"), (2, None)], "pos long, text string"), "pos", "text", model.HashingEmbedder(8))
    records.write_index(v, fp("x"), str(tmp_path / "i"), "hash")
    assert records.read_index(spark, str(tmp_path / "i"), fp("x")).count() == 2
    with pytest.raises(ValueError):
        records.read_index(spark, str(tmp_path / "i"), fp("y"))
    for version in ("1", "2"):
        records.write_snapshot(spark.createDataFrame([(version,)], "v string"), str(tmp_path / "s"), version)
    assert records.read_snapshot(spark, str(tmp_path / "s"), "1").first().v == "1"


def test_chat_model(spark):
    sent = []

    def send(url, body, timeout):
        sent.append((url, body, timeout))
        return {"models": [{"name": "m:3b"}]} if url.endswith("tags") else {"message": {"content": "hi"}}

    m = model.ChatModel("http://x/", "m", send)
    assert m.available() and m.complete("s", "p") == "hi" and sent[1][1]["options"]["temperature"] == 0
    assert not model.ChatModel("http://x", "other", send).available()
    with pytest.raises(model.ModelError):
        model.ChatModel("http://x", "m", lambda *a: {}).complete("s", "p")
    with pytest.raises(ValueError):
        model.model_of("nothing")


def test_resume_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"chunk_id": c, "text": "t"}) for c in ("c1", "c2")))

    def reply(df):
        return df.select("chunk_id", F.lit("1. What is this all about?").alias("reply"), F.when(F.col("chunk_id") == "c2", "down").alias("error"))

    for _ in range(2):
        resume.follow(spark, str(src), str(tmp_path / "log"), str(tmp_path / "cp"), reply).awaitTermination()
    log = records.read_jsonl(spark, str(tmp_path / "log"), records.CANDIDATE)
    assert sorted((r.chunk_id, r.error) for r in log.collect()) == [("c1", None), ("c2", "down")]
    assert [r.chunk_id for r in resume.pending(spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chunk_id string"), log).orderBy("chunk_id").collect()] == ["c2", "c3"]
