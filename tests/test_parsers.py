from pyspark.sql import functions as F

from scriptorium.operators import parsers

SCHEMA = "doc_id string, ord long, page int, x0 double, y0 double, x1 double, y1 double, text string"


def blocks(spark, rows):
    return spark.createDataFrame([("d", i, p, float(x0), float(y0), float(x1), float(y0 + 12), t) for i, (p, x0, x1, y0, t) in enumerate(rows)], SCHEMA)


def test_judgment(spark):
    rows = [
        (1, 99, 400, 50, "IN THE COURT"), (1, 20, 60, 300, "signed by"), (1, 99, 400, 82, "Civil appeal no. 9"), (1, 99, 120, 150, "1."), (1, 99, 400, 182, "The first para-"), (1, 99, 400, 214, "graph goes here."),
        (1, 150, 400, 260, "2."), (1, 150, 400, 292, "A quoted paragraph."), (1, 300, 320, 770, "1"), (2, 99, 400, 50, "Notions of Justice"), (2, 99, 120, 100, "2."), (2, 99, 400, 132, "The second one."), (2, 99, 120, 200, "5."), (2, 99, 400, 300, "………J."),
    ]
    look = parsers.Judgment("A v B", "Judgment")
    units = parsers.judgment_units(blocks(spark, rows), look).orderBy("unit_id").collect()
    assert [(u.unit_key, u.unit_group, u.mergeable) for u in units] == [("Case details", "case-details", False), ("1", "", True), ("2", "Notions of Justice", True)]
    assert [p.text for p in units[1].paragraphs] == ["The first paragraph goes here.", "2. A quoted paragraph."] and [p.text for p in units[2].paragraphs][0] == "The second one."
    got = parsers.judgment_passages(blocks(spark, rows), look).orderBy("first_unit").collect()
    assert [(r.section, r.chunk_id, r.covers) for r in got] == [("Case details", "d:case-details", []), ("¶ 1", "d:p-1", ["¶ 1"]), ("¶ 2", "d:p-2", ["¶ 2"])]
    assert got[2].title == "Notions of Justice" and got[1].pdf_pages == [1] and parsers.judgment_passages(blocks(spark, rows).limit(0), look).count() == 0


LOOK = parsers.Contract("Conditions", "Clauses of Contract", {"CLAUSES OF CONTRACT": "Clauses of Contract", "SAFETY CODE": "The Safety Code"}, ("Clauses of Contract",), footer="Excellence")


def test_contract(spark):
    rows = [
        (3, 200, 400, 40, "CLAUSES OF CONTRACT"), (3, 120, 500, 100, "Clause 10 cc\nThe rate is paid."), (3, 60, 150, 140, "Rate"), (3, 120, 500, 160, "It stays so."), (3, 60, 150, 200, "Advance"), (3, 120, 500, 220, "An advance is due."),
        (3, 200, 400, 780, "41\nEngineering Excellence"), (4, 120, 500, 100, "Clause 11\nWork ends."), (5, 200, 400, 40, "SAFETY CODE"), (5, 120, 500, 90, "SAFETY CODE"), (5, 120, 500, 100, "1. Ladders stand firm."), (5, 120, 500, 120, "GUARD RAILS"), (5, 120, 500, 140, "12345 12345 12345 12345"), (6, 120, 500, 100, "2. rails are high. " + "word " * 90),
    ]
    items = parsers.contract_items(blocks(spark, rows), LOOK).orderBy("ord").collect()
    assert [(r.kind, r.clause, r.part, r.printed) for r in items][:2] == [("body", "10CC", "Clauses of Contract", "41"), ("heading", None, "Clauses of Contract", "41")] and len(items) == 10
    got = parsers.contract_passages(blocks(spark, rows), LOOK, 25).orderBy("key", "part_no").collect()
    assert [(r.section, r.title) for r in got][:2] == [("Clause 10CC", "Rate"), ("Clause 11", "")]
    assert got[0].text == "The rate is paid.\nIt stays so.\n[Advance]\nAn advance is due." and got[0].chunk_id == "d:clause-10cc:1"
    assert got[2].section == "The Safety Code, item 1" and got[2].text == "1. Ladders stand firm.\n[GUARD RAILS]" and got[2].chunk_id == "d:the-safety-code:p5-1"
    assert [r.section for r in got[3:]] == ["The Safety Code, item 2"] + ["The Safety Code, item 2 (cont.)"] * 2
    both = parsers.corpus(*(parsers.contract_passages(blocks(spark, rows).withColumn("doc_id", F.lit(d)), LOOK, 25) for d in "ba"))
    assert [(r.pos, r.doc_id) for r in both.orderBy("pos").collect()] == [(k + 1, "a" if k < len(got) else "b") for k in range(2 * len(got))]


def test_item_numbers(spark):
    windows = [["intro", "1. a", "2. b"], ["still b", "1. nested", "3. c"], ["x"], ["[2. NEW LIST]", "3. d"], ["Article 1 of it"]]
    row = spark.createDataFrame([(windows,)], "w array<array<string>>").select(parsers.item_labels(F.col("w")).alias("x")).first().x
    assert [(r.first, r.last, r.n) for r in row] == [("1", "2", 2), ("2", "3", 2), ("3", "3 (cont.)", 1), ("2", "3", 2), ("1", "1", 1)]
