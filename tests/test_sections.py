from pyspark.sql import functions as F

from scriptorium.operators import layout, sections

BLOCKS = [
    (1, "Words before any number."), (1, "1. SCOPE 1.1 Where it holds - in all cases. 1.2 Where it doesn't, see Part 2 Imposed loads."), (1, "1.9 Too far to follow"),
    (2, "TABLE 1 FACTORS FOR GUSTS"), (2, "a b c"), (2, "TABLE 9 OUT OF ORDER"), (3, "2. WIND SPEED AND PRESSURE"), (3, "2.1 General"), (4, "2.1.1 Read with an l."), (4, "APPENDIX B DRAG"), (4, "B-1 Bodies"), (4, "B-1.1 Round ones."), (5, "   "), (5, None),
]


def blocks(spark, docs=("d",)):
    return spark.createDataFrame([(d, i, p, t) for d in docs for i, (p, t) in enumerate(BLOCKS)], "doc_id string, ord long, page int, text string")


def test_units_follow_their_numbers(spark):
    units = sections.units_of(blocks(spark, ("d", "e")), offset=-4).orderBy("doc_id", "unit_id").collect()
    one = [u for u in units if u.doc_id == "d"]
    assert [u.unit_key for u in one] == ["Foreword", "Cl. 1", "Cl. 1.1", "Cl. 1.2", "Table 1", "Cl. 2", "Cl. 2.1", "Cl. 2.1.1", "Appendix B", "Cl. B-1", "Cl. B-1.1"]
    assert [u.title for u in one] == ["Foreword", "SCOPE", "Where it holds", "Where it doesn't, see Part 2 Imposed loads.", "FACTORS FOR GUSTS", "WIND SPEED AND PRESSURE", "General", "Read with an l.", "DRAG", "Bodies", "Round ones."]
    assert [u.unit_group for u in one] == ["0", "1", "1", "1", "Table 1", "2", "2", "2", "B", "B", "B"]
    assert [u.mergeable for u in one].count(False) == 1 and one[3].paragraphs[1].text == "1.9 Too far to follow" and one[3].paragraphs[0].printed_page == "5"
    assert [p.text for p in one[4].paragraphs] == ["TABLE 1 FACTORS FOR GUSTS", "a b c", "TABLE 9 OUT OF ORDER"]
    assert [u.unit_key for u in units if u.doc_id == "e"] == [u.unit_key for u in one]
    assert sections.units_of(blocks(spark).limit(0)).count() == 0


def test_passages(spark):
    rows = sections.passages(blocks(spark), "A Standard", replaced=("Table 1",)).orderBy("first_unit", "part_no").collect()
    assert [r.section for r in rows] == ["Foreword", "Cl. 1-1.2", "Cl. 2-2.1.1", "Appendix B to Cl. B-1.1"]
    assert [r.part for r in rows] == ["Foreword", "1. Scope", "2. Wind Speed And Pressure", "Appendices"]
    assert rows[1].chunk_id == "d:cl-1-1-2" and rows[1].covers == ["Cl. 1", "Cl. 1.1", "Cl. 1.2"] and rows[2].pdf_pages == [3, 4]


def test_frames_and_stamps(spark):
    df = spark.createDataFrame([("IS 875 part", 0.0, 500.0, 10.0, 40.0), ("12", 0.0, 20.0, 760.0, 770.0), ("12 m", 0.0, 500.0, 760.0, 770.0), ("stamp", 560.0, 590.0, 300.0, 310.0), ("body", 50.0, 500.0, 300.0, 310.0)], "text string, x0 double, x1 double, y0 double, y1 double").withColumn("height", F.lit(800.0))
    assert [r.text for r in layout.framed(df, "875").collect()] == ["12 m", "stamp", "body"]
    assert [r.text for r in layout.without_stamps(df, 0, 540).collect()] == ["IS 875 part", "12", "12 m", "body"]
    lines = spark.createDataFrame([("……… (A. Judge)",), ("(SIGNED)",), ("Dated: 3 May",), ("The text stays.",)], "text string")
    assert [r.text for r in layout.signatures(lines).collect()] == ["The text stays."]
