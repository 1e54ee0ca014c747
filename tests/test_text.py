import re

from pyspark.sql import functions as F

from scriptorium.functions import labels, text as tx


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_search_tokens(spark):
    t = lambda s: one(spark, s, tx.search_tokens)
    assert t("Clause 10 CC applies") == ["clause", "10cc", "applies"]
    assert t("Section 34 of Tables 2 to 5") == ["section", "34", "tables", "2", "5"]
    assert t("c-2.1 and 6.2.2.8 tax tax") == ["c-2.1", "6.2.2.8", "tax", "tax"]
    assert t("") == []
    assert t(None) is None


def test_numbers(spark):
    n = lambda s: sorted(one(spark, s, tx.numbers_in))
    assert n("0'6 and 1.00 and 1,000 and twelve months") == ["0.6", "1", "1000", "12"]
    assert n("-0.80, 007, 1,234,567") == ["0.8", "1234567", "7"]
    assert n("none") == []


def test_answer_sentences(spark):
    s = lambda x: one(spark, x, tx.answer_sentences)
    assert s("See Cl. 5.3 for it. Next one.") == ["See Cl. 5.3 for it.", "Next one."]
    assert s("It is 1.8. [S2] Then more.") == ["It is 1.8. [S2]", "Then more."]
    assert s("It is 1.8 [S1]. [S2] Then more.") == ["It is 1.8 [S1].", "[S2] Then more."]
    assert s("") == []


def test_markers_and_abstention(spark):
    assert one(spark, "a [S1][S3, s4] b [x]", tx.source_numbers) == [1, 3, 4]
    assert one(spark, '> "This could not be found in the documents', tx.is_abstention)
    assert not one(spark, "The limit could not be found", tx.is_abstention)


def test_missing_values(spark):
    def missing(answer, required):
        df = spark.createDataFrame([(answer, required)], "a string, r array<string>")
        return df.select(tx.missing_values(F.col("a"), F.col("r")).alias("m")).first().m

    assert missing("It is twelve months [S1]", ["12"]) == []
    assert missing("It is 5 [S1]", ["1"]) == ["1"]
    assert missing("Cp is −0.80", ["-0.8"]) == []
    assert missing("Cp is 0.8", ["-0.8"]) == ["-0.8"]
    assert missing("Cp is -0.85", ["-0.8"]) == ["-0.8"]
    assert missing("the Employer pays", ["employer", "tenant"]) == ["tenant"]


def test_cleaning(spark):
    assert one(spark, " “a” ﬁx ..... b\t c ", tx.normalize) == '"a" fix ... b c'
    j = lambda lines: one(spark, lines, tx.join_lines, "array<string>")
    assert j(["construc-", "tion of", "Engineer-", "in-Charge"]) == "construction of Engineer-in-Charge"
    assert j(["", "a", "", "b"]) == "a b"
    assert one(spark, "12345 67890 12345 67890", tx.is_ruler)
    assert one(spark, "ds- yks- fu- fo-", tx.looks_broken)
    assert one(spark, "a b  c", tx.word_count) == 3
    assert one(spark, None, tx.token_count) == 0


def test_token_count_adds_up_over_blanks(spark):
    from hypothesis import HealthCheck, given, settings, strategies as st

    rx = re.compile(tx.COUNTED)

    @settings(max_examples=100, suppress_health_check=list(HealthCheck))
    @given(st.text(), st.text())
    def check(a, b):
        assert len(rx.findall(f"{a} {b}")) == len(rx.findall(a)) + len(rx.findall(b))

    check()


def test_questions(spark):
    reply = "1. What does the clause say?\n2) \"What does the clause say?\"\n- Why is it so late?\nNo.\nWho pays for all of this?"
    assert one(spark, reply, tx.parsed_questions) == ["What does the clause say?", "Why is it so late?"]


def test_copied_phrase(spark):
    df = spark.createDataFrame([("one two three four five six seven", "zero one two three four five six"), ("one two", "one two"), ("", "")], "q string, p string")
    assert [r.c for r in df.select(tx.copies_phrase(F.col("q"), F.col("p")).alias("c")).collect()] == [True, False, False]


def test_clause_keys(spark):
    assert one(spark, "Clause 10 cc", tx.clause_id) == "10CC"
    assert one(spark, "Clauses", tx.clause_id) is None
    assert one(spark, "C-2.l", tx.clause_key) == [103, 2, 1]
    df = spark.createDataFrame([([5, 3], [5, 3, 1], True), ([5, 3, 2], [5, 4], True), ([5, 3], [5, 6], False), ([5, 3], [6], True), ([5], [4], False)], "a array<int>, b array<int>, w boolean")
    assert all(r.g == r.w for r in df.select("w", tx.is_successor(F.col("a"), F.col("b")).alias("g")).collect())


def test_labels(spark):
    rows = [("D", "P", "S (part 1/2)", "T", "x", [3, 3, 4], ["1", "1", "2"]), ("D", "", "S", "", "x", [3], []), ("D", None, "S", None, None, [7], ["7"])]
    df = spark.createDataFrame(rows, "doc_title string, part string, section string, title string, text string, pdf_pages array<int>, printed_pages array<string>")
    got = df.select(labels.breadcrumb().alias("b"), labels.page_label().alias("p"), labels.index_text().alias("t")).collect()
    assert [r.b for r in got] == ["D > P > S (part 1/2) - T", "D > S", "D > S"]
    assert [r.p for r in got] == ["pp. 1-2 (PDF 3-4)", "PDF p. 3", "p. 7"]
    assert got[2].t == "D > S\n"
    r = spark.range(1).select(labels.rate(F.lit(1), F.lit(8)).alias("a"), labels.rate(F.lit(0), F.lit(0)).alias("b"), labels.duration(F.lit(125.7)).alias("c")).first()
    assert (r.a, r.b, r.c) == ("1/8 (12%)", "-", "2m05s")
