import os

import pytest
from pyspark.sql import functions as F

from scriptorium import evaluate_cli
from scriptorium.operators import reports, runs

needs_tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


def run(spark, rows):
    """(qid, type, hybrid rank, fully supported)"""
    return spark.createDataFrame([(q, "gcw", t, "natural", t != "unanswerable", (h, 1, None), ["full"], ["full"] if full else [], [("full", 6)], 0.5 + i / 10) for i, (q, t, h, full) in enumerate(rows)], runs.RUN)


BASE = [("a", "fact", 1, True), ("b", "fact", None, True), ("c", "amendment", 7, True), ("d", "fact", 2, True), ("x", "unanswerable", None, False)]


def test_verdict(spark):
    base = run(spark, BASE)
    better = run(spark, [("a", "fact", 1, True), ("b", "fact", 9, True), ("c", "amendment", 3, True), ("d", "fact", 3, True), ("x", "unanswerable", None, False)])
    both = runs.compared(base, better)
    assert tuple(runs.verdict(both).first()) == (2, 1, 1, 0, True)
    assert {r.qid: r.outcome for r in runs.outcomes(both).collect()} == {"a": "tie", "b": "win", "c": "win", "d": "loss"}
    broken = runs.verdict(runs.compared(base, run(spark, [*BASE[:2], ("c", "amendment", 1, False), *BASE[3:]]))).first()
    assert (broken.wins, broken.broken, broken.ships) == (1, 1, False)
    for other in (BASE[1:], [*BASE, ("e", "fact", 1, True)]):
        with pytest.raises(ValueError):
            runs.compared(base, run(spark, other))
    runs.compared(base, run(spark, BASE[:4]))  # questions without an answer play no part


def test_runs_are_read_as_written(spark, tmp_path):
    base = run(spark, BASE)
    runs.write_run(base, str(tmp_path), "base")
    assert sorted(map(str, runs.read_run(spark, str(tmp_path), "base").collect())) == sorted(map(str, base.collect()))
    text = reports.text(reports.retrieval_report(base, "base"))
    assert "| hybrid | 1/4 (25%) | 2/4 (50%) | 3/4 (75%) | 0.411 |" in text and "| full | 4/4 (100%) | 4/4 (100%) | 6.0 |" in text and "| b | natural | >60 | 1 | >60 | yes | yes |" in text
    text = reports.text(reports.comparison_report(base, base, "base", "new"))
    assert "fixed 0, broke 0, same 4" in text and "**keep base**" in text
    assert "| hybrid | 0" not in reports.text(reports.retrieval_report(base.limit(0), "none"))


def test_sheet_and_pages(spark):
    df = spark.createDataFrame([([2, 9], [1, 2, 3], ["i", "ii", "iii"]), ([2], [1, 2], ["i"])], "p array<int>, pdf array<int>, printed array<string>")
    assert [r.x for r in df.select(reports.printed_pages(F.col("p"), F.col("pdf"), F.col("printed")).alias("x")).collect()] == [["ii"], ["i"]]
    gold = spark.createDataFrame([("g1", "Q?", "fact", "natural", "A", ["5"], [("c", "s", [2], "the quote"), ("gone", "t", [1], "q2")], None)], "id string, question string, question_type string, wording string, answer string, must_include array<string>, evidence array<struct<chunk_id:string,section:string,pdf_pages:array<int>,quote:string>>, note string")
    chunks = spark.createDataFrame([("c", "Doc", [1, 2], ["7", "8"])], "chunk_id string, doc_title string, pdf_pages array<int>, printed_pages array<string>")
    text = reports.text(reports.checking_sheet(gold, chunks))
    assert "- **Look at:** Doc, s, PDF p. 2 (printed p. 8)\n  > the quote\n- **Look at:** ?, t, PDF p. 1\n  > q2" in text and "**Must state:** 5" in text and "Why" not in text


@needs_tables
def test_evaluation_cli(spark, sf, tmp_path):
    out = str(tmp_path)
    assert evaluate_cli.main(["retrieval", "--data", sf, "--out", out], spark) == 0
    assert evaluate_cli.main(["retrieval", "--data", sf, "--out", out, "--label", "other"], spark) == 0
    assert evaluate_cli.main(["compare", "--data", sf, "--out", out, "--new", "other"], spark) == 0
    text = "\n".join(r.value for r in spark.read.text(f"{out}/comparison_base_other").collect())
    assert "**keep base**" in text and "same" in text
    assert evaluate_cli.main(["gold", "--data", sf, "--out", out], spark) in (0, 1)
    with pytest.raises(SystemExit):
        evaluate_cli.parse(["compare", "--data", sf, "--out", out])
