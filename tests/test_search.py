import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scriptorium.operators import cite, evaluate, expand, index, mining, pipeline, prompt, quality, rank
from scriptorium.operators.search import Corpus, Ranked

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import test modules

SCHEMA = (
    "pos long, chunk_id string, doc_id string, doc_title string, section string, text string, pdf_pages array<int>, printed_pages array<string>, title string, part string, covers array<string>, "
    "is_amendment boolean, amends array<string>, source string, parent string"
)


def chunk(pos, text, section=None, parent="", covers=(), amends=(), doc="d"):
    return (pos, f"c{pos}", doc, "Doc", section or f"Clause {pos}", text, [1], ["1"], "", "", list(covers), bool(amends), list(amends), "pdf", parent)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        chunk(1, "wind speed factor table alpha", "Table 2 (part 1/4)", "Table 2", ["Table 2"]), chunk(2, "wind beta", "Table 2 (part 2/4)", "Table 2"), chunk(3, "gamma", "Table 2 (part 3/4)", "Table 2"),
        chunk(4, "delta", "Table 2 (part 4/4)", "Table 2"), chunk(5, "the factor is replaced", "Amendment 1", amends=["Table 2"]), chunk(6, "article 142 relief granted"), chunk(7, "rain load"), chunk(8, "snow load"),
        chunk(9, "global note", "Amendment 2", amends=[]),
    ]
    chunks = spark.createDataFrame(rows, SCHEMA)
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i in (1, 7) else [0.6, 0.8]) for i in range(1, 9)], "pos long, vec array<float>")
    return Corpus.build(chunks, vectors)


def ask(spark, corpus, *questions):
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(questions)], "qid string, question string")
    v = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i, _ in enumerate(questions)], "qid string, vec array<float>")
    return Ranked.of(corpus, q, v)


def test_bm25_matches_the_formula(spark, corpus):
    r = ask(spark, corpus, "wind wind relief")
    got = {x.pos: x.score for x in r.bm25.collect()}
    docs = {x.pos: x.toks for x in index.with_tokens(corpus.chunks).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for toks in docs.values():
        for t in set(toks):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    for pos, toks in docs.items():
        want = sum(idf[t] * toks.count(t) * 2.5 / (toks.count(t) + 1.5 * (0.25 + 0.75 * len(toks) / avg)) for t in ("wind", "wind", "relief") if t in toks)
        assert got.get(pos, 0) == pytest.approx(want) if want > 0 else pos not in got


def test_fusion_and_dense_ties(spark, corpus):
    r = ask(spark, corpus, "relief")
    assert [x.pos for x in r.dense.orderBy("rank").collect()][:3] == [1, 7, 2]
    top = r.list_of("hybrid").orderBy("rank").collect()
    assert top[0].pos == 6 and top[0].bm25_rank == 1
    with pytest.raises(ValueError):
        r.list_of("other")
    with pytest.raises(ValueError):
        r.hits(top_k=0)


def test_dense_grid_equals_one_block(spark):
    import random

    rng = random.Random(1)
    q = spark.createDataFrame([(f"q{i}", [rng.random() for _ in range(4)]) for i in range(7)], "qid string, vec array<float>")
    p = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(40)], "pos long, vec array<float>")
    a = {(r.qid, r.pos, r.rank) for r in rank.dense_ranking(q, p, 5).collect()}
    b = {(r.qid, r.pos, r.rank) for r in rank.dense_ranking(q, p, 5, query_block=2, passage_block=6).collect()}
    assert a == b and len(a) == 35


def test_siblings_and_amendments(spark, corpus):
    r = ask(spark, corpus, "wind speed alpha")
    hits = [(x.pos, x.reason) for x in r.hits("bm25", top_k=1, pin=False).orderBy("ord").collect()]
    assert [p for p, _ in hits] == [1, 5, 2, 3, 4]
    assert hits[1][1] == "Amendment 1 amends Table 2"
    assert hits[2][1] == "rest of Table 2: Table 2 (part 1/4) was retrieved"
    only = [x.pos for x in expand.attach_siblings(r.list_of("bm25").filter("rank = 1").select("qid", F.col("rank").alias("ord"), "pos", "score", F.lit("").alias("reason")), corpus.chunks, budget=2).orderBy("ord").collect()]
    assert only == [1, 2, 3]


def test_amendment_brings_its_original(spark, corpus):
    r = ask(spark, corpus, "replaced")
    hits = [(x.pos, x.reason) for x in r.hits("bm25", top_k=1, pin=False, siblings=False).orderBy("ord").collect()]
    assert hits == [(5, ""), (1, "original text of Table 2, amended by Amendment 1")]


def test_pin_rare_identifier(spark, corpus):
    r = ask(spark, corpus, "what of article 142 and rain")
    got = r.hits("dense", top_k=1, siblings=False, amendments=False).orderBy("ord").collect()
    assert [(x.pos, x.reason) for x in got] == [(1, ""), (6, "contains '142' from the question")]


def test_prompt_marks_amended_sources(spark, corpus):
    r = ask(spark, corpus, "wind speed alpha")
    blocks = {x.ord: x.block for x in prompt.source_blocks(r.hits("bm25", top_k=1, pin=False, siblings=False), corpus.chunks).collect()}
    assert blocks[1].startswith("[S1] Doc, Table 2 (part 1/4), p. 1\nAMENDED by [S2]: the factor is replaced\nOriginal text")
    assert blocks[2].startswith("[S2] Doc, Amendment 1, p. 1\nThis is an AMENDMENT to [S1].")


def test_citations(spark):
    rows = [
        ("a", "The limit is 25 days [S1]. It was twenty days before that change [S2].", "q", ["limit 25 days", "20 days"]), ("b", "This could not be found in the documents.", "q", ["x"]),
        ("c", "This sentence has no citation at all here. The value is 9 [S1][S7].", "is it 4?", ["value 8"]), ("d", "It is 9 [S1].", "", None),
    ]
    got = {r.aid: r for r in cite.check_citations(spark.createDataFrame(rows, "aid string, answer string, question string, sources array<string>")).collect()}
    assert got["a"].ok and got["a"].cited == [1, 2]
    assert got["b"].ok and got["b"].cited == []
    assert got["c"].invalid == [7] and got["c"].uncited_sentences == ["This sentence has no citation at all here."] and [x.number for x in got["c"].ungrounded] == ["9"]
    assert got["d"].invalid == [1]


class Canned:
    model = "canned"

    def __init__(self, up=True, fail=False):
        self.up, self.fail = up, fail

    def available(self):
        return self.up

    def complete(self, system, prompt):
        from scriptorium.sources.model import ModelError

        if self.fail:
            raise ModelError("boom")
        return "Relief was granted under article 142 [S1]."


def test_pipeline(spark, corpus):
    r = ask(spark, corpus, "article 142 relief")
    ok = pipeline.ask(r, Canned()).first()
    assert ok.mode == "generated" and ok.cited == [1] and ok.warnings == []
    for model, word in ((Canned(up=False), "not reachable"), (Canned(fail=True), "LLM error (boom)")):
        row = pipeline.ask(r, model).first()
        assert row.mode == "retrieval-only" and word in row.warnings[0]
    assert pipeline.ask(r, use_model=False).first().warnings == []


def test_thresholds(spark):
    def best(ok, no):
        return evaluate.best_threshold(spark.createDataFrame([(x, True) for x in ok] + [(x, False) for x in no], "score double, answerable boolean")).first()

    assert best([0.8, 0.9], [0.5, 0.6]).threshold == 0.7
    b = best([0.6, 0.8], [0.5, 0.7])
    assert b.false_alarms == 0 and b.threshold == 0.55
    assert best([0.5], []).threshold == 0.5


def test_wins_losses(spark):
    df = spark.createDataFrame([(None, 3), (7, 6), (1, 9), (None, None), (12, 20)], "rank_a int, rank_b int")
    assert tuple(evaluate.wins_losses(df).first()) == (2, 1, 2)


def test_score_answers(spark):
    nf = "This could not be found in the documents."
    rows = [(1, "x", "retrieval-only", True, ["1"]), (2, nf, "generated", False, []), (3, nf, "generated", True, ["1"]), (4, "It is 1", "generated", True, ["1"]), (5, "It is", "generated", True, []), (6, None, None, None, None)]
    got = {r.result_id: r.correct for r in evaluate.score_answers(spark.createDataFrame(rows, "result_id long, answer string, mode string, answerable boolean, must_include array<string>")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: None, 6: False}


def test_near_duplicates_against_brute_force(spark):
    import random

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    base = [[rng.choice(vocab) for _ in range(8)] for _ in range(40)]
    qs = [" ".join(b) for b in base] + [" ".join([*b[:7], rng.choice(vocab)]) for b in base] + ["", "", base[0][0], " ".join(base[1])]
    rng.shuffle(qs)
    sets = [set(q.split()) for q in qs]
    want = {j for j in range(len(qs)) for i in range(j) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    got = {r.i for r in mining.near_duplicates(spark.createDataFrame(list(enumerate(qs)), "i long, question string")).collect()}
    assert got == want


def test_hard_negative_skips_related(spark, corpus):
    pos = spark.createDataFrame([("q", 1)], "qid string, pos long")
    lists = spark.createDataFrame([("q", p, r) for r, p in enumerate([1, 2, 5, 7, 6], 1)], "qid string, pos long, rank int")
    assert mining.hard_negatives(pos, lists, corpus.chunks).first().negative_id == "c7"


def test_samples_and_split(spark):
    rows = mining.numbered(spark.range(10).withColumnRenamed("id", "pos"), "pos")
    assert sorted(r.pos for r in mining.spread_sample(rows, 10, 3).collect()) == [0, 3, 6]
    assert mining.spread_sample(rows, 10, 10).count() == 10
    a = mining.seeded_split(spark.range(25), "id")
    assert a.filter("split = 'validation'").count() == 2 and a.exceptAll(mining.seeded_split(spark.range(25), "id")).count() == 0


def test_quality(spark, corpus):
    c = corpus.chunks
    bad = spark.createDataFrame([chunk(1, ""), (*chunk(1, "x")[:6], [], [], "", "", [], False, [], "pdf", "")], SCHEMA)
    assert {(r.problem) for r in quality.build_violations(bad).collect()} == {"duplicate id", "empty text", "no pages"}
    assert quality.build_violations(c).count() == 0 and quality.broken_tables(c).count() == 0 and quality.uncovered_amendments(c).count() == 0
    ev = lambda cid, pages, quote: [(cid, "s", pages, quote)]
    gold = [("g1", "q", "gcw", "fact", "natural", "a", ev("c1", [1], "WIND  speed")), ("g2", "q", "gcw", "fact", "natural", "a", ev("zz", [1], "x")), ("g3", "q", "gcw", "fact", "natural", "a", ev("c1", [9], "nope")), ("g4", "", "bad", "fact", "natural", "a", [])]
    g = spark.createDataFrame(gold, "id string, question string, doc string, question_type string, wording string, answer string, evidence array<struct<chunk_id:string,section:string,pdf_pages:array<int>,quote:string>>")
    got = sorted((r.id, r.problem) for r in quality.gold_problems(g, c).collect())
    assert [i for i, _ in got] == ["g2", "g3", "g3", "g4", "g4", "g4"]
    with pytest.raises(ValueError):
        quality.require_none(quality.gold_problems(g, c), "gold")
    a, b = index.fingerprint(c).first().fingerprint, index.fingerprint(c.withColumn("text", F.upper("text"))).first().fingerprint
    assert a != b and len(a) == 16
    assert {tuple(r) for r in quality.id_changes(spark.createDataFrame([("a",), ("b",)], "chunk_id string"), spark.createDataFrame([("b",), ("c",)], "chunk_id string")).collect()} == {("a", "removed"), ("c", "added")}


def test_empty_tables(spark, corpus):
    empty = spark.createDataFrame([], SCHEMA)
    c = Corpus.build(empty, spark.createDataFrame([], "pos long, vec array<float>"))
    assert ask(spark, c, "anything").hits().count() == 0
    assert quality.build_summary(empty).filter("passages > 0").count() == 0
