"""Counting what comes before a passage gives what the lists give."""

import numpy as np
import pytest

from scriptorium.operators import keyword, mining, rank


def _vectors(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{key} long, vec array<float>")


def _unit(rng, n, dim=6):
    x = rng.integers(-2, 3, (n, dim)) + 0.0  # whole numbers, so that many products are equal
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@pytest.mark.parametrize("passage_block", [1000, 70])
def test_within_equals_dense_list(spark, passage_block):
    rng = np.random.default_rng(3)
    queries = _vectors(spark, enumerate(_unit(rng, 150)), "qid")
    passages = _vectors(spark, enumerate(_unit(rng, 600)), "pos")
    targets = spark.createDataFrame([(q, int(p)) for q in range(150) for p in rng.choice(700, 3)], "qid long, pos long")  # places from 600 have no vector
    want = {tuple(r) for r in rank.dense_ranking(queries, passages, 50).join(targets, ["qid", "pos"]).select("qid", "pos").collect()}
    got = [tuple(r) for r in rank.within(queries, targets, passages, 50, 40, passage_block).collect()]
    assert set(got) == want and len(got) == len(want) > 10


@pytest.mark.parametrize("passage_block", [1000, 70])
def test_near_any_equals_nearest(spark, passage_block):
    rng = np.random.default_rng(4)
    queries, gold = _vectors(spark, enumerate(_unit(rng, 300)), "qid"), _vectors(spark, enumerate(_unit(rng, 200)), "pos")
    for least in (0.85, 1.0):
        want = {r.qid for r in mining.leaks(queries, gold, least).collect()}
        got = [r.qid for r in rank.near_any(queries, gold, least, 40, passage_block).collect()]
        assert set(got) == want and len(got) == len(want)
        assert 0 < len(want) < 300 or least == 1.0


def test_candidates_hold_all_that_are_listed(spark):
    from scriptorium.operators import index

    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    say = lambda n: " ".join(words[min(119, int(x))] for x in rng.exponential(25, n))
    toks = spark.createDataFrame([(p, say(30).split()) for p in range(500)], "pos long, toks array<string>").selectExpr("pos", "toks", "size(toks) AS dl")
    posts = index.postings(toks)
    n, avgdl = index.totals(toks)
    grid = keyword.Grid(posts, index.term_stats(posts, n), n, avgdl, passages=200)
    questions = spark.createDataFrame([(q, say(6)) for q in range(120)], "qid long, question string")
    targets = spark.createDataFrame([(q, int(p)) for q in range(120) for p in rng.choice(520, 2)], "qid long, pos long")
    _, places = grid.search(questions, 0, targets)
    want = {tuple(r) for r in places.filter("rank <= 20").select("qid", "pos").collect()}
    few = grid.candidates(questions, targets, 20)
    _, again = grid.search(questions, 5, few)
    assert {tuple(r) for r in again.filter("rank <= 20").select("qid", "pos").collect()} == want and want
    assert few.count() < places.count() / 2
