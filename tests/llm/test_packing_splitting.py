import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import packing, splitting


def test_nnls_solves():
    import numpy as np

    a = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]])
    assert np.allclose(packing.nnls(a, a @ np.array([2.0, 3, 0])), [2, 3, 0], atol=1e-8)
    assert (packing.nnls(a, -np.ones(3)) == 0).all()


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(30)}
    plan = packing.plan_patterns(hist, 100)
    used = {}
    for pattern, n in plan:
        assert sum(k * c for k, c in pattern.items()) <= 100 and n > 0
        for k, c in pattern.items():
            used[k] = used.get(k, 0) + c * n
    assert used == hist
    bins = []  # first fit decreasing
    for k in sorted(hist, reverse=True):
        for _ in range(hist[k]):
            at = next((i for i, b in enumerate(bins) if b + k <= 100), None)
            if at is None:
                bins.append(k)
            else:
                bins[at] += k
    assert sum(n for _, n in plan) <= len(bins) * 1.02 + 1


def test_plan_of_nothing_and_too_long():
    assert packing.plan_patterns({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan_patterns({11: 1}, 10)


def test_pack_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aé中\n") for _ in range(rng.choice([0, 5, 30, 90, 260])))) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, salt string, n_tokens int")
    got = packing.pack(df, capacity=100, rows_per_task=20).collect()
    texts = dict(rows)
    fill = {}
    for r in got:
        if r.container_id is None:
            assert r.n_tokens == 0 and not texts[r.doc_id]
        else:
            part = texts[r.doc_id][r.start_char : r.end_char]
            assert len(part.encode()) == r.n_tokens
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 100
    for i, t in rows:
        mine = sorted((r.piece_no, r.start_char, r.end_char) for r in got if r.doc_id == i)
        assert "".join((t or "")[a:b] for _, a, b in mine) == (t or "")
        assert (len(mine) > 1) == (len((t or "").encode()) > 100)
    assert packing.pack(df.limit(0), 100).count() == 0


def test_equal_lengths_spread(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("abcde").alias("text"))
    got = packing.pack(df, 50)
    assert got.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).filter("n = 50").count() == 100


def test_pieces_invariants():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["abc", "12", ". ", "\n", "\n\n", " ", "，", "。", "x"]) for _ in range(rng.randint(0, 2500)))
        found = splitting.pieces(t)
        rest = []
        for k, (a, b, n, o) in enumerate(found):
            toks = splitting.TOKEN.findall(t[a:b])
            assert len(toks) == n <= 400 and o <= 40 and (o == 0 or k > 0)
            rest += toks[o:]
        assert rest == splitting.TOKEN.findall(t)


def test_cuts_are_natural():
    text = "\n\n".join(" ".join(["Word"] * 49) + "." for _ in range(20))
    found = splitting.pieces(text)
    assert all(text[a - 2 : a] == "\n\n" or text[a - 2 : a] == ". " or a == 0 or o for a, b, n, o in found)
    assert all(text[:b].rstrip().endswith(".") for _, b, _, _ in found)
    assert all(n == 1 for n in [1]) and splitting.pieces("x" * 5000) == [(0, 5000, 1, 0)]


def test_split_and_recount(spark):
    rows = [("chunk", "a", "w " * 1000), ("chunk", "b", "short"), ("chunk", "c", None), ("unit", "d", "")]
    got = splitting.split(spark.createDataFrame([(*r, 1) for r in rows], "src string, record_id string, text string, part_no int")).collect()
    a = sorted((r.part_no, r.part_count, r.n_tokens) for r in got if r.record_id == "a")
    assert len(a) > 2 and all(n <= 400 and c == len(a) for _, c, n in a) and [i for i, _, _ in a] == list(range(1, len(a) + 1))
    assert {r.record_id: (r.part_count, r.text) for r in got if r.record_id != "a"} == {"b": (1, "short"), "c": (1, None), "d": (1, "")}
    w = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 3, 2), (2, 1, 3, 2), (3, None, 1, 1), (4, None, None, None)], "window_id long, unit_id long, part_no int, part_count int")
    assert {(r.window_id, r.right_no, r.right_count) for r in splitting.recount(w).collect()} == {(1, 1, 2), (2, 2, 2), (3, 1, 1), (4, 1, 1)}
    assert splitting.split(spark.createDataFrame([], "src string, record_id string, text string")).count() == 0
