import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import overlap, similar

WORD = re.compile(r"[a-z0-9]+")


def texts(n, seed, vocab=60, lengths=(8, 45)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)] + ["the", "of", "and"] * 3
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(*lengths))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            b = list(base)
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(b))
                rng.choice([lambda: b.pop(k) if len(b) > 9 else None, lambda: b.insert(k, rng.choice(words)), lambda: b.__setitem__(k, rng.choice(words))])()
            rng.shuffle(b)
            out.append(" ".join(b).title())
    return out


def brute(a, b, same):
    sets = lambda xs: [(i, frozenset(WORD.findall((t or "").lower()))) for i, t in xs if len(WORD.findall((t or "").lower())) >= 10]
    return {(i, j) for i, x in sets(a) for j, y in sets(b) if (not same or i < j) and len(x & y) / len(x | y) >= 0.7}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = list(enumerate(texts(60, seed))) + [(900, None), (901, ""), (902, "too short"), (903, "x " * 40)]
    df = spark.createDataFrame([(0, i, t) for i, t in rows] + [(0, *rows[0])], "kind int, id long, text string")
    got = {(r.id_a, r.id_b) for r in similar.similar_pairs(df).collect()}
    assert got == brute(rows, rows, True) and got


def test_shared_keys_give_the_same_pairs(spark):
    rows = list(enumerate(texts(60, 3, vocab=25)))
    df = spark.createDataFrame([(0, i, t) for i, t in rows], "kind int, id long, text string")
    plain = {tuple(r) for r in similar.similar_pairs(df).collect()}
    for run in (1, 5, 40):  # keys of more rows than these go out under chains of two, in blocks
        plan, _ = similar.make_plan(df, run=run)
        assert len(plan.shared) and (run > 5 or plan.blocks.max() > 1)
        assert {tuple(r) for r in similar.similar_pairs(df, run=run).collect()} == plain
    assert {(a, b) for _, a, b in plain} == brute(rows, rows, True)


@pytest.mark.parametrize("t", [0.5, 0.6, 0.9])
def test_other_similarities(spark, t):
    rows = list(enumerate(texts(40, 5)))
    df = spark.createDataFrame([(0, i, x) for i, x in rows], "kind int, id long, text string")
    sets = [(i, frozenset(WORD.findall(x.lower()))) for i, x in rows if len(WORD.findall(x.lower())) >= 10]
    want = {(i, j) for i, x in sets for j, y in sets if i < j and len(x & y) / len(x | y) >= t - 1e-9}
    assert {(r.id_a, r.id_b) for r in similar.similar_pairs(df, t=t).collect()} == want and want


def test_a_plan_of_other_texts_finds_the_same(spark):
    rows = list(enumerate(texts(50, 6)))
    df = spark.createDataFrame([(0, i, x) for i, x in rows], "kind int, id long, text string")
    hashed = similar.hashed_rows(df)
    rng = np.random.default_rng(0)
    other = similar.Plan([(0, rng.integers(0, 2**63, 12).astype(np.uint64)) for _ in range(50)], 100)
    got = {(r.rep_a, r.rep_b) for r in similar.alike_classes(hashed, other, 3).filter("name_a <> name_b").collect()}
    ids = {tuple(sorted(p)) for p in got}
    assert ids and ids <= brute(rows, rows, True)
    empty = similar.Plan([], 0)
    assert {tuple(sorted((r.rep_a, r.rep_b))) for r in similar.alike_classes(hashed, empty, 3).filter("name_a <> name_b").collect()} == ids


def test_long_texts(spark):
    rng = random.Random(4)
    base = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    near = [f"v{rng.randrange(10**6)}" if rng.random() < 0.1 else w for w in base]
    far = [f"v{rng.randrange(10**6)}" if rng.random() < 0.5 else w for w in base]
    df = spark.createDataFrame([(0, 1, " ".join(base)), (0, 2, " ".join(near)), (0, 3, " ".join(far))], "kind int, id long, text string")
    assert {tuple(r) for r in similar.similar_pairs(df).collect()} == {(0, 1, 2)}


def test_levels_cover_all_bounds():
    rng = random.Random(1)
    for seed in range(20):
        ranges = [similar.tau_range(rng.randint(1, 30 * (seed + 1))) for _ in range(200)]
        levels = similar.levels_for(ranges)
        assert levels[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(levels, levels[1:])) and levels[-1][1] > 10**6


def test_classes_count_all_links(spark):
    t = "one two three four five six seven eight nine ten eleven"
    rows = [(0, i, t) for i in range(100)] + [(0, 99, t + " twelve"), (0, 200, t + " twelve"), (0, 201, t + " twelve"), (0, 300, "a b c d e f g h i j k"), (1, 5, t), (0, 3, t)]
    df = spark.createDataFrame(rows, "kind int, id long, text string")
    got = {(r.kind, r.id, r.class_id): (r.class_size, r.links) for r in similar.similar_classes(df).collect()}
    assert got == {(0, i, 0): (100, 102) for i in range(100)} | {(0, i, 99): (3, 102) for i in (99, 200, 201)}


def test_copies_stay_linked(spark):
    t = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(0, i, t) for i in range(50)] + [(0, 99, t + " twelve")], "kind int, id long, text string")
    got = {(r.id_a, r.id_b) for r in similar.similar_pairs(df, expand=4).collect()}
    assert {(0, i) for i in range(1, 50)} <= got and (0, 99) in got and len(got) < 80


def test_different_texts_of_one_class_stand_in_all_pairs(spark):
    words = "one two three four five six seven eight nine ten eleven".split()
    rng = random.Random(2)
    df = spark.createDataFrame([(0, i, " ".join(rng.sample(words, len(words)))) for i in range(40)], "kind int, id long, text string")
    assert {(r.id_a, r.id_b) for r in similar.similar_pairs(df, expand=2).collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40)}


def test_pairs_stay_within_a_table_and_empty_input(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(0, 1, t), (1, 2, t), (1, 3, t)], "kind int, id long, text string")
    assert {tuple(r) for r in similar.similar_pairs(df).collect()} == {(1, 2, 3)}
    assert similar.similar_pairs(df.limit(0)).count() == 0


def test_overlaps_equal_brute_force(spark):
    all_ = texts(60, 7)
    rng = random.Random(0)
    rng.shuffle(all_)
    train, ev = list(enumerate(all_[:90])), [(str(i), t) for i, t in enumerate(all_[90:])]
    t = spark.createDataFrame([*train, train[0], (500, None), (501, "")], "id long, text string")
    e = spark.createDataFrame([(1, *x) for x in ev] + [(2, "n", None)], "kind int, id string, text string")
    got = {(r.eval_id, r.train_id) for r in overlap.overlaps(t, e).collect()}
    assert got == brute(ev, train, False) and got
    assert overlap.overlaps(t.limit(0), e).count() == 0 and overlap.overlaps(t, e.limit(0)).count() == 0


@pytest.mark.parametrize("t", [0.4, 0.5, 2 / 3, 0.9])
def test_overlaps_at_other_similarities(spark, t):
    all_ = texts(50, 8)
    random.Random(1).shuffle(all_)
    train, ev = list(enumerate(all_[:80])), [(str(i), x) for i, x in enumerate(all_[80:])]
    sets = lambda xs: [(i, frozenset(WORD.findall(x.lower()))) for i, x in xs if len(WORD.findall(x.lower())) >= 10]
    want = {(i, j) for i, x in sets(ev) for j, y in sets(train) if len(x & y) / len(x | y) >= t - 1e-9}
    df = spark.createDataFrame([(1, *x) for x in ev], "kind int, id string, text string")
    assert {(r.eval_id, r.train_id) for r in overlap.overlaps(spark.createDataFrame(train, "id long, text string"), df, t=t).collect()} == want and want


def test_shared_starts_in_blocks_give_the_same(spark):
    all_ = texts(60, 9, vocab=20)
    train, ev = list(enumerate(all_[:100])), [(str(i), x) for i, x in enumerate(all_[100:])]
    a, b = spark.createDataFrame(train, "id long, text string"), spark.createDataFrame([(1, *x) for x in ev], "kind int, id string, text string")
    keys, blocks, _ = overlap._shared_starts(a.withColumn("kind", F.lit(0)), 10, 3, 3)
    assert len(keys) and blocks.max() > 1
    assert {(r.eval_id, r.train_id) for r in overlap.overlaps(a, b, run=3).collect()} == brute(ev, train, False)


def test_coverage_is_what_the_spans_cover():
    rng = np.random.default_rng(3)
    a = np.sort(rng.choice(2**40, 20, replace=False)).astype(np.uint64)
    b = np.delete(a, [7])
    x = overlap.suffixes(np.concatenate([a, b]), np.array([0, 20, 39]), 3)
    side, name = (x["row"] == 0).astype(np.int8), x["row"].astype(np.int64)
    size = np.array([20, 19])[x["row"]]
    found = list(overlap.shared_spans({"key": x["key"], "ahead": x["ahead"], "pos": x["pos"], "side": side, "name": name, "sketch": np.zeros(len(size), np.uint64), "size": size}, 0.7, 3))
    places = {p for f in found for p, n in zip(f["pos"], f["length"]) for p in range(p, p + n)}
    order = np.argsort(np.argsort(np.sort(a)))
    assert places == set(range(22)) - {1 + int(order[7])} and all((f["least"] <= 21).all() for f in found)


def test_overlap_copies_stay_linked(spark):
    x = "one two three four five six seven eight nine ten eleven"
    t = spark.createDataFrame([(i, x) for i in range(30)], "id long, text string")
    e = spark.createDataFrame([(1, f"{i:02}", x) for i in range(20)], "kind int, id string, text string")
    got = {(r.eval_id, r.train_id) for r in overlap.overlaps(t, e, expand=3).collect()}
    assert {i for i, _ in got} == {f"{i:02}" for i in range(20)} and {j for _, j in got} == set(range(30)) and len(got) < 70


def test_large_classes_overlap_in_full(spark, tmp_path):
    x = "one two three four five six seven eight nine ten eleven"
    train = [(i, x if i % 2 else x + " twelve") for i in range(200)] + [(0, x)]  # id 0 has two texts
    val = [(1000 + i, x.title(), "gcw:1:1") for i in range(70)] + [(2000, "too short", "gcw:1:1")]
    spark.createDataFrame(train, "pair_id long, query string").write.parquet(f"{tmp_path}/pairs.parquet")
    spark.createDataFrame(val, "val_id long, query string, chunk_id string").write.parquet(f"{tmp_path}/val.parquet")
    spark.createDataFrame([("g1", x + " thirteen", "gcw"), ("g2", None, "gcw")], "id string, question string, doc string").write.parquet(f"{tmp_path}/gold.parquet")
    found = [tuple(r) for r in overlap.p6_found(spark, str(tmp_path)).collect()]
    want = {("val", str(1000 + i), j) for i in range(70) for j in range(200)} | {("gold", "g1", j) for j in range(200)}
    assert len(found) == len(want) and set(found) == want
    got_gold = next(r.coverage for r in overlap.p6_report(spark, str(tmp_path)).collect() if r.eval_table == "gold")
    assert {tuple(r) for r in overlap.p6_report(spark, str(tmp_path)).collect()} == {("val", "gcw", 71, 70, 14000, 1.0), ("gold", "gcw", 2, 1, 200, round(got_gold, 4))} and 0.5 < got_gold < 1


def test_extra_columns_do_no_harm(spark):
    df = spark.createDataFrame([(0, 1, "a b c d e f g h i j", 5, "z"), (0, 2, "a b c d e f g h i j k", 5, "z")], "kind int, id long, text string, name int, words string").withColumn("count", F.lit(1))
    assert similar.similar_pairs(df).count() == 1
