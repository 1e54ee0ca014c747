import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import index, keyword, rank


@pytest.fixture(scope="module")
def corpus(spark):
    """Passages of few words, many alike, so that scores tie and some words stand in most of them; their statistics."""
    rng = np.random.default_rng(5)
    words = ["beam", "slab", "pile", "kerb", "joint", "weld", *(f"name{chr(97 + i)}" for i in range(20))]
    texts = [" ".join(rng.choice(words, 6, p=[0.12] * 6 + [0.014] * 20)) for _ in range(600)]
    tokens = spark.createDataFrame(list(enumerate(texts)), "pos long, t string").select("pos", F.split("t", " ").alias("toks")).withColumn("dl", F.size("toks"))
    posts = index.postings(tokens).localCheckpoint()
    questions = [(i, t) for i, t in enumerate(" ".join(rng.choice(words, 5)) for _ in range(60))] + [(60, "unheard"), (61, ""), (62, "nameb nameb unheard")]
    asked = spark.createDataFrame(questions, "qid long, question string")
    return asked, posts, index.term_stats(posts, 600), *index.totals(tokens)


@pytest.mark.parametrize("passages, questions", [(10_000, 10_000), (70, 20)])
def test_lists_and_places_equal_the_whole_ranking(spark, corpus, passages, questions, monkeypatch):
    monkeypatch.setattr(keyword, "ASKED", 7)
    asked, posts, stats, n, avgdl = corpus
    whole = rank.bm25_ranking(rank.query_terms(asked), posts, stats, n, avgdl, 600).collect()
    targets = [(q, p) for q in range(63) for p in (q, q + 300)]
    lists, places = keyword.Grid(posts, stats, n, avgdl, passages, questions).search(asked, 10, spark.createDataFrame(targets, "qid long, pos long"))
    assert {(r.qid, r.pos, r.rank, round(r.score, 9)) for r in lists.collect()} == {(r.qid, r.pos, r.rank, round(r.score, 9)) for r in whole if r.rank <= 10}
    want = {(r.qid, r.pos): r["rank"] for r in whole}
    assert {(r.qid, r.pos): r["rank"] for r in places.collect()} == {t: want[t] for t in targets if t in want}
