import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import mining, rank
from scriptorium.plans import answers, retrieval as rt
from scriptorium.sources.model import HashingEmbedder

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


def test_cascade_equals_brute_force(spark, sf):
    questions, positives = answers._candidates(spark, sf)
    asked = {r.qid: r.question for r in questions.collect()}
    own = {r.qid: r.pos for r in positives.collect()}
    gold = [q for _, q in sorted(asked.items()) if q.strip()][5:60:9]  # these stand in training, so they leak
    corpus = rt.corpus_of(spark, sf)
    got = {r.qid: (r.reason, r.negative_id) for r in mining.filter_cascade(questions, positives, spark.createDataFrame(list(enumerate(gold)), "pos long, question string"), corpus, HashingEmbedder(), answers.PREFIX).collect()}
    words = {q: set(re.findall("[a-z0-9]+", t.lower())) for q, t in asked.items()}
    near = {b for b in words for a in words if a < b and words[a] and len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b]) - 1e-9}
    simple = {r.qid: (r.m, r.c) for r in questions.join(positives, "qid").join(corpus.chunks.select("pos", "text"), "pos").select("qid", tx.mentions_prompt(F.col("question")).alias("m"), tx.copies_phrase(F.col("question"), F.col("text")).alias("c")).collect()}
    code = HashingEmbedder().encode
    ids = sorted(own)
    vectors = code([answers.PREFIX + asked[q] for q in ids]).astype(float)
    leak = dict(zip(ids, (vectors @ code([answers.PREFIX + g for g in gold]).astype(float).T).max(axis=1) >= 0.85))
    chunks = sorted(corpus.chunks.select("pos", "text").collect())
    scores = np.round(vectors @ code([c.text for c in chunks]).astype(float).T, 9)
    dense = {q: {chunks[i].pos for i in np.argsort(-row, kind="stable")[:50]} for q, row in zip(ids, scores)}
    bm25 = rank.bm25_ranking(rank.query_terms(questions), corpus.posts, corpus.stats, corpus.n, corpus.avgdl, 50)
    listed = {(r.qid, r.pos) for r in bm25.collect()}
    negatives = dict(map(tuple, mining.hard_negatives(positives, bm25, corpus.chunks).select("qid", "negative_id").collect()))
    want = {}
    for q in ids:
        m, c = simple[q]
        checks = (q in near, m, c, leak[q], (q, own[q]) not in listed and own[q] not in dense[q], q not in negatives)
        reason = next((r for bad, r in zip(checks, answers.CODES) if bad), "kept")
        want[q] = (reason, negatives[q] if reason == "kept" else None)
    assert got == want
    assert "too similar to a gold question" in {r for r, _ in got.values()}
    assert any((q, own[q]) not in listed and own[q] in dense[q] and not (q in near or any(simple[q]) or leak[q]) for q in ids)


def test_negatives_of_pairs_and_val_equal_sql(spark, sf):
    """The SQL of hard_negatives over a view of val that also holds pairs, with the ids of passages as chunks writes them."""
    import duckdb

    con = duckdb.connect()
    for name in ("chunks", "embeddings", "gold"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    key = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), '-')".format
    con.execute(f"""CREATE TABLE val AS SELECT DISTINCT r.id AS val_id, r.query, c.chunk_id FROM (SELECT pair_id AS id, query, chunk_id FROM read_parquet('{sf}/pairs.parquet')
      UNION ALL SELECT val_id, query, chunk_id FROM read_parquet('{sf}/val.parquet')) r JOIN chunks c ON {key('r.chunk_id')} = {key('c.chunk_id')}""")
    want = con.execute(answers.ORACLE["hard_negatives"]).fetchall()
    got = [tuple(r) for r in answers.mined_negatives(spark, sf).select("qid", "negative_id").collect()]
    assert sorted(got) == sorted(want) and len(got) > 200
