"""Search of a batch of queries over a corpus: ranking, then pinning, parts of tables, amendments, in this order."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from scriptorium.operators import expand, index, rank
from scriptorium.runtime import cut_lineage, ensure_checkpoint_dir

TOP_K = 6
MODES = ("hybrid", "bm25", "dense")


@dataclass
class Corpus:
    """Passages with their index; vectors are (pos, vec). Passages without a vector are absent from dense lists."""

    chunks: DataFrame
    vectors: DataFrame
    posts: DataFrame
    stats: DataFrame
    n: int
    avgdl: float

    @classmethod
    def build(cls, chunks: DataFrame, vectors: DataFrame, path: str | None = None) -> Corpus:
        """Reads the texts once and stores the inverted index: postings, statistics of the tokens, and one row of totals, written last. Without a path it lives in the shared folder."""
        spark = chunks.sparkSession
        path = path or f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        index.postings(index.with_tokens(chunks)).write.mode("overwrite").parquet(f"{path}/postings")
        posts = spark.read.parquet(f"{path}/postings")
        n = chunks.count()
        length = posts.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        index.term_stats(posts, n).write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(n, length / n if n else 0.0)], "n long, avgdl double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return cls.read(chunks, vectors, path)

    @classmethod
    def read(cls, chunks: DataFrame, vectors: DataFrame, path: str) -> Corpus:
        spark = chunks.sparkSession
        row = spark.read.parquet(f"{path}/totals").first()
        return cls(chunks, vectors, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), row.n, row.avgdl)


@dataclass
class Ranked:
    """The lists of a batch of queries, before expansion."""

    corpus: Corpus
    queries: DataFrame
    terms: DataFrame
    bm25: DataFrame
    dense: DataFrame

    @classmethod
    def of(cls, corpus: Corpus, queries: DataFrame, query_vectors: DataFrame, k: int = rank.CANDIDATES) -> Ranked:
        terms = cut_lineage(rank.query_terms(queries))
        bm25 = rank.bm25_ranking(terms, corpus.posts, corpus.stats, corpus.n, corpus.avgdl, k)
        # Lists are k rows per query; each is read many times from here on.
        return cls(corpus, queries, terms, cut_lineage(bm25), cut_lineage(rank.dense_ranking(query_vectors, corpus.vectors, k)))

    @cached_property
    def holders(self) -> DataFrame:
        """Candidates for pinning, a few rows per query, computed once."""
        return cut_lineage(expand.rare_holders(self.terms, self.corpus.posts, self.corpus.stats, self.corpus.avgdl))

    def list_of(self, mode: str) -> DataFrame:
        """(qid, pos, score, bm25_rank, dense_rank, rank) of one mode."""
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {MODES}")
        none = F.lit(None).cast("int")
        if mode == "hybrid":
            return rank.fused(self.bm25, self.dense)
        if mode == "bm25":
            return self.bm25.select("qid", "pos", "score", F.col("rank").alias("bm25_rank"), none.alias("dense_rank"), "rank")
        return self.dense.select("qid", "pos", "score", none.alias("bm25_rank"), F.col("rank").alias("dense_rank"), "rank")

    def hits(self, mode: str = "hybrid", top_k: int = TOP_K, pin: bool = True, siblings: bool = True, amendments: bool = True) -> DataFrame:
        """(qid, ord, pos, score, reason) after the additions that are switched on."""
        return self.hits_of({"": (pin, siblings, amendments)}, mode, top_k).drop("config")

    def hits_of(self, configs: dict[str, tuple[bool, bool, bool]], mode: str = "hybrid", top_k: int = TOP_K) -> DataFrame:
        """(config, qid, ord, pos, score, reason) for several choices of (pin, siblings, amendments) at once: each addition is one pass over the lists of all
        configurations that have it."""
        if top_k < 1:
            raise ValueError("top_k must be 1 or more")
        top = self.list_of(mode).filter(F.col("rank") <= top_k).select("qid", F.col("rank").alias("ord"), "pos", "score", F.lit("").alias("reason"))
        names = lambda which: F.explode(F.array(*(F.lit(n) for n in which)))
        keyed = lambda df, which: df.withColumn("config", names(which)).withColumn("qid", F.struct("config", "qid")).drop("config")
        out, c = keyed(top, configs), self.corpus
        steps = (
            lambda df, on: expand.pin(df, keyed(self.holders, on)), lambda df, _: expand.attach_siblings(df, c.chunks), lambda df, _: expand.attach_amendments(df, c.chunks),
        )
        for k, step in enumerate(steps):
            on = [n for n, switches in configs.items() if switches[k]]
            if not on:
                continue
            out = cut_lineage(out)
            some = F.col("qid.config").isin(on)
            added = step(out.filter(some), on)
            out = added.unionByName(out.filter(~some)) if len(on) < len(configs) else added
        return out.select("qid.config", "qid.qid", "ord", "pos", "score", "reason")
