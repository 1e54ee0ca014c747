"""The inverted index, its statistics, and the fingerprint that ties vectors to passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import labels, text as tx
from scriptorium.runtime import widen

EPSILON = 0.25


def with_tokens(chunks: DataFrame) -> DataFrame:
    """(pos, toks, dl) of every passage; its breadcrumb is searched with its text."""
    parts = chunks.select("pos", labels.index_text().alias("t"))
    return widen(parts).select("pos", tx.search_tokens(F.col("t")).alias("toks")).withColumn("dl", F.size("toks"))


def postings(tokens: DataFrame) -> DataFrame:
    """(tok, pos, tf, dl): one row per token and passage."""
    return tokens.select("pos", "dl", F.explode("toks").alias("tok")).groupBy("tok", "pos", "dl").agg(F.count(F.lit(1)).alias("tf"))


def totals(tokens: DataFrame) -> tuple[int, float]:
    """Number of passages and their average length in tokens."""
    row = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return row.n, row.avgdl or 0.0


def term_stats(posts: DataFrame, n: int) -> DataFrame:
    """(tok, df, idf) of n passages. An idf below 0 is replaced by EPSILON times the average idf before replacement."""
    df = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("tok", "df", idf.alias("idf"))  # the broadcast is one row


#: Hashes that are hashed together on each level of a fingerprint, and its levels: the last gathers n / FAN ** LEVELS short strings.
FAN, LEVELS = 1000, 2


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: 16 hex digits of the SHA-256 over the passages in order. Hashes of passages are hashed in blocks, and those again, so no text is gathered."""
    together = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256).alias("h")
    each = chunks.select(F.col("pos").alias("at"), F.sha2(F.concat(F.col("chunk_id"), labels.index_text()), 256).alias("h"))
    for _ in range(LEVELS):
        each = each.groupBy((F.col("at") / FAN).cast("long").alias("b")).agg(together).withColumnRenamed("b", "at")
    return each.agg(together).select(F.substring("h", 1, 16).alias("fingerprint"))
