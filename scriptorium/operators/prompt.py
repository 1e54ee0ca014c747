"""Numbered sources and prompts of a batch of hit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import labels

#: What the checks of an answer look at: markers of listed sources, figures that stand in them, the one phrase for an open question, amendments with both sides.
RULES = (
    "Each claim carries the marker of its source before the full stop, as in [S3]; markers of sources that aren't listed are errors. "
    "Figures are checked against the cited text digit by digit, so repeat them with their units and clause numbers unchanged. "
    "A source that was amended counts in its amended form: say what changed and mark both sources. "
    "A note that a place has a new name makes both names the same place. "
    "What the listed sources leave open is answered by this one sentence alone: This could not be found in the documents. "
    "Use plain sentences, six at most, and no formula markup."
)


def numbered(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with what prompts need of their passage."""
    c = chunks.select("pos", "chunk_id", "title", "text", "is_amendment", "covers", "amends", labels.citation().alias("citation"))
    return hits.join(c, "pos")


def amendment_links(sources: DataFrame) -> DataFrame:
    """(qid, original, amendment): ords of hits of one query of which the second changes what the first covers."""
    o = sources.filter(~F.col("is_amendment")).select("qid", F.col("ord").alias("original"), F.explode("covers").alias("target"))
    a = sources.filter("is_amendment").select("qid", F.col("ord").alias("amendment"), F.explode("amends").alias("target"))
    return o.join(a, ["qid", "target"]).select("qid", "original", "amendment").distinct()


def _refs(numbers):
    return F.array_join(F.transform(F.array_sort(numbers), lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))), ", ")


def source_blocks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, ord, chunk_id, block): each source as a model sees it, amendments written above what they change. The headings are fixed values."""
    s = numbered(hits, chunks)
    links = amendment_links(s)
    texts = links.join(s.select("qid", F.col("ord").alias("amendment"), F.col("text").alias("change")), ["qid", "amendment"])
    above = texts.groupBy("qid", F.col("original").alias("ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("amendment", "change"))), lambda x: F.concat(F.lit("AMENDED by [S"), x["amendment"].cast("string"), F.lit("]: "), x["change"])), "\n").alias("changes")
    )
    targets = links.groupBy("qid", F.col("amendment").alias("ord")).agg(_refs(F.collect_set("original")).alias("targets"))
    rows = s.join(above, ["qid", "ord"], "left").join(targets, ["qid", "ord"], "left")
    head = F.concat(F.lit("[S"), F.col("ord").cast("string"), F.lit("] "), "citation", F.when(F.col("title") != "", F.concat(F.lit(" - "), "title")).otherwise(""))
    kind = F.when(F.col("is_amendment"), F.when(F.col("targets").isNotNull(), F.concat(F.lit("\nThis is an AMENDMENT to "), "targets", F.lit("."))).otherwise("\nThis is an AMENDMENT.")).otherwise("")
    body = F.when(F.col("changes").isNotNull(), F.concat("changes", F.lit("\nOriginal text (superseded where the amendment differs):\n"), "text")).otherwise(F.col("text"))
    return rows.select("qid", "ord", "chunk_id", F.concat(head, kind, F.lit("\n"), body).alias("block"))


def prompts(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, prompt): the question, its sources in order, the question again."""
    sources = blocks.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), "\n\n").alias("sources"))
    ask = F.concat(F.lit("Question: "), F.col("question"))
    return queries.join(sources, "qid").select("qid", F.concat(ask, F.lit("\n\nSources:\n\n"), "sources", F.lit("\n\n"), ask, F.lit("\n\nAnswer (cite sources as [S#]):")).alias("prompt"))
