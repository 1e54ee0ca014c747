"""Checks of corpora, gold sets and runs against each other. Each returns the offending rows; `require_none` raises on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import labels, text as tx

DOCS = ("gcw", "arb", "wlc", "spm", "lwr", "tnd", "none", "cross")
TYPES = ("fact", "numeric", "table", "amendment", "cross_doc", "unanswerable")
WORDINGS = ("natural", "document")


def require_none(problems: DataFrame, what: str) -> None:
    """Raises with the first ten rows if there are any."""
    first = problems.limit(10).collect()
    if first:
        raise ValueError(f"{what}: {[tuple(r) for r in first]}")


def build_violations(chunks: DataFrame, most: int = 512) -> DataFrame:
    """(chunk_id, problem): repeated ids, empty texts, no pages, too many tokens."""
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id", F.lit("duplicate id").alias("problem"))
    size = tx.token_count(labels.index_text()) + 2
    each = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text"), F.when(F.coalesce(F.size("pdf_pages"), F.lit(0)) <= 0, "no pages"), F.when(size > most, "too many tokens"),
    ))
    return twice.unionByName(chunks.select("chunk_id", F.explode(each).alias("problem")))


def build_summary(chunks: DataFrame) -> DataFrame:
    """Per document, and in a last row for all: passages, average words, most tokens, amendments, curated passages."""
    rows = chunks.select("doc_id", tx.word_count(F.col("text")).alias("words"), (tx.token_count(labels.index_text()) + 2).alias("tokens"), "is_amendment", "source")
    return rows.rollup("doc_id").agg(
        F.count(F.lit(1)).alias("passages"), F.bround(F.avg("words"), 1).alias("avg_words"), F.max("tokens").alias("max_tokens"),
        F.count_if(F.col("is_amendment")).alias("amendments"), F.count_if(F.col("source") == "curated").alias("curated"),
    ).withColumn("doc_id", F.coalesce("doc_id", F.lit("total")))


def id_changes(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, change): 'added' or 'removed'."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def gold_problems(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, problem): every problem of every gold record, of its labels and of its evidence against the corpus."""
    twice = gold.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    answerable = F.col("question_type") != "unanswerable"
    n = F.coalesce(F.size("evidence"), F.lit(0))
    own = F.array_compact(F.array(
        F.when(~F.col("doc").isin(*DOCS), F.concat(F.lit("unknown doc "), "doc")),
        F.when(~F.col("question_type").isin(*TYPES), F.concat(F.lit("unknown type "), "question_type")),
        F.when(~F.col("wording").isin(*WORDINGS), F.concat(F.lit("unknown wording "), "wording")),
        F.when((F.trim("question") == "") | (F.trim("answer") == ""), "empty question or answer"),
        F.when(answerable & (n <= 0), "answerable question without evidence"),
        F.when(~answerable & ((n > 0) | (F.col("answer") != tx.NOT_FOUND) | (F.col("doc") != "none")), "unanswerable question with evidence, answer or doc"),
    ))
    records = gold.select("id", F.explode(own).alias("problem"))
    ev = gold.select("id", F.explode("evidence").alias("e")).select("id", "e.chunk_id", F.col("e.pdf_pages").alias("pages"), "e.quote")
    rows = ev.join(chunks.select("chunk_id", "pdf_pages", "text", F.lit(True).alias("there")), "chunk_id", "left")
    of_evidence = F.array_compact(F.array(
        F.when(F.col("there").isNull(), F.concat("chunk_id", F.lit(" is not in the corpus"))),
        F.when(F.col("there") & (F.size(F.array_except("pages", "pdf_pages")) > 0), F.concat("chunk_id", F.lit(" is on other pages"))),
        F.when(F.col("there") & ~F.contains(tx.squashed(F.col("text")), tx.squashed(F.col("quote"))), F.concat(F.lit("quote not found in "), "chunk_id")),
    ))
    return records.unionByName(rows.select("id", F.explode(of_evidence).alias("problem"))).unionByName(twice)


def uncovered_amendments(chunks: DataFrame) -> DataFrame:
    """(chunk_id, target): targets of amendments that no passage covers."""
    a = chunks.filter("is_amendment").select("chunk_id", F.explode("amends").alias("target"))
    return a.join(chunks.select(F.explode("covers").alias("target")).distinct(), "target", "left_anti").select("chunk_id", "target")


def broken_tables(chunks: DataFrame) -> DataFrame:
    """(parent, parts, named): split tables whose parts aren't complete and in order."""
    part = F.regexp_extract("section", r"\(part (\d+)/(\d+)\)$", 1).cast("int")
    total = F.regexp_extract("section", r"\(part (\d+)/(\d+)\)$", 2).cast("int")
    rows = chunks.filter("parent <> '' AND section RLIKE '\\\\(part [0-9]+/[0-9]+\\\\)$'").select("parent", "pos", part.alias("i"), total.alias("n"))
    per = rows.groupBy("parent").agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("named"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "i"))), lambda x: x["i"]).alias("seen"))
    return per.filter((F.col("parts") != F.col("named")) | (F.col("seen") != F.sequence(F.lit(1), F.col("named")))).select("parent", "parts", "named")
