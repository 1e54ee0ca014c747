"""Mechanical checks of answers against their numbered sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as tx

LEAST_WORDS = 6


def numbers_of_sources(sources: Column) -> Column:
    """For each source the numbers that it holds."""
    return F.transform(sources, lambda s: tx.numbers_in(tx.without_markers(s)))


def check_citations(answers: DataFrame) -> DataFrame:
    """(aid, cited, invalid, uncited_sentences, ungrounded, ok) from (aid, answer, question, sources array<string>); sources[0] is [S1].

    An answer that opens with the not-found phrase has an empty report. A sentence without any marker and of LEAST_WORDS words or more
    is uncited. A number of a cited sentence is ungrounded if neither the sources cited there nor the question hold it.
    Null sources mean that numbers aren't checked. Where many answers share sources, a column `numbers` (numbers_of_sources) saves finding them again.
    """
    used = tx.source_numbers(F.col("answer"))
    count = F.coalesce(F.size("sources"), F.lit(0))
    refused = F.startswith(F.trim("answer"), F.lit(tx.NOT_FOUND))
    none, texts = F.array().cast("array<int>"), F.array().cast("array<string>")
    df = answers.withColumn("used", F.array_sort(F.array_distinct(used))).withColumn("count", count)
    if "numbers" not in answers.columns:
        df = df.withColumn("numbers", numbers_of_sources(F.col("sources")))
    df = df.withColumn("allowed", tx.numbers_in(F.coalesce(F.col("question"), F.lit(""))))
    df = df.withColumn("sentences", F.transform(tx.answer_sentences(F.col("answer")), lambda s: F.regexp_replace(s, r"^[ \-*•\t]+|[ \-*•\t]+$", "")))

    def grounded(s: Column) -> Column:
        here = F.filter(tx.source_numbers(s), lambda n: (n >= 1) & (n <= F.col("count")))
        backing = F.flatten(F.transform(here, lambda n: F.get("numbers", n - 1)))
        loose = F.array_sort(F.array_except(F.array_except(tx.numbers_in(tx.without_markers(s)), backing), F.col("allowed")))
        return F.when(F.size(here) > 0, F.transform(loose, lambda n: F.struct(n.alias("number"), s.alias("sentence")))).otherwise(F.array().cast("array<struct<number:string,sentence:string>>"))

    return df.select(
        "aid",
        F.when(refused, none).otherwise(F.filter("used", lambda n: (n >= 1) & (n <= F.col("count")))).alias("cited"),
        F.when(refused, none).otherwise(F.filter("used", lambda n: (n < 1) | (n > F.col("count")))).alias("invalid"),
        F.when(refused, texts).otherwise(F.filter("sentences", lambda s: (F.size(tx.source_numbers(s)) == 0) & (tx.word_count(s) >= LEAST_WORDS))).alias("uncited_sentences"),
        F.when(refused | F.col("sources").isNull(), F.array().cast("array<struct<number:string,sentence:string>>")).otherwise(F.flatten(F.transform("sentences", grounded))).alias("ungrounded"),
    ).withColumn("ok", (F.size("invalid") == 0) & (F.size("uncited_sentences") == 0) & (F.size("ungrounded") == 0))


def warnings(reports: DataFrame) -> DataFrame:
    """(aid, warnings) in fixed order and wording (fixed values), from reports joined with (low_confidence, best_cosine)."""
    numbers = F.array_join(F.array_distinct(F.transform("ungrounded", lambda x: x["number"])), ", ")
    names = F.array_join(F.transform("invalid", lambda n: F.concat(F.lit("S"), n.cast("string"))), ", ")
    each = F.array(
        F.when(F.col("low_confidence"), F.concat(F.lit("Low retrieval confidence (best similarity "), F.format_number("best_cosine", 2), F.lit("); the documents may not cover this question."))),
        F.when(F.size("invalid") > 0, F.concat(F.lit("Answer cites non-existent sources: "), names, F.lit("."))),
        F.when(F.size("uncited_sentences") > 0, F.concat(F.size("uncited_sentences").cast("string"), F.lit(" sentence(s) in the answer have no citation."))),
        F.when(F.size("ungrounded") > 0, F.concat(F.lit("Number(s) not found in the sources they cite: "), numbers, F.lit(". Check them against the sources."))),
    )
    return reports.select("aid", F.array_compact(each).alias("warnings"))
