"""Reports as rows of text (section, key, line): the tables behind them stay DataFrames, and a report of any length is written sorted, in parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import labels, text as tx
from scriptorium.operators import evaluate, runs
from scriptorium.operators.mining import numbered
from scriptorium.operators.search import MODES

LINES = "section int, key string, line string"


def lines(spark: SparkSession, section: int, *texts: str) -> DataFrame:
    """Fixed lines, in order, before all rows of their section."""
    return spark.createDataFrame([(section, f"\u0001{i:04}", t) for i, t in enumerate(texts)], LINES)


def table(section: int, rows: DataFrame, key: Column, *cells: Column, head: tuple[str, ...] = ()) -> DataFrame:
    """A row of a Markdown table for each row, in the order of `key`; `head` opens it."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    body = rows.select(F.lit(section).alias("section"), F.concat(F.lit("\u0003"), key.cast("string")).alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |")).alias("line"))
    if not head:
        return body
    top = rows.sparkSession.createDataFrame([(section, "\u00020", "| " + " | ".join(head) + " |"), (section, "\u00021", "|" + "---|" * len(head))], LINES)
    return top.unionByName(body)


def listed(section: int, rows: DataFrame, key: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.concat(F.lit("\u0003"), key.cast("string")).alias("key"), line.alias("line"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write(report: DataFrame, path: str) -> None:
    report.repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("line").write.mode("overwrite").text(path)


def text(report: DataFrame) -> str:
    """The report as one text, for those that fit the driver."""
    return "\n".join(r.line for r in report.orderBy("section", "key").collect())


def shown_rank(r: Column) -> Column:
    return F.coalesce(r.cast("string"), F.lit(f">{runs.DEPTH}"))


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("**no**")


def _quality(rows: DataFrame, by: list[Column], r: Column) -> DataFrame:
    rate = lambda k: labels.rate(F.count_if(evaluate.hit_at(r, k)), F.count(F.lit(1))).alias(f"hit_{k}")
    return rows.groupBy(*by).agg(*(rate(k) for k in evaluate.CUTOFFS), F.format_number(F.coalesce(F.avg(evaluate.reciprocal(r)), F.lit(0.0)), 3).alias("mrr"))


def _by_mode(run: DataFrame, tag: str = "") -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(f"{m}{tag}").alias("mode"), F.col(f"ranks.{m}").alias("r")) for m in MODES))).alias("x")
    return run.filter("answerable").select(each).select("x.*")


QUALITY_HEAD = ("list", *(f"Hit@{k}" for k in evaluate.CUTOFFS), f"MRR@{evaluate.MRR_CUTOFF}")


def retrieval_report(run: DataFrame, label: str, cutoff: float = 0.51) -> DataFrame:
    """Ranking quality, contexts, breakdowns, the low-confidence cutoff, and a row per question."""
    spark = run.sparkSession
    asked = run.filter("answerable")
    quality = _quality(_by_mode(run), [F.col("mode")], F.col("r"))
    configs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("config")) for i, c in enumerate(evaluate.CONFIGS)))).alias("c")
    sent = F.get(F.filter("sent", lambda s: s["config"] == F.col("c.config")), F.lit(0))["n"]
    context = asked.select("found", "fully", "sent", configs).groupBy("c.i", "c.config").agg(
        labels.rate(F.count_if(F.array_contains("found", F.col("c.config"))), F.count(F.lit(1))).alias("found"), labels.rate(F.count_if(F.array_contains("fully", F.col("c.config"))), F.count(F.lit(1))).alias("fully"), F.format_number(F.coalesce(F.avg(sent), F.lit(0.0)), 1).alias("sent"),
    )
    label_of = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("doc", "question_type", "wording")))).alias("l")
    broken_down = asked.select("ranks", "found", "fully", label_of).groupBy("l.kind", "l.value").agg(
        F.count(F.lit(1)).alias("n"), *(labels.rate(F.count_if(evaluate.hit_at(F.col(f"ranks.{m}"), evaluate.HEADLINE)), F.count(F.lit(1))).alias(m) for m in MODES),
        labels.rate(F.count_if(F.array_contains("found", runs.FULL)), F.count(F.lit(1))).alias("found"), labels.rate(F.count_if(F.array_contains("fully", runs.FULL)), F.count(F.lit(1))).alias("fully"),
    )
    flagged = run.groupBy("answerable").agg(labels.rate(F.count_if(F.col("best_cosine") < cutoff), F.count(F.lit(1))).alias("flagged"), F.format_number(F.min("best_cosine"), 3).alias("least"), F.format_number(F.max("best_cosine"), 3).alias("most"))
    best = evaluate.best_threshold(run.select(F.col("best_cosine").alias("score"), "answerable"))
    return together(
        lines(spark, 1, f"# Retrieval: {label}", "", "## Ranking (answerable questions)", ""), table(1, quality, F.col("mode"), F.col("mode"), *(F.col(f"hit_{k}") for k in evaluate.CUTOFFS), F.col("mrr"), head=QUALITY_HEAD),
        lines(spark, 2, "", "## Passages sent", ""), table(2, context, F.col("i"), F.col("config"), F.col("found"), F.col("fully"), F.col("sent"), head=("configuration", "found", "fully supported", "average sent")),
        lines(spark, 3, "", "## By label", ""), table(3, broken_down, F.concat("kind", "value"), F.concat("kind", F.lit("="), "value"), F.col("n"), *(F.col(m) for m in MODES), F.col("found"), F.col("fully"), head=("label", "n", *(f"{m} Hit@{evaluate.HEADLINE}" for m in MODES), "found", "fully supported")),
        lines(spark, 4, "", f"## Low confidence (now {cutoff})", ""), table(4, flagged, F.col("answerable"), F.when(F.col("answerable"), "answerable").otherwise("unanswerable"), F.col("flagged"), F.col("least"), F.col("most"), head=("questions", "flagged", "least", "greatest")),
        listed(5, best, F.lit("0"), F.concat(F.lit("\nBest here: "), F.col("threshold").cast("string"), F.lit(", flags "), F.col("flagged").cast("string"), F.lit("/"), F.col("unanswerable").cast("string"), F.lit(" unanswerable and "), F.col("false_alarms").cast("string"), F.lit("/"), F.col("answerable").cast("string"), F.lit(" answerable"))),
        lines(spark, 6, "", "## Questions", ""), table(6, asked, F.col("qid"), F.col("qid"), F.col("wording"), *(shown_rank(F.col(f"ranks.{m}")) for m in MODES), yes_no(F.array_contains("found", runs.FULL)), yes_no(F.array_contains("fully", runs.FULL)), F.format_number("best_cosine", 3), head=("id", "wording", *MODES, "found", "fully supported", "best cosine")),
    )


def comparison_report(base: DataFrame, new: DataFrame, base_label: str, new_label: str) -> DataFrame:
    """The verdict on a new run, ranking quality of both, and a row per question; refused for runs on different questions."""
    spark = base.sparkSession
    both = runs.compared(base, new)
    v = runs.verdict(both)
    said = F.concat(
        F.lit(f"{new_label} against {base_label}: fixed "), F.col("wins").cast("string"), F.lit(", broke "), F.col("losses").cast("string"), F.lit(", same "), F.col("ties").cast("string"),
        F.lit("; questions on amendments that lost full support: "), F.col("broken").cast("string"), F.when(F.col("ships"), f"\n\n**{new_label} ships**").otherwise(f"\n\n**keep {base_label}**"),
    )
    quality = _quality(_by_mode(base, f" ({base_label})").unionByName(_by_mode(new, f" ({new_label})")), [F.col("mode")], F.col("r"))
    per = both.select("qid", "wording", *(F.col(f"{side}.ranks.{m}").alias(f"{side}_{m}") for m in ("dense", "hybrid") for side in ("base", "new")))
    return together(
        lines(spark, 1, f"# {base_label} and {new_label}", ""), listed(1, v, F.lit("0"), said),
        lines(spark, 2, "", "## Ranking", ""), table(2, quality, F.col("mode"), F.col("mode"), *(F.col(f"hit_{k}") for k in evaluate.CUTOFFS), F.col("mrr"), head=QUALITY_HEAD),
        lines(spark, 3, "", "## Questions", ""), table(3, per, F.col("qid"), F.col("qid"), F.col("wording"), *(shown_rank(F.col(f"{side}_{m}")) for m in ("dense", "hybrid") for side in ("base", "new")), head=("id", "wording", *(f"{m} {label}" for m in ("dense", "hybrid") for label in (base_label, new_label)))),
    )


def printed_pages(pages: Column, pdf_pages: Column, printed: Column) -> Column:
    """Printed pages of some PDF pages of a passage: by place where both lists go together, else all printed pages."""
    at = F.transform(F.filter(pages, lambda p: F.array_contains(pdf_pages, p)), lambda p: F.get(printed, F.array_position(pdf_pages, p).cast("int") - 1))
    return F.when(F.size(pdf_pages) == F.size(printed), at).otherwise(printed)


def label_counts(gold: DataFrame) -> DataFrame:
    """(label, n): questions per document, type and wording."""
    each = F.explode(F.array(*(F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit(""))) for name, c in (("doc", F.col("doc")), ("type", F.col("question_type")), ("wording", F.col("wording")))))).alias("label")
    return gold.select(each).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def checking_sheet(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """A block of lines per question: what is expected, and where to look for each passage of evidence."""
    spark = gold.sparkSession
    of = chunks.select("chunk_id", F.col("doc_title").alias("c_title"), F.col("pdf_pages").alias("c_pdf"), F.col("printed_pages").alias("c_printed"))
    ev = gold.select("id", F.posexplode("evidence").alias("k", "e")).select("id", "k", "e.*").join(of, "chunk_id", "left")
    strings = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ", ")
    printed = strings(printed_pages(F.col("pdf_pages"), F.col("c_pdf"), F.col("c_printed")))
    where = F.concat(F.lit("- **Look at:** "), F.coalesce("c_title", F.lit("?")), F.lit(", "), F.coalesce("section", F.lit("")), F.lit(", PDF p. "), strings(F.col("pdf_pages")), F.when(F.coalesce(printed, F.lit("")) != "", F.concat(F.lit(" (printed p. "), printed, F.lit(")"))).otherwise(""), F.lit("\n  > "), F.coalesce("quote", F.lit("")))
    found = ev.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", where.alias("line")))), lambda x: x["line"]), "\n").alias("evidence_lines"))
    rows = gold.join(found, "id", "left")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    block = F.concat_ws(
        "\n", F.concat(F.lit("## "), "id", F.lit(" - "), "question_type", F.lit(", "), "wording", F.lit(" wording\n")), F.concat(F.lit("- [ ] **Q:** "), F.coalesce("question", F.lit(""))), F.concat(F.lit("- **Expected answer:** "), F.coalesce("answer", F.lit(""))),
        part("- **Must state:** ", F.array_join("must_include", ", ")), F.col("evidence_lines"), part("- *Why this question:* ", F.col("note")), F.lit(""),
    )
    return together(lines(spark, 1, "# Evaluation questions: checking sheet", "", "Open each page, find the quote, and see whether the expected answer is right and complete.", ""), listed(2, rows, F.col("id"), block))


def pairs_report(kept: DataFrame, dropped: DataFrame, chunks: DataFrame, sample: int = 20, examples: int = 3) -> DataFrame:
    """Counts by reason, a sample of kept pairs spread over the list (query, chunk_id, negative_id), and examples of dropped ones (query, chunk_id, reason). A top-k report: sample and examples are its size."""
    spark = kept.sparkSession
    n, lost = kept.count(), dropped.count()
    reasons = dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    step = max(1, n // sample)
    some = numbered(kept, "query", "chunk_id").filter((F.col("n0") % step == 0) & (F.col("n0") < step * sample))
    cite = chunks.select("chunk_id", labels.citation().alias("cited"))
    some = some.join(cite.select("chunk_id", F.col("cited").alias("passage")), "chunk_id", "left").join(cite.select(F.col("chunk_id").alias("negative_id"), F.col("cited").alias("negative")), "negative_id", "left")
    few = dropped.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("query", "chunk_id"))).filter(F.col("k") <= examples)
    share = f" ({round(100 * n / (n + lost))}%)" if n + lost else ""
    return together(
        lines(spark, 1, "# Training pairs", "", f"Kept {n} of {n + lost}{share}.", ""), table(1, reasons, F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0"), F.col("reason"), F.col("n"), head=("dropped because", "count")),
        lines(spark, 2, "", "## Kept", ""), listed(2, some, F.lpad(F.col("n0").cast("string"), 12, "0"), F.concat(F.lit("- **"), "query", F.lit("** | "), F.coalesce("passage", "chunk_id"), F.lit(" | "), F.coalesce("negative", "negative_id", F.lit("-")))),
        lines(spark, 3, "", "## Dropped", ""), listed(3, few, F.concat(F.coalesce("reason", F.lit("")), F.lpad(F.col("k").cast("string"), 4, "0")), F.concat(F.lit("- *"), F.coalesce("reason", F.lit("none")), F.lit("*: "), F.coalesce("query", F.lit("")), F.lit(" ["), F.coalesce("chunk_id", F.lit("")), F.lit("]"))),
    )


def lost_tails(chunks: DataFrame, window: int = 512, room: int = 2) -> DataFrame:
    """(chunk_id, tail): the tokens of a passage's indexed text that an embedder with `window` tokens never sees, joined by blanks."""
    tokens = F.regexp_extract_all(labels.index_text(), F.lit(tx.COUNTED), F.lit(0))
    sized = chunks.select("chunk_id", tokens.alias("tokens")).filter(F.size("tokens") > window - room)
    return sized.select("chunk_id", F.array_join(F.slice("tokens", window - room + 1, F.size("tokens")), " ").alias("tail"))
