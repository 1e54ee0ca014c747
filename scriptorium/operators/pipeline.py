"""Questions to checked answers, in batch: search, prompt, model, citation check, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import cite, prompt, rank
from scriptorium.operators.search import Ranked
from scriptorium.sources import model as models

FALLBACK = "Most relevant passages (no generated answer):"


def ask(ranked: Ranked, model=None, mode: str = "hybrid", top_k: int = 6, use_model: bool = True) -> DataFrame:
    """(qid, answer, mode, cited, invalid, uncited_sentences, ungrounded, warnings, seconds), one row per question.

    Where no model answers, the answer is the fallback, the mode 'retrieval-only', and a warning says why (none if models were switched off).
    """
    hits = ranked.hits(mode, top_k)
    blocks = prompt.source_blocks(hits, ranked.corpus.chunks)
    confidence = rank.best_cosine(ranked.queries, ranked.dense)
    sources = blocks.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("sources"))
    model = model or models.NoModel()
    reason = None
    if use_model and not model.available():
        reason = f"LLM backend '{model.model}' is not reachable"
    base = ranked.queries.join(sources, "qid", "left").join(confidence, "qid")
    if not use_model or reason:
        rows = base.withColumn("raw", F.lit(None).cast("string")).withColumn("why", F.lit(reason).cast("string")).withColumn("seconds", F.lit(0.0))
    else:
        replies = models.complete(prompt.prompts(ranked.queries, blocks), model, prompt.RULES)
        rows = base.join(replies, "qid", "left").withColumn("raw", tx.tidy_answer(F.col("answer"))).withColumn("why", F.when(F.col("answer").isNull(), F.concat(F.lit("LLM error ("), F.coalesce("error", F.lit("no reply")), F.lit(")"))))
    rows = rows.select(F.col("qid").alias("aid"), "question", "sources", "low_confidence", "best_cosine", "raw", "why", "seconds")
    report = cite.check_citations(rows.select("aid", F.coalesce("raw", F.lit(tx.NOT_FOUND)).alias("answer"), "question", "sources"))
    checked = rows.join(report, "aid")
    told = cite.warnings(checked)
    out = checked.join(told, "aid")
    extra = F.when(F.col("why").isNotNull(), F.array(F.concat("why", F.lit("; showing retrieved passages only.")))).otherwise(F.array().cast("array<string>"))
    # The warning on confidence comes first, then the one on the model, then those on citations.
    low = F.filter("warnings", lambda w: F.startswith(w, F.lit("Low retrieval confidence")))
    others = F.filter("warnings", lambda w: ~F.startswith(w, F.lit("Low retrieval confidence")))
    return out.select(
        F.col("aid").alias("qid"), F.coalesce("raw", F.lit(FALLBACK)).alias("answer"), F.when(F.col("raw").isNull(), "retrieval-only").otherwise("generated").alias("mode"),
        "cited", "invalid", "uncited_sentences", "ungrounded", F.concat(low, extra, others).alias("warnings"), "seconds",
    )
