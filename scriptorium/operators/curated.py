"""Hand-made content: split tables, amendments, and names that have changed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as tx


def annotate(text: Column, aliases: dict[str, str], legend: str = "") -> Column:
    """'old' as a whole word becomes 'old [now new]' unless that is there already; the legend follows where something changed."""
    out = text
    for old, new in aliases.items():
        out = F.regexp_replace(out, rf"\b{re.escape(old)}\b(?! \[now )", f"{old} [now {new}]")
    return F.when((out != text) & F.lit(bool(legend)), F.concat(out, F.lit("\n" + legend))).otherwise(out)


def table_parts(tables: DataFrame) -> DataFrame:
    """(section, title, text, parent) from (section, title, text, header, parts array<struct<label,text>>, footer): one row per part, or per table that isn't split."""
    whole = tables.filter(F.coalesce(F.size("parts"), F.lit(0)) <= 0).select("section", "title", "text", F.lit("").alias("parent"))
    each = tables.select("section", "title", "header", "footer", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part"))
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    return whole.unionByName(each.select(
        F.concat("section", F.lit(" (part "), (F.col("i") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")")).alias("section"),
        F.concat("title", F.lit(" ("), F.col("part.label"), F.lit(")")).alias("title"),
        F.concat_ws("\n\n", blank("header"), F.col("part.text"), blank("footer")).alias("text"), F.col("section").alias("parent"),
    ))


#: How the explanation of an amendment is marked. Fixed value.
EXPLANATION = "[Curator's explanation: "
TABLES = "section STRING, title STRING, part STRING, pdf_pages ARRAY<INT>, printed_pages ARRAY<STRING>, covers ARRAY<STRING>, text STRING, header STRING, parts ARRAY<STRUCT<label: STRING, text: STRING>>, footer STRING"
AMENDMENTS = "number INT, date STRING, pdf_pages ARRAY<INT>, items ARRAY<STRUCT<amends: ARRAY<STRING>, text: STRING, explanation: STRING>>"


def amendment_items(amendments: DataFrame, doc_id: str, doc_title: str) -> DataFrame:
    """A passage per item of (number, date, pdf_pages, items array<struct<amends,text,explanation>>)."""
    each = amendments.select("number", "date", "pdf_pages", F.posexplode("items").alias("i", "item"))
    name = F.concat(F.lit("Amendment No. "), F.col("number").cast("string"))
    dated = F.concat(name, F.lit(" ("), "date", F.lit(")"))
    place = (F.col("i") + 1).cast("string")
    note = F.nullif(F.coalesce(F.col("item.explanation"), F.lit("")), F.lit(""))
    said = F.concat(dated, F.lit(f" to {doc_title}. "), F.col("item.text"), F.when(note.isNotNull(), F.concat(F.lit(" " + EXPLANATION), note, F.lit("]"))).otherwise(""))
    amends = F.coalesce(F.col("item.amends"), F.array().cast("array<string>"))
    targets = F.when(F.size(amends) > 0, F.array_join(amends, ", ")).otherwise("all clauses")
    empty = F.array().cast("array<string>")
    return each.select(
        F.concat(F.lit(f"{doc_id}:amd"), F.col("number").cast("string"), F.lit(":item-"), place).alias("chunk_id"), F.lit(doc_id).alias("doc_id"), F.lit(doc_title).alias("doc_title"), F.concat(name, F.lit(", item "), place).alias("section"),
        said.alias("text"), "pdf_pages", empty.alias("printed_pages"), F.concat(dated, F.lit(" - amends "), targets).alias("title"), F.lit("Amendments").alias("part"), empty.alias("covers"), F.lit(True).alias("is_amendment"), amends.alias("amends"), F.lit("curated").alias("source"), F.lit("").alias("parent"),
    )


def passages(tables: DataFrame, amendments: DataFrame, doc_id: str, doc_title: str, aliases: dict[str, str] | None = None, apply_to: tuple[str, ...] = (), legend: str = "") -> DataFrame:
    """Passages of hand-made tables (TABLES) and amendments (AMENDMENTS). Names that have changed are noted in the sections of `apply_to`; one that isn't there is an error."""
    unknown = set(apply_to) - {r.section for r in tables.filter(F.col("section").isin(list(apply_to))).select("section").distinct().collect()}  # at most len(apply_to) names
    if unknown:
        raise ValueError(f"aliases apply to unknown sections {sorted(unknown)}")
    noted = lambda t: F.when(F.col("section").isin(list(apply_to)), annotate(t, aliases or {}, legend)).otherwise(t)
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    rows = tables.withColumn("text", noted(bare(F.col("text")))).withColumn("header", bare(F.col("header"))).withColumn("footer", bare(F.col("footer")))
    rows = rows.withColumn("parts", F.transform("parts", lambda p: F.struct(p["label"].alias("label"), noted(bare(p["text"])).alias("text"))))
    own = tables.select(F.col("section").alias("of"), F.coalesce("part", F.lit("")).alias("part"), "pdf_pages", F.coalesce("printed_pages", F.array().cast("array<string>")).alias("printed_pages"), F.coalesce("covers", F.array("section")).alias("covers"))
    each = table_parts(rows).withColumn("of", F.when(F.col("parent") == "", F.col("section")).otherwise(F.col("parent"))).join(own, "of")
    made = each.select(
        F.concat(F.lit(f"{doc_id}:curated:"), tx.slug(F.col("section"))).alias("chunk_id"), F.lit(doc_id).alias("doc_id"), F.lit(doc_title).alias("doc_title"), "section", "text", "pdf_pages", "printed_pages", "title", "part", "covers",
        F.lit(False).alias("is_amendment"), F.array().cast("array<string>").alias("amends"), F.lit("curated").alias("source"), "parent",
    )
    return made.unionByName(amendment_items(amendments, doc_id, doc_title))


def absorb(chunks: DataFrame, provisions: DataFrame) -> DataFrame:
    """Adds provisions (provision, host, signature) to `covers` of the passages that cover their host and match their pattern. Provisions without any passage raise."""
    hosts = chunks.select("pos", "text", F.explode(F.array_distinct("covers")).alias("host"))
    rows = hosts.join(provisions.select("provision", "host", "signature"), "host").filter(F.regexp_like("text", F.concat(F.lit("(?i)"), "signature")))
    found = rows.groupBy("pos").agg(F.array_sort(F.collect_set("provision")).alias("more"))
    lost = provisions.join(rows.select("provision").distinct(), "provision", "left_anti").limit(10).collect()
    if lost:
        raise ValueError(f"no passage holds {[r.provision for r in lost]}")
    return chunks.join(found, "pos", "left").withColumn("covers", F.when(F.col("more").isNull(), F.col("covers")).otherwise(F.array_union("covers", "more"))).drop("more")
