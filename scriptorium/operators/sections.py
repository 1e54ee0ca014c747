"""Numbered documents: from blocks in reading order to clauses, tables and appendices, their titles, and passages.

A block may hold several clause numbers, and scans produce stray ones. A number opens a clause only if it may follow the last one that did
(`text.is_successor`); tables count on by themselves, an appendix starts a count of its own. The places that may open
something are few beside the text; per stretch between two appendices they are folded in order, as small structs, on the JVM.

Defined results: text before the first number belongs to a unit `Foreword`; blocks without text vanish; a document without numbers is one
unit; ties of (page, order) don't arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import labels, text as tx
from scriptorium.operators import pack
from scriptorium.operators.ordered import Ordered

#: Forms of numbers and headings. Fixed values.
KEY = r"(?:[A-D]-)?[\dlI]{1,2}(?:\.\d{1,2}){0,4}"
NUMBER = rf"{KEY}\.?\s+[A-Z(]"
TABLE, APPENDIX = r"^TABLE\s+(\d{1,2})\b\s*(.*)", r"^APPENDIX\s+([A-D])\b\s*(.*)"
#: A table may be this much further than the last one.
TABLE_GAP = 3
NO_KEY = "array<int>"


def pieces(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, piece, page, text): blocks cut before everything that looks like a clause number; headings of tables and appendices stay whole."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    cut = F.when(text.rlike(TABLE) | text.rlike(APPENDIX), F.array(text)).otherwise(F.split(text, rf"(?<=^|\s)(?={NUMBER})"))
    each = blocks.select("doc_id", "ord", "page", F.posexplode(F.filter(cut, lambda x: F.trim(x) != "")).alias("piece", "text"))
    return each.select("doc_id", "ord", "piece", "page", F.trim("text").alias("text"))


def candidates(rows: DataFrame) -> DataFrame:
    """Adds what a piece may open: `table` number, `appendix` letter as a number from 101, or clause `key`, with `top` for a lone number that isn't printed as a heading."""
    key = tx.clause_key(F.regexp_extract("text", rf"^({KEY})", 1))
    dotted = F.col("text").rlike(rf"^{KEY}\.\s+[A-Z]{{3,}}\b")
    is_clause = F.col("text").rlike(rf"^{NUMBER}")
    return rows.select(
        "*", F.nullif(F.regexp_extract("text", TABLE, 1), F.lit("")).cast("int").alias("table"),
        F.when(F.col("text").rlike(APPENDIX), F.ascii(F.regexp_extract("text", APPENDIX, 1)) - 65 + 101).alias("appendix"),
        F.when(is_clause & (F.size(key) > 0), key).alias("key"), (is_clause & (F.size(key) == 1) & ~dotted).alias("top"),
    )


def accepted(rows: DataFrame, gap: int = 2) -> DataFrame:
    """(doc_id, ord, piece, table, appendix, key): the candidates that open something."""
    some = rows.filter("table IS NOT NULL OR appendix IS NOT NULL OR key IS NOT NULL").select("doc_id", "ord", "piece", "table", "appendix", "key", "top")
    # Clause numbers start anew at an appendix; tables count on over the whole document, so they are folded by themselves.
    placed = Ordered.of(some, ["doc_id"], ["ord", "piece"]).running(F.col("appendix").isNotNull().cast("int"), "stretch").done()

    def clauses(found: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("last"), F.array().cast("array<boolean>").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            opens = F.coalesce(~c["top"] & tx.is_successor(acc["last"], c["key"], gap), F.lit(False))
            last = F.when(c["appendix"].isNotNull(), F.array(c["appendix"])).when(opens, c["key"]).otherwise(acc["last"])
            return F.struct(last.alias("last"), F.concat(acc["out"], F.array(opens | c["appendix"].isNotNull())).alias("out"))

        return F.aggregate(found, start, step, lambda acc: acc["out"])

    def tables(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<boolean>").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            opens = (c["table"] > acc["last"]) & (c["table"] <= acc["last"] + TABLE_GAP)
            return F.struct(F.when(opens, c["table"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(opens)).alias("out"))

        return F.aggregate(found, start, step, lambda acc: acc["out"])

    def folded(part: DataFrame, by: list[str], fold) -> DataFrame:
        held = part.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "piece", "table", "appendix", "key", "top"))).alias("found"))
        opened = F.filter(F.zip_with("found", fold(F.col("found")), lambda c, o: F.struct(c.alias("c"), o.alias("o"))), lambda x: x["o"])
        return held.select("doc_id", F.explode(opened).alias("x")).select("doc_id", "x.c.ord", "x.c.piece", "x.c.table", "x.c.appendix", "x.c.key")

    return folded(placed.filter("table IS NULL"), ["doc_id", "stretch"], clauses).unionByName(folded(placed.filter("table IS NOT NULL"), ["doc_id"], tables))


def label_of(table: Column, appendix: Column, key: Column) -> Column:
    """'Table 5', 'Appendix B', 'Cl. 5.3.2' or 'Cl. C-2.1'."""
    return F.when(table.isNotNull(), F.concat(F.lit("Table "), table.cast("string"))).when(appendix.isNotNull(), F.concat(F.lit("Appendix "), F.char(appendix - 101 + 65))).otherwise(F.concat(F.lit("Cl. "), tx.key_label(key)))


def group_of(unit_key: Column) -> Column:
    """Units merge only within the same top-level clause or appendix; a table is a group of its own."""
    body = F.regexp_replace(unit_key, r"^Cl\. ", "")
    inner = F.when(F.contains(body, F.lit("-")), F.substring_index(body, "-", 1)).otherwise(F.substring_index(body, ".", 1))
    return F.when(F.startswith(unit_key, F.lit("Table")), unit_key).when(F.startswith(unit_key, F.lit("Appendix")), F.substring(unit_key, -1, 1)).when(unit_key == "Foreword", "0").otherwise(inner)


def title_of(unit_key: Column, text: Column) -> Column:
    """Heading of a unit from the text it opens with: after a table's or appendix's number, up to a dash within ten words, leading words in capitals, or a text of at most eight words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    before_dash = F.regexp_extract(text, r"^(.*?)\s[-–]\s", 1)
    capitals = F.filter(F.slice(words, 1, 12), lambda w: (w == F.upper(w)) & w.rlike("[A-Za-z]"))
    leading = F.slice(words, 1, F.greatest(F.size(capitals), F.lit(1))) == capitals
    after = F.substring(F.coalesce(F.nullif(F.regexp_extract(text, TABLE, 2), F.lit("")), F.regexp_extract(text, APPENDIX, 2)), 1, 120)
    return (
        F.when(unit_key.rlike("^(?:Table|Appendix) "), after).when((before_dash != "") & (tx.word_count(before_dash) <= 10), F.trim(before_dash))
        .when((F.size(capitals) >= 2) & leading, F.array_join(capitals, " ")).when(F.size(words) <= 8, text).otherwise("")
    )


def units_of(blocks: DataFrame, gap: int = 2, offset: int = 0, replaced: tuple[str, ...] = ()) -> DataFrame:
    """Units (unit_id, doc_id, unit_key, unit_group, title, paragraphs, mergeable) of blocks (doc_id, ord, page, text); printed pages are `offset` lower.

    Units named in `replaced` are left out: their text comes from elsewhere.
    """
    cut = pieces(blocks)
    opened = accepted(candidates(cut), gap)
    opened = opened.select("doc_id", "ord", "piece", label_of(F.col("table"), F.col("appendix"), F.col("key")).alias("opens"), F.col("key").isNotNull().alias("is_clause"))
    rows = cut.join(opened, ["doc_id", "ord", "piece"], "left")
    rows = Ordered.of(rows, ["doc_id"], ["ord", "piece"]).running(F.col("opens").isNotNull().cast("int"), "unit_no").filled(F.col("opens"), "unit_key").done()
    body = F.when(F.col("opens").isNotNull() & F.col("is_clause"), F.regexp_replace("text", rf"^{KEY}\.?\s+", "")).otherwise(F.col("text"))
    rows = rows.select("doc_id", "ord", "piece", "page", "unit_no", F.coalesce("unit_key", F.lit("Foreword")).alias("unit_key"), body.alias("text"), F.col("opens").isNotNull().alias("starts"))
    # What a block goes on with after a stray number is one paragraph with what stands before it.
    para = rows.groupBy("doc_id", "unit_no", "unit_key", "ord", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), " ").alias("text"))
    para = para.filter(F.trim("text") != "")
    held = F.array_sort(F.collect_list(F.struct("ord", F.col("text").alias("text"), F.col("page").alias("pdf_page"), (F.col("page") - offset).cast("string").alias("printed_page"))))
    units = para.groupBy("doc_id", "unit_no", "unit_key").agg(held.alias("held"))
    paragraphs = F.transform("held", lambda h: F.struct(h["text"].alias("text"), h["pdf_page"].cast("int").alias("pdf_page"), h["printed_page"].alias("printed_page")))
    first = F.element_at("held", 1)["text"]
    title = F.when(F.col("unit_key") == "Foreword", "Foreword").otherwise(title_of(F.col("unit_key"), first))
    out = units.filter(~F.col("unit_key").isin(list(replaced)) if replaced else F.lit(True))
    return out.select(
        F.col("unit_no").alias("unit_id"), "doc_id", "unit_key", group_of(F.col("unit_key")).alias("unit_group"), title.alias("title"), paragraphs.alias("paragraphs"), (~F.startswith("unit_key", F.lit("Table"))).alias("mergeable"),
    )


def window_label(keys: Column, part_no: Column, part_count: Column) -> Column:
    """'Cl. 5.3.2', 'Cl. 5.3.2-5.3.2.2', 'Appendix B, Cl. B-1', 'Table 5 (part 1/2)'."""
    first, last = F.element_at(keys, 1), F.element_at(keys, -1)
    both = F.when(F.startswith(first, F.lit("Cl.")) & F.startswith(last, F.lit("Cl.")), F.concat(first, F.lit("-"), F.regexp_replace(last, r"^Cl\. ", "")))
    name = F.when(first == last, first).otherwise(F.coalesce(both, F.concat(first, F.when(F.size(keys) == 2, ", ").otherwise(" to "), last)))
    return F.when(part_count > 1, F.concat(name, F.lit(" (part "), part_no.cast("string"), F.lit("/"), part_count.cast("string"), F.lit(")"))).otherwise(name)


def section_titles(units: DataFrame) -> DataFrame:
    """(doc_id, unit_group, part): '5. Wind Speed and Pressure' for each top-level clause with a title."""
    number = F.regexp_extract("unit_key", r"^Cl\. (\d+)$", 1)
    named = units.filter((number != "") & (F.col("title") != "")).select("doc_id", number.alias("unit_group"), F.concat(number, F.lit(". "), F.initcap("title")).alias("part"))
    return named.groupBy("doc_id", "unit_group").agg(F.max("part").alias("part"))


def passages(blocks: DataFrame, doc_title: str, gap: int = 2, offset: int = 0, replaced: tuple[str, ...] = (), budget: int = pack.MAX_TOKENS) -> DataFrame:
    """Passages of numbered documents: blocks to units, units to windows, windows to rows of the passage table (without pos)."""
    units = units_of(blocks, gap, offset, replaced)
    windows = pack.windows_of(units, budget)
    label = window_label(F.col("keys"), F.col("part_no"), F.col("part_count"))
    last = F.element_at("keys", -1)
    named = windows.withColumn("section", label).withColumn("unit_group", group_of(last)).join(section_titles(units), ["doc_id", "unit_group"], "left")
    part = (
        F.when(last == "Foreword", "Foreword").when(F.startswith(last, F.lit("Table")), "Tables").when(F.startswith(last, F.lit("Appendix")), "Appendices")
        .otherwise(F.coalesce("part", F.when(F.col("unit_group").rlike(r"^\d+$"), F.when(F.col("unit_group") == "0", "Foreword").otherwise("")).otherwise("Appendices")))
    )
    return named.select(
        F.concat("doc_id", F.lit(":"), tx.slug(F.col("section"))).alias("chunk_id"), "doc_id", F.lit(doc_title).alias("doc_title"), "section", F.array_join(F.col("paragraphs.text"), "\n").alias("text"),
        F.array_sort(F.array_distinct("paragraphs.pdf_page")).alias("pdf_pages"), F.array_distinct("paragraphs.printed_page").alias("printed_pages"), "title", part.alias("part"), F.array_distinct("keys").alias("covers"),
        F.lit(False).alias("is_amendment"), F.array().cast("array<string>").alias("amends"), F.lit("pdf").alias("source"), F.lit("").alias("parent"), "first_unit", "part_no",
    )


def breadcrumbs(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", labels.breadcrumb().alias("breadcrumb"))
