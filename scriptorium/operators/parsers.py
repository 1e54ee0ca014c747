"""Two kinds of documents from positioned blocks to passages: judgments with numbered paragraphs, and contracts with parts, clauses and items.

Blocks are (doc_id, ord, page, x0, y0, x1, y1, text), text with line feeds, `ord` without ties in a document; a reader of PDF or HTML gives them. Everything
along the order of a document goes by `Ordered`; what is folded are short arrays of numbers.

Defined results: blocks without text vanish; a document without numbered paragraphs or clauses is one unit; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import pack
from scriptorium.operators.ordered import Ordered


def _lines(text: Column, drop: str | None = None) -> Column:
    """Lines of a block that aren't blank, rulers, or in a font that wasn't mapped; `drop` is a pattern of further ones."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: (x != "") & ~tx.is_ruler(x) & ~tx.looks_broken(x))
    return F.filter(kept, lambda x: ~x.rlike(drop)) if drop else kept


def _reversed(rows: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """Adds next_<c>: the values of the row after."""
    turned = Ordered.of(rows.withColumn("__turned", -F.col(order)), [by], ["__turned"]).previous(*columns).done().drop("__turned", "is_first")
    return turned.select("*", *(F.col(f"previous_{c}").alias(f"next_{c}") for c in columns)).drop(*(f"previous_{c}" for c in columns))


def _passage(doc_title: str, part: Column, section: Column, chunk_id: Column, covers: Column) -> list[Column]:
    empty = F.array().cast("array<string>")
    return [
        chunk_id.alias("chunk_id"), F.col("doc_id"), F.lit(doc_title).alias("doc_title"), section.alias("section"), F.array_join(F.col("paragraphs.text"), "\n").alias("text"),
        F.array_sort(F.array_distinct("paragraphs.pdf_page")).alias("pdf_pages"), F.array_distinct("paragraphs.printed_page").alias("printed_pages"), F.col("title"), part.alias("part"), covers.alias("covers"),
        F.lit(False).alias("is_amendment"), empty.alias("amends"), F.lit("pdf").alias("source"), F.lit("").alias("parent"),
    ]


# Judgments


@dataclass(frozen=True)
class Judgment:
    """Places of a judgment's layout, in points, and its names."""

    title: str
    part: str = ""
    body: float = 110
    stamp: float = 99
    foot: float = 760
    indent: float = 10
    gap: float = 38
    heading_words: int = 15
    header: str = "Case details"


def judgment_groups(blocks: DataFrame, look: Judgment) -> DataFrame:
    """(doc_id, grp, page, x0, lines): neighbouring lines of one indent on one page, without stamp, page number and signature lines."""
    kept = blocks.filter((F.col("y0") <= look.foot) & (F.col("x1") > look.stamp)).select("doc_id", "ord", "page", "x0", "y0", _lines(F.col("text"), r"^[.…\s]*J\.?$").alias("lines")).filter(F.size("lines") > 0)
    starts = F.col("lines")[0].rlike(r"^\d{1,3}\.$") & (F.col("x0") < look.body)
    moved = (F.col("page") != F.col("previous_page")) | (F.abs(F.col("x0") - F.col("previous_x0")) > look.indent) | (F.col("y0") - F.col("previous_y0") > look.gap)
    grouped = Ordered.of(kept, ["doc_id"], ["ord"]).previous("page", "x0", "y0").islands(starts | moved, "grp").done()
    held = grouped.groupBy("doc_id", "grp").agg(F.min("page").alias("page"), F.min_by("x0", "ord").alias("x0"), F.array_sort(F.collect_list(F.struct("ord", "lines"))).alias("held"))
    return held.select("doc_id", "grp", "page", "x0", F.flatten(F.transform("held", lambda h: h["lines"])).alias("lines"))


def judgment_units(blocks: DataFrame, look: Judgment) -> DataFrame:
    """Units (unit_id, doc_id, unit_key, unit_group, title, paragraphs, mergeable): the numbered paragraphs in their sequence, under the heading before them."""
    groups = judgment_groups(blocks, look)
    number = F.nullif(F.regexp_extract(F.col("lines")[0], r"^(\d{1,3})\.$", 1), F.lit("")).cast("int")
    some = groups.filter(number.isNotNull() & (F.col("x0") < look.body)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("grp", number.alias("n")))).alias("found"))
    # Only the next number opens a paragraph; the others are numbers in quoted passages.
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hit = x["n"] == acc["next"]
        return F.struct(F.when(hit, acc["next"] + 1).otherwise(acc["next"]).alias("next"), F.when(hit, F.concat(acc["out"], F.array(x["grp"]))).otherwise(acc["out"]).alias("out"))

    opens = some.select("doc_id", F.posexplode(F.aggregate("found", start, step, lambda acc: acc["out"])).alias("k", "grp")).select("doc_id", "grp", (F.col("k") + 1).alias("para"))
    rows = groups.join(opens, ["doc_id", "grp"], "left")
    rows = rows.withColumn("lines", F.when(F.col("para").isNotNull(), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))).withColumn("text", tx.join_lines(F.col("lines")))
    rows = _reversed(rows, "doc_id", "grp", "para")
    rows = Ordered.of(rows, ["doc_id"], ["grp"]).filled(F.col("para"), "number").done()
    heads = (
        F.col("next_para").isNotNull() & F.col("para").isNull() & F.col("number").isNotNull() & (F.col("x0") < look.body)
        & (tx.word_count(F.col("text")) <= look.heading_words) & ~F.col("text").rlike(r"[.,;:\"]$")
    )
    rows = Ordered.of(rows.withColumn("is_heading", heads), ["doc_id"], ["grp"]).filled(F.when(F.col("is_heading"), F.col("text")), "heading").done()
    body = rows.filter(~F.col("is_heading") & (F.size("lines") > 0))
    piece = F.struct("grp", "text", F.col("page").cast("int").alias("pdf_page"), F.col("page").cast("string").alias("printed_page"))
    units = body.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(piece)).alias("held"), F.coalesce(F.min_by("heading", "grp"), F.lit("")).alias("heading"))
    paragraphs = F.transform("held", lambda h: F.struct(h["text"].alias("text"), h["pdf_page"].alias("pdf_page"), h["printed_page"].alias("printed_page")))
    first = F.col("number").isNull()
    return units.select(
        F.coalesce("number", F.lit(0)).cast("long").alias("unit_id"), "doc_id", F.when(first, look.header).otherwise(F.col("number").cast("string")).alias("unit_key"),
        F.when(first, "case-details").otherwise(F.col("heading")).alias("unit_group"), F.when(first, "").otherwise(F.col("heading")).alias("title"), paragraphs.alias("paragraphs"), (~first).alias("mergeable"),
    )


def judgment_passages(blocks: DataFrame, look: Judgment, budget: int = pack.MAX_TOKENS) -> DataFrame:
    from scriptorium.functions.labels import window_label

    # Unit ids are numbers of paragraphs, so documents are packed with ids that tell them apart.
    units = judgment_units(blocks, look).withColumn("unit_id", F.xxhash64("doc_id").bitwiseAND(F.lit(~0xFFFFF)) + F.col("unit_id"))
    windows = pack.windows_of(units, budget)
    alone = F.element_at("keys", 1) == look.header
    section = F.when(alone, look.header).otherwise(window_label("¶ ", F.col("keys"), F.col("part_no"), F.col("part_count")))
    covers = F.when(alone, F.array().cast("array<string>")).otherwise(F.transform("keys", lambda k: F.concat(F.lit("¶ "), k)))
    slug = tx.slug(F.replace(section, F.lit("¶"), F.lit("p")))
    return windows.select(*_passage(look.title, F.lit(look.part), section, F.concat("doc_id", F.lit(":"), slug), covers), "first_unit", "part_no")


# Contracts


@dataclass(frozen=True)
class Contract:
    """Places of a contract's layout, in points, and its names. parts: running header (in capitals) to the name used in citations."""

    title: str
    clauses: str
    parts: dict[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    header: float = 80
    footer: str = "\u0000"
    margin_x0: float = 100
    margin_x1: float = 160
    offset: int = 2


def part_name(header: Column, parts: dict[str, str]) -> Column:
    key = F.upper(tx.normalize(F.regexp_replace(header, r"\s+", " ")))
    known = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[key] if parts else F.lit(None).cast("string")
    return F.coalesce(known, F.initcap(key))


def is_caps_title(text: Column) -> Column:
    """A short title in capitals: at most eight words, one of four letters or more, no formula."""
    return text.rlike(r"(?:^|\s)\S*(?:[A-Za-z]\S*){4}") & ~F.contains(text, F.lit("=")) & (F.upper(text) == text) & (tx.word_count(text) <= 8)


def contract_items(blocks: DataFrame, look: Contract) -> DataFrame:
    """(doc_id, ord, page, printed, part, kind, clause, text): headings and body paragraphs in order; a page without running header belongs to the part of the page before."""
    lined = blocks.select("doc_id", "ord", "page", "x0", "x1", "y1", "text", _lines(F.col("text")).alias("lines"))
    in_head = (F.col("y1") < look.header) & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~tx.is_ruler(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    in_foot = F.contains("text", F.lit(look.footer))
    printed = F.when(in_foot & F.col("lines")[0].rlike(r"^\d+$"), F.col("lines")[0])
    pages = lined.groupBy("doc_id", "page").agg(F.min_by(F.when(in_head, F.col("text")), F.when(in_head, F.col("ord"))).alias("head"), F.min_by(printed, F.when(printed.isNotNull(), F.col("ord"))).alias("printed"))
    pages = pages.withColumn("named", F.when(F.col("head").isNotNull(), part_name(F.col("head"), look.parts)))
    pages = Ordered.of(pages, ["doc_id"], ["page"]).filled(F.col("named"), "part").done()
    pages = pages.select("doc_id", "page", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("printed", (F.col("page") - look.offset).cast("string")).alias("printed"))
    rows = lined.filter((F.col("y1") >= look.header) & ~F.coalesce(in_foot, F.lit(False)) & (F.size("lines") > 0)).join(pages, ["doc_id", "page"])
    clause = tx.clause_id(F.col("lines")[0])
    whole = tx.join_lines(F.col("lines"))
    margin = F.col("part").isin(list(look.columns)) & (F.col("x0") < look.margin_x0) & (F.col("x1") < look.margin_x1) if look.columns else F.lit(False)
    heading = margin | (clause.isNull() & is_caps_title(whole))
    return rows.select(
        "doc_id", "ord", "page", "printed", "part", F.when(heading, "heading").otherwise("body").alias("kind"), F.when(~heading, clause).alias("clause"),
        F.when(~heading & clause.isNotNull(), tx.join_lines(F.slice("lines", 2, F.size("lines")))).otherwise(whole).alias("text"),
    )


def repeats_part(heading: Column, part: Column, parts: dict[str, str]) -> Column:
    """Whether a heading only says the name of its part again."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.contains(plain(part), plain(heading)) | (plain(part_name(heading, parts)) == plain(part))


def contract_sections(items: DataFrame, look: Contract) -> DataFrame:
    """Units of the clauses, and one unit for each stretch of another part; headings inside are kept in brackets, the first one in a clause is its title."""
    in_clauses = F.col("part") == look.clauses
    # The clauses go on where other parts come between; elsewhere a change of part begins a section.
    one = items.filter(in_clauses)
    one = Ordered.of(one, ["doc_id"], ["ord"]).running(F.col("clause").isNotNull().cast("int"), "no").filled(F.col("clause"), "own").done().filter("no > 0")
    firsts = one.filter("kind = 'heading'").groupBy("doc_id", "no").agg(F.min("ord").alias("title_ord"), F.min_by("text", "ord").alias("title"))
    one = one.join(firsts, ["doc_id", "no"], "left")
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    clauses = one.filter(~F.col("ord").eqNullSafe(F.col("title_ord"))).select("doc_id", "no", "ord", "page", "printed", "part", F.concat(F.lit("Clause "), "own").alias("label"), F.coalesce("title", F.lit("")).alias("title"), shown.alias("text"), F.lit(0).alias("kind_no"))
    rest = Ordered.of(items.filter(~in_clauses), ["doc_id"], ["ord"]).previous("part").islands(F.col("part") != F.col("previous_part"), "no").done()
    rest = rest.filter((F.col("kind") != "heading") | ~repeats_part(F.col("text"), F.col("part"), look.parts))
    named = F.when(F.col("clause").isNotNull(), F.concat(F.lit("Clause "), "clause", F.lit(": "), shown)).otherwise(shown)
    others = rest.select("doc_id", "no", "ord", "page", "printed", "part", F.lit("").alias("label"), F.lit("").alias("title"), named.alias("text"), F.lit(1).alias("kind_no"))
    rows = clauses.unionByName(others).filter(F.coalesce("text", F.lit("")) != "")
    piece = F.struct("ord", "text", F.col("page").cast("int").alias("pdf_page"), F.col("printed").alias("printed_page"))
    units = rows.groupBy("doc_id", "kind_no", "no", "part", "label", "title").agg(F.array_sort(F.collect_list(piece)).alias("held"))
    paragraphs = F.transform("held", lambda h: F.struct(h["text"].alias("text"), h["pdf_page"].alias("pdf_page"), h["printed_page"].alias("printed_page")))
    return units.select("doc_id", "kind_no", "no", "part", "label", "title", paragraphs.alias("paragraphs"))


#: Forms of the numbers that items open with. Fixed values.
ITEM, ITEM_CLAUSE, ARTICLE = r"^(\d{1,2}[A-Z]?)\.\s", r"^Clause (\w+):", r"^Article (\d+)\b"


def leading_int(label: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(label, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(-1))


def item_labels(windows: Column) -> Column:
    """For the windows of a section, in order, as arrays of texts: the item numbers of each, as first and last.

    Only numbers that don't fall count, so nested lists add none; a heading in brackets or an article is always of the upper level and starts the
    count anew. A window that begins inside an item names it first, as continued.
    """

    def number(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^\[+", "")
        return F.coalesce(*(F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in (ITEM, ITEM_CLAUSE, ARTICLE)))

    kind = "struct<carried:string,out:array<struct<first:string,last:string,n:int>>>"
    start = F.struct(F.lit(None).cast("string").alias("carried"), F.array().alias("out")).cast(kind)

    def window(acc: Column, texts: Column) -> Column:
        found = F.filter(F.transform(texts, lambda t, i: F.struct(number(t).alias("n"), t.rlike(r"^(?:\[|Article)").alias("upper"), (i == 0).alias("opens"))), lambda x: x["n"].isNotNull())
        inner = F.struct(acc["carried"].alias("carried"), F.array().cast("array<string>").alias("numbers"), F.lit(False).alias("opens"))

        def step(a: Column, x: Column) -> Column:
            last = F.coalesce(F.try_element_at(a["numbers"], F.lit(-1)), a["carried"])
            falls = last.isNotNull() & (leading_int(x["n"]) < leading_int(last))
            anew = x["upper"] & falls
            numbers = F.when(anew, F.array(x["n"])).when(x["upper"] | ~falls, F.concat(a["numbers"], F.array(x["n"]))).otherwise(a["numbers"])
            return F.struct(F.when(~anew, a["carried"]).alias("carried"), numbers.alias("numbers"), (a["opens"] | x["opens"]).alias("opens"))

        def closed(a: Column) -> Column:
            goes_on = a["carried"].isNotNull() & ~a["opens"]
            first = F.when(goes_on, a["carried"]).otherwise(F.try_element_at(a["numbers"], F.lit(1)))
            last = F.coalesce(F.try_element_at(a["numbers"], F.lit(-1)), F.when(goes_on, F.concat(a["carried"], F.lit(" (cont.)"))))
            n = F.size(a["numbers"]) + goes_on.cast("int")
            return F.struct(F.coalesce(F.try_element_at(a["numbers"], F.lit(-1)), acc["carried"]).alias("carried"), F.concat(acc["out"], F.array(F.struct(first.alias("first"), last.alias("last"), n.alias("n")))).alias("out"))

        return F.aggregate(found, inner, step, closed).cast(kind)

    return F.aggregate(windows, start, window, lambda acc: acc["out"])


def contract_passages(blocks: DataFrame, look: Contract, budget: int = pack.MAX_TOKENS) -> DataFrame:
    """Passages of contracts: every clause by itself, other parts in windows that name their items."""
    sections = contract_sections(contract_items(blocks, look), look)
    key = F.concat_ws("|", F.col("kind_no").cast("string"), F.lpad(F.col("no").cast("string"), 12, "0"))
    units = sections.select(F.xxhash64("doc_id", "kind_no", "no").alias("unit_id"), "doc_id", key.alias("unit_key"), key.alias("unit_group"), "title", "paragraphs", F.lit(False).alias("mergeable"))
    windows = pack.windows_of(units, budget).withColumn("key", F.element_at("keys", 1)).join(sections.select("doc_id", key.alias("key"), "part", "label", "kind_no"), ["doc_id", "key"])
    listed = windows.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("part_no", F.col("paragraphs.text").alias("texts")))).alias("held"))
    items = listed.select("doc_id", "key", F.posexplode(item_labels(F.transform("held", lambda h: h["texts"]))).alias("i", "items"))
    rows = windows.join(items.select("doc_id", "key", (F.col("i") + 1).alias("part_no"), "items"), ["doc_id", "key", "part_no"])
    first, last, n = F.col("items.first"), F.col("items.last"), F.col("items.n")
    other = F.when(n == 0, F.col("part")).when((n == 1) | (first == last), F.concat("part", F.lit(", item "), F.when(n == 1, last).otherwise(first))).otherwise(F.concat("part", F.lit(", items "), first, F.lit("-"), last))
    in_clause = F.col("kind_no") == 0
    section = F.when(in_clause, F.col("label")).otherwise(other)
    own = F.concat("doc_id", F.lit(":"), tx.slug(F.col("label")), F.lit(":"), F.col("part_no").cast("string"))
    placed = F.concat("doc_id", F.lit(":"), tx.slug(F.col("part")), F.lit(":p"), F.element_at("paragraphs", 1)["pdf_page"].cast("string"), F.lit("-"), F.col("part_no").cast("string"))
    return rows.select(*_passage(look.title, F.col("part"), section, F.when(in_clause, own).otherwise(placed), F.array().cast("array<string>")), "key", "part_no")


def corpus(*parsed: DataFrame) -> DataFrame:
    """All passages of several parsers and of hand-made content together, numbered by `pos` in the order of doc_id and chunk_id."""
    columns = [c for c in parsed[0].columns if c not in ("first_unit", "part_no", "key", "pos")]
    out = parsed[0].select(*columns)
    for p in parsed[1:]:
        out = out.unionByName(p.select(*columns))
    return Ordered.of(out.withColumn("__all", F.lit(0)), ["__all"], ["doc_id", "chunk_id"]).running(F.lit(1), "pos").done().drop("__all")


