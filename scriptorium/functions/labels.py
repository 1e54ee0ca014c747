"""Labels of passages and windows, and formatting of figures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def breadcrumb() -> Column:
    """doc_title > part > section - title, without what is empty."""
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    crumb = F.concat_ws(" > ", blank("doc_title"), blank("part"), blank("section"))
    return F.when(blank("title").isNotNull(), F.concat(crumb, F.lit(" - "), F.col("title"))).otherwise(crumb)


def index_text() -> Column:
    return F.concat(breadcrumb(), F.lit("\n"), F.coalesce(F.col("text"), F.lit("")))


def span(pages: Column) -> Column:
    """First page, or first-last of the distinct ones in order; '?' if none."""
    u = F.array_distinct(F.transform(pages, lambda p: p.cast("string")))
    return F.when(F.size(u) == 0, "?").when(F.size(u) == 1, u[0]).otherwise(F.concat(F.element_at(u, 1), F.lit("-"), F.element_at(u, -1)))


def page_label() -> Column:
    pdf, printed = F.coalesce(span(F.col("pdf_pages")), F.lit("?")), span(F.col("printed_pages"))
    mark = F.when(F.size(F.array_distinct("printed_pages")) > 1, "pp. ").otherwise("p. ")
    none = F.coalesce(F.size("printed_pages"), F.lit(0)) <= 0
    return F.when(none, F.concat(F.lit("PDF p. "), pdf)).when(printed != pdf, F.concat(mark, printed, F.lit(" (PDF "), pdf, F.lit(")"))).otherwise(F.concat(mark, printed))


def citation() -> Column:
    return F.concat_ws(", ", F.col("doc_title"), F.col("section"), page_label())


def window_label(prefix: str, keys: Column, part_no: Column, part_count: Column) -> Column:
    first, last = F.element_at(keys, 1), F.element_at(keys, -1)
    name = F.concat(F.lit(prefix), F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), last)))
    return F.when(part_count > 1, F.concat(name, F.lit(" (part "), part_no.cast("string"), F.lit("/"), part_count.cast("string"), F.lit(")"))).otherwise(name)


def rate(hits: Column, total: Column) -> Column:
    """'22/26 (85%)', half to even; '-' of none."""
    share = F.bround(F.try_divide(hits * 100.0, total), 0).cast("int")
    return F.when(total == 0, "-").otherwise(F.concat(hits.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), share.cast("string"), F.lit("%)")))


def duration(seconds: Column) -> Column:
    whole = seconds.cast("int")
    return F.concat((whole / 60).cast("int").cast("string"), F.lit("m"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s"))
