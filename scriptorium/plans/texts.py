"""Queries of cleaning, labels, packing, checks and layout over chunks, units, windows, gold and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import labels, text as tx
from scriptorium.operators import curated, index, layout, pack, quality, sections
from scriptorium.operators.ordered import Ordered
from scriptorium.plans import sqltext as sql
from scriptorium.runtime import read_table

ALIASES = {"lakh": "100,000", "Engineer-in-Charge": "Project Engineer"}
LEGEND = "Names in brackets are those used now."


def normalize_text(spark, sf_dir):
    return read_table(spark, sf_dir, "chunks").select("pos", tx.normalize(F.col("text")).alias("clean"))


def _unit_paragraphs(spark, sf_dir):
    return read_table(spark, sf_dir, "units").select("unit_id", F.posexplode("paragraphs").alias("n", "p")).select("unit_id", "n", "p.*")


def join_lines_dehyphen(spark, sf_dir):
    return _unit_paragraphs(spark, sf_dir).select("unit_id", "n", tx.join_lines(F.split(F.coalesce("text", F.lit("")), "\n")).alias("joined"))


def layout_noise(spark, sf_dir):
    """Per scanned passage: lines, ruler lines and lines in a font that wasn't mapped."""
    lines = read_table(spark, sf_dir, "chunks").filter("source = 'pdf'").select("pos", F.explode(tx.lines_of(F.col("text"))).alias("line"))
    return lines.groupBy("pos").agg(F.count(F.lit(1)).alias("lines"), F.count_if(tx.is_ruler(F.col("line"))).alias("rulers"), F.count_if(tx.looks_broken(F.col("line"))).alias("broken"))


def citation_labels(spark, sf_dir):
    return read_table(spark, sf_dir, "chunks").select("pos", labels.breadcrumb().alias("breadcrumb"), labels.page_label().alias("page_label"), labels.citation().alias("citation"), tx.section_family(F.col("section")).alias("family"))


def snippets(spark, sf_dir):
    return read_table(spark, sf_dir, "chunks").select("pos", tx.snippet(F.col("text")).alias("snippet"))


def clause_ids(spark, sf_dir):
    family = tx.section_family(F.col("section"))
    return read_table(spark, sf_dir, "chunks").select("pos", tx.clause_id(family).alias("clause_id"), tx.slug(F.col("section")).alias("slug"))


def clause_keys(spark, sf_dir):
    """Numbers of unit keys and whether each may follow the one before it in its document."""
    keyed = read_table(spark, sf_dir, "units").filter(F.col("unit_key").rlike(r"^(?:[A-D]-)?[\dlI]+(?:\.[\dlI]+)*$")).select("doc_id", "unit_id", tx.clause_key(F.col("unit_key")).alias("key"))
    both = Ordered.of(keyed, ["doc_id"], ["unit_id"]).previous("key").done()
    return both.select("doc_id", "unit_id", F.array_join(F.transform("key", lambda k: k.cast("string")), ".").alias("key"), F.coalesce(tx.is_successor(F.col("previous_key"), F.col("key")), F.lit(False)).alias("follows"))


def window_labels(spark, sf_dir):
    w = read_table(spark, sf_dir, "windows")
    return w.select("window_id", labels.window_label("Cl. ", F.col("unit_keys"), F.col("part_no"), F.col("part_count")).alias("label"))


def alias_annotation(spark, sf_dir):
    return read_table(spark, sf_dir, "chunks").select("pos", curated.annotate(F.col("text"), ALIASES, LEGEND).alias("annotated"))


def curated_parts(spark, sf_dir):
    """Units read as split tables: each paragraph a part, its printed page the label."""
    parts = F.transform("paragraphs", lambda p: F.struct(F.coalesce(p["printed_page"], F.lit("?")).alias("label"), F.coalesce(p["text"], F.lit("")).alias("text")))
    t = read_table(spark, sf_dir, "units").select(F.col("unit_key").alias("section"), "title", F.lit("").alias("text"), F.col("title").alias("header"), parts.alias("parts"), F.lit("").alias("footer"))
    return curated.table_parts(t)


def amendment_targets(spark, sf_dir):
    """Amendment passages as items: one row per target."""
    a = read_table(spark, sf_dir, "chunks").filter("is_amendment")
    return a.select("chunk_id", F.explode("amends").alias("target"), F.col("pos"))


def part_forward_fill(spark, sf_dir):
    out = layout.forward_fill(read_table(spark, sf_dir, "chunks").select("doc_id", "pos", "part"), "part", ["doc_id"], "pos")
    return out.select("doc_id", "pos", "part_filled")


def section_runs(spark, sf_dir):
    """Runs of neighbouring passages of one section."""
    c = read_table(spark, sf_dir, "chunks").select("doc_id", "pos", tx.section_family(F.col("section")).alias("family"))
    runs = Ordered.of(c, ["doc_id"], ["pos"]).previous("family").islands(F.col("family") != F.col("previous_family"), "run").done()
    return runs.groupBy("doc_id", "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("passages"), F.min("family").alias("family"))


def gap_islands_events(spark, sf_dir):
    """Runs of a user's events without a gap of six hours."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("s", F.unix_micros("ts"))
    wide = F.col("s") - layout.previous("s", ["user_id"], "s") > 6 * 3600 * 1_000_000
    runs = layout.islands(e, wide, ["user_id"], "s", "run")
    return runs.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("events"))


def paragraph_runs(spark, sf_dir):
    """Paragraphs of a unit grouped where the page changes."""
    p = _unit_paragraphs(spark, sf_dir).select("unit_id", "n", "pdf_page", tx.token_count(F.col("text")).alias("tokens"))
    runs = layout.islands(p, ~F.col("pdf_page").eqNullSafe(layout.previous("pdf_page", ["unit_id"], "n")), ["unit_id"], "n", "run")
    return runs.groupBy("unit_id", "run").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("tokens").cast("long").alias("tokens"))


def window_packing(spark, sf_dir):
    """Greedy fold of the token counts of a unit's paragraphs into windows of 400."""
    u = read_table(spark, sf_dir, "units").select("unit_id", F.transform("paragraphs", lambda p: tx.token_count(p["text"])).alias("sizes"))
    return u.select("unit_id", F.array_join(F.transform(pack.greedy_groups(F.col("sizes")), lambda k: k.cast("string")), ",").alias("windows"))


def group_units(spark, sf_dir):
    """Windows of all units: small neighbours merged, oversized units split."""
    w = pack.windows_of(read_table(spark, sf_dir, "units"))
    return w.select("doc_id", "first_unit", F.array_join("keys", ",").alias("keys"), "title", "part_no", "part_count", F.size("paragraphs").alias("paragraphs"), F.aggregate("paragraphs", F.lit(0), lambda a, p: a + tx.token_count(p["text"])).alias("tokens"))


def unit_merging(spark, sf_dir):
    """For each unit with paragraphs the unit that opens its window."""
    return pack.merging(pack.sized_units(read_table(spark, sf_dir, "units")))


def _scanned_blocks(spark, sf_dir):
    """Scanned passages as blocks in the order of the list."""
    return read_table(spark, sf_dir, "chunks").filter("source = 'pdf'").select("doc_id", F.col("pos").alias("ord"), F.element_at("pdf_pages", 1).alias("page"), "text")


def numbered_units(spark, sf_dir):
    """Clauses, tables and appendices that scanned passages open, by their numbers."""
    return sections.units_of(_scanned_blocks(spark, sf_dir)).select("doc_id", "unit_id", "unit_key", "unit_group", "title", "mergeable", F.size("paragraphs").alias("paragraphs"))


def numbered_passages(spark, sf_dir):
    """The same, packed to passages."""
    return sections.passages(_scanned_blocks(spark, sf_dir), "Scanned").select("doc_id", "first_unit", "part_no", "chunk_id", "section", "part", "title", F.size("covers").alias("covers"), F.length("text").alias("characters"))


def build_summary(spark, sf_dir):
    return quality.build_summary(read_table(spark, sf_dir, "chunks"))


def build_violations(spark, sf_dir):
    return quality.build_violations(read_table(spark, sf_dir, "chunks"))


def id_changes(spark, sf_dir):
    """Units that earlier windows don't have, and units only those have."""
    return quality.id_changes(read_table(spark, sf_dir, "windows").select("unit_id"), read_table(spark, sf_dir, "units").select("unit_id"), "unit_id")


def fingerprint(spark, sf_dir):
    return index.fingerprint(read_table(spark, sf_dir, "chunks"))


def gold_validation(spark, sf_dir):
    return quality.gold_problems(read_table(spark, sf_dir, "gold"), read_table(spark, sf_dir, "chunks"))


def uncovered_amendments(spark, sf_dir):
    return quality.uncovered_amendments(read_table(spark, sf_dir, "chunks"))


def broken_tables(spark, sf_dir):
    return quality.broken_tables(read_table(spark, sf_dir, "chunks"))


QUERIES = {
    f.__name__: f for f in (
        normalize_text, join_lines_dehyphen, layout_noise, citation_labels, snippets, clause_ids, clause_keys, window_labels, alias_annotation, curated_parts, amendment_targets, part_forward_fill, section_runs,
        gap_islands_events, paragraph_runs, window_packing, group_units, unit_merging, numbered_units, numbered_passages, build_summary, build_violations, id_changes, fingerprint, gold_validation, uncovered_amendments, broken_tables,
    )
}

_UP = "SELECT unit_id, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) - 1 AS n FROM units"
_LINES = sql.trim("x")
_JOIN = (
    "list_reduce(list_prepend('', list_transform(string_split(coalesce(p.text, ''), chr(10)), lambda x: " + _LINES + ")), lambda a, x: CASE WHEN x = '' THEN a "
    "WHEN a LIKE '%-' AND regexp_matches(x, '^\\p{Ll}') THEN CASE WHEN contains(split_part(x, ' ', 1), '-') THEN a || x ELSE left(a, length(a) - 1) || x END WHEN a = '' THEN x ELSE a || ' ' || x END)"
)
_TOK = f"list_filter(regexp_extract_all(line, '\\S+'), lambda x: regexp_matches(x, '\\p{{L}}'))"
_ODD = f"list_filter({_TOK}, lambda x: regexp_matches(x, '[a-z][A-Z]|[;`~@¼½©®ç]|^[a-z]{{1,3}}-$'))"
_FLAT = sql.trim(r"regexp_replace(text, '\s+', ' ', 'g')")
_SIZE = f"({sql.token_count(sql.INDEX_TEXT)} + 2)"


def _annotate_sql() -> str:
    out = "text"
    for old, new in ALIASES.items():
        # What is annotated already is protected by a mark between the name and its note.
        out = f"replace(regexp_replace(replace({out}, '{old} [now ', '{old[0]}' || chr(1) || '{old[1:]} [now '), '\\b{old}\\b', '{old} [now {new}]', 'g'), chr(1), '')"
    return out


ORACLE = {
    "normalize_text": f"SELECT pos, {sql.normalize('text')} AS clean FROM chunks",
    "join_lines_dehyphen": f"SELECT unit_id, CAST(n AS INTEGER) AS n, {sql.normalize(_JOIN)} AS joined FROM ({_UP})",
    "layout_noise": f"""SELECT pos, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[\\d\\s]{{20,}}$')) AS rulers, count(*) FILTER (len({_TOK}) >= 2 AND len({_ODD}) >= 0.3 * len({_TOK})) AS broken
  FROM (SELECT pos, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LINES}), lambda x: x <> '')) AS line FROM chunks WHERE source = 'pdf') GROUP BY pos""",
    "citation_labels": f"SELECT pos, {sql.CRUMB} AS breadcrumb, {sql.PAGE_LABEL} AS page_label, {sql.CITATION} AS citation, {sql.section_family('section')} AS family FROM chunks",
    "snippets": f"SELECT pos, CASE WHEN length({_FLAT}) <= 300 THEN {_FLAT} ELSE regexp_replace(left({_FLAT}, 300), '\\s\\S*$', '') || ' ...' END AS snippet FROM chunks",
    "clause_ids": f"""SELECT pos, CASE WHEN regexp_matches(f, '(?i)^clause\\s+\\d+\\s*[a-z]{{0,3}}$') THEN regexp_extract(f, '(?i)^clause\\s+(\\d+)', 1) || upper(regexp_extract(f, '(?i)^clause\\s+\\d+\\s*([a-z]{{0,3}})$', 1)) END AS clause_id,
  regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT *, {sql.section_family('section')} AS f FROM chunks)""",
    "clause_keys": """WITH k AS (SELECT doc_id, unit_id, list_transform(string_split(translate(unit_key, 'lI', '11'), '.'), lambda x: CAST(x AS INTEGER)) AS key FROM units WHERE regexp_matches(unit_key, '^[\\dlI]+(\\.[\\dlI]+)*$')),
  b AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY unit_id) AS prev FROM k)
SELECT doc_id, unit_id, array_to_string(key, '.') AS key, coalesce((len(key) = len(prev) + 1 AND key[:len(prev)] = prev AND key[-1] = 1)
  OR (len(key) <= len(prev) AND key[:len(key) - 1] = prev[:len(key) - 1] AND key[-1] - prev[len(key)] BETWEEN 1 AND 2), FALSE) AS follows FROM b""",
    "window_labels": "SELECT window_id, 'Cl. ' || CASE WHEN unit_keys[1] = unit_keys[-1] THEN unit_keys[1] ELSE unit_keys[1] || '-' || unit_keys[-1] END || CASE WHEN part_count > 1 THEN ' (part ' || part_no || '/' || part_count || ')' ELSE '' END AS label FROM windows",
    "alias_annotation": f"SELECT pos, CASE WHEN a <> text THEN a || chr(10) || '{LEGEND}' ELSE a END AS annotated FROM (SELECT pos, text, {_annotate_sql()} AS a FROM chunks)",
    "curated_parts": f"""SELECT unit_key AS section, title, '' AS text, '' AS parent FROM units WHERE len(paragraphs) = 0 UNION ALL
SELECT unit_key || ' (part ' || (n + 1) || '/' || k || ')', title || ' (' || coalesce(p.printed_page, '?') || ')', concat_ws(chr(10) || chr(10), nullif(coalesce(title, ''), ''), coalesce(p.text, '')), unit_key
  FROM (SELECT unit_key, title, len(paragraphs) AS k, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) - 1 AS n FROM units)""",
    "amendment_targets": "SELECT chunk_id, unnest(amends) AS target, pos FROM chunks WHERE is_amendment",
    "part_forward_fill": "SELECT doc_id, pos, last_value(nullif(part, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS part_filled FROM chunks",
    "section_runs": f"""WITH c AS (SELECT doc_id, pos, {sql.section_family('section')} AS family FROM chunks), s AS (SELECT *, coalesce(CAST(family <> lag(family) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER), 1) AS st FROM c),
  r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM s) SELECT doc_id, CAST(run AS BIGINT) AS run, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS passages, min(family) AS family FROM r GROUP BY doc_id, run""",
    "gap_islands_events": """WITH s AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 21600000000 AS INTEGER), 1) AS st FROM events),
  r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS events FROM r GROUP BY ALL""",
    "paragraph_runs": f"""WITH p AS (SELECT unit_id, n, p.pdf_page AS page, {sql.token_count('p.text')} AS tokens FROM ({_UP})),
  s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR page IS DISTINCT FROM lag(page) OVER w THEN 1 ELSE 0 END AS st FROM p WINDOW w AS (PARTITION BY unit_id ORDER BY n)),
  r AS (SELECT *, sum(st) OVER (PARTITION BY unit_id ORDER BY n) AS run FROM s) SELECT unit_id, CAST(run AS BIGINT) AS run, count(*) AS paragraphs, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY unit_id, run""",
    "window_packing": f"""WITH RECURSIVE z AS (SELECT unit_id, list_transform(paragraphs, lambda p: {sql.token_count('p.text')}) AS sizes FROM units),
  f AS (SELECT unit_id, sizes, 0 AS i, CAST(0 AS BIGINT) AS used, 0 AS k, '' AS out FROM z UNION ALL
    SELECT unit_id, sizes, i + 1, CASE WHEN i > 0 AND used + sizes[i + 1] > 400 THEN sizes[i + 1] ELSE used + sizes[i + 1] END, CASE WHEN i > 0 AND used + sizes[i + 1] > 400 THEN k + 1 ELSE k END,
      out || CASE WHEN i > 0 THEN ',' ELSE '' END || CASE WHEN i > 0 AND used + sizes[i + 1] > 400 THEN k + 1 ELSE k END FROM f WHERE i < len(sizes))
SELECT unit_id, out AS windows FROM f WHERE i = len(sizes)""",
    "unit_merging": f"""WITH RECURSIVE p AS (SELECT DISTINCT ON (unit_id) doc_id, unit_id, unit_group AS grp, coalesce(mergeable, FALSE) AS m, list_filter(paragraphs, lambda p: p.text IS NOT NULL) AS ps FROM units),
  z AS (SELECT doc_id, unit_id, grp, m, CAST(list_sum(list_transform(ps, lambda p: {sql.token_count('p.text')})) AS BIGINT) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY unit_id) AS k FROM p WHERE len(ps) > 0),
  f AS (SELECT doc_id, k, unit_id, grp, CASE WHEN size > 400 THEN -1 ELSE size END AS used, m AS open, unit_id AS head FROM z WHERE k = 1 UNION ALL
    SELECT doc_id, k, unit_id, grp, CASE WHEN size > 400 THEN -1 WHEN j THEN used + size ELSE size END, m, CASE WHEN j THEN head ELSE unit_id END
    FROM (SELECT z.*, f.used, f.head, f.used >= 0 AND z.grp IS NOT DISTINCT FROM f.grp AND CASE WHEN z.size > 400 THEN f.used < 50 ELSE f.open AND z.m AND f.used + z.size <= 400 END AS j FROM f JOIN z ON z.doc_id = f.doc_id AND z.k = f.k + 1))
SELECT doc_id, unit_id, head FROM f""",
    "build_summary": f"""SELECT coalesce(doc_id, 'total') AS doc_id, count(*) AS passages, round_even(avg({sql.word_count('text')}), 1) AS avg_words, CAST(max({_SIZE}) AS INTEGER) AS max_tokens, count(*) FILTER (is_amendment) AS amendments, count(*) FILTER (source = 'curated') AS curated FROM chunks GROUP BY ROLLUP (doc_id)""",
    "build_violations": f"""SELECT chunk_id, 'duplicate id' AS problem FROM chunks GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT chunk_id, 'empty text' FROM chunks WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT chunk_id, 'no pages' FROM chunks WHERE coalesce(len(pdf_pages), 0) = 0 UNION ALL SELECT chunk_id, 'too many tokens' FROM chunks WHERE {_SIZE} > 512""",
    "id_changes": "SELECT unit_id, 'added' AS change FROM (SELECT unit_id FROM units EXCEPT SELECT unit_id FROM windows) UNION ALL SELECT unit_id, 'removed' FROM (SELECT unit_id FROM windows EXCEPT SELECT unit_id FROM units)",
    "fingerprint": f"""WITH h AS (SELECT pos, sha256(chunk_id || {sql.INDEX_TEXT}) AS h FROM chunks), b AS (SELECT pos // 1000 AS b, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM h GROUP BY pos // 1000),
c AS (SELECT b // 1000 AS c, sha256(string_agg(h, '' ORDER BY b)) AS h FROM b GROUP BY b // 1000) SELECT left(sha256(string_agg(h, '' ORDER BY c)), 16) AS fingerprint FROM c""",
    "gold_validation": f"""WITH ev AS (SELECT id, unnest(evidence) AS e FROM gold), j AS (SELECT ev.id, e.chunk_id AS cid, e.pdf_pages AS pages, e.quote AS quote, k.* FROM ev LEFT JOIN chunks k ON k.chunk_id = e.chunk_id),
  a AS (SELECT id, question_type <> 'unanswerable' AS ok, evidence, answer, doc, question_type, wording, question FROM gold)
SELECT id, 'unknown doc ' || doc AS problem FROM a WHERE doc NOT IN {quality.DOCS} UNION ALL SELECT id, 'unknown type ' || question_type FROM a WHERE question_type NOT IN {quality.TYPES}
UNION ALL SELECT id, 'unknown wording ' || wording FROM a WHERE wording NOT IN {quality.WORDINGS} UNION ALL SELECT id, 'empty question or answer' FROM a WHERE trim(question) = '' OR trim(answer) = ''
UNION ALL SELECT id, 'answerable question without evidence' FROM a WHERE ok AND len(evidence) = 0
UNION ALL SELECT id, 'unanswerable question with evidence, answer or doc' FROM a WHERE NOT ok AND (len(evidence) > 0 OR answer <> '{tx.NOT_FOUND}' OR doc <> 'none')
UNION ALL SELECT id, cid || ' is not in the corpus' FROM j WHERE pos IS NULL UNION ALL SELECT id, cid || ' is on other pages' FROM j WHERE pos IS NOT NULL AND NOT list_has_all(pdf_pages, pages)
UNION ALL SELECT id, 'quote not found in ' || cid FROM j WHERE pos IS NOT NULL AND NOT contains({sql.squashed('text')}, {sql.squashed('quote')}) UNION ALL SELECT id, 'duplicate id' FROM gold GROUP BY id HAVING count(*) > 1""",
    "uncovered_amendments": "SELECT chunk_id, target FROM (SELECT chunk_id, unnest(amends) AS target FROM chunks WHERE is_amendment) WHERE target NOT IN (SELECT unnest(covers) FROM chunks)",
    "broken_tables": r"""WITH p AS (SELECT parent, pos, CAST(regexp_extract(section, '\(part (\d+)/(\d+)\)$', 1) AS INTEGER) AS i, CAST(regexp_extract(section, '\(part (\d+)/(\d+)\)$', 2) AS INTEGER) AS n FROM chunks WHERE parent <> '' AND regexp_matches(section, '\(part [0-9]+/[0-9]+\)$')),
  g AS (SELECT parent, count(*) AS parts, max(n) AS named, list(i ORDER BY pos, i) AS seen FROM p GROUP BY parent) SELECT parent, parts, named FROM g WHERE parts <> named OR seen <> CAST(range(1, named + 1) AS INTEGER[])""",
}
