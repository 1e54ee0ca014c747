"""DuckDB forms of the text expressions. Its regex engine has no look-around: protected places are marked with chr(1) first."""

from __future__ import annotations

import functools

from scriptorium.functions.text import ABBREVIATIONS, COUNTED, NO_SUFFIX, NUMBER_WORDS, STOP_WORDS, TOKEN, WORD


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def blank(x: str) -> str:
    return f"nullif(coalesce({x}, ''), '')"


CRUMB = f"(concat_ws(' > ', {blank('doc_title')}, {blank('part')}, {blank('section')}) || CASE WHEN {blank('title')} IS NOT NULL THEN ' - ' || title ELSE '' END)"
INDEX_TEXT = f"({CRUMB} || chr(10) || coalesce(text, ''))"


def search_tokens(x: str) -> str:
    marked = rf"regexp_replace(lower({x}), '\b(\d+)(\s+)({'|'.join(NO_SUFFIX)})\b', '\1\2' || chr(1) || '\3', 'g')"
    glued = rf"regexp_replace({marked}, '\b(\d+)\s+([a-z]{{1,2}})(\s|$|[),.;:])', '\1\2\3', 'g')"
    stop = "[" + ", ".join(map(q, STOP_WORDS)) + "]"
    return f"list_filter(regexp_extract_all(replace({glued}, chr(1), ''), '{TOKEN}'), lambda t: NOT list_contains({stop}, t))"


def token_count(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{COUNTED}'))"


def word_count(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(WORD)})"


def source_numbers(x: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all({x}, '\[([^\]]+)\]', 1), lambda g: list_transform(regexp_extract_all(g, '(?i)S\s*(\d+)', 1), lambda n: CAST(n AS INTEGER))))"


def without_markers(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\[\s*S\s*\d+(?:\s*,\s*S?\s*\d+)*\s*\]', ' ', 'g')"


def numbers_in(x: str) -> str:
    """Look-behind of one digit is replaced by keeping that digit; commas are taken out twice, for neighbours that share a digit."""
    t = rf"regexp_replace({x}, '(\d)[''’·](\d)', '\1.\2', 'g')"
    for _ in range(3):
        t = rf"regexp_replace({t}, '(\d),(\d\d\d)(\D|$)', '\1\2\3', 'g')"
    t = functools.reduce(lambda acc, kv: rf"regexp_replace({acc}, '(?i)\b{kv[0]}\b', ' {kv[1]} ', 'g')", NUMBER_WORDS.items(), t)
    whole = r"regexp_replace(split_part(n, '.', 1), '^0+(.)', '\1')"
    fraction = r"regexp_replace(split_part(n, '.', 2), '0+$', '')"
    return rf"list_distinct(list_transform(regexp_extract_all({t}, '\d+(?:\.\d+)?'), lambda n: CASE WHEN {fraction} = '' THEN {whole} ELSE {whole} || '.' || {fraction} END))"


def squashed(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g'))"


def span(x: str) -> str:
    u = f"list_filter(list_transform({x}, lambda p, i: CASE WHEN list_position({x}, p) = i THEN CAST(p AS VARCHAR) END), lambda p: p IS NOT NULL)"
    return f"(CASE WHEN len({u}) = 0 THEN '?' WHEN len({u}) = 1 THEN ({u})[1] ELSE ({u})[1] || '-' || ({u})[-1] END)"


PDF_SPAN, PRINTED_SPAN = span("pdf_pages"), span("printed_pages")
PAGE_LABEL = (
    f"(CASE WHEN coalesce(len(printed_pages), 0) = 0 THEN 'PDF p. ' || {PDF_SPAN} ELSE (CASE WHEN len(list_distinct(printed_pages)) > 1 THEN 'pp. ' ELSE 'p. ' END) || {PRINTED_SPAN}"
    f" || CASE WHEN {PRINTED_SPAN} <> {PDF_SPAN} THEN ' (PDF ' || {PDF_SPAN} || ')' ELSE '' END END)"
)
CITATION = f"(doc_title || ', ' || section || ', ' || {PAGE_LABEL})"
ABBREVIATION_END = r"(?i)(?:^|[\s(\[])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.$"


def normalize(x: str) -> str:
    t = f"replace(replace(translate({x}, '‘’“”–—\u00a0', '''''\"\"-- '), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    t = rf"regexp_replace({t}, '\.{{4,}}|…{{2,}}', ' ... ', 'g')"
    return trim(rf"regexp_replace({t}, '[ \t]+', ' ', 'g')")


def section_family(x: str) -> str:
    return rf"regexp_replace({x}, '\s*\(part \d+/\d+\)$', '')"


# The search pipeline, as common table expressions over gold (queries), chunks (passages) and embeddings (vectors).
RANKING = f"""
q AS (SELECT id AS qid, question, CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) AS vec_id FROM gold),
c AS (SELECT *, {search_tokens(INDEX_TEXT)} AS toks FROM chunks),
tk AS (SELECT pos, len(toks) AS dl, unnest(toks) AS tok FROM c),
posts AS (SELECT tok, pos, dl, count(*) AS tf FROM tk GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM c),
raw AS (SELECT tok, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM posts, tot GROUP BY tok),
stats AS (SELECT tok, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt0 AS (SELECT qid, {search_tokens('question')} AS toks FROM q),
qt1 AS (SELECT qid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS plc FROM qt0),
qt AS (SELECT qid, tok, count(*) AS qtf, min(plc) AS first_at FROM qt1 GROUP BY ALL),
sc AS (SELECT qid, pos, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN stats USING (tok) JOIN posts USING (tok), tot GROUP BY qid, pos),
bm AS (SELECT * FROM (SELECT qid, pos, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos) AS rank FROM sc WHERE score > 0) WHERE rank <= 30),
v AS (SELECT vec_id + 1 AS pos, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id + 1 IN (SELECT pos FROM chunks)),
dn AS (SELECT * FROM (SELECT qid, v.pos, list_dot_product(CAST(e.embedding AS DOUBLE[]), v.vec) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), v.vec), 9) DESC, v.pos) AS rank
  FROM q JOIN embeddings e ON e.vec_id = q.vec_id, v) WHERE rank <= 30),
fu0 AS (SELECT qid, pos, bm.rank AS bm25_rank, dn.rank AS dense_rank, coalesce(1 / (60 + bm.rank), 0) + coalesce(1 / (60 + dn.rank), 0) AS score FROM bm FULL JOIN dn USING (qid, pos)),
fu AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST) AS rank FROM fu0)"""


def expansion(pin: bool = True, siblings: bool = True, amendments: bool = True, tag: str = "", top_k: int = 6) -> str:
    """CTEs ending in hits{tag}(qid, ord, pos, score, reason)."""
    out = f"""
h0{tag} AS (SELECT qid, rank AS ord, pos, score, '' AS reason FROM fu WHERE rank <= {top_k}),"""
    last = f"h0{tag}"
    if pin:
        out += f"""
pc{tag} AS (SELECT qt.qid, p.pos, sc.score, qt.tok, first_at FROM qt JOIN stats USING (tok) JOIN posts p USING (tok) JOIN sc ON sc.qid = qt.qid AND sc.pos = p.pos
  WHERE regexp_matches(tok, '[0-9]') AND df <= 3 AND NOT EXISTS (SELECT 1 FROM {last} h WHERE h.qid = qt.qid AND h.pos = p.pos)),
p1{tag} AS (SELECT * FROM pc{tag} QUALIFY row_number() OVER (PARTITION BY qid, pos ORDER BY first_at, -round(score, 9), pos) = 1),
p2{tag} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_at, -round(score, 9), pos) AS k FROM p1{tag} QUALIFY k <= 2),
h1{tag} AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord) AS ord, pos, score, reason FROM
  (SELECT * FROM {last} UNION ALL SELECT qid, k + 1000000, pos, score, 'contains ''' || tok || ''' from the question' FROM p2{tag})),"""
        last = f"h1{tag}"
    if siblings:
        out += f"""
s0{tag} AS (SELECT h.qid, h.ord AS plc, b.pos, a.parent, a.section AS of_section FROM {last} h JOIN chunks a ON a.pos = h.pos AND a.parent <> '' JOIN chunks b ON b.parent = a.parent
  WHERE NOT EXISTS (SELECT 1 FROM {last} x WHERE x.qid = h.qid AND x.pos = b.pos)),
s1{tag} AS (SELECT * FROM s0{tag} QUALIFY row_number() OVER (PARTITION BY qid, pos ORDER BY plc, pos) = 1),
s2{tag} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY plc, pos) AS k FROM s1{tag} QUALIFY k <= 3),
h2{tag} AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord, sub) AS ord, pos, score, reason FROM
  (SELECT *, 0 AS sub FROM {last} UNION ALL SELECT qid, plc, pos, 0, 'rest of ' || parent || ': ' || of_section || ' was retrieved', k FROM s2{tag})),"""
        last = f"h2{tag}"
    if amendments:
        out += f"""
cv{tag} AS (SELECT pos, unnest(covers) AS target, generate_subscripts(covers, 1) AS step FROM chunks WHERE NOT is_amendment),
am{tag} AS (SELECT pos, section, is_amendment, unnest(amends) AS target FROM chunks),
rel{tag} AS (SELECT cv.pos AS from_pos, step, am.pos AS pos, am.section || ' amends ' || target AS reason FROM cv{tag} cv JOIN am{tag} am USING (target)
  UNION ALL SELECT am.pos, 0, cv.pos, 'original text of ' || string_agg(DISTINCT target, ', ' ORDER BY target) || ', amended by ' || am.section FROM am{tag} am JOIN cv{tag} cv USING (target) WHERE am.is_amendment GROUP BY am.pos, am.section, cv.pos),
a0{tag} AS (SELECT h.qid, h.ord AS plc, step, r.pos, r.reason FROM {last} h JOIN rel{tag} r ON r.from_pos = h.pos WHERE NOT EXISTS (SELECT 1 FROM {last} x WHERE x.qid = h.qid AND x.pos = r.pos)),
a1{tag} AS (SELECT * FROM a0{tag} QUALIFY row_number() OVER (PARTITION BY qid, pos ORDER BY plc, step, pos) = 1),
a2{tag} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY plc, step, pos) AS k FROM a1{tag} QUALIFY k <= 4),
h3{tag} AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord, sub) AS ord, pos, score, reason FROM
  (SELECT *, 0 AS sub FROM {last} UNION ALL SELECT qid, plc, pos, 0, reason, k FROM a2{tag})),"""
        last = f"h3{tag}"
    return out + f"\nhits{tag} AS (SELECT * FROM {last})"


EVIDENCE = "ge AS (SELECT DISTINCT g.qid, chunks.pos FROM (SELECT id AS qid, unnest(evidence).chunk_id AS chunk_id FROM gold) g JOIN chunks USING (chunk_id))"
