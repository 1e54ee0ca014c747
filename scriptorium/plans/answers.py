"""Queries on answers, mined pairs and samples: generation_finetuned, pairs, val, dropped."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import cite, evaluate, index, keyword, mining, prompt, rank
from scriptorium.plans import retrieval as rt, sqltext as sql
from scriptorium.runtime import cut_lineage, read_table, widen
from scriptorium.sources.model import HashingEmbedder, embed

PREFIX = "Represent this sentence for searching relevant passages: "


def _results(spark, sf_dir, *columns):
    return read_table(spark, sf_dir, "generation_finetuned").select("result_id", *columns).dropDuplicates(["result_id"])


def source_markers(spark, sf_dir):
    r = _results(spark, sf_dir, "answer").filter("answer IS NOT NULL")
    return r.select("result_id", F.array_join(F.transform(tx.source_numbers(F.col("answer")), lambda n: n.cast("string")), ",").alias("sources"))


def numbers_normalised(spark, sf_dir):
    r = _results(spark, sf_dir, "answer").filter("answer IS NOT NULL")
    return r.select("result_id", F.array_join(F.array_sort(tx.numbers_in(tx.without_markers(F.col("answer")))), ",").alias("numbers"))


def answer_sentences(spark, sf_dir):
    r = _results(spark, sf_dir, "answer").filter("answer IS NOT NULL")
    return r.select("result_id", F.posexplode(tx.answer_sentences(F.col("answer"))).alias("n", "sentence"))


def tidy_answers(spark, sf_dir):
    return _results(spark, sf_dir, "answer").select("result_id", tx.tidy_answer(F.col("answer")).alias("tidy"))


def answer_scoring(spark, sf_dir):
    gold = read_table(spark, sf_dir, "gold").select("id", "must_include")
    rows = _results(spark, sf_dir, "id", "answer", "mode", "answerable").join(gold, "id", "left")
    return evaluate.score_answers(rows).select("result_id", "abstained", F.array_join("missing", ",").alias("missing"), "correct")


def failure_sources(spark, sf_dir):
    r = _results(spark, sf_dir, "question_type", "correct", "answerable", "found")
    source = evaluate.failure_source(F.col("correct"), F.col("answerable"), F.col("found"))
    return r.groupBy(source.alias("source"), "question_type").agg(F.count(F.lit(1)).alias("answers"))


def answer_rates(spark, sf_dir):
    """Automatic results by document, type and wording; those left to a person don't count."""
    r = _results(spark, sf_dir, "doc", "question_type", "wording", "correct", "cites_evidence", "warnings", "seconds")
    sets = r.groupingSets([[F.col("doc")], [F.col("question_type")], [F.col("wording")], []], "doc", "question_type", "wording")
    return sets.agg(F.count("correct").alias("judged"), F.count_if("correct").alias("right"), F.count_if("cites_evidence").alias("citing"), F.count_if(F.coalesce(F.size("warnings"), F.lit(0)) <= 0).alias("without_warning"), F.round(F.avg("seconds"), 4).alias("avg_seconds"))


def citation_report(spark, sf_dir):
    """Citation checks of every answer against the sources that search gives for its question."""
    r = rt.ranked_of(spark, sf_dir)
    blocks = prompt.source_blocks(r.hits(), r.corpus.chunks)
    sources = blocks.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("sources"))
    sources = cut_lineage(sources.withColumn("numbers", cite.numbers_of_sources(F.col("sources"))))
    rows = _results(spark, sf_dir, "id", "answer", "question").filter("answer IS NOT NULL").join(sources, F.col("id") == F.col("qid"), "left")
    rep = cite.check_citations(rows.select(F.col("result_id").alias("aid"), "answer", "question", "sources", "numbers"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rep.select("aid", join("cited").alias("cited"), join("invalid").alias("invalid"), F.size("uncited_sentences").alias("uncited"), F.array_join(F.transform("ungrounded", lambda x: x["number"]), ",").alias("ungrounded"), "ok")


def parsed_questions(spark, sf_dir):
    """Questions out of a reply made of a gold record: a numbered list with a repetition, an answer and a short line."""
    reply = F.concat(F.lit("1. "), "question", F.lit("\n2) \""), "question", F.lit("\"\n"), "answer", F.lit("\nWhy so?\n- What does "), "doc", F.lit(" say about it?"))
    return read_table(spark, sf_dir, "gold").select("id", F.array_join(tx.parsed_questions(reply), "|").alias("questions"))


def copied_phrase(spark, sf_dir):
    """Pairs whose question repeats six words of its passage in a row."""
    pairs = read_table(spark, sf_dir, "pairs").select("pair_id", "query", "chunk_id").dropDuplicates(["pair_id"]).filter("query IS NOT NULL")
    rows = pairs.join(read_table(spark, sf_dir, "chunks").select("chunk_id", "text"), "chunk_id")
    return rows.select("pair_id", tx.copies_phrase(F.col("query"), F.col("text")).alias("copies"))


def near_duplicates(spark, sf_dir):
    """Training questions that share four fifths of their words with an earlier one."""
    q = read_table(spark, sf_dir, "pairs").select(F.col("pair_id").alias("i"), F.col("query").alias("question")).filter("question IS NOT NULL").distinct()
    return mining.near_duplicates(q)


def _val_search(spark, sf_dir, k, places=False):
    """Keyword lists of validation questions, their own passage and, if asked for, its place in the whole list."""
    c = rt.corpus_of(spark, sf_dir)
    val = read_table(spark, sf_dir, "val").select(F.col("val_id").alias("qid"), F.col("query").alias("question"), "chunk_id").filter("question IS NOT NULL")
    positives = val.join(c.chunks.select("pos", "chunk_id"), "chunk_id").select("qid", "pos")
    return c, val, *keyword.Grid.of(c).search(val, k, positives if places else None), positives


def hard_negatives(spark, sf_dir):
    c, _, bm25, _, positives = _val_search(spark, sf_dir, mining.POOL)
    return mining.hard_negatives(positives, bm25, c.chunks)


def pair_filter(spark, sf_dir):
    """Reason to drop each validation question, or that it is kept, and its hard negative. As in its SQL, nothing leaks and only the keyword list counts; filter_cascade has all checks."""
    c, val, bm25, places, positives = _val_search(spark, sf_dir, mining.POOL, True)
    near = mining.near_duplicates(val.select(F.col("qid").alias("i"), "question")).select(F.col("i").alias("qid"), F.lit(True).alias("near"))
    found = places.filter(F.col("rank") <= mining.TOP_N).select("qid", F.lit(True).alias("found")).distinct()
    rows = val.join(c.chunks.select("chunk_id", "text"), "chunk_id").join(near, "qid", "left").join(found, "qid", "left").join(mining.hard_negatives(positives, bm25, c.chunks), "qid", "left")
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    reason = mining.filter_reason(yes("near"), tx.mentions_prompt(F.col("question")), tx.copies_phrase(F.col("question"), F.col("text")), F.lit(False), yes("found"), F.col("negative_id"))
    return rows.select("qid", F.coalesce(reason, F.lit("kept")).alias("reason"), F.when(reason.isNull(), F.col("negative_id")).alias("negative_id"))


def _candidates(spark, sf_dir):
    """(qid, question) of pairs and val, and (qid, pos) of their passages, whose ids may be written in another case or with other separators."""
    key = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), "-")
    of = lambda table, name: read_table(spark, sf_dir, table).select(F.col(name).alias("qid"), F.col("query").alias("question"), "chunk_id")
    rows = of("pairs", "pair_id").unionByName(of("val", "val_id")).filter("question IS NOT NULL").dropDuplicates(["qid"])
    positives = rows.select("qid", key(F.col("chunk_id")).alias("key")).join(rt.chunks_of(spark, sf_dir).select("pos", key(F.col("chunk_id")).alias("key")), "key")
    return rows.select("qid", "question"), positives.select("qid", "pos")


def mined_negatives(spark, sf_dir):
    """Hard negatives of all training questions of pairs and val."""
    c = rt.corpus_of(spark, sf_dir)
    questions, positives = _candidates(spark, sf_dir)
    bm25, _ = keyword.Grid.of(c).search(questions.join(positives.select("qid"), "qid", "left_semi"), mining.POOL)
    return mining.hard_negatives(positives, bm25, c.chunks)


def _gold_numbered(spark, sf_dir):
    return read_table(spark, sf_dir, "gold").select(F.xxhash64("id").alias("pos"), "id", "question")


def leak_guard(spark, sf_dir, embedder=None):
    """Training questions too similar to a gold question, and to which."""
    embedder = embedder or HashingEmbedder()
    questions, _ = _candidates(spark, sf_dir)
    gold = _gold_numbered(spark, sf_dir)
    near = mining.leaks(embed(widen(questions), "qid", "question", embedder, PREFIX), embed(gold, "pos", "question", embedder, PREFIX))
    return near.join(gold.select(F.col("pos").alias("gold"), "id"), "gold").select("qid", F.col("id").alias("gold_id"), F.round("cosine", 6).alias("cosine"))


def filter_cascade(spark, sf_dir, embedder=None):
    """Reason to drop each training question of pairs and val, or that it is kept, and its hard negative: all six checks, with vectors of the injected embedder."""
    questions, positives = _candidates(spark, sf_dir)
    return mining.filter_cascade(questions, positives, _gold_numbered(spark, sf_dir).select("pos", "question"), rt.corpus_of(spark, sf_dir), embedder or HashingEmbedder(), PREFIX)


CODES = ("near-duplicate", "refers to 'the passage'", "copies a phrase from its passage", "too similar to a gold question", "passage not in BM25 or dense top 50", "no unrelated hard negative in the BM25 top 10")


def reason_code(reason):
    """The code a reason opens with, 'none' without one."""
    code = F.lit("none")
    for c in CODES:
        code = F.when(F.startswith(reason, F.lit(c)), c).otherwise(code)
    return code


def drop_reasons(spark, sf_dir):
    """Dropped questions by the code their reason opens with, most frequent first, ties in order of first sight."""
    code = reason_code(F.col("reason"))
    d = read_table(spark, sf_dir, "dropped").select("dropped_id", "reason").dropDuplicates(["dropped_id"])
    per = d.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("dropped_id").alias("first_id"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_id")).cast("long"))  # one row per code


def spread_sample(spark, sf_dir):
    """Fifty passages spread evenly over the list: the limit is what the operator is for."""
    rows = mining.numbered(read_table(spark, sf_dir, "chunks").select("pos", "chunk_id"), "pos")
    return mining.spread_sample(rows, read_table(spark, sf_dir, "chunks").count(), 50).select("pos", "chunk_id")


def strided_sample(spark, sf_dir):
    """The first three dropped rows of each code, by id."""
    code = F.lit("none")
    for c in CODES:
        code = F.when(F.startswith("reason", F.lit(c)), c).otherwise(code)
    d = read_table(spark, sf_dir, "dropped").select("dropped_id", code.alias("code")).distinct()
    return d.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("dropped_id"))).filter("k <= 3").select("code", "dropped_id", F.col("k").cast("long").alias("k"))


def seeded_split(spark, sf_dir):
    return mining.seeded_split(read_table(spark, sf_dir, "val").select("val_id").distinct(), "val_id").select("val_id", "split")


def resume_anti_join(spark, sf_dir):
    """Passages that no pair was made from yet."""
    return read_table(spark, sf_dir, "chunks").select("chunk_id").join(read_table(spark, sf_dir, "pairs").select("chunk_id"), "chunk_id", "left_anti")


def pair_fk_check(spark, sf_dir):
    """Pairs whose passage or negative isn't in the corpus under the id as written."""
    ids = read_table(spark, sf_dir, "chunks").select("chunk_id").distinct()
    p = read_table(spark, sf_dir, "pairs").select("pair_id", "chunk_id", "negative_id").distinct()
    flat = p.select("pair_id", F.expr("stack(2, 'chunk_id', chunk_id, 'negative_id', negative_id) AS (role, ref)"))
    return flat.filter("ref IS NOT NULL").join(ids, flat["ref"] == ids["chunk_id"], "left_anti")


def training_triples(spark, sf_dir):
    c = read_table(spark, sf_dir, "chunks").select("chunk_id", F.col("text"))
    p = read_table(spark, sf_dir, "pairs").select("pair_id", "query", "chunk_id", "negative_id").dropDuplicates(["pair_id"]).filter("query IS NOT NULL")
    rows = p.join(c.select("chunk_id", F.col("text").alias("positive")), "chunk_id").join(c.select(F.col("chunk_id").alias("negative_id"), F.col("text").alias("negative")), "negative_id")
    return rows.select("pair_id", F.concat(F.lit(PREFIX), "query").alias("anchor"), F.md5("positive").alias("positive_md5"), F.md5("negative").alias("negative_md5"))


def ir_metrics(spark, sf_dir):
    """Keyword search of validation questions for their one relevant passage."""
    _, _, _, places, positives = _val_search(spark, sf_dir, 0, True)
    r = positives.join(places, ["qid", "pos"], "left")
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    gain = F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return r.agg(
        F.count(F.lit(1)).alias("queries"), *(at(k).alias(f"accuracy_{k}") for k in (1, 3, 5, 10)), F.round(F.avg(F.when(F.col("rank") <= 5, 0.2).otherwise(0.0)), 6).alias("precision_5"),
        F.round(F.avg(gain), 6).alias("ndcg_10"), F.round(F.avg(evaluate.reciprocal(F.col("rank"))), 6).alias("mrr_10"), F.round(F.avg(evaluate.reciprocal(F.col("rank"), 100)), 6).alias("map_100"),
    )


def quote_holders(spark, sf_dir):
    """For each piece of evidence, the passages of its section that hold its quote."""
    ev = read_table(spark, sf_dir, "gold").select("id", F.explode("evidence").alias("e")).select("id", "e.chunk_id", tx.squashed(F.col("e.quote")).alias("quote")).distinct()
    c = read_table(spark, sf_dir, "chunks")
    fam = c.select("chunk_id", "doc_id", tx.section_family(F.col("section")).alias("family"), tx.squashed(F.col("text")).alias("flat"))
    home = ev.join(fam.select("chunk_id", "doc_id", "family"), "chunk_id").select("id", F.col("chunk_id").alias("named"), "quote", "doc_id", "family")
    return home.join(fam, ["doc_id", "family"]).filter(F.contains("flat", F.col("quote"))).select("id", "named", F.col("chunk_id").alias("holder"))


def value_probes(spark, sf_dir):
    """Whether every required value of a question stands in the sources that search gives for it: retrieved, attached or missing."""
    r = rt.ranked_of(spark, sf_dir)
    hits = r.hits().join(r.corpus.chunks.select("pos", "text"), "pos").select("qid", "reason", "text")
    need = read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), F.explode("must_include").alias("value"))
    per = need.join(hits, "qid").groupBy("qid", "value").agg(F.bool_or(F.contains("text", F.col("value")) & (F.col("reason") == "")).alias("direct"), F.bool_or(F.contains("text", F.col("value"))).alias("any"))
    status = F.when(F.bool_and("direct"), "retrieved").when(F.bool_and("any"), "attached").otherwise("missing")
    return per.groupBy("qid").agg(status.alias("status"))


def ship_verdict(spark, sf_dir):
    """Whether the hybrid list may replace the keyword list: more wins than losses, and no amendment question lost."""
    kinds = read_table(spark, sf_dir, "gold").select(F.col("id").alias("qid"), "question_type")
    ranks = rt._ranks(spark, sf_dir)
    a = ranks.filter("mode = 'bm25'").select("qid", F.col("rank").alias("rank_a"))
    both = a.join(ranks.filter("mode = 'hybrid'").select("qid", F.col("rank").alias("rank_b")), "qid")
    lost = both.join(kinds, "qid").agg(F.count_if((F.col("question_type") == "amendment") & evaluate.hit_at(F.col("rank_a"), 5) & ~evaluate.hit_at(F.col("rank_b"), 5)).alias("broken"))
    row = evaluate.wins_losses(both).crossJoin(lost)  # one row each
    return row.withColumn("ships", (F.col("wins") > F.col("losses")) & (F.col("broken") == 0))


QUERIES = {
    f.__name__: f for f in (
        source_markers, numbers_normalised, answer_sentences, tidy_answers, answer_scoring, failure_sources, answer_rates, citation_report, parsed_questions, copied_phrase, near_duplicates, hard_negatives, pair_filter, leak_guard, filter_cascade, mined_negatives,
        drop_reasons, spread_sample, strided_sample, seeded_split, resume_anti_join, pair_fk_check, training_triples, ir_metrics, quote_holders, value_probes, ship_verdict,
    )
}

_R = "(SELECT DISTINCT ON (result_id) * FROM generation_finetuned)"
_CODE = "CASE " + " ".join(f"WHEN starts_with(reason, {sql.q(c)}) THEN {sql.q(c)}" for c in reversed(CODES)) + " ELSE 'none' END"
_NG = "list_transform(range(1, greatest(len({0}) - 4, 1)), lambda i: array_to_string({0}[i:i + 5], ' '))"
_COPIES = "(len(qw) >= 6 AND len(pw) >= 6 AND list_has_any(" + _NG.format("qw") + ", " + _NG.format("pw") + "))"
_ABST = f"starts_with(lower(regexp_replace(answer, '^[\\s\"''*>_`]+', '')), {sql.q(tx.NOT_FOUND.rstrip('.').lower())})"
_TEXT = "regexp_replace(answer, '(?i)\\[\\s*S\\s*\\d+[^\\]]*\\]', ' ', 'g')"
_MISSING = f"""list_filter(list_transform(must_include, lambda v: trim(v)), lambda v: NOT CASE WHEN regexp_matches(v, '^[-−–]?\\s*\\d[\\d.,]*$') THEN list_has_all(stated, {sql.numbers_in('v')})
  AND (NOT regexp_matches(v, '^[-−–]') OR regexp_matches(t, '[-−–]\\s*' || regexp_escape(regexp_replace(v, '^[-−–]\\s*', '')) || '0*(\\D|$)')) ELSE contains(lower(t), lower(v)) END)"""
_VAL_Q = sql.RANKING.replace("q AS (SELECT id AS qid, question, CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) AS vec_id FROM gold)", "q AS (SELECT val_id AS qid, query AS question, CAST(NULL AS BIGINT) AS vec_id, chunk_id FROM val WHERE query IS NOT NULL)")
_VAL = f"WITH {_VAL_Q}"
_FREE = f"""NOT (p.chunk_id = n.chunk_id OR (p.doc_id = n.doc_id AND {sql.section_family('p.section')} = {sql.section_family('n.section')}) OR (p.parent <> '' AND p.parent = n.parent) OR list_has_any(p.amends, n.covers) OR list_has_any(n.amends, p.covers))"""
_NEG = f"""lst AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos) AS rank FROM sc WHERE score > 0),
positive AS (SELECT q.qid, k.* FROM q JOIN chunks k USING (chunk_id)),
neg AS (SELECT p.qid, arg_min(n.chunk_id, l.rank) AS negative_id FROM positive p JOIN lst l ON l.qid = p.qid AND l.rank <= 10 JOIN chunks n ON n.pos = l.pos WHERE {_FREE} GROUP BY p.qid)"""
_NEAR = f"""w AS (SELECT val_id AS i, list_distinct({sql.words('query')}) AS ws FROM val WHERE query IS NOT NULL), near AS (SELECT DISTINCT b.i FROM w a JOIN w b ON a.i < b.i AND len(a.ws) > 0 AND len(a.ws) >= 0.8 * len(b.ws) AND len(b.ws) >= 0.8 * len(a.ws)
  WHERE len(list_intersect(a.ws, b.ws)) >= 0.8 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) - 1e-9)"""
ORACLE = {
    "near_duplicates": f"""WITH w AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT pair_id AS i, list_distinct({sql.words('query')}) AS ws FROM pairs WHERE query IS NOT NULL) WHERE len(ws) > 0),
u AS (SELECT r, i, len(ws) AS n, unnest(ws) AS word FROM w), f AS (SELECT word, count(*) AS c FROM u GROUP BY word),
p AS (SELECT r, i, word FROM (SELECT u.*, row_number() OVER (PARTITION BY r ORDER BY c, word) AS k FROM u JOIN f USING (word)) WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.r AS ra, b.r AS rb FROM p a JOIN p b ON a.word = b.word AND a.i < b.i)
SELECT DISTINCT y.i FROM c JOIN w x ON x.r = ra JOIN w y ON y.r = rb WHERE len(list_intersect(x.ws, y.ws)) >= 0.8 * len(list_distinct(list_concat(x.ws, y.ws))) - 1e-9""",
    "source_markers": f"SELECT result_id, coalesce(array_to_string({sql.source_numbers('answer')}, ','), '') AS sources FROM {_R} WHERE answer IS NOT NULL",
    "numbers_normalised": f"SELECT result_id, coalesce(array_to_string(list_sort({sql.numbers_in(sql.without_markers('answer'))}), ','), '') AS numbers FROM {_R} WHERE answer IS NOT NULL",
    "tidy_answers": f"SELECT result_id, {sql.trim(r'''regexp_replace(regexp_replace(answer, '\\[\[\]()]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')} AS tidy FROM {_R}",
    "answer_scoring": f"""WITH r AS (SELECT g.result_id, coalesce(g.answer, '') AS answer, coalesce(g.mode = 'generated', FALSE) AS gen, coalesce(g.answerable, FALSE) AS ok, coalesce(k.must_include, []) AS must_include FROM {_R} g LEFT JOIN gold k ON k.id = g.id),
  s AS (SELECT *, gen AND {_ABST} AS abstained, {_TEXT} AS t FROM r), u AS (SELECT *, {sql.numbers_in('t')} AS stated FROM s), m AS (SELECT *, CASE WHEN gen THEN {_MISSING} ELSE must_include END AS missing FROM u)
SELECT result_id, abstained, coalesce(array_to_string(missing, ','), '') AS missing, CASE WHEN NOT gen THEN FALSE WHEN NOT ok THEN abstained WHEN abstained THEN FALSE WHEN len(must_include) > 0 THEN len(missing) = 0 END AS correct FROM m""",
    "failure_sources": f"SELECT CASE WHEN correct = FALSE AND answerable THEN CASE WHEN found THEN 'generation' ELSE 'retrieval' END ELSE '' END AS source, question_type, count(*) AS answers FROM {_R} GROUP BY ALL",
    "answer_rates": f"""SELECT doc, question_type, wording, count(correct) AS judged, count(*) FILTER (correct) AS right, count(*) FILTER (cites_evidence) AS citing, count(*) FILTER (coalesce(len(warnings), 0) = 0) AS without_warning, round(avg(seconds), 4) AS avg_seconds
  FROM {_R} GROUP BY GROUPING SETS ((doc), (question_type), (wording), ())""",
    "parsed_questions": f"""WITH l AS (SELECT id, string_split('1. ' || question || chr(10) || '2) "' || question || '"' || chr(10) || answer || chr(10) || 'Why so?' || chr(10) || '- What does ' || doc || ' say about it?', chr(10)) AS ls FROM gold),
  b AS (SELECT id, list_transform(ls, lambda x: {sql.trim("regexp_replace(regexp_replace(" + sql.trim("regexp_replace(x, '(?i)^\\s*(?:[-*•]|\\d+\\s*[.):]|q\\d*\\s*[.):])\\s*', '')") + ", '^[\"'']+', ''), '[\"'']+$', '')")}) AS ls FROM l),
  f AS (SELECT id, list_filter(ls, lambda x, i: x LIKE '%?' AND len(regexp_extract_all(x, '\\S+')) >= 4 AND list_position(ls, x) = i) AS ls FROM b) SELECT id, array_to_string(ls[1:2], '|') AS questions FROM f""",
    "copied_phrase": f"""SELECT pair_id, {_COPIES} AS copies FROM (SELECT pair_id, {sql.words('query')} AS qw, {sql.words('text')} AS pw FROM (SELECT DISTINCT ON (pair_id) pair_id, query, chunk_id FROM pairs) JOIN chunks USING (chunk_id) WHERE query IS NOT NULL)""",
    "hard_negatives": f"{_VAL}, {_NEG} SELECT qid, negative_id FROM neg",
    "pair_filter": f"""{_VAL}, {_NEG}, {_NEAR}, hit AS (SELECT DISTINCT p.qid FROM positive p JOIN lst l ON l.qid = p.qid AND l.pos = p.pos AND l.rank <= 50),
  j AS (SELECT p.qid, q.question, {sql.words('q.question')} AS qw, {sql.words('p.text')} AS pw, near.i IS NOT NULL AS is_near, hit.qid IS NOT NULL AS is_hit, negative_id FROM positive p JOIN q ON q.qid = p.qid LEFT JOIN near ON near.i = p.qid LEFT JOIN hit ON hit.qid = p.qid LEFT JOIN neg ON neg.qid = p.qid),
  r AS (SELECT *, CASE WHEN is_near THEN 'near-duplicate' WHEN regexp_matches(question, '(?i)\\b(?:the|this|given) (?:passage|excerpt|text)\\b') THEN 'refers to ''the passage''' WHEN {_COPIES} THEN 'copies a phrase from its passage'
    WHEN NOT is_hit THEN 'passage not in BM25 or dense top 50' WHEN negative_id IS NULL THEN 'no unrelated hard negative in the BM25 top 10' ELSE 'kept' END AS reason FROM j)
SELECT qid, reason, CASE WHEN reason = 'kept' THEN negative_id END AS negative_id FROM r""",
    "drop_reasons": f"""SELECT code, n, first_id, row_number() OVER (ORDER BY n DESC, first_id) AS place FROM (SELECT {_CODE} AS code, count(DISTINCT dropped_id) AS n, min(dropped_id) AS first_id FROM dropped GROUP BY 1)""",
    "spread_sample": "WITH r AS (SELECT pos, chunk_id, row_number() OVER (ORDER BY pos) - 1 AS n0, count(*) OVER () AS n FROM chunks) SELECT pos, chunk_id FROM r WHERE n <= 50 OR n0 IN (SELECT i * (SELECT count(*) FROM chunks) // 50 FROM range(50) t(i))",
    "strided_sample": f"SELECT code, dropped_id, k FROM (SELECT code, dropped_id, row_number() OVER (PARTITION BY code ORDER BY dropped_id) AS k FROM (SELECT DISTINCT {_CODE} AS code, dropped_id FROM dropped)) WHERE k <= 3",
    "seeded_split": "SELECT val_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || val_id), val_id) <= round_even((SELECT count(DISTINCT val_id) FROM val) * 0.1, 0) THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT val_id FROM val)",
    "resume_anti_join": "SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM pairs WHERE chunk_id IS NOT NULL)",
    "pair_fk_check": "SELECT DISTINCT pair_id, role, ref FROM (SELECT pair_id, 'chunk_id' AS role, chunk_id AS ref FROM pairs UNION ALL SELECT pair_id, 'negative_id', negative_id FROM pairs) WHERE ref IS NOT NULL AND ref NOT IN (SELECT chunk_id FROM chunks)",
    "training_triples": f"""SELECT pair_id, {sql.q(PREFIX)} || query AS anchor, md5(a.text) AS positive_md5, md5(b.text) AS negative_md5 FROM (SELECT DISTINCT ON (pair_id) * FROM pairs) p JOIN chunks a ON a.chunk_id = p.chunk_id JOIN chunks b ON b.chunk_id = p.negative_id WHERE query IS NOT NULL""",
    "ir_metrics": f"""{_VAL}, {_NEG}, r AS (SELECT p.qid, CASE WHEN l.rank <= 100 THEN l.rank END AS rank FROM positive p LEFT JOIN lst l ON l.qid = p.qid AND l.pos = p.pos)
SELECT count(*) AS queries, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS accuracy_{k}' for k in (1, 3, 5, 10))}, round(avg(CASE WHEN rank <= 5 THEN 0.2 ELSE 0 END), 6) AS precision_5,
  round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_10, round(avg(CASE WHEN rank <= 100 THEN 1.0 / rank ELSE 0 END), 6) AS map_100 FROM r""",
    "quote_holders": f"""WITH ev AS (SELECT DISTINCT id, e.chunk_id AS named, {sql.squashed('e.quote')} AS quote FROM (SELECT id, unnest(evidence) AS e FROM gold)), f AS (SELECT chunk_id, doc_id, {sql.section_family('section')} AS family, {sql.squashed('text')} AS flat FROM chunks)
SELECT id, named, b.chunk_id AS holder FROM ev JOIN f a ON a.chunk_id = named JOIN f b ON b.doc_id = a.doc_id AND b.family = a.family WHERE contains(b.flat, quote)""",
    "value_probes": f"""WITH {sql.RANKING}, {sql.expansion()}, need AS (SELECT id AS qid, unnest(must_include) AS value FROM gold),
  p AS (SELECT n.qid, value, bool_or(contains(text, value) AND reason = '') AS direct, bool_or(contains(text, value)) AS anywhere FROM need n JOIN hits h ON h.qid = n.qid JOIN chunks k ON k.pos = h.pos GROUP BY ALL)
SELECT qid, CASE WHEN bool_and(direct) THEN 'retrieved' WHEN bool_and(anywhere) THEN 'attached' ELSE 'missing' END AS status FROM p GROUP BY qid""",
    "ship_verdict": f"""WITH {sql.RANKING}, {rt._RANKS}, b AS (SELECT a.qid, a.rank AS ra, b.rank AS rb FROM ranks a JOIN ranks b ON a.qid = b.qid AND a.mode = 'bm25' AND b.mode = 'hybrid'),
  s AS (SELECT count(*) FILTER ({rt._KEY.format('rb')} > {rt._KEY.format('ra')}) AS wins, count(*) FILTER ({rt._KEY.format('rb')} < {rt._KEY.format('ra')}) AS losses, count(*) FILTER ({rt._KEY.format('rb')} = {rt._KEY.format('ra')}) AS ties,
    count(*) FILTER (question_type = 'amendment' AND ra <= 5 AND NOT coalesce(rb <= 5, FALSE)) AS broken FROM b JOIN gold ON gold.id = b.qid) SELECT *, wins > losses AND broken = 0 AS ships FROM s""",
}
