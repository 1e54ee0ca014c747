"""Problem 4: train, validation and test splits that keep related records together.

Records and the entities they name (section of a document, agreement) form a bipartite graph. Every entity
starts with the smallest record that names it; labels then travel over the records that name several entities,
the only ones that join anything, until none changes. Each round also takes what an entity meets to the entity whose
label it had, and follows a label to the label of its own entity, so chains settle in few rounds however they are
numbered, and is cut off from its lineage by a checkpoint.
Records that name one entity never enter the loop, however hot the entity: they are aggregated once, map-side first.

Splits: groups of at least 1/LARGE of all rows (there are at most LARGE of them) go one by one to the split
that lacks most rows of their strata; the others are dealt by hash buckets within their stratum, so the driver
sees at most STRATA x BUCKETS counts. Groups of the strata beyond the STRATA largest, each of at most 1/STRATA of the rows, are
dealt stratum by stratum on the executors, in the order of a hash, each to the split in whose share of the stratum its middle
falls. A group is never divided.

Defined results: a record that names no entity is alone; ids written in another case, with blanks or
other separators are the same; a chunk_id with fewer than two parts names no section; repeated rows count once.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.runtime import cut_lineage, read_table, write_out

PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
LARGE = 1000
BUCKETS = 256
STRATA = 1000
#: Letters, number and year of an agreement after a word for one, in any writing.
NAMED = r"(?i)\b(?:agreement|agmt|contract)\b[^a-zA-Z0-9]*(?:(?:no|number|nr)\b[^a-zA-Z0-9]*)?[a-zA-Z]{1,5}[-/._\s]{0,3}\d{1,6}\s*[-/. ]\s*(?:\d{4}|\d{2})(?![0-9a-zA-Z])"
#: The same without such a word: letters joined to the number or in capitals, and - or / before the year, as no decimal, date or range of pages has them.
FORMED = r"(?<![a-zA-Z0-9])(?:[a-zA-Z]{1,5}[-/._]?|[A-Z]{1,5}\s{1,2})\d{3,6}\s?[-/]\s?(?:\d{4}|\d{2})(?![0-9a-zA-Z])"
AGREEMENT_PARTS = r"([a-z]{1,5})[^a-z0-9]*(\d+)[^a-z0-9]+(\d+)$"


def section_of(chunk_id: Column) -> Column:
    """The chunk id in lower case with single separators, without its last number; NULL if nothing is left."""
    parts = F.regexp_extract_all(F.lower(chunk_id), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.size(parts)
    return F.when(n >= 2, F.array_join(F.slice(parts, 1, n - 1), "-"))


def agreements_of(text: Column) -> Column:
    """Letters, number and year of every agreement a text names, once each."""
    found = F.concat(F.regexp_extract_all(text, F.lit(NAMED), F.lit(0)), F.regexp_extract_all(text, F.lit(FORMED), F.lit(0)))

    def norm(x: Column) -> Column:
        x = F.lower(x)
        part = lambda k: F.regexp_extract(x, AGREEMENT_PARTS, k)
        return F.concat_ws("-", part(1), F.regexp_replace(part(2), "^0+(?=.)", ""), F.substring(part(3), -2, 2))

    return F.array_distinct(F.transform(found, norm))


def edges(rows: DataFrame) -> DataFrame:
    """(record_id, entity) from (record_id, chunk_id, query)."""
    named = F.concat(
        F.array_compact(F.array(F.concat(F.lit("s:"), section_of(F.col("chunk_id"))))),
        F.coalesce(F.transform(agreements_of(F.col("query")), lambda a: F.concat(F.lit("a:"), a)), F.array().cast("array<string>")),
    )
    return rows.select("record_id", F.array_distinct(named).alias("entities")).filter("record_id IS NOT NULL")


def group_labels(rows: DataFrame) -> DataFrame:
    """(record_id, group_id): the smallest record of each record's group."""
    named = write_out(edges(rows))  # read three times; the patterns over the texts run once
    flat = named.select("record_id", F.explode("entities").alias("entity"))
    ends = cut_lineage(flat.groupBy("entity").agg(F.min("record_id").alias("own")))
    several = named.filter(F.size("entities") > 1).select("record_id", F.explode("entities").alias("entity"))
    joins = cut_lineage(several.join(ends, "entity").select("record_id", "own").distinct())
    state = cut_lineage(joins.groupBy("own").agg(F.min("own").alias("low")))
    while True:  # labels only fall, and only to records of the same group, so this ends
        via = joins.join(state, "own").groupBy("record_id").agg(F.min("low").alias("l"))
        near = joins.join(via, "record_id").groupBy("own").agg(F.min("l").alias("l"))
        step = state.join(near, "own").select("own", F.col("low").alias("was"), F.least("low", "l").alias("low"))
        roots = step.select(F.explode(F.array_distinct(F.array("own", "was"))).alias("root"), "low").groupBy("root").agg(F.min("low").alias("root_low"))
        met = step.join(roots, step["own"] == roots["root"], "left").select("own", "was", F.least("low", F.coalesce("root_low", "low")).alias("low"))
        roots = met.select(F.col("own").alias("root"), F.col("low").alias("root_low"))
        after = cut_lineage(met.join(roots, met["low"] == roots["root"], "left").select("own", "was", F.least("low", F.coalesce("root_low", "low")).alias("low")))
        changed = after.filter("low < was").limit(1).count()
        state = after.select("own", "low")
        if not changed:
            break
    settled = ends.join(state, "own", "left").select("entity", F.coalesce("low", "own").alias("low"))
    return (
        named.select("record_id", F.explode_outer("entities").alias("entity")).join(settled, "entity", "left")
        .groupBy("record_id").agg(F.coalesce(F.min("low"), F.first("record_id")).alias("group_id"))
    )


def groups_of_two(labels: DataFrame) -> DataFrame:
    """(group_id, record_id) of the groups of two or more: the records that aren't the smallest of their group, and the smallest of theirs."""
    more = cut_lineage(labels.filter("record_id > group_id").select("group_id", "record_id"))
    return more.unionByName(more.select("group_id", F.col("group_id").alias("record_id")).distinct())


def deal(totals: dict[str, dict[str, int]], taken: dict[tuple[str, str], int], rows: dict[str, int]) -> str:
    """The split that lacks most of the given rows per stratum."""

    def lack(split: str, share: float) -> float:
        return sum(n * (share * sum(totals[s].values()) - taken.get((split, s), 0)) / max(1.0, share * sum(totals[s].values())) for s, n in rows.items())

    return max(PROPORTIONS, key=lambda p: (lack(*p), p[1]))[0]


def assign(labels: DataFrame, strata: int = STRATA) -> DataFrame:
    """(record_id, group_id, stratum, split) from (record_id, group_id, stratum)."""
    spark = labels.sparkSession
    lab = cut_lineage(labels.withColumn("stratum", F.coalesce("stratum", F.lit("none"))))
    names = lab.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(strata).select(F.col("stratum").alias("layer"))
    lab = lab.join(F.broadcast(names), lab["stratum"] == names["layer"], "left")  # at most `strata` names
    n = lab.count()
    groups = lab.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("layer", "record_id").alias("home"), F.min_by("stratum", "record_id").alias("own"))
    is_large = F.col("n") * LARGE >= n
    bucket = F.pmod(F.xxhash64("group_id"), F.lit(BUCKETS)).cast("string")
    unit = F.when(is_large, F.concat(F.lit("g"), F.col("group_id").cast("string"))).otherwise(F.concat_ws(":", bucket, F.col("home")))
    groups = groups.select("group_id", "n", "own", F.when(is_large | F.col("home").isNotNull(), unit).alias("unit"))
    bucketed = lab.join(groups.select("group_id", "unit"), "group_id")
    per: dict[str, dict[str, int]] = {}
    totals: dict[str, dict[str, int]] = {}
    # At most LARGE + strata x BUCKETS units; rows of smaller strata in them count together.
    for r in bucketed.filter("unit IS NOT NULL").groupBy("unit", F.coalesce("layer", F.lit("")).alias("layer")).count().collect():
        per.setdefault(r.unit, {})[r.layer] = r["count"]
        totals.setdefault(r.layer, {})[r.unit] = r["count"]
    taken: dict[tuple[str, str], int] = {}
    chosen = []
    for u in sorted(per, key=lambda u: (-sum(per[u].values()), u)):
        split = deal(totals, taken, per[u])
        chosen.append((u, split))
        for s, k in per[u].items():
            taken[split, s] = taken.get((split, s), 0) + k
    table = spark.createDataFrame(chosen, "unit string, split string")
    # Small strata: the share of the stratum that comes before the middle of a group.
    by = Window.partitionBy("own").orderBy(F.xxhash64("group_id"), "group_id")
    before = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") / 2
    share = before / F.sum("n").over(Window.partitionBy("own"))
    # Turned by a number of the stratum's own, so that strata of a group or two don't all go to one split.
    share = F.pmod(share + F.pmod(F.xxhash64("own"), F.lit(1 << 20)) / (1 << 20), F.lit(1.0))
    split = F.lit(PROPORTIONS[-1][0])
    for (name, _), upto in reversed(list(zip(PROPORTIONS, itertools.accumulate(p for _, p in PROPORTIONS)))[:-1]):
        split = F.when(share < upto, name).otherwise(split)
    small = groups.filter("unit IS NULL").withColumn("split", split).select("group_id", F.col("split").alias("own_split"))
    out = bucketed.join(F.broadcast(table), "unit", "left").join(small, "group_id", "left")
    return out.select("record_id", "group_id", "stratum", F.coalesce("split", "own_split").alias("split"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "pairs").select(F.col("pair_id").alias("record_id"), "chunk_id", "query")
    return pairs.unionByName(read_table(spark, sf_dir, "val").select(F.col("val_id").alias("record_id"), "chunk_id", "query"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of two or more."""
    return groups_of_two(group_labels(_records(spark, sf_dir)))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its split; the strata are the documents of chunk_id."""
    rows = _records(spark, sf_dir)
    strata = rows.groupBy("record_id").agg(F.min(F.lower(F.regexp_extract("chunk_id", "([A-Za-z]+)", 1))).alias("stratum"))
    return assign(group_labels(rows).join(strata, "record_id"))


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split and stratum."""
    return p4_splits(spark, sf_dir).groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_balance": p4_balance}
ORACLE: dict[str, str] = {}
