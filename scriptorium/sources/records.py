"""JSON Lines scans and sinks with fixed schemas, index metadata, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CHUNK = (
    "pos BIGINT, chunk_id STRING, doc_id STRING, doc_title STRING, section STRING, text STRING, pdf_pages ARRAY<INT>, printed_pages ARRAY<STRING>, title STRING, part STRING, "
    "covers ARRAY<STRING>, is_amendment BOOLEAN, amends ARRAY<STRING>, source STRING, parent STRING"
)
EVIDENCE = "ARRAY<STRUCT<chunk_id: STRING, section: STRING, pdf_pages: ARRAY<INT>, quote: STRING>>"
GOLD = f"id STRING, question STRING, doc STRING, question_type STRING, wording STRING, answer STRING, must_include ARRAY<STRING>, evidence {EVIDENCE}, note STRING"
CANDIDATE = "chunk_id STRING, questions ARRAY<STRING>, error STRING"
PAIR = "query STRING, chunk_id STRING, negative_id STRING"
REQUIRED = {"chunk": ("chunk_id", "doc_id", "section", "text"), "gold": ("id", "question", "doc", "question_type", "wording", "answer")}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def file_states(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of every file under a path, in order: what tells one state of a table from another without reading it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return sorted(out)


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), missing_ok: bool = False) -> DataFrame:
    """Rows of JSON Lines files; blank lines are skipped. A malformed line or one without a required field fails the job and names itself.
    Where `missing_ok`, a path that doesn't exist has no rows."""
    kind = T._parse_datatype_string(schema)
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], kind)
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.input_file_name().alias("file"))
    parsed = lines.select("value", "file", F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull()
    for name in required:
        bad = bad | F.col(f"r.{name}").isNull()
    told = F.raise_error(F.concat(F.lit("malformed record in "), "file", F.lit(": "), F.substring("value", 1, 200)))
    checked = parsed.filter(F.when(bad, told.cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields))


def write_jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "overwrite") -> None:
    (df.repartitionByRange(order).sortWithinPartitions(order) if order else df).write.mode(mode).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Passages with the defaults of their optional fields."""
    df = read_jsonl(spark, path, CHUNK, REQUIRED["chunk"])
    empty = F.array().cast("array<string>")
    for name in ("title", "part", "parent"):
        df = df.withColumn(name, F.coalesce(name, F.lit("")))
    for name in ("covers", "amends", "printed_pages"):
        df = df.withColumn(name, F.coalesce(name, empty))
    return df.withColumn("is_amendment", F.coalesce("is_amendment", F.lit(False))).withColumn("source", F.coalesce("source", F.lit("pdf")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    df = read_jsonl(spark, path, GOLD, REQUIRED["gold"])
    return df.withColumn("evidence", F.coalesce("evidence", F.array().cast(EVIDENCE))).withColumn("answerable", F.col("question_type") != "unanswerable")


def write_index(vectors: DataFrame, fingerprint: DataFrame, path: str, model: str) -> None:
    """Vectors keyed by passage, and one row that says what they were made from."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    row = vectors.agg(F.count(F.lit(1)).alias("passages"), F.max(F.size("vec")).alias("dim"))
    row.crossJoin(fingerprint).withColumn("model", F.lit(model)).write.mode("overwrite").parquet(f"{path}/meta")  # one row each


def read_index(spark: SparkSession, path: str, fingerprint: DataFrame) -> DataFrame:
    """The vectors, refused if the passages have changed since."""
    then, now = spark.read.parquet(f"{path}/meta").first().fingerprint, fingerprint.first().fingerprint
    if then != now:
        raise ValueError(f"the vectors were made from other passages ({then}, now {now}); build the index again")
    return spark.read.parquet(f"{path}/vectors")


def write_snapshot(df: DataFrame, path: str, version: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    """An earlier build; only its folder is read."""
    return spark.read.option("basePath", path).parquet(f"{path}/version={version}").drop("version")


def read_yaml(spark: SparkSession, path: str, missing_ok: bool = False) -> dict:
    """A hand-written YAML file, from any file system that Spark reads; where `missing_ok`, one that doesn't exist is empty."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    if missing_ok and not exists(spark, path):
        return {}
    row = spark.read.text(path, wholetext=True).first()
    return (yaml.safe_load(row.value) if row else None) or {}


def read_curated(spark: SparkSession, folder: str, doc_id: str, doc_title: str, content: str = "curated.yaml", aliases: str = "aliases.yaml") -> DataFrame:
    """Passages of a folder of hand-made content: tables and amendments, and names that have changed (apply_to, legend, aliases), which may be missing."""
    from scriptorium.operators import curated

    data, names = read_yaml(spark, f"{folder}/{content}"), read_yaml(spark, f"{folder}/{aliases}", missing_ok=True)
    rows = lambda kind, schema: spark.createDataFrame([{f.name: x.get(f.name) for f in T._parse_datatype_string(schema).fields} for x in data.get(kind) or []], T._parse_datatype_string(schema))
    return curated.passages(rows("tables", curated.TABLES), rows("amendments", curated.AMENDMENTS), doc_id, doc_title, dict(names.get("aliases") or {}), tuple(names.get("apply_to") or ()), names.get("legend") or "")
