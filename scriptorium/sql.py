"""The tables as temporary views, and the text functions for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.runtime import read_table

TABLES = ("chunks", "gold", "units", "windows", "pairs", "val", "dropped", "generation_finetuned", "embeddings", "documents")


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(text)
