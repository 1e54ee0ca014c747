"""The append-and-resume log of question generation as a stream: new passages in, a record appended for each, once.

The engine this stands for appends to a log and skips what is there; here the checkpoint of the stream does that, and
`pending` gives the same answer for a batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions import text as tx
from scriptorium.sources import records


def pending(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Passages that have no record without an error yet."""
    return chunks.join(log.filter("error IS NULL").select("chunk_id").distinct(), "chunk_id", "left_anti")


def candidates_of(replies: DataFrame, most: int = 2) -> DataFrame:
    """(chunk_id, questions, error) from (chunk_id, reply, error)."""
    return replies.select("chunk_id", F.coalesce(tx.parsed_questions(F.col("reply"), most), F.array().cast("array<string>")).alias("questions"), "error")


def follow(spark: SparkSession, source: str, log: str, checkpoint: str, reply) -> StreamingQuery:
    """Appends a record for each passage that arrives as JSON Lines in `source`; reply is a function from (chunk_id, text) rows to (chunk_id, reply, error)."""
    stream = spark.readStream.schema(records.CHUNK).json(source).select("chunk_id", "text")

    def step(batch: DataFrame, _: int) -> None:
        done = records.read_jsonl(batch.sparkSession, log, records.CANDIDATE, missing_ok=True)
        fresh = pending(batch.dropDuplicates(["chunk_id"]), done)
        candidates_of(reply(fresh)).write.mode("append").json(log)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
