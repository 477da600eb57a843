"""File-source streaming of prediction lines into a table keyed by model and page. An addition of this library, not of the reference."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "model string, sample_id string, raw_text string, written_at timestamp"


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def upserted(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The latest line of each model and page; replaying a batch changes nothing."""
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy("model", "sample_id").agg(F.max_by(F.struct("raw_text", "written_at"), F.struct("written_at", "raw_text")).alias("r")).select("model", "sample_id", "r.*")


def run(source: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Reads what is there and stops. Each batch is a folder of the table, named by the stream's checkpoint and the batch's number: a batch that
    runs twice replaces itself, and a stream with a new checkpoint adds to what others have written. Only the batch's own lines are written."""
    stream_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        upserted(None, batch).write.mode("overwrite").parquet(f"{table}/stream={stream_id}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The latest line of each model and page over all batches."""
    return upserted(None, spark.read.parquet(table).select("model", "sample_id", "raw_text", "written_at"))


def compacted(spark: SparkSession, table: str, target: str) -> None:
    """Writes the latest lines as one table, for when batches are many; the batches stay until they are removed."""
    latest(spark, table).write.mode("overwrite").parquet(f"{target}/stream=compacted/batch=0")


def by_minute(source: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Predictions a model and minute, with a bound on how late lines may come."""
    return source.withWatermark("written_at", late).groupBy("model", F.window("written_at", "1 minute").alias("w")).agg(F.count("*").alias("n"))
