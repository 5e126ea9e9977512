"""Continuous ingestion: files of documents arrive, each micro-batch is one upsert of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgweft.plans.engine import Engine

ARRIVING = "id string, title string, abstract string, url string, source string, citations bigint, received_at timestamp"


def arriving(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """A stream of JSON document records; a record repeated within ``late`` of the newest one comes once."""
    stream = spark.readStream.schema(ARRIVING).json(path)
    return stream.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["id"])


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Upsert each micro-batch. Upserts count, so a batch that is replayed after a failure is recognised by its number and left out."""

    def upsert(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        placed = batch.orderBy("received_at", "id").withColumn("ord", F.monotonically_increasing_id())  # rises along the sorted partitions
        engine.ingest(placed, batch=f"stream-{number}")

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def mentions_per_window(mentions: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mentions by predicate and time window, late ones included until the watermark passes."""
    return mentions.withWatermark("extracted_at", late).groupBy(F.window("extracted_at", width), "predicate").agg(F.count(F.lit(1)).alias("mentions"))
