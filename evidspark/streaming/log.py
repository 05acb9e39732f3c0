"""Streaming extensions: windows over the question log, sessions, and idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def windowed(events: DataFrame, size: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Counts and mean value by window and type; a watermark bounds the state of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late and events.isStreaming else rows
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late and events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ingest(stream: DataFrame, table, checkpoint: str, key: str = "source_file", order: tuple[str, ...] = ()):
    """Upsert every micro-batch into a VersionedTable; a batch that is replayed changes nothing.

    Of several rows of a key the last by the order columns stays, or the greatest of all columns. One writer at a time.
    """
    from evidspark.operators.catalog import latest_by
    from evidspark.sources.state import upsert

    def apply(batch: DataFrame, batch_id: int) -> None:
        latest = latest_by(batch, [key], list(order))
        table.write(upsert(table.read(), latest, key))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
