"""Streams: documents as they arrive, and windows over events with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def incoming(spark: SparkSession, path: str, schema: str = DOCUMENTS, files_at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def lines_by_class(documents: DataFrame) -> DataFrame:
    """The batch plan of line classes, on a batch or a stream."""
    line = documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return line.groupBy("doc_id", X.line_class(F.col("line")).alias("line_class")).agg(F.count("*").alias("n_lines"))


def apply_to_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs a batch plan on each micro-batch and writes it under its batch number, so that a repeated batch replaces itself."""

    def each(df: DataFrame, number: int) -> None:
        plan(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count and sum by type and window; rows later than ``late`` are left out of a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
