"""Phase health as a stream over the append-only run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.operators.runs import FAILED


def windowed_health(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Outcomes per window and phase; an event more than ``late`` behind the newest is dropped.

    Works on a stream (state per window and phase, dropped once the watermark
    has passed it) and on a finished table alike.
    """
    done = events.filter(F.col("status") != "start").withWatermark("at", late)
    return done.groupBy(F.window("at", every), "phase").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status").isin(*FAILED)).alias("failed"),
        F.avg("duration_ms").alias("mean_duration_ms"),
    )


def log_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of the log as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_health(events: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there now and append every closed window to ``out``.

    Runs to the end of the available input; started again it goes on from its
    checkpoint.  Both folders must be shared between the machines.
    """
    flat = windowed_health(events).select(F.col("window.start").alias("day"), "phase", "total", "ok", "failed", "mean_duration_ms")
    stream = (
        flat.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    stream.awaitTermination()
