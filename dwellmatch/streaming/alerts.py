"""Source health on a stream of finished runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.operators.monitor import run_gauges
from dwellmatch.sources.sinks import VersionedTable, append_batch


def with_event_time(runs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Zone-less times become instants under UTC before the watermark."""
    return runs.withColumn("finished_at", F.col("finished_at").cast("timestamp")).withWatermark("finished_at", delay)


def error_windows(runs: DataFrame, width: str = "15 minutes", step: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sliding error counts per source; a window is emitted once the watermark passes it."""
    return (
        with_event_time(runs, delay)
        .groupBy("source_slug", F.window("finished_at", width, step).alias("w"))
        .agg(F.sum("errors").alias("errors"), F.sum("items_new").alias("items_new"))
        .filter("errors > 0")
        .select("source_slug", F.col("w.start").alias("window_start"), "errors", "items_new")
    )


def live_totals(runs: DataFrame) -> DataFrame:
    """Running totals per source and status (update or complete mode)."""
    return runs.groupBy("source_slug", "status").agg(
        F.count("*").alias("runs"), F.sum("errors").alias("errors"), F.sum("items_new").alias("items_new")
    )


@dataclass
class StallWatch:
    """Stalled and recovered transitions per source, across micro-batches.

    The batch is reduced to one row per source before it meets the stored gauges, so a
    busy source costs no more than a quiet one. Time is the newest run seen so far.
    """

    spark: SparkSession
    root: str
    max_age_seconds: int = 900

    def __post_init__(self) -> None:
        self.gauges = VersionedTable(self.spark, f"{self.root}/gauges", "source_slug", buckets=1)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        new = run_gauges(batch).withColumn("newest", F.lit(None).cast("timestamp"))
        newest = batch.agg(F.max(F.col("finished_at").cast("timestamp"))).first()[0]
        stored = self.gauges.read(batch_id)
        if stored is None:
            stored = self.spark.createDataFrame([], "source_slug string, last_success_at timestamp, stalled boolean, as_of timestamp")
        old = stored.select("source_slug", F.col("last_success_at").alias("_s"), "stalled", "as_of")
        merged = new.select("source_slug", F.col("last_success_at").cast("timestamp").alias("_n")).join(old, "source_slug", "full_outer")
        now = F.greatest(F.lit(newest).cast("timestamp"), F.col("as_of"))
        success = F.greatest("_s", "_n")
        age = F.unix_seconds(now) - F.unix_seconds(success)
        state = merged.select(
            "source_slug",
            success.alias("last_success_at"),
            F.coalesce(age > self.max_age_seconds, F.lit(True)).alias("stalled"),
            now.alias("as_of"),
            F.coalesce("stalled", F.lit(False)).alias("_was"),
        )
        flips = state.filter("stalled <> _was").select(
            "source_slug", F.when(F.col("stalled"), "stalled").otherwise("recovered").alias("state"), "as_of"
        )
        append_batch(flips, f"{self.root}/alerts", batch_id)
        self.gauges.write(state.drop("_was"), batch_id)
