"""Deduplicated, rate-limited delivery over micro-batches, with retries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellmatch.functions.keys import delivery_key
from dwellmatch.operators.notify import CHAT_LIMIT, GLOBAL_LIMIT, WINDOW_MS, rate_limit
from dwellmatch.sources.sinks import VersionedTable, append_batch


def first_deliveries(stream: DataFrame) -> DataFrame:
    """One row per (subscription, listing) for the life of the query."""
    return stream.dropDuplicates(["subscription_id", "listing_id"])


def first_deliveries_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The same with bounded state: repeats farther apart than ``delay`` are not caught
    here but by the stored dedupe keys."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["subscription_id", "listing_id"])


@dataclass
class StoredDeliveries:
    """One row per (subscription, listing) for ever, with bounded state: behind
    ``first_deliveries_within``, which drops the repeats that come soon, the keys of a batch are
    looked up among the stored ones, of which only the batch's own buckets are read.

    Rows need ``subscription_id``, ``listing_id`` and ``time``; the earliest of a batch wins, equal times by
    ``order``. Replaying a batch writes the same rows again: it reads the keys of earlier batches only.
    """

    spark: SparkSession
    root: str
    time: str = "at"
    order: tuple[str, ...] = ()
    buckets: int = 64
    compact_every: int = 50

    def __post_init__(self) -> None:
        self.keys = VersionedTable(self.spark, f"{self.root}/keys", "dedupe_key", self.buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        key = delivery_key(F.col("subscription_id").cast("string"), F.col("listing_id").cast("string"))
        turn = F.row_number().over(Window.partitionBy("dedupe_key").orderBy(self.time, *self.order))
        firsts = batch.withColumn("dedupe_key", key).withColumn("_turn", turn).where("_turn = 1").drop("_turn").persist()
        try:
            known = self.keys.read(batch_id, self.keys.touched(firsts))
            fresh = firsts if known is None else firsts.join(known.select("dedupe_key"), "dedupe_key", "left_anti")
            append_batch(fresh, f"{self.root}/first", batch_id)
        finally:
            firsts.unpersist()
        # The keys follow the rows: after a loss between the two, the batch runs again as a whole.
        written = self.spark.read.schema(fresh.schema).parquet(f"{self.root}/first/batch_id={batch_id}")
        self.keys.write(written.select("dedupe_key"), batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            self.keys.compact(batch_id)


@dataclass
class LimitedDelivery:
    """Admits attempts under the two windows; refused ones come back in a later batch.

    Attempts: attempt_id, chat_id, ts. A refused attempt returns with the time its window
    ends. Windows that earlier batches already used are charged first.
    """

    spark: SparkSession
    root: str
    global_limit: int = GLOBAL_LIMIT
    chat_limit: int = CHAT_LIMIT
    window_ms: int = WINDOW_MS

    def _log(self, name: str, batch_id: int) -> DataFrame:
        schema = "attempt_id bigint, chat_id bigint, ts timestamp, batch_id bigint"
        reader = self.spark.read.schema(schema)
        try:
            rows = reader.parquet(f"{self.root}/{name}")
        except AnalysisException:  # no batch has written yet
            rows = self.spark.createDataFrame([], schema)
        return rows.filter(F.col("batch_id") < batch_id)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        cols = ["attempt_id", "chat_id", "ts"]
        waiting = self._log("waiting", batch_id).filter(F.col("batch_id") == batch_id - 1).select(*cols)
        now = batch.select(*[F.col(c).cast("timestamp") if c == "ts" else F.col(c) for c in cols]).unionByName(waiting)
        slot = F.floor(F.unix_millis("ts") / self.window_ms)
        used = self._log("admitted", batch_id).select(*cols).withColumn("_slot", slot)
        # Only windows this batch touches again are read back.
        used = used.join(now.select(slot.alias("_slot")).distinct(), "_slot", "left_semi").drop("_slot")
        rows = used.withColumn("_new", F.lit(0)).unionByName(now.withColumn("_new", F.lit(1)))
        judged = rate_limit(rows, ["_new", "ts", "attempt_id"], self.global_limit, self.chat_limit, self.window_ms)
        judged = judged.filter("_new = 1")
        append_batch(judged.filter("allowed").select(*cols), f"{self.root}/admitted", batch_id)
        later = F.timestamp_millis(F.unix_millis("ts") + F.col("retry_after_ms"))
        refused = judged.filter("not allowed").select("attempt_id", "chat_id", later.alias("ts"))
        append_batch(refused, f"{self.root}/waiting", batch_id)
