"""Keeping hot keys from landing in one task.

A key is hot when it holds more than 1/``share`` of the rows and more rows than one task
should take. There are fewer than ``share`` such keys whatever the data size, so the list
is safe to bring to the driver and to broadcast. It only steers how work is split;
results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARE = 256
CHUNKS = 64
MIN_ROWS = 500_000


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = SHARE, min_rows: int = MIN_ROWS) -> dict[int, int]:
    """Hash of each hot key → number of slices it should be cut into.

    One pass with a frequent-items sketch (mergeable, fixed size), no shuffle by key.
    ``min_rows`` is what one task may hold of a key before cutting pays off.
    """
    row = (
        df.select(F.xxhash64(*keys).alias("h"))
        .agg(F.expr(f"approx_top_k(h, {share}, {share * 40})").alias("top"), F.count("*").alias("n"))
        .first()
    )
    per_slice = max(min_rows, row["n"] // share)
    return {
        item["item"]: -(-item["count"] // per_slice)
        for item in row["top"] or []
        if item["item"] is not None and item["count"] > per_slice
    }


def default_slices(df: DataFrame) -> int:
    """Slices per key: grows with the configured shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)


def sliced_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], slices: int | None = None
) -> DataFrame:
    """Inner equi-join in which the rows of one key go to several tasks.

    Every row of ``big`` falls into one slice by a hash of ``spread_by`` (stable when a
    task is re-run); the far smaller side is repeated per slice. No pass over the data
    is needed to find the crowded keys first.
    """
    n = default_slices(big) if slices is None else slices
    if n == 1:
        return big.join(small, list(on))
    left = big.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(n)).cast("int"))
    right = small.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*on, "_slice"]).drop("_slice")


class KeyedHistory:
    """Ordered versions per key, with look-back that also works for hot keys.

    Cold keys use plain windows. A hot key is cut into time chunks at approximate
    quantiles of the order time; each chunk is windowed alone and receives what the
    chunks before it carry over, from a table of at most share × chunks rows.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        time: str,
        order: Sequence[str],
        share: int = SHARE,
        min_rows: int = MIN_ROWS,
        chunks: int = CHUNKS,
    ):
        self.keys, self.order, self.chunks = list(keys), list(order), chunks
        hot = hot_keys(df, keys, share, min_rows)
        self.hot = bool(hot)
        parts = [*self.keys, "_hot", "_chunk"] if hot else self.keys
        # Rows that came dealt out by key are dealt out anew, since chunks of a key may not stay in one task.
        self.df = self._cut(df, time, hot).repartition(*parts) if hot else df
        self.window = Window.partitionBy(*parts).orderBy(*self.order)

    def _cut(self, df: DataFrame, time: str, hot: dict[int, int]) -> DataFrame:
        h = F.xxhash64(*self.keys)
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        steps = [i / self.chunks for i in range(1, self.chunks)]
        edges = (
            df.filter(h.isin(list(hot)))
            .groupBy(h.alias("_h"))
            .agg(F.percentile_approx(micros, steps, 1000).alias("_edges"))
        )
        # Fewer than ``share`` rows of ``chunks`` numbers each.
        return (
            df.withColumn("_h", h)
            .join(F.broadcast(edges), "_h", "left")
            .withColumn("_hot", F.col("_edges").isNotNull())
            .withColumn("_chunk", F.coalesce(F.size(F.filter("_edges", lambda e: e < micros)), F.lit(0)))
            .drop("_h", "_edges")
        )

    def _carry(self, value: Column, name: str) -> DataFrame:
        """Last non-null ``value`` of all earlier chunks, per hot key and chunk."""
        ordered = F.struct(*self.order)
        last = (
            self.df.filter("_hot")
            .groupBy(*self.keys, "_chunk")
            .agg(F.max_by(value, F.when(value.isNotNull(), ordered)).alias("_v"))
        )
        before = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return last.select(*self.keys, "_chunk", F.last("_v", ignorenulls=True).over(before).alias(name))

    def _with(self, name: str, local: Column, value: Column) -> None:
        df = self.df.withColumn(name, local)
        if self.hot:
            carry = self._carry(value, "_carry")
            df = (
                df.join(F.broadcast(carry.withColumn("_hot", F.lit(True))), [*self.keys, "_hot", "_chunk"], "left")
                .withColumn(name, F.coalesce(name, "_carry"))
                .drop("_carry")
            )
        self.df = df

    def add_latest(self, name: str, value: Column) -> None:
        """Last non-null ``value`` up to and including the row."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self._with(name, F.last(value, ignorenulls=True).over(frame), value)

    def add_previous(self, name: str, value: Column) -> None:
        """Last non-null ``value`` before the row; a struct value is the previous row."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, -1)
        self._with(name, F.last(value, ignorenulls=True).over(frame), value)

    def result(self) -> DataFrame:
        return self.df.drop("_hot", "_chunk")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. The rank filter becomes a per-task group limit before the
    shuffle, so a hot key sends one row per map task."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def mark_first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: Column | int, cap: int, out: str
) -> DataFrame:
    """Boolean ``out``: the row is among the first ``n`` of its group (``n`` ≤ ``cap``, by row).

    Only up to ``cap`` rows per group are ranked (group limit before the shuffle); all
    others compare themselves with the position of the n-th row. ``cap`` bounds what is
    ranked, never what is returned. ``order`` must be unique within a group.
    """
    keys = list(keys)
    n = F.lit(n) if isinstance(n, int) else n
    at = F.struct(*order)
    w = Window.partitionBy(*keys).orderBy(*order)
    top = (
        df.select(*keys, at.alias("_at"), n.alias("_n"), *order)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= cap)
        .filter(F.col("_rn") <= F.col("_n"))
    )
    edge = top.groupBy(*keys).agg(F.max("_at").alias("_edge"))
    return (
        df.join(edge, keys, "left")
        .withColumn(out, F.coalesce(at <= F.col("_edge"), F.lit(False)))
        .drop("_edge")
    )

