"""What the operators of this folder share: shared-folder tables, Arrow passes, hashes, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from dwellmatch.session import ensure_checkpoint_dir


class Shelf:
    """Tables in the shared folder that ``spark.checkpoint.dir`` names, to cut lineage.

    A written table survives the loss of executors. Each shelf has a folder of its own, which
    goes when the application ends, or sooner by ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._path(self.root)[1].deleteOnExit(self._path(self.root)[0])

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path, fs = self._path(f"{self.root}/{name}")
        fs.delete(path, True)


def worker_store(name: str) -> dict:
    """A dict that the Python worker keeps from task to task; tasks get their code by value, so module globals
    aren't kept. Only the operator that runs has one: asking for another drops it."""
    module = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store"))
    if module.__dict__.get("owner") != name:
        module.owner, module.store = name, {}
    return module.store


def release_memory() -> None:
    """Gives back what earlier stages left in this worker; workers are used again from stage to stage."""
    module = sys.modules.get("_llm_worker_store")
    if module is not None:
        module.owner, module.store = None, {}
    trim_memory()


def trim_memory() -> None:
    """Gives back what isn't in use; a worker that waits for a task would hold it beside those that have one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Rows that are Python objects at a time; an Arrow batch may have ten times as many.
ROWS_AT_A_TIME = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield batch.slice(at, ROWS_AT_A_TIME)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, work: Callable[[list], dict[str, list]]) -> DataFrame:
    """One row per document: ``work`` gets some texts (None for null) and returns columns for ``schema``.

    The id stands first, unchanged.
    """
    want = StructType([StructField(id_col, df.schema[id_col].dataType), *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = work(batch.column(1).to_pylist())
            cols = [batch.column(0).cast(arrow.field(0).type)]
            cols += [pa.array(got[f.name], type=f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)
            del got, cols
        trim_memory()

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, want)


def with_made(df: DataFrame, text_col: str, made: str, schema: str, work: Callable[[list], dict[str, list]]) -> DataFrame:
    """All columns as they are, and what ``work`` makes of the texts as one struct column ``made``."""
    fields = StructType.fromDDL(schema)
    want = StructType([*df.schema, StructField(made, fields)])
    arrow = to_arrow_schema(want)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = work(batch.column(at).to_pylist())
            inner = list(arrow.field(made).type)
            column = pa.StructArray.from_arrays([pa.array(got[f.name], type=f.type) for f in inner], fields=inner)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), column], schema=arrow)
            del got, column
        trim_memory()

    return df.mapInArrow(run, want)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: Edges that one task contracts.
EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task to (node, least node that these edges connect it with)."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if schema is not None:
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in (0, 1)], schema=schema)


def components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b): component is the smallest id reachable.

    Each round, tasks contract ``EDGES`` edges at most to stars. If that took one task, it's done;
    else a large-star and a small-star step over all stars follow, which never hold more edges than
    the first list and gather no neighbourhood. Each round is a table in the shared folder; rounds
    end when every node points to one root. A node with very many neighbours only ever takes part
    in a minimum, which combines before the shuffle, and in a join on its key, which adaptive
    execution can split.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, k, done = shelf.put(edges, "cc-0"), 0, False
    while not done:
        tasks = max(1, -(-now.count() // EDGES))
        stars = shelf.put(now.coalesce(tasks).mapInArrow(_contract, now.schema), f"cc-{k}-stars")
        if tasks == 1:
            now = stars
            break
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = shelf.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"cc-{k}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = shelf.put(large, f"cc-{k}-large")
        down = shelf.put(large.groupBy("u").agg(F.min("v").alias("m")), f"cc-{k}-down")
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = shelf.put(small.where("u <> v").distinct(), f"cc-{k + 1}")
        inner = small.join(small.select(F.col("v").alias("u")), "u", "left_semi")
        done = inner.isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty()
        for name in ("", "-stars", "-low", "-large", "-down"):
            shelf.drop(f"cc-{k}{name}")
        now, k = small, k + 1
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged(shelf: Shelf, component: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """``component`` (id, component) with more links (a, b) taken in, as a table. Only links between
    different components are gone through, as links of their components."""
    if component is None:
        return shelf.put(components(shelf, links), name)
    ends = links
    for side in ("a", "b"):
        to = component.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
        ends = ends.join(to, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    between = shelf.put(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b"), f"{name}-between")
    if between.isEmpty():
        return component
    roots = shelf.put(components(shelf, between), f"{name}-roots")
    moved = component.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    moved = moved.select("id", F.coalesce("root", "component").alias("component"))
    added = roots.join(component.select("id"), "id", "left_anti")
    return shelf.put(moved.unionByName(added), name)
