"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dwellmatch.llm.common import Shelf, map_texts, merged, mix64, worker_store

TREES, DEPTH = 12, 8
#: Shortest common prefix that makes a candidate. Two sets of similarity 0.8 share it in a given
#: order with probability 0.51, and in none of the 12 with 0.0002.
LEAST_DEPTH = 3
#: Rows before it in an order that a row is compared with: its longest common prefixes.
NEAR = 3
#: Members of a component that documents beside it are compared with, besides the member they stand
#: next to and the one that this member is linked with.
HUBS = 3
#: Words whose hashes a worker keeps.
KEEP_WORDS = 200_000
#: Shingles that are hashed at a time.
CHUNK = 1 << 17

_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
POSITIONS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of the whole text if it has fewer.

    A-Z is lower-cased; words stand between spaces and the controls from tab to carriage return.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    known = worker_store("word hashes")
    if "map" not in known or len(known["map"]) > KEEP_WORDS:
        known["map"] = _WordHashes()
    h = np.fromiter(map(known["map"].__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        total += h[k : len(h) - size + 1 + k] * POSITIONS[k]
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Per set TREES * DEPTH minima as big-endian 32-bit numbers, so that bytes sort as numbers do."""
    lengths = np.array([len(s) for s in sets])
    out = np.full((len(sets), TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    rows = np.flatnonzero(lengths)
    at = 0
    while at < len(rows):
        stop, size = at, 0
        while stop < len(rows) and (stop == at or size + lengths[rows[stop]] <= CHUNK):
            size += lengths[rows[stop]]
            stop += 1
        part = rows[at:stop]
        flat = np.concatenate([sets[r] for r in part])
        starts = np.concatenate([[0], np.cumsum(lengths[part])[:-1]])
        for k, a in enumerate(MULTIPLIERS):
            out[part, k] = np.minimum.reduceat(flat * a >> np.uint64(32), starts)
        at = stop
    return out.astype(">u4")


def sign(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, signature): equal sets have equal 128-bit set digests."""

    def work(texts: list[str | None]) -> dict[str, list]:
        sets = [shingle_set(t, words) for t in texts]
        digest = [[int(mix64(s ^ salt).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))]
        return {"n_shingles": [len(s) for s in sets], "set_a": digest[0], "set_b": digest[1], "signature": [row.tobytes() for row in signatures(sets)]}

    return map_texts(docs, id_col, text_col, "n_shingles long, set_a long, set_b long, signature binary", work)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def work(texts: list[str | None]) -> dict[str, list]:
        return {"shingles": [shingle_set(t, words).astype(np.int64) for t in texts]}

    return map_texts(docs, id_col, text_col, "shingles array<long>", work)


def _pairs_in_order(near: int, tree: np.ndarray, key: np.ndarray, ids: np.ndarray, group: np.ndarray, fresh: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, common prefix, group of a, group of b) of rows at most ``near`` apart, in the same tree and of different groups.

    The last ``fresh`` rows have not been compared with those before them yet.
    """
    n = len(ids)
    for lag in range(1, near + 1):
        low = max(n - fresh, lag)
        if low >= n:
            continue
        now, then = slice(low, n), slice(low - lag, n - lag)
        common = np.cumprod(key[now] == key[then], axis=1).sum(axis=1)
        hit = (tree[now] == tree[then]) & (common >= LEAST_DEPTH) & (group[now] != group[then])
        yield ids[now][hit], ids[then][hit], common[hit], group[now][hit], group[then][hit]


def sorted_neighbours(rows: DataFrame, shelf: Shelf, name: str, near: int) -> DataFrame:
    """Candidate pairs (a, b, depth, group_a, group_b) from rows (tree, key, id, group): neighbours in each
    tree's order, with their groups, so that no join has to look these up for every pair.

    The orders are range-partitioned on (tree, key, tie, id), so a crowded region is spread over tasks,
    and tasks stream through their rows. ``tie`` holds minima of the next tree: rows of equal keys
    stand by likeness, differently in each tree. A row meets the ``near`` rows before it: where a region
    is crowded, these are the ones with the longest common prefixes, which is how the depth adapts.
    The outer rows of each partition are compared across its borders in a second, small step.
    Neighbouring rows of one group (documents known to be linked) count as one: only the ends of
    such a run are kept, so that what stands on either side of it meets.
    """
    spark = rows.sparkSession
    id_field = rows.schema["id"].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "key", "tie", "id"]
    ordered = rows.select(*order, "group").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("tree", "key", "id", "group")
    schema = StructType([*StructType.fromDDL("border int, tree int, key binary"), StructField("a", id_field), StructField("b", id_field), *StructType.fromDDL("depth int"), StructField("group_a", id_field), StructField("group_b", id_field)])

    def found_of(a, b, depth, *groups) -> list[pa.Array]:
        return [pa.array(a), pa.array(b), pa.array(depth.astype(np.int32)), *map(pa.array, groups)]

    def batch_of(border, tree, key, a, b, depth, group_a, group_b) -> pa.RecordBatch:
        n = len(a)
        cols = [pa.array(np.full(n, border, np.int32)) if border is not None else pa.nulls(n, pa.int32()), tree, key, a, b, depth, group_a, group_b]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def frame(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
        keys = np.frombuffer(b"".join(batch.column(at + 1).to_pylist()), ">u4").reshape(-1, DEPTH)
        return [batch.column(at).to_numpy(), keys, batch.column(at + 2).to_numpy(), batch.column(at + 3).to_numpy()]

    def ends_of_runs(got: list[np.ndarray]) -> np.ndarray:
        """Rows at the start or end of a run of one group in one tree."""
        tree, _, ids, group = got
        change = np.ones(len(ids) + 1, bool)
        change[1:-1] = (group[1:] != group[:-1]) | (tree[1:] != tree[:-1])
        return change[:-1] | change[1:]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None
        head: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = frame(batch, 0)
            got = [x[ends_of_runs(got)] for x in got]
            fresh = len(got[2])
            head = got if head is None else head if len(head[2]) >= near else [np.concatenate(x) for x in zip(head, got)]
            head = [x[:near] for x in head]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            for pair in _pairs_in_order(near, *held, fresh):
                yield batch_of(None, pa.nulls(len(pair[0]), pa.int32()), pa.nulls(len(pair[0]), pa.binary()), *found_of(*pair))
            held = [x[-near:] for x in held]
        for border, rows_ in ((part, head), (part + 1, held)):
            if rows_ is not None:
                tree, keys, ids, group = rows_
                place = np.arange(len(ids), dtype=np.int32) + (near if border == part else 0)
                here = pa.array(ids)
                none = pa.nulls(len(ids), here.type)
                yield batch_of(border, pa.array(tree.astype(np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), here, pa.array(group), pa.array(place), none, none)

    found = shelf.put(ordered.mapInArrow(walk, schema), name)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, border = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, keys, ids, group = frame(batch, 1)
            borders = batch.column(0).to_numpy()
            for at in np.flatnonzero(np.diff(borders, prepend=-1)):
                stop = at + int((borders == borders[at]).sum())
                now = [x[at:stop] for x in (tree, keys, ids, group)]
                if borders[at] == border:
                    now = [np.concatenate(x) for x in zip(held, now)]
                    fresh = stop - at
                else:
                    fresh = len(now[2])
                held, border = now, borders[at]
                for pair in _pairs_in_order(near, *now, fresh):
                    yield pa.RecordBatch.from_arrays(found_of(*pair), names=schema.names[3:])

    edges = found.where("border is not null").repartition(F.col("border")).sortWithinPartitions("border", "depth")
    across = edges.select("border", "tree", "key", "a", "b").mapInArrow(meet, StructType(list(schema)[3:]))
    pairs = found.where("border is null").select(*schema.names[3:]).unionByName(across)
    up = F.col("a") < F.col("b")
    groups = [F.when(up, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("group_a", "group_b"), ("group_b", "group_a"))]
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "depth", *groups)
    # An id has one group.
    return pairs.groupBy("a", "b").agg(F.sum("depth").alias("depth"), F.min("group_a").alias("group_a"), F.min("group_b").alias("group_b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Components of near-duplicate documents: (id, n_shingles, component_id, kept).

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` hundredths or more, checked on the full sets. ``component_id`` is the smallest id
    reachable over links, ``kept`` tells whether that is the document itself.

    1. One pass makes signatures of 12 x 8 minima and a digest of each set; documents with equal
       sets form a class, which the smallest id stands for, so copies cost no comparisons.
    2. Classes are sorted once for each of the 12 trees; neighbours with a common prefix of
       3 or more are candidates (``sorted_neighbours``): 3 rows on either side.
    3. Each class first checks its best candidate on full sets. A candidate pair that now lies in
       one component needs no check; all others are checked then.
    4. Components then count as groups in the sorted orders, which brings documents together that
       members of a large group stood between, and each one next to a component with its hubs and
       with what its neighbour there is linked with; these pairs are checked as in 3. This is done
       until it links nothing more; from the third turn on, only where components grew.

    Null, empty and blank texts have no shingles and are linked with nothing. A null id takes part
    in no link, its component is null and it is kept. Repeated rows each get their row, judged by
    their own text; other columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "minhash-forest")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = shelf.put(sign(source, "id", "text", words), "signed")
    classes = signed.where("n_shingles > 0 and id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    classes = shelf.put(classes, "classes")
    width = DEPTH * 4
    keys = [F.struct(F.substring("signature", t * width + 1, width).alias("key"), F.substring("signature", (t + 1) % TREES * width + 1, 8).alias("tie")) for t in range(TREES)]
    planted = classes.select(F.col("rep").alias("id"), F.posexplode(F.array(*keys)).alias("tree", "at")).select("id", "tree", "at.key", "at.tie")

    fresh = shelf.put(sorted_neighbours(planted.withColumn("group", F.col("id")), shelf, "order-0", NEAR).select("a", "b", "depth"), "pairs-0")
    shelf.drop("order-0")
    involved = fresh.select(F.col("a").alias("id")).unionByName(fresh.select(F.col("b").alias("id"))).distinct()
    involved = shelf.put(involved, "involved")
    # The id's smallest text stands for it, should ids repeat with different texts.
    wanted = source.where("id is not null").join(involved, "id", "left_semi")
    sets = shelf.put(shingle_sets(wanted, "id", "text", words), "sets").join(classes.select(F.col("rep").alias("id"), "n_shingles"), "id").where(F.size("shingles") == F.col("n_shingles")).select("id", "shingles").dropDuplicates(["id"])
    sets = shelf.put(sets, "sets-of-classes")

    component, k = None, 0
    while True:
        before = component
        ends = fresh.select(F.col("a").alias("id"), "a", "b", "depth").unionByName(fresh.select(F.col("b").alias("id"), "a", "b", "depth"))
        best = ends.groupBy("id").agg(F.max(F.struct("depth", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        checked = shelf.put(_linked(best, sets, percent), f"checked/k={2 * k}")
        component = merged(shelf, component, checked.where("linked"), f"component-{2 * k}")
        left = shelf.put(_apart(fresh.join(checked, ["a", "b"], "left_anti"), component).select("a", "b", "depth"), f"left-{k}")
        checked = shelf.put(_linked(left, sets, percent), f"checked/k={2 * k + 1}")
        component = merged(shelf, component, checked.where("linked"), f"component-{2 * k + 1}")
        for name in (f"pairs-{k}", f"left-{k}"):
            shelf.drop(name)
        k += 1
        if component is before or component.isEmpty():
            break
        grouped = planted.join(involved, "id", "left_semi").join(component, "id", "left").select("tree", "key", "tie", "id", F.coalesce("component", "id").alias("group"))
        if before is not None:
            grouped = _where_grown(grouped, component, before)
        seen = spark.read.schema(checked.schema).parquet(*[f"{shelf.root}/checked/k={i}" for i in range(2 * k)])
        again = sorted_neighbours(grouped, shelf, f"order-{k}", NEAR)
        again = _with_hubs(again, component, classes, seen.where("linked"))
        fresh = shelf.put(again.join(seen, ["a", "b"], "left_anti"), f"pairs-{k}")
        shelf.drop(f"order-{k}")
        if fresh.isEmpty():
            break

    classes = shelf.put(classes.select("set_a", "set_b", "n_shingles", F.col("rep").alias("id")).join(component, "id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("component_id")), "result")
    out = signed.select("id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with the verdict of their full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.select("a", "b", (100 * common >= percent * (F.size("left") + F.size("right") - common)).alias("linked"))


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    sides = pairs
    for side in ("a", "b"):
        sides = sides.join(component.select(F.col("id").alias(side), F.col("component").alias(f"group_{side}")), side, "left")
    return sides.withColumns({"group_a": F.coalesce("group_a", "a"), "group_b": F.coalesce("group_b", "b")}).where("group_a <> group_b")


def _where_grown(rows: DataFrame, component: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that share the shortest prefix with a row of a component that grew: where none did, the rows
    in between are as before, and so are the neighbours."""
    was = before.select("id", F.col("component").alias("was"))
    grown = component.join(was, "id", "left").where("was is null or was <> component").select(F.col("component").alias("group")).distinct()
    bucket = F.substring("key", 1, LEAST_DEPTH * 4)
    rows = rows.withColumn("bucket", bucket)
    return rows.join(rows.join(grown, "group", "left_semi").select("tree", "bucket").distinct(), ["tree", "bucket"], "left_semi").drop("bucket")


def _with_hubs(pairs: DataFrame, component: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of different components, and each document with the hubs of the component it stands next to
    (the members with most copies and links, which an outer member is most likely to resemble), and with
    that one of most links which the member next to it is linked with."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.col("copies") + F.col("degree")), "id"))
    members = component.join(classes.select(F.col("rep").alias("id"), "copies"), "id").join(degree, "id").withColumn("rank", rank).where(F.col("rank") <= HUBS)
    hubs = members.groupBy("component").agg(F.collect_list("id").alias("hubs"))
    sides = pairs.select(F.col("a").alias("id"), F.col("b").alias("member"), F.col("group_b").alias("component")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("member"), F.col("group_a").alias("component")))
    ends = links.select(F.col("a").alias("member"), F.col("b").alias("id")).unionByName(links.select(F.col("b").alias("member"), F.col("a").alias("id")))
    centre = ends.join(degree, "id").groupBy("member").agg(F.max(F.struct("degree", "id")).alias("top")).select("member", F.col("top.id").alias("hub"))
    beside = sides.select("id", "component").distinct().join(hubs, "component").select("id", F.explode("hubs").alias("hub"))
    beside = beside.unionByName(sides.select("id", "member").join(centre, "member").select("id", "hub")).where("id <> hub")
    beside = beside.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.lit(0).cast("long").alias("depth"))
    return pairs.select("a", "b", "depth").unionByName(beside).groupBy("a", "b").agg(F.max("depth").alias("depth"))
