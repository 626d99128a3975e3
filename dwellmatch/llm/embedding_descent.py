"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellmatch.llm.common import Shelf, components, merged

#: Orders of the first lists, rows of an order compared together, bits of its keys.
ORDERS, RUN, BITS = 8, 256, 24
#: Neighbours per list at first, and rounds of refinement with them at most.
NEIGHBOURS, ROUNDS = 8, 4
#: A round that changes fewer than this share of the entries is the last one.
SETTLED = 0.01
#: Vectors of a component that are compared block by block; of a label, if lists are full of links.
BLOCK, WIDE = 512, 2048
#: Vectors whose links are counted by brute force, and the share that must be found.
AUDITED, RECALL = 256, 0.98

PAIRS = "u {id}, v {id}, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    return np.array([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    rows = column.to_numpy(zero_copy_only=False)
    lengths = np.array([len(r) for r in rows])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, np.array([np.asarray(rows[k], np.float64) for k in at])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal first ``keys`` columns, as arrays, the last column as a matrix; runs longer
    than ``most`` are cut."""
    held: list[pa.RecordBatch] = []
    name = None

    def done() -> list[np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        return [*(c.to_numpy(zero_copy_only=False) for c in cols[:-1]), _matrix(cols[-1])]

    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            now = tuple(c[a] for c in cols)
            while a < b:
                if held and (now != name or count == most):
                    yield done()
                    held, count = [], 0
                take = b - a if most is None else min(b - a, most - count)
                held.append(batch.slice(a, take))
                name, count, a = now, count + take, a + take
    if held:
        yield done()


def _best(ids: np.ndarray, unit: np.ndarray, k: int, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sim): for each vector its ``k`` best others in the run, better than ``worst`` if given."""
    sim = unit @ unit.T
    sim[ids[:, None] == ids[None, :]] = -2
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    col = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(ids)), k)
    col = col.ravel()
    value = sim[row, col]
    ok = value > (-1.5 if worst is None else worst[row])
    return ids[row[ok]], ids[col[ok]], value[ok]


def _pairs(df: DataFrame, id_ddl: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for u, v, sim in work(batches):
            held.append((u, v, sim))
            size += len(u)
            if size >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["u", "v", "sim"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["u", "v", "sim"])

    return df.mapInArrow(run, PAIRS.format(id=id_ddl))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries of each list; Spark cuts each task's share before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return pairs.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _first_lists(nodes: DataFrame, orders: int, k: int) -> DataFrame:
    """Lists from runs of neighbours in sorted orders: each order sorts by the signs of projections."""
    id_ddl = nodes.schema["id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _by_length(batch.column(2)):
                rows = batch.take(pa.array(at))
                for order in range(orders):
                    planes = np.random.default_rng((order, unit.shape[1])).standard_normal((unit.shape[1], BITS))
                    key = ((unit @ planes > 0) << np.arange(BITS)[::-1]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), order, np.int32)), rows.column(1), pa.array(key.astype(np.int64)), rows.column(0), rows.column(2)], names=["order", "part", "key", "id", "unit"])

    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("id", "part", "unit").mapInArrow(keys, f"order int, part string, key long, id {id_ddl}, unit array<double>")
    rows = rows.repartitionByRange(parts, "order", "part", "key", "id").sortWithinPartitions("order", "part", "key", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, _, _, ids, unit in _groups(batches, 2, RUN):
            yield _best(ids, unit, k)

    return _top(_pairs(rows, id_ddl, work), k)


def _refined(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Better entries found among the neighbours and reverse neighbours of each vector."""
    id_ddl = nodes.schema["id"].dataType.simpleString()
    back = _top(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"), k)
    around = lists.select("u", "v").unionByName(back.select("u", "v")).distinct()
    worst = lists.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-1.5)).alias("worst"))
    members = nodes.select(F.col("id").alias("v"), "unit").join(worst.withColumnRenamed("u", "v"), "v", "left").select("v", F.coalesce("worst", F.lit(-1.5)).alias("worst"), "unit")
    rows = around.join(members, "v").select("u", "v", "worst", "unit").repartition("u").sortWithinPartitions("u", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, ids, worst, unit in _groups(batches, 1):
            yield _best(ids, unit, k, worst)

    return _pairs(rows, id_ddl, work)


def _counted(nodes: DataFrame, component: DataFrame, least: float) -> DataFrame:
    """(id, near): how many rows the other vectors of its component stand for that it links to.

    A component is compared block by block; each task holds two blocks, and only counts leave it.
    """
    id_ddl = nodes.schema["id"].dataType.simpleString()
    sizes = component.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = component.join(sizes, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    rows = rows.join(nodes.select("id", "copies", "unit"), "id").select("component", "i", "j", "own", "id", "copies", "unit").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, ids, copies, unit in _groups(batches, 3):
            linked = unit @ unit.T >= least
            linked[np.arange(len(ids)), np.arange(len(ids))] = False
            if i[0] != j[0]:
                linked &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((linked @ copies.astype(np.float64)).astype(np.int64))], names=["id", "near"])

    return rows.mapInArrow(run, f"id {id_ddl}, near long").groupBy("id").agg(F.sum("near").alias("near"))


def _settled(nodes: DataFrame, component: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components, as a forest per task, of the vectors ``full`` (id) with all of their part.

    Each block of such vectors is compared with each block of the part; tasks hold two blocks.
    """
    id_ddl = nodes.schema["id"].dataType.simpleString()
    placed = nodes.join(component, "id", "left").select("id", "part", F.coalesce("component", "id").alias("component"), "unit")
    some = placed.join(full, "id", "left_semi")
    blocks = lambda rows, name: rows.groupBy("part").agg(F.ceil(F.count("*") / WIDE).cast("int").alias(name))
    sizes = blocks(some, "rows").join(blocks(placed, "cols"), "part")
    own = lambda count: F.pmod(F.xxhash64("id", F.lit(7)), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = some.join(sizes, "part").withColumn("i", own("rows")).withColumn("j", each("cols")).withColumn("side", F.lit(0))
    right = placed.join(sizes, "part").withColumn("j", own("cols")).withColumn("i", each("rows")).withColumn("side", F.lit(1))
    cols = ["part", "i", "j", "side", "component", "unit"]
    rows = left.select(cols).unionByName(right.select(cols)).repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, side, comp, unit in _groups(batches, 3):
            kinds, code = np.unique(comp, return_inverse=True)
            here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            parent = list(range(len(kinds)))

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            a, b = [], []
            for at in range(0, len(here), 256):
                now = here[at : at + 256]
                hit = (unit[now] @ unit[there].T >= least) & (code[now][:, None] != code[there][None, :])
                r, c = np.nonzero(hit)
                for pair in np.unique(code[now][r] * len(kinds) + code[there][c]).tolist():
                    x, y = root(pair // len(kinds)), root(pair % len(kinds))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        a.append(pair // len(kinds))
                        b.append(pair % len(kinds))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(kinds[x]) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(run, f"a {id_ddl}, b {id_ddl}")


def audit(nodes: DataFrame, component: DataFrame, least: float) -> float:
    """Share of a vector's links that lie within its component, the mean over those of ``AUDITED`` vectors
    (drawn by a hash) that have links, so that vectors of many links count no more than others.

    Their vectors, a bounded number, are compared with all others by brute force.
    """
    placed = nodes.join(component, "id", "left").select("id", "part", F.coalesce("component", "id").alias("component"), "unit")
    drawn = placed.orderBy(F.xxhash64("id", F.lit(5))).limit(AUDITED).collect()
    if not drawn:
        return 1.0
    queries = {}
    for r in drawn:
        queries.setdefault(r.part, []).append((r.id, r.component, r.unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = {r.id: 0 for r in drawn}
        found = dict(true)
        for batch in batches:
            part = batch.column(1).to_numpy(zero_copy_only=False)
            ids, comp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for p, rows in queries.items():
                at = np.flatnonzero(part == p)
                if len(at):
                    linked = (_matrix(batch.column(3).take(pa.array(at))) @ np.array([r[2] for r in rows]).T >= least) & (ids[at][:, None] != np.array([r[0] for r in rows])[None, :])
                    within = linked & (comp[at][:, None] == np.array([r[1] for r in rows])[None, :])
                    for r, n, m in zip(rows, linked.sum(axis=0).tolist(), within.sum(axis=0).tolist()):
                        true[r[0]] += n
                        found[r[0]] += m
        yield pa.RecordBatch.from_arrays([pa.array(list(x.values()), pa.int64()) for x in (true, found)] + [pa.array(np.arange(len(true)))], names=["true", "found", "number"])

    sums = placed.mapInArrow(run, "true long, found long, number long").groupBy("number").agg(F.sum("true").alias("true"), F.sum("found").alias("found"))
    return sums.where(F.col("true") > 0).agg(F.coalesce(F.avg(F.col("found") / F.col("true")), F.lit(1.0))).first()[0]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """Links between vectors of one label with a cosine of ``least`` or more: (id, n_links, component_id, kept).

    1. Equal vectors of a label form a class, which the smallest id stands for.
    2. First lists: in each of 8 orders by random projections, runs of 256 rows are compared.
    3. NN-descent: the neighbours and reverse neighbours of each vector are compared with one
       another, which improves their lists, until a round changes hardly anything.
    4. Entries of at least ``least`` are links; their components are formed. A list that is full of
       links is too short: its vector is compared with all of its label, block by block, for links to
       other components (``_settled``). Then members of a component are compared block by block, and
       links are counted where they are found, not written out.
    5. An audit compares 256 vectors with all by brute force. Below a mean recall of 0.98 the lists are
       doubled, with more orders, and refined again; if the third time misses it, all vectors are
       compared with their label as in 4.

    ``n_links`` counts other rows, copies included. Null, empty and zero vectors, vectors with null
    or non-finite components, null labels and null ids link with nothing (a null id has a null
    component and is kept). Vectors of different lengths are not compared. Repeated rows each get
    their row and count as links of each other; other columns are not looked at; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark, "nn-descent")
    raw = F.col(vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), raw.alias("vector"))
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Dividing by the largest component first keeps squares of very large and small ones in range.
    top = F.array_max(F.transform("vector", F.abs))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite & (top > 0), F.lit(False))
    base = base.select("*", usable.alias("usable")).withColumn("vector", F.when(F.col("usable"), F.transform("vector", lambda x: x / top)))
    part = F.concat_ws(":", F.size("vector").cast("string"), "label")
    keyed = base.select("id", "usable", F.when(F.col("usable"), part).alias("part"), F.transform("vector", lambda x: x / size).alias("unit"))
    keyed = keyed.withColumns({"a": F.xxhash64("part", "unit"), "b": F.xxhash64(F.lit(3), "unit", "part")})
    keyed = shelf.put(keyed, "vectors")
    classes = keyed.where("usable").groupBy("part", "a", "b").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = shelf.put(classes, "nodes")

    k, orders = NEIGHBOURS, ORDERS
    for attempt in range(3):
        lists = shelf.put(_first_lists(nodes, orders, k), f"lists-{attempt}-0")
        for step in range(ROUNDS):
            better = _top(lists.unionByName(_refined(lists, nodes, k)), k)
            new = shelf.put(better, f"lists-{attempt}-{step + 1}")
            changed = new.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
            lists = new
            if changed <= SETTLED * new.count():
                break
        links = lists.where(F.col("sim") >= least).select(F.col("u").alias("a"), F.col("v").alias("b"))
        component = shelf.put(components(shelf, links), f"component-{attempt}")
        full = shelf.put(lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low")).where((F.col("n") >= k) & (F.col("low") >= least)).select(F.col("u").alias("id")), f"full-{attempt}")
        if not full.isEmpty():
            component = merged(shelf, component, shelf.put(_settled(nodes, component, full, least), f"settled-{attempt}"), f"component-{attempt}-settled")
        if audit(nodes, component, least) >= RECALL:
            break
        k, orders = 2 * k, orders + ORDERS
    else:
        component = merged(shelf, component, shelf.put(_settled(nodes, component, nodes.select("id"), least), "settled"), "component-settled")

    near = _counted(nodes, component, least)
    found = nodes.select("part", "a", "b", "copies", "id").join(component, "id", "left").join(near, "id", "left")
    found = shelf.put(found.select("part", "a", "b", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "found")
    out = keyed.select("id", "part", "a", "b").join(found, ["part", "a", "b"], "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
