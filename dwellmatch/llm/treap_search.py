"""Ranked lexical search over K2-treaps: quadtrees of the term-document grid with impact maxima."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappush, heappushpop, nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from dwellmatch.llm.common import Shelf, slices
from dwellmatch.llm.word_hash import NOT_ALPHANUMERIC, WordHashes, pack, unpack

#: A block of documents, one treap, is closed at either size.
BLOCK_DOCS, BLOCK_WORDS = 16384, 1 << 20
#: Terms of the items that one pass over the index searches for: 16 MB of terms and weights.
PASS_TERMS = 1 << 20
#: Document ranges of one level that are opened together.
RANGES = 64

_BIT_COUNT = np.array([bin(k).count("1") for k in range(16)], np.uint8)
_BITS_BELOW = np.array([[bin(k & ((1 << q) - 1)).count("1") for q in range(4)] for k in range(16)], np.int64)

INDEX = "ids array<long>, terms array<long>, dfs array<int>, height int, top long, children array<binary>, drops array<binary>"


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Treap:
    """Cells of a square grid by level; a cell that holds no point has none below it.

    ``children``: four bits a cell, the quadrants that hold points; a cell's children stand together
    on the next level, in order, so that counting bits leads to them. ``maxima``: the greatest value
    in each cell, kept as what it lacks of its parent's. Each level ends with an empty cell of value
    0, at index -1, for what isn't there.
    """

    def __init__(self, height: int, top: int, children: list[bytes], drops: list[bytes]):
        self.height = height
        self.maxima, self.children, self.first = [np.array([top, 0], np.int64)], [], []
        for bits, drop in zip(children, drops):
            bits = unpack(bits).astype(np.uint8)
            count = _BIT_COUNT[bits]
            self.children.append(np.append(bits, 0))
            self.first.append(np.append(np.cumsum(count, dtype=np.int64) - count, 0))
            self.maxima.append(np.append(np.repeat(self.maxima[-1][:-1], count) - unpack(drop).astype(np.int64), 0))

    @staticmethod
    def build(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[int, int, list[bytes], list[bytes]]:
        """(height, greatest value, children and drops by level from the top) of distinct points."""
        height = max(int(rows.max()).bit_length(), int(cols.max()).bit_length(), 1)
        code = _spread(rows) << np.uint64(1) | _spread(cols)
        order = np.argsort(code)
        code, best = code[order], values[order].astype(np.int64)
        children, drops = [], []
        for _ in range(height):
            starts = np.flatnonzero(np.diff(code >> np.uint64(2), prepend=~np.uint64(0)))
            bits = np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), starts)
            above = np.maximum.reduceat(best, starts)
            drops.append(pack(np.repeat(above, np.diff(np.append(starts, len(code)))) - best))
            children.append(pack(bits))
            code, best = code[starts] >> np.uint64(2), above
        return height, int(best[0]), children[::-1], drops[::-1]

    def best_columns(self, rows: np.ndarray, weights: np.ndarray, least, offer) -> None:
        """Offers (columns, sums of weight * value over ``rows``), the best ranges of columns first.

        All rows go down together: a range is known by the cell of each row that covers it, and
        bounded by the weighted maxima of those cells. Ranges bounded below ``least()`` are left out.
        """
        half = np.stack([2 * (rows >> np.int64(k)) % 4 for k in range(self.height - 1, -1, -1)]).astype(np.uint8)
        sides = np.array([0, 1], np.uint8)[:, None, None]
        waiting: list[tuple | None] = [None] * self.height
        tops = [-1] * self.height
        tops[0] = int(self.maxima[0][0]) * int(weights.sum())
        waiting[0] = np.array([tops[0]]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)
        while (top := max(tops)) >= (low := least()):
            level = tops.index(top)
            bounds, starts, cells = waiting[level]
            waiting[level], tops[level] = None, -1
            if len(bounds) > RANGES:
                order = np.argpartition(-bounds, RANGES)
                rest = order[RANGES:]
                rest = rest[bounds[rest] >= low]
                if len(rest):
                    waiting[level], tops[level] = (bounds[rest], starts[rest], cells[rest]), int(bounds[rest].max())
                starts, cells = starts[order[:RANGES]], cells[order[:RANGES]]
            bits, first = self.children[level][cells], self.first[level][cells]
            quadrant = half[level] + sides
            below = np.where((bits >> quadrant) & 1, first + _BITS_BELOW[bits, quadrant], -1)
            bounds = (self.maxima[level + 1][below] @ weights).ravel()
            kept = np.flatnonzero(bounds >= max(low, 1))
            if not len(kept):
                continue
            bounds, columns = bounds[kept], (2 * starts + np.array([[0], [1]])).ravel()[kept]
            if level + 1 == self.height:
                offer(columns, bounds)
                continue
            more = bounds, columns, below.reshape(-1, len(rows))[kept]
            if waiting[level + 1] is not None:
                more = tuple(np.concatenate(pair) for pair in zip(waiting[level + 1], more))
            waiting[level + 1], tops[level + 1] = more, int(more[0].max())


def _text_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def corpus_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """(documents with at least one term, all their terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(NOT_ALPHANUMERIC)
        for batch in slices(batches):
            counts = hashes.of(batch.column(1).to_pylist())[1]
            yield pa.RecordBatch.from_pydict({"docs": [int((counts > 0).sum())], "terms": [int(counts.sum())]})

    row = _text_columns(docs, id_col, text_col).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: ids, terms (64-bit hashes) with document counts, and the treap
    of (term, document) with the impact (10^9 tf) div (1000 tf + 8 m).

    ``size`` is that of ``corpus_size``. Rows of a treap are the block's terms, those in most documents
    first, so that the rows of rare terms share cells with rare terms and end early. Blocks follow the
    input's partitions; nothing is shuffled.
    """
    n_docs, n_terms = size
    arrow = to_arrow_schema(StructType.fromDDL(INDEX))

    def block(ids: list, words: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        words, counts = np.concatenate(words), np.concatenate(counts)
        order = np.argsort(words)
        ordered = words[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        terms = ordered[new]
        term = np.empty(len(words), np.int64)
        term[order] = np.cumsum(new) - 1
        pairs = np.sort(term * len(ids) + np.repeat(np.arange(len(ids)), counts))
        starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        tf, (term, doc) = np.diff(np.append(starts, len(pairs))), np.divmod(pairs[starts], len(ids))
        m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in counts], np.int64)
        dfs = np.bincount(term, minlength=len(terms))
        height, top, children, drops = Treap.build(_rows_of(dfs)[term], doc, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        row = {"ids": ids, "terms": terms.view(np.int64), "dfs": dfs.astype(np.int32), "height": height, "top": top, "children": children, "drops": drops}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, words, counts, size = WordHashes(NOT_ALPHANUMERIC), [], [], [], 0
        for batch in slices(batches):
            found, count = hashes.of(batch.column(1).to_pylist())
            held = count > 0
            if not held.any():
                continue
            ids += batch.column(0).filter(pa.array(held)).to_pylist()
            words.append(found)
            counts.append(count[held])
            size += len(found)
            if len(ids) >= BLOCK_DOCS or size >= BLOCK_WORDS:
                yield block(ids, words, counts)
                ids, words, counts, size = [], [], [], 0
        if ids:
            yield block(ids, words, counts)

    return _text_columns(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(run, INDEX)


def _rows_of(dfs: np.ndarray) -> np.ndarray:
    """Row of each term: terms in most documents first."""
    rows = np.empty(len(dfs), np.int64)
    rows[np.argsort(-dfs, kind="stable")] = np.arange(len(dfs))
    return rows


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    want = StructType([StructField("item", items.schema[id_col].dataType), StructField("term", LongType())])
    arrow = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(NOT_ALPHANUMERIC)
        for batch in slices(batches):
            found, counts = hashes.of(batch.column(1).to_pylist())
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), pa.array(found.view(np.int64))], schema=arrow)

    return _text_columns(items, id_col, text_col).mapInArrow(run, want).distinct()


def _passes(rows: Iterator, n_docs: int) -> Iterator[list[tuple]]:
    """Items (id, terms, weights) in lists of at most ``PASS_TERMS`` terms, or of one longer item."""
    found, size = [], 0
    for row in rows:
        if found and size + len(row.terms) > PASS_TERMS:
            yield found
            found, size = [], 0
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * t.df + 1))) for t in row.terms]
        found.append((row.item, np.array([t.term for t in row.terms], np.int64).view(np.uint64), np.array(weights, np.int64)))
        size += len(weights)
    if found:
        yield found


def _search_pass(index: DataFrame, items: list[tuple], k: int, item_field: StructField) -> DataFrame:
    """The best ``k`` documents of each item within each task: (item, doc, score)."""
    shared = index.sparkSession.sparkContext.broadcast(items)
    want = StructType([item_field, StructField("doc", LongType()), StructField("score", LongType())])
    arrow = to_arrow_schema(want)
    last = (1 << 63) - 1  # a document without an id comes after all others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best: list[list] = [[] for _ in items]
        for batch in batches:
            for at in range(batch.num_rows):
                ids, terms, dfs, *treap = (column[at] for column in batch.columns)
                treap = Treap(*(part.as_py() for part in treap))
                terms, rows = terms.values.to_numpy().view(np.uint64), _rows_of(dfs.values.to_numpy())
                ids = [last if i is None else i for i in ids.as_py()]
                for (_, wanted, weights), heap in zip(items, best):
                    place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    here = (terms[place] == wanted) & (weights > 0)
                    if not here.any():
                        continue

                    def offer(columns: np.ndarray, scores: np.ndarray) -> None:
                        for c, s in zip(columns.tolist(), scores.tolist()):
                            (heappush if len(heap) < k else heappushpop)(heap, (s, -ids[c]))

                    treap.best_columns(rows[place[here]], weights[here], lambda: heap[0][0] if len(heap) == k else 1, offer)
        found = [(item[0], None if -d == last else -d, s) for item, heap in zip(items, best) for s, d in nlargest(k, heap)]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t.type) for c, t in enumerate(arrow)], schema=arrow)

    return index.mapInArrow(run, want)


def search(index: DataFrame, size: tuple[int, int], items: DataFrame, k: int = 10, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, scores above 0.

    ``index`` is a stored table of ``build_index``. A term's weight comes from the documents it is in,
    counted over all blocks; rows of one item id are one item with the terms of all. Each task goes
    through its blocks with the best documents so far, and sends at most ``k`` an item. One pass takes
    up to ``PASS_TERMS`` terms of items, broadcast. Items without a known term, and terms of weight 0,
    find nothing. Equal scores go by ascending doc_id, a null id last; repeated rows of the documents
    are documents of their own.
    """
    shelf = Shelf(index.sparkSession, "treap-items")
    terms = shelf.put(_item_terms(items, item_id, text_col), "terms")
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    counts = counts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    listed = terms.join(counts, "term").groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    listed = shelf.put(listed, "items")
    field = StructField("item", items.schema[item_id].dataType)
    cols = ["ids", "terms", "dfs", "height", "top", "children", "drops"]
    found = index.sparkSession.createDataFrame([], StructType([field, StructField("doc", LongType()), StructField("score", LongType())]))
    for n, block in enumerate(_passes(listed.toLocalIterator(), size[0])):
        found = found.unionByName(shelf.put(_search_pass(index.select(*cols), block, k, field), f"found-{n}"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("doc").alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id") -> DataFrame:
    """Index all whole texts, then search for all items. Null and empty texts hold no term and are no
    documents; an empty table of either kind gives no rows; other columns are not looked at."""
    spark: SparkSession = docs.sparkSession
    size = corpus_size(docs, id_col, text_col)
    index = Shelf(spark, "treap").put(build_index(docs, size, id_col, text_col), "index")
    return search(index, size, items, k, item_id, text_col)
