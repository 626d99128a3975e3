"""Removal of long strings that start more than once, across all documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from dwellmatch.llm.common import Shelf, mix64, release_memory, slices
from dwellmatch.llm.suffix_groups import suffix_array
from dwellmatch.llm.url_filter import possible

#: Anchors are chosen by the hashes of GRAM bytes.
GRAM = 16
#: Starts of strings that are told apart together: the bytes in which they can differ are few.
STEP = 16
#: Bytes hashed at a time; a longer text is taken in overlapping pieces.
PIECE = 1 << 19
#: Symbols of one suffix array, and strings of one class beyond which its windows are counted by Spark.
BODY, CROWD = 1 << 16, 4096

#: Rows that a task gathers before it passes them on.
ROWS = 20_000

_WORD = (1 << 64) - 1


class RollingHash:
    """Hashes of substrings of a byte string, from prefix sums modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.powers = self.inverses = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            for name, factor in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                steps = np.full(len(data) + 1, factor & _WORD, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((sums[stop] - sums[start]) * self.inverses[start] + (stop - start).astype(np.uint64))


def window_of(length: int) -> int:
    """Among how many neighbouring places an anchor is chosen: the more, the fewer anchors there are,
    and the fewer bytes after an anchor all its strings share."""
    return length * 5 // 8


def anchors(data: np.ndarray, ends: np.ndarray, length: int, rolling: RollingHash, chosen: RollingHash) -> dict[str, np.ndarray]:
    """Anchors of the strings of ``length`` bytes that lie within one of the texts ending at ``ends``.

    The anchor of a string is the place of the least gram hash among its first places (``window_of``; of
    equal ones the last), so equal strings have their anchors at equal distances. One row per
    anchor: ``text`` its text's number, ``at`` its place, ``low`` and ``high`` the first and last
    start of the strings that have it, ``core`` the hash of the bytes all these strings have after
    the anchor, ``whole`` the hash of all bytes of all of them.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("text", "at", "low", "high", "core", "whole")}
    begins = np.concatenate([[0], ends[:-1]])
    n, window = len(data), window_of(length)
    starts = [np.arange(b, e - length + 1) for b, e in zip(begins, ends) if e - b >= length]
    if not starts:
        return empty
    gram_sums = chosen.sums(data)
    grams = mix64((gram_sums[GRAM:] - gram_sums[:-GRAM]) * chosen.inverses[: n - GRAM + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    last = np.uint64((1 << 24) - 1)
    key = grams & ~last | last - places
    blocks = -(-len(key) // window) + 1
    padded = np.full(blocks * window, np.uint64(_WORD))
    padded[: len(key)] = key
    padded = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.concatenate(starts)
    anchor = (last - (np.minimum(behind[p], ahead[p + window - 1]) & last)).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
    low, high, at = p[new], p[np.append(new[1:], len(p)) - 1], anchor[new]
    text = np.searchsorted(ends, at, side="right")
    sums = rolling.sums(data)
    core = rolling.of(sums, at, at + length - window + 1)
    shape = (at - low).astype(np.uint64) << np.uint64(32) | (at - high).astype(np.uint64)
    whole = mix64(rolling.of(sums, low, high + length) ^ mix64(shape + np.uint64(1)))
    origin = begins[text]
    return {"text": text, "at": at - origin, "low": low - origin, "high": high - origin, "core": core.astype(np.int64), "whole": whole.astype(np.int64)}


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(text numbers, their offsets, bytes, ends): texts laid end to end; pieces of a long text share the
    bytes of the strings that start in the one before and end in the next."""
    names, offsets, body, size = [], [], [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), PIECE - length):
            part = text[start : start + PIECE - 1]
            if len(part) < length:
                continue
            if body and size + len(part) > PIECE:
                yield names, offsets, np.frombuffer(b"".join(body), np.uint8), np.cumsum([len(b) for b in body])
                names, offsets, body, size = [], [], [], 0
            names.append(k)
            offsets.append(start)
            body.append(part)
            size += len(part)
    if body:
        yield names, offsets, np.frombuffer(b"".join(body), np.uint8), np.cumsum([len(b) for b in body])


def repeated_windows(strings: list[tuple[int, bytes, bytes, int]]) -> list[int]:
    """Masks of the windows that occur more than once.

    A string is (class, bytes before the core, bytes after it, how often it occurs); strings of a
    class have the same core, which is one symbol here. Windows are STEP symbols long and hold the
    core. Bit q is set if the window that starts q symbols into the string has several occurrences.
    """
    symbols: list[int] = []
    begins: list[int] = []
    for number, before, after, _ in strings:
        begins.append(len(symbols))
        symbols.extend(b + 1 for b in before)
        symbols.append(257 + number)
        symbols.extend(b + 1 for b in after)
        symbols.append(0)
    text = np.array(symbols, np.int64)
    order = suffix_array(text)
    starts = np.array(begins)
    owner = np.searchsorted(starts, order, side="right") - 1
    q = order - starts[owner]
    before = np.array([len(s[1]) for s in strings])
    whole = np.array([len(s[1]) + 1 + len(s[2]) for s in strings])
    keep = (q <= before[owner]) & (q + STEP <= whole[owner])
    order, owner, q = order[keep], owner[keep], q[keep]
    windows = np.lib.stride_tricks.sliding_window_view(text, STEP)[order] if len(order) else np.zeros((0, STEP))
    same = (windows[1:] == windows[:-1]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    times = np.bincount(run, np.array([s[3] for s in strings], float)[owner])
    hit = times[run] > 1
    masks = np.zeros(len(strings), np.int64)
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << q[hit])
    return masks.tolist()


def _windows(row: tuple) -> int:
    """Mask of all windows of a string: those that hold the core and end within the string."""
    before, whole = len(row[2]), len(row[2]) + 1 + len(row[3])
    return sum(1 << q for q in range(before + 1) if q + STEP <= whole)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(id, version, at, low, high, core, whole) for every anchor of every text."""
    schema = StructType([*docs.schema.fields[:2], *StructType.fromDDL("at int, low int, high int, core long, whole long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        rolling, chosen = RollingHash(1), RollingHash(2)
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for names, offsets, data, ends in _pieces(texts, length):
                got = anchors(data, ends, length, rolling, chosen)
                row = pa.array(np.array(names)[got["text"]])
                shift = np.array(offsets)[got["text"]]
                cols = [batch.column(0).take(row), batch.column(1).take(row)]
                cols += [pa.array((got[k] + shift).astype(np.int32)) for k in ("at", "low", "high")]
                cols += [pa.array(got[k]) for k in ("core", "whole")]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return docs.select("id", "version", "text").mapInArrow(run, schema)


def _step_rows(docs: DataFrame, length: int) -> DataFrame:
    """From (text, spots): for each spot, the strings with its anchor in groups of STEP starts.

    (core, whole, class_a, class_b, before, after, low, times): the bytes that all strings of the
    group have in common give the class (128 bits, with the group's distance from the anchor);
    ``before`` and ``after`` are what the group's strings have beside them.
    """
    schema = StructType.fromDDL("core long, whole long, class_a long, class_b long, before binary, after binary, low int, times long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in schema}
            for text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                for s in spots:
                    at = s["at"]
                    for j in range((at - s["high"]) // STEP, (at - s["low"]) // STEP + 1):
                        far, near = min(at - s["low"], STEP * j + STEP - 1), max(at - s["high"], STEP * j)
                        begin = at - STEP * j
                        common = data[begin : begin - STEP + 1 + length]
                        digest = hashlib.blake2b(common, digest_size=16, salt=j.to_bytes(4, "little")).digest()
                        cols["core"].append(s["core"])
                        cols["whole"].append(s["whole"])
                        cols["class_a"].append(int.from_bytes(digest[:8], "little", signed=True))
                        cols["class_b"].append(int.from_bytes(digest[8:], "little", signed=True))
                        cols["before"].append(data[at - far : begin])
                        cols["after"].append(data[begin - STEP + 1 + length : at - near + length])
                        cols["low"].append(at - far - s["low"])
                        cols["times"].append(s["times"])
                if len(cols["low"]) >= ROWS:
                    yield pa.RecordBatch.from_pydict(cols, schema=arrow)
                    cols = {f.name: [] for f in schema}
            yield pa.RecordBatch.from_pydict(cols, schema=arrow)

    return docs.select("text", "spots").mapInArrow(run, schema)


def _masks(strings: DataFrame) -> DataFrame:
    """``mask`` for rows (class_a, class_b, before, after, times); tasks hold BODY symbols at a time."""
    strings = strings.repartition("class_a", "class_b").sortWithinPartitions("class_a", "class_b")
    schema = StructType([*strings.select("class_a", "class_b", "before", "after").schema, StructField("mask", StructType.fromDDL("m int")[0].dataType)])
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple], masks: list[int]) -> pa.RecordBatch:
        cols = [*zip(*(r[:4] for r in rows)), masks] if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        number = {c: k for k, c in enumerate(dict.fromkeys(r[:2] for r in rows))}
        return batch_of(rows, repeated_windows([(number[r[:2]], r[2], r[3], r[4]) for r in rows]))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:2] != rows[-1][:2]:
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        body: list[tuple] = []
        single: list[tuple] = []
        size = 0
        for rows in classes(batches):
            if len(rows) == 1:
                # One kind of string: its windows differ in where the core stands, so it's down to copies.
                single += rows if rows[0][4] > 1 else []
            else:
                body += rows
                size += sum(len(r[2]) + len(r[3]) + 2 for r in rows)
            if size >= BODY:
                yield solve(body)
                body, size = [], 0
            if len(single) >= ROWS:
                yield batch_of(single, [_windows(r) for r in single])
                single = []
        if body:
            yield solve(body)
        yield batch_of(single, [_windows(r) for r in single])

    return strings.select("class_a", "class_b", "before", "after", "times").mapInArrow(run, schema)


def _crowded_masks(strings: DataFrame) -> DataFrame:
    """The same for classes of very many strings: every window is a row, and Spark counts them."""
    q = F.explode(F.sequence(F.lit(0), F.length("before"))).alias("q")
    rows = strings.select("*", q).where(F.length("before") - F.col("q") + 1 + F.length("after") >= STEP)
    left = F.expr("substring(before, q + 1, length(before) - q)")
    right = F.expr(f"substring(after, 1, {STEP - 1} - (length(before) - q))")
    rows = rows.withColumns({"left": left, "right": right})
    often = rows.groupBy("class_a", "class_b", "left", "right").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
    hits = rows.join(often, ["class_a", "class_b", "left", "right"], "left_semi")
    bit = F.call_function("shiftleft", F.lit(1), F.col("q"))
    return hits.groupBy("class_a", "class_b", "before", "after").agg(F.bit_or(bit).alias("mask"))


_WORDS = re.compile(rb"\S+")


def cut(text: str | None, marks: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]], int]:
    """What is left of a text, the spans taken out, and its bytes. A mark is (start, span, mask): strings
    start at each of ``span`` places from ``start``, or where ``mask`` has bits."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ranges = []
    for m in marks or ():
        if m["mask"] is None:
            ranges.append((m["start"], m["start"] + m["span"] - 1 + length))
        else:
            ranges += [(m["start"] + q, m["start"] + q + length) for q in range(STEP) if m["mask"] >> q & 1]
    spans: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), spans, len(data)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that starts at two or more places.

    (id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, carried]); ``kept_text`` leaves out
    characters that a cut has split, ``carried`` is a struct of the columns in ``carry``. Strings are judged on the input, within one document each.

    1. Each string has an anchor among its first places (250 for 400 bytes), chosen by content, so that equal
       strings have theirs at equal distances. Anchors (one in about 125 bytes) are counted by the
       bytes that all strings of an anchor share; those that occur once hold no repeated string.
    2. Where all occurrences of an anchor agree on all bytes of all its strings, these are all
       repeated. That settles the inner parts of copies, however many there are.
    3. The rest lies at the edges of repeated passages. One occurrence of each differing kind is
       looked up in its text, and its strings are told apart in groups of 16 neighbouring starts:
       a suffix array (``suffix_groups``) over the few bytes in which the strings of a class can
       differ, with what they share as one symbol, finds equal windows, that is equal strings.
       Classes of more than ``CROWD`` differing kinds are not gathered; their windows are counted.

    Anchors and classes are keyed by hashes of 64 + 64 and 128 bits; copies are combined before the
    shuffles. Null and empty texts lose nothing. Rows with equal ids and texts are copies like any
    others (each gets its row); null ids are kept apart by their texts. Other columns are not looked
    at; an empty table gives no rows.
    """
    if length < 4 * GRAM:
        raise ValueError(f"length must be at least {4 * GRAM}")
    spark = docs.sparkSession
    shelf = Shelf(spark, "suffix-dedup")
    source = docs.select(*source_columns(id_col, text_col))
    whole = source if carry is None else docs.select(*source_columns(id_col, text_col), F.struct(*carry).alias("carried"))
    found = shelf.put(_anchor_rows(source, length), "anchors")
    kinds = found.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    kinds = shelf.put(kinds.where("n > 1").select("core", (F.col("least") == F.col("most")).alias("agreed")), "kinds")
    shared = shelf.put(found.join(kinds, "core"), "shared")
    shelf.drop("anchors")

    differing = shared.where("not agreed")
    spots = differing.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(F.struct("id", "version", "at", "low", "high")).alias("one"))
    spots = spots.groupBy("one.id", "one.version").agg(F.collect_list(F.struct("one.at", "one.low", "one.high", "core", "whole", "times")).alias("spots"))
    spots = shelf.put(spots, "spots")
    wanted = _only_possible(source, spots)
    looked = wanted.alias("d").join(spots.alias("s"), _same_text(), "inner").select("d.text", "s.spots")
    steps = shelf.put(_step_rows(looked, length), "steps")
    strings = shelf.put(steps.groupBy("class_a", "class_b", "before", "after").agg(F.sum("times").alias("times")), "strings")
    crowded = shelf.put(strings.groupBy("class_a", "class_b").count().where(F.col("count") > CROWD).select("class_a", "class_b"), "crowded")
    masks = _masks(strings.join(crowded, ["class_a", "class_b"], "left_anti"))
    masks = masks.unionByName(_crowded_masks(strings.join(crowded, ["class_a", "class_b"], "left_semi")))
    masks = shelf.put(masks.where("mask <> 0"), "masks")
    told = steps.join(masks, ["class_a", "class_b", "before", "after"]).select("core", "whole", F.col("low").alias("shift"), "mask").distinct()
    told = shelf.put(told, "told")

    null = F.lit(None).cast("int")
    marks = shared.where("agreed").select("id", "version", F.col("low").alias("start"), (F.col("high") - F.col("low") + 1).alias("span"), null.alias("mask"))
    edges = differing.join(told, ["core", "whole"]).select("id", "version", (F.col("low") + F.col("shift")).alias("start"), null.alias("span"), "mask")
    marks = marks.unionByName(edges).groupBy("id", "version").agg(F.collect_set(F.struct("start", "span", "mask")).alias("marks"))
    marks = shelf.put(marks, "marks")

    more = [] if carry is None else ["carried"]
    judged = _possible(whole, marks)
    hit = judged.where("possible").alias("d").join(marks.alias("s"), _same_text(), "left").select("d.id", "d.text", "s.marks", *(f"d.{c}" for c in more))
    rest = judged.where("not possible").select("id", "text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"), *more)
    return _cut_rows(rest.unionByName(hit), id_col, length, with_text)


#: Words of a piece whose passages are taken together (a power of two), and passages of an anchor at most,
#: which are bits of a mask.
WORDS, MASK = 1 << 16, 62


def word_anchors(data: bytes, begins: np.ndarray, words: int, rolling: RollingHash, chosen: RollingHash) -> dict[str, np.ndarray]:
    """Anchors of the passages of ``words`` words within the texts that start at ``begins`` and end with white space.

    As in ``anchors``, with words in place of bytes: a passage's anchor is the word among its first
    ones (``window_of``) with the least hash of ``GRAM // 4`` words, so equal passages have theirs at equal
    distances. One row per anchor and piece: ``text``, ``start`` and ``stop`` in it of all its passages,
    ``core`` the hash of what all of them have in common, ``whole`` that of all they have.
    """
    text = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], (text == 32) | ((text >= 9) & (text <= 13)), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edges[::2], edges[1::2]
    owner = np.searchsorted(begins, first, side="right") - 1
    window, gram = min(window_of(words), MASK), GRAM // 4
    parts: dict[str, list] = {k: [] for k in ("text", "start", "stop", "core", "whole")}
    for at in range(0, max(0, len(first) - words + 1), WORDS - words + 1):
        starts, stops, texts = (x[at : at + WORDS] for x in (first, last, owner))
        n = len(starts)
        p = np.flatnonzero(texts[: n - words + 1] == texts[words - 1 :])
        if not len(p):
            continue
        piece = text[starts[0] : stops[-1]]
        starts, stops, origin = starts - starts[0], stops - starts[0], starts[0] - begins
        places = np.arange(n)
        grams = chosen.of(chosen.sums(piece), starts, stops[np.minimum(places + gram - 1, n - 1)])
        low_bits = np.uint64(WORDS - 1)
        key = grams & ~low_bits | low_bits - places.astype(np.uint64)
        padded = np.full((-(-n // window) + 1) * window, np.uint64(_WORD))
        padded[:n] = key
        padded = padded.reshape(-1, window)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (low_bits - (np.minimum(behind[p], ahead[p + window - 1]) & low_bits)).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
        low, high, place = p[new], p[np.append(new[1:], len(p)) - 1], anchor[new]
        sums = rolling.sums(piece)
        shape = (place - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)
        begin, end = starts[low], stops[high + words - 1]
        whole = mix64(rolling.of(sums, begin, end) ^ mix64(shape + np.uint64(1)))
        core = rolling.of(sums, starts[place], stops[place + words - window])
        shift = origin[texts[low]]
        for k, values in zip(parts, (texts[low], begin + shift, end + shift, core.astype(np.int64), whole.astype(np.int64))):
            parts[k].append(values)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def _passage_rows(docs: DataFrame, words: int) -> DataFrame:
    """(id, version, start, stop, core, whole) for every anchor of every text's passages."""
    schema = StructType([*docs.schema.fields[:2], *StructType.fromDDL("start int, stop int, core long, whole long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        rolling, chosen = RollingHash(1), RollingHash(2)
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                first, size = at, 0
                while at < len(texts) and (at == first or size + len(texts[at]) <= PIECE):
                    size += len(texts[at]) + 1
                    at += 1
                begins = np.cumsum([0, *(len(t) + 1 for t in texts[first : at - 1])])
                got = word_anchors(b"\n".join(texts[first:at]), begins, words, rolling, chosen)
                row = pa.array(got["text"] + first)
                cols = [batch.column(0).take(row), batch.column(1).take(row), *(pa.array(got[k]) for k in ("start", "stop", "core", "whole"))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return docs.select("id", "version", "text").mapInArrow(run, schema)


def _word_spans(data: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in _WORDS.finditer(data)]


def remove_passages(docs: DataFrame, words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each passage of ``words`` words that stands at two or more places, so longer ones as a whole:
    (n_removed, kept_text, carried).

    Passages are equal byte by byte; words stand between ASCII white space. Like ``remove_repeats``, with
    anchors at words (one in about 16): where all occurrences of an anchor agree on all its passages,
    these are all repeated; those of an anchor that occurs once are not. What is left are the edges of
    repeated passages: one occurrence of each differing kind is looked up in its text, and its
    passages are counted by 128-bit hashes. Rows with equal ids and texts are copies like any others;
    null and empty texts lose nothing.
    """
    if words < GRAM // 2:
        raise ValueError(f"words must be at least {GRAM // 2}")
    shelf = Shelf(docs.sparkSession, "passages")
    source = docs.select(*source_columns(id_col, text_col))
    whole = docs.select(*source_columns(id_col, text_col), F.struct(*docs.columns).alias("carried"))
    found = shelf.put(_passage_rows(source, words), "anchors")
    kinds = found.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    kinds = shelf.put(kinds.where("n > 1").select("core", (F.col("least") == F.col("most")).alias("agreed")), "kinds")
    shared = shelf.put(possible(found, F.col("core"), kinds.select("core")).where("possible").drop("possible").join(kinds, "core"), "shared")
    shelf.drop("anchors")

    differing = shared.where("not agreed")
    spots = differing.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(F.struct("id", "version", "start", "stop")).alias("one"))
    spots = spots.groupBy("one.id", "one.version").agg(F.collect_list(F.struct("one.start", "one.stop", "core", "whole", "times")).alias("spots"))
    spots = shelf.put(spots, "spots")
    looked = _only_possible(source, spots).alias("d").join(spots.alias("s"), _same_text(), "inner").select("d.text", "s.spots")
    places = StructType.fromDDL("core long, whole long, nth int, times long, code binary")
    arrow = to_arrow_schema(places)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in slices(batches):
            out: list[tuple] = []
            for text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for s in spots:
                    part = data[s["start"] : s["stop"]]
                    at = _word_spans(part)
                    out += [(s["core"], s["whole"], w, s["times"], xxhash.xxh3_128_digest(part[at[w][0] : at[w + words - 1][1]])) for w in range(len(at) - words + 1)]
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    seen = shelf.put(looked.mapInArrow(windows, places), "windows")
    repeated = shelf.put(seen.groupBy("code").agg(F.sum("times").alias("n")).where("n > 1").select("code"), "repeated")
    told = seen.join(repeated, "code").groupBy("core", "whole").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("nth"))).alias("mask"))
    told = shelf.put(told, "told")

    marks = shared.where("agreed").select("id", "version", "start", "stop", F.lit(None).cast("long").alias("mask"))
    edges = differing.join(told, ["core", "whole"]).select("id", "version", "start", "stop", "mask")
    marks = marks.unionByName(edges).groupBy("id", "version").agg(F.collect_set(F.struct("start", "stop", "mask")).alias("marks"))
    marks = shelf.put(marks, "marks")

    judged = _possible(whole, marks)
    clear = judged.where("not possible").select(F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text"), "carried")
    hit = judged.where("possible").alias("d").join(marks.alias("s"), _same_text(), "left").select("d.text", "s.marks", "d.carried")
    schema = StructType([*clear.schema.fields[:2], hit.schema["carried"]])
    result = to_arrow_schema(schema)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in slices(batches):
            removed, kept = [], []
            for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not marks:
                    removed.append(0)
                    kept.append(text)
                    continue
                data = text.encode("utf-8", "surrogatepass")
                ranges = []
                for m in marks:
                    if m["mask"] is None:
                        ranges.append((m["start"], m["stop"]))
                    else:
                        at = _word_spans(data[m["start"] : m["stop"]])
                        ranges += [(m["start"] + at[w][0], m["start"] + at[w + words - 1][1]) for w in range(len(at) - words + 1) if m["mask"] >> w & 1]
                parts, at = [], 0
                for a, b in sorted(ranges):
                    parts.append(data[at : max(at, a)])
                    at = max(at, b)
                rest = b"".join([*parts, data[at:]])
                removed.append(len(data) - len(rest))
                kept.append(rest.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, result.field(1).type), batch.column(2).cast(result.field(2).type)], schema=result)

    return clear.unionByName(hit.mapInArrow(without, schema))


def source_columns(id_col: str, text_col: str) -> list[Column]:
    """``version`` tells texts apart that share an id."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text")]


def _same_text() -> Column:
    return F.col("d.version").eqNullSafe(F.col("s.version")) & F.col("d.id").eqNullSafe(F.col("s.id"))


def _possible(source: DataFrame, texts: DataFrame) -> DataFrame:
    """Marks the documents that may be among ``texts``, so that the others need no shuffle."""
    key = F.xxhash64("id", "version")
    return possible(source, key, texts.select(key.alias("key")))


def _only_possible(source: DataFrame, texts: DataFrame) -> DataFrame:
    return _possible(source, texts).where("possible").drop("possible")


def _cut_rows(docs: DataFrame, id_col: str, length: int, with_text: bool) -> DataFrame:
    fields = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    schema = StructType([StructField(id_col, docs.schema["id"].dataType), *fields, *docs.schema.fields[3:]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in slices(batches):
            cols: list[list] = [[] for _ in fields]
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, spans, n = cut(text, marks, length)
                values = [n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                if with_text:
                    values.append(kept.decode("utf-8", "ignore"))
                for col, value in zip(cols, values):
                    col.append(value)
            made = [pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:])]
            carried = [batch.column(k).cast(f.type) for k, f in enumerate(list(arrow)[1 + len(made) :], 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *made, *carried], schema=arrow)

    return docs.mapInArrow(run, schema)
