"""Structure of conversations: faults, and the cheapest repair by weighted interval parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from dwellmatch.llm.common import Shelf

#: Costs of the edits; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Letters of a run that are parsed at a time.
SPAN = 1 << 12

# The repair grammar. A nonterminal says what a span's rows become: nothing (""), roles that alternate,
# by their first and last one ("uu", "ua", "au", "aa"), or a system row alone or with such roles after it
# ("s", "su", "sa"). All rules have two nonterminals on the right, and whatever a nonterminal stands for
# can be cut at any place into two others; so one split of a span finds its cheapest repair.
NONTERMINALS = ["", "uu", "ua", "au", "aa", "s", "su", "sa"]
OTHER = {"u": "a", "a": "u"}


def _product(left: str, right: str) -> str | None:
    if not left or not right:
        return left or right
    if right[0] == (OTHER[left[-1]] if left != "s" else "u"):
        return left[0] + right[-1]
    return None


_PAIRS = [(_product(a, b), k, y) for k, a in enumerate(NONTERMINALS) for y, b in enumerate(NONTERMINALS)]
RULES = [(NONTERMINALS.index(x), k, y) for x, k, y in _PAIRS if x is not None]
WHOLE = [NONTERMINALS.index(x) for x in ("", "ua", "sa")]

Cell = tuple  # per nonterminal: None, or the least (cost, edits)


def _join(left: Cell, right: Cell) -> Cell:
    """Cell of a span from those of its two parts.

    Costs add and edits follow each other. Of two repairs of one span with the same cost neither
    spells the start of the other (it would have fewer inserts), so the least stays the least whatever
    follows.
    """
    best: list = [None] * len(NONTERMINALS)
    for x, k, y in RULES:
        a, b = left[k], right[y]
        if a is not None and b is not None:
            cost = a[0] + b[0]
            old = best[x]
            if old is None or cost < old[0] or cost == old[0] and a[1] + b[1] < old[1]:
                best[x] = cost, a[1] + b[1]
    return tuple(best)


@cache
def _inserted() -> Cell:
    """What inserts alone make of no row: closed under joining with itself."""
    cell: Cell = tuple((0, "") if not x else (INSERT, "I") if x in ("uu", "aa") else None for x in NONTERMINALS)
    while (more := _join(cell, cell)) != cell:
        cell = more
    return cell


@cache
def _leaf(letter: str) -> Cell:
    """Cell of one row, closed under inserts before and after it."""
    role, fault = letter[0].lower(), "must go" if letter == "-" else "cut" if letter.isupper() else None
    stays = TRUNCATED if fault == "cut" else 0
    cell: list = [None] * len(NONTERMINALS)
    cell[0] = DELETE, "D"
    if fault != "must go":
        for r in ("u", "a"):
            cell[NONTERMINALS.index(r + r)] = (stays, "K") if role == r else (stays + REROLE, "R")
        if role == "s":
            cell[NONTERMINALS.index("s")] = stays, "K"
    return _join(_join(_inserted(), tuple(cell)), _inserted())


def letter_of(role: str, must_go: bool, truncated: bool) -> str:
    """A row as the parser sees it: its role's initial, upper-case if truncated; "-" if it must go."""
    if must_go:
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if truncated else initial


def parse(letters: str) -> Cell:
    """Cell of a span of rows, from spans of one row, then two, four and so on."""
    if not letters:
        return _inserted()
    return _short(letters) if len(letters) <= 16 else _bottom_up([_leaf(c) for c in letters])


@lru_cache(1 << 16)
def _short(letters: str) -> Cell:
    return _bottom_up([_leaf(c) for c in letters])


def _bottom_up(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        cells = [_join(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[k] for k in WHOLE if cell[k] is not None)


# ---- frames


def damage(conversations: DataFrame) -> DataFrame:
    """The damaged rows (conv_id, turn, role, text): a hash of id and turn decides what happens to a row.

    Null roles and texts become one space; a null id or turn stays, and counts as one space in the hash.
    """
    told = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(told.cast("binary")) % 20).alias("_h"))
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("_h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


BLANKS = r"\x20\x09-\x0D"
RUN = "part int, seq long, letters long, gaps_low long, gaps_high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, edits array<string>"


def _place() -> list[Column]:
    """Order of a conversation's rows: turn (nulls first), then role and a digest of the text."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _counted_rows(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one row with their number ``n``."""
    kept = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return kept.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.md5("text"))


def _with_faults(texts: DataFrame) -> DataFrame:
    """Rows without their texts, with the faults of the text and whether role and text come for the first time."""
    narrow = texts.select("conv_id", "turn", "role", "digest", "n", (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")).alias("cut"))
    at = F.struct(F.col("turn").isNotNull().alias("t"), F.col("turn").alias("turn"))
    first = narrow.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(at).alias("_first"))
    found = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    return found.select("conv_id", "turn", "role", "digest", "n", "blank", "cut", (F.col("_first.turn").eqNullSafe(F.col("turn"))).alias("fresh"))


def _fields(conv_type: DataType, ddl: str) -> StructType:
    return StructType([StructField("conv_id", conv_type), *StructType.fromDDL(ddl)])


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)


class _Run:
    """What a stretch of a conversation's rows, in order, comes to."""

    def __init__(self, conv_id):
        self.conv_id, self.cells, self.pending, self.letters = conv_id, [], "", 0
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, n: int, blank: bool, cut: bool, fresh: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.low, self.high, self.last_turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - bool(fresh)
        self.truncated += bool(fresh and cut and not blank)
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        # Equal neighbours follow each other illegally, whatever their role.
        self.illegal += n - 1
        self.last = initial
        self.pending += letter_of(role, blank or not fresh, cut) + "-" * (n - 1)
        self.letters += n
        if len(self.pending) >= SPAN:
            self._close()

    def _close(self) -> None:
        self.cells.append(parse(self.pending))
        self.pending = ""

    def row(self, part: int, seq: int) -> dict:
        if self.pending:
            self._close()
        cell = _bottom_up(self.cells)
        made = {"conv_id": self.conv_id, "part": part, "seq": seq, "letters": self.letters, "gaps_low": self.low, "gaps_high": self.high, "turns": self.turns, "first": self.first, "last": self.last}
        made |= {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal")}
        return made | {"costs": [-1 if c is None else c[0] for c in cell], "edits": [None if c is None else c[1] for c in cell]}


def _runs(rows: DataFrame) -> DataFrame:
    """Ordered rows, range-partitioned, as one row per conversation and partition. A long conversation lies
    in several partitions; each parses its stretch."""
    want = _fields(rows.schema["conv_id"].dataType, RUN)
    arrow = to_arrow_schema(want)
    order = [F.col("conv_id").asc_nulls_first(), *_place()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, done, seq = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None or run.conv_id != conv_id:
                    if run is not None:
                        done.append(run.row(part, seq))
                        seq += 1
                    run = _Run(conv_id)
                run.add(*row)
                if len(done) >= 500:
                    yield _batch(done, arrow)
                    done = []
        if run is not None:
            done.append(run.row(part, seq))
        yield _batch(done, arrow)

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "turn", "role", "n", "blank", "cut", "fresh").mapInArrow(work, want)


REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(runs: DataFrame) -> DataFrame:
    """One row per conversation from its runs, at most one a partition."""
    want = _fields(runs.schema["conv_id"].dataType, REPAIR)
    arrow = to_arrow_schema(want)
    listed = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in runs.columns if c != "conv_id"]))).alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                conv_id, runs = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                cell = _bottom_up([tuple(None if c < 0 else (c, e) for c, e in zip(r["costs"], r["edits"])) for r in runs])
                cost, audit = cheapest(cell)
                row = {"conv_id": conv_id, "cost": cost, "audit": audit} | {k: sum(r[k] for r in runs) for k in ("blank", "duplicate", "truncated", "illegal")}
                row["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(runs, runs[1:]))
                dated = [r for r in runs if r["turns"]]
                turns = sum(r["turns"] for r in dated) - sum(a["gaps_high"] == b["gaps_low"] for a, b in zip(dated, dated[1:]))
                row["gaps"] = dated[-1]["gaps_high"] - dated[0]["gaps_low"] + 1 - turns if dated else 0
                rows.append(row)
                if len(rows) >= 500:
                    yield _batch(rows, arrow)
                    rows = []
            yield _batch(rows, arrow)

    return listed.mapInArrow(work, want)


class Repair:
    """Repairs of all conversations of ``rows`` (conv_id, turn, role, text).

    ``report``: per conversation the faults, cost and edits of the cheapest repair. ``turns()``:
    the repaired rows; ``digests()``: per conversation the SHA-256 of ``role:text`` lines.

    Rows are taken by turn, nulls first, rows of a turn by role and digest of the text; null roles and
    texts count as one space, a null conv_id is an id of its own; equal rows of a turn are counted
    before they are shuffled. Faults are found by aggregates over (conversation, role, text); parsing runs on
    ranges of the ordered rows, so that a conversation of any length is parsed by many tasks, and joins
    the cells of their stretches; what comes together in one task is a letter per row, as in the
    result. ``turns`` and ``digests`` stream each conversation through one task, since a digest is
    made from first to last, and hold a batch at a time. An empty table gives no rows; other columns
    are not looked at.
    """

    def __init__(self, rows: DataFrame):
        self.shelf = Shelf(rows.sparkSession, "turn-repair")
        self.texts = self.shelf.put(_counted_rows(rows), "texts")
        faults = self.shelf.put(_with_faults(self.texts), "faults")
        self.report = self.shelf.put(_joined(_runs(faults)), "report")

    def _replayed(self, schema: str, start: Callable, line: Callable, end: Callable) -> DataFrame:
        want = _fields(self.texts.schema["conv_id"].dataType, schema)
        arrow = to_arrow_schema(want)
        none = F.lit(None)
        audits = self.report.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"), none.cast("string").alias("digest"))
        rows = audits.unionByName(self.texts.withColumn("kind", F.lit(1)))
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_place())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_, audit, at, last, out = None, "", 0, None, []

            def inserts() -> None:
                nonlocal at, last
                while at < len(audit) and audit[at] == "I":
                    last = OTHER.get(last, "u")
                    line(open_, out, "I", ROLES[last], "")
                    at += 1

            for batch in batches:
                for conv_id, kind, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "n"))):
                    if kind == 0:
                        if open_ is not None:
                            inserts()
                            end(open_, out)
                        open_, audit, at, last = start(conv_id), text, 0, None
                        continue
                    for _ in range(n):
                        inserts()
                        edit = audit[at]
                        at += 1
                        if edit == "K":
                            last = role[:1]
                            line(open_, out, edit, role, text)
                        elif edit == "R":
                            last = OTHER.get(last, "u")
                            line(open_, out, edit, ROLES[last], text)
                        # The conversation's other places are gone.
                    if len(out) >= 500:
                        yield _batch(out, arrow)
                        out = []
            if open_ is not None:
                inserts()
                end(open_, out)
            yield _batch(out, arrow)

        return rows.select("conv_id", "kind", "role", "text", "n").mapInArrow(work, want)

    def turns(self) -> DataFrame:
        """(conv_id, place, edit, role, text) of the repaired conversations."""

        def line(conv: list, out: list, edit: str, role: str, text: str) -> None:
            out.append({"conv_id": conv[0], "place": conv[1], "edit": edit, "role": role, "text": text})
            conv[1] += 1

        return self._replayed("place long, edit string, role string, text string", lambda conv_id: [conv_id, 0], line, lambda conv, out: None)

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256)."""

        def line(conv: list, out: list, edit: str, role: str, text: str) -> None:
            conv[1].update((b"\n" if conv[2] else b"") + f"{role}:{text}".encode())
            conv[2] = True

        def end(conv: list, out: list) -> None:
            out.append({"conv_id": conv[0], "repaired_sha256": conv[1].hexdigest()})

        return self._replayed("repaired_sha256 string", lambda conv_id: [conv_id, hashlib.sha256(), False], line, end)


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Report and digest of each conv_id of ``conversations`` for its ``rows``; zeros, no edits and the digest of
    nothing where it has none."""
    repair = Repair(rows)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    same = lambda a: F.col("conv_id").eqNullSafe(F.col(a))
    found = conversations.select("conv_id").distinct()
    found = found.join(repair.report.withColumnRenamed("conv_id", "_r"), same("_r"), "left").join(repair.digests().withColumnRenamed("conv_id", "_d"), same("_d"), "left")
    nothing = hashlib.sha256().hexdigest()
    return found.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
