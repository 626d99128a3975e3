"""Language-model scores by a weighted backoff automaton of smoothed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from dwellmatch.llm.common import Shelf, mix64, slices
from dwellmatch.llm.word_hash import BLANKS, WordHashes, pack, unpack

#: Words of an n-gram at most.
ORDER = 3
#: Weight of the shorter context: p(w | h) = (c(hw) + BACKOFF p(w | h')) / (c(h) + BACKOFF).
BACKOFF = 2.0
#: Added to each token's count where no context is left; one more token stands for all unknown ones.
ADDED = 0.1
#: Tokens of a slab; a longer text goes on in the next.
SLAB = 1 << 20
#: Distinct n-grams that one task sums up, in the mean.
RANGE_KEYS = 1 << 21
#: Steps that all lanes of a slab are walked in.
STEPS = 256

#: Bits by which the keys of n-grams of two words and more are shortened. Of 10^10 n-grams in 56 bits about
#: 700 pairs share a key and are counted together; words keep all 64.
SPARED_BITS = 8

#: Symbols before and after each text.
START, END = np.uint64(1), np.uint64(2)

DOC = "row long, lead int, tokens int, learn boolean"
SLABS = f"slab long, tokens long, learned long, docs array<struct<{DOC}>>, words binary, places binary"
GRAMS = "slab long, ord int, part int, grams binary, counts binary"
SUMS = "slab long, ord int, part int, known long, totals binary"
SCORES = "row long, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    """True for the tenth of the ids that nothing is learned from, and without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _columns(made: dict[str, list], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)


def _slabs(docs: DataFrame, id_col: str, text_col: str, learn: Column, order: int) -> DataFrame:
    """Texts as rows of words, ``SLAB`` tokens a row. A piece of a text starts with symbols that only set
    the state (``lead`` of them): the start symbol, or the last words of the piece before."""
    want = StructType([StructField("slab", StructType.fromDDL("x long")["x"].dataType), *StructType.fromDDL(SLABS)[1:], StructField("ids", StructType.fromDDL(f"x array<{docs.schema[id_col].dataType.simpleString()}>")["x"].dataType)])
    arrow = to_arrow_schema(want)

    def slab(number: int, pieces: list[tuple]) -> pa.RecordBatch:
        stream = np.concatenate([p[-1] for p in pieces])
        words, places = _by_frequency(*_distinct(stream))
        tokens = [len(p[-1]) - p[2] for p in pieces]
        made = {"slab": [number], "tokens": [sum(tokens)], "learned": [sum(n for n, p in zip(tokens, pieces) if p[3])], "ids": [[p[0] for p in pieces]], "words": [pack(words)], "places": [pack(places)]}
        made["docs"] = [[{"row": p[1], "lead": p[2], "tokens": n, "learn": p[3]} for p, n in zip(pieces, tokens)]]
        return _columns(made, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        hashes, row, number, pieces, size = WordHashes(BLANKS), base, base, [], 0
        for batch in slices(batches):
            words, counts = hashes.of(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            for i, learned, end, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends.tolist(), counts.tolist()):
                text = np.concatenate([[START], words[end - n : end], [END]])
                at = 1
                while at < len(text):
                    stop = min(len(text), at + SLAB - size)
                    first = max(at - order + 1, 0) if at > 1 else 0
                    pieces.append((i, row, at - first, learned, text[first:stop]))
                    size += stop - at
                    at = stop
                    if size >= SLAB:
                        yield slab(number, pieces)
                        number, pieces, size = number + 1, [], 0
                row += 1
        if pieces:
            yield slab(number, pieces)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), learn.alias("learn"))
    return rows.mapInArrow(run, want)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def _by_frequency(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with the most frequent words first: most places are then small numbers."""
    order = np.argsort(-np.bincount(places), kind="stable")
    to = np.empty(len(words), np.int32)
    to[order] = np.arange(len(words), dtype=np.int32)
    return words[order], to[places]


class _Slab:
    """The symbols of a slab with, by order, its distinct n-grams and the one that ends at each place."""

    def __init__(self, docs: dict[str, np.ndarray], words: bytes, places: bytes, order: int):
        self.words, self.word = unpack(words), unpack(places).astype(np.int32)
        lead, tokens = docs["lead"].astype(np.int64), docs["tokens"].astype(np.int64)
        lengths = lead + tokens
        self.docs, self.starts = docs, np.cumsum(lengths) - lengths
        self.piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        since = np.arange(len(self.word)) - self.starts[self.piece]
        self.counted = since >= lead[self.piece]
        #: The start symbols of texts, not those that a piece repeats.
        self.opening = (since == 0) & (lead[self.piece] == 1) & (self.words[self.word] == START)
        self.keys, self.gram = [], []
        key = np.full(len(self.word), START)
        for n in range(1, order + 1):
            # The key of the n - 1 words before, one place back, together with the word here.
            before = np.concatenate([[START], key[:-1]]) if n > 1 else key
            key = mix64(mix64(before + np.uint64(n)) + self.words[self.word])
            whole = np.flatnonzero(since >= n - 1)
            distinct, place = _distinct(key[whole] >> np.uint64(0 if n == 1 else SPARED_BITS))
            self.keys.append(distinct)
            self.gram.append(np.full(len(key), -1, np.int32))
            self.gram[-1][whole] = place


def _grams(slabs: DataFrame, order: int, parts: int) -> DataFrame:
    """Per slab, order and range of keys: the distinct n-grams and how often the slab teaches them."""
    arrow = to_arrow_schema(StructType.fromDDL(GRAMS))
    cuts = np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)
    cuts_of = [cuts >> np.uint64(0 if n == 0 else SPARED_BITS) for n in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, slab in _each_slab(batches, order):
            learn = slab.docs["learn"][slab.piece]
            for n in range(order):
                gram = slab.gram[n]
                # The start symbol is no token, but its count is that of a context.
                taught = learn & (gram >= 0) & (slab.counted | (n == 0) & slab.opening)
                counts = np.bincount(gram[taught], minlength=len(slab.keys[n]))
                edges = [0, *np.searchsorted(slab.keys[n], cuts_of[n]).tolist(), len(counts)]
                some = [k for k in range(parts) if edges[k] < edges[k + 1]]
                made = {"slab": [row] * len(some), "ord": [n + 1] * len(some), "part": some}
                made["grams"] = [pack(slab.keys[n][edges[k] : edges[k + 1]], True) for k in some]
                made["counts"] = [pack(counts[edges[k] : edges[k + 1]]) for k in some]
                yield _columns(made, arrow)

    return slabs.select("slab", "docs", "words", "places").mapInArrow(run, GRAMS)


def _doc_columns(docs: pa.Scalar) -> dict[str, np.ndarray]:
    inner = docs.values
    return {f.name: inner.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(inner.type)}


def _each_slab(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, _Slab]]:
    for batch in batches:
        for at in range(batch.num_rows):
            number, docs, words, places = (c[at] for c in batch.columns)
            yield number.as_py(), _Slab(_doc_columns(docs), words.as_py(), places.as_py(), order)


def _sums(grams: DataFrame) -> DataFrame:
    """Per slab, order and range: counts of the slab's n-grams over all slabs, in the slab's order, and on one
    row of each range how many n-grams are known there."""
    arrow = to_arrow_schema(StructType.fromDDL(SUMS))

    def total(table: pa.Table) -> pa.Table:
        keys = [unpack(k, True) for k in table["grams"].to_pylist()]
        distinct, place = _distinct(np.concatenate(keys))
        counts = np.concatenate([unpack(c) for c in table["counts"].to_pylist()]).astype(np.int64)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, place, counts)
        ends = np.cumsum([len(k) for k in keys])
        made = {name: table[name].to_pylist() for name in ("slab", "ord", "part")}
        made["known"] = [int((sums > 0).sum())] + [0] * (len(keys) - 1)
        made["totals"] = [pack(sums[place[e - len(k) : e]]) for e, k in zip(ends, keys)]
        return pa.Table.from_batches([_columns(made, arrow)])

    return grams.groupBy("ord", "part").applyInArrow(total, SUMS)


class Automaton:
    """States are the contexts that were seen, 0 the empty one; an arc reads a word, a failure arc none.

    ``arcs``: state * words + word, sorted, each with the state it leads to and its log10
    probability; ``failure`` and ``penalty``: per state the next shorter context and the log10 weight of
    going there; ``first`` and ``first_log``: arcs of the empty context, which has one for each word.
    It holds just the n-grams of one slab, with counts over the whole corpus: no other arc would
    be taken in it.
    """

    def __init__(self, slab: _Slab, totals: list[np.ndarray], n_tokens: int, n_known: int):
        n_words, order = len(slab.words), len(totals)
        word_count = totals[0][np.searchsorted(slab.keys[0], _unigram_keys(slab.words))]
        is_start, is_end = slab.words == START, slab.words == END
        p = (word_count + ADDED) / (n_tokens + ADDED * (n_known + 1))
        self.known = (word_count > 0) & ~is_start
        self.first_log = np.log10(p)
        n_states = 1
        self.first = np.where((word_count > 0) & ~is_end & (order > 1), n_states + np.arange(n_words), 0)
        state_of = [None, self.first[slab.word]]
        contexts = [np.concatenate([[0], word_count])]
        failures = [np.zeros(1 + n_words, np.int64)]
        n_states += n_words
        lower, arcs, targets, logs = p[slab.word], [], [], []
        for n in range(1, order):
            gram, count = slab.gram[n], totals[n]
            at = np.full(len(count), -1)
            at[gram[gram >= 0]] = np.flatnonzero(gram >= 0)
            context_count = np.concatenate(contexts)
            # Of each distinct n-gram: its last word, the state of the words before it, its probability.
            word, context = slab.word[at], state_of[n][at - 1]
            # Words before that were never seen are no state; then the n-gram wasn't seen either.
            seen = count > 0
            prob = (count + BACKOFF * lower[at]) / (context_count[context] + BACKOFF)
            ends = is_end[word]
            target = np.where(seen & ~ends, n_states + np.arange(len(count)), 0)
            shorter = state_of[n][at]
            arcs.append((context[seen] * n_words + word[seen]))
            # The longest context has the length order - 1.
            targets.append((target if n < order - 1 else shorter)[seen])
            logs.append(np.log10(prob)[seen])
            # Index -1 stands for no n-gram.
            lower = np.where(gram >= 0, np.append(prob, 0.0)[gram], lower)
            if n < order - 1:
                state_of.append(np.append(target, 0)[gram])
                contexts.append(count)
                failures.append(shorter)
                n_states += len(count)
        arcs = np.concatenate(arcs) if arcs else np.zeros(0, np.int64)
        by = np.argsort(arcs)
        self.n_words, self.arcs = n_words, np.append(arcs[by], np.iinfo(np.int64).max)
        self.targets = np.append(np.concatenate(targets)[by], 0) if targets else np.zeros(1, np.int64)
        self.logs = np.append(np.concatenate(logs)[by], 0.0) if logs else np.zeros(1)
        self.failure = np.concatenate(failures)
        with np.errstate(divide="ignore"):
            self.penalty = np.log10(BACKOFF / (np.concatenate(contexts) + BACKOFF))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 probabilities) of reading one word in each lane."""
        target, log = np.empty(len(state), np.int64), np.zeros(len(state))
        lanes = np.arange(len(state))
        while len(lanes):
            root = state == 0
            log[lanes[root]] += self.first_log[word[root]]
            target[lanes[root]] = self.first[word[root]]
            lanes, state, word = lanes[~root], state[~root], word[~root]
            wanted = state * self.n_words + word
            at = np.searchsorted(self.arcs, wanted)
            hit = self.arcs[at] == wanted
            log[lanes[hit]] += self.logs[at[hit]]
            target[lanes[hit]] = self.targets[at[hit]]
            lanes, state, word = lanes[~hit], state[~hit], word[~hit]
            log[lanes] += self.penalty[state]
            state = self.failure[state]
        return target, log


def _unigram_keys(words: np.ndarray) -> np.ndarray:
    return mix64(mix64(np.full(len(words), START) + np.uint64(1)) + words)


def walk(automaton: Automaton, word: np.ndarray, fresh: np.ndarray, order: int) -> np.ndarray:
    """Log10 probability of each symbol in one traversal from left to right.

    ``fresh`` marks the symbols that are read in the empty context, the first of each text. The row of
    symbols is cut into lanes that are walked in step; a lane first reads the ``order - 1`` symbols
    before it, which is all that a state can remember.
    """
    n, warm = len(word), order - 1
    lanes = -(-n // STEPS)
    starts = np.arange(lanes) * STEPS
    state, out = np.zeros(lanes, np.int64), np.zeros(n)
    for k in range(-warm, STEPS):
        at = starts + k
        live = np.flatnonzero((at >= 0) & (at < n))
        here = at[live]
        now = np.where(fresh[here], 0, state[live])
        state[live], log = automaton.step(now, word[here])
        if k >= 0:
            out[here] = log
    return out


def _scored(slabs: DataFrame, sums: DataFrame, order: int, n_tokens: int, n_known: int) -> DataFrame:
    """Scores of the pieces of each slab."""
    arrow = to_arrow_schema(StructType.fromDDL(SCORES))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("ord", "ascending"), ("part", "ascending")])
        totals: list[list] = [[] for _ in range(order)]
        for n, counts in zip(right["ord"].to_pylist(), right["totals"].to_pylist()):
            totals[n - 1].append(unpack(counts).astype(np.int64))
        totals = [np.concatenate(t) if t else np.zeros(0, np.int64) for t in totals]
        slab = _Slab(_doc_columns(left["docs"][0]), left["words"][0].as_py(), left["places"][0].as_py(), order)
        automaton = Automaton(slab, totals, n_tokens, n_known)
        slab.keys = slab.gram = totals = right = None
        fresh = np.zeros(len(slab.word), bool)
        fresh[slab.starts] = True
        logs = walk(automaton, slab.word, fresh, order)
        counted, n_docs = slab.counted, len(slab.starts)
        piece, word = slab.piece[counted], slab.word[counted]
        made = {
            "row": slab.docs["row"],
            "n_tokens": np.bincount(piece, minlength=n_docs),
            "n_known": np.bincount(piece[automaton.known[word]], minlength=n_docs),
            "base_score": np.bincount(piece, weights=automaton.first_log[word], minlength=n_docs),
            "score": np.bincount(piece, weights=logs[counted], minlength=n_docs),
        }
        return pa.Table.from_batches([_columns(made, arrow)])

    left, right = slabs.select("slab", "docs", "words", "places"), sums.select("slab", "ord", "part", "totals")
    return left.groupBy("slab").cogroup(right.groupBy("slab")).applyInArrow(score, SCORES)


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Words stand between blanks, A-Z lower-cased; an end symbol after them is a token too. n-grams up to
    ``order`` are counted over the rows for which ``learn`` is true. ``base_score`` is of single
    tokens with ``ADDED`` to each count; ``score`` is of the automaton, whose contexts fall back as
    ``BACKOFF`` says and at last to those single tokens. Logarithms are to base 10.

    Slabs of texts send their distinct n-grams, once each, to ranges of the key; ranges add up and send
    totals back, so a frequent n-gram costs a row per slab and no task sees more than its range or
    slab. Slabs stay in a table. Words are told apart by 64-bit hashes, n-grams by 56 bits.

    Null and empty texts have the end symbol alone. Repeated rows each count and each get a row; null
    ids too. With nothing to learn from, every token has the probability 1. An empty table gives no
    rows. Other columns are not looked at.
    """
    shelf = Shelf(docs.sparkSession, "backoff-lm")
    slabs = shelf.put(_slabs(docs, id_col, text_col, F.coalesce(learn, F.lit(False)), order), "slabs")
    row = slabs.agg(F.sum("tokens"), F.sum("learned")).first()
    tokens, learned = row[0] or 0, row[1] or 0
    sums = shelf.put(_sums(_grams(slabs, order, max(1, -(-tokens // RANGE_KEYS)))), "sums")
    known = sums.where("ord = 1").agg(F.sum("known")).first()[0] or 0
    # The start symbol is among the known ones if anything was learned.
    scores = _scored(slabs, sums, order, learned, max(known - 1, 0))
    scores = scores.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    listed = slabs.select(F.explode(F.arrays_zip("ids", "docs")).alias("d")).select(F.col("d.docs.row").alias("row"), F.col("d.ids").alias(id_col), F.col("d.docs.learn").alias("learned"))
    return listed.dropDuplicates(["row"]).join(scores, "row").select(id_col, "learned", "n_tokens", "n_known", F.lit(learned).cast("long").alias("train_tokens"), "base_score", "score")
