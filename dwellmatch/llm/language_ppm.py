"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellmatch.llm.common import map_texts, with_made

ORDER = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

#: Bytes whose code lengths are looked up at a time.
CHUNK = 1 << 19


@dataclass
class PpmModel:
    """Frozen statistics of all languages, as code lengths.

    ``symbol`` numbers the bytes met in training from 1; 0 is every other byte, which no context knows. ``state`` leads from
    the last three symbols to the longest context known, ``bits[state, symbol, language]`` is what
    the next symbol costs there, escapes included.
    """

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of the whole text in each language. The text stands after three zero bytes."""
        n_symbols = self.bits.shape[1]
        table = self.bits.reshape(-1, len(self.languages))
        total = np.zeros(len(self.languages))
        before = np.zeros(ORDER, np.uint8)
        for at in range(0, len(text), CHUNK):
            data = np.concatenate([before, np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)])
            s = self.symbol[data]
            context = (s[:-3] * n_symbols + s[1:-2]) * n_symbols + s[2:-1]
            total += table[self.state[context] * n_symbols + s[3:]].sum(axis=0, dtype=np.float64)
            before = data[-ORDER:]
        return total


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): how often three bytes and the next one stand in a batch, as one number."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        for lang, texts in by_lang.items():
            grams = []
            for text in texts:
                d = np.frombuffer(bytes(ORDER) + text, np.uint8).astype(np.int64)
                grams.append(d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:])
            gram, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 600, max_contexts: int = 1 << 15) -> PpmModel:
    """Learn from a bounded sample: about ``rows_per_language`` rows of each language, whole texts.

    Rows are drawn by a hash of the id, at the rate that the language's number of rows asks for.
    Their byte statistics are counted on Spark; what reaches the driver is bounded by the sample.
    ``max_contexts`` bounds the context tree (the most frequent contexts are kept), and so what is
    broadcast: contexts x bytes x languages x 4. Rows without text or language teach nothing.
    """
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return PpmModel([], np.zeros(256, np.int64), np.zeros(1, np.int64), np.zeros((1, 1, 0), np.float32))
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), draw.alias("draw")).where(F.col("draw") < rates[F.col("lang")])
    grams = sample.select("lang", "text").mapInArrow(_gram_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build(languages, grams["lang"].to_numpy(), grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64), max_contexts)


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, max_contexts: int) -> PpmModel:
    """Code lengths from counts of (three bytes, next byte) per language.

    Escapes are those of method C with exclusion: a context where T bytes of D kinds were seen
    gives a byte seen c times c/(T+D) and the escape D/(T+D); after an escape, bytes of the longer
    context no longer count in the shorter one, and at last all bytes left are equally likely.
    """
    symbol = np.zeros(256, np.int64)
    met = np.union1d(gram & 255, [0])  # zero bytes stand before each text
    symbol[met] = np.arange(1, len(met) + 1)
    n_symbols = len(met) + 1
    digits = [symbol[gram >> shift & 255] for shift in (24, 16, 8, 0)]
    which = np.searchsorted(np.array(languages, object).astype(str), lang.astype(str))

    # Contexts of each order as numbers, the frequent ones first.
    contexts, counts = [], []
    for order in range(ORDER + 1):
        key = np.zeros(len(gram), np.int64)
        for d in digits[ORDER - order : ORDER]:
            key = key * n_symbols + d
        keys, inverse = np.unique(key, return_inverse=True)
        room = max_contexts - sum(map(len, contexts))
        weight = np.bincount(inverse, n, len(keys))
        kept = np.sort(np.argsort(-weight, kind="stable")[:room])
        rank = np.full(len(keys), -1)
        rank[kept] = np.arange(len(kept))
        contexts.append(keys[kept])
        table = np.zeros((len(languages), len(kept), n_symbols), np.float32)
        at = rank[inverse]
        ok = at >= 0
        np.add.at(table, (which[ok], at[ok], digits[ORDER][ok]), n[ok])
        counts.append(table)

    offsets = np.cumsum([0, *map(len, contexts)])
    bits = np.empty((offsets[-1], n_symbols, len(languages)), np.float32)
    for order in range(ORDER + 1):
        keys = contexts[order]
        for k in range(len(languages)):
            spent = np.zeros(len(keys))
            used = np.zeros((len(keys), n_symbols), bool)
            cost = np.zeros((len(keys), n_symbols))
            for shorter in range(order, -1, -1):
                suffix = keys % n_symbols**shorter
                at = np.searchsorted(contexts[shorter], suffix)
                at = np.minimum(at, len(contexts[shorter]) - 1)
                c = np.where((contexts[shorter][at] == suffix)[:, None] & ~used, counts[shorter][k][at], 0)
                kinds, total = (c > 0).sum(1), c.sum(1)
                seen = c > 0
                whole = np.log2(np.maximum(total + kinds, 1))
                cost = np.where(seen, spent[:, None] + whole[:, None] - np.log2(np.where(seen, c, 1)), cost)
                spent += np.where(kinds > 0, whole - np.log2(np.maximum(kinds, 1)), 0)
                used |= seen
            last = spent + np.log2(np.maximum(256 - used.sum(1), 1))
            bits[offsets[order] : offsets[order + 1], :, k] = np.where(used, cost, last[:, None])

    state = np.zeros(n_symbols**ORDER, np.int32)
    every = np.arange(len(state))
    for order in range(1, ORDER + 1):
        at = np.minimum(np.searchsorted(contexts[order], every % n_symbols**order), max(len(contexts[order]) - 1, 0))
        if len(contexts[order]):
            hit = contexts[order][at] == every % n_symbols**order
            state[hit] = (offsets[order] + at)[hit]
    return PpmModel(languages, symbol, state, bits)


def identify(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) per document; only the text is looked at.

    The language is the one in which the whole text has the shortest code (of equals the first by
    name), the score its share of the probability if all languages are equally likely beforehand.
    Null texts, texts without a letter, and all texts if nothing was learned are ``und`` with score
    0 and no bits. One pass without a shuffle; the model is broadcast and its size is bounded by
    parameters of ``fit``. Repeated rows each get their row; an empty table gives no rows.
    """
    return map_texts(docs, id_col, text_col, MADE, _worker(docs, model))


MADE = "lang_pred string, score double, bits_per_byte double"


def with_language(docs: DataFrame, model: PpmModel, text_col: str = "text", made: str = "_language") -> DataFrame:
    """All columns of ``docs``, and what ``identify`` says as a struct column ``made``."""
    return with_made(docs, text_col, made, MADE, _worker(docs, model))


def _worker(docs: DataFrame, model: PpmModel) -> Callable[[list], dict[str, list]]:
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.symbol, model.state, model.bits))

    def work(texts: list[str | None]) -> dict[str, list]:
        m = PpmModel(*shared.value)
        cols: dict[str, list] = {"lang_pred": [], "score": [], "bits_per_byte": []}
        for text in texts:
            lang, score, per_byte = UNKNOWN, 0.0, None
            if m.languages and text and _LETTER.search(text):
                data = text.encode("utf-8", "surrogatepass")
                lengths = m.code_lengths(data)
                best = int(np.argmin(lengths))
                lang = m.languages[best]
                score = float(1 / np.exp2(np.maximum(lengths[best] - lengths, -1000)).sum())
                per_byte = float(lengths[best] / len(data))
            cols["lang_pred"].append(lang)
            cols["score"].append(score)
            cols["bits_per_byte"].append(per_byte)
        return cols

    return work
