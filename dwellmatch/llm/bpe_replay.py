"""Byte-level BPE by merge replay over a body of words, and decoding."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from dwellmatch.llm.common import map_texts, release_memory, worker_store

#: Words whose ids a worker keeps from one batch to the next; when full, it starts anew.
KEEP_WORDS = 200_000


class Vocabulary:
    """Ranks of byte strings, and the rank that each pair of neighbouring tokens merges into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: For each rank: its splits into two tokens (left to right), and what it merges into with the
        #: token after it and with the token before it. Every split counts, since it's the joined
        #: bytes that decide.
        self.splits: dict[int, dict[int, int]] = {}
        self.with_next: dict[int, dict[int, int]] = {}
        self.with_previous: dict[int, dict[int, int]] = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    self.splits.setdefault(rank, {})[left] = right
                    self.with_next.setdefault(left, {})[right] = rank
                    self.with_previous.setdefault(right, {})[left] = rank
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = ranks.get(bytes([a, b]), -1)


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each word: every merge is applied to all words at once, in rank order.

    The words lie end to end; an inverted index leads from a merge to the positions of its pair.
    The lowest rank is taken next, its positions from left to right; a merge re-indexes just the
    pairs with its two neighbours. A merge can open a pair of lower rank only in words whose
    tokens were not reached in training order; such a word is replayed alone, so that each word
    always sees its own lowest rank first.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return [[] for _ in words]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.zeros(n + 1, bool)
    first[starts[lengths > 0]] = True
    first[n] = True
    # One more place, n, stands for what is before and after each word; no token there fits a pair.
    token = vocabulary.of_byte[data].tolist() + [-2]
    right = np.arange(1, n + 2)
    right[:n][first[1:]] = n
    left = np.arange(-1, n)
    left[:n][first[:n]] = n

    rank = np.full(n, -1, np.int64)
    rank[:-1] = vocabulary.byte_pairs[data[:-1], data[1:]]
    rank[right[:n] == n] = -1
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[at])) + 1
    index = {int(rank[part[0]]): part.tolist() for part in np.split(at, cuts)} if len(at) else {}
    right, left = right.tolist(), left.tolist()
    queue = list(index)
    heapify(queue)
    late: set[int] = set()
    nothing: dict[int, int] = {}
    while queue:
        now = heappop(queue)
        places = index.pop(now)
        places.sort()
        split = vocabulary.splits[now].get
        with_next = vocabulary.with_next.get(now, nothing)
        with_previous = vocabulary.with_previous.get(now, nothing)
        for p in places:
            q = right[p]
            if split(token[p]) != token[q]:
                continue
            token[p], token[q] = now, -1
            r = right[p] = right[q]
            left[r] = p
            opened = ()
            if token[r] in with_next:
                opened = ((with_next[token[r]], p),)
            s = left[p]
            if token[s] in with_previous:
                opened += ((with_previous[token[s]], s),)
            for k, at in opened:
                if k in index:
                    index[k].append(at)
                elif k < now:
                    late.add(p)
                else:
                    index[k] = [at]
                    heappush(queue, k)
    token.pop()
    flat = np.array(token, np.int64)
    alive = flat >= 0
    counts = np.concatenate([[0], np.cumsum(alive)])
    kept = flat[alive].tolist()
    lo, hi = counts[starts].tolist(), counts[ends].tolist()
    out = [kept[a:b] for a, b in zip(lo, hi)]
    for w in set(np.searchsorted(ends, sorted(late), side="right").tolist()):
        out[w] = alone(words[w], vocabulary)
    return out


def alone(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word: of all its pairs, the lowest rank is merged next, the leftmost one of equals."""
    token = [int(vocabulary.of_byte[b]) for b in word]
    n = len(token)
    right, left = list(range(1, n)) + [-1], list(range(-1, n - 1))
    follow = vocabulary.with_next

    def rank_at(p: int) -> int | None:
        return follow.get(token[p], {}).get(token[right[p]]) if p >= 0 and right[p] >= 0 else None

    queue = [(k, p) for p in range(n) if (k := rank_at(p)) is not None]
    heapify(queue)
    while queue:
        now, p = heappop(queue)
        if token[p] < 0 or rank_at(p) != now:
            continue
        q = right[p]
        token[p], token[q] = now, -1
        right[p] = right[q]
        if right[q] >= 0:
            left[right[q]] = p
        for a in (left[p], p):
            if (k := rank_at(a)) is not None:
                heappush(queue, (k, a))
    return [t for t in token if t >= 0]


# What \p{L}, \p{N} and \s are below U+0100.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text.

    Texts below U+0100 go to the standard library's faster engine, which knows no Unicode
    properties: there they are spelled out, with the same matches.
    """
    whole = regex.compile(pattern).findall
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    spelled = spelled.replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
    try:
        small = re.compile(spelled).findall
    except re.error:
        return whole

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return small(text)

    return whole if r"\p" in spelled else split


class Encoder:
    """Texts to ids, written as decimal numbers joined by commas, and back.

    Words met before keep their ids, up to ``KEEP_WORDS`` of them.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = splitter(pattern)
        self.known: dict[str, str] = {}
        self.bytes_of = {str(rank): piece for rank, piece in enumerate(vocabulary.pieces)}

    def encode(self, texts: list[str]) -> Iterable[str]:
        """The words of all texts that are not known yet are replayed together."""
        parts = [self.split(t) for t in texts]
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        spelled = [w.encode("utf-8") for w in new]
        ranks, name = self.vocabulary.ranks, list(self.bytes_of).__getitem__
        rest = [k for k, b in enumerate(spelled) if b not in ranks]
        self.known.update((w, str(ranks[b])) for w, b in zip(new, spelled) if b in ranks)
        self.known.update(zip([new[k] for k in rest], (",".join(map(name, ids)) for ids in replay([spelled[k] for k in rest], self.vocabulary))))
        get = self.known.__getitem__
        for words in parts:
            yield ",".join(map(get, words))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


#: Characters of text that are encoded together: the body of words of one replay.
BODY_CHARS = 1_000_000


def _bodies(texts: list[str | None]) -> Iterable[list[str]]:
    body, size = [], 0
    for text in texts:
        body.append(text or "")
        size += len(body[-1])
        if size >= BODY_CHARS:
            yield body
            body, size = [], 0
    if body:
        yield body


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: (id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    ``ranks_path`` is a vocabulary file that the driver reads (lines of base64 token and rank) and
    broadcasts; its size does not depend on the data. Each match of ``pattern`` is a word and is
    encoded by itself, so the merges replayed over the words of some documents give each word the
    ids it would get over all words of the corpus. One pass without a shuffle: tasks replay the
    distinct words of about ``BODY_CHARS`` characters of documents at a time. Special tokens are
    ordinary text. Null and empty texts have no ids (the digests of nothing). Repeated rows each
    get their row; other columns are not looked at; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = read_ranks(f)
    shared = spark.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def work(texts: list[str | None]) -> dict[str, list]:
        store = worker_store("bpe")
        if name not in store:
            release_memory()
            store = worker_store("bpe")
            store[name] = Encoder(Vocabulary(shared.value), pattern)
        encoder = store[name]
        cols: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        # Lists of words and ids hold no cycles; walking them for garbage takes a fifth of the time.
        gc.disable()
        try:
            for body in _bodies(texts):
                for ids in encoder.encode(body):
                    cols["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                    cols["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    cols["decoded_sha256"].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if with_ids:
                        cols["ids"].append(np.array(ids.split(",") if ids else [], np.int32))
        finally:
            gc.enable()
        return cols

    return map_texts(docs, id_col, text_col, schema, work)
