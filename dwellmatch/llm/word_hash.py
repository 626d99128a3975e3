"""Words of texts as 64-bit hashes, without a Python object per word, and packed number arrays."""

from __future__ import annotations

import numpy as np
import zstandard

from dwellmatch.llm.common import mix64

#: Bytes that are hashed at a time.
CHUNK = 1 << 19

#: The separators of words, and all of ASCII but letters and digits.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_rng = np.random.default_rng(20250211)
_BASE = int(_rng.integers(1, 2**63)) * 2 + 1
_OF_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_OF_BYTE[ord("A") : ord("Z") + 1] = _OF_BYTE[ord("a") : ord("z") + 1]
_WRAP = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), _WRAP))])
    return out[:n]


class WordHashes:
    """Hashes of the maximal runs of bytes that are no ``separators``; A-Z counts as a-z.

    A word's hash is a polynomial in its bytes, taken as a difference of running sums, then mixed.
    Two words of a vocabulary of a hundred million share one with probability below 0.001.
    """

    def __init__(self, separators: bytes):
        self.in_word = np.ones(256, bool)
        self.in_word[list(separators)] = False
        self.blank = separators[:1]
        self.up, self.down = _powers(_BASE, CHUNK + 1), _powers(pow(_BASE, -1, _WRAP), CHUNK + 1)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words per text)."""
        counts = np.zeros(len(texts), np.int64)
        parts, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or b"") < CHUNK):
                size += len(texts[stop] or b"") + 1
                stop += 1
            if size > CHUNK:
                found = self._long(texts[at])
                counts[at] = len(found)
            else:
                ends = np.cumsum([len(t or b"") + 1 for t in texts[at:stop]])
                found, starts = self._hash(np.frombuffer(self.blank.join(t or b"" for t in texts[at:stop]), np.uint8))
                counts[at:stop] = np.diff(np.searchsorted(starts, ends), prepend=0)
            parts.append(found)
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts

    def _hash(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(data) + 2, np.int8)
        edge[1:-1] = self.in_word[data]
        edge = np.diff(edge)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * self.up[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.down[starts]), starts

    def _long(self, text: bytes) -> np.ndarray:
        """A text longer than a chunk: cut at separators; a word longer than a chunk is summed in parts."""
        data, parts, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(data):
            stop = min(at + CHUNK, len(data))
            if stop < len(data):
                gaps = np.flatnonzero(~self.in_word[data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:
                    value, size = 0, 0
                    while at + size < len(data) and self.in_word[data[at + size]]:
                        piece = data[at + size : at + size + CHUNK]
                        gaps = np.flatnonzero(~self.in_word[piece])
                        piece = piece[: gaps[0]] if len(gaps) else piece
                        part = int((_OF_BYTE[piece] * self.up[: len(piece)]).sum(dtype=np.uint64))
                        value = (value + part * pow(_BASE, size, _WRAP)) % _WRAP
                        size += len(piece)
                    parts.append(mix64(np.array([value], np.uint64)))
                    at += size
                    continue
            parts.append(self._hash(data[at:stop])[0])
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def pack(numbers: np.ndarray, increasing: bool = False) -> bytes:
    """64-bit numbers by byte planes, compressed; of increasing ones the steps between them."""
    x = numbers.astype(np.uint64, copy=False)
    if increasing and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, increasing: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if increasing else x
