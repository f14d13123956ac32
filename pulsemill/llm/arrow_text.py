"""Text columns of Arrow batches as numpy arrays, in pieces of bounded size."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at a time; a longer single text makes a piece of its own.
PIECE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# Word bytes after lower-casing: digits, a-z and all of every letter beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHINGLE = np.uint64(0xA0761D6478BD642F)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `size` bytes of text each."""
    for batch in batches:
        offsets = _offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _offsets(text: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    raw = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)
    return raw[text.offset : text.offset + len(text) + 1].astype(np.int64)


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more entry than texts); NULL is empty."""
    if text.null_count:
        text = text.fill_null("")
    offsets = _offsets(text)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of several texts: where they begin and end in `data`, whose they are, and their hashes.

    `data` is lower-cased (A-Z only). Words are runs of digits, letters a-z and characters beyond ASCII.
    """

    def __init__(self, text: pa.Array):
        raw, self.offsets = bytes_of(text)
        self.data = LOWER[raw]
        inside = WORD[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.offsets)  # index of each text's first word
        self.hash = _word_hashes(self.data, self.start, self.end)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every run of `size` words within one text."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, np.uint64(size))
        for k in range(size):
            h = (h ^ self.hash[k : k + n]) * _SHINGLE
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, _mixed(h[at])

    def join(self, a: int, b: int) -> str:
        """Words a to b (exclusive), with blanks between."""
        return " ".join(self.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[a:b], self.end[a:b]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes from running sums, over stretches of about PIECE_BYTES."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + 2 * PIECE_BYTES)))
        low, high = start[at], end[to - 1]
        powers = np.full(high - low, _BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        # Dividing by the power at the word's start makes equal words equal wherever they stand.
        inverse = np.full(high - low, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return _mixed(out)
