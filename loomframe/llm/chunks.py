"""Whole texts as byte arrays: spans cut at safe places, their hashes, and a bounded memo of what each span encodes to.

An Arrow string column is one byte buffer with offsets, so spans, hashes and
memo look-ups of a window of many documents are a few NumPy calls. Windows are
balanced by bytes; a text longer than a window is cut at a safe place, and only
a text without any such place makes a longer window.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 19
#: Bytes of text that are taken of an Arrow batch at a time.
SLICE = 1 << 21
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: The bytes that part words: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Beside these no cut is made, as some pattern might take them for white space.
_NO_CUT = _SPACE.copy()
_NO_CUT[[*range(0x1C, 0x20), 0x00, 0x7F]] = True
_TWO = np.zeros(256, bool)  # first bytes of U+00C0 to U+03FF, none of them white space
_TWO[0xC3:0xD0] = True
_ASCII = np.arange(256) < 0x80
_PLAIN = _ASCII & ~_NO_CUT
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, WINDOW + 4096), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    powers, inverse = _powers_to(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * powers[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents; ``offsets`` has len(documents) + 1 entries."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between characters that surely aren't white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    return at[(_PLAIN[before] | ((before >= 0x80) & (at > 1) & _TWO[data[at - 2]])) & (_PLAIN[after] | _TWO[after])]


def safe_spans(data: np.ndarray, offsets: np.ndarray, with_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spans between single spaces; the space itself begins the next span if ``with_space``, else it is in none."""
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full]
    cut = _cuts(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    cut = cut[~edge[cut] & ~edge[cut + 1]]
    return np.sort(np.concatenate([first, cut if with_space else cut + 1])), np.sort(np.concatenate([cut, last]))


def given_back() -> None:
    """Return freed memory to the system: workers are kept between stages, and what they hold is taken from the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array] = lambda batch: batch.column("text"), size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each part has at most ``size`` bytes of text, but at least one row.

    Batches of Spark are bounded by rows, and with long texts hold far more than a function should work on at once.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(text(batch)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo, before = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo, before = hi, int(ends[hi - 1])
            given_back()
    given_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data, offsets


def windows(data: np.ndarray, offsets: np.ndarray, words: bool = True, skip: int = 0, size: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, document after the last, bytes, offsets in them); a long document comes in several windows of its own.

    Later windows of a long document begin ``skip`` bytes after the white space where it was cut.
    """
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= size:
            yield lo, hi, data[a:b], offsets[lo : hi + 1] - a
        else:
            while a < b:
                end, width = b, size
                while a + width < b:
                    piece = data[a : a + width]
                    at = np.flatnonzero(_SPACE[piece]) if words else _cuts(piece)
                    if len(at) and at[-1]:
                        end = a + int(at[-1])
                        break
                    width *= 2
                yield lo, lo + 1, data[a:end], np.array([0, end - a], np.int64)
                a = end + skip if end < b else b
        lo = hi


class SpanMemo:
    """What spans encode to, or only to how many ids. Open addressing in arrays of fixed size; when it is over half full and misses are many it starts anew."""

    PROBES = 4

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], slots: int = 1 << 20, longest: int = 64, with_ids: bool = True):
        self.with_ids = with_ids
        self.encode, self.slots, self.longest = encode, slots, longest
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.first = np.zeros(self.slots, np.int64)
        self.count = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.entries = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.slots - 1)
        at = (h & mask).astype(np.int64)
        found = np.where(self.keys[at] == h, at, -1)
        for probe in range(1, self.PROBES):
            left = np.flatnonzero(found < 0)
            if not len(left):
                break
            at = ((h[left] + np.uint64(probe)) & mask).astype(np.int64)
            hit = self.keys[at] == h[left]
            found[left[hit]] = at[hit]
        return found

    def _add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        first = np.cumsum(counts) - counts
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        first, mask = first + self.used, np.uint64(self.slots - 1)
        self.used += len(ids)
        left = np.arange(len(h))
        for probe in range(self.PROBES):
            at = ((h[left] + np.uint64(probe)) & mask).astype(np.int64)
            free = np.flatnonzero(self.keys[at] == 0)
            _, winners = np.unique(at[free], return_index=True)
            won = free[winners]
            self.keys[at[won]], self.first[at[won]], self.count[at[won]] = h[left[won]], first[left[won]], counts[left[won]]
            self.entries += len(won)
            left = np.delete(left, won)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of each span's ids."""
        h = span_hashes(data, starts, ends)
        h[h == 0] = 1
        found = self._find(h)
        lost = np.flatnonzero(found < 0)
        counts = self.count[found]
        if len(lost):
            fresh, where, back = np.unique(h[lost], return_index=True, return_inverse=True)
            spans = lost[where]
            raw = data.tobytes()
            new_ids, new_counts = self.encode([raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist())])
            new_counts = np.asarray(new_counts, np.int32)
            counts[lost] = new_counts[back]
        total = int(counts.sum())
        before = np.cumsum(counts, dtype=np.int64) - counts
        out = np.empty(0, np.uint32)
        if self.with_ids and total:
            source = self.first[found]
            if len(lost):
                new_first = np.cumsum(new_counts, dtype=np.int64) - new_counts
                source[lost] = new_first[back]
                hit = np.ones(len(h), bool)
                hit[lost] = False
                at = np.repeat(source - before, counts) + np.arange(total)
                from_pool = np.repeat(hit, counts)
                out = np.empty(total, np.uint32)
                out[from_pool] = self.pool[at[from_pool]]
                out[~from_pool] = new_ids[at[~from_pool]]
            else:
                out = self.pool[np.repeat(source - before, counts) + np.arange(total)]
        if len(lost):
            if self.entries > self.slots // 2 and len(lost) * 5 > len(h):
                self._clear()
            if self.entries <= self.slots // 2:
                short = (ends - starts)[spans] <= self.longest
                if short.all():
                    self._add(fresh, np.asarray(new_ids, np.uint32), new_counts)
                elif short.any():
                    keep = np.repeat(short, new_counts) if len(new_ids) else np.empty(0, bool)
                    self._add(fresh[short], np.asarray(new_ids, np.uint32)[keep], new_counts[short])
        return out, counts


def by_document(counts: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the spans' counts in each document of a window."""
    sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    at = np.searchsorted(starts, offsets)
    return sums[at[1:]] - sums[at[:-1]]
