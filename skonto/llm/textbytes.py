"""Words and word shingles of whole columns of texts, as numpy arrays over the Arrow buffers.

All functions work on a run of texts that lie one after another in one byte buffer, so a task handles
thousands of texts with a few array operations. Every byte of a character beyond ASCII is a word byte,
therefore words can be cut on bytes and are those of the pattern
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on text whose A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed one by one, the others by powers of their place.
LONG_WORD = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POWER:
        _POWER["up"], _POWER["down"] = _powers(BASE, SEGMENT + 1), _powers(INVERSE, SEGMENT + 1)
    return _POWER["up"], _POWER["down"]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (one more entry than texts); null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, row after the last, bytes, offsets."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a run of texts: ``low`` holds the lower-cased bytes, ``rows`` where each text's words begin."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def text(self, first: int, last: int) -> str:
        """Words ``first`` to ``last - 1`` of the run, joined by blanks."""
        raw = self.low.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return b" ".join(raw[a:b] for a, b in zip(self.starts[first:last], self.ends[first:last])).decode("utf-8", "replace")


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Cut a run of texts into words."""
    low = LOWER[data]
    mask = WORD_BYTE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return Words(low, starts, ends, np.searchsorted(starts, offsets))


def word_runs(column: pa.Array, size: int = CHUNK_BYTES, overlap: int = 0) -> Iterator[tuple[int, int, Words, int, int]]:
    """Words of runs of texts: first row, row after the last, words, the run's part, and how many words the part before has had.

    A run holds whole texts and is part 0. A text of more than twice ``size`` bytes is a series of parts, from 1 on, that are
    cut between words, so memory doesn't grow with the text; each begins with the last ``overlap`` words of the one before.
    """
    for lo, hi, data, offsets in chunks(column, size):
        if len(data) <= 2 * size:
            yield lo, hi, words(data, offsets), 0, 0
            continue
        for r in range(lo, hi):  # one long text, beside empty ones only
            text = data[offsets[r - lo] : offsets[r - lo + 1]]
            begin = end = again = 0
            part = 1
            while True:
                end = min(len(text), end + size)
                while end < len(text) and WORD_BYTE[LOWER[text[end]]]:
                    gaps = np.flatnonzero(~WORD_BYTE[LOWER[text[end : end + 4096]]])
                    end = min(len(text), end + (int(gaps[0]) if len(gaps) else 4096))
                w = words(text[begin:end], np.array([0, end - begin]))
                yield r, r + 1, w, part, again
                if end >= len(text):
                    break
                again = min(overlap, len(w.starts))
                begin, part = begin + int(w.starts[-again]) if again else end, part + 1


def distinct(w: Words) -> pa.DictionaryArray:
    """The words of a run as indices into its different words, which are bytes."""
    offsets = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
    raw = np.ascontiguousarray(w.low[WORD_BYTE[w.low]])
    return pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, the same for equal words everywhere."""
    up, down = _tables()
    n = len(w.starts)
    out = np.zeros(n, np.uint64)
    i = 0
    while i < n:
        base = w.starts[i]
        j = max(i + 1, int(np.searchsorted(w.ends, base + SEGMENT, side="right")))
        if w.ends[j - 1] - base <= SEGMENT:
            part = w.low[base : w.ends[j - 1]].astype(np.uint64) + np.uint64(1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            a, b = w.starts[i:j] - base, w.ends[i:j] - base
            out[i:j] = (total[b] - total[a]) * down[a]
        i = j
    size = (w.ends - w.starts).astype(np.uint64)
    out = mix(out + size * STEP)
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(w.low[w.starts[k] : w.ends[k]].tobytes())
    return out


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size`` words from each word on, and which of them lie within one text."""
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(min(size, n)):
        total[: n - k] += hashes[k:] * np.uint64(factor)
        factor = factor * int(STEP) % (1 << 64)
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)
    return mix(total + np.uint64(size)), left >= size


def text_shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text in turn and where each text's begin; a text of fewer words has one of all its words."""
    all_hashes, inside = shingle_hashes(hashes, rows, size)
    count = np.diff(rows)
    for n in range(1, size):
        if len(short := np.flatnonzero(count == n)):
            at = rows[short]
            own, _ = shingle_hashes(hashes[(at[:, None] + np.arange(n)).ravel()], np.arange(len(short) + 1) * n, n)
            all_hashes[at], inside[at] = own[::n], True
    kept = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    return all_hashes[inside], np.concatenate([[0], np.cumsum(kept)])
