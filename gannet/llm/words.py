"""Words of UTF-8 texts, found and hashed with numpy over Arrow's own buffers.

A word is a longest run of bytes that aren't separators. Separators are ASCII, so they never
fall inside a multi-byte character. A word's hash is the sum of a mixed value for each byte and
its place in the word, then mixed; it doesn't depend on where the word stands.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None
#: What operators keep in a worker from task to task, by name, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, drop: Callable[[], None]) -> None:
    """Notes that something stays in this worker until batches are read for another purpose."""
    _kept[name] = drop


def give_back() -> None:
    """Returns memory that a worker doesn't use now; it lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


STEP = 1 << 17
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def _separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SPACE = _separators(b"\t\n\x0b\x0c\r ")
#: Also ASCII punctuation, for scorers that read "word," as "word".
SPACE_PUNCT = SPACE | _separators(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
NEWLINE = _separators(b"\n")

EXACT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: A-Z hash as a-z do.
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_spots = np.zeros(0, dtype=np.uint64)


def spots(n: int) -> np.ndarray:
    """A random 64-bit value for each place in a word."""
    global _spots
    if len(_spots) < n:
        _spots = mix(np.arange(1, max(n, STEP + (1 << 16)) + 1))
    return _spots


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


@dataclass
class Words:
    start: np.ndarray  #: byte at which each word starts
    end: np.ndarray
    hash: np.ndarray  #: uint64
    first: np.ndarray  #: the index of each document's first word, and the number of words at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def _pieces(buf: np.ndarray, off: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about STEP bytes that end at a document's end or behind a separator."""
    at, last = int(off[0]), int(off[-1])
    while at < last:
        end = min(at + STEP, last)
        if end < last:
            limit = int(off[np.searchsorted(off, end)])
            while end < limit:
                hit = np.flatnonzero(sep[buf[end : min(end + 4096, limit)]])
                if len(hit):
                    end += int(hit[0]) + 1
                    break
                end = min(end + 4096, limit)
        yield at, end
        at = end


def split(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, values: np.ndarray = EXACT) -> Words:
    starts, ends, hashes = [], [], []
    for at, to in _pieces(buf, off, sep):
        seg = buf[at:to]
        word = ~sep[seg]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edge = off[np.searchsorted(off, at) : np.searchsorted(off, to)] - at
        opens[edge] = word[edge]
        edge = edge[edge > 0] - 1
        closes[edge] = word[edge]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        place = np.arange(len(seg), dtype=np.int32)
        place -= np.maximum.accumulate(np.where(opens, place, np.int32(0)))
        each = values[seg]
        each += spots(len(seg))[place]
        each ^= each >> np.uint64(29)
        each *= np.uint64(0xBF58476D1CE4E5B9)
        each ^= each >> np.uint64(32)
        total = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(each, dtype=np.uint64, out=total[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix(total[e] - total[s] + (e - s).astype(np.uint64)))
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, off))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place at which n words of one document start: the place, and the n words' hash."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.ones(m, dtype=bool)
    for k in range(1, n):
        edge = words.first[1:-1] - k
        ok[edge[(edge >= 0) & (edge < m)]] = False
    h = words.hash[:m].copy()
    for k in range(1, n):
        h *= np.uint64(_P)
        h += words.hash[k : k + m]
    at = np.flatnonzero(ok)
    return at, mix(h[at])


def batches(source: Iterator[pa.RecordBatch], column: str, size: int = 1 << 19, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about `size` bytes of text, or one row. What others than `keeps` have left in this worker is dropped first."""
    for name in [x for x in _kept if x != keeps]:
        _kept.pop(name)()
    for batch in source:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(length), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()
