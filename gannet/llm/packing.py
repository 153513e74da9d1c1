"""Packing token sequences by minimum bin slack.

A document's ids are cut into whole windows; what remains is shorter than a window. From a pool
of remainders, each window takes the multiset of remaining lengths whose sum comes closest to
the capacity: subset sums are kept as the bits of one integer, one shift and OR for each power
of two of a length's count, and the counts are read off backwards from the best sum. A window
whose best sum leaves slack is filled up with a piece cut from the shortest remainder left that
covers it. What the last pool can't fill is cut into sequences as long as powers of two, which
need no padding.
"""

from __future__ import annotations

import base64
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, EOS, POOL = 2048, 1, 8192
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Sequence ids of one partition start at its number shifted by so many bits.
_SHIFT = 33


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum is the largest up to capacity.

    counts: pieces there are of each length, 1 to capacity. The longest piece is always taken.
    """
    lengths = sorted((x for x, n in counts.items() if n > 0), reverse=True)
    if not lengths:
        return {}
    largest = lengths[0]
    room = capacity - largest
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length] - (length == largest), room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {largest: 1}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            out[length] = out.get(length, 0) + take
    return out


class Packer:
    """Packs one partition's documents; ids are arrays of little-endian uint32."""

    def __init__(self, window: int = WINDOW, pool: int = POOL, first_sequence: int = 0):
        self.window, self.limit, self.next = window, pool, first_sequence
        self.pool: dict[int, list] = defaultdict(list)
        self.size, self.out = 0, []

    def _emit(self, pieces: list) -> None:
        """pieces: (doc_id, start, ids, doc_tokens), one sequence."""
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), total, self.next, at, ids.tobytes()))
            at += len(ids)
        self.next += 1

    def _put(self, piece) -> None:
        if n := len(piece[2]):
            self.pool[n].append(piece)
            self.size += 1

    def _take(self, length: int):
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.size -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self._emit([(doc, at, ids[at : at + self.window], len(ids))])
        self._put((doc, whole, ids[whole:], len(ids)))
        if self.size >= self.limit:
            self.drain(self.limit // 4)

    def drain(self, keep: int = 0) -> None:
        """Fills windows until at most `keep` remainders are left or none can fill a window."""
        while self.size > keep:
            counts = {n: len(x) for n, x in self.pool.items()}
            chosen = best_fill(counts, self.window)
            slack = self.window - sum(n * k for n, k in chosen.items())
            if not slack:
                for _ in range(min(counts[n] // k for n, k in chosen.items())):
                    self._emit([self._take(n) for n, k in chosen.items() for _ in range(k)])
                continue
            pieces = [self._take(n) for n, k in chosen.items() for _ in range(k)]
            longer = min((n for n in self.pool if n > slack), default=0)
            if not longer:
                for piece in pieces:
                    self._put(piece)
                break
            doc, start, ids, total = self._take(longer)
            self._emit([*pieces, (doc, start, ids[:slack], total)])
            self._put((doc, start + slack, ids[slack:], total))

    def finish(self) -> None:
        self.drain()
        rest = [self._take(n) for n in sorted(self.pool, reverse=True) for _ in range(len(self.pool[n]))]
        left = sum(len(x[2]) for x in rest)
        while left:
            goal = 1 << min(left.bit_length() - 1, self.window.bit_length() - 1)
            left -= goal
            pieces = []
            while goal:
                doc, start, ids, total = rest.pop(0)
                pieces.append((doc, start, ids[:goal], total))
                if len(ids) > goal:
                    rest.insert(0, (doc, start + goal, ids[goal:], total))
                goal -= len(pieces[-1][2])
            self._emit(pieces)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.out:
            return
        cols, self.out = list(zip(*self.out, strict=True)), []
        kinds = [pa.int64()] * 6 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


class _Memory(dict):
    """Ids, as bytes, of stretches met before. Two generations of at most about `most` bytes each are kept, long stretches never."""

    LONG, ENTRY = 256, 200  # characters of a stretch that is kept at most; bytes an entry takes besides its contents

    def __init__(self, learn, most: int):
        super().__init__()
        self.learn, self.most, self.old, self.held = learn, most, {}, 0

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.learn(key)
        if len(key) > self.LONG:
            return ids
        if self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += self.ENTRY + len(key) + len(ids)
        self[key] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    Its pre-tokenizer always cuts before a space that a non-space follows, so stretches between
    such cuts can be encoded alone. With ranks_path, the same vocabulary as ranks, parts of ASCII
    and Latin letters without a special token go to a faster library of the same ids at once. Of
    any other part, stretches met before are looked up; new ones go to the faster library if they
    may, else to the tokenizer itself.
    """

    PART = 1 << 14  # characters of a part, which ends at the next cut behind them

    _CUT = re.compile(r" (?=\S)")
    _ODD = re.compile(r" (?:\s|\Z)")
    _FAST = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")

    def __init__(self, path: str, ranks_path: str | None = None, most: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.fast = self._ranked(ranks_path) if ranks_path else None
        self.heads = _Memory(self._learn, most // 8)
        self.tails = _Memory(lambda x: self._learn(" " + x), most)

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _may(self, x: str) -> bool:
        return bool(self.fast and self._FAST.fullmatch(x)) and not any(s in x for s in self.special)

    def _learn(self, x: str) -> bytes:
        ids = self.fast(x) if self._may(x) else self.model.encode(x, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.PART and (found := self._CUT.search(text, at + self.PART)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def encode(self, text: str, end: int) -> np.ndarray:
        """The ids of a text, and `end` behind them."""
        ids = []
        for part in self._parts(text):
            if self._may(part):
                ids.append(np.array(self.fast(part), dtype="<u4").tobytes())
                continue
            words = self._CUT.split(part) if self._ODD.search(part) else part.split(" ")
            ids += [self.heads[words[0]], *map(self.tails.__getitem__, words[1:])]
        return np.frombuffer(b"".join([*ids, end.to_bytes(4, "little")]), dtype="<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(*paths: str | None) -> Encoder:
    """One for each worker and files: what it remembers serves the worker's later tasks too."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, eos: int = EOS, pool: int = POOL) -> DataFrame:
    """One row for each piece of a document: SCHEMA, ids as little-endian unsigned 32-bit.

    Each document gets `eos` behind its ids. Null texts count as empty, so they are that one id.
    Repeated rows and null ids are documents like any other; columns other than these two are
    left out, so their names can't clash. Very long texts are encoded whole: a worker holds one
    text's ids at once, and what it remembers of stretches is bounded in bytes. Each input partition is packed alone, without a
    shuffle: sequence ids hold the partition's number, at most `pool` remainders are held at
    once, and at most log2(window) + 1 sequences a partition are shorter than the window.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from gannet.llm.words import batches, keep

        packer = Packer(window, pool, TaskContext.get().partitionId() << _SHIFT)
        coder = encoder(tokenizer_path, ranks_path)
        keep("encoders", _encoders.clear)
        for batch in batches(source, "text", 1 << 20, "encoders"):
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, coder.encode(x or "", eos))
            yield from packer.rows()
        packer.finish()
        yield from packer.rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
