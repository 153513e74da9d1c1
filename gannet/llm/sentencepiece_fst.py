"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled to machines kept as integer tables.

- The normaliser first reads the model's character map, a trie whose longest match is rewritten.
  Then it has three states (start of a text, behind a blank, behind any other character)
  and writes the dummy prefix and the marks that stand for blanks.
- The piece machine is the trie of all pieces: an arc for each state and character, and on states
  where a piece ends an arc back to the start that writes the piece and weighs its negated score.
  Byte fallback is an arc for each character that no piece holds: it writes the bytes' ids.
- For merge models (BPE) the pair machine's state is the piece before. Its arc for a piece weighs
  0 where merging the characters of both leaves just these two, and infinity elsewhere. Its
  arcs are made when a text first asks for them.

Texts are composed with these on the fly: the matches of the piece machine are the arcs of a
lattice over a text's places, and the path of least weight in the tropical semiring is its
encoding. In a merge model every path of finite weight is what merging gives, and there is one;
in a unigram model all pairs weigh 0. No arc spans two neighbours that no piece holds side by
side, so the lattice falls apart into stretches there; a batch's distinct stretches are relaxed
together, place by place. Decoding runs the piece machine backwards: an id's bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gannet.llm.common import with_row
from gannet.llm.words import batches, keep, mix

MARK = 0x2581
_UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 2, 3, 4, 5, 6  # fixed values: kinds of pieces in a model file
#: Longer stretches are relaxed alone, so that the others of a batch need no more steps than this.
LONG = 64
#: Arcs the pair machine has room for (9 bytes each); when half are made, all are forgotten.
PAIRS = 1 << 20
#: Room for stretches whose ids are held from batch to batch (12 bytes, 8 more for each of up to half as many, and their ids); beyond half, all are forgotten.
STRETCHES = 1 << 20
_NEAR = 0x250  # characters below it have a dense table of neighbours


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + n]
        at += n


class Table:
    """Numbers by non-negative keys: open addressing in arrays, all keys looked up at once."""

    def __init__(self, room: int, kind: type = np.int32):
        self.mask = (1 << max(int(room - 1).bit_length(), 4)) - 1
        self.keys, self.values, self.size = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, kind), 0

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        out = Table(max(4 * len(keys), 16), values.dtype.type)
        out.add(keys, values)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).view(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it has none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], self.values.dtype.type(-1))
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot = (slot[todo] if len(slot) != len(todo) else slot) + 1 & self.mask
            wanted, there = keys[todo], self.keys[slot]
            hit = there == wanted
            out[todo[hit]] = self.values[slot[hit]]
            left = ~hit & (there >= 0)
            todo, slot = todo[left], slot[left]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        slot = self._slot(keys)
        self.size += len(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], slot[~won] + 1 & self.mask

    def clear(self) -> None:
        self.keys[:], self.size = -1, 0


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 0, 3: the owners 0 0 2 2 2, and their numbers 0 1 0 1 2."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<i4").copy()


class Rules:
    """A character map as a trie: at each place the longest source is read and its target written, else one character is copied."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little")
        units, targets = np.frombuffer(blob, "<u4", n // 4, 4).astype(np.int64), blob[4 + n :]
        offset = (units >> 10) << ((units & (1 << 9)) >> 6)
        found, paths, at = {}, [b""], np.zeros(1, dtype=np.int64)
        label = np.arange(256)
        while len(at):  # all places of one depth at once; label 0 leads to a value
            child = (at[:, None] ^ offset[at][:, None]) ^ label[None, :]
            there = (child < len(units)) & ((units[np.minimum(child, len(units) - 1)] & 0x800000FF) == label) & (label > 0)
            who, byte = np.nonzero(there)
            at, paths = child[who, byte], [paths[k] + bytes([b]) for k, b in zip(who.tolist(), byte.tolist(), strict=True)]
            for k in np.flatnonzero(units[at] >> 8 & 1).tolist():
                value = int(units[at[k] ^ offset[at[k]]] & 0x7FFFFFFF)
                found[paths[k].decode()] = targets[value : targets.index(b"\0", value)].decode()
        state, arcs, rule = {"": 0}, {}, {}
        for source, target in found.items():
            for k in range(len(source)):
                state.setdefault(source[: k + 1], len(state))
                arcs[state[source[:k]] << 21 | ord(source[k])] = state[source[: k + 1]]
            rule[state[source]] = len(rule)
        self.arcs = Table.of(np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int32))
        self.rule = np.full(len(state), -1, dtype=np.int64)
        self.rule[list(rule)] = list(rule.values())
        self.out = codes("".join(found.values()))
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])]).astype(np.int64)

    def apply(self, c: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is written for texts of these sizes, one after the other, and its sizes."""
        stop = np.repeat(np.cumsum(size), size)
        start, state, n = np.arange(len(c)), np.zeros(len(c), dtype=np.int64), 0
        length, rule = np.zeros(len(c), dtype=np.int64), np.full(len(c), -1)
        while len(start):
            go = self.arcs.get(state << 21 | c[start + n])
            start, state, n = start[go >= 0], go[go >= 0].astype(np.int64), n + 1
            hit = self.rule[state] >= 0
            length[start[hit]], rule[start[hit]] = n, self.rule[state[hit]]
            more = start + n < stop[start]
            start, state = start[more], state[more]
        taken, end = [], 0
        matched = np.flatnonzero(rule >= 0)
        for at, upto in zip(matched.tolist(), (matched + length[matched]).tolist(), strict=True):
            if at >= end:
                taken.append(at)
                end = upto
        taken = np.array(taken, dtype=np.int64)
        wide = np.ones(len(c), dtype=np.int64)
        of, nth = _spread(length[taken])
        wide[taken[of] + nth] = 0
        wide[taken] = np.diff(self.ends)[rule[taken]]
        out, ends = np.repeat(c, wide), np.concatenate([[0], np.cumsum(wide)])
        of, nth = _spread(wide[taken])
        out[ends[taken[of]] + nth] = self.out[self.ends[rule[taken[of]]] + nth]
        bounds = ends[np.concatenate([[0], np.cumsum(size)])]
        return out, np.diff(bounds)


class Transducer:
    """A compiled model. Symbols are piece ids, then characters that only stand inside pieces, then one for all others."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
        normaliser = dict(_fields(next((v for k, v in message if k == 3), b"")))
        if not normaliser.get(5, 1):
            raise ValueError("models without marks for blanks aren't supported")
        self.merging = trainer.get(3, 1) == 2
        if not self.merging and trainer.get(3, 1) != 1:
            raise ValueError("only unigram and merge models are supported")
        self.prefix, squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        # by state (start, behind a blank, behind another) and whether a blank is read: marks written first, and whether what is read is
        self.marks = np.array([[0 if squeeze else int(self.prefix), int(self.prefix)], [0, int(squeeze)], [0, 0]])
        self.copies = np.array([[not squeeze, True]] * 3)
        self.rules = Rules(normaliser[2]) if normaliser.get(2) else None

        pieces: dict[str, tuple[int, float]] = {}
        byte = np.full(256, -1, dtype=np.int64)
        out: list[bytes] = []
        self.unknown = 0
        for i, data in enumerate(v for k, v in message if k == 1):
            x = dict(_fields(data))
            piece, kind = x.get(1, b"").decode(), x.get(3, 1)
            out.append(b"" if kind == _CONTROL else piece.replace(chr(MARK), " ").encode())
            if kind == _BYTE:
                byte[int(piece[3:5], 16)] = i
                out[-1] = bytes([int(piece[3:5], 16)])
            elif kind == _UNKNOWN:
                self.unknown, out[-1] = i, trainer.get(44, " ⁇ ".encode())
            elif kind == _USER:
                raise ValueError("user-defined pieces aren't supported")
            elif kind not in (_CONTROL, _UNUSED):
                pieces[piece] = i, struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0]
        self.byte = byte if (byte >= 0).all() else None
        self.out, self.out_ends = np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self._compile(pieces, len(out))
        self.stretches, self.coded, self.coded_ends = Table(STRETCHES), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.spots = mix(np.arange(1, 4097))

    def _compile(self, pieces: dict[str, tuple[int, float]], n: int) -> None:
        symbol = {p: i for p, (i, _) in pieces.items()}
        inside = sorted({c for p in pieces for c in p} - pieces.keys())
        symbol |= {c: n + k for k, c in enumerate(inside)}
        self.other = n + len(inside)
        state, arcs, ends = {"": 0}, {}, []
        for p, (i, score) in pieces.items():
            for k in range(len(p)):
                if p[: k + 1] not in state:
                    state[p[: k + 1]] = len(state)
                arcs[state[p[:k]] << 21 | ord(p[k])] = state[p[: k + 1]]
            ends.append((state[p], i, score))
        table = lambda d: Table.of(np.array(list(d), np.int64), np.array(list(d.values()), np.int32))
        self.arcs = table(arcs)
        self.piece, self.weight = np.full(len(state), -1, np.int32), np.zeros(len(state), np.float32)
        at, ids, scores = map(np.array, zip(*ends, strict=True))
        self.piece[at] = ids
        self.score = np.full(self.other + 1, -np.inf, np.float32)
        self.score[ids] = scores
        if not self.merging:
            self.weight[at] = -scores
        self.fallback = np.float32(0 if self.merging else 10 - scores.min())
        self.single = table({ord(c): s for c, s in symbol.items() if len(c) == 1})
        self.longest = max(map(len, pieces))
        beside = {ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.beside = table(dict.fromkeys(beside, 1))
        self.near = np.zeros((_NEAR + 2, _NEAR + 2), dtype=np.int8)
        for key in beside:
            a, b = key >> 21, key & (1 << 21) - 1
            if (a < _NEAR or a == MARK) and (b < _NEAR or b == MARK):
                self.near[min(a, _NEAR), min(b, _NEAR)] = 1
        self.near[_NEAR + 1, :] = self.near[:, _NEAR + 1] = -1
        if self.merging:
            joins = {symbol[p[:k]] << 32 | symbol[p[k:]]: i for p, (i, _) in pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
            self.joins = table(joins)
            spelt = {s: [symbol[c] for c in p] for p, s in symbol.items()}
            self.spelling = np.full((self.other + 1, self.longest), -1, np.int32)
            for s, own in spelt.items():
                self.spelling[s, : len(own)] = own
            self.spelling[self.other, 0] = self.other
            self.pairs = Table(PAIRS, np.int8)

    def normalise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters that the normaliser writes for all texts, and where each text's end, 0 first."""
        c = codes("".join(texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        if self.rules:
            c, size = self.rules.apply(c, size)
        begin = np.cumsum(size) - size
        blank = c == 32
        state = np.full(len(c), 2, dtype=np.int8)
        state[1:][blank[:-1]] = 1
        if self.copies[0, 0]:
            state[begin[size > 0]] = 0
        else:  # a text's start lasts until something is written
            first = np.minimum.accumulate(np.where(blank, len(c), np.arange(len(c)))[::-1])[::-1]  # the next that isn't blank
            of, nth = _spread(size)
            state[begin[of] + nth <= first[begin[of]]] = 0
        arc = 2 * state + ~blank
        wide = (self.marks + self.copies).astype(np.int8).ravel()[arc]
        c[blank] = MARK
        out = np.repeat(c, wide)
        ends = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
        marked = np.flatnonzero(self.marks.astype(bool).ravel()[arc])
        out[ends[marked]] = MARK
        return out, ends[np.concatenate([[0], np.cumsum(size)])]

    def _cuts(self, c: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where stretches begin: at a text's start, and between two characters that no piece holds side by side."""
        kind = np.minimum(c, _NEAR + 1)
        kind[c == _NEAR] = _NEAR + 1
        kind[c == MARK] = _NEAR
        held = self.near.ravel()[kind[:-1] * (_NEAR + 2) + kind[1:]]
        rare = np.flatnonzero(held < 0)
        held[rare] = self.beside.get(c[rare].astype(np.int64) << 21 | c[rare + 1]) > 0
        begins = np.ones(len(c), dtype=bool)
        begins[1:] = held == 0
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        return np.flatnonzero(begins)

    def _matches(self, c: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of the lattice: place they leave, characters they span, symbol, weight. Places count from a stretch's begin in c."""
        of, nth = _spread(size)
        start, stop = begin[of] + nth, (begin + size)[of]
        state = np.zeros(len(start), dtype=np.int64)
        found = []
        alone = self.single.get(c[start].astype(np.int64))
        lost = np.flatnonzero((alone < 0) | (alone >= len(self.out_ends) - 1))
        found.append((start[lost], np.ones(len(lost), np.int64), np.where(alone[lost] < 0, self.other, alone[lost]), np.full(len(lost), self.fallback)))
        at = start
        for n in range(1, self.longest + 1):
            go = self.arcs.get(state << 21 | c[at])
            on = go >= 0
            start, stop, state = start[on], stop[on], go[on].astype(np.int64)
            hit = self.piece[state] >= 0
            found.append((start[hit], np.full(hit.sum(), n), self.piece[state[hit]], self.weight[state[hit]]))
            more = start + n < stop
            start, stop, state = start[more], stop[more], state[more]
            at = start + n
            if not len(start):
                break
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _free(self, key: np.ndarray) -> np.ndarray:
        """Whether the pair machine's arcs weigh 0; makes those that aren't there yet. key: symbol before << 32 | symbol."""
        known = self.pairs.get(key)
        new = np.unique(key[known < 0])
        if len(new):
            free = self._merge(new >> 32, new & 0xFFFFFFFF)
            if self.pairs.size + len(new) > PAIRS // 2:
                self.pairs.clear()
            known[known < 0] = free[np.searchsorted(new, key[known < 0])]
            if len(new) <= PAIRS // 2:
                self.pairs.add(new, free.astype(np.int8))
        return known > 0

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b, the best score first and the leftmost of equals, ends with a, b."""
        out = np.zeros(len(a), dtype=bool)
        for low in range(0, len(a), 1 << 14):
            part = slice(low, low + (1 << 14))
            out[part] = self._merge_some(a[part], b[part])
        return out

    def _merge_some(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        row, edge = np.arange(len(a)), (self.spelling[a] >= 0).sum(axis=1)
        size = edge + (self.spelling[b] >= 0).sum(axis=1)
        s = np.full((len(a), int(size.max()) + 1), -1, dtype=np.int64)
        of, nth = _spread(size)
        s[of, nth] = np.where(nth < edge[of], self.spelling[a[of], np.minimum(nth, self.longest - 1)], self.spelling[b[of], np.maximum(nth - edge[of], 0)])
        join = np.full((len(a), s.shape[1] - 1), -1, dtype=np.int64)
        of, nth = _spread(size - 1)
        join[of, nth] = self.joins.get(s[of, nth] << 32 | s[of, nth + 1])
        out = np.zeros(len(a), dtype=bool)
        while True:
            score = np.where(join >= 0, self.score[join], -np.inf)
            best = score.argmax(axis=1)
            any_left = score[np.arange(len(best)), best] > -np.inf
            done = ~any_left
            out[row[done]] = (s[done, 0] == a[row[done]]) & (s[done, 1] == b[row[done]]) & (s[done, 2] < 0 if s.shape[1] > 2 else True)
            go = any_left & (best != edge - 1)  # a merge across the edge: the two don't stay side by side
            if not go.any():
                return out
            row, edge, s, join, best = row[go], edge[go], s[go], join[go], best[go]
            k = np.arange(len(row))
            s[k, best] = join[k, best]
            edge = edge - (best < edge)
            take = np.arange(s.shape[1])[None, :] + (np.arange(s.shape[1])[None, :] > best[:, None])
            s = np.where(take < s.shape[1], np.take_along_axis(s, np.minimum(take, s.shape[1] - 1), axis=1), -1)
            take = np.arange(join.shape[1])[None, :] + (np.arange(join.shape[1])[None, :] > best[:, None])
            join = np.where(take < join.shape[1], np.take_along_axis(join, np.minimum(take, join.shape[1] - 1), axis=1), -1)
            for at in (best - 1, best):
                here = np.flatnonzero((at >= 0) & (at < join.shape[1]))
                x, y = s[here, at[here]], s[here, np.minimum(at[here] + 1, s.shape[1] - 1)]
                join[here, at[here]] = np.where(y >= 0, self.joins.get(x << 32 | np.maximum(y, 0)), -1)

    def _shortest(self, c: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols on the shortest paths of stretches one after the other, and how many each has."""
        node = np.cumsum(size + 1) - size - 1  # the first of each stretch's places in what follows
        owner, nth = _spread(size + 1)
        first = np.zeros(len(c) + 1, dtype=np.int64)  # a character's place
        inner = nth < size[owner]
        first[begin[owner[inner]] + nth[inner]] = np.flatnonzero(inner)
        start, span, symbol, weight = self._matches(c, begin, size)
        source = first[start]
        sink = source + span
        step = nth[sink]
        order = np.argsort((step * len(owner) + sink) * (LONG + 1) - span)
        source, sink, symbol, weight, step = source[order], sink[order], symbol[order].astype(np.int64), weight[order], step[order]
        cost = np.full(len(owner), np.inf, dtype=np.float32)
        cost[node] = 0
        last, back = np.full(len(owner), -1, np.int64), np.zeros(len(owner), np.int64)
        bounds = np.searchsorted(step, np.arange(1, int(size.max(initial=0)) + 2))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            s, t, x = source[low:high], sink[low:high], symbol[low:high]
            if self.merging:
                inside = np.flatnonzero((last[s] >= 0) & (x != self.other) & (last[s] != self.other))
                total = cost[s] + weight[low:high]
                if len(inside):
                    total[inside[~self._free(last[s[inside]] << 32 | x[inside])]] = np.inf
            else:
                total = cost[s] + weight[low:high]
            heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            least = np.minimum.reduceat(total, heads)
            best = np.flatnonzero(total == np.repeat(least, np.diff(np.append(heads, len(t)))))
            best = best[np.concatenate([[True], t[best[1:]] != t[best[:-1]]])]  # of equals the longest arc
            cost[t[best]], last[t[best]], back[t[best]] = total[best], x[best], s[best]
        on = np.zeros(len(owner), dtype=bool)
        at = (node + size)[size > 0]
        while len(at):
            on[at] = True
            at = back[at]
            at = at[last[at] >= 0]
        return last[on], np.bincount(owner[on], minlength=len(size))

    def _alone(self, c: np.ndarray, begin: int, size: int) -> np.ndarray:
        """The symbols on the shortest path of one long stretch: arcs and pairs are found at once, then relaxed one by one."""
        start, span, symbol, weight = self._matches(c, np.array([begin]), np.array([size]))
        source = start - begin
        sink = source + span
        order = np.lexsort((source, sink))
        source, sink, symbol, weight = source[order], sink[order], symbol[order].astype(np.int64), weight[order]
        head = np.searchsorted(sink, np.arange(size + 2))
        before = np.diff(head)[source]  # arcs that end where each leaves
        row = np.cumsum(before) - before
        if self.merging:
            free = np.ones(int(before.sum()), dtype=bool)
            for low in range(0, len(source), 1 << 16):
                of, nth = _spread(before[low : low + (1 << 16)])
                x, y = symbol[head[source[low + of]] + nth], symbol[low + of]
                inner = (x != self.other) & (y != self.other)
                free[row[low + of[inner]] + nth[inner]] = self._free(x[inner] << 32 | y[inner])
            free = free.tolist()
        cost, pick = [0.0] + [np.inf] * size, [-1] * (size + 1)
        columns = [x.tolist() for x in (source, sink, weight, row)]
        heads = head.tolist()
        for m, (s, t, w, r) in enumerate(zip(*columns, strict=True)):
            if s and self.merging and not free[r + pick[s] - heads[s]]:
                continue
            total = w if not s else float(np.float32(cost[s]) + np.float32(w)) if w else cost[s]
            if total < cost[t]:
                cost[t], pick[t] = total, m
        path, at = [], size
        while at:
            path.append(pick[at])
            at = columns[0][pick[at]]
        return symbol[path[::-1]]

    def _ids(self, c: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unknown ones as -1) of stretches one after the other, and how many each has."""
        short = size <= LONG
        symbols, n = self._shortest(c, begin[short], size[short])
        counts = np.zeros(len(size), dtype=np.int64)
        counts[short] = n
        longer = [self._alone(c, int(begin[k]), int(size[k])) for k in np.flatnonzero(~short)]
        counts[~short] = [len(x) for x in longer]
        out = np.zeros(counts.sum(), dtype=np.int64)
        in_short = np.repeat(short, counts)
        out[in_short] = symbols
        if longer:
            out[~in_short] = np.concatenate(longer)
        odd = out >= len(self.out_ends) - 1
        if not odd.any():
            return out, counts
        if self.byte is None:
            out[odd] = -1
            return out, counts
        # a character without a piece stands alone in its stretch's path: its place follows from the spans before it
        of, _ = _spread(counts)
        wide = np.where(odd, 1, self._spans()[np.where(odd, 0, out)])
        total = np.cumsum(wide) - wide
        place = begin[of] + total - total[(np.cumsum(counts) - counts)[of]]
        raw = np.frombuffer("".join(map(chr, c[place[odd]])).encode("utf-8", "surrogatepass"), np.uint8)
        lead = (raw & 0xC0) != 0x80
        times = np.ones(len(out), dtype=np.int64)
        times[odd] = np.diff(np.append(np.flatnonzero(lead), len(raw)))
        wider = np.repeat(out, times)
        wider[np.repeat(odd, times)] = self.byte[raw]
        return wider, np.bincount(of, weights=times, minlength=len(size)).astype(np.int64)

    def _spans(self) -> np.ndarray:
        """Characters of each piece."""
        if not hasattr(self, "spans"):
            lead = np.concatenate([[0], np.cumsum((self.out & 0xC0) != 0x80)])
            self.spans = np.diff(lead[self.out_ends])
        return self.spans

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as little-endian uint32, one after the other, and how many each has (null: none)."""
        c, ends = self.normalise([x or "" for x in texts])
        if not len(c):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        begin = self._cuts(c, ends)
        size = np.diff(np.append(begin, len(c)))
        which = self._known(c, begin, size)
        counts = self.coded_ends[which + 1] - self.coded_ends[which]
        of, nth = _spread(counts)
        out = self.coded[self.coded_ends[which[of]] + nth]
        text = np.searchsorted(ends, begin, side="right") - 1
        if self.byte is None:  # neighbours without a piece are one unknown
            text_of = text[of]
            again = np.concatenate([[False], (out[1:] < 0) & (out[:-1] < 0) & (text_of[1:] == text_of[:-1])])
            out, n = np.where(out < 0, self.unknown, out)[~again], np.bincount(text_of[~again], minlength=len(texts))
        else:
            n = np.bincount(text, weights=counts, minlength=len(texts)).astype(np.int64)
        return out.astype("<u4"), n

    def _known(self, c: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of stretches among those whose ids are held; encodes those that aren't yet."""
        place = np.arange(len(c)) - np.repeat(begin, size)
        each = c.astype(np.uint64)
        each *= np.uint64(0x9FB21C651E98DF25)
        each += self.spots[place] if size.max() <= len(self.spots) else mix(place + 1)
        each ^= each >> np.uint64(29)
        each *= np.uint64(0xBF58476D1CE4E5B9)
        each ^= each >> np.uint64(32)
        key = (mix(np.add.reduceat(each, begin)) >> np.uint64(1)).view(np.int64)
        if self.stretches.size > STRETCHES // 2 or len(self.coded) > 4 * STRETCHES:
            self.stretches.clear()
            self.coded, self.coded_ends = self.coded[:0], self.coded_ends[:1]
        which = self.stretches.get(key).astype(np.int64)
        lost = np.flatnonzero(which < 0)
        if len(lost):
            new, first, number = np.unique(key[lost], return_index=True, return_inverse=True)
            ids, counts = self._ids(c, begin[lost[first]], size[lost[first]])
            which[lost] = len(self.coded_ends) - 1 + number
            room = max(STRETCHES * 3 // 4 - self.stretches.size, 0)
            self.stretches.add(new[:room], np.arange(len(self.coded_ends) - 1, len(self.coded_ends) - 1 + len(new), dtype=np.int32)[:room])
            self.coded_ends = np.concatenate([self.coded_ends, self.coded_ends[-1] + np.cumsum(counts)])
            self.coded = np.concatenate([self.coded, ids.astype(np.int32)])
        return which

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids, one after the other, of which each text has so many. Bytes that aren't UTF-8 become replacement characters."""
        wide = np.diff(self.out_ends)[ids]
        of, nth = _spread(wide)
        raw = self.out[self.out_ends[ids[of]] + nth].tobytes()
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(counts)])]
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [x[1:] if self.prefix and x.startswith(" ") else x for x in texts]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker and file."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: doc_id) and ids (little-endian unsigned 32-bit, as binary), a row for each row.

    Null texts give null, empty ones no ids. Repeated rows and null ids are encoded like any
    other, very long texts whole. Columns that aren't carried are left out; carrying one named
    ids raises a ValueError. Nothing is shuffled; a worker holds some 1 MB of texts, or one text.
    """
    carry = ["doc_id"] if carry is None else carry
    if "ids" in carry:
        raise ValueError("column ids would be written over")
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(model_path)
        keep("transducers", _compiled.clear)
        for batch in batches(source, "text", 1 << 20, "transducers"):
            texts = batch.column(1).to_pylist()
            ids, n = coder.encode_all(texts)
            ends = np.concatenate([[0], np.cumsum(4 * n)])
            null = pa.array([x is not None for x in texts]).buffers()[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [null, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())]).cast(pa.binary())], ["row", "ids"])

    return rows.mapInArrow(run, with_row(rows, "ids binary")).select("row.*", "ids")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: doc_id) and text, a row for each row of encoded, whose column `ids` is as encode() makes it.

    Null ids give null. Columns that aren't carried are left out; carrying one named text raises
    a ValueError. Nothing is shuffled.
    """
    carry = ["doc_id"] if carry is None else carry
    if "text" in carry:
        raise ValueError("column text would be written over")
    rows = encoded.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(ids).alias("ids"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(model_path)
        keep("transducers", _compiled.clear)
        for batch in batches(source, "ids", 1 << 20, "transducers"):
            coded = [x or b"" for x in batch.column(1).to_pylist()]
            texts = coder.decode_all(np.frombuffer(b"".join(coded), "<u4").astype(np.int64), np.array([len(x) // 4 for x in coded]))
            null = batch.column(1).is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if n else x for n, x in zip(null, texts, strict=True)], pa.string())], ["row", "text"])

    return rows.mapInArrow(run, with_row(rows, "text string")).select("row.*", "text")
