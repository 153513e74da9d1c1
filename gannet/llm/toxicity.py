"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the bytes in a word, one of toxic and one of ordinary
texts, differ in their longer contexts and share the lower orders: continuation counts pooled
over both classes. So an expression that one class never had is rare there, not impossible,
and inflected or compound forms resemble what was learnt. A word's evidence is the difference
of its two log-likelihoods. A text's evidence is normalised by length: over the whole text, over
its worst window, and of its worst word. A logistic curve fitted on labelled rows that the
counts left out turns these into a score; its rows are weighted to the classes' shares among all
labelled rows, of which the counts may have taken fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gannet.llm import words as W
from gannet.llm.common import crc_of_id, with_row

#: At most so many labelled rows of each class are learnt from, the first by a hash of their id.
MAX_ROWS = 3000
#: Of these, one in CURVE_PART is left out of the counts and fits the curve.
CURVE_PART = 3
WINDOW = 12
DISCOUNT = 0.75
#: Orders in bytes, the byte itself included, at which each class counts for itself; lower ones are shared.
ORDERS = (6, 7, 8)
#: Evidence of a word above which it counts as an expression of its own.
STRONG = 2.0
FEATURES = 4
_BLANK = 0x20
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32


def _tokens(col: pa.Array) -> tuple[np.ndarray, W.Words]:
    """Bytes of the texts, and their words in lower case without punctuation."""
    buf, off = W.utf8(col)
    return buf, W.split(buf, off, sep=W.SPACE_PUNCT, values=W.LOWER)


def _padded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words side by side in lower case, blanks before and one behind; the places to predict, and each place's word."""
    pad = ORDERS[-1] - 1
    size = end - start + pad + 1
    head = np.concatenate([[0], np.cumsum(size)])
    out = np.full(head[-1], _BLANK, dtype=np.uint8)
    length = end - start
    word = np.repeat(np.arange(len(start)), length)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    out[head[word] + pad + inner] = _LOWER_BYTES[buf[start[word] + inner]]
    of = np.repeat(np.arange(len(start)), length + 1)
    step = np.arange(len(of)) - np.repeat(np.cumsum(length + 1) - (length + 1), length + 1)
    return out, head[of] + pad + step, of


def _grams(text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: hashes of the bytes that end at each place, and of these without the last."""
    last = W.EXACT[text[at]]
    context = np.zeros(len(at), dtype=np.uint64)
    scale = np.uint64(1)
    for k in range(1, ORDERS[-1] + 1):
        if k > 1:
            scale = np.uint64(int(scale) * W._P % (1 << 64))
            context = context + W.EXACT[text[at - k + 1]] * scale
        yield k, W.mix(context + last * np.uint64(W._P_INVERSE) + np.uint64(k)), W.mix(context + np.uint64(k))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted), dtype=values.dtype), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], values.dtype.type(0)), found


@dataclass
class Model:
    """Log-likelihood differences, toxic less ordinary; all keys are sorted hashes."""

    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  #: of a byte after a context, where either class had both
    escapes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  #: of what a context leaves to the lower order
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  #: evidence of the words learnt from
    curve: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def of_words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        text, at, of = _padded(buf, start, end)
        todo = np.arange(len(at))
        sums = np.zeros(len(at))
        hashes = {k: (g, c) for k, g, c in _grams(text, at) if k >= ORDERS[0]}
        for k in reversed(ORDERS):
            value, found = _look(*self.grams[k], hashes[k][0][todo])
            left, _ = _look(*self.escapes[k], hashes[k][1][todo])
            sums[todo] += np.where(found, value, left)
            todo = todo[~found]
        return np.bincount(of, weights=sums, minlength=len(start))

    def evidence(self, col: pa.Array) -> np.ndarray:
        """A row of features for each text; zeros for a text without words."""
        buf, words = _tokens(col)
        value, found = _look(self.words, self.known, words.hash)
        value = value.astype(float)
        new = np.flatnonzero(~found)
        if len(new):
            _, first, where = np.unique(words.hash[new], return_index=True, return_inverse=True)
            value[new] = self.of_words(buf, words.start[new[first]], words.end[new[first]])[where]
        n = words.counts()
        some, begin = n > 0, words.first[:-1]
        total = np.concatenate([[0.0], np.cumsum(value)])
        strong = np.concatenate([[0.0], np.cumsum(np.maximum(value - STRONG, 0))])
        ends = np.arange(1, len(total))
        window = (total[1:] - total[np.maximum(ends - WINDOW, np.repeat(begin, n))]) / WINDOW
        out = np.zeros((len(n), FEATURES))
        out[:, 0] = (total[words.first[1:]] - total[begin]) / np.maximum(n, 1)
        out[:, 1] = (strong[words.first[1:]] - strong[begin]) / np.maximum(n, 1)
        if some.any():
            out[some, 2] = np.maximum.reduceat(window, begin[some])
            out[some, 3] = np.maximum.reduceat(value, begin[some])
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        z = np.clip(self.evidence(col) @ self.curve[:-1] + self.curve[-1], -500, 500)
        return 1 / (1 + np.exp(-z))


def train(words: pa.Array, count: np.ndarray) -> Model:
    """Fits both models. words: distinct lower-case words; count: by class (1: toxic) and word."""
    buf, off = W.utf8(words)
    model = Model()
    if not len(words):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        model.grams = model.escapes = dict.fromkeys(ORDERS, none)
        return model
    text, at, of = _padded(buf, off[:-1], off[1:])
    top = ORDERS[-1]
    gram = next(g for k, g, _ in _grams(text, at) if k == top)
    gram, place, where = np.unique(gram, return_index=True, return_inverse=True)
    where, of = where.astype(np.int32), of.astype(np.int32)
    counts = {top: np.stack([np.bincount(where, weights=count[c][of], minlength=len(gram)) for c in (0, 1)])}
    at = at[place]  # a place of each distinct longest gram: the shorter ones end there too
    grams, number, suffix = {}, {}, {}
    before = None
    for k, g, c in _grams(text, at):
        grams[k], place, inverse = np.unique(g, return_index=True, return_inverse=True)
        contexts, number[k] = np.unique(c[place], return_inverse=True)
        number[k] = number[k].astype(np.int32)
        if k > 1:
            suffix[k] = before[place]  # the gram of one byte less in front
        if k in ORDERS:
            model.escapes[k] = contexts, None
        before = inverse.astype(np.int32)
    del before, inverse, place, g, c, contexts
    for k in range(top, 1, -1):  # continuation counts: in how many contexts, one byte longer, a gram stands
        counts[k - 1] = np.stack([np.bincount(suffix[k], weights=counts[k][c] > 0, minlength=len(grams[k - 1])) for c in (0, 1)])
    shared = None
    for k in range(1, ORDERS[0]):
        n, own = counts[k].sum(axis=0), number[k]
        below = np.full(len(n), 1 / 256) if shared is None else shared[suffix[k]]
        total, kinds = np.bincount(own, weights=n), np.bincount(own)
        shared = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds[own] * below) / total[own]
    lower = [shared, shared]
    for k in ORDERS:
        probability, escape = [], []
        for c in (0, 1):
            n, own = counts[k][c], number[k]
            total, kinds = np.bincount(own, weights=n), np.bincount(own, weights=n > 0)
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            probability.append(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[own] + left[own] * lower[c][suffix[k]])
            escape.append(left)
        lower = probability
        model.grams[k] = grams[k], np.log(probability[1] / probability[0]).astype(np.float32)
        model.escapes[k] = model.escapes[k][0], np.log(escape[1] / escape[0]).astype(np.float32)
    value = np.bincount(of, weights=model.grams[top][1][where], minlength=len(words))
    key = W.split(buf, off, sep=W.SPACE_PUNCT, values=W.LOWER).hash
    order = np.argsort(key)
    model.words, model.known = key[order], value[order].astype(np.float32)
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, of_row: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge, weights in x's own units. of_row: how much each row counts, 1 by default."""
    of_row = np.ones(len(y)) if of_row is None else of_row
    if not len(y) or y.min() == y.max():
        base = ((of_row * y).sum() + 0.5) / (of_row.sum() + 1)
        return np.array([0.0] * FEATURES + [np.log(base / (1 - base))])
    mid, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mid) / scale, np.ones(len(x))])
    w = np.zeros(FEATURES + 1)
    ridge = np.diag([1e-3] * FEATURES + [1e-6]) * of_row.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (of_row * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (of_row * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / scale
    return np.array([*slope, w[-1] - slope @ mid])


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.batches(source, "text"):
        buf, words = _tokens(batch.column(1))
        label = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), words.counts())
        _, first, n = np.unique(W.mix(words.hash + label.astype(np.uint64)), return_index=True, return_counts=True)
        text = [_LOWER_BYTES[buf[s:e]].tobytes() for s, e in zip(words.start[first], words.end[first], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(label[first], pa.int32()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["toxic", "word", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", hold_out: int = 5, max_rows: int = MAX_ROWS) -> Model:
    """Learns from labelled rows whose crc32(id) mod hold_out isn't 0, max_rows of each class at most.

    The curve has the rate of toxic rows among all of these, however many of a class are learnt from.
    A null label teaches nothing; of several labels of one id the largest counts. Without any
    labelled row of a class, all texts get that class's share as their score.
    """
    each = labels.where(F.col(label).isin(0, 1) & (crc_of_id(id_col, hold_out) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    all_of = {r["toxic"]: r["count"] for r in each.groupBy("toxic").count().collect()}  # two rows
    order = F.xxhash64("id", F.lit("learn"))
    picked = None
    for c in (0, 1):
        part = each.where(F.col("toxic") == c).orderBy(order, "id").limit(max_rows)
        picked = part if picked is None else picked.union(part)
    picked = picked.withColumn("curve", F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(CURVE_PART)) == 0)
    # at most 2 * max_rows rows of three small columns: safe to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
    counted = rows.where("not curve").select("toxic", "text").mapInArrow(_count, "toxic int, word string, n long").groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in (0, 1)]).toArrow()
    model = train(counted["word"].combine_chunks(), np.stack([counted[f"n{c}"].combine_chunks().to_numpy() for c in (0, 1)]).astype(float))
    del counted
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.batches(source, "text"):
            x = sent.value.evidence(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(FEATURES)]], ["toxic", *[f"x{k}" for k in range(FEATURES)]])

    names = [f"x{k}" for k in range(FEATURES)]
    left = rows.where("curve").select("toxic", "text").mapInArrow(weigh, "toxic int, " + ", ".join(f"{x} double" for x in names)).toArrow().to_pandas()
    sent.destroy()
    of_class = np.array([all_of.get(c, 0) / max(min(all_of.get(c, 0), max_rows), 1) for c in (0, 1)])  # rows that one learnt from stands for
    toxic = left["toxic"].to_numpy().astype(int)
    of_row = of_class[toxic]
    model.curve = fit_curve(left[names].to_numpy(), toxic.astype(float), of_row / of_row.mean() if len(of_row) else of_row)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: doc_id), score and predicted, a row for each row of docs.

    Null and empty texts have no evidence and get the curve's value at 0. Repeated rows and
    null ids are scored like any other. Columns that aren't carried are left out; carrying one
    named score or predicted raises a ValueError. Nothing is shuffled.
    """
    carry = ["doc_id"] if carry is None else carry
    if clash := {"score", "predicted"} & set(carry):
        raise ValueError(f"columns {sorted(clash)} would be written over")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.batches(source, "text"):
            p = sent.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    return rows.mapInArrow(run, with_row(rows, "score double, predicted int")).select("row.*", "score", "predicted")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all columns as they were."""
    row = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    return score(row, model, "__text", ["__row"]).where("predicted = 0").select("__row.*")
