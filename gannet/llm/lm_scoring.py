"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

The vocabulary is all words seen often enough, up to a bound that is a parameter. The most frequent
ones are units of their own; each other word belongs to a class by its ending. The model
predicts first the unit (a frequent word, the end of a text, or a class), then the word within
its class, where one row stands for all words that are too rare. Scores of both steps after
two words are linear in a predicted vector, the sum of the context's vectors through a matrix
for each distance (log-bilinear). Training tells what stood there from noise drawn by
frequency, among units and within the class; scoring normalises over all units and over the class, by
batched products. A rare word has its share of its class's smoothed rest, so probabilities of
all words, seen and unseen, sum to 1.

Counts cover every training token, and every training token is trained on once, as a target
and as context, at every size of the corpus. Texts are dealt
by hashes to shards of about SHARD tokens, and shards to rounds, more of them for more text. In a
round each shard runs stochastic gradient steps from common weights, and the mean of the
results, weighted by tokens, starts the next one. What a shard holds, and in which order,
depends on the texts alone, so scores don't depend on how the input is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gannet.llm import words as W
from gannet.llm.common import cut, drop

#: Units of the first step: so many words (and the end of a text), and so many classes of other words.
TOP, CLASSES = 64, 96
UNITS = TOP + CLASSES
#: Words of classes that are told apart: all seen LEAST times, but the most frequent VOCABULARY at most (16 * 2 floats each).
VOCABULARY, LEAST = 12_000, 16
CONTEXT, SIZE, NOISE, NOISE_IN_CLASS = 2, 16, 12, 2
#: Tokens of a shard, of a block in which tokens are shuffled, and of a gradient step.
SHARD, BLOCK, BATCH, RATE = 1 << 20, 1 << 16, 4096, 0.06
PART, ROWS = 1 << 16, 1024  # tokens that are scored at once, and of one product: both stay in a processor's cache
NOISE_TABLE = 1 << 12  # entries of a class's table of noise
ALPHA = 0.1
#: At most about so many of the most frequent words' counts are held by every executor (16 bytes each); those of the others are joined.
HELD = 500_000
END = np.uint64(0x2545F4914F6CDD1D)
_CHUNK = 1 << 14  # weights that travel as one row


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words, each text's end behind them: hashes, classes; and where each text starts."""
    buf, off = W.utf8(col)
    words = W.split(buf, off, values=W.LOWER)
    n = len(off) - 1
    hashes = np.full(len(words.hash) + n, END, dtype=np.uint64)
    kind = np.zeros(len(hashes), dtype=np.int16)
    at = np.arange(len(words.hash)) + words.doc()
    hashes[at] = words.hash
    if len(at):
        last = [W.LOWER[buf[np.maximum(words.end - k, words.start)]] for k in (1, 2, 3)]
        tail = last[0] * np.uint64(5) + last[1] * np.uint64(3) + last[2]
        kind[at] = (W.mix(tail) % np.uint64(CLASSES)).astype(np.int16)
    return hashes, kind, words.first + np.arange(n + 1)


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.batches(source, "text", 1 << 22):
        hashes, kind, _ = _tokens(batch.column(0))
        h, first, n = np.unique(hashes, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind[first]), pa.array(n)], ["h", "kind", "n"])


@dataclass
class Counts:
    """What each executor holds of the counts.

    A word's code is its number among the frequent ones, or TOP and its row of the second step.
    Rows of a class stand together, the row of its rare words last.
    """

    keys: np.ndarray  #: hashes of the HELD most frequent words, sorted
    count: np.ndarray
    code: np.ndarray  #: where the word has one of its own, else -1
    ends: np.ndarray  #: of each class's rows, 0 first
    of_code: np.ndarray  #: tokens of each code
    room: np.ndarray  #: log10 of the smoothed total of each class's rare words
    tokens: int
    distinct: int

    def unit(self, code: np.ndarray) -> np.ndarray:
        return np.where(code < TOP, code, TOP - 1 + np.searchsorted(self.ends, code - TOP, side="right"))

    def look(self, hashes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's count (-1: not held) and code."""
        rare = TOP - 1 + self.ends[kind.astype(np.int64) + 1]
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(hashes), -1), rare
        found = self.keys[at] == hashes
        code = np.where(found, self.code[at], -1)
        return np.where(found, self.count[at], -1), np.where(code >= 0, code, rare)

    def rare(self, code: np.ndarray) -> np.ndarray:
        """The class whose rare words a code stands for, else -1."""
        kind = np.searchsorted(self.ends, code - TOP, side="right") - 1
        return np.where((code >= TOP) & (code - TOP == self.ends[np.minimum(kind, CLASSES - 1) + 1] - 1), kind, -1)


def _contexts(code: np.ndarray, first: np.ndarray, before: int) -> np.ndarray:
    """The CONTEXT codes before each token, the nearest first; `before` stands for what lies before a text."""
    out = np.full((CONTEXT, len(code)), before, dtype=np.int64)
    place = np.arange(len(code)) - np.repeat(first[:-1], np.diff(first))
    for k in range(CONTEXT):
        out[k, k + 1 :] = code[: -k - 1]
        out[k, place <= k] = before
    return out


def _shares(tokens: np.ndarray) -> np.ndarray:
    n = np.maximum(tokens, 0.5)
    return n / n.sum()


class Model:
    """Weights, and what the gradients of each row have summed up to, as views of one array."""

    def __init__(self, rows: int, flat: np.ndarray | None = None):
        shapes = [(TOP + rows + 1, SIZE), (CONTEXT * SIZE, SIZE), (UNITS, SIZE), (UNITS,), (rows, SIZE), (rows,)]
        shapes += [(s[0],) for s in shapes]
        ends = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
        self.rows, self.flat = rows, np.zeros(ends[-1], dtype=np.float32) if flat is None else flat.astype(np.float32)
        parts = [self.flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True)]
        self.weights, self.seen = parts[:6], parts[6:]
        self.vectors, self.turns, self.targets, self.bias, self.targets_in, self.bias_in = self.weights

    @staticmethod
    def fresh(counts: Counts) -> Model:
        m, draw = Model(int(counts.ends[-1])), np.random.default_rng(7)
        for x in (m.vectors, m.turns, m.targets, m.targets_in):
            x[:] = 0.1 * draw.standard_normal(x.shape)
        m.turns += np.tile(np.eye(SIZE, dtype=np.float32), (CONTEXT, 1))
        of_unit, of_row = _totals(counts)
        m.bias[:] = np.log(_shares(of_unit))
        m.bias_in[:] = np.log(of_row)
        for s in m.seen:
            s[:] = 0.1
        return m

    def guess(self, context: np.ndarray) -> np.ndarray:
        out = self.vectors[context[0]] @ self.turns[:SIZE]
        for k in range(1, CONTEXT):
            out += self.vectors[context[k]] @ self.turns[k * SIZE : (k + 1) * SIZE]
        return out

    def log10(self, counts: Counts, code: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of codes in their contexts; long texts in parts."""
        if len(code) > PART:
            return np.concatenate([self.log10(counts, code[at : at + PART], context[:, at : at + PART]) for at in range(0, len(code), PART)])
        unit, out = counts.unit(code), np.empty(len(code))
        guess = np.ones((len(code), SIZE + 1), dtype=np.float32)  # a last 1 for the bias
        guess[:, :SIZE] = self.guess(context)
        targets, targets_in = np.column_stack([self.targets, self.bias]), np.column_stack([self.targets_in, self.bias_in])
        for at in range(0, len(code), ROWS):
            part = slice(at, at + ROWS)
            out[part] = _normalised(guess[part], targets, unit[part])
        order = np.argsort(unit.astype(np.uint16), kind="stable")  # a radix sort
        bounds = np.searchsorted(unit[order], np.arange(TOP, UNITS + 1))
        order, bounds = order[bounds[0] :], bounds - bounds[0]
        guess, row, inside = guess[order], code[order] - TOP, np.zeros(len(order))
        for c in np.flatnonzero(np.diff(bounds)):
            rows = slice(counts.ends[c], counts.ends[c + 1])
            if rows.stop - rows.start > 1:
                for at in range(bounds[c], bounds[c + 1], ROWS):
                    part = slice(at, min(at + ROWS, bounds[c + 1]))
                    inside[part] = _normalised(guess[part], targets_in[rows], row[part] - rows.start)
        out[order] += inside
        return out / np.log(10)


def _normalised(guess: np.ndarray, targets: np.ndarray, which: np.ndarray) -> np.ndarray:
    logits = guess @ targets.T
    mine = logits[np.arange(len(logits)), which].astype(np.float64)
    # no logit is larger than this, so that most batches need no pass for their maxima
    bound = np.sqrt(np.einsum("ij,ij->i", guess, guess).max() * np.einsum("ij,ij->i", targets, targets).max())
    top = 0.0
    if bound > 80:
        top = logits.max(axis=1).astype(np.float64)
        logits -= top[:, None].astype(np.float32)
    np.exp(logits, out=logits)
    return mine - top - np.log(logits @ np.ones(logits.shape[1], dtype=np.float32))


def _totals(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each unit, and the share of each row in its class."""
    inside = counts.of_code[TOP:]
    of_class = np.add.reduceat(inside, counts.ends[:-1])
    share = np.maximum(inside, 0.5)
    return np.concatenate([counts.of_code[:TOP], of_class]), share / np.repeat(np.add.reduceat(share, counts.ends[:-1]), np.diff(counts.ends))


def _fold(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values of equal rows, of which there are fewer than 2 ** 16."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
    rows = rows[order]
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[begin], np.add.reduceat(values[order], begin)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    z = np.exp(np.maximum(-z, -30))  # overflow to infinity gives 0
    z += 1
    return np.reciprocal(z, out=z)


class Trainer:
    """Gradient steps with rates that shrink by what each row of weights has seen (AdaGrad by rows)."""

    def __init__(self, counts: Counts):
        self.c = counts
        of_unit, self.share = _totals(counts)
        noise = _shares(of_unit)
        self.bounds, self.shift = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        ends = counts.ends
        self.noise_in = np.empty((CLASSES, NOISE_TABLE), dtype=np.int32)
        times = np.zeros(len(self.share))
        for c in range(CLASSES):
            total = np.cumsum(self.share[ends[c] : ends[c + 1]])
            self.noise_in[c] = ends[c] + np.minimum(np.searchsorted(total, (np.arange(NOISE_TABLE) + 0.5) / NOISE_TABLE), len(total) - 1)
            times[ends[c] : ends[c + 1]] = np.bincount(self.noise_in[c] - ends[c], minlength=len(total))
        # a row that noise never draws still tells itself apart: half an entry
        self.shift_in = np.log(NOISE_IN_CLASS * np.maximum(times, 0.5) / NOISE_TABLE).astype(np.float32)

    @staticmethod
    def _step(m: Model, k: int, rows: np.ndarray | slice, g: np.ndarray) -> None:
        seen = m.seen[k][rows] + (np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim > 1 else g * g)
        m.seen[k][rows] = seen
        rate = RATE / np.sqrt(seen)
        m.weights[k][rows] -= g * (rate[:, None] if g.ndim > 1 else rate)

    def step(self, m: Model, draw: np.random.Generator, code: np.ndarray, unit: np.ndarray, context: np.ndarray) -> None:
        noise = np.minimum(np.searchsorted(self.bounds, draw.random(NOISE)), UNITS - 1)
        parts = m.vectors[context]  # distance, token, size
        turns = m.turns.reshape(CONTEXT, SIZE, SIZE)
        guess = parts[0] @ turns[0]
        for part, turn in zip(parts[1:], turns[1:], strict=True):
            guess += part @ turn
        true, other = m.targets[unit], m.targets[noise]
        g_true = _sigmoid(np.einsum("ij,ij->i", guess, true) + m.bias[unit] - self.shift[unit]) - 1
        g_other = _sigmoid(guess @ other.T + m.bias[noise] - self.shift[noise])
        back = g_true[:, None] * true + g_other @ other
        inner = np.flatnonzero(unit >= TOP)
        if len(inner):
            kind, near = unit[inner] - TOP, guess[inner]
            # noise of each class from a table of rows as frequent as their shares
            picks = draw.integers(0, NOISE_TABLE, (NOISE_IN_CLASS, len(inner)))
            rows = np.concatenate([(code[inner] - TOP)[None], self.noise_in[kind, picks]])
            targets = m.targets_in[rows]
            g_in = _sigmoid(np.einsum("ij,kij->ki", near, targets) + m.bias_in[rows] - self.shift_in[rows])
            g_in[0] -= 1
            back[inner] += np.einsum("ki,kij->ij", g_in, targets)
            moved = np.empty((*rows.shape, SIZE + 1), dtype=np.float32)
            np.multiply(g_in[:, :, None], near, out=moved[:, :, :SIZE])
            moved[:, :, SIZE] = g_in
            at, g = _fold(rows.ravel(), moved.reshape(-1, SIZE + 1))
            self._step(m, 4, at, g[:, :SIZE])
            self._step(m, 5, at, g[:, SIZE])
        self._step(m, 0, *_fold(context.ravel(), np.matmul(back[None], turns.transpose(0, 2, 1)).reshape(-1, SIZE)))
        self._step(m, 1, slice(None), np.matmul(parts.transpose(0, 2, 1), back[None]).reshape(-1, SIZE))
        grads, bias = np.zeros_like(m.targets), np.bincount(unit, weights=g_true, minlength=UNITS).astype(np.float32)
        at, g = _fold(unit, g_true[:, None] * guess)
        grads[at] = g
        np.add.at(grads, noise, g_other.T @ guess)
        np.add.at(bias, noise, g_other.sum(axis=0))
        self._step(m, 2, slice(None), grads)
        self._step(m, 3, slice(None), bias)

    def block(self, m: Model, draw: np.random.Generator, texts: list[np.ndarray]) -> None:
        """Steps over all tokens of some texts (codes), each a target once, in random order."""
        code = np.concatenate(texts).astype(np.int64)
        context = _contexts(code, np.cumsum([0, *map(len, texts)]), TOP + m.rows)
        unit, order = self.c.unit(code), draw.permutation(len(code))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            self.step(m, draw, code[pick], unit[pick], context[:, pick])


def _train(held, start, round_no: int):
    """Rows come by shard, in a fixed order; gives the sums of the shards' weights, each times its tokens, in chunks."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(held.value)
        total, tokens = np.zeros(len(start.value)), 0
        m, draw, shard, seen, waiting = None, None, None, 0, []

        def work() -> None:
            nonlocal waiting
            if waiting:
                trainer.block(m, draw, waiting)
            waiting = []

        def close() -> None:
            nonlocal total, tokens
            if m is not None:
                work()
                total += m.flat.astype(np.float64) * seen
                tokens += seen

        held_back = 0
        for batch in source:
            for number, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != shard:
                    close()
                    m, shard, seen, held_back = Model(int(held.value.ends[-1]), start.value.copy()), number, 0, 0
                    draw = np.random.default_rng([round_no, number])
                text = np.frombuffer(codes.as_buffer(), dtype="<u2")
                waiting.append(text)
                seen += len(text)
                held_back += len(text)
                if held_back >= BLOCK:
                    work()
                    held_back = 0
        close()
        W.give_back()
        if tokens:
            at = np.arange(0, len(total), _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(at // _CHUNK, pa.int32()), pa.array([tokens] * len(at), pa.int64()), pa.array([total[a : a + _CHUNK].tobytes() for a in at], pa.binary())], ["chunk", "n", "w"])

    return run


def _sum(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer(), dtype="<f8") for x in group["w"]], axis=0)
    return pa.table({"chunk": pa.array([group["chunk"][0].as_py()], pa.int32()), "n": pa.array([sum(group["n"].to_pylist())], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})


def _held(counts: DataFrame) -> DataFrame:
    """About the HELD most frequent words (h, kind, c), from a histogram of some hundred rows: nothing is sorted. Of the least frequent among them, a share by their hashes."""
    step = F.floor(8 * F.log2("c")).cast("int")
    room, share, least = HELD, 0.0, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        least, share = row["step"], min(room / row["count"], 1.0)
        room -= row["count"]
        if room <= 0:
            break
    part = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return counts.where((step > least) | ((step == least) & part)).select("h", "kind", "c")


def count(train: DataFrame, text: str = "text") -> tuple[Counts, DataFrame]:
    """Counts for the executors, and the table of all counts (h, kind, c), made by cut."""
    table = cut(train.select(F.col(text).alias("text")).mapInArrow(_count, "h long, kind short, n long").groupBy("h").agg(F.max("kind").alias("kind"), F.sum("n").alias("c")))
    tokens, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    held = _held(table).toArrow()
    h, kind, n = (held[c].combine_chunks().to_numpy() for c in ("h", "kind", "c"))
    h = h.view(np.uint64)
    rank = np.lexsort((h, -n))
    top, inner = rank[:TOP], rank[TOP : TOP + VOCABULARY]
    inner = inner[n[inner] >= LEAST]
    inner = inner[np.argsort(kind[inner], kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(kind[inner], minlength=CLASSES) + 1)])
    code = np.full(len(h), -1, dtype=np.int32)
    code[top] = np.arange(len(top))
    code[inner] = TOP + np.arange(len(inner)) + kind[inner]  # a row for rare words stands before each class but the first
    of_code, kinds = np.zeros(TOP + ends[-1]), np.zeros(CLASSES)
    of_code[code[code >= 0]] = n[code >= 0]
    # of each class all that is counted, less what has a row of its own: CLASSES rows
    for row in table.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        own = (code >= 0) & (kind == row["kind"])
        of_code[TOP + ends[row["kind"] + 1] - 1], kinds[row["kind"]] = row["c"] - n[own].sum(), row["v"] - own.sum()
    order = np.argsort(h)
    room = np.log10(of_code[TOP + ends[1:] - 1] + ALPHA * (kinds + 1))
    return Counts(h[order], n[order], code[order], ends, of_code, room, int(tokens), int(distinct)), table


def _code(held):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.batches(source, "text", 1 << 18):
            hashes, kind, first = _tokens(batch.column(1))
            code = held.value.look(hashes, kind)[1].astype("<u2")
            flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(first.astype(np.int64) * 2), pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), flat.cast(pa.binary())], ["h", "codes"])

    return run


def fit(train: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[Counts, DataFrame, np.ndarray]:
    """Counts for the executors, the table of all counts (h, kind, c), and the model's weights."""
    spark = train.sparkSession
    counts, table = count(train, text)
    weights = Model.fresh(counts).flat
    shards = -(-counts.tokens // SHARD)
    if not shards:
        return counts, table, weights
    rounds = min(3 + int(np.log2(shards)) // 3, shards)
    sent = spark.sparkContext.broadcast(counts)
    keyed = train.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), F.col(text).alias("text"))
    coded = cut(keyed.mapInArrow(_code(sent), "h long, codes binary").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")))
    tasks = min(-(-shards // rounds), spark.sparkContext.defaultParallelism)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(weights)
        dealt = coded.where(F.col("shard") % rounds == k).repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "h").select("shard", "codes")
        sums = dealt.mapInArrow(_train(sent, start, k), "chunk int, n long, w binary")
        done = sums.groupBy("chunk").applyInArrow(_sum, "chunk int, n long, w binary").toArrow().to_pylist()  # the weights, once
        if done:
            done.sort(key=lambda r: r["chunk"])
            weights = (np.concatenate([np.frombuffer(r["w"], dtype="<f8") for r in done]) / done[0]["n"]).astype(np.float32)
        start.destroy()
    sent.destroy()
    drop(coded)
    return counts, table, weights


def score(docs: DataFrame, counts: Counts, table: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score, a row for each row of docs.

    base_score is the smoothed unigram log10 probability, score the model's (null without
    weights). Null texts count as empty: one token, the end. Repeated rows and null ids are
    scored like any other, very long texts whole. Other columns are left out, so their names can't clash. With
    nothing to learn from, the distribution over units is as good as uniform.
    """
    sent = docs.sparkSession.sparkContext.broadcast((counts, weights))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, w = sent.value
        model = None if w is None else Model(int(c.ends[-1]), w)
        row = TaskContext.get().partitionId() << 33
        floor = np.log10(c.tokens + ALPHA * (c.distinct + 1))
        for batch in W.batches(source, "text", 1 << 18):
            hashes, kind, first = _tokens(batch.column(1))
            n, code = c.look(hashes, kind)
            rest = n < 0
            smooth = np.log10(np.where(rest, 1.0, n + ALPHA))  # what's missing of the rest is added after the join
            begin, size = first[:-1], np.diff(first)
            p = pa.nulls(batch.num_rows, pa.float64())
            if model is not None:
                rare = c.rare(code)
                each = model.log10(c, code, _contexts(code, first, TOP + model.rows)) + np.where(rare >= 0, smooth - c.room[np.maximum(rare, 0)], 0.0)
                p = pa.array(np.add.reduceat(each, begin))
            rests = np.concatenate([[0], np.cumsum(rest)])[first]
            flat = pa.ListArray.from_arrays(pa.array(rests, pa.int32()), pa.array(hashes[rest].view(np.int64)))
            cols = [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), pa.array(size), pa.array(np.add.reduceat((n > 0).astype(np.int64), begin))]
            cols += [pa.array(np.add.reduceat(smooth, begin) - size * floor), p, flat]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    part = cut(rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rest array<long>"))
    each = part.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    known = F.coalesce("c", F.lit(0))
    missing = each.join(table.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(known + ALPHA)).alias("more"), F.sum(F.when(known > 0, F.col("n")).otherwise(0)).alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    return part.drop("rest").join(missing, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )


def fit_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows of docs that aren't held out, and scores all."""
    return score(docs, *fit(docs.where(~held_out), id_col, text), id_col, text)


def base_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The same without the model: its score is null."""
    return score(docs, *count(docs.where(~held_out), text), None, id_col, text)
