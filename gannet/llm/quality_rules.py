"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken with numpy over a whole text; the characters
(code points in words) that lie inside repeated n-grams and repeated lines decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gannet.llm import words as W
from gannet.llm.common import with_row

#: Largest share of a text's characters inside later copies of an n-gram, by n (published repetition rules for web text).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHAR_LIMIT = 0.20
MIN_WORDS = 10
BASE_N, BASE_PERCENT = 5, 20

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"
)
_SYMBOL = W._separators(b"#*$%&|<>")


def _per_doc(mask: np.ndarray, off: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:] - base] - total[off[:-1] - base]


def _later_copies(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys stand elsewhere too, and which of these aren't the first."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    again = np.zeros(len(k), dtype=bool)
    again[order] = same
    any_of = same.copy()
    any_of[:-1] |= same[1:]
    repeated = np.zeros(len(k), dtype=bool)
    repeated[order] = any_of
    return repeated, again


def _cover(at: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + n, size), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text; see SCHEMA."""
    base, n_docs = int(off[0]), len(off) - 1
    seg = buf[base : int(off[-1])]
    words = W.split(buf, off)
    doc, n_words = words.doc(), words.counts()
    sum_by = lambda d, v: np.bincount(d, weights=v, minlength=n_docs).astype(np.int64)
    lead = (seg & 0xC0) != 0x80
    in_word = lead & ~W.SPACE[seg]
    chars_to = np.zeros(len(seg) + 1, dtype=np.int64)
    np.cumsum(in_word, out=chars_to[1:])
    size_of = chars_to[words.end - base] - chars_to[words.start - base] if len(words.start) else np.zeros(0, np.int64)

    salt = W.mix(np.arange(n_docs, dtype=np.uint64) + np.uint64(77))
    lines = W.split(buf, off, sep=W.NEWLINE)
    chars = chars_to[lines.end - base] - chars_to[lines.start - base] if len(lines.start) else np.zeros(0, np.int64)
    full = chars > 0
    line_doc = lines.doc()[full]
    _, again = _later_copies(lines.hash[full] ^ salt[line_doc])

    at, h = W.ngrams(words, BASE_N)
    repeated, _ = _later_copies(h ^ salt[doc[at]])
    covered = _cover(at[repeated], BASE_N, len(doc))
    inside = []
    for n in NGRAM_LIMITS:
        at, h = W.ngrams(words, n)
        worth = covered[at]  # a repeated n-gram starts with a repeated n-gram of the base length
        at, h = at[worth], h[worth]
        _, later = _later_copies(h ^ salt[doc[at]])
        cover = _cover(at[later], n, len(doc))
        inside.append(sum_by(doc[cover], size_of[cover]))
    return {
        "n_words": n_words,
        "word_chars": _per_doc(in_word, off, base),
        "n_symbols": _per_doc(_SYMBOL[seg], off, base),
        "n_dup_lines": np.bincount(line_doc[again], minlength=n_docs),
        "n_repeat_words": np.bincount(doc[covered], minlength=n_docs),
        "dup_line_chars": sum_by(line_doc[again], chars[full][again]),
        "dup_ngram_chars": np.stack(inside, axis=1),
    }


def judge(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > BASE_PERCENT * x["n_words"])
    limits = np.array(list(NGRAM_LIMITS.values()))
    too_much = (x["dup_ngram_chars"] > limits * x["word_chars"][:, None]).any(axis=1)
    return failed, ~failed & ~too_much & (x["dup_line_chars"] <= LINE_CHAR_LIMIT * x["word_chars"])


def rate(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: doc_id) and those of SCHEMA, a row for each row of docs.

    Null texts count as empty: no words, so they fail. Repeated rows and null ids are rated
    like any other. Other columns are left out, so their names can't clash; a carried column
    named like one of SCHEMA raises a ValueError. Nothing is shuffled.
    """
    carry = ["doc_id"] if carry is None else carry
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    if clash := set(made) & set(carry):
        raise ValueError(f"columns {sorted(clash)} would be written over")
    kept = F.struct(*[F.col(c) for c in carry]).alias("row")
    rated = docs.select(kept, F.col(text).alias("text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.batches(source, "text"):
            x = measure(*W.utf8(batch.column(1)))
            failed, ok = judge(x)
            grams = x.pop("dup_ngram_chars")
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, grams.size + 1, grams.shape[1]), pa.int32()), pa.array(grams.ravel(), pa.int64()))
            cols = [pa.array(x[c], pa.int64()) for c in made[:6]] + [flat, pa.array(failed), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", *made])

    return rated.mapInArrow(run, with_row(rated, SCHEMA)).select("row.*", *made)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with all columns as they were."""
    row = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    return rate(row, "__text", ["__row"]).where("kept").select("__row.*")
