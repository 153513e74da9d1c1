import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gannet.llm import quality_rules, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#", max_size=60), st.text(max_size=20)), min_size=1, max_size=8)


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_are_split_as_the_pattern_does(given_texts):
    buf, off = words.utf8(pa.array(given_texts, pa.string()))
    w = words.split(buf, off)
    data = buf.tobytes()
    got = [data[s:e].decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for t in given_texts for x in WORD.findall(t or "")]
    assert w.counts().tolist() == [len(WORD.findall(t or "")) for t in given_texts]
    by = {}
    for x, h in zip(got, w.hash.tolist(), strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_long_texts_are_split_in_stretches():
    t = ("word " * 300_000, "x" * 1_200_000 + " y", None)
    w = words.split(*words.utf8(pa.array(t)))
    assert w.counts().tolist() == [300_000, 2, 0] and len(set(w.hash.tolist())) == 3


def brute(text):
    ws = WORD.findall(text or "")
    n = len(ws)

    def cover(size, later):
        seen, grams, hit = set(), Counter(tuple(ws[i : i + size]) for i in range(n - size + 1)), [False] * n
        for i in range(n - size + 1):
            g = tuple(ws[i : i + size])
            if (g in seen) if later else grams[g] > 1:
                hit[i : i + size] = [True] * size
            seen.add(g)
        return hit

    lines, dup, chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            if line in lines:
                dup, chars = dup + 1, chars + sum(map(len, WORD.findall(line)))
            lines.add(line)
    size = sum(map(len, ws))
    inside = [sum(len(x) for x, h in zip(ws, cover(k, True), strict=True) if h) for k in quality_rules.NGRAM_LIMITS]
    repeat = sum(cover(5, False))
    failed = n < 10 or 100 * repeat > 20 * n
    kept = not failed and chars <= 0.2 * size and all(c <= lim * size for c, lim in zip(inside, quality_rules.NGRAM_LIMITS.values(), strict=True))
    return n, size, len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, chars, inside, failed, kept


CASES = [None, "", " \n ", "one", "a b c d e " * 30, "line of six words in it\n" * 3 + " ".join(f"w{k}" for k in range(80)), " ".join(f"é{k}" for k in range(40)), "### *** && " * 20 + "x", "\n\n\n", " ".join(f"w{k % 23}" for k in range(200))]


def test_quality_counts(spark):
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate(CASES)] + [(None, "x", "x"), (1, "", "")], "doc_id long, text string, n_words string")
    got = quality_rules.rate(df).collect()
    assert len(got) == len(CASES) + 2
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 1)}
    for k, t in enumerate(CASES):
        if k != 1:
            r = by[k]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["dup_line_chars"], r["dup_ngram_chars"], r["base_failed"], r["kept"]) == brute(t), k
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, t in enumerate(CASES) if brute(t)[-1]}
    assert quality_rules.rate(df.limit(0)).count() == 0


@given(texts)
@settings(max_examples=60, deadline=None)
def test_quality_against_brute_force(given_texts):
    x = quality_rules.measure(*words.utf8(pa.array(given_texts, pa.string())))
    failed, kept = quality_rules.judge(x)
    for k, t in enumerate(given_texts):
        n, size, sym, dup, repeat, chars, inside, bad, good = brute(t)
        assert (x["n_words"][k], x["word_chars"][k], x["n_symbols"][k], x["n_dup_lines"][k], x["n_repeat_words"][k], x["dup_line_chars"][k]) == (n, size, sym, dup, repeat, chars)
        assert x["dup_ngram_chars"][k].tolist() == inside and (failed[k], kept[k]) == (bad, good)


def _docs(n=600, seed=3):
    r = np.random.default_rng(seed)
    plain = ["".join(r.choice(list("aeioubdgklmnrst"), r.integers(2, 8))) for _ in range(400)]
    out = []
    for k in range(n):
        ws = r.choice(plain, r.integers(5, 80)).tolist()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(1 + len(ws) // 20):
                ws.insert(int(r.integers(0, len(ws))), "zuq" + "".join(r.choice(list("aeiou"), 3)))
        out.append((k, " ".join(ws), int(toxic)))
    return out


def test_toxicity_learns(spark):
    rows = _docs()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(9000, None, ""), (9001, "", ""), (None, "zuqaaa", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(5, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    from zlib import crc32

    held = [(k, y) for k, _, y in rows if crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["predicted"] == y for k, y in held]) >= 0.97
    assert got[9000]["score"] == got[9001]["score"]
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 0").count() == 0


def test_toxicity_keeps_the_rate_of_cut_classes(spark):
    """However many rows of a class are learnt from, scores have the rate of all labelled rows (here 1 in 9, as nothing tells the classes apart)."""
    r = np.random.default_rng(11)
    rows = [(k, " ".join(r.choice(["ab", "cd", "ef", "gh"], 12)), int(k % 9 == 0)) for k in range(3600)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    for most in (300, 10_000):
        got = toxicity.score(docs, toxicity.fit(docs, labels, max_rows=most)).selectExpr("avg(score) s", "avg(predicted) p").first()
        assert abs(got["s"] - 1 / 9) < 0.04 and got["p"] < 0.02


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


class _KneserNey:
    """The two models by their definition, over dictionaries of grams."""

    def __init__(self, ws, count):
        top = toxicity.ORDERS[-1]
        self.n = {top: [Counter(), Counter()]}
        for k, w in enumerate(ws):
            text = b" " * (top - 1) + w.encode() + b" "
            for at in range(top - 1, len(text)):
                for c in (0, 1):
                    if count[c][k]:
                        self.n[top][c][text[at - top + 1 : at + 1]] += count[c][k]
        for k in range(top - 1, 0, -1):
            self.n[k] = [Counter(), Counter()]
            for c in (0, 1):
                for gram in self.n[k + 1][c]:
                    self.n[k][c][gram[1:]] += 1

    def p(self, c, gram):
        k = len(gram)
        if not k:
            return 1 / 256
        n = self.n[k][c] if k in toxicity.ORDERS else self.n[k][0] + self.n[k][1]
        follow = {g: x for g, x in n.items() if g[:-1] == gram[:-1]}
        total = sum(follow.values())
        below = self.p(c, gram[1:])
        if not total:
            return below
        # in the shared orders a context's kinds are grams of either class
        return (max(n[gram] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(follow) * below) / total


def test_toxicity_models_against_brute_force():
    """The difference of log-likelihoods is that of Kneser-Ney models written out, for words learnt from and new ones; and these sum to one over all bytes."""
    r = np.random.default_rng(4)
    ws = sorted({"".join(r.choice(list("abc"), int(r.integers(1, 12))).tolist()) for _ in range(40)})
    count = np.stack([r.integers(0, 4, len(ws)), r.integers(0, 4, len(ws))]).astype(float)
    ws, count = [w for w, n in zip(ws, count.sum(axis=0), strict=True) if n], count[:, count.sum(axis=0) > 0]
    model, brute = toxicity.train(pa.array(ws), count), _KneserNey(ws, count)
    asked = [*ws[:12], "abcabcabc", "zz", "a", "abz", "q" * 30]
    value = model.of_words(*_spans(asked))
    top = toxicity.ORDERS[-1]
    for w, v in zip(asked, value, strict=True):
        text = b" " * (top - 1) + w.encode() + b" "
        grams = [text[at - top + 1 : at + 1] for at in range(top - 1, len(text))]
        assert abs(v - sum(np.log(brute.p(1, g) / brute.p(0, g)) for g in grams)) < 1e-4, w
    for context in (b"", b"a", b"ab", b"   ab", b"  abcab", b"      c"):
        for c in (0, 1):
            assert abs(sum(brute.p(c, context + bytes([x])) for x in range(256)) - 1) < 1e-9
    known = dict(zip(model.words.tolist(), model.known.tolist(), strict=True))
    h = words.split(*words.utf8(pa.array([ws[0]])), sep=words.SPACE_PUNCT, values=words.LOWER).hash
    assert abs(known[h.tolist()[0]] - value[0]) < 1e-4


def test_toxicity_edge_cases(spark):
    """Very long texts, repeated rows and a clashing column."""
    rows = _docs(200)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(7000, (rows[1][1] + " ") * 20_000), (7001, "zuqaei " * 200_000), (7002, "twice"), (7002, "twice")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.score(docs, model).where("doc_id >= 7000").collect()]
    assert sorted(got)[:2] == [(7000, 0), (7001, 1)] and len(got) == 4
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumnRenamed("doc_id", "score"), model, carry=["score"])


def _spans(ws):
    buf, off = words.utf8(pa.array(ws))
    return buf, off[:-1], off[1:]


def test_hashes_tell_crafted_words_apart():
    """Words on which sums of powers modulo 2**64 agree."""
    a = b"ab"
    for _ in range(10):
        a = a + bytes(97 + 98 - c for c in a)
    b = bytes(97 + 98 - c for c in a)
    buf = np.frombuffer(a + b" " + b + b" " + a, dtype=np.uint8)
    h = words.split(buf, np.array([0, len(buf)])).hash
    assert h[0] != h[1] and h[0] == h[2]
