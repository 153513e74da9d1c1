import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gannet.llm import chat_format, html_text, lm_scoring, packing, sentencepiece_fst
from gannet.llm.queries import tokenizer


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=8), st.integers(40, 64))
@settings(max_examples=200, deadline=None)
def test_best_fill_is_best(counts, capacity):
    reach = {max(counts)}
    for n, k in counts.items():
        for _ in range(k - (n == max(counts))):
            reach |= {s + n for s in reach if s + n <= capacity}
    chosen = packing.best_fill(counts, capacity)
    assert all(k <= counts[n] for n, k in chosen.items()) and chosen[max(counts)] >= 1
    assert sum(n * k for n, k in chosen.items()) == max(reach)


@given(st.lists(st.integers(0, 200), max_size=60), st.integers(2, 50))
@settings(max_examples=100, deadline=None)
def test_packer_is_exact(sizes, pool):
    p = packing.Packer(64, pool)
    docs = [np.arange(n, dtype="<u4") + 1000 * k for k, n in enumerate(sizes)]
    for k, ids in enumerate(docs):
        p.add(k, ids)
    p.finish()
    rows = [x for b in p.rows() for x in b.to_pylist()]
    back = defaultdict(dict)
    fill = defaultdict(list)
    for r in rows:
        back[r["doc_id"]][r["start"]] = r["ids"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["doc_tokens"] == sizes[r["doc_id"]]
    for k, ids in enumerate(docs):
        assert b"".join(back[k][s] for s in sorted(back[k])) == ids.tobytes()
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0


@pytest.fixture(scope="module")
def coder():
    return packing.Encoder(tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def test_parts_of_new_words_are_encoded_at_once(coder, monkeypatch):
    """A text of words never met takes one call for each part, not one for each word."""
    calls, fast = [], coder.fast
    monkeypatch.setattr(coder, "fast", lambda x: calls.append(x) or fast(x))
    text = " ".join(f"neu{k}wörd" for k in range(5000))
    got = coder.encode(text, 1)
    assert "".join(calls) == text and len(calls) < 50 and max(map(len, calls)) < coder.PART + 20
    assert got.tolist() == [*coder.model.encode(text, add_special_tokens=False).ids, 1]


PARTS = st.sampled_from([" ", "  ", "\n", " \n ", "\t", "\r\n", "a", "Word", "it's", "é", "ß", "12", "3.5", "!?", "…", "漢字", "\u00a0", "\u2003", "\x0b", "\x1c", "\x85", "<|endoftext|>", "<|end", "'", "x" * 30])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40), st.integers(1, 40))
def test_parts_have_the_ids_of_the_text(coder, pieces, size):
    text = "".join(pieces)
    coder.PART = size
    try:
        got = coder.encode(text, 1)
        assert "".join(coder._parts(text)) == text
    finally:
        del coder.PART
    assert got.tolist() == [*coder.model.encode(text, add_special_tokens=False).ids, 1]


def test_packing_query(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = [None, "", "hello  world\n\n it's", "a<|endoftext|>b", "漢字 x² " * 900, "tab\tand \n space ", "ünïcode " * 4000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "x", 1), (2, texts[2], 1)], "doc_id long, text string, offset int")
    for ranks in (None, tokenizer("byte_bpe_50k.tiktoken")):
        got = packing.pack(df, tokenizer("byte_bpe_50k.json"), ranks).collect()
        for k, t in enumerate(texts):
            if k != 2:
                ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
                mine = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"]))
                assert mine == np.array(ids, dtype="<u4").tobytes()
        assert sum(r["doc_id"] is None for r in got) >= 1
    assert packing.pack(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "x", window=100)


def test_sentencepiece_equals_the_library(spark, data):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    mine = sentencepiece_fst.Transducer(tokenizer("piece_bpe_32k.model"))
    odd = ["", " ", "  a  b ", "x \n y", "▁x y", "漢字\x00<s>", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 40, "ß" * 300, "é" * 7 + " ", "\t\t"]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    for t in texts:
        ids = mine.encode(t).tolist()
        assert ids == sp.encode(t) and mine.decode(ids) == sp.decode(ids)
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(odd)] + [(None, None, 1)], "doc_id long, text string, ids int")
    path = tokenizer("piece_bpe_32k.model")
    back = {r["doc_id"]: r["text"] for r in sentencepiece_fst.decode(sentencepiece_fst.encode(df, path), path).collect()}
    assert back[None] is None and all(back[k] == sp.decode(sp.encode(t)) for k, t in enumerate(odd))


@given(st.text(alphabet="ab ▁é漢\n'-.", max_size=40))
@settings(max_examples=150, deadline=None)
def test_sentencepiece_on_any_text(text):
    import sentencepiece

    global _SP, _FST
    if "_SP" not in globals():
        _SP, _FST = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), sentencepiece_fst.Transducer(tokenizer("piece_bpe_32k.model"))
    assert _FST.encode(text).tolist() == _SP.encode(text)


def _brute_force(model, text):
    """Shortest path by Bellman-Ford over all arcs (and pairs) of a text, without any of the machines' shortcuts."""
    c, _ = model.normalise([text])
    start, span, symbol, weight = model._matches(c, np.array([0]), np.array([len(c)]))
    arcs = list(zip(start.tolist(), (start + span).tolist(), symbol.tolist(), weight.tolist(), strict=True))
    best = {(0, -1): (0.0, [])}
    for end in range(1, len(c) + 1):
        for s, e, x, w in sorted(arcs, key=lambda a: a[0]):
            if e != end:
                continue
            for (at, last), (cost, path) in [(k, v) for k, v in best.items() if k[0] == s]:
                free = not model.merging or last < 0 or model.other in (last, x) or bool(model._merge(np.array([last]), np.array([x]))[0])
                if free and cost + w < best.get((end, x), (np.inf,))[0]:
                    best[end, x] = (cost + w, [*path, x])
    return min((v for k, v in best.items() if k[0] == len(c)), key=lambda v: v[0], default=(0.0, []))


def test_sentencepiece_is_the_shortest_path(tmp_path):
    """Against all paths: one of finite weight in the merge model, the least weight in a unigram one; short stretches, long ones, and the whole text at once."""
    r = np.random.default_rng(3)
    merge = sentencepiece_fst.Transducer(tokenizer("piece_bpe_32k.model"))
    path = tmp_path / "uni.model"
    path.write_bytes(_unigram_model({"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.2, "▁a": -2.2, "▁ab": -3.9, "ba": -3.3, "bb": -4.0, "aab": -4.1}))
    uni = sentencepiece_fst.Transducer(str(path))
    for model, alphabet in ((merge, list("theins ▁é漢x")), (uni, list("ab x"))):
        for _ in range(25):
            text = "".join(r.choice(alphabet, int(r.integers(1, 14))).tolist())
            cost, symbols = _brute_force(model, text)
            c, _ = model.normalise([text])
            whole, n = model._shortest(c, np.array([0]), np.array([len(c)]))
            alone = model._alone(c, 0, len(c))
            if model.merging:
                assert whole.tolist() == alone.tolist() == symbols
            else:
                spans = {s: w for s, w in zip(model._matches(c, np.array([0]), np.array([len(c)]))[2].tolist(), model._matches(c, np.array([0]), np.array([len(c)]))[3].tolist(), strict=True)}
                assert abs(sum(spans[s] for s in whole.tolist()) - cost) < 1e-4 and abs(sum(spans[s] for s in alone.tolist()) - cost) < 1e-4


def _unigram_model(pieces, byte_fallback=False):
    """A model file with these pieces and scores, by the protocol buffers' own rules."""

    def field(number, value):
        if isinstance(value, bytes):
            return bytes([number << 3 | 2, len(value)]) + value
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        return bytes([number << 3, value])

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{k:02X}>", 0.0, 6) for k in range(256) if byte_fallback], *[(p, s, 1) for p, s in pieces.items()]]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in rows)
    trainer = field(3, 1) + (bytes([35 << 3 & 127 | 128, 35 >> 4, 1]) if byte_fallback else b"")
    return out + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1))


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_sentencepiece_unigram_equals_the_library(tmp_path, byte_fallback):
    import sentencepiece

    r = np.random.default_rng(1)
    pieces = {"▁": -3.5, **{c: -4.0 - k / 7 for k, c in enumerate("abcd")}}
    while len(pieces) < 60:
        piece = "".join(r.choice(list("abcd▁"), int(r.integers(2, 6))).tolist())
        pieces.setdefault(piece, -2.0 * len(piece) - float(r.random()))
    path = tmp_path / "uni.model"
    path.write_bytes(_unigram_model(pieces, byte_fallback))
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_fst.Transducer(str(path))
    texts = ["", " ", "  a  b ", "abé漢é d", "xx a xx", *["".join(r.choice(list("abcd é"), int(r.integers(1, 150))).tolist()) for _ in range(60)]]
    for t in texts:
        assert mine.encode(t).tolist() == sp.encode(t), t
    ids, n = mine.encode_all(texts)
    assert ids.tolist() == [i for t in texts for i in sp.encode(t)] and n.tolist() == [len(sp.encode(t)) for t in texts]


def test_sentencepiece_character_map_equals_the_library(tmp_path):
    """A published map of characters (compatibility forms, white space, marks that combine) in a hand-made model."""
    import sentencepiece

    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    size, n = b"", len(spec)
    while n:
        size, n = size + bytes([n & 127 | (128 if n > 127 else 0)]), n >> 7
    plain = _unigram_model({"▁": -3.0, **{c: -4.0 for c in "abfi1é가"}, "fi": -5.0, "▁a": -5.5}, True)
    path = tmp_path / "map.model"
    path.write_bytes(plain[: plain.rindex(bytes([3 << 3 | 2]) + bytes([len(plain) - plain.rindex(bytes([10, 8]) + b"identity")]))] + bytes([3 << 3 | 2]) + size + spec)
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_fst.Transducer(str(path))
    r = np.random.default_rng(5)
    odd = list("aeif \t\n\u3000\u0301\u0300ﬁ①ｱﾞé가\u1100\u1161\u200b\u00ad漢Å\u212b㌔")
    texts = ["", " ", "\u3000", "ﬁ ① ｱﾞ\u3000x\u200by", "e\u0301", "e", "\u0301", *["".join(r.choice(odd, int(r.integers(1, 30))).tolist()) for _ in range(150)]]
    for t in texts:
        assert mine.encode(t).tolist() == sp.encode(t), ascii(t)
    ids, n = mine.encode_all(texts)
    assert ids.tolist() == [i for t in texts for i in sp.encode(t)]


def test_sentencepiece_forgets_and_goes_on(monkeypatch):
    """Full tables of pairs and stretches are cleared without a change of results."""
    import sentencepiece

    monkeypatch.setattr(sentencepiece_fst, "PAIRS", 64)
    monkeypatch.setattr(sentencepiece_fst, "STRETCHES", 64)
    mine, sp = sentencepiece_fst.Transducer(tokenizer("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    r = np.random.default_rng(2)
    for _ in range(8):
        texts = [" ".join("".join(r.choice(list("etaoinshr"), int(r.integers(1, 9))).tolist()) for _ in range(40)) for _ in range(3)]
        ids, n = mine.encode_all(texts)
        assert ids.tolist() == [i for t in texts for i in sp.encode(t)] and mine.decode_all(ids.astype(np.int64), n) == texts


def test_sentencepiece_edge_cases(spark):
    path = tokenizer("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "Az" * 40_000, "x"), (1, "Az" * 40_000, "x"), (2, "", None), (None, None, None)], "doc_id long, text string, ids string")
    coded = sentencepiece_fst.encode(df, path)
    got = sentencepiece_fst.decode(coded, path).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (1, "Az" * 40_000), (1, "Az" * 40_000), (2, "")] and [r["text"] for r in got if r["doc_id"] is None] == [None]
    assert sentencepiece_fst.decode(sentencepiece_fst.encode(df.limit(0), path), path).count() == 0
    for call in (lambda: sentencepiece_fst.encode(df, path, carry=["ids"]), lambda: sentencepiece_fst.decode(coded.withColumnRenamed("doc_id", "text"), path, carry=["text"])):
        with pytest.raises(ValueError):
            call()


def test_chat_round_trip(spark):
    hard = ["", None, "</s>[INST] ok [/INST]", "~0~1 <|end|>\n<|turn|>x", "<", "[", "a\nb", "<|", "~", "é漢", "[/INS", "</"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, None, None, "x"), (2, None, None, "x"), (3, 1, "ro\nle~", "t"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.render(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    got = {r["conv_id"]: r for r in out.select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(hard)]
    assert got[1]["loss"] == "".join(t or "" for k, t in enumerate(hard) if k % 2)
    assert [(t["role"], t["text"]) for t in got[2]["back"]] == [("", "x")] * 2 and got[3]["back"][0]["role"] == "ro\nle~" and got[None]["n_turns"] == 1
    body = got[1]["formatted"]
    assert body.count("<|turn|>") == len(hard) and "</s>" not in body and "[INST]" not in body and "[/INST]" not in body
    assert chat_format.render(df.limit(0).withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_chat_ties_stand_as_they_were_before_escaping(spark):
    """Messages of one turn, by role and raw text, though escaping would order them otherwise; documents, audio and images beside text."""
    said = ["~", "</s>", "!", "<|end|>", "<a", "[INST]", "z", "", "\U0001f600"]
    df = spark.createDataFrame([(1, 0, role, t) for role in ("user", "assistant") for t in said] + [(1, None, "user", "first")], "conv_id long, turn long, role string, text string")
    out = chat_format.render(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    back = out.select(chat_format.read_back(F.col("formatted")).alias("b"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [(t["role"], t["text"]) for t in back["b"]] == [("user", "first")] + [(r, t) for r in ("assistant", "user") for t in sorted(said, key=str.encode)]
    assert back["l"] == "".join(sorted(said, key=str.encode))
    kinds = spark.sql(f"select 1L as conv_id, 0L as turn, 'user' as role, cast(array(named_struct('type','document','text',null,'ref','d','units',3L), named_struct('type','text','text','t','ref',null,'units',null), named_struct('type','audio','text',null,'ref','a','units',null)) as array<{chat_format.PART}>) as parts")
    r = chat_format.render(kinds).first()
    assert r["formatted"].startswith("<|turn|>user\n<|document:0|>t<|audio:2|>") and [a["type"] for a in r["attachments"]] == ["document", "audio"]
    assert r["expanded_tokens"] == 3 * chat_format.EXPANDS["document"] + chat_format.EXPANDS["audio"]


def test_chat_parts(spark):
    df = spark.sql(
        f"select 1L as conv_id, 0L as turn, 'user' as role, cast(array(named_struct('type','text','text','<','ref',null,'units',null), named_struct('type','image','text',null,'ref','s3://i','units',2L), "
        f"named_struct('type','text','text','|end|>','ref',null,'units',null), named_struct('type','audio','text',null,'ref','s3://a','units',10L), null) as array<{chat_format.PART}>) as parts"
    )
    r = chat_format.render(df).first()
    assert r["formatted"] == "<|turn|>user\n<~1<|image:1|>|end|><|audio:3|><|end|>\n"
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "s3://i", 512), (3, "audio", "s3://a", 250)] and r["expanded_tokens"] == 762


def test_lm_scores(spark):
    r = np.random.default_rng(0)
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    docs = [(k, " ".join(r.choice(a if k % 2 else b, 300).tolist()), None) for k in range(400)] + [(1000, None, None), (1001, "", None), (1002, "A1 neverseen", None), (None, "a1", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    got = {x["doc_id"]: x for x in lm_scoring.fit_and_score(df, held).collect()}
    train = [(t or "").lower().split() + ["\n"] for k, t, _ in docs if k is None or zlib.crc32(str(k).encode()) % 10]
    c = Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    for k, t, _ in docs:
        ws = (t or "").lower().split() + ["\n"]
        x = got[k]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(x["base_score"] - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6
    out = [got[k] for k, _, _ in docs[:400] if zlib.crc32(str(k).encode()) % 10 == 0]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out)


def test_lm_is_a_distribution(monkeypatch, spark):
    """Over all words seen and the unseen one of each class, probabilities sum to 1; also with few counts held, all of them ties."""
    monkeypatch.setattr(lm_scoring, "HELD", 200)
    monkeypatch.setattr(lm_scoring, "LEAST", 2)
    words = [f"w{k}" for k in range(900)]
    df = spark.createDataFrame([(k, " ".join(words[k % 50 :: 7] + words[:3])) for k in range(60)], "doc_id long, text string")
    counts, table, weights = lm_scoring.fit(df)
    rows = int(counts.ends[-1])
    assert 100 < len(counts.keys) < 300 and rows > lm_scoring.CLASSES
    model = lm_scoring.Model(rows, weights)
    codes = np.arange(lm_scoring.TOP + rows)
    for before in ([1, 2], [lm_scoring.TOP + rows - 1, lm_scoring.TOP + rows]):
        p = model.log10(counts, codes, np.tile(np.array(before)[:, None], (1, len(codes))))
        assert abs((10**p).sum() - 1) < 1e-4
    own = {int(h) for h, u in zip(counts.keys.view(np.int64), counts.code, strict=True) if u >= 0}
    mass = defaultdict(float)
    for x in table.collect():
        if x["h"] not in own:
            mass[x["kind"]] += (x["c"] + lm_scoring.ALPHA) / 10 ** counts.room[x["kind"]]
    for kind, m in mass.items():
        assert abs(m + lm_scoring.ALPHA / 10 ** counts.room[kind] - 1) < 1e-9
    assert lm_scoring.score(df, counts, table, weights).count() == 60 and lm_scoring.fit_and_score(df.limit(0), F.lit(False)).count() == 0


def test_lm_trains_on_every_token(spark, monkeypatch):
    """Each token of each text is a target once, none is left out; a block that is no whole number of steps among them."""
    texts = [" ".join(f"w{j * k % 97}" for j in range(k)) for k in range(1, 140)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, _ = lm_scoring.count(df)
    hashes, kind, first = lm_scoring._tokens(pa.array(texts))
    code = counts.look(hashes, kind)[1]
    trained = []
    monkeypatch.setattr(lm_scoring.Trainer, "step", lambda self, m, draw, code, unit, context: trained.append(np.vstack([code, context])))
    model = lm_scoring.Model.fresh(counts)
    lm_scoring.Trainer(counts).block(model, np.random.default_rng(0), np.split(code.astype("<u2"), first[1:-1]))
    want = np.vstack([code, lm_scoring._contexts(code, first, lm_scoring.TOP + model.rows)])
    got = np.hstack(trained)
    assert len(trained) > 1 and got.shape[1] == counts.tokens
    assert Counter(map(tuple, got.T.tolist())) == Counter(map(tuple, want.T.tolist()))


def test_lm_does_not_depend_on_partitions(spark, monkeypatch, data):
    """The same scores, whatever the partitioning, with several shards and rounds; repeated rows and a very long text among them; better than the base on held-out texts."""
    monkeypatch.setattr(lm_scoring, "SHARD", 20_000)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "word " * 30_000), (-2, "twice"), (-2, "twice"), (None, "x")], "doc_id long, text string")
    docs = docs.union(more)
    held = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    got = []
    for n in (2, 16):
        rows = lm_scoring.fit_and_score(docs.repartition(n), held).collect()
        got.append({r["doc_id"]: r for r in rows})
        assert len(rows) == docs.count()
    assert all(abs(r["score"] - got[1][k]["score"]) <= 1e-6 * abs(r["score"]) for k, r in got[0].items())
    out = [r for k, r in got[0].items() if k is not None and k % 10 == 0]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


HTML = [
    ("<p>a  b<p>c<br>d", "a b\n\nc\nd"),
    ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
    ("<table><tr><th>Name<th>N<tr><td>abcdef<td>1</table>", "Name    N\nabcdef  1"),
    ("<table><tr><td>日本<td>x<tr><td>abcdef<td>y</table>", "日本    x\nabcdef  y"),
    ("a<script>if(a<b){}</script>b<style>p{}</style><!-- no --> c", "ab c"),
    ("<div hidden>no</div><div style='display: none'>no</div><div>yes", "yes"),
    ("<pre>  k\n l</pre>end &amp; <b>bo</b>ld &lt;x&gt;", "  k\n l\n\nend & bold <x>"),
    ("<title>t</title><body><h1>H</h1>text<div>d1</div><div>d2</div>", "H\n\ntext\nd1\nd2"),
    ("", ""),
    ("plain < text > here", "plain < text > here"),
    ("<p>unclosed <b>tag", "unclosed tag"),
    ("<td>stray</td>", "stray"),
    ("<img alt='pic'> x", "pic x"),
    ("<p>one</div>two", "onetwo"),
]


@pytest.mark.parametrize(("source", "text"), HTML)
def test_html(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><thead><th>Name<th>N</thead><tbody><tr><td>abcdef<td>1</table>", "Name    N\nabcdef  1"),
        ("<table><tbody><td>a<td>b<tfoot><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tbody><tr><td>a</td></tr><td>b</td><tr><td>c</table>", "a\nb\nc"),
        ("<table><tbody><form><tr><td>a<td>b</tr><tr><td>c<td>d</tr></form></tbody></table>", "a  b\nc  d"),
        ("<form><table><tr><td>a</form><td>b</table>c</form>d", "a  b\n\nc\nd"),
        ("<table><tbody>stray<tr><td>a</tr> <b>bold</b><div>block<tr><td>c</table>", "stray\nbold\nblock\na\nc"),
        ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><colgroup><col>x<tr><td>a</table>", "x\na"),
        ("<table><tbody><tr><td>a<caption>top</table>", "top\na"),
        ("<table><tbody hidden>no<td>no</tbody><tbody><noscript><tr><td>no</noscript><td>a</table>", "a"),
        ("<table><tbody><td>a<table><tbody><td>b<td>c</table><td>d</table>", "a     d\n\nb  c"),
    ],
)
def test_html_table_sections(source, text):
    assert html_text.render(source) == text


SPANS = [
    ("<table><tr><td rowspan=2>aaaa<td>bb<tr><td>cc</table>", "aaaa  bb\n      cc"),
    ("<table><tr><td colspan=2>very wide spanning head<td>x<tr><td>a<td>b<td>y</table>", "very wide spanning head  x\na  b                     y"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td rowspan=3 colspan=2>ab<td>1<tr><td>2<tr><td>3<tr><td>x<td>y<td>4</table>", "ab    1\n      2\n      3\nx  y  4"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td colspan=x>a<td rowspan=-1>b<tr><td>cc<td>d</table>", "a   b\ncc  d"),
    ("<select><option>A<option>B</select> <svg><title>t</title><desc>d</desc><text>hey</text></svg><input value=Go type=submit><input type=hidden value=no>", "A\nB\nhey Go"),
    ("<a title=\"x>y\" b'>z</a> <a c = 'q>' d>w</a>", "z w"),
    ("a < b <3 c </ d> e <!-- x --> f <!--> g <? h > i <!x> j", "a < b <3 c e f g i j"),
    ("shown<a href='never ends", "shown"),
    ("<ul>" + "<li><ul>" * 60 + "<li>deep</ul>", "- " * 61 + "deep"),
    ("<table><tr><td>" * 12 + "a<td>b", "a  b"),
]


@pytest.mark.parametrize("source,text", SPANS)
def test_html_spans_forms_and_odd_tags(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    "source",
    ["<a" * 500_000, '<a "' * 200_000, "<" * 500_000, "<div>" * 100_000, "<p><object>" + "<div>" * 100_000, "<span>" * 100_000 + "</b>" * 100_000, "<ul><li>" + "<div>" * 50_000 + "<ul>" + "</li>" * 50_000,
     "<div>" * 50_000 + "<tr>" * 50_000, "<table>" + "".join(f"<tr><td rowspan={k}>" for k in range(5000)), "<table><tr>" + "<td colspan=1000 rowspan=2>a" * 3000, "<script>" * 100_000, "<!--" * 200_000, "&" * 500_000],
    ids=range(13),
)
def test_html_takes_time_in_proportion(source):
    """Pages on which a search or a match could go over the same text again and again: a tenth of a page takes at least a thirtieth of its time."""
    import time

    def took(x):
        begun = time.process_time()
        html_text.render(x)
        return time.process_time() - begun

    cut = max(len(source) // 10, 1)
    assert took(source) < 30 * max(took(source[:cut]), 0.02)


@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "<td rowspan=2>", "<td colspan=3>", "</table>", "<span hidden>", "</span>", "<!-- c -->", "w1", "w2", " "]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_html_shows_all_visible_text(parts):
    """Against the standard library's parser, which knows nothing of layout: the same words, whatever the nesting, where nothing is hidden."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_data(self, data):
            self.found += data.split()

    source = " ".join(p for p in parts if p not in ("<span hidden>", "</span>"))
    own = Words()
    own.feed(source)
    own.close()
    assert Counter(html_text.render(source).split()) == Counter(x for x in own.found) + Counter({"-": html_text.render(source).split().count("-")})
    hidden = html_text.render("<div>a" + source + "</div>").split()
    assert "a" in " ".join(hidden)


def test_html_edge_cases(spark):
    df = spark.createDataFrame([(1, "<p>" + "word " * 300_000, "x"), (2, "", "y"), (2, "", "y"), (None, None, None)], "page_id long, html string, url string")
    got = html_text.extract(df, carry=["page_id", "url"]).collect()
    assert sorted((r["page_id"] or 0, None if r["text"] is None else len(r["text"].split())) for r in got) == [(0, None), (1, 300_000), (2, 0), (2, 0)]
    assert html_text.extract(df.limit(0)).count() == 0 and html_text.extract(df.limit(0)).columns == ["page_id", "text"]
    with pytest.raises(ValueError):
        html_text.extract(df.withColumnRenamed("url", "text"), carry=["page_id", "text"])


def test_html_operator(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    df = spark.createDataFrame([(1, "<p>a", "u"), (None, None, "u"), (2, deep, None), (1, "<p>a", "u"), (3, "<ul><li>" * 200 + "y", None)], "page_id long, html string, text string")
    got = html_text.extract(df).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["a", "a"] and [r["text"] for r in got if r["page_id"] == 2] == ["x"] and [r["text"] for r in got if r["page_id"] is None] == [None]
    assert "y" in next(r["text"] for r in got if r["page_id"] == 3)


@given(st.text(alphabet="<>/abliptd \"'=!-&;", max_size=80))
@settings(max_examples=200, deadline=None)
def test_html_never_fails(source):
    html_text.render(source)


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, data)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
