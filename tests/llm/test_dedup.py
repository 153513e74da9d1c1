import numpy as np

from gannet.llm import components, embedding_dedup, license_scan, near_dedup


def test_dart_collisions_match_weighted_jaccard():
    r = np.random.default_rng(5)
    a = r.integers(1, 1 << 60, 300, dtype=np.uint64)
    w1, w2 = r.integers(1, 5, 300).astype(float), r.integers(0, 4, 300).astype(float)
    expected = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    hit = w2 > 0
    k = 2048
    sig = near_dedup.signatures(np.concatenate([a, a[hit]]), np.concatenate([w1, w2[hit]]), np.repeat([0, 1], [300, hit.sum()]), 3, k)
    assert abs((sig[0] == sig[1]).mean() - expected) < 0.04 and not sig[2].any()
    assert (sig[:2] != 0).all()
    tiny = near_dedup.signatures(a[:1], np.ones(1), np.zeros(1, int), 1, k)
    assert (near_dedup.signatures(a[:1], np.ones(1), np.zeros(1, int), 1, k) == tiny).all()


def _texts():
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    base = [[word() for _ in range(r.integers(40, 120))] for _ in range(25)]
    passage = [word() for _ in range(30)]
    out = {}
    for k, b in enumerate(base):
        b = b + passage
        out[k * 10] = " ".join(b)
        out[k * 10 + 1] = "  ".join(b)
        for c in range(2, 2 + k % 6):
            x = list(b)
            for _ in range(c):
                x[int(r.integers(0, len(x)))] = word()
            out[k * 10 + c] = " ".join(x)
    return out


def _classes(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ks}


def test_near_duplicates_against_brute_force(spark):
    texts = _texts() | {9000: None, 9001: "", 9002: " \n", 9003: "a b", 9004: "a  b", 9005: "b a"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(None, "a b", "x"), (20, texts[20], "again")], "doc_id long, text string, class_id string")
    got = near_dedup.classes(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == _classes(texts)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None) and len(got) == len(texts) + 1
    kept = near_dedup.keep(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(_classes(texts).values())) and ids.count(None) == 1
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_mixed_buckets_lose_no_link(spark, monkeypatch):
    """With one-coordinate bands all kinds of texts meet, so that the comparison across components has work to do."""
    monkeypatch.setattr(near_dedup, "BANDS", 12)
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    texts = {k: t for k, t in _texts().items() if k < 120}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()} == _classes(texts)


def test_weights_decide_links(spark):
    """weighting="count" signs and verifies by how often shingles occur: texts of one set of shingles can be far apart, and the other way round."""
    from collections import Counter

    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    texts = {}
    for k in range(30):
        unit, tail = [word() for _ in range(6)], [word() for _ in range(40)]
        for c, n in enumerate((1, 2, 12, 13)):
            texts[10 * k + c] = " ".join(unit * n + tail)
    bags = {k: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for k, w in ((k, t.split()) for k, t in texts.items())}
    ks, root = sorted(bags), {}
    for a in ks:
        root[a] = min([root[b] for b in ks if b < a and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())], default=a)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(df, weighting="count").collect()}
    assert got == root and root[2] != root[0] and root[3] == root[2]
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.classes(df).collect()} == _classes(texts) != got


def test_very_long_texts_and_blocks(spark, monkeypatch):
    """Whole texts count, and leaders' texts and buckets dealt to many blocks lose no link."""
    monkeypatch.setattr(near_dedup, "LED", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    r = np.random.default_rng(9)
    long = [str(x) for x in r.integers(0, 10**6, 60_000)]
    base = [str(x) for x in r.integers(0, 10**6, 100)]
    texts = {1: " ".join(long), 2: " ".join([*long[:50_000], "changed", *long[50_001:]]), 3: " ".join([*long[:30_000], *map(str, range(30_000))])}
    for k in range(40):  # a group in which many are as far as 0.7 to 0.85 from each other
        own = list(base)
        for at in r.choice(100, 2, replace=False):
            own[at] = f"w{k}-{at}"
        texts[100 + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.classes(df).collect()} == _classes(texts)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (500, 500), (129, 300), (None, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    expected = {k: 0 for k in range(41)} | {k: 100 for k in [*range(100, 130), 300]} | {500: 500}
    got = [(r["id"], r["component"]) for r in components.connected(df).collect()]
    assert dict(got) == expected and len(got) == len(expected)
    assert components.connected(df.limit(0)).count() == 0


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 16))
    x = np.concatenate([centres[k % 12] + 0.25 * r.standard_normal((1, 16)) * (0.3 + k % 5) for k in range(400)]).astype(np.float32)
    x[10], x[20] = x[4], x[4]
    rows = [(k, x[k].tolist(), k % 3 if k % 50 else None) for k in range(400)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, [1.0], 1), (505, [], 1), (None, x[1].tolist(), 1), (506, [2.0], 1)]
    df = spark.createDataFrame([(*row, "x") for row in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r["vec_id"]: r for r in embedding_dedup.link(df, block_bytes=16 * 16 * 8).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    label = np.array([-k - 1 if row[2] is None else row[2] for k, row in enumerate(rows[:400])])
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    root = list(range(400))
    for i in range(400):
        todo = [i]
        while root[i] == i and todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j > i and root[j] == j:
                    root[j] = i
                    todo.append(j)
    assert near.sum() > 100
    for k in range(400):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (near[k].sum(), root[k], root[k] == k)
    assert all((got[k]["n_links"], got[k]["component_id"]) == (0, k) for k in (500, 501, 502, 503, 505)) and got[504]["n_links"] == 1 and got[506]["component_id"] == 504
    assert got[None]["component_id"] is None and got[None]["kept"] and len(got) == 408
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_licences(spark):
    t = license_scan.TEMPLATES
    long = " ".join(f"w{k}" for k in range(3000))
    edited = t["mit-grant"].replace("merge", "join")
    given = {1: long + "\n" + t["mit-grant"] + "\n" + long, 2: t["cc-by-nc-4.0"].upper(), 3: None, 4: "", 5: "the mit license", 6: edited + " x", 7: "Released under the\n MIT license!", 8: long, 9: t["gpl-3.0"][: len(t["gpl-3.0"]) // 2]}
    df = spark.createDataFrame([(k, x, "x") for k, x in given.items()] + [(None, t["mit-line"], "x"), (2, given[2], "x")], "doc_id long, text string, template string")
    got = {(r["doc_id"], r["template"]): r for r in license_scan.scan(df).collect()}
    assert set(got) == {(1, "mit-grant"), (2, "cc-by-nc-4.0"), (6, "mit-grant"), (7, "mit-line"), (None, "mit-line")}
    assert got[1, "mit-grant"]["containment"] == 1 and 0.8 <= got[6, "mit-grant"]["containment"] < 1
    r = got[1, "mit-grant"]
    assert r["first_word"] <= 3000 < r["first_word"] + r["n_words"]
    assert license_scan.scan(df.limit(0)).count() == 0 and license_scan.scan(df, {"short": "too short"}).count() == 0


def test_licences_of_rows_that_share_an_id(spark):
    """Other texts of an id, alike in part at the same place, don't hide the one that holds the licence."""
    whole = license_scan.TEMPLATES["mit-grant"]
    ws = whole.split()
    part = [" ".join(ws[: 20 + k] + [f"x{k}{j}" for j in range(len(ws) - 20 - k)]) for k in range(12)]
    rows = [(i, t) for i in (1, 2, 3, None) for t in [*part, whole, *part]]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("template = 'mit-grant'").collect()
    assert sorted((r["doc_id"] or 0, r["containment"], r["first_word"]) for r in got) == [(k, 1.0, 0) for k in range(4)]


def test_every_template_is_found_in_any_place(spark):
    r = np.random.default_rng(4)
    rows = []
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        for j in range(4):
            pad = lambda n: " ".join(f"p{x}" for x in r.integers(0, 10**6, n))
            rows.append((k * 10 + j, f"{pad(int(r.integers(0, 200)))} {text} {pad(int(r.integers(0, 200)))}", name))
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    found = license_scan.scan(df).join(df.select("doc_id", "name"), "doc_id").where("template = name and containment = 1")
    assert found.count() == len(rows)


def test_native_operators_use_no_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
