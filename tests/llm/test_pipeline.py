"""The pipeline's stages one after the other against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from test_dedup import _classes, _texts
from test_filters import brute

from gannet.llm import toxicity
from gannet.llm.common import table
from gannet.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, folder, rows):
    spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    marked = [(k, 0, int("zuq" in (t or ""))) for k, t in rows if k is not None and k % 2]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def _rows():
    r = np.random.default_rng(8)
    rows = list(_texts().items())
    rows += [(5000 + k, " ".join(["".join(r.choice(list("mnopqrst"), 6).tolist()) for _ in range(40)] + ["zuq" + "".join(r.choice(list("aeiou"), 3).tolist()) for _ in range(8)])) for k in range(60)]
    rows += [(6000, "the same words again and again " * 40), (6001, ""), (6002, None), (6003, "few words"), (None, rows[0][1]), (None, None), (rows[3][0], rows[3][1])]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    """Nulls, empty texts, a repeated row, copies and toxic texts: what each stage keeps, row by row, and the ids of the last."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    folder, rows = str(tmp_path / "in"), _rows()
    _write(spark, folder, rows)
    docs = table(spark, folder, "documents")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert name == ("toxicity", "quality_rules", "near_dedup", "packing")[k]
        if k == 3:
            break
        assert out.columns == before.columns
        out.write.parquet(str(tmp_path / str(k)))
        was, out = [(r["doc_id"], r["text"]) for r in docs.collect()], spark.read.parquet(str(tmp_path / str(k)))
        now = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        if k == 0:
            model = toxicity.fit(docs, table(spark, folder, "labels"))
            bad = model.score(pa.array([t for _, t in was])) >= 0.5
            expected = [x for x, b in zip(was, bad, strict=True) if not b]
            assert 40 < bad.sum() < 80
        elif k == 1:
            expected = [x for x in was if brute(x[1])[-1]]
        else:
            own = _classes(dict((i, t) for i, t in was if i is not None))
            expected = [x for x in dict.fromkeys(was) if x[0] is not None and own[x[0]] == x[0]] + [x for x in was if x[0] is None]
        assert now == sorted(expected, key=str) and len(now) < len(was)
        docs = out
    model = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = out.collect()
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]:
        ids = [*model.encode(t, add_special_tokens=False).ids, 1]
        mine = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]))
        assert mine == np.array(ids, dtype="<u4").tobytes()


def test_run_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("extra", ["row", "id", "kept", "map_hit", "__row"])
def test_filters_keep_columns_of_any_name(spark, extra):
    from gannet.llm import near_dedup, quality_rules

    df = spark.createDataFrame([(1, "a b c d e f g h i j k l", 1), (2, "a b c d e f g h i j k l", 2), (3, None, 3)], f"doc_id long, text string, {extra} int")
    assert [tuple(r) for r in near_dedup.keep(df).orderBy("doc_id").collect()] == [(1, "a b c d e f g h i j k l", 1), (3, None, 3)]
    assert quality_rules.keep(df).columns == df.columns
