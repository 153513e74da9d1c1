import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gannet.functions import derive, globs, metadata, templates, values


@pytest.mark.parametrize(
    ("pattern", "key", "expected"),
    [
        ("**/*.txt", "file.txt", True),
        ("**/*.txt", "a/b/file.txt", True),
        ("*.txt", "a/file.txt", False),
        ("data/**/*.parquet", "data/x.parquet", True),
        ("data/**/*.parquet", "logs/x.parquet", False),
        ("data/**", "data", True),
        ("data/**", "data\\file.txt", False),
        ("**", "", True),
        ("a?c", "a/c", False),
        ("a[0-9]b", "a5b", True),
        ("a[!0-9]b", "a5b", False),
        ("a[!0-9]b", "a/b", False),
        ("{x,y}/*.csv", "y/1.csv", True),
        ("f\\*.txt", "f*.txt", True),
        ("f\\*.txt", "fx.txt", False),
        ("a.b", "axb", False),
        ("a**b", "a/b", False),
        ("**/_temporary/**", "data/_temporary/file.txt", True),
    ],
)
def test_glob(pattern, key, expected):
    assert bool(re.search(globs.to_regex(pattern), key)) is expected


@pytest.mark.parametrize(
    ("pattern", "prefix"),
    [("data/*.json", "data/"), ("exact/file.txt", "exact/file.txt"), ("**/x", ""), ("data/2024-*/*.csv", "data/"), ("data\\2024\\**\\*.csv", "data/"), ("data\\2024\\subdir\\**", "data/2024/"), ("data\\2024\\subdir/**", "data/2024/subdir/"), ("data/file\\*/logs/*.log", "data/file*/logs/"), ("data/\\[2024\\]/**/*.csv", "data/[2024]/"), ("", "")],
)
def test_prefix(pattern, prefix):
    assert globs.literal_prefix(pattern) == prefix


def test_prefixes_are_subsumed():
    assert globs.literal_prefixes(["data/**", "data/2024/**", "b/**"]) == ["b/", "data/"]
    assert globs.literal_prefixes(["data/2024/**", "**/*.json"]) == [""]
    with pytest.raises(globs.GlobError):
        globs.to_regex("a[b")
    with pytest.raises(globs.GlobError):
        globs.to_regex("{a,b")


def test_sizes():
    assert [values.parse_size(x) for x in ("10", "1.5KiB", " 3 kb", "2gi", "1T")] == [10, 1536, 3000, 2 * 1024**3, 10**12]
    for bad in ("", "x", "5 zb", "-1", "99999999999999999999"):
        with pytest.raises(ValueError):
            values.parse_size(bad)


def test_dates_and_layouts(spark):
    assert values.parse_date("2024-01-02") == datetime(2024, 1, 2, tzinfo=UTC)
    assert values.parse_date("2024-01-02T03:04:05.5+01:00") == datetime(2024, 1, 2, 2, 4, 5, 500000, tzinfo=UTC)
    with pytest.raises(ValueError):
        values.parse_date("soon")
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("nonsense",), (None,)], "t string")
    assert [r[0] is None for r in df.select(values.timestamp(F.col("t"))).collect()] == [False, True, True]
    assert df.select(values.bad_timestamps(F.col("t"))).first()[0] == 1
    assert values.date_pattern("2006-01-02 at 15:04") == "yyyy-MM-dd' at 'HH:mm"


def test_column_values(spark):
    df = spark.createDataFrame([("1.5KiB", 'W/"abc"', 1536), ("99999999999999999999", '"abc-12"', 256), (None, None, None), ("x", "", 5 * 1024**4)], "s string, e string, n long")
    got = df.select(values.size_of(F.col("s")), values.etag(F.col("e")), values.is_multipart(F.col("e")), values.format_size(F.col("n"))).collect()
    assert [r[0] for r in got] == [1536, None, None, None]
    assert [r[1] for r in got] == ["abc", "abc-12", None, ""]
    assert [r[2] for r in got] == [False, True, False, False]
    assert [r[3] for r in got] == ["1.5KiB", "256B", None, "5.0TiB"]


def test_derive(spark):
    df = spark.createDataFrame([("abcdef", '{"a": {"b": [{"c": 5}]}}', "<r><t>x</t><t>y</t></r>"), ("ab", "bad", "<r><t></t></r>"), (None, None, None)], "v string, j string, x string")
    v = F.col("v")
    got = df.select(
        derive.substring(v, 1, 4).alias("sub"), derive.pad(v, 4).alias("pad"), derive.regex_capture(v, "a(b)c").alias("cap"), derive.json_path(F.col("j"), "a.b[0].c").alias("j"), derive.xml_path(F.col("x"), "//t").alias("x"),
        derive.lookup(v, [("exact", "ab", "1"), ("prefix", "ab", "2")], "0").alias("l"),
    ).collect()
    assert [r["sub"] for r in got] == ["bcd", None, None]
    assert [r["pad"] for r in got] == ["abcdef", "00ab", None]
    assert [r["cap"] for r in got] == ["b", None, None]
    assert [r["j"] for r in got] == ["5", None, None]
    assert [r["x"] for r in got] == ["x", None, None]
    assert [r["l"] for r in got] == ["2", "1", "0"]
    with pytest.raises(ValueError):
        derive.check_regex("(?=x)")
    out, fails, routing = derive.route({"a": v}, {"a": "quarantine"})
    assert [tuple(r) for r in df.select(out["a"], fails, routing).collect()][2] == ("_unresolved", False, "quarantine")


def test_templates(spark):
    df = spark.createDataFrame([("s1/x-2024/f.txt",), ("other",), (None,)], "k string")
    k = F.col("k")
    r = templates.Rewrite("{site}/x-{day}/{_}", "/{day}//{site}/")
    got = df.select(r.render(k), templates.path("{filename}-{dir[1]}", k), templates.shard_value(k), templates.quarantine_key("q/", F.lit("why"), k)).collect()
    assert [x[0] for x in got] == ["2024/s1", None, None]
    assert [x[1] for x in got] == ["f.txt-x-2024", None, None]
    assert got[2][2] == "_empty"
    assert got[0][3] == "q/why/s1/x-2024/f.txt"


def test_metadata(spark):
    df = spark.sql("select map('site', 'A%20B', 'doc', '{\"k\": 1}') as m, 'key1' as key")
    sys = {"key": F.col("key")}
    got = df.select(*[metadata.expression(t, F.col("m"), sys) for t in ("urldecode(meta.site)", "meta.doc.k", "'x' + sys.key", "meta.none")]).first()
    assert tuple(got) == ("A B", "1", "xkey1", None)
    for bad in ("a+b+c", "env.x", "sys.none"):
        with pytest.raises(ValueError):
            metadata.expression(bad, F.col("m"), sys)
    got = df.select(metadata.apply_policy(F.col("m"), "merge", {"site": F.lit("S")}), metadata.apply_policy(F.col("m"), "clear", {})).first()
    assert got[0]["site"] == "S" and "doc" in got[0] and got[1] == {}


def test_restore(spark):
    df = spark.createDataFrame([('ongoing-request="true"',), ('ongoing-request="false", expiry-date="Fri, 21 Dec 2012 00:00:00 GMT"',), ("?",), (None,)], "h string")
    got = [r[0] for r in df.select(values.restore_state(F.col("h"), F.lit("2020-01-01").cast("timestamp"))).collect()]
    assert got == ["ongoing", "expired", "unknown", None]
