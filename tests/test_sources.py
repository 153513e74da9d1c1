import json

import pytest
from pyspark.sql import functions as F

from gannet.operators import delta, merge, rollup
from gannet.operators import query as Q
from gannet.sources import heads, listing, records
from gannet.sources.storage import StaleParent, Store, resolve
from gannet.streaming import merge as stream

ROWS = "rel_key string, size_bytes long, etag string, deleted_at timestamp_ntz"


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(f"k{n:04d}", n, f"e{n % 7}", None) for n in range(100)], ROWS)
    first = store.publish(df, "r1")
    assert (first["row_count"], first["distinct_etags"]) == (100, 7) and store.latest() == "r1"
    with pytest.raises(StaleParent):
        store.publish(df, "r2")
    store.publish(df.limit(10), "r2", "r1", segment_rows=3)
    assert store.read().count() == 10 and store.read("r1", verify=True).count() == 100
    with pytest.raises(ValueError):
        store.publish(df.union(df), "r3", "r2")
    assert store.latest() == "r2"
    with pytest.raises(ValueError):
        store.read("r3")
    other = Store(spark, str(tmp_path / "hub"))
    store.copy_to(other, "r1")
    assert Q.count(other.read().withColumn("last_modified", F.lit(None).cast("timestamp_ntz")), Q.Query(min_size=50)).first()[0] == 50


def test_resolve(spark):
    sets = spark.createDataFrame([("idx_abc1", "s3://x"), ("idx_abd2", "s3://y")], "index_set_id string, base_uri string")
    assert resolve(sets, "s3://x") == "idx_abc1" and resolve(sets, "abd") == "idx_abd2"
    for bad in ("ab", "zzz"):
        with pytest.raises(ValueError):
            resolve(sets, bad)


def test_records(spark, tmp_path):
    df = spark.createDataFrame([("s3://b/k", 5), ("s3://b/l", None)], "source_uri string, size long")
    records.write_lines(records.envelope(df, "object", "j1", "s3"), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).union(spark.createDataFrame([('{"source_uri": "s3://b/m"}',), ("s3://b/n",), ("{broken",), ("",)], "value string"))
    good, bad = records.parse_lines(lines, "source_uri string, size long")
    assert sorted((r["source_uri"], r["record_type"]) for r in good.collect()) == [("s3://b/k", "object"), ("s3://b/l", "object"), ("s3://b/m", None), ("s3://b/n", None)]
    assert [r["value"] for r in bad.collect()] == ["{broken"]


def test_journals(spark, tmp_path):
    def lines(j, ns, told):
        return [json.dumps({"kind": "header", "journal_id": j})] + [json.dumps({"kind": "record", "journal_id": j, "sequence": n, "rel_key": "k"}) for n in ns] + [json.dumps({"kind": "footer", "journal_id": j, "records": told})] * (told is not None)

    (tmp_path / "a.jsonl").write_text("\n".join(lines("good", [1, 2], 2) + lines("gap", [1, 3], 2) + lines("short", [1], 2) + lines("open", [1], None)))
    body, bad = records.read_journal(spark, str(tmp_path), "rel_key string")
    assert body.count() == 6
    assert {r["journal_id"]: r["problem"] for r in bad.collect()} == {"gap": "broken sequence", "short": "wrong count", "open": "no footer"}


def test_frames_and_uris():
    made = list(records.frames("x", [b"ab", b"", b"c"]))
    assert b"".join(records.unframe(made)) == b"abc"
    for bad in (made[:-1], [made[0], made[2], made[1], made[3], made[4]], made[1:]):
        with pytest.raises(ValueError):
            list(records.unframe(bad))
    u = records.parse_uri("s3://bucket/a/b/*.csv")
    assert (u.bucket, u.key, u.pattern, u.prefix) == ("bucket", "a/b", "a/b/*.csv", "a/b/")
    assert records.parse_uri("file:///x/y").key == "/x/y"
    with pytest.raises(ValueError):
        records.parse_uri("http://x")


def test_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.txt").write_text("hello")
    (tmp_path / "g.csv").write_text("x")
    assert {r["size_bytes"] for r in listing.list_files(spark, str(tmp_path)).collect()} == {5, 1}
    assert bytes(listing.head_bytes(spark, str(tmp_path / "a"), 2).first()["head"]) == b"he"
    spark.dataSource.register(listing.PrefixSource)
    got = spark.read.format("prefix_listing").option("root", str(tmp_path)).option("prefixes", "a,none,../..").load().collect()
    assert {(r["prefix"], r["key"], r["error"]) for r in got} == {("a", "a/f.txt", None), ("none", None, "not_found"), ("../..", None, "access_denied")}


def test_heads(spark, tmp_path):
    """Files, what stands beside them, and classes of failure, through to an enriched table and a crawl's summary."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"hello")
    (tmp_path / "d" / "a.bin.meta.json").write_text('{"content_type": "a/b", "storage_class": "COLD", "user_metadata": {"k": "v"}}')
    (tmp_path / "d" / "b.bin").write_bytes(b"xy")
    (tmp_path / "d" / "b.bin.meta.json").write_text("no json")
    keys = spark.createDataFrame([("d/a.bin",), ("d/none",), ("d",), ("../../etc/passwd",), ("d/b.bin",), (None,)], "rel_key string")
    found = heads.heads(keys, str(tmp_path), first=2)
    got = {r["rel_key"]: r for r in found.collect()}
    a = got["d/a.bin"]
    assert (a["size_bytes"], a["content_type"], a["storage_class"], a["metadata"], bytes(a["head"]), len(a["etag"])) == (5, "a/b", "COLD", {"k": "v"}, b"he", 64)
    assert {k: got[k]["error"] for k in ("d/none", "d", "../../etc/passwd", "d/b.bin", None)} == {"d/none": "not_found", "d": "not_found", "../../etc/passwd": "access_denied", "d/b.bin": "provider_error", None: "not_found"}
    assert {r["error"]: r["keys"] for r in heads.failures(found).collect()} == {"not_found": 3, "access_denied": 1, "provider_error": 1}
    rows = keys.withColumns({c: F.lit(None).cast(t) for c, t in (("archive_status", "string"), ("restore_state", "string"), ("restore_expiry", "timestamp_ntz"), ("content_type", "string"), ("head_enriched_at", "timestamp_ntz"))})
    assert {r["rel_key"]: r["content_type"] for r in merge.enrich(rows, heads.enrichment(found)).where("head_enriched_at is not null").collect()} == {"d/a.bin": "a/b"}
    summary = rollup.crawl_summary(found, F.col("rel_key").endswith(".bin"), F.col("error")).first()
    assert (summary["listed"], summary["matched"], summary["bytes"], summary["errors"]) == (1, 1, 5, 5)
    assert heads.heads(keys.limit(0), str(tmp_path)).count() == 0


def test_publishing_by_turns(spark, tmp_path):
    """Two writers from one parent: one gets the turn. Segments tell what they hold; garbage is collected by runs."""
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(10).select(F.concat(F.lit("k"), F.col("id")).alias("rel_key"), F.lit("e").alias("etag"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    first = store.publish(rows, "r1", facts={"index_set_id": "s"}, segment_rows=4)
    assert sum(x["rows"] for x in first["segments"]) == 10 and all(x["rows"] <= 4 and len(x["sha256"]) == 64 for x in first["segments"])
    assert [x["min_key"] for x in first["segments"]] == sorted(x["min_key"] for x in first["segments"]) and first["index_set_id"] == "s"
    late = Store(spark, store.root)
    seen = late._turns
    late_turns = seen()
    store.publish(rows, "r2", "r1", segment_rows=4)
    object.__setattr__(late, "_turns", lambda: late_turns)
    object.__setattr__(late, "latest", lambda: "r1")
    with pytest.raises(StaleParent):
        late.publish(rows, "r3", "r1")
    assert store.latest() == "r2" and store.runs() == ["r1", "r2"]
    twice = spark.createDataFrame([("a", 1), ("a", 1)], "rel_key string, n int")
    assert Store._digest(twice) != Store._digest(twice.limit(0)) and Store._digest(rows) == Store._digest(rows.orderBy(F.desc("rel_key")))
    part = next((tmp_path / "s" / "r2" / "segments").glob("*.parquet"))
    assert store.read("r2", verify=True).count() == 10
    assert store.collect_garbage(1) == ["r1"] and store.read().count() == 10
    part.unlink()
    with pytest.raises(ValueError):
        store.read("r2", verify=True)


def test_ordered_digest(spark):
    rows = spark.createDataFrame([("b", 2, None, None), ("a<", 1, "2024-01-01 10:00:00.5", "C")], "rel_key string, size_bytes long, last_modified string, storage_class string").withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz"))
    import hashlib

    lines = b'{"rel_key":"a\\u003c","size_bytes":1,"last_modified":"2024-01-01T10:00:00.5Z","storage_class":"C"}\n{"rel_key":"b","size_bytes":2}\n'
    assert delta.ordered_digest(rows) == hashlib.sha256(lines).hexdigest() == delta.ordered_digest(rows.orderBy(F.desc("rel_key")))


def test_stream_merge(spark, tmp_path):
    schema = "rel_key string, journal_id string, sequence long, size_bytes long"
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "state"))
    for n, rows in enumerate(([("a", "j1", 2, 20), ("b", "j1", 1, 1)], [("a", "j1", 1, 10), ("b", "j2", 1, 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream.start(stream.read_events(spark, str(folder), schema), store, str(tmp_path / "ckpt"), ("size_bytes",)).awaitTermination()
        assert store.latest() == f"batch-{n:012d}"
    assert {r["rel_key"]: r["size_bytes"] for r in store.read().collect()} == {"a": 20, "b": 9}


def test_windowed_counts(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert stream.windowed_counts(events).agg(F.sum("events")).first()[0] == events.count()
