from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gannet.operators import delta, merge, predicates, reflow, retention, rollup
from gannet.operators import query as Q
from gannet.plans import partition, scope

STATE = "rel_key string, size_bytes long, etag string, storage_class string, last_modified timestamp_ntz, deleted_at timestamp_ntz"


def rows(spark, *given):
    full = [(k, s, e, c, None if m is None else datetime.fromisoformat(m), None if d is None else datetime.fromisoformat(d)) for k, s, e, c, m, d in given]
    return spark.createDataFrame(full, STATE)


@pytest.fixture(scope="module")
def inv(spark):
    return rows(
        spark,
        ("a/1.txt", 10, "e1", "STANDARD", "2024-01-01", None),
        ("a/2.txt", 20, "e1", None, None, None),
        ("b/.h/3.txt", 30, None, "GLACIER", "2024-01-03", None),
        ("b/4.csv", 40, "", "", "2024-01-02", "2024-02-01"),
        ("top", 50, "e2", "STANDARD", "2024-01-05", None),
    )


def keys(df):
    return [r["rel_key"] for r in df.collect()]


def test_query(inv):
    assert keys(Q.run(inv, Q.Query(pattern="a/**"))) == ["a/1.txt", "a/2.txt"]
    assert keys(Q.run(inv, Q.Query(after="2024-01-01", before="2024-01-03"))) == ["a/1.txt", "b/.h/3.txt"]
    assert keys(Q.run(inv, Q.Query(storage_classes=("", "STANDARD"), limit=1))) == ["a/1.txt"]
    assert keys(Q.run(inv, Q.Query(include_deleted=True, min_size=40))) == ["b/4.csv", "top"]
    assert Q.count(inv, Q.Query(limit=1)).first()[0] == 4
    assert keys(inv.where(predicates.match(F.col("rel_key"), ["**/*.txt"])).orderBy("rel_key")) == ["a/1.txt", "a/2.txt"]
    assert keys(inv.where(predicates.modified_listing(F.col("last_modified"), None, "2024-01-03")).orderBy("rel_key")) == ["a/1.txt", "b/4.csv"]
    with pytest.raises(ValueError):
        predicates.content_type("text/plain")


def test_glob_prefix_reaches_the_scan(spark, inv, tmp_path):
    inv.write.parquet(str(tmp_path / "inv"))
    df = spark.read.parquet(str(tmp_path / "inv")).where(predicates.glob(F.col("rel_key"), "a/*.txt"))
    plan = df._jdf.queryExecution().toString()
    assert "StringStartsWith(rel_key,a/)" in plan


def test_canonical(inv):
    got = {r["rel_key"]: (r["copies"], r["alternates"]) for r in Q.canonical(inv, "max_modified").collect()}
    assert got["a/1.txt"] == (2, ["a/2.txt"]) and got["b/4.csv"] == (1, []) and len(got) == 4
    assert keys(Q.canonical(inv, "min_key", limit=2)) == ["a/1.txt", "b/.h/3.txt"]


def test_merge_round(spark, inv):
    lineage = inv.withColumns({c: F.lit("r0") if c.endswith("id") else F.lit("2024-01-01").cast("timestamp_ntz") for c in ("first_seen_run_id", "first_seen_at", "last_changed_run_id", "last_changed_at", "last_seen_run_id", "last_seen_at")})
    seen = rows(spark, ("a/1.txt", 10, "e1", "STANDARD", "2024-01-01", None), ("a/2.txt", 21, "e1", None, None, None), ("new", 1, None, None, None, None), ("b/4.csv", 40, "", "", "2024-01-02", None)).drop("deleted_at")
    out = {r["rel_key"]: r for r in merge.upsert(lineage, seen, "r1", "2024-03-01").collect()}
    assert out["a/1.txt"]["last_changed_run_id"] == "r0" and out["a/1.txt"]["last_seen_run_id"] == "r1"
    assert out["a/2.txt"]["last_changed_run_id"] == "r1" and out["new"]["first_seen_run_id"] == "r1"
    assert out["b/4.csv"]["deleted_at"] is None and out["b/4.csv"]["last_changed_run_id"] == "r1"
    after = merge.upsert(lineage, seen, "r1", "2024-03-01")
    gone = merge.soft_delete(after, "r1", "2024-03-01").where("deleted_at is not null")
    assert sorted(keys(gone)) == ["b/.h/3.txt", "top"]
    assert merge.soft_delete(after, "r1", "2024-03-01", run_succeeded=False).where("deleted_at is not null").count() == 0


def test_coverage(spark, inv):
    cover = spark.createDataFrame([("a", "confirmed", True, False, []), ("b", "inferred", True, False, ["a/2.txt"])], "scope string, basis string, complete boolean, windowed boolean, gaps array<string>")
    got = {r["rel_key"]: r["covered"] for r in predicates.covered(inv, cover).collect()}
    assert got == {"a/1.txt": True, "a/2.txt": False, "b/.h/3.txt": False, "b/4.csv": False, "top": False}
    root = spark.createDataFrame([(".", "confirmed", True, False, [])], cover.schema)
    assert predicates.covered(inv, root).where("covered").count() == 5
    none = inv.limit(0)
    assert sorted(keys(merge.tombstones(inv, none, cover, "2024-05-01").where("deleted_at = timestamp_ntz'2024-05-01'"))) == ["a/1.txt"]


@pytest.mark.parametrize("compiled", [1000, 0])
def test_coverage_rules(spark, monkeypatch, compiled):
    """Gaps of any entry count and an entry with one attests nothing; compiled and joined alike."""
    monkeypatch.setattr(predicates, "COMPILED", compiled)
    schema = "scope string, basis string, complete boolean, windowed boolean, gaps array<string>"
    keys_of = spark.createDataFrame([(k,) for k in ("en/src1/x", "en/src2/x", "en/a/x", "en", "en/", "enx", "top")] + [(None,)], "rel_key string")

    def attested(*entries):
        cover = spark.createDataFrame([(s, b, c, w, g) for s, b, c, w, g in entries], schema)
        out = predicates.covered(keys_of, cover).collect()
        assert len(out) == 8 and not [r for r in out if r["rel_key"] is None and r["covered"] and "." not in [e[0] for e in entries]]
        return sorted(r["rel_key"] for r in out if r["covered"] and r["rel_key"])

    good = ("confirmed", True, False)
    assert attested(("en", *good, ["en/src1"])) == []
    assert attested(("en", *good, []), ("x", "inferred", True, False, ["en/a"])) == ["en", "en/", "en/src1/x", "en/src2/x"]
    assert attested(("en/", *good, None)) == ["en/", "en/a/x", "en/src1/x", "en/src2/x"]
    assert attested((" /en/src2", *good, [])) == ["en/src2/x"]
    assert attested(("en", *good, []), ("x", *good, [None])) == [] == attested(("en", *good, []), ("x", "inferred", False, True, [""]))
    assert attested(("en", "confirmed", True, True, []), ("en", "confirmed", False, False, []), ("", *good, [])) == []
    assert len(attested((".", *good, []))) == 7
    manifest = [{"scope": "en/src1", "basis": "confirmed", "complete": True}, {"scope": "/en/", "basis": "confirmed", "complete": True}, {"scope": "q", "gaps": ["en/a"]}]
    names = {r[0]: r[1] for r in keys_of.select("rel_key", predicates.attribution(F.col("rel_key"), manifest)).collect()}
    assert (names["en/src1/x"], names["en/src2/x"], names["en/a/x"], names["en"]) == ("en/src1", "en/", None, None)


def test_fold(spark):
    """Observations, enrichment and tombstones in one step; the same rows as an upsert, an enrichment and a deletion."""
    old, at, day = datetime(2024, 1, 1), datetime(2024, 2, 1, 1), datetime(2023, 1, 1)
    lineage = ("r0", old, "r0", old, "r0", old)
    given = [("set", f"data/{k}.xml", n, f"e-{k}", "STANDARD", day, *lineage, gone, None, None, None, kind, None) for k, n, gone, kind in (("unchanged", 10, None, None), ("changed", 10, None, None), ("reappeared", 5, old, None), ("missing", 7, None, None), ("enrich-only", 8, None, "a/x"))]
    given.append(("set", "other/far", 1, "e", None, day, *lineage, None, None, None, None, None, None))
    lineage_ddl = "first_seen_run_id string, first_seen_at timestamp_ntz, last_changed_run_id string, last_changed_at timestamp_ntz, last_seen_run_id string, last_seen_at timestamp_ntz"
    head_ddl = "archive_status string, restore_state string, restore_expiry timestamp_ntz, content_type string, head_enriched_at timestamp_ntz"
    prior = spark.createDataFrame(given, f"index_set_id string, rel_key string, size_bytes long, etag string, storage_class string, last_modified timestamp_ntz, {lineage_ddl}, deleted_at timestamp_ntz, {head_ddl}")
    none = (None,) * 5
    seen = [("data/unchanged.xml", 10, "e-unchanged"), ("data/changed.xml", 20, "new"), ("data/changed.xml", 20, "new"), ("data/reappeared.xml", 5, "e-reappeared"), ("data/new.xml", 1, "created")]
    log = [(k, "observe", "j_a", i, at, n, e, "STANDARD", day, *none) for i, (k, n, e) in enumerate(seen, 1)]
    log += [(k, "enrich", j, i, at, None, None, None, None, None, "available", None, kind, None) for k, j, i, kind in (("data/new.xml", "j_b", 1, "b/y"), ("data/new.xml", "j_a", 9, "lost"), ("data/enrich-only.xml", "j_b", 2, "b/z"), ("data/nobody", "j_b", 3, "c"))]
    journal = spark.createDataFrame(log, f"rel_key string, op string, journal_id string, sequence long, at timestamp_ntz, size_bytes long, etag string, storage_class string, last_modified timestamp_ntz, {head_ddl}")
    cover = spark.createDataFrame([("data/", "confirmed", True, False, [])], "scope string, basis string, complete boolean, windowed boolean, gaps array<string>")
    out = merge.fold(prior, journal, cover, "r1", "2024-02-01")
    assert out.columns == prior.columns
    got = {r["rel_key"].removeprefix("data/").removesuffix(".xml"): r for r in out.collect()}
    assert sorted(got) == ["changed", "enrich-only", "missing", "new", "other/far", "reappeared", "unchanged"]
    start = datetime(2024, 2, 1)
    assert {k for k, r in got.items() if r["deleted_at"] == start} == {"missing", "enrich-only"} and sum(r["deleted_at"] is not None for r in got.values()) == 2
    assert [got[k]["last_changed_run_id"] for k in ("unchanged", "changed", "reappeared", "new", "missing")] == ["r0", "r1", "r1", "r1", "r0"]
    assert (got["new"]["content_type"], got["new"]["head_enriched_at"], got["enrich-only"]["content_type"], got["enrich-only"]["restore_state"]) == ("b/y", at, "b/z", "available")
    assert (got["new"]["first_seen_run_id"], got["new"]["first_seen_at"], got["changed"]["size_bytes"], got["unchanged"]["last_seen_at"]) == ("r1", at, 20, at)
    heads = merge.fold(prior, journal.where("op = 'enrich'"), cover, "r1", "2024-02-01", enrich_only=True)
    assert heads.where("deleted_at is not null").count() == 1 and heads.count() == 6
    with pytest.raises(ValueError):
        merge.fold(prior, journal, cover, "r1", "2024-02-01", enrich_only=True)
    empty = merge.fold(prior.limit(0), journal.limit(0), cover, "r1", "2024-02-01")
    assert empty.count() == 0
    runs = spark.createDataFrame([("set", "r9", datetime(2023, 1, 1)), ("set", "r8", datetime(2023, 2, 1))], "index_set_id string, run_id string, started_at timestamp_ntz")
    bare = prior.withColumns({c: F.lit(None).cast(prior.schema[c].dataType) for c in ("first_seen_run_id", "first_seen_at", "last_changed_run_id", "last_changed_at", "last_seen_run_id")})
    filled = merge.backfill(bare, runs).first()
    assert (filled["first_seen_run_id"], filled["first_seen_at"], filled["last_changed_run_id"], filled["last_changed_at"]) == ("r9", old, "r9", old)


def test_upsert_keeps_what_it_does_not_set(spark, inv):
    lineage = inv.withColumns({c: F.lit(None).cast("string" if c.endswith("id") else "timestamp_ntz") for c in merge.LINEAGE} | {"last_seen_run_id": F.lit("r0"), "content_type": F.lit("a/b")})
    seen = spark.createDataFrame([("a/1.txt", 99, 1), ("a/1.txt", 10, 2), ("n", 1, 1)], "rel_key string, size_bytes long, nth int").withColumns({"etag": F.lit("e1"), "storage_class": F.lit("STANDARD"), "last_modified": F.lit("2024-01-01").cast("timestamp_ntz")})
    out = {r["rel_key"]: r for r in merge.upsert(lineage, seen, "r1", "2024-03-01", order="nth").collect()}
    assert (out["a/1.txt"]["size_bytes"], out["a/1.txt"]["content_type"], out["n"]["content_type"]) == (10, "a/b", None)
    assert (out["a/1.txt"]["first_seen_run_id"], out["a/1.txt"]["last_changed_run_id"], out["top"]["first_seen_run_id"]) == ("r0", "r0", None)


def test_delta_of_dead_rows(spark):
    before = rows(spark, ("same", 1, "e", None, None, "2024-01-01"), ("moved", 1, "e", None, None, "2024-01-01"), ("back", 1, "e", None, None, "2024-01-01"), ("gone", 1, "e", None, None, "2024-01-01"))
    after = rows(spark, ("same", 1, "e", None, None, "2024-01-01"), ("moved", 2, "e", None, None, "2024-01-01"), ("back", 1, "e", None, None, None), ("ghost", 1, "e", None, None, "2024-01-01"))
    assert {r["rel_key"]: r["kind"] for r in delta.compare(before, after).collect()} == {"same": "unchanged", "moved": "changed", "back": "added", "ghost": "error"}
    good = {"index_set_id": "s", "run_id": "a", "coverage": [{"scope": "x", "basis": "confirmed", "complete": True}]}
    delta.check_snapshots(good, good | {"run_id": "b", "parents": ["a"]}, parent_needed=True)
    for bad in ({"run_id": "a"}, {"run_id": "b", "index_set_id": "t"}, {"run_id": "b", "coverage": []}, {"run_id": "b", "coverage": [{"scope": "x", "basis": "confirmed", "complete": True, "gaps": ["y"]}]}):
        with pytest.raises(ValueError):
            delta.check_snapshots(good, good | bad)


def test_journal(spark):
    j = spark.createDataFrame([("k", "observe", "j2", 1, 5), ("k", "observe", "j1", 1, 3), ("k", "observe", "j1", 2, 3), ("k", "enrich", "j1", 3, 9), ("x", "enrich", "j1", 4, 1)], "rel_key string, op string, journal_id string, sequence long, size_bytes long")
    j = j.withColumn("at", F.timestamp_seconds("sequence").cast("timestamp_ntz"))
    got = merge.compact(j, ("size_bytes",), ("size_bytes",)).collect()
    assert [(r["rel_key"], r["size_bytes"], r["enriched_size_bytes"], r["observations"]) for r in got] == [("k", 5, 9, 3)]
    assert merge.broken_sequences(j).count() == 0 and merge.broken_sequences(j.where("sequence != 2")).count() == 1
    with pytest.raises(ValueError):
        merge.union_journals(j, j)


def test_delta(spark, inv):
    after = rows(spark, ("a/1.txt", 11, "e1", "STANDARD", "2024-01-01", None), ("a/2.txt", 20, "e1", None, None, None), ("z", 1, None, None, None, None))
    got = {r["rel_key"]: r["kind"] for r in delta.compare(inv, after).collect()}
    assert got == {"a/1.txt": "changed", "a/2.txt": "unchanged", "b/.h/3.txt": "tombstoned", "top": "tombstoned", "z": "added"}
    assert {r["prefix"]: r["changed"] for r in delta.by_prefix(delta.compare(inv, after), ["a/", "a/1"]).collect()} == {"": 0, "a/": 0, "a/1": 1}
    assert delta.digest(inv).collect() == delta.digest(inv.orderBy(F.desc("rel_key"))).collect()
    dead = rows(spark, ("q", 1, None, None, None, "2024-01-01"))
    cover = spark.createDataFrame([("a", "confirmed", True, False, [])], "scope string, basis string, complete boolean, windowed boolean, gaps array<string>")
    with pytest.raises(ValueError):
        delta.check_covered(delta.compare(inv, dead, cover))


def test_rollup(inv):
    got = {r["prefix"]: (r["objects"], r["bytes"]) for r in rollup.top_level(inv).collect()}
    assert got == {"a/": (2, 30), "b/": (1, 30), "": (1, 50)}
    tree = {r["prefix"]: r for r in rollup.direct_prefixes(inv).collect()}
    assert (tree[""]["direct_objects"], tree[""]["child_prefixes"]) == (1, 2) and tree["b/"]["child_prefixes"] == 1
    assert {(r["name"], r["kind"]) for r in rollup.common_prefixes(inv, "b/").collect()} == {("b/.h/", "prefix"), ("b/4.csv", "object")}
    assert [r["shard"] for r in rollup.shards(inv, 1).collect()] == ["a/", "b/"]
    assert rollup.manifest_counts(inv).first()["distinct_etags"] == 2
    with pytest.raises(ValueError):
        rollup.gate(rollup.crawl_summary(inv, F.lit(True)), min_objects=9)


def test_plans(spark):
    plan = partition.compile_plan(["a/", "a/b/", "c/", "d/"], 2)
    assert plan.lanes == (("a/", "d/"), ("c/",)) and plan.hash == partition.compile_plan(["d/", "c/", "a/"], 2).hash
    with pytest.raises(ValueError):
        partition.compile_plan(["a/"], 65)
    assert partition.canonical_json({"a": "<&>"}) == '{"a":"\\u003c\\u0026\\u003e"}'
    df = spark.createDataFrame([("a/",), ("a/b/c/",), ("ab/",), ("d/e/",)], "prefix string")
    assert sorted(r[0] for r in partition.subsume_table(df).collect()) == ["a/", "ab/", "d/e/"]
    assert {r["prefix"]: r["lane"] for r in partition.assign_lanes(df, 2).collect()} == {"a/": 1, "a/b/c/": 2, "ab/": 1, "d/e/": 2}
    assert scope.migrate(["data/**", "x/y/**/*"]) == ["data/", "x/y/"]
    with pytest.raises(ValueError):
        scope.migrate(["data/*.csv"])
    assert scope.narrow(date(2024, 1, 1), date(2024, 2, 1), datetime(2024, 1, 10, 5)) == (date(2024, 1, 10), date(2024, 2, 1))
    assert len(scope.days(date(2024, 2, 28), date(2024, 3, 1))) == 2


def test_retention_and_reflow(spark):
    sets = spark.createDataFrame([("u", f"s{k}", datetime(2024, 1, k)) for k in range(1, 6)], "base_uri string, index_set_id string, created_at timestamp_ntz")
    assert sorted(r["index_set_id"] for r in retention.collectable(sets, 2).collect()) == ["s1", "s2", "s3"]
    assert sorted(r["index_set_id"] for r in retention.collectable(sets, 2, "2024-01-02").collect()) == ["s1", "s2"]
    pair = "source_provider string, source_etag string, source_size long, source_modified timestamp_ntz, dest_provider string, dest_etag string, dest_size long, dest_modified timestamp_ntz, dest_found boolean"
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    given = [("", "a", 1, t1, "s3", "a", 1, t1, True), ("s3", "a", 1, t2, "s3", "b", 1, t1, True), ("s3", "a", 1, t1, "s3", "b", 2, t1, True), ("s3", "a", 1, t1, "s3", "b", 1, t2, True), ("s3", "a", None, t1, "s3", "b", 1, t1, True), ("file", "a", 1, t1, "file", "a", 1, t1, True), ("s3", "a", 1, t1, None, None, None, None, None), ("s3", "x-2", 1, t1, "s3", "x-2", 1, None, True)]
    got = [r["decision"] for r in reflow.decide(spark.createDataFrame(given, pair).coalesce(1), "overwrite-if-source-newer").collect()]
    assert got == ["skipped", "overwrite", "overwrite", "skipped", "error", "skipped", "copy", "error"]
    assert [r["decision"] for r in reflow.decide(spark.createDataFrame(given[:2], pair).coalesce(1), "fail").collect()] == ["error", "error"]
    with pytest.raises(ValueError):
        reflow.decide(sets, "whatever")
