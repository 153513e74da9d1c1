"""The registered queries over inventories, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gannet.functions import derive, metadata, templates, values
from gannet.operators import atlas, delta, merge, predicates, reflow, retention, rollup
from gannet.operators import query as Q
from gannet.plans import partition, scope
from gannet.sources import records, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, *parts: str):
    """Registers a function under its name, with SQL behind the named common tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = ("WITH " + ", ".join(parts) + " " if parts else "") + sql
        return f

    return register


DOCS, LINES, PAGES, RUNS, SNAPS, JOURNAL = views.DOCUMENTS_SQL, views.LINES_SQL, views.PAGES_SQL, views.RUNS_SQL, views.SNAPSHOTS_SQL, views.JOURNAL_SQL


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@_query("SELECT rel_key, size_bytes, storage_class FROM inv WHERE deleted_at IS NULL AND starts_with(rel_key, 'en/') AND regexp_matches(rel_key, '^en/(?:[^/]*/)*[^/]*5\\.txt$')", DOCS)
def idx_query_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.run(views.documents(spark, sf_dir), Q.Query(pattern="en/**/*5.txt"), ("rel_key", "size_bytes", "storage_class"))


@_query(
    "SELECT rel_key, size_bytes, etag, storage_class, strftime(last_modified, '%Y-%m-%d') AS last_modified FROM inv WHERE deleted_at IS NULL AND size_bytes BETWEEN 500 AND 5000 "
    "AND last_modified >= TIMESTAMP '2024-01-10' AND last_modified <= TIMESTAMP '2024-02-20' AND storage_class IN ('STANDARD', 'GLACIER')",
    DOCS,
)
def idx_query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q.Query(min_size=values.parse_size("500"), max_size=values.parse_size("5KB"), after="2024-01-10", before="2024-02-20", storage_classes=("STANDARD", "GLACIER", ""))
    return Q.run(views.documents(spark, sf_dir), q, ("rel_key", "size_bytes", "etag", "storage_class", "last_modified")).withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd"))


@_query("SELECT rel_key, size_bytes FROM inv WHERE deleted_at IS NULL AND regexp_matches(rel_key, 'src[13]/0+[0-9]*7') ORDER BY rel_key LIMIT 25", DOCS)
def idx_query_regex_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.run(views.documents(spark, sf_dir), Q.Query(regex="src[13]/0+[0-9]*7", limit=25), ("rel_key", "size_bytes"))


@_query("SELECT count(*) AS matches FROM inv WHERE deleted_at IS NULL AND size_bytes >= 1024", DOCS)
def idx_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.count(views.documents(spark, sf_dir), Q.Query(min_size=values.parse_size("1KiB"), limit=5))


@_query(
    "SELECT page_id, rel_key FROM inv WHERE (regexp_matches(rel_key, '^fr/[^/]*$') OR regexp_matches(rel_key, '^(?:[^/]*/)*[^/]*1[^/]*$')) AND NOT regexp_matches(rel_key, '^(?:[^/]*/)*[^/]*5$') AND NOT regexp_matches(rel_key, '(^|/)\\.')",
    PAGES,
)
def idx_match_include_exclude_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pages(spark, sf_dir)
    return rows.where(predicates.match(F.col("rel_key"), ["fr/*", "**/*1*"], ["**/*5"])).select("page_id", "rel_key")


@_query("SELECT rel_key FROM inv WHERE last_modified >= TIMESTAMP '2024-01-05' AND last_modified < TIMESTAMP '2024-01-09' AND lower(split_part(rel_key, '/', 1)) IN ('en', 'fr')", DOCS)
def crawl_modified_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.documents(spark, sf_dir)
    first = F.lower(F.get(F.split("rel_key", "/"), 0))
    return rows.where(predicates.modified_listing(F.col("last_modified"), "2024-01-05", "2024-01-09") & predicates.segments(first, allow=["en", "fr"])).select("rel_key")


def _canonical(rule: str, order: str):
    sql = f"""
    , tagged AS (SELECT *, row_number() OVER (PARTITION BY etag ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY etag) AS n FROM inv WHERE etag IS NOT NULL AND etag <> '' AND deleted_at IS NULL)
    SELECT rel_key, etag, n AS copies FROM tagged WHERE rn = 1 UNION ALL SELECT rel_key, etag, 1 AS copies FROM inv WHERE (etag IS NULL OR etag = '') AND deleted_at IS NULL"""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.documents(spark, sf_dir).where("deleted_at is null").select("rel_key", "etag", "last_modified")
        return Q.canonical(rows, rule).select("rel_key", "etag", "copies")

    f.__name__ = f"canonical_{rule}"
    QUERIES[f.__name__], ORACLE[f.__name__] = f, "WITH " + DOCS + sql


_canonical("min_key", "rel_key")
_canonical("min_modified", "last_modified ASC NULLS LAST, rel_key")
_canonical("max_modified", "last_modified DESC NULLS LAST, rel_key")


@_query(
    "SELECT etag, min(rel_key) AS rel_key, string_agg(rel_key, ',' ORDER BY rel_key) FILTER (WHERE rel_key <> m) AS alternates FROM (SELECT *, min(rel_key) OVER (PARTITION BY etag) AS m FROM inv WHERE etag IS NOT NULL) GROUP BY etag HAVING count(*) > 1",
    DOCS,
)
def canonical_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.canonical(views.documents(spark, sf_dir).select("rel_key", "etag", "last_modified"))
    return rows.where("copies > 1 and etag is not null").select("etag", "rel_key", F.array_join("alternates", ",").alias("alternates"))


@_query(
    "SELECT rel_key, CASE WHEN first_seen_at > b THEN 'added' WHEN last_changed_at > b THEN 'changed' END AS change_kind FROM inv, (SELECT started_at AS b FROM runs WHERE run_id = 'run_1') "
    "WHERE EXISTS (SELECT 1 FROM runs r WHERE r.run_id = first_seen_run_id AND r.started_at > b) OR EXISTS (SELECT 1 FROM runs r WHERE r.run_id = last_changed_run_id AND r.started_at > b)",
    DOCS,
    RUNS,
)
def since_run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.runs(spark)
    boundary = Q.resolve_boundary(runs, "run_1", "set_a")["started_at"]
    return Q.since_run(views.documents(spark, sf_dir), runs, str(boundary)).select("rel_key", "change_kind")


@_query("SELECT index_set_id, count(*) AS total, count(*) FILTER (WHERE deleted_at IS NULL) AS active, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS deleted, CAST(coalesce(sum(size_bytes) FILTER (WHERE deleted_at IS NULL), 0) AS BIGINT) AS active_bytes FROM inv GROUP BY 1", DOCS)
def set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.set_summary(views.documents(spark, sf_dir))


@_query("SELECT index_set_id, count(*) AS runs, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'partial') AS \"partial\", count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'failed-resumable') AS failed_resumable FROM runs GROUP BY 1", RUNS)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.run_summary(views.runs(spark))


@_query("SELECT CASE WHEN instr(rel_key, '/') = 0 THEN '' ELSE substr(rel_key, 1, instr(rel_key, '/')) END AS prefix, count(*) AS objects, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM inv WHERE deleted_at IS NULL GROUP BY 1", DOCS)
def top_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.top_level(views.documents(spark, sf_dir))


@_query(
    "SELECT s.*, coalesce(r.runs, 0) AS runs, r.latest_run, r.latest_status FROM (SELECT index_set_id, count(*) FILTER (WHERE deleted_at IS NULL) AS active, CAST(coalesce(sum(size_bytes) FILTER (WHERE deleted_at IS NULL), 0) AS BIGINT) AS active_bytes FROM inv GROUP BY 1) s "
    "LEFT JOIN (SELECT index_set_id, count(*) AS runs, arg_max(run_id, started_at) AS latest_run, arg_max(status, started_at) AS latest_status FROM runs GROUP BY 1) r USING (index_set_id)",
    DOCS,
    RUNS,
)
def list_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.list_with_stats(views.documents(spark, sf_dir), views.runs(spark))


@_query("SELECT count(*) AS deleted, strftime(min(deleted_at), '%Y-%m-%d') AS oldest, strftime(max(deleted_at), '%Y-%m-%d') AS newest FROM inv WHERE deleted_at IS NOT NULL", DOCS)
def deleted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.deleted_stats(views.documents(spark, sf_dir)).select("deleted", _day("oldest"), _day("newest"))


@_query("SELECT rel_key FROM inv WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMP '2024-04-15'", DOCS)
def purge_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.purge(views.documents(spark, sf_dir), "2024-04-15").select("rel_key")


@_query("SELECT rel_key, CASE WHEN deleted_at >= TIMESTAMP '2024-04-15' THEN NULL ELSE strftime(deleted_at, '%Y-%m-%d') END AS deleted_at FROM inv", DOCS)
def restore_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.restore(views.documents(spark, sf_dir), "2024-04-15").select("rel_key", _day("deleted_at"))


_LINEAGE = ("first_seen_run_id", "first_seen_at", "last_changed_run_id", "last_changed_at", "last_seen_run_id", "last_seen_at")
#: The earlier snapshot with lineage, some of it missing, and what enrichment has found.
PRIOR = """prior AS (SELECT i.index_set_id, p.rel_key, p.size_bytes, p.etag, p.storage_class, p.last_modified, CASE WHEN i.doc_id % 7 <> 0 THEN i.first_seen_run_id END AS first_seen_run_id, CASE WHEN i.doc_id % 7 <> 0 THEN i.first_seen_at END AS first_seen_at,
  CASE WHEN i.doc_id % 19 <> 0 THEN i.last_changed_run_id END AS last_changed_run_id, CASE WHEN i.doc_id % 19 <> 0 THEN i.last_changed_at END AS last_changed_at, i.last_seen_run_id, i.last_seen_at, p.deleted_at,
  CASE WHEN i.doc_id % 4 = 1 THEN 'ARCHIVE' END AS archive_status, CASE WHEN i.doc_id % 8 = 1 THEN 'completed' END AS restore_state, CAST(NULL AS TIMESTAMP) AS restore_expiry, CASE WHEN i.doc_id % 3 = 0 THEN 'text/plain' END AS content_type, CASE WHEN i.doc_id % 3 = 0 THEN TIMESTAMP '2024-03-02' END AS head_enriched_at
  FROM before p JOIN inv i USING (rel_key))"""
_HEADS = "archive_status, restore_state, content_type, strftime(restore_expiry, '%Y-%m-%d') AS restore_expiry, strftime(head_enriched_at, '%Y-%m-%d') AS head_enriched_at"


def _prior(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, after = views.snapshots(spark, sf_dir)
    i = F.col("doc_id")
    lineage = views.documents(spark, sf_dir).select(
        "index_set_id", "rel_key", *[F.when(i % 7 != 0, F.col(c)).alias(c) for c in _LINEAGE[:2]], *[F.when(i % 19 != 0, F.col(c)).alias(c) for c in _LINEAGE[2:4]], *_LINEAGE[4:],
        F.when(i % 4 == 1, "ARCHIVE").alias("archive_status"), F.when(i % 8 == 1, "completed").alias("restore_state"), F.lit(None).cast("timestamp_ntz").alias("restore_expiry"),
        F.when(i % 3 == 0, "text/plain").alias("content_type"), F.when(i % 3 == 0, F.lit("2024-03-02").cast("timestamp_ntz")).alias("head_enriched_at"),
    )
    columns = ("index_set_id", "rel_key", *merge.FIELDS, *_LINEAGE, "deleted_at", *merge.HEAD)
    return before.drop("doc_id").join(lineage, "rel_key").select(*columns), after


def _days(*names: str):
    return {c: F.date_format(c, "yyyy-MM-dd") for c in names}


_DATED = ("last_modified", "first_seen_at", "last_changed_at", "last_seen_at", "deleted_at", "restore_expiry", "head_enriched_at")


@_query(
    """, m AS (SELECT p.index_set_id, coalesce(p.rel_key, o.rel_key) AS rel_key, o.rel_key IS NOT NULL AS seen, o.rel_key IS NOT NULL AND (p.rel_key IS NULL OR p.deleted_at IS NOT NULL OR p.size_bytes IS DISTINCT FROM o.size_bytes OR p.etag IS DISTINCT FROM o.etag OR p.storage_class IS DISTINCT FROM o.storage_class OR p.last_modified IS DISTINCT FROM o.last_modified) AS moved,
      CASE WHEN o.rel_key IS NOT NULL THEN o.size_bytes ELSE p.size_bytes END AS size_bytes, CASE WHEN o.rel_key IS NOT NULL THEN o.etag ELSE p.etag END AS etag, CASE WHEN o.rel_key IS NOT NULL THEN o.storage_class ELSE p.storage_class END AS storage_class, CASE WHEN o.rel_key IS NOT NULL THEN o.last_modified ELSE p.last_modified END AS last_modified, p.* EXCLUDE (index_set_id, rel_key, size_bytes, etag, storage_class, last_modified)
      FROM prior p FULL OUTER JOIN after o ON p.rel_key = o.rel_key)
    SELECT index_set_id, rel_key, size_bytes, etag, storage_class, strftime(last_modified, '%Y-%m-%d') AS last_modified,
      CASE WHEN seen THEN coalesce(first_seen_run_id, last_seen_run_id, 'run_9') ELSE first_seen_run_id END AS first_seen_run_id, strftime(CASE WHEN seen THEN coalesce(first_seen_at, last_seen_at, TIMESTAMP '2024-06-01') ELSE first_seen_at END, '%Y-%m-%d') AS first_seen_at,
      CASE WHEN moved THEN 'run_9' WHEN seen THEN coalesce(last_changed_run_id, last_seen_run_id, 'run_9') ELSE last_changed_run_id END AS last_changed_run_id, strftime(CASE WHEN moved THEN TIMESTAMP '2024-06-01' WHEN seen THEN coalesce(last_changed_at, last_seen_at, TIMESTAMP '2024-06-01') ELSE last_changed_at END, '%Y-%m-%d') AS last_changed_at,
      CASE WHEN seen THEN 'run_9' ELSE last_seen_run_id END AS last_seen_run_id, strftime(CASE WHEN seen THEN TIMESTAMP '2024-06-01' ELSE last_seen_at END, '%Y-%m-%d') AS last_seen_at, CASE WHEN NOT seen THEN strftime(deleted_at, '%Y-%m-%d') END AS deleted_at, """
    + _HEADS
    + " FROM m",
    DOCS,
    SNAPS,
    PRIOR,
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, after = _prior(spark, sf_dir)
    return merge.upsert(prior, after, "run_9", "2024-06-01").withColumns(_days(*_DATED))


@_query(
    "SELECT rel_key, CASE WHEN deleted_at IS NULL AND last_seen_run_id <> 'run_3' THEN '2024-06-01' ELSE strftime(deleted_at, '%Y-%m-%d') END AS deleted_at FROM inv",
    DOCS,
)
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.soft_delete(views.documents(spark, sf_dir), "run_3", "2024-06-01").select("rel_key", _day("deleted_at"))


#: Scopes without and with a slash at the end, with blanks and a slash before it; entries that attest nothing, some with gaps that count all the same.
_COVERAGE = [
    ("en/src2", "confirmed", True, False, []),
    (" /fr/", "confirmed", True, False, []),
    ("de", "inferred", True, False, ["fr/src1"]),
    ("de/src3/", "confirmed", False, False, None),
    ("es", "confirmed", True, True, []),
    ("en", "confirmed", True, False, ["fr/src12/", "/en/src2/00000022.txt"]),
    ("", "confirmed", True, False, []),
]
COVERAGE = "coverage AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{b}', {c}, {w}, {'CAST(NULL AS VARCHAR[])' if g is None else 'CAST(' + str(g) + ' AS VARCHAR[])'})" for s, b, c, w, g in _COVERAGE) + ") t(scope, basis, complete, windowed, gaps))"
_CLEAN = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '^/', '')"
_HOLDS = "(p = '.' OR CASE WHEN ends_with(p, '/') THEN starts_with(rel_key, p) ELSE rel_key = p OR starts_with(rel_key, p || '/') END)"
SCOPES = f"scopes AS (SELECT {_CLEAN.format('scope')} AS p FROM coverage WHERE basis = 'confirmed' AND complete AND NOT windowed AND coalesce(len(gaps), 0) = 0 AND {_CLEAN.format('scope')} <> ''), gaps AS (SELECT CASE WHEN coalesce({_CLEAN.format('g')}, '') = '' THEN '.' ELSE {_CLEAN.format('g')} END AS p FROM (SELECT unnest(gaps) AS g FROM coverage))"
_COVERED = f"(EXISTS (SELECT 1 FROM scopes WHERE {_HOLDS}) AND NOT EXISTS (SELECT 1 FROM gaps WHERE {_HOLDS}))"


def _coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_COVERAGE, "scope string, basis string, complete boolean, windowed boolean, gaps array<string>")


@_query(f"SELECT rel_key, CASE WHEN deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM after a WHERE a.rel_key = before.rel_key) AND {_COVERED} THEN '2024-06-01' ELSE strftime(deleted_at, '%Y-%m-%d') END AS deleted_at FROM before", DOCS, SNAPS, COVERAGE, SCOPES)
def tombstones_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = views.snapshots(spark, sf_dir)
    return merge.tombstones(before, after, _coverage(spark), "2024-06-01").select("rel_key", _day("deleted_at"))


@_query(
    """, o AS (SELECT *, lag(event_type) OVER w AS pe, lag(size_bytes) OVER w AS ps, row_number() OVER w AS rn FROM journal WHERE op = 'observe' WINDOW w AS (PARTITION BY rel_key ORDER BY journal_id, sequence)),
    s AS (SELECT rel_key, arg_max(event_type, (journal_id, sequence)) AS event_type, arg_max(size_bytes, (journal_id, sequence)) AS size_bytes, min(seen) AS fs, max(seen) AS ls, count(*) AS observations,
      arg_max(seen, (journal_id, sequence)) FILTER (WHERE rn = 1 OR event_type IS DISTINCT FROM pe OR size_bytes IS DISTINCT FROM ps) AS lc FROM o GROUP BY rel_key),
    e AS (SELECT rel_key, arg_max(size_bytes, (journal_id, sequence)) AS enriched_size_bytes FROM journal WHERE op = 'enrich' GROUP BY rel_key)
    SELECT s.rel_key, s.event_type, s.size_bytes, s.observations, epoch_us(fs) AS first_us, epoch_us(lc) AS changed_us, epoch_us(ls) AS last_us, e.enriched_size_bytes FROM s LEFT JOIN e USING (rel_key)""",
    JOURNAL,
)
def compact_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.compact(views.journal(spark, sf_dir), ("event_type", "size_bytes"), ("size_bytes",))
    us = lambda c, name: F.unix_micros(F.col(c).cast("timestamp")).alias(name)
    return out.select("rel_key", "event_type", "size_bytes", "observations", us("first_seen_at", "first_us"), us("last_changed_at", "changed_us"), us("last_seen_at", "last_us"), "enriched_size_bytes")


_DELTA = """, d AS (SELECT coalesce(a.rel_key, b.rel_key) AS rel_key, CASE WHEN a.rel_key IS NULL AND b.deleted_at IS NOT NULL THEN 'error' WHEN b.rel_key IS NULL AND a.deleted_at IS NOT NULL THEN NULL
  WHEN a.rel_key IS NULL THEN 'added' WHEN b.rel_key IS NULL THEN 'tombstoned' WHEN a.deleted_at IS NOT NULL AND b.deleted_at IS NULL THEN 'added' WHEN a.deleted_at IS NULL AND b.deleted_at IS NOT NULL THEN 'tombstoned'
  WHEN a.size_bytes IS DISTINCT FROM b.size_bytes OR a.etag IS DISTINCT FROM b.etag OR a.storage_class IS DISTINCT FROM b.storage_class OR a.last_modified IS DISTINCT FROM b.last_modified THEN 'changed' ELSE 'unchanged' END AS kind
  FROM before a FULL OUTER JOIN after b ON a.rel_key = b.rel_key) """


@_query(_DELTA + f"SELECT rel_key, kind, {_COVERED} AS covered FROM d WHERE kind IS NOT NULL", DOCS, SNAPS, COVERAGE, SCOPES)
def delta_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.compare(*views.snapshots(spark, sf_dir), _coverage(spark)).select("rel_key", "kind", "covered")


@_query(_DELTA + "SELECT count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'changed') AS changed, count(*) FILTER (WHERE kind = 'tombstoned') AS tombstoned, count(*) FILTER (WHERE kind = 'unchanged') AS unchanged FROM d", DOCS, SNAPS)
def delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.counts(delta.compare(*views.snapshots(spark, sf_dir)))


@_query(_DELTA + "SELECT rel_key, kind FROM d WHERE kind <> 'unchanged' ORDER BY rel_key LIMIT 50", DOCS, SNAPS)
def delta_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.details(delta.compare(*views.snapshots(spark, sf_dir)), 50).select("rel_key", "kind")


_PLAN = ["en/", "en/src1", "en/src10/", "fr/src", "de/"]


@_query(
    _DELTA + "SELECT coalesce((SELECT arg_max(p, length(p)) FROM (VALUES " + ", ".join(f"('{p}')" for p in _PLAN) + ") t(p) WHERE starts_with(d.rel_key, p)), '') AS prefix, count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'changed') AS changed, count(*) FILTER (WHERE kind = 'unchanged') AS unchanged FROM d WHERE kind IS NOT NULL GROUP BY 1",
    DOCS,
    SNAPS,
)
def delta_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.by_prefix(delta.compare(*views.snapshots(spark, sf_dir)), _PLAN)


@_query(
    "SELECT coalesce(a.rel_key, b.rel_key) AS rel_key, CASE WHEN b.rel_key IS NULL THEN 'left_only' WHEN a.rel_key IS NULL THEN 'right_only' WHEN a.size_bytes IS DISTINCT FROM b.size_bytes OR a.last_modified IS DISTINCT FROM b.last_modified OR a.storage_class IS DISTINCT FROM b.storage_class THEN 'differs' ELSE 'equal' END AS parity, a.size_bytes AS left_size, b.size_bytes AS right_size FROM before a FULL OUTER JOIN after b ON a.rel_key = b.rel_key",
    DOCS,
    SNAPS,
)
def parity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.parity(*views.snapshots(spark, sf_dir))


@_query("SELECT b.rel_key, 'added' AS side FROM after b WHERE NOT EXISTS (SELECT 1 FROM before a WHERE a.rel_key = b.rel_key) UNION ALL SELECT a.rel_key, 'removed' FROM before a WHERE NOT EXISTS (SELECT 1 FROM after b WHERE a.rel_key = b.rel_key)", DOCS, SNAPS)
def added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.added_removed(*views.snapshots(spark, sf_dir))


@_query("SELECT count(*) AS row_count, count(*) FILTER (WHERE deleted_at IS NULL) AS active, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS tombstones, count(DISTINCT nullif(etag, '')) AS distinct_etags FROM inv", DOCS)
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.manifest_counts(views.documents(spark, sf_dir))


@_query("SELECT substr(rel_key, 1, 2) AS segment, min(rel_key) AS min_key, max(rel_key) AS max_key, count(*) AS row_count, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS tombstones, count(DISTINCT nullif(etag, '')) AS distinct_etags FROM inv GROUP BY 1", DOCS)
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.segment_stats(views.documents(spark, sf_dir), F.substring("rel_key", 1, 2))


@_query("SELECT count(*) AS listed, count(*) FILTER (WHERE m) AS matched, CAST(coalesce(sum(size_bytes) FILTER (WHERE m), 0) AS BIGINT) AS bytes FROM (SELECT *, rel_key LIKE 'en/%' AND size_bytes >= 1000 AS m FROM inv)", DOCS)
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.crawl_summary(views.documents(spark, sf_dir), predicates.glob(F.col("rel_key"), "en/**") & predicates.size_between(F.col("size_bytes"), 1000))


@_query(
    "SELECT array_to_string(list_slice(string_split(rel_key, '/'), 1, n), '/') || CASE WHEN n > 0 THEN '/' ELSE '' END AS prefix, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes, n AS depth FROM inv, (SELECT unnest(range(0, 4)) AS n) GROUP BY 1, 4",
    LINES,
)
def prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.prefix_tree(views.lines(spark, sf_dir), 3).withColumn("depth", F.col("depth").cast("long"))


@_query(
    """, f AS (SELECT regexp_extract(rel_key, '^(.*/)?[^/]*$', 1) AS prefix, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS b FROM inv GROUP BY 1),
    c AS (SELECT DISTINCT array_to_string(list_slice(string_split(rel_key, '/'), 1, n), '/') || '/' AS child FROM inv, (SELECT unnest(range(1, 4)) AS n)),
    u AS (SELECT regexp_extract(child, '^(.*/)?[^/]+/$', 1) AS prefix, count(*) AS k FROM c GROUP BY 1)
    SELECT coalesce(f.prefix, u.prefix) AS prefix, coalesce(n, 0) AS direct_objects, coalesce(b, 0) AS direct_bytes, coalesce(k, 0) AS child_prefixes FROM f FULL OUTER JOIN u ON f.prefix = u.prefix""",
    LINES,
)
def direct_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.direct_prefixes(views.lines(spark, sf_dir))


@_query("SELECT DISTINCT array_to_string(list_slice(string_split(rel_key, '/'), 1, 3), '/') || '/' AS shard FROM inv", LINES)
def shard_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.shards(views.lines(spark, sf_dir), 3)


@_query("SELECT 'A/F/' || split_part(substr(rel_key, 5), '/', 1) || '/' AS name, 'prefix' AS kind, count(*) AS objects FROM inv WHERE starts_with(rel_key, 'A/F/') GROUP BY 1", LINES)
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.common_prefixes(views.lines(spark, sf_dir), "A/F/")


@_query("SELECT p || '/' || strftime(d, '%Y-%m-%d') || '/' AS prefix FROM (SELECT DISTINCT array_to_string(list_slice(string_split(rel_key, '/'), 1, 2), '/') AS p FROM inv), (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-15', INTERVAL 1 DAY)) AS d)", LINES)
def date_partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.date_partitions(views.lines(spark, sf_dir), 2, "2024-01-01", "2024-01-15")


@_query("SELECT prefix, CAST((row_number() OVER (ORDER BY prefix) - 1) % 7 + 1 AS INTEGER) AS lane FROM (SELECT DISTINCT regexp_extract(rel_key, '^(.*/)[^/]*$', 1) AS prefix FROM inv)", LINES)
def lane_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.lines(spark, sf_dir).select(F.regexp_extract("rel_key", "^(.*/)[^/]*$", 1).alias("prefix")).distinct()
    return partition.assign_lanes(found, 7)


_SUBSUME = "(SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN regexp_extract(rel_key, '^([^/]*/)', 1) ELSE regexp_extract(rel_key, '^(.*/)[^/]*$', 1) END AS prefix FROM inv WHERE rel_key NOT LIKE 'en/%')"


@_query(f"SELECT prefix FROM {_SUBSUME} a WHERE NOT EXISTS (SELECT 1 FROM {_SUBSUME} b WHERE b.prefix <> a.prefix AND starts_with(a.prefix, b.prefix)) UNION ALL SELECT DISTINCT regexp_extract(rel_key, '^(.*/)[^/]*$', 1) FROM inv WHERE rel_key LIKE 'en/%'", DOCS)
def prefix_subsume(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_extract("rel_key", "^(.*/)[^/]*$", 1)
    top = F.when((F.col("doc_id") % 7 == 0) & ~F.col("rel_key").startswith("en/"), F.regexp_extract("rel_key", "^([^/]*/)", 1)).otherwise(folder)
    return partition.subsume_table(views.documents(spark, sf_dir).select(top.alias("prefix")))


@_query("SELECT o_orderkey AS index_set_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn > 3 AND o_orderdate <= TIMESTAMP '1999-01-01'")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("base_uri"), F.col("o_orderkey").alias("index_set_id"), F.col("o_orderdate").alias("created_at"))
    return retention.collectable(sets, keep_last=3, older_than="1999-01-01").select("index_set_id")


@_query(
    ", g AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn > 3) SELECT (SELECT count(*) FROM g) AS sets, count(*) AS objects, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM inv WHERE l_orderkey IN (SELECT o_orderkey FROM g)",
    LINES,
)
def gc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("base_uri"), F.col("o_orderkey").alias("index_set_id"), F.col("o_orderdate").alias("created_at"))
    return retention.totals(retention.collectable(sets, keep_last=3), views.lines(spark, sf_dir).withColumnRenamed("l_orderkey", "index_set_id"))


@_query("SELECT o_custkey AS index_set_id, o_orderkey AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("index_set_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return rollup.latest_run(runs, only_success=True).select("index_set_id", "run_id")


@_query("SELECT doc_id, CASE WHEN length(source) >= 4 THEN substr(source, 2, 3) END AS sub, CASE WHEN length(source) >= 6 THEN source ELSE lpad(source, 6, '0') END AS padded, CASE WHEN regexp_matches(source, 'src([0-9])[0-9]') THEN regexp_extract(source, 'src([0-9])[0-9]', 1) END AS captured, upper(lang) AS up FROM documents")
def derive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("source")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", derive.substring(c, 1, 4).alias("sub"), derive.pad(c, 6).alias("padded"), derive.regex_capture(c, "src([0-9])[0-9]").alias("captured"), F.upper("lang").alias("up"))


@_query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' WHEN starts_with(o_orderpriority, '2') THEN 'soon' WHEN regexp_matches(o_orderpriority, '^[34]') THEN 'later' ELSE 'none' END AS looked_up, strftime(o_orderdate, '%d/%m/%y') AS formatted FROM orders")
def derive_lookup_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = [("exact", "1-URGENT", "now"), ("prefix", "2", "soon"), ("regex", "^[34]", "later")]
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", derive.lookup(F.col("o_orderpriority"), table, "none").alias("looked_up"), derive.reformat(day, "2006-01-02", "02/01/06").alias("formatted"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", derive.json_path(F.col("props"), "k").alias("k"))


@_query("SELECT page_id, nullif(trim(regexp_extract(html, '<title(?: [^>]*)?>([^<]*)</title>', 1)), '') AS title, CASE WHEN regexp_matches(html, '<h1(?: [^>]*)?>([^<]*)</h1>') THEN 1 WHEN regexp_matches(html, '<title') THEN 2 END AS place FROM inv", PAGES)
def html_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    title = derive.tag_text(html, "title")
    _, place = derive.first_of(derive.tag_text(html, "h1"), title)
    return views.pages(spark, sf_dir).select("page_id", title.alias("title"), place.alias("place"))


@_query("SELECT rel_key, 'by-date/' || split_part(rel_key, '/', 3) || '/' || split_part(rel_key, '/', 1) || '/' || split_part(rel_key, '/', 4) AS dest_key, split_part(rel_key, '/', 4) || '@' || split_part(rel_key, '/', 2) AS path FROM inv", LINES)
def rewrite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("rel_key")
    rewrite = templates.Rewrite("{flag}/{_}/{day}/{name}", "by-date/{day}//{flag}/{name}/")
    return views.lines(spark, sf_dir).select("rel_key", rewrite.render(key).alias("dest_key"), templates.path("{filename}@{dir[1]}", key).alias("path"))


@_query(
    "SELECT o.rel_key, CASE WHEN p.rel_key IS NULL THEN 'copy' WHEN o.etag IS NOT NULL AND o.etag = p.etag AND o.size_bytes = p.size_bytes THEN 'skipped' WHEN p.last_modified IS NULL THEN 'error' WHEN o.last_modified > p.last_modified THEN 'overwrite' WHEN o.last_modified = p.last_modified AND o.size_bytes <> p.size_bytes THEN 'overwrite' ELSE 'skipped' END AS decision FROM after o LEFT JOIN before p ON p.rel_key = o.rel_key",
    DOCS,
    SNAPS,
)
def collision_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = views.snapshots(spark, sf_dir)
    source = after.select("rel_key", F.lit("s3").alias("source_provider"), F.col("etag").alias("source_etag"), F.col("size_bytes").alias("source_size"), F.col("last_modified").alias("source_modified"))
    dest = before.select("rel_key", F.lit("s3").alias("dest_provider"), F.col("etag").alias("dest_etag"), F.col("size_bytes").alias("dest_size"), F.col("last_modified").alias("dest_modified"), F.lit(True).alias("dest_found"))
    return reflow.decide(source.join(dest, "rel_key", "left"), "overwrite-if-source-newer").select("rel_key", "decision")


@_query(
    "SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'copy' WHEN octet_length(encode(a.text)) = octet_length(encode(b.text)) AND a.text = b.text THEN 'skipped' ELSE 'error' END AS decision FROM documents a LEFT JOIN documents b ON b.doc_id = CASE WHEN a.doc_id % 3 = 0 THEN a.doc_id ELSE a.doc_id + 1 END"
)
def collision_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collisions that only contents decide: tags of several parts, and files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i, size = F.col("doc_id"), F.octet_length("text").cast("long")
    source = docs.select(i, F.when(i % 3 == 0, i).otherwise(i + 1).alias("at"), F.when(i % 2 == 0, "s3").otherwise("file").alias("source_provider"), F.lit("x-2").alias("source_etag"), size.alias("source_size"), F.lit(None).cast("timestamp_ntz").alias("source_modified"), F.col("text").cast("binary").alias("source_body"))
    dest = docs.select(i.alias("at"), F.lit("s3").alias("dest_provider"), F.lit("x-2").alias("dest_etag"), size.alias("dest_size"), F.lit(None).cast("timestamp_ntz").alias("dest_modified"), F.lit(True).alias("dest_found"), F.col("text").cast("binary").alias("dest_body"))
    return reflow.decide(source.join(dest, "at", "left"), "quarantine").select("doc_id", "decision")


_VERIFY = "(SELECT o.rel_key, CASE WHEN p.rel_key IS NULL THEN 'missing' WHEN o.size_bytes IS DISTINCT FROM p.size_bytes THEN 'size_mismatch' WHEN coalesce(o.etag, '') <> '' AND coalesce(p.etag, '') <> '' AND o.etag <> p.etag THEN 'verified_size_etag_differs' ELSE 'verified' END AS verdict FROM after o LEFT JOIN before p ON p.rel_key = o.rel_key)"


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = views.snapshots(spark, sf_dir)
    audit = after.select(F.col("rel_key").alias("dest_key"), F.col("size_bytes").alias("source_size"), F.concat(F.lit('"'), "etag", F.lit('"')).alias("source_etag"))
    return reflow.verify(audit, before.withColumnRenamed("rel_key", "dest_key"))


@_query(f"SELECT rel_key AS dest_key, verdict FROM {_VERIFY}", DOCS, SNAPS)
def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("dest_key", "verdict")


@_query(f"SELECT verdict, count(*) AS n FROM {_VERIFY} GROUP BY 1", DOCS, SNAPS)
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.tally(_verified(spark, sf_dir), "verdict")


@_query("SELECT 'p' || l_partkey AS dest_key, 's' || l_suppkey AS source_uri, count(*) AS seen_count, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen FROM lineitem GROUP BY 1, 2")
def dest_key_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dest_key"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_uri"), F.col("l_shipdate").alias("at"))
    return reflow.source_counts(rows).select("dest_key", "source_uri", "seen_count", _day("first_seen"), _day("last_seen"))


@_query(
    """SELECT c_nationkey AS lane, c_nationkey % 2 = 0 AS eof, count(*) AS admissions, CAST(sum(outs) AS BIGINT) AS outcomes, CAST(sum(units) AS BIGINT) AS work_units, CAST(sum(ends) AS BIGINT) AS durable_terminals, count(*) FILTER (WHERE outs = 0) AS missing_outcomes, CAST(sum(units - ended) AS BIGINT) AS missing_terminals,
      c_nationkey % 2 = 0 AND count(*) FILTER (WHERE outs = 0) = 0 AND sum(units - ended) = 0 AS terminal
    FROM (SELECT c.c_custkey, c.c_nationkey, count(DISTINCT o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'F') AS outs, count(DISTINCT o.o_orderkey) AS units, count(l.l_orderkey) AS ends, count(DISTINCT l.l_orderkey) AS ended
      FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2) GROUP BY 1, 2""",
)
def lane_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    admitted = read("customer").select(F.col("c_custkey").alias("admission_key"), F.col("c_nationkey").alias("lane"))
    lanes = admitted.select("lane").distinct().withColumn("eof", F.col("lane") % 2 == 0)
    orders = read("orders").select(F.col("o_custkey").alias("admission_key"), F.col("o_orderkey").alias("unit_key"), "o_orderstatus")
    return reflow.lane_status(lanes, admitted, orders.where("o_orderstatus = 'F'"), orders, read("lineitem").select(F.col("l_orderkey").alias("unit_key")))


def _atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("rel_key", F.col("doc_id").cast("string"))
    day = F.when(F.col("doc_id") % 9 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")).otherwise("someday")
    return atlas.build(docs, "text", {"lang": F.col("lang"), "site": F.concat(F.lit(" "), "source", F.lit("!")), "day": day}, ["lang", "site"], {"day": "day"})


@_query("SELECT CAST(doc_id AS VARCHAR) AS rel_key, sha256(text) AS content_sha256, 'lang=' || lang || '/site=' || source AS shard, CASE WHEN doc_id % 9 = 0 THEN 'invalid_temporal' ELSE 'indexed' END AS outcome FROM documents")
def atlas_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atlas(spark, sf_dir).select("rel_key", "content_sha256", "shard", "outcome")


@_query("SELECT count(*) AS tier1_keys, count(DISTINCT text) AS tier2_contents, count(DISTINCT (lang, source, text)) AS tier3_shard_contents FROM documents WHERE doc_id % 9 <> 0")
def atlas_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.stats(_atlas(spark, sf_dir))


@_query("SELECT CASE WHEN doc_id % 9 = 0 THEN 'invalid_temporal' ELSE 'indexed' END AS outcome, count(*) AS rows FROM documents GROUP BY 1")
def atlas_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.outcomes(_atlas(spark, sf_dir))


@_query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ongoing' WHEN 1 THEN CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'expired' ELSE 'completed' END WHEN 2 THEN 'unknown' END AS state FROM orders")
def restore_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey") % 4
    expiry = F.date_format("o_orderdate", "'Fri, 'dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(i == 0, 'ongoing-request="true"').when(i == 1, F.concat(F.lit('ongoing-request="false", expiry-date="'), expiry, F.lit('"'))).when(i == 2, "later")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", values.restore_state(header, F.lit("1999-01-01").cast("timestamp")).alias("state"))


@_query("SELECT doc_id, CASE WHEN n_chars >= 1024 THEN printf('%.1fKiB', n_chars / 1024.0) ELSE n_chars || 'B' END AS shown, CAST(n_chars * 1000 AS BIGINT) AS parsed FROM documents")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", values.format_size(n).alias("shown"), values.size_of(F.concat(n.cast("string"), F.lit(" kB"))).alias("parsed"))


#: A run's journal over documents: most are observed, some twice, others enriched.
LOG = """log AS (
  SELECT rel_key, 'observe' AS op, 'j' || CAST(doc_id % 3 AS VARCHAR) AS journal_id, doc_id AS sequence, TIMESTAMP '2024-06-01' + to_seconds(doc_id % 5000) AS seen, size_bytes, etag, storage_class, last_modified, NULL AS content_type FROM after
  UNION ALL SELECT rel_key, 'observe', 'k0', doc_id, TIMESTAMP '2024-06-02' + to_seconds(doc_id % 5000), CASE WHEN doc_id % 2 = 0 THEN size_bytes + 5 ELSE size_bytes END, etag, storage_class, last_modified, NULL FROM after WHERE doc_id % 7 = 1
  UNION ALL SELECT rel_key, 'enrich', 'e0', doc_id, TIMESTAMP '2024-06-03' + to_seconds(doc_id % 5000), NULL, NULL, NULL, NULL, 'text/html' FROM inv WHERE doc_id % 4 = 2)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, inv = views.snapshots(spark, sf_dir)[1], views.documents(spark, sf_dir)
    i = F.col("doc_id")
    at = lambda day: F.expr(f"timestamp_ntz'{day} 00:00:00' + make_dt_interval(0, 0, 0, cast(doc_id % 5000 as decimal(18, 6)))").alias("at")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("archive_status", "string"), ("restore_state", "string"), ("restore_expiry", "timestamp_ntz"))]
    end = [*none, F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("timestamp_ntz").alias("head_enriched_at")]
    first = after.select("rel_key", F.lit("observe").alias("op"), F.concat(F.lit("j"), (i % 3).cast("string")).alias("journal_id"), i.alias("sequence"), at("2024-06-01"), *merge.FIELDS, *end)
    again = after.where(i % 7 == 1).select("rel_key", F.lit("observe"), F.lit("k0"), i, at("2024-06-02"), F.when(i % 2 == 0, F.col("size_bytes") + 5).otherwise(F.col("size_bytes")), *merge.FIELDS[1:], *end)
    heads = inv.where(i % 4 == 2).select("rel_key", F.lit("enrich"), F.lit("e0"), i, at("2024-06-03"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"), *none, F.lit("text/html"), F.lit(None).cast("timestamp_ntz"))
    return first.union(again).union(heads)


@_query(
    """, st AS (SELECT l.*, lag(struct_pack(a := l.size_bytes, b := l.etag, c := l.storage_class, d := l.last_modified)) OVER w AS was, row_number() OVER w AS n, struct_pack(a := l.size_bytes, b := l.etag, c := l.storage_class, d := l.last_modified) AS now_, p.rel_key AS known, p.deleted_at AS dead, struct_pack(a := p.size_bytes, b := p.etag, c := p.storage_class, d := p.last_modified) AS before_
      FROM log l LEFT JOIN prior p USING (rel_key) WHERE op = 'observe' WINDOW w AS (PARTITION BY l.rel_key ORDER BY journal_id, sequence)),
    o AS (SELECT rel_key, arg_max(size_bytes, (journal_id, sequence)) AS size_bytes, arg_max(seen, (journal_id, sequence)) AS last_at, arg_min(seen, (journal_id, sequence)) AS first_at,
      arg_max(seen, (journal_id, sequence)) FILTER (WHERE CASE WHEN n > 1 THEN now_ IS DISTINCT FROM was ELSE known IS NULL OR dead IS NOT NULL OR now_ IS DISTINCT FROM before_ END) AS moved_at FROM st GROUP BY rel_key),
    e AS (SELECT rel_key, max(seen) AS head_at FROM log WHERE op = 'enrich' GROUP BY 1), m AS (SELECT coalesce(p.rel_key, o.rel_key) AS rel_key, o.rel_key IS NOT NULL AS seen_, p.* EXCLUDE (rel_key, size_bytes), o.* EXCLUDE (rel_key, size_bytes), CASE WHEN o.rel_key IS NULL THEN p.size_bytes ELSE o.size_bytes END AS size_bytes FROM prior p FULL OUTER JOIN o ON p.rel_key = o.rel_key)
    SELECT coalesce(index_set_id, 'set_new') AS index_set_id, m.rel_key, size_bytes, CASE WHEN seen_ THEN coalesce(first_seen_run_id, last_seen_run_id, 'run_9') ELSE first_seen_run_id END AS first_seen_run_id,
      CASE WHEN seen_ THEN CASE WHEN moved_at IS NOT NULL THEN 'run_9' ELSE coalesce(last_changed_run_id, last_seen_run_id, 'run_9') END ELSE last_changed_run_id END AS last_changed_run_id,
      epoch_us(CASE WHEN seen_ THEN coalesce(first_seen_at, last_seen_at, first_at) ELSE first_seen_at END) AS first_us, epoch_us(CASE WHEN seen_ THEN coalesce(moved_at, last_changed_at, last_seen_at, first_at) ELSE last_changed_at END) AS changed_us, epoch_us(CASE WHEN seen_ THEN last_at ELSE last_seen_at END) AS last_us,
      CASE WHEN seen_ THEN NULL WHEN deleted_at IS NULL AND """
    + _COVERED.replace("rel_key", "m.rel_key")
    + """ THEN '2024-06-01' ELSE strftime(deleted_at, '%Y-%m-%d') END AS deleted_at, CASE WHEN e.rel_key IS NULL THEN content_type ELSE 'text/html' END AS content_type, CASE WHEN e.rel_key IS NULL THEN archive_status END AS archive_status, epoch_us(CASE WHEN e.rel_key IS NULL THEN head_enriched_at ELSE head_at END) AS head_us
    FROM m LEFT JOIN e ON e.rel_key = m.rel_key""",
    DOCS,
    SNAPS,
    PRIOR,
    LOG,
    COVERAGE,
    SCOPES,
)
def compact_onto_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.fold(_prior(spark, sf_dir)[0], _log(spark, sf_dir), _coverage(spark), "run_9", "2024-06-01", index_set_id="set_new")
    us = lambda c, name: F.unix_micros(F.col(c).cast("timestamp")).alias(name)
    return out.select("index_set_id", "rel_key", "size_bytes", "first_seen_run_id", "last_changed_run_id", us("first_seen_at", "first_us"), us("last_changed_at", "changed_us"), us("last_seen_at", "last_us"), _day("deleted_at"), "content_type", "archive_status", us("head_enriched_at", "head_us"))


@_query("SELECT rel_key, CASE WHEN doc_id % 5 = 0 THEN 'text/csv' ELSE p.content_type END AS content_type, CASE WHEN doc_id % 5 <> 0 THEN p.restore_state END AS restore_state FROM prior p JOIN inv USING (rel_key)", DOCS, SNAPS, PRIOR)
def enrich_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = views.documents(spark, sf_dir).where("doc_id % 5 = 0").select("rel_key", F.lit("text/csv").alias("content_type"), *[F.lit(None).cast(t).alias(c) for c, t in (("archive_status", "string"), ("restore_state", "string"), ("restore_expiry", "timestamp_ntz"), ("head_enriched_at", "timestamp_ntz"))])
    return merge.enrich(_prior(spark, sf_dir)[0], heads).select("rel_key", "content_type", "restore_state")


@_query("SELECT rel_key, strftime(coalesce(first_seen_at, last_seen_at), '%Y-%m-%d') AS first_seen_at, coalesce(last_changed_run_id, last_seen_run_id) AS last_changed_run_id FROM prior", DOCS, SNAPS, PRIOR)
def backfill_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.backfill(_prior(spark, sf_dir)[0], views.runs(spark)).select("rel_key", _day("first_seen_at"), "last_changed_run_id")


@_query("SELECT rel_key, content_type FROM prior WHERE deleted_at IS NULL AND head_enriched_at >= TIMESTAMP '2024-03-01'", DOCS, SNAPS, PRIOR)
def idx_query_enriched_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.run(_prior(spark, sf_dir)[0], Q.Query(enriched_after="2024-03-01"), ("rel_key", "content_type"))


@_query("SELECT run_id, index_set_id, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 3", RUNS)
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.run_list(views.runs(spark), limit=3).select("run_id", "index_set_id", "status")


_TREE = ", kept AS (SELECT rel_key, size_bytes FROM inv WHERE starts_with(rel_key, 'A/') AND NOT regexp_matches(rel_key, '^A/F/[^/]*-0[1-6]-')), f AS (SELECT regexp_extract(rel_key, '^(.*/)?[^/]*$', 1) AS prefix, count(*) AS n FROM kept GROUP BY 1), c AS (SELECT DISTINCT array_to_string(list_slice(string_split(rel_key, '/'), 1, n), '/') || '/' AS child FROM kept, (SELECT unnest(range(1, 4)) AS n)), u AS (SELECT regexp_extract(child, '^(.*/)?[^/]+/$', 1) AS prefix, count(*) AS n FROM c GROUP BY 1), t AS (SELECT coalesce(f.prefix, u.prefix) AS prefix, coalesce(f.n, 0) AS direct_objects, coalesce(u.n, 0) AS child_prefixes FROM f FULL OUTER JOIN u ON f.prefix = u.prefix) "


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rollup.filtered_tree(views.lines(spark, sf_dir), 3, predicates.match(F.col("rel_key"), ["A/**"], ["A/F/*-0[1-6]-*/**"]), 100)


@_query(_TREE + "SELECT prefix, direct_objects, child_prefixes FROM t ORDER BY prefix LIMIT 100", LINES)
def tree_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[0].select("prefix", "direct_objects", "child_prefixes")


@_query(_TREE + "SELECT count(*) AS prefixes, CAST(sum(direct_objects) AS BIGINT) AS objects, count(*) > 100 AS truncated FROM t", LINES)
def tree_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[1]


@_query("SELECT count(*) AS prefixes, CAST(sum(n) AS BIGINT) AS objects, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT DISTINCT array_to_string(list_slice(string_split(rel_key, '/'), 1, n), '/') || CASE WHEN n > 0 THEN '/' ELSE '' END AS prefix FROM inv, (SELECT unnest(range(0, 4)) AS n)) LEFT JOIN (SELECT regexp_extract(rel_key, '^(.*/)?[^/]*$', 1) AS prefix, count(*) AS n, sum(size_bytes) AS b FROM inv GROUP BY 1) USING (prefix)", LINES)
def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.tree_totals(rollup.direct_prefixes(views.lines(spark, sf_dir)))


@_query("SELECT rel_key, copies FROM (SELECT rel_key, 1 AS copies FROM inv WHERE coalesce(trim(etag), '') = '' UNION ALL SELECT min(rel_key), count(*) FROM inv WHERE coalesce(trim(etag), '') <> '' GROUP BY etag) ORDER BY rel_key LIMIT 25", DOCS)
def canonical_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.canonical(views.documents(spark, sf_dir), "min_key", limit=25).select("rel_key", "copies")


@_query("SELECT journal_id, count(*) AS records, min(sequence) AS low, max(sequence) AS high, count(DISTINCT sequence) AS kinds FROM journal GROUP BY 1 HAVING min(sequence) <> 1 OR max(sequence) <> count(*) OR count(DISTINCT sequence) <> count(*)", JOURNAL)
def journal_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.broken_sequences(views.journal(spark, sf_dir))


@_query("SELECT journal_id, op, count(*) AS n FROM journal GROUP BY 1, 2", JOURNAL)
def journal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.journal(spark, sf_dir)
    return merge.union_journals(*[rows.where(F.col("journal_id") == j) for j in ("j0", "j1", "j2")]).groupBy("journal_id", "op").agg(F.count("*").alias("n"))


@_query(
    "SELECT rel_key, CASE WHEN doc_id % 6 = 0 THEN 'held/late/' || rel_key WHEN doc_id % 6 = 1 THEN 'own/' || doc_id ELSE split_part(rel_key, '/', 2) || '/' || split_part(rel_key, '/', 3) END AS dest_key FROM inv",
    DOCS,
)
def route_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, i = F.col("rel_key"), F.col("doc_id")
    explicit = F.when(i % 6 == 1, F.concat(F.lit("own/"), i.cast("string"))).otherwise("")
    rewritten = templates.Rewrite("{_}/{source}/{name}", "{source}/{name}").render(key)
    routed = templates.destination(F.when(i % 6 == 0, "quarantine").otherwise("normal"), templates.quarantine_key("/held/", F.lit("late"), F.concat(F.lit("/"), key)), explicit, rewritten)
    return views.documents(spark, sf_dir).select("rel_key", routed.alias("dest_key"))


@_query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || '-' || (o_orderkey % 7) ELSE CAST(o_custkey AS VARCHAR) END AS tag, o_orderkey % 3 = 0 AS multipart FROM orders",
)
def etag_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    raw = F.when(i % 3 == 0, F.concat(F.lit(' "'), c, F.lit("-"), (i % 7).cast("string"), F.lit('"'))).when(i % 3 == 1, F.concat(F.lit('W/"'), c, F.lit('" '))).otherwise(c)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", values.etag(raw).alias("tag"), values.is_multipart(raw).alias("multipart"))


@_query("SELECT event_id, CAST(event_id AS VARCHAR) || event_type AS label, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'kept' END AS old, 'given' AS owner FROM events")
def metadata_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.map_filter(F.create_map(F.lit("props"), F.col("props"), F.lit("old"), F.when(F.col("event_id") % 2 == 0, "kept"), F.lit("owner"), F.lit("was")), lambda k, v: v.isNotNull())
    system = {"id": F.col("event_id").cast("string"), "type": F.col("event_type")}
    made = metadata.apply_policy(meta, "merge", {"owner": metadata.expression("'given'", meta, system)})
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", metadata.expression("sys.id + sys.type", meta, system).alias("label"), metadata.expression("meta.props.k", meta, system).alias("k"), F.try_element_at(made, F.lit("old")).alias("old"), F.try_element_at(made, F.lit("owner")).alias("owner"))


@_query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 9 AS VARCHAR) END AS inner_value FROM events")
def xml_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in five isn't well-formed."""
    i = F.col("event_id")
    document = F.concat(F.lit("<r><kind> "), "event_type", F.lit("</kind><a><b>"), (i % 9).cast("string"), F.lit("</b><b>no</b></a>"), F.when(i % 5 == 0, "").otherwise("</r>"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", derive.xml_path(document, "//kind").alias("kind"), derive.xml_path(document, "/r/a/b").alias("inner_value"))


@_query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'four' WHEN doc_id % 3 = 0 THEN 'three' END AS value, CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 2 END AS place, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'normal' ELSE 'quarantine' END AS routing FROM documents")
def extract_first_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    value, place = derive.first_of(F.when(i % 4 == 0, "four"), F.when(i % 3 == 0, "three"))
    _, _, routing = derive.route({"value": value}, {"value": "quarantine"})
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", value.alias("value"), place.alias("place"), routing.alias("routing"))


@_query("SELECT DISTINCT etag FROM inv WHERE deleted_at IS NOT NULL AND etag IS NOT NULL AND etag NOT IN (SELECT etag FROM inv WHERE deleted_at IS NULL AND etag IS NOT NULL)", DOCS)
def retained_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.documents(spark, sf_dir).where("etag is not null")
    return retention.retained(rows.where("deleted_at is not null").select("etag").distinct(), rows.where("deleted_at is null"), "etag")


@_query("SELECT index_set_id, count(*) AS n FROM inv WHERE index_set_id <> 'set_b' GROUP BY 1", DOCS)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = views.runs(spark).where("index_set_id = 'set_b'").select("index_set_id")
    return retention.cascade(views.documents(spark, sf_dir), dropped).groupBy("index_set_id").agg(F.count("*").alias("n"))


@_query("SELECT storage_class AS kind, count(*) AS artifacts, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inv GROUP BY 1", DOCS)
def artifact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.artifact_summary(views.documents(spark, sf_dir).withColumnRenamed("storage_class", "kind"))


@_query("SELECT rel_key, size_bytes, storage_class, etag FROM inv WHERE storage_class = 'GLACIER' AND (starts_with(rel_key, 'en/src1') OR starts_with(rel_key, 'fr/'))", DOCS)
def enrichment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.enrichment_candidates(views.documents(spark, sf_dir), predicates.storage_class(F.col("storage_class"), ["GLACIER", ""]), predicates.in_scope(F.col("rel_key"), ["en/src1", "fr/"]))


@_query("SELECT starts_with(rel_key, 'en/src_') AS inside, starts_with(rel_key, '%') AS odd, count(*) AS n FROM inv GROUP BY 1, 2", DOCS)
def base_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base prefix with characters that a LIKE pattern would read as wildcards."""
    inside, outside = predicates.split_by_base(views.documents(spark, sf_dir), "en/src_", "rel_key")
    both = inside.select("rel_key", F.lit(True).alias("inside")).union(outside.select("rel_key", F.lit(False)))
    return both.groupBy("inside", predicates.prefix(F.col("rel_key"), "%").alias("odd")).agg(F.count("*").alias("n"))


@_query("SELECT CASE WHEN event_id % 3 = 0 THEN 'inv.object' END AS record_type, 's3://b/' || event_id AS source_uri, CASE WHEN event_id % 3 <> 2 THEN CAST(floor(value) AS BIGINT) END AS size_bytes FROM events WHERE event_id % 10 <> 9")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three forms: in an envelope, a bare object, a bare URI; one in ten is none of these."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("s3://b/"), F.col("event_id").cast("string")).alias("source_uri"), F.floor("value").alias("size_bytes"))
    i = F.col("event_id")
    boxed = records.envelope(events.where((i % 10 != 9) & (i % 3 == 0)).select("source_uri", "size_bytes"), "inv.object", "job", "s3")
    bare = events.where((i % 10 != 9) & (i % 3 == 1)).select(F.to_json(F.struct("source_uri", "size_bytes")).alias("value"))
    uris = events.where((i % 10 != 9) & (i % 3 == 2)).select(F.col("source_uri").alias("value"))
    junk = events.where(i % 10 == 9).select(F.concat(F.lit("not a record "), "source_uri").alias("value"))
    return records.parse_lines(boxed.union(bare).union(uris).union(junk), "source_uri string, size_bytes long")[0]


@_query("SELECT rel_key, journal_id, sequence, event_type, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY rel_key ORDER BY journal_id DESC, sequence DESC) AS rn FROM journal) WHERE rn = 1", JOURNAL)
def events_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold that the streaming merge applies to each batch, over the whole journal in two batches."""
    from gannet.streaming.merge import fold

    rows, fields = views.journal(spark, sf_dir), ("event_type", "size_bytes")
    return fold(fold(None, rows.where("sequence % 2 = 1"), fields), rows.where("sequence % 2 = 0"), fields).select("rel_key", "journal_id", "sequence", *fields)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level prefixes of what an index query with a glob matches."""
    rows = views.documents(spark, sf_dir)
    return rollup.top_level(rows.where(Q.Query(pattern="**/*.txt").where(rows)))
