"""Inventories as projections of ordinary tables: what the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs that the inventories' lineage refers to.
RUNS = [
    ("run_1", "set_a", "success", "2024-01-01 00:00:00"),
    ("run_2", "set_a", "success", "2024-02-01 00:00:00"),
    ("run_3", "set_a", "failed", "2024-03-01 00:00:00"),
    ("run_4", "set_b", "partial", "2024-02-15 00:00:00"),
    ("run_5", "set_b", "failed-resumable", "2024-01-20 00:00:00"),
]
RUNS_SQL = "runs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', TIMESTAMP '{d}')" for a, b, c, d in RUNS) + ") t(run_id, index_set_id, status, started_at))"

DOCUMENTS_SQL = """
inv AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'set_b' ELSE 'set_a' END AS index_set_id,
         lang || '/' || source || '/' || CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 8 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 8, '0') END || '.txt' AS rel_key,
         n_chars AS size_bytes, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE md5(text) END AS etag,
         CASE doc_id % 4 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'GLACIER' WHEN 2 THEN 'STANDARD_IA' END AS storage_class,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) END AS last_modified,
         CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-04-01' + to_days(CAST(doc_id % 30 AS INTEGER)) END AS deleted_at,
         CASE WHEN doc_id % 2 = 0 THEN 'run_1' ELSE 'run_2' END AS first_seen_run_id,
         CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS first_seen_at,
         CASE WHEN doc_id % 5 = 0 THEN 'run_3' WHEN doc_id % 2 = 0 THEN 'run_1' ELSE 'run_2' END AS last_changed_run_id,
         CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-03-01' WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS last_changed_at,
         'run_3' AS last_seen_run_id, TIMESTAMP '2024-03-01' AS last_seen_at, doc_id
  FROM documents)"""

LINES_SQL = """
inv AS (
  SELECT l_returnflag || '/' || l_linestatus || '/' || strftime(l_shipdate, '%Y-%m-%d') || '/' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS rel_key,
         CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, l_shipdate AS last_modified, l_orderkey, l_linenumber
  FROM lineitem)"""

#: A snapshot before and one after: rows come, go and change by their id.
SNAPSHOTS_SQL = """
before AS (SELECT rel_key, size_bytes, etag, storage_class, last_modified, CASE WHEN doc_id % 10 = 4 THEN TIMESTAMP '2024-01-01' END AS deleted_at, doc_id FROM inv WHERE doc_id % 10 < 8),
after AS (SELECT rel_key, CASE WHEN doc_id % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, etag, storage_class, last_modified, CASE WHEN doc_id % 20 IN (4, 5) THEN TIMESTAMP '2024-05-01' END AS deleted_at, doc_id FROM inv WHERE doc_id % 10 >= 2)"""

JOURNAL_SQL = """
journal AS (
  SELECT 'u/' || CAST(user_id AS VARCHAR) AS rel_key, CASE WHEN event_type = 'purchase' THEN 'enrich' ELSE 'observe' END AS op,
         'j' || CAST(event_id % 3 AS VARCHAR) AS journal_id, event_id AS sequence, ts AS seen, event_type, CAST(floor(value) AS BIGINT) AS size_bytes
  FROM events)"""

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(day: str):
    return F.lit(day).cast("timestamp_ntz")


def _days(start: str, n):
    return (F.date_add(F.lit(start).cast("date"), n.cast("int"))).cast("timestamp_ntz")


def runs(spark: SparkSession) -> DataFrame:
    made = spark.createDataFrame(RUNS, "run_id string, index_set_id string, status string, started_at string")
    return made.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(F.length(i.cast("string")) >= 8, i.cast("string")).otherwise(F.lpad(i.cast("string"), 8, "0"))
    even, fifth = i % 2 == 0, i % 5 == 0
    return _read(spark, sf_dir, "documents").select(
        F.when(i % 3 == 0, "set_b").otherwise("set_a").alias("index_set_id"),
        F.concat("lang", F.lit("/"), "source", F.lit("/"), name, F.lit(".txt")).alias("rel_key"),
        F.col("n_chars").alias("size_bytes"),
        F.when(i % 13 != 0, F.md5("text")).alias("etag"),
        F.when(i % 4 == 0, "STANDARD").when(i % 4 == 1, "GLACIER").when(i % 4 == 2, "STANDARD_IA").alias("storage_class"),
        F.when(i % 17 != 0, _days("2024-01-01", i % 90)).alias("last_modified"),
        F.when(i % 11 == 0, _days("2024-04-01", i % 30)).alias("deleted_at"),
        F.when(even, "run_1").otherwise("run_2").alias("first_seen_run_id"),
        F.when(even, _at("2024-01-01")).otherwise(_at("2024-02-01")).alias("first_seen_at"),
        F.when(fifth, "run_3").when(even, "run_1").otherwise("run_2").alias("last_changed_run_id"),
        F.when(fifth, _at("2024-03-01")).when(even, _at("2024-01-01")).otherwise(_at("2024-02-01")).alias("last_changed_at"),
        F.lit("run_3").alias("last_seen_run_id"),
        _at("2024-03-01").alias("last_seen_at"),
        "doc_id",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    return _read(spark, sf_dir, "lineitem").select(key.alias("rel_key"), F.floor("l_extendedprice").alias("size_bytes"), F.col("l_shipdate").alias("last_modified"), "l_orderkey", "l_linenumber")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inv = documents(spark, sf_dir)
    i = F.col("doc_id")
    fields = ("rel_key", "size_bytes", "etag", "storage_class", "last_modified")
    before = inv.where(i % 10 < 8).select(*fields, F.when(i % 10 == 4, _at("2024-01-01")).alias("deleted_at"), "doc_id")
    after = inv.where(i % 10 >= 2).withColumn("size_bytes", F.when(i % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return before, after.select(*fields, F.when((i % 20).isin(4, 5), _at("2024-05-01")).alias("deleted_at"), "doc_id")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("rel_key"),
        F.when(F.col("event_type") == "purchase", "enrich").otherwise("observe").alias("op"),
        F.concat(F.lit("j"), (F.col("event_id") % 3).cast("string")).alias("journal_id"),
        F.col("event_id").alias("sequence"),
        F.col("ts").alias("at"),
        "event_type",
        F.floor("value").alias("size_bytes"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1).alias("rel_key"), "html")


PAGES_SQL = "inv AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?]*)', 1) AS rel_key, html FROM pages)"
