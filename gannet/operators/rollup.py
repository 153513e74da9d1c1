"""Summaries: index sets, runs, prefixes and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_prefix(key: Column) -> Column:
    """Up to the first slash, with it; empty without one."""
    return F.when(F.instr(key, "/") == 0, F.lit("")).otherwise(F.substring(key, F.lit(1), F.instr(key, "/")))


def rel_key(base: str, key: Column) -> Column:
    rest = F.when(key.startswith(base), F.substring(key, F.lit(len(base) + 1), F.length(key))).otherwise(key)
    return F.when(rest.startswith("/"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)


def full_key(base: str, key: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), key) if base else key


def set_summary(rows: DataFrame, by: str = "index_set_id") -> DataFrame:
    live = F.col("deleted_at").isNull()
    return rows.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(live).alias("active"),
        F.count_if(~live).alias("deleted"),
        F.coalesce(F.sum(F.when(live, F.col("size_bytes"))), F.lit(0)).alias("active_bytes"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    kinds = ("running", "success", "partial", "failed", "failed-resumable")
    return runs.groupBy("index_set_id").agg(F.count("*").alias("runs"), *[F.count_if(F.col("status") == k).alias(k.replace("-", "_")) for k in kinds])


def top_level(rows: DataFrame) -> DataFrame:
    live = rows.where("deleted_at is null")
    grouped = live.groupBy(top_prefix(F.col("rel_key")).alias("prefix")).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return grouped.orderBy(F.desc("objects"), F.desc("bytes"), "prefix")


def latest_run(runs: DataFrame, only_success: bool = False) -> DataFrame:
    """The latest run of each set by start, then id; nothing is sorted."""
    some = runs.where("status = 'success'") if only_success else runs
    return some.groupBy("index_set_id").agg(F.max_by(F.struct("run_id", "started_at", "status"), F.struct("started_at", "run_id")).alias("r")).select("index_set_id", "r.*")


def run_list(runs: DataFrame, index_set: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs, the newest first."""
    some = runs if index_set is None else runs.where(F.col("index_set_id") == index_set)
    out = some.orderBy(F.desc("started_at"), F.desc("run_id"))
    return out if limit is None else out.limit(limit)


def list_with_stats(rows: DataFrame, runs: DataFrame) -> DataFrame:
    stats = set_summary(rows).select("index_set_id", "active", "active_bytes")
    count = runs.groupBy("index_set_id").agg(F.count("*").alias("runs"))
    last = latest_run(runs).select("index_set_id", F.col("run_id").alias("latest_run"), F.col("status").alias("latest_status"))
    return stats.join(count, "index_set_id", "left").join(last, "index_set_id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def deleted_stats(rows: DataFrame) -> DataFrame:
    return rows.where("deleted_at is not null").agg(F.count("*").alias("deleted"), F.min("deleted_at").alias("oldest"), F.max("deleted_at").alias("newest"))


def manifest_counts(rows: DataFrame) -> DataFrame:
    live = F.col("deleted_at").isNull()
    return rows.agg(
        F.count("*").alias("row_count"), F.count_if(live).alias("active"), F.count_if(~live).alias("tombstones"), F.count_distinct(F.nullif(F.col("etag"), F.lit(""))).alias("distinct_etags")
    )


def segment_stats(rows: DataFrame, segment: Column) -> DataFrame:
    return rows.groupBy(segment.alias("segment")).agg(
        F.min("rel_key").alias("min_key"),
        F.max("rel_key").alias("max_key"),
        F.count("*").alias("row_count"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("tombstones"),
        F.count_distinct(F.nullif(F.col("etag"), F.lit(""))).alias("distinct_etags"),
    )


def crawl_summary(listed: DataFrame, matches: Column, error: Column | None = None) -> DataFrame:
    """listed, matched, bytes, and errors where a column tells what failed; a row that is an error isn't a listed object."""
    yes = F.coalesce(matches, F.lit(False))
    if error is not None:
        good = error.isNull()
        return listed.agg(F.count_if(good).alias("listed"), F.count_if(good & yes).alias("matched"), F.coalesce(F.sum(F.when(good & yes, F.col("size_bytes"))), F.lit(0)).alias("bytes"), F.count_if(~good).alias("errors"))
    return listed.agg(F.count("*").alias("listed"), F.count_if(yes).alias("matched"), F.coalesce(F.sum(F.when(yes, F.col("size_bytes"))), F.lit(0)).alias("bytes"))


def gate(summary: DataFrame, min_objects: int | None = None, max_bytes: int | None = None) -> None:
    """Raises if a crawl matched too few objects or too many bytes."""
    row = summary.first()
    if min_objects is not None and row["matched"] < min_objects:
        raise ValueError(f"{row['matched']} objects matched, {min_objects} are needed")
    if max_bytes is not None and row["bytes"] > max_bytes:
        raise ValueError(f"{row['bytes']} bytes matched, {max_bytes} are allowed")


def ancestors(key: Column, depth: int) -> Column:
    """The prefixes above a key, from the root ('') down to so many levels, each with its slash."""
    parts = F.split(key, "/")
    levels = F.least(F.size(parts) - 1, F.lit(depth))
    below = F.when(levels > 0, F.transform(F.sequence(F.lit(1), levels), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    return F.concat(F.array(F.lit("")), F.coalesce(below, F.array().cast("array<string>")))


def _folder(key: Column) -> Column:
    """What stands before a key's last slash, with it."""
    return F.substring(key, F.lit(1), F.length(key) - F.length(F.substring_index(key, "/", -1)))


def prefix_tree(rows: DataFrame, depth: int) -> DataFrame:
    """For each prefix down to a depth: all objects and bytes below it.

    Objects are folded by their folder first, so that only folders meet their ancestors.
    """
    folders = rows.groupBy(_folder(F.col("rel_key")).alias("folder")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    up = folders.select(F.explode(ancestors(F.col("folder"), depth)).alias("prefix"), "n", "b")
    return up.groupBy("prefix").agg(F.sum("n").alias("objects"), F.sum("b").alias("bytes"), (F.size(F.split("prefix", "/")) - 1).alias("depth"))


def direct_prefixes(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """For each prefix: objects and bytes that stand directly in it, and prefixes directly under it."""
    files = rows.groupBy(_folder(F.col("rel_key")).alias("prefix")).agg(F.count("*").alias("direct_objects"), F.sum("size_bytes").alias("direct_bytes"))
    folders = files.select(F.explode(ancestors(F.col("prefix"), depth or 1000)).alias("child")).where("child != ''").distinct()
    under = folders.groupBy(F.regexp_extract("child", "^(.*/)?[^/]+/$", 1).alias("prefix")).agg(F.count("*").alias("child_prefixes"))
    both = files.join(under, "prefix", "full_outer")
    out = both.select("prefix", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("direct_objects", "direct_bytes", "child_prefixes")])
    return out if depth is None else out.where(F.size(F.split("prefix", "/")) - 1 <= depth)


def filtered_tree(rows: DataFrame, depth: int, matches: Column, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """direct_prefixes of the rows that match, the first `most` prefixes by name, and a row of totals: prefixes there are, and whether some were left out.

    matches is any predicate on keys, such as includes and excludes. The cap is the caller's wish.
    """
    tree = direct_prefixes(rows.where(matches), depth)
    left_out = F.lit(False) if most is None else F.col("prefixes") > most
    return (tree if most is None else tree.orderBy("prefix").limit(most)), tree.agg(F.count("*").alias("prefixes"), F.coalesce(F.sum("direct_objects"), F.lit(0)).alias("objects")).withColumn("truncated", left_out)


def tree_totals(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count("*").alias("prefixes"), F.sum("direct_objects").alias("objects"), F.sum("direct_bytes").alias("bytes"))


def common_prefixes(rows: DataFrame, start: str = "", delimiter: str = "/") -> DataFrame:
    """What a delimited listing under a prefix gives: objects, and prefixes each once."""
    under = rows.where(F.col("rel_key").startswith(start))
    rest = F.substring("rel_key", F.lit(len(start) + 1), F.length("rel_key"))
    at = F.instr(rest, delimiter)
    name = F.concat(F.lit(start), F.when(at == 0, rest).otherwise(F.substring(rest, F.lit(1), at)))
    return under.groupBy(name.alias("name"), F.when(at == 0, "object").otherwise("prefix").alias("kind")).agg(F.count("*").alias("objects"))


def shards(rows: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """Distinct prefixes of so many segments, in order; a cap is the caller's wish."""
    parts = F.split("rel_key", "/")
    found = rows.where(F.size(parts) > depth).select(F.concat(F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/")).alias("shard")).distinct().orderBy("shard")
    return found if most is None else found.limit(most)
