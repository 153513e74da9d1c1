"""Moving objects: collisions, verification, audit counts and lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gannet.functions.values import etag, is_multipart

MODES = ("fail", "skip-if-duplicate", "quarantine", "overwrite-if-source-newer")  # fixed values


def is_duplicate(source_provider: Column, dest_provider: Column, source_etag: Column, dest_etag: Column, source_size: Column, dest_size: Column) -> Column:
    """Comparable providers, equal strong tags, sizes equal or unknown."""
    source = F.coalesce(F.nullif(F.trim(source_provider), F.lit("")), F.lit("s3"))
    tags = (F.coalesce(source_etag, F.lit("")) != "") & source_etag.eqNullSafe(dest_etag) & ~is_multipart(source_etag)
    sizes = (F.coalesce(source_size, F.lit(0)) <= 0) | (F.coalesce(dest_size, F.lit(0)) <= 0) | source_size.eqNullSafe(dest_size)
    return source.eqNullSafe(dest_provider) & (source != "file") & tags & sizes


def same_body(source_size: Column, dest_size: Column, source_body: Column, dest_body: Column) -> Column:
    """Equal contents where tags don't tell; hashes matter only if sizes agree."""
    return F.when(source_size == dest_size, F.sha2(source_body, 256) == F.sha2(dest_body, 256)).otherwise(False)


def decide(pairs: DataFrame, mode: str) -> DataFrame:
    """decision and reason for rows of source_* and dest_* columns joined on dest_key.

    A null dest_found means the place is free. With columns source_body and dest_body (null where
    a provider gives none), contents of equal size that tags don't tell apart are compared by hash.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    c = F.col
    free = c("dest_found").isNull()
    same = is_duplicate(c("source_provider"), c("dest_provider"), c("source_etag"), c("dest_etag"), c("source_size"), c("dest_size"))
    if {"source_body", "dest_body"} <= set(pairs.columns):
        same = same | F.coalesce(same_body(c("source_size"), c("dest_size"), c("source_body"), c("dest_body")), F.lit(False))
    on_same = ("error", "collision.duplicate") if mode == "fail" else ("skipped", "collision.duplicate")
    decision, reason = F.when(free, "copy").when(same, on_same[0]), F.when(free, "none").when(same, on_same[1])
    if mode == "overwrite-if-source-newer":
        newer, tie = c("source_modified") > c("dest_modified"), c("source_modified") == c("dest_modified")
        steps = [
            (c("dest_modified").isNull(), "error", "collision.missing_dest_last_modified"),
            (newer, "overwrite", "source_newer"),
            (tie & c("source_size").isNull(), "error", "collision.source_size_unavailable"),
            (tie & (c("source_size") != c("dest_size")), "overwrite", "equal_time_size_differs"),
        ]
        for test, d, r in steps:
            decision, reason = decision.when(test, d), reason.when(test, r)
        decision, reason = decision.otherwise("skipped"), reason.otherwise("collision.skipped_src_older")
    else:
        decision, reason = decision.otherwise("error"), reason.otherwise("collision.conflict")
    return pairs.withColumn("decision", decision).withColumn("reason", reason)


def verify(audit: DataFrame, heads: DataFrame) -> DataFrame:
    """A verdict for each audit row (dest_key, source_size, source_etag), and whether its tags compare."""
    h = heads.select("dest_key", F.col("size_bytes").alias("dest_size"), etag(F.col("etag")).alias("_dst"), F.lit(True).alias("_found"))
    src, dst = F.coalesce(etag(F.col("source_etag")), F.lit("")), F.coalesce("_dst", F.lit(""))
    both = (src != "") & (dst != "")
    verdict = (
        F.when(F.col("_found").isNull(), "missing")
        .when(~F.col("source_size").eqNullSafe(F.col("dest_size")), "size_mismatch")
        .when(both & (src != dst), "verified_size_etag_differs")
        .otherwise("verified")
    )
    comparable = F.col("_found").isNotNull() & both & ~is_multipart(src) & ~is_multipart(dst)
    return audit.join(h, "dest_key", "left").withColumn("verdict", verdict).withColumn("etag_comparable", comparable).drop("_dst", "_found")


def tally(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(by)


def source_counts(seen: DataFrame) -> DataFrame:
    """How often each source wrote to each destination key, first and last."""
    return seen.groupBy("dest_key", "source_uri").agg(F.count("*").alias("seen_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def lane_status(lanes: DataFrame, admissions: DataFrame, outcomes: DataFrame, units: DataFrame, terminals: DataFrame) -> DataFrame:
    """For each lane: admissions, outcomes, units, terminals, what is missing, and whether it has ended.

    Keys: lane in lanes and admissions, admission_key, unit_key. Counts are folded by key before
    they meet, so a lane with many rows is one row in the last joins.
    """
    out = outcomes.groupBy("admission_key").agg(F.count("*").alias("outs"))
    done = terminals.groupBy("unit_key").agg(F.count("*").alias("ends"))
    work = units.join(done, "unit_key", "left").groupBy("admission_key").agg(F.count("*").alias("units"), F.sum(F.coalesce("ends", F.lit(0))).alias("ends"), F.count_if(F.col("ends").isNull()).alias("open"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    by = admissions.join(out, "admission_key", "left").join(work, "admission_key", "left").groupBy("lane").agg(
        F.count("*").alias("admissions"),
        F.sum(zero("outs")).alias("outcomes"),
        F.sum(zero("units")).alias("work_units"),
        F.sum(zero("ends")).alias("durable_terminals"),
        F.count_if(F.col("outs").isNull()).alias("missing_outcomes"),
        F.sum(zero("open")).alias("missing_terminals"),
    )
    names = ("admissions", "outcomes", "work_units", "durable_terminals", "missing_outcomes", "missing_terminals")
    joined = lanes.select("lane", "eof").join(by, "lane", "left").select("lane", "eof", *[zero(n).alias(n) for n in names])
    return joined.withColumn("terminal", F.col("eof") & (F.col("missing_outcomes") == 0) & (F.col("missing_terminals") == 0))
