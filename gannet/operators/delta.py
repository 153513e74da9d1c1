"""Comparing two snapshots of one index."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gannet.operators.predicates import covered
from gannet.plans.partition import canonical_json

FIELDS = ("size_bytes", "last_modified", "storage_class")


def _sides(a: DataFrame, b: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    left = a.select("rel_key", F.struct(*fields, "deleted_at" if "deleted_at" in a.columns else F.lit(None).cast("timestamp_ntz").alias("deleted_at")).alias("a"))
    right = b.select("rel_key", F.struct(*fields, "deleted_at" if "deleted_at" in b.columns else F.lit(None).cast("timestamp_ntz").alias("deleted_at")).alias("b"))
    return left.join(right, "rel_key", "full_outer")


def parity(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every key of either side with what differs: left_only, right_only, differs or equal."""
    differs = reduce(or_, [~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields])
    kind = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(differs, "differs").otherwise("equal")
    return _sides(a, b, fields).select("rel_key", kind.alias("parity"), F.col("a.size_bytes").alias("left_size"), F.col("b.size_bytes").alias("right_size"))


def compare(before: DataFrame, after: DataFrame, coverage: DataFrame | None = None, fields: tuple[str, ...] = ("size_bytes", "etag", "storage_class", "last_modified"), coverage_before: DataFrame | None = None) -> DataFrame:
    """added, changed, tombstoned or unchanged for each key; with coverage also whether both runs cover it.

    Deleted on both sides is changed or unchanged, by its fields. A tombstone only after is an error
    (kind "error"); a key deleted before and gone after is left out. coverage is the later
    run's, coverage_before the earlier one's (the same if not given).
    """
    differs = reduce(or_, [~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields])
    was, now = F.col("a").isNotNull() & F.col("a.deleted_at").isNull(), F.col("b").isNotNull() & F.col("b.deleted_at").isNull()
    kind = (
        F.when(F.col("a").isNull() & ~now, "error")
        .when(F.col("b").isNull() & ~was, F.lit(None).cast("string"))
        .when(now & ~was, "added")
        .when(was & ~now, "tombstoned")
        .when(differs, "changed")
        .otherwise("unchanged")
    )
    out = _sides(before, after, fields).select("rel_key", kind.alias("kind")).where("kind is not null")
    if coverage is None:
        return out
    both = covered(covered(out, coverage_before or coverage, name="_before"), coverage)
    return both.select("rel_key", "kind", (F.col("_before") & F.col("covered")).alias("covered"))


def check_covered(compared: DataFrame) -> None:
    """Raises if a row lies outside either run's coverage, or a tombstone has no row before it."""
    bad = compared.where("kind = 'error' or not covered").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['kind']} row outside coverage: {bad[0]['rel_key']}")


def check_snapshots(before: dict, after: dict, parent_needed: bool = False) -> None:
    """Raises unless two manifests can be compared: of one index set and two runs, in order, each with coverage that is confirmed, complete, explicit and without gaps or windows."""
    if before.get("index_set_id") != after.get("index_set_id"):
        raise ValueError("the snapshots are of different index sets")
    if before["run_id"] == after["run_id"]:
        raise ValueError("both snapshots are of one run")
    if before.get("created_at") and after.get("created_at") and after["created_at"] < before["created_at"]:
        raise ValueError("the later snapshot is older")
    if parent_needed and before["run_id"] not in after.get("parents", ()):
        raise ValueError("the later snapshot wasn't made from the earlier one")
    for side, manifest in (("earlier", before), ("later", after)):
        entries = manifest.get("coverage") or []
        if not entries or any(e.get("basis") != "confirmed" or not e.get("complete") or e.get("gaps") or e.get("windowed") or not (e.get("scope") or "").strip() for e in entries):
            raise ValueError(f"the {side} snapshot's coverage isn't confirmed, complete, explicit and ungapped")


def counts(compared: DataFrame) -> DataFrame:
    kinds = ("added", "changed", "tombstoned", "unchanged")
    return compared.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def details(compared: DataFrame, limit: int) -> DataFrame:
    """The first changes by key: a bounded report beside exact counts."""
    return compared.where("kind != 'unchanged'").orderBy("rel_key").limit(limit)


def by_prefix(compared: DataFrame, prefixes: list[str]) -> DataFrame:
    """Counts by the longest plan prefix that a key begins with ('' for none).

    Prefixes come from a plan on the driver; they are compiled to one expression, the longest
    first, so no join is needed.
    """
    place = F.lit("")
    for p in sorted(set(prefixes), key=lambda p: (len(p), p)):
        place = F.when(F.col("rel_key").startswith(p), F.lit(p)).otherwise(place)
    return (
        compared.groupBy(place.alias("prefix"))
        .agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "changed", "unchanged")])
        .orderBy("prefix")
    )


def digest(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A digest of a projection that doesn't depend on order: rows, and the sum and xor of their hashes."""
    h = F.xxhash64("rel_key", *fields)
    return rows.agg(F.count("*").alias("row_count"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def ordered_digest(rows: DataFrame) -> str:
    """The SHA-256 of a snapshot's projection, one JSON line for each row in key order.

    Such a digest can't be split: rows are sorted by Spark and read in order, one partition at a
    time, by the driver. digest() tells whether two snapshots are equal without that.
    """
    stamp = F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lines = rows.select("rel_key", F.col("size_bytes").cast("long"), F.regexp_replace(stamp, r"\.?0+Z$", "Z").alias("last_modified"), "storage_class").orderBy("rel_key")
    out = hashlib.sha256()
    for r in lines.toLocalIterator(prefetchPartitions=False):
        line = {"rel_key": r["rel_key"], "size_bytes": r["size_bytes"] or 0} | {k: r[k] for k in ("last_modified", "storage_class") if r[k]}
        out.update(canonical_json(line).encode() + b"\n")
    return out.hexdigest()


def added_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    added = after.join(before, "rel_key", "left_anti").select("rel_key", F.lit("added").alias("side"))
    return added.union(before.join(after, "rel_key", "left_anti").select("rel_key", F.lit("removed")))


def first_per(rows: DataFrame, by: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy("rel_key")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
