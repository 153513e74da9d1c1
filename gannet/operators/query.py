"""Index queries: filter, then count, or order and limit, or group by content."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gannet.operators import predicates as P

COLUMNS = ("rel_key", "size_bytes", "last_modified", "etag", "storage_class", "deleted_at")


@dataclass(frozen=True)
class Query:
    pattern: str | None = None
    regex: str | None = None
    prefix: str = ""
    min_size: int | None = None
    max_size: int | None = None
    after: str | None = None
    before: str | None = None
    storage_classes: tuple[str, ...] = ()
    enriched_after: str | None = None
    include_deleted: bool = False
    limit: int | None = None

    def where(self, rows: DataFrame) -> Column:
        key = F.col("rel_key")
        return P.every(
            P.glob(key, self.pattern) if self.pattern else None,
            P.regex(key, self.regex) if self.regex else None,
            P.prefix(key, self.prefix) if self.prefix else None,
            P.size_between(F.col("size_bytes"), self.min_size, self.max_size),
            P.modified_query(F.col("last_modified"), self.after, self.before),
            P.storage_class(F.col("storage_class"), self.storage_classes) if self.storage_classes else None,
            F.col("head_enriched_at") >= F.lit(self.enriched_after).cast("timestamp_ntz") if self.enriched_after else None,
            None if self.include_deleted else P.not_deleted(F.col("deleted_at")),
        )


def run(rows: DataFrame, q: Query, columns: Iterable[str] = COLUMNS) -> DataFrame:
    out = rows.where(q.where(rows)).select(*columns).orderBy("rel_key")
    return out.limit(q.limit) if q.limit is not None else out


def count(rows: DataFrame, q: Query) -> DataFrame:
    """The number of matches; a limit doesn't count."""
    return rows.where(q.where(rows)).agg(F.count("*").alias("matches"))


RULES = {
    "min_key": lambda: [F.col("rel_key")],
    "min_modified": lambda: [F.col("last_modified").asc_nulls_last(), F.col("rel_key")],
    "max_modified": lambda: [F.col("last_modified").desc_nulls_last(), F.col("rel_key")],
}


def canonical(rows: DataFrame, rule: str = "min_key", limit: int | None = None) -> DataFrame:
    """One row for each entity tag, chosen by the rule, with the number and keys of the others; rows without a tag, or with a blank one, pass as they are.

    The choice is an aggregate of the least of a struct, so a tag's rows are folded before the
    shuffle and never sorted in one task. The keys of the others are gathered only for the
    result, whose row they are part of.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule!r}")
    tagged = F.coalesce(F.trim("etag"), F.lit("")) != ""
    micros = F.unix_micros(F.col("last_modified").cast("timestamp"))
    order = {"min_key": [], "min_modified": [F.coalesce(micros, F.lit(2**62))], "max_modified": [F.coalesce(-micros, F.lit(2**62))]}[rule]
    rank = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col("rel_key").alias("key"))
    row = F.struct(*[F.col(c) for c in rows.columns])
    grouped = rows.where(tagged).groupBy(F.col("etag").alias("group_etag")).agg(F.min_by(row, rank).alias("row"), F.count("*").alias("copies"), F.collect_list("rel_key").alias("keys"))
    picked = grouped.select("row.*", "copies", F.sort_array(F.filter("keys", lambda k: k != F.col("row.rel_key"))).alias("alternates"))
    plain = rows.where(~tagged).withColumn("copies", F.lit(1).cast("long")).withColumn("alternates", F.array().cast("array<string>"))
    out = picked.unionByName(plain).orderBy("rel_key")
    return out.limit(limit) if limit is not None else out


def canonical_ranked(rows: DataFrame, rule: str = "min_key") -> DataFrame:
    """The same choice as row numbers within each tag."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("etag").orderBy(*RULES[rule]())))


def resolve_boundary(runs: DataFrame, run_id: str, index_set: str | None = None) -> dict:
    """The run to measure changes from; raises unless it exists, in the set, and succeeded."""
    found = runs.where(F.col("run_id") == run_id).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"no such run: {run_id}")
    row = found[0].asDict()
    if row["status"] != "success":
        raise ValueError(f"run {run_id} didn't succeed")
    if index_set is not None and row.get("index_set_id") not in (None, index_set):
        raise ValueError(f"run {run_id} belongs to another index set")
    return row


def since_run(rows: DataFrame, runs: DataFrame, boundary: str) -> DataFrame:
    """Rows first seen or changed by a run that started after the boundary, with change_kind.

    Membership goes by the runs' start times, the label by the row's own times, so a row may
    have no label.
    """
    started = F.lit(boundary).cast("timestamp_ntz")
    later = runs.where(F.col("started_at") > started).select("run_id").distinct()
    first = later.select(F.col("run_id").alias("first_seen_run_id"), F.lit(True).alias("_first"))
    changed = later.select(F.col("run_id").alias("last_changed_run_id"), F.lit(True).alias("_changed"))
    both = rows.join(first, "first_seen_run_id", "left").join(changed, "last_changed_run_id", "left")
    kept = both.where(F.coalesce("_first", "_changed", F.lit(False))).drop("_first", "_changed")
    kind = F.when(F.col("first_seen_at") > started, "added").when(F.col("last_changed_at") > started, "changed")
    return kept.withColumn("change_kind", kind).select(*rows.columns, "change_kind")
