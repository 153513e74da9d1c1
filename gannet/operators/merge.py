"""Merging observations into the current state."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gannet.operators.predicates import covered

FIELDS = ("size_bytes", "etag", "storage_class", "last_modified")


def changed(a: str, b: str, fields: tuple[str, ...] = FIELDS) -> Column:
    """Whether any field differs, nulls being equal."""
    return reduce(or_, [~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in fields])


LINEAGE = ("first_seen_run_id", "first_seen_at", "last_changed_run_id", "last_changed_at", "last_seen_run_id", "last_seen_at")


def upsert(prior: DataFrame, observed: DataFrame, run_id: str, run_at: str, keys: tuple[str, ...] = ("rel_key",), fields: tuple[str, ...] = FIELDS, order: str | None = None) -> DataFrame:
    """The state after a listing: one full outer join on the keys; all columns of prior, in their order.

    observed has the keys and fields; of a key observed more than once the last row by `order`
    counts, or without one the greatest by its fields. Seen again, a deleted row lives again.
    Lineage that a prior row lacks is taken from when it was last seen. Other columns of prior, such as
    those of enrichment, stay; new keys have nulls there.
    """
    now, run = F.lit(run_at).cast("timestamp_ntz"), F.lit(run_id)
    last = F.max(F.struct(*fields)) if order is None else F.max_by(F.struct(*fields), order)
    seen = observed.groupBy(*keys).agg(last.alias("o")).select(*keys, "o.*", F.lit(True).alias("_seen"))
    both = prior.withColumn("_was", F.lit(True)).alias("p").join(seen.alias("o"), [F.col(f"p.{k}") == F.col(f"o.{k}") for k in keys], "full_outer")
    was, is_seen = F.col("_was").isNotNull(), F.col("_seen").isNotNull()
    moved = is_seen & (~was | changed("p", "o", fields) | F.col("p.deleted_at").isNotNull())
    made = {k: F.coalesce(F.col(f"p.{k}"), F.col(f"o.{k}")) for k in keys}
    made |= {f: F.when(is_seen, F.col(f"o.{f}")).otherwise(F.col(f"p.{f}")) for f in fields}
    for kind, value in (("run_id", run), ("at", now)):
        first, change, recent = (F.col(f"p.{x}_{kind}") for x in ("first_seen", "last_changed", "last_seen"))
        made[f"first_seen_{kind}"] = F.when(is_seen, F.coalesce(first, recent, value)).otherwise(first)
        made[f"last_changed_{kind}"] = F.when(moved, value).when(is_seen, F.coalesce(change, recent, value)).otherwise(change)
        made[f"last_seen_{kind}"] = F.when(is_seen, value).otherwise(recent)
    made["deleted_at"] = F.when(~is_seen, F.col("p.deleted_at"))
    return both.select(*[made.get(c, F.col(f"p.{c}")).alias(c) for c in prior.columns])


def soft_delete(rows: DataFrame, run_id: str, run_at: str, run_succeeded: bool = True) -> DataFrame:
    """Marks live rows that the run didn't see as deleted at its start; a partial run deletes nothing."""
    if not run_succeeded:
        return rows
    gone = F.col("deleted_at").isNull() & ~F.col("last_seen_run_id").eqNullSafe(run_id)
    return rows.withColumn("deleted_at", F.when(gone, F.lit(run_at).cast("timestamp_ntz")).otherwise(F.col("deleted_at")))


def tombstones(prior: DataFrame, observed: DataFrame, coverage: DataFrame, run_at: str) -> DataFrame:
    """prior with rows that weren't observed, though covered, marked as deleted at the run's start."""
    seen = observed.select("rel_key").distinct().withColumn("_seen", F.lit(True))
    marked = covered(prior.join(seen, "rel_key", "left"), coverage)
    gone = F.col("deleted_at").isNull() & F.col("_seen").isNull() & F.col("covered")
    return marked.withColumn("deleted_at", F.when(gone, F.lit(run_at).cast("timestamp_ntz")).otherwise(F.col("deleted_at"))).select(*prior.columns)


def purge(rows: DataFrame, before: str) -> DataFrame:
    """Without tombstones older than `before`."""
    return rows.where(F.coalesce(F.col("deleted_at") >= F.lit(before).cast("timestamp_ntz"), F.lit(True)))


def restore(rows: DataFrame, since: str) -> DataFrame:
    """Tombstones from `since` on live again."""
    back = F.col("deleted_at") >= F.lit(since).cast("timestamp_ntz")
    return rows.withColumn("deleted_at", F.when(back, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("deleted_at")))


def enrich(rows: DataFrame, heads: DataFrame, fields: tuple[str, ...] = ("archive_status", "restore_state", "restore_expiry", "content_type", "head_enriched_at")) -> DataFrame:
    """Replaces the fields by those of heads where a key has one; heads of unknown keys are dropped."""
    h = heads.select("rel_key", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_head"))
    both = rows.join(h, "rel_key", "left")
    return both.select(*[F.when(F.col("_head"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def compact(journal: DataFrame, fields: tuple[str, ...], enriched: tuple[str, ...] = ()) -> DataFrame:
    """Folds a journal (rel_key, op observe or enrich, journal_id, sequence, at, fields) into one row for each key.

    Order is journal, then sequence, never arrival; enrichment counts after all observations and
    is dropped for keys never observed. All but the last change are partial aggregates; the last
    change compares neighbours within a key.
    """
    order = F.struct("journal_id", "sequence")
    observed = journal.where("op = 'observe'")
    last = observed.groupBy("rel_key").agg(
        F.max_by(F.struct(*fields, "at"), order).alias("l"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.count("*").alias("observations")
    )
    w = Window.partitionBy("rel_key").orderBy("journal_id", "sequence")
    state = F.struct(*fields)
    steps = observed.select("rel_key", "at", order.alias("order"), state.alias("state"), F.lag(state).over(w).alias("before"), F.row_number().over(w).alias("n"))
    moved = steps.where((F.col("n") == 1) | ~F.col("state").eqNullSafe(F.col("before"))).groupBy("rel_key").agg(F.max_by("at", "order").alias("last_changed_at"))
    out = last.join(moved, "rel_key").select("rel_key", *[F.col(f"l.{f}").alias(f) for f in fields], "first_seen_at", "last_changed_at", "last_seen_at", "observations")
    if not enriched:
        return out
    heads = journal.where("op = 'enrich'").groupBy("rel_key").agg(F.max_by(F.struct(*enriched), order).alias("e")).select("rel_key", *[F.col(f"e.{c}").alias(f"enriched_{c}") for c in enriched])
    return out.join(heads, "rel_key", "left")


HEAD = ("archive_status", "restore_state", "restore_expiry", "content_type", "head_enriched_at")


def fold(prior: DataFrame, journal: DataFrame, coverage: DataFrame, run_id: str, run_at: str, enrich_only: bool = False, index_set_id: str | None = None, fields: tuple[str, ...] = FIELDS, heads: tuple[str, ...] = HEAD) -> DataFrame:
    """The state after a run's journal: observations in order onto the prior rows, then enrichment, then tombstones.

    journal: rel_key, op (observe or enrich), journal_id, sequence, at, fields and heads. Order is
    journal, then sequence. The first record of a key is judged against its prior row, each other
    one against the record before. Enrichment counts for keys there are, observed or not. Live rows that weren't
    observed, though coverage attests them, are marked as deleted at the run's start. An enrichment alone
    (enrich_only) deletes nothing and takes no observations. Columns are those of prior, in their
    order; new keys get index_set_id.
    """
    if enrich_only and journal.where("op != 'enrich'").limit(1).collect():
        raise ValueError("an enrichment alone takes no observations")
    order, run = F.struct("journal_id", "sequence"), F.lit(run_id)
    w = Window.partitionBy("rel_key").orderBy("journal_id", "sequence")
    state = F.struct(*fields)
    steps = journal.where("op = 'observe'").select("rel_key", "at", order.alias("order"), state.alias("state"), F.lag(state).over(w).alias("before"), F.row_number().over(w).alias("n"))
    step_moved = (F.col("n") > 1) & ~F.col("state").eqNullSafe(F.col("before"))
    seen = steps.groupBy("rel_key").agg(
        F.max_by("state", "order").alias("o"), F.min_by("state", "order").alias("first"), F.min_by("at", "order").alias("first_at"), F.max_by("at", "order").alias("last_at"),
        F.max_by("at", F.when(step_moved, F.col("order"))).alias("moved_at"),
    )
    enriched = journal.where("op = 'enrich'").withColumn("head_enriched_at", F.coalesce("head_enriched_at", "at")).groupBy("rel_key").agg(F.max_by(F.struct(*heads), order).alias("e"))
    both = prior.withColumn("_was", F.lit(True)).alias("p").join(seen.alias("o"), "rel_key", "full_outer").join(enriched, "rel_key", "left")
    both = covered(both, coverage, name="_covered")
    was, is_seen = F.col("_was").isNotNull(), F.col("o.last_at").isNotNull()
    first_moved = ~was | F.col("p.deleted_at").isNotNull() | reduce(or_, [~F.col(f"p.{f}").eqNullSafe(F.col(f"first.{f}")) for f in fields])
    moved_at = F.coalesce("moved_at", F.when(first_moved, F.col("first_at")))
    made = {"rel_key": F.col("rel_key"), "index_set_id": F.coalesce("p.index_set_id", F.lit(index_set_id)) if "index_set_id" in prior.columns else None}
    made |= {f: F.when(is_seen, F.col(f"o.o.{f}")).otherwise(F.col(f"p.{f}")) for f in fields}
    made |= {h: F.when(F.col("e").isNotNull(), F.col(f"e.{h}")).otherwise(F.col(f"p.{h}")) for h in heads}
    for kind, first_value, moved_value, last_value in (("run_id", run, F.when(moved_at.isNotNull(), run), run), ("at", F.col("first_at"), moved_at, F.col("last_at"))):
        first, change, recent = (F.col(f"p.{x}_{kind}") for x in ("first_seen", "last_changed", "last_seen"))
        made[f"first_seen_{kind}"] = F.when(is_seen, F.coalesce(first, recent, first_value)).otherwise(first)
        made[f"last_changed_{kind}"] = F.when(is_seen, F.coalesce(moved_value, change, recent, first_value)).otherwise(change)
        made[f"last_seen_{kind}"] = F.when(is_seen, last_value).otherwise(recent)
    gone = ~is_seen & F.col("p.deleted_at").isNull() & F.col("_covered") & F.lit(not enrich_only)
    made["deleted_at"] = F.when(gone, F.lit(run_at).cast("timestamp_ntz")).when(~is_seen, F.col("p.deleted_at"))
    return both.select(*[made.get(c, F.col(f"p.{c}")).alias(c) for c in prior.columns])


def backfill(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows of a table from before lineage was kept: first seen and last changed when last seen, or at the set's earliest run where even that is missing."""
    least = runs.groupBy("index_set_id").agg(F.min_by(F.struct("run_id", "started_at"), F.struct("started_at", "run_id")).alias("_base"))
    both = rows.join(least, "index_set_id", "left")
    for kind, base in (("run_id", "_base.run_id"), ("at", "_base.started_at")):
        for x in ("first_seen", "last_changed"):
            both = both.withColumn(f"{x}_{kind}", F.coalesce(f"{x}_{kind}", f"last_seen_{kind}", base))
    return both.select(*rows.columns)


def union_journals(*journals: DataFrame) -> DataFrame:
    """All journals as one; raises if two share an id."""
    ids = [j.select("journal_id").distinct() for j in journals]
    twice = reduce(DataFrame.union, ids).groupBy("journal_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"journal {twice[0]['journal_id']} is there twice")
    return reduce(DataFrame.unionByName, journals)


def broken_sequences(journal: DataFrame) -> DataFrame:
    """Journals whose sequence isn't 1, 2, 3 ... without gap or repeat, from counts alone."""
    by = journal.groupBy("journal_id").agg(F.count("*").alias("records"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_distinct("sequence").alias("kinds"))
    return by.where("low != 1 or high != records or kinds != records")
