"""Retention: which runs and index sets to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collectable(sets: DataFrame, keep_last: int = 0, older_than: str | None = None, by: str = "base_uri", id_col: str = "index_set_id") -> DataFrame:
    """Sets beyond the newest keep_last of their base, and older than the cutoff if one is given.

    With keep_last 0 no ranking is needed. The window holds one base's sets, not objects.
    """
    out = sets
    if keep_last:
        w = Window.partitionBy(by).orderBy(F.desc("created_at"), id_col)
        out = out.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") > keep_last).drop("_rank")
    return out if older_than is None else out.where(F.col("created_at") <= F.lit(older_than).cast("timestamp_ntz"))


def totals(dropped: DataFrame, rows: DataFrame, id_col: str = "index_set_id") -> DataFrame:
    hit = rows.join(dropped.select(id_col), id_col, "left_semi").agg(F.count("*").alias("objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return dropped.agg(F.count("*").alias("sets")).crossJoin(hit)  # one row each


def cascade(rows: DataFrame, dropped: DataFrame, id_col: str = "index_set_id") -> DataFrame:
    return rows.join(dropped.select(id_col).distinct(), id_col, "left_anti")


def retained(candidates: DataFrame, kept: DataFrame, on: str) -> DataFrame:
    """Candidates for removal that nothing kept refers to."""
    return candidates.join(kept.select(on).distinct(), on, "left_anti")


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("kind").agg(F.count("*").alias("artifacts"), F.sum("size_bytes").alias("bytes"))
