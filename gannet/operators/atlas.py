"""Atlases: content-addressed rows with named dimensions, dealt to shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gannet.functions.templates import shard_value
from gannet.functions.values import timestamp


def atlas_id(set_id: Column, run_id: Column, recipe_digest: Column) -> Column:
    return F.concat(F.lit("atlas_"), F.sha2(F.concat_ws("\n", set_id, run_id, recipe_digest), 256))


def build(rows: DataFrame, content: str, dimensions: dict[str, Column], shard: list[str], temporal: dict[str, str] | None = None) -> DataFrame:
    """rel_key, content_sha256, dimensions, shard and outcome (indexed, unresolved or invalid_temporal).

    temporal names dimensions that must be a day (2024-05-01) or an instant with its zone
    (2024-05-01T10:00:00Z). A dimension that is null or blank is unresolved.
    """
    bad = F.lit(False)
    for name, kind in (temporal or {}).items():
        if kind not in ("day", "instant"):
            raise ValueError(f"unknown kind of time: {kind!r}")
        value = F.trim(dimensions[name])
        fits = timestamp(value).isNotNull() & value.rlike(r"^\d{4}-\d{2}-\d{2}$" if kind == "day" else r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
        bad = bad | ~F.coalesce(fits, F.lit(False))
    missing = F.lit(False)
    for value in dimensions.values():
        missing = missing | (F.coalesce(F.trim(value), F.lit("")) == "")
    named = F.create_map(*[x for k, v in dimensions.items() for x in (F.lit(k), v)])
    path = F.concat_ws("/", *[F.concat(F.lit(k + "="), shard_value(dimensions[k])) for k in shard])
    outcome = F.when(missing, "unresolved").when(bad, "invalid_temporal").otherwise("indexed")
    return rows.select("rel_key", F.sha2(F.col(content).cast("binary"), 256).alias("content_sha256"), named.alias("dimensions"), path.alias("shard"), outcome.alias("outcome"))


def stats(atlas: DataFrame) -> DataFrame:
    """Keys, distinct contents, and distinct pairs of shard and content."""
    good = atlas.where("outcome = 'indexed'")
    return good.agg(F.count("*").alias("tier1_keys"), F.count_distinct("content_sha256").alias("tier2_contents"), F.count_distinct("shard", "content_sha256").alias("tier3_shard_contents"))


def outcomes(atlas: DataFrame) -> DataFrame:
    return atlas.groupBy("outcome").agg(F.count("*").alias("rows"))
