"""Partition plans: prefixes dealt to lanes, and identities hashed from canonical JSON."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gannet.functions.globs import normalise, subsume

MAX_LANES = 64  # fixed value


def canonical_json(value) -> str:
    """Compact JSON in given key order; <, > and & escaped as web-safe encoders do."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _patterns(given: list[str]) -> list[str]:
    return sorted({x for x in (normalise(p.strip()).removeprefix("/") for p in given if p.strip()) if x})


def index_set_id(base_uri: str, provider: str, build: dict, place: dict | None = None, path_date: dict | None = None, version_key: str = "tool_version") -> str:
    """The identity of an index set, hashed from what it was built from.

    place: storage_provider, cloud_provider, region_kind, region, endpoint_host. build: source_type,
    schema_version, version, includes, excludes, include_hidden, filters_hash, scope_hash; version
    is hashed under version_key. path_date: method, regex, segment_index. Empty values that aren't always there are left out.
    """
    text = lambda d, k: str(d.get(k) or "").strip()
    some = lambda pairs: {k: v for k, v in pairs if v}
    place = place or {}
    uri = base_uri.strip()
    where = some((k, text(place, k)) for k in ("storage_provider", "cloud_provider", "region_kind", "region")) | some([("endpoint_host", text(place, "endpoint_host").lower())])
    made = {"source_type": text(build, "source_type"), "schema_version": int(build.get("schema_version") or 0)} | some([(version_key, text(build, "version"))])
    made |= {"includes": _patterns(build.get("includes") or [])} | some([("excludes", _patterns(build.get("excludes") or []))])
    made |= {"include_hidden": bool(build.get("include_hidden"))} | some((k, text(build, k)) for k in ("filters_hash", "scope_hash"))
    payload = {"base_uri": uri if not uri or uri.endswith("/") else uri + "/", "provider": provider.strip(), **where, "build": made}
    if path_date:
        payload["path_date"] = {"method": text(path_date, "method")} | some([("regex", text(path_date, "regex")), ("segment_index", int(path_date.get("segment_index") or 0))])
    return "idx_" + digest(payload)


@dataclass(frozen=True)
class Plan:
    lanes: tuple[tuple[str, ...], ...]

    @property
    def hash(self) -> str:
        return digest({"version": 1, "lanes": [{"ordinal": k, "prefixes": list(p)} for k, p in enumerate(self.lanes, 1)]})


def compile_plan(prefixes: list[str], lanes: int) -> Plan:
    """Distinct prefixes none of which begins with another, dealt in order to the lanes in turn."""
    if not 1 <= lanes <= MAX_LANES:
        raise ValueError(f"lanes must be 1 to {MAX_LANES}")
    kept = subsume(prefixes)
    n = min(lanes, len(kept)) or 1
    return Plan(tuple(tuple(kept[k::n]) for k in range(n)))


def assign_lanes(prefixes: DataFrame, lanes: int) -> DataFrame:
    """The same deal for a table: each prefix's place in order, from per-partition counts, so no task sorts all.

    Prefixes are ranged over partitions; a partition's offset is the number of prefixes before
    it, one row for each partition.
    """
    held = prefixes.select("prefix").distinct().repartitionByRange("prefix").sortWithinPartitions("prefix")
    numbered = held.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    return numbered.join(before, "_p").select("prefix", (F.pmod(F.col("_before") + F.col("_n"), F.lit(lanes)) + 1).cast("int").alias("lane"))


def subsume_table(prefixes: DataFrame, delimiter: str = "/") -> DataFrame:
    """Prefixes (ending in the delimiter) without those under another: an anti-join by ancestors."""
    p = prefixes.select("prefix").distinct()
    parts = F.split("prefix", delimiter)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), delimiter), F.lit(delimiter)))
    up = p.where(F.size(parts) > 2).select("prefix", F.explode(above).alias("above"))
    covered = up.join(p.select(F.col("prefix").alias("above")), "above", "left_semi").select("prefix").distinct()
    return p.join(covered, "prefix", "left_anti")
