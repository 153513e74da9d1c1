"""Scopes: which prefixes to list, planned on the driver or found in a table."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gannet.functions import globs
from gannet.operators import predicates as P


def prefix_list(base: str, prefixes: list[str]) -> list[str]:
    return sorted({base + p.lstrip("/") if not p.startswith(base) else p for p in prefixes})


def union(*scopes: list[str]) -> list[str]:
    return sorted({p for s in scopes for p in s})


def days(after: date, before: date) -> list[date]:
    """Each day from `after` up to `before`, without it."""
    return [after + timedelta(days=k) for k in range((before - after).days)]


def date_partitions(rows: DataFrame, depth: int, after: str, before: str, pattern: str = "yyyy-MM-dd", **segment_tests) -> DataFrame:
    """Every discovered prefix of so many segments with every day, as prefixes to list.

    Days are a literal array that each prefix explodes: no join.
    """
    parts = F.split("rel_key", "/")
    found = rows.where(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("found")).distinct()
    if segment_tests:
        found = found.where(P.segments(F.substring_index("found", "/", -1), **segment_tests))
    last = F.date_sub(F.lit(before).cast("date"), 1)
    each = found.withColumn("day", F.explode(F.sequence(F.lit(after).cast("date"), last)))
    return each.select(F.concat("found", F.lit("/"), F.date_format("day", pattern), F.lit("/")).alias("prefix")).orderBy("prefix")


def narrow(after: date, before: date, since: datetime) -> tuple[date, date]:
    """A date scope from a watermark on, by whole days; never wider than it was."""
    return max(after, since.date()), before


def since_auto(runs: DataFrame, now: datetime) -> datetime:
    """The start of the latest run; raises unless it succeeded and lies in the past."""
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1).collect()
    if not last:
        raise ValueError("there is no earlier run")
    if last[0]["status"] != "success":
        raise ValueError("the latest run didn't succeed")
    if last[0]["started_at"] > now:
        raise ValueError("the latest run lies in the future")
    return last[0]["started_at"]


def migrate(includes: list[str], excludes: list[str] = ()) -> list[str]:
    """The prefix list that equals literal includes of the form prefix/**; raises for any other."""
    if excludes:
        raise ValueError("excludes can't become a prefix list")
    out = []
    for p in includes:
        prefix = globs.literal_prefix(p)
        if globs.normalise(p) not in (prefix + "**", prefix + "**/*") or not prefix:
            raise ValueError(f"not a literal prefix: {p!r}")
        out.append(prefix)
    return sorted(set(out))


def same(a: list[str], b: list[str]) -> bool:
    return set(a) == set(b)
