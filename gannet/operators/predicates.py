"""Predicates over inventory rows, as columns that Catalyst can push to a scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gannet.functions import globs
from gannet.functions.derive import check_regex


def every(*tests: Column | None) -> Column:
    return reduce(and_, [t for t in tests if t is not None], F.lit(True))


def glob(key: Column, pattern: str) -> Column:
    """The literal prefix goes beside the expression, since a scan can skip by it."""
    prefix = globs.literal_prefix(pattern)
    if not globs.is_glob(globs.normalise(pattern)):
        return key == prefix
    test = key.rlike(globs.to_regex(pattern))
    # "a/**" also matches "a", which "a/" doesn't begin
    whole = globs.normalise(pattern).endswith("/**")
    return key.startswith(prefix.rstrip("/") if whole else prefix) & test if prefix else test


def hidden(key: Column) -> Column:
    return key.rlike(r"(^|/)\.")


def match(key: Column, includes: Iterable[str], excludes: Iterable[str] = (), include_hidden: bool = False) -> Column:
    """Some include matches, no exclude does, and no segment is hidden."""
    some = reduce(or_, [glob(key, p) for p in includes], F.lit(False))
    none = reduce(and_, [~glob(key, p) for p in excludes], F.lit(True))
    return some & none if include_hidden else some & none & ~hidden(key)


def regex(key: Column, pattern: str) -> Column:
    return key.rlike(check_regex(pattern))


def size_between(size: Column, low: int | None = None, high: int | None = None) -> Column:
    return every(None if low is None else size >= low, None if high is None else size <= high)


def modified_listing(at: Column, after: str | None = None, before: str | None = None) -> Column:
    """While listing: from `after` on, up to `before` without it."""
    return every(None if after is None else at >= F.lit(after).cast("timestamp_ntz"), None if before is None else at < F.lit(before).cast("timestamp_ntz"))


def modified_query(at: Column, after: str | None = None, before: str | None = None) -> Column:
    """In an index query: both ends belong to the range."""
    return every(None if after is None else at >= F.lit(after).cast("timestamp_ntz"), None if before is None else at <= F.lit(before).cast("timestamp_ntz"))


def storage_class(value: Column, allowed: Iterable[str]) -> Column:
    """Exactly one of those given, the empty ones among them ignored; nothing given means no test."""
    given = [x for x in allowed if x]
    return F.coalesce(value.isin(given), F.lit(False)) if given else F.lit(True)


def not_deleted(deleted_at: Column, include_deleted: bool = False) -> Column:
    return F.lit(True) if include_deleted else deleted_at.isNull()


def prefix(key: Column, start: str) -> Column:
    return key.startswith(start) if start else F.lit(True)


def content_type(*_: str) -> Column:
    raise ValueError("content types are known only after enrichment; filter an enriched table by its column")


def segments(value: Column, allow: Iterable[str] = (), deny: Iterable[str] = (), glob_allow: Iterable[str] = (), glob_deny: Iterable[str] = ()) -> Column:
    allow, glob_allow = list(allow), list(glob_allow)
    yes = reduce(or_, [value.isin(allow)] * bool(allow) + [glob(value, p) for p in glob_allow]) if allow or glob_allow else F.lit(True)
    return yes & ~value.isin(list(deny)) & reduce(and_, [~glob(value, p) for p in glob_deny], F.lit(True))


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), "^/", "")


def attested(coverage: DataFrame) -> DataFrame:
    """What coverage says, as paths of two kinds: scopes that attest absence, and gaps.

    coverage: scope, basis, complete, windowed, gaps (array). An entry attests only if it is
    confirmed, complete, unwindowed, has a path, and has no gap at all. Gaps count whichever entry names
    them; one without a path is a gap everywhere, "." stands for everything.
    """
    whole = (F.col("basis") == "confirmed") & F.col("complete") & ~F.coalesce("windowed", F.lit(False)) & (F.coalesce(F.size("gaps"), F.lit(0)) <= 0)
    scopes = coverage.where(whole).select(F.lit("scope").alias("kind"), _clean(F.col("scope")).alias("path")).where("path != ''")
    gaps = coverage.select(F.explode("gaps").alias("gap")).select(F.lit("gap").alias("kind"), F.coalesce(F.nullif(_clean(F.col("gap")), F.lit("")), F.lit(".")).alias("path"))
    return scopes.union(gaps).distinct()


def places(key: Column) -> Column:
    """All paths that hold a key: itself and what stands before each slash, without and with that slash."""
    parts = F.split(key, "/")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.concat(whole, F.transform(F.slice(whole, F.lit(1), F.size(parts) - 1), lambda p: F.concat(p, F.lit("/"))))


#: Paths of coverage that are compiled into an expression at most; more are joined.
COMPILED = 1000


def covered(rows: DataFrame, coverage: DataFrame, key: str = "rel_key", name: str = "covered") -> DataFrame:
    """rows with a column that says whether coverage attests a key's absence: some scope holds it and no gap does.

    A path that ends with a slash holds all keys that begin with it, another one itself and what lies
    under it. Few paths are tested row by row, with no shuffle; more by an equi-join with each of a
    key's places.
    """
    found = attested(coverage).limit(COMPILED + 1).collect()
    above = places(F.col(key))
    if len(found) <= COMPILED:

        def held(kind: str) -> Column:
            paths = [r["path"] for r in found if r["kind"] == kind]
            return F.lit("." in paths) if "." in paths or not paths else F.exists(above, lambda p: p.isin(paths))

        return rows.withColumn(name, F.coalesce(held("scope") & ~held("gap"), F.lit(False)))
    up = rows.select(key).distinct().select(key, F.explode(F.array_append(above, F.lit("."))).alias("path")).join(attested(coverage), "path")
    good = up.groupBy(F.col(key).alias("_key")).agg((F.count_if(F.col("kind") == "gap") == 0).alias("_good"))
    both = rows.join(good, rows[key] == good["_key"], "left")
    return both.select(*[rows[c] for c in rows.columns if c != name], F.coalesce("_good", F.lit(False)).alias(name))


def attribution(key: Column, coverage: list[dict]) -> Column:
    """The path of the first entry of a manifest's coverage that attests a key; null where none does, or a gap holds it."""
    within = lambda path: F.lit(True) if path == "." else key.startswith(path) if path.endswith("/") else (key == path) | key.startswith(path + "/")
    clean = lambda path: re.sub("^/", "", (path or "").strip())
    gap = reduce(or_, [within(clean(g) or ".") for e in coverage for g in e.get("gaps") or ()], F.lit(False))
    out = F.lit(None).cast("string")
    for e in reversed(coverage):
        path = clean(e.get("scope"))
        if path and e.get("basis") == "confirmed" and e.get("complete") and not e.get("windowed") and not e.get("gaps"):
            out = F.when(within(path), F.lit(path)).otherwise(out)
    return F.when(~gap, out)


def in_scope(key: Column, scopes: Iterable[str]) -> Column:
    return reduce(or_, [prefix(key, s) for s in scopes], F.lit(False))


def enrichment_candidates(rows: DataFrame, *tests: Column) -> DataFrame:
    return rows.where(every(*tests)).select("rel_key", "size_bytes", "storage_class", "etag")


def split_by_base(rows: DataFrame, base: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows under the base prefix, and those outside, which are violations."""
    test = F.coalesce(prefix(F.col(key), base), F.lit(False))
    return rows.where(test), rows.where(~test)
