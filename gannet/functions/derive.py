"""Derived fields: extractors of JSON, XML and text, and transforms of one value.

Each function returns a value, null where it can't be had. `missing` decides what a null means.
"""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PAD = 1024  # fixed value
UNRESOLVED = "_unresolved"  # fixed value


def substring(value: Column, start: int, end: int = -1) -> Column:
    """Characters from start up to end (-1: to the last); null out of bounds, never clamped."""
    size = F.length(value)
    stop = size if end == -1 else F.lit(end)
    return F.when((F.lit(start) <= stop) & (stop <= size) & (F.lit(start) >= 0), F.substring(value, F.lit(start + 1), stop - start))


def check_regex(pattern: str) -> str:
    """Rejects what not every engine has: look-around, back-references, possessive and atomic groups."""
    if re.search(r"\(\?[=!>]|\(\?<[=!]|\\[1-9]|\\k<|[*+?}]\+", pattern):
        raise ValueError(f"unsupported in a pattern: {pattern!r}")
    return pattern


def regex_capture(value: Column, pattern: str, group: int = 1) -> Column:
    check_regex(pattern)
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))


def pad(value: Column, width: int, fill: str = "0", left: bool = True) -> Column:
    """Filled up to width, never cut."""
    if not 0 <= width <= MAX_PAD or len(fill) != 1:
        raise ValueError("pad takes a width up to 1024 and one character")
    return F.when(F.length(value) >= width, value).otherwise((F.lpad if left else F.rpad)(value, width, fill))


def reformat(value: Column, layout_in: str, layout_out: str) -> Column:
    from gannet.functions.values import date_pattern

    return F.date_format(F.try_to_timestamp(value, F.lit(date_pattern(layout_in))), date_pattern(layout_out))


def lookup(value: Column, table: list[tuple[str, str, str]], default: str | None = None) -> Column:
    """The first entry (kind, key, result) that matches: exact, prefix or regex."""
    out = F.lit(default).cast("string")
    for kind, key, result in reversed(table):
        test = value == key if kind == "exact" else value.startswith(key) if kind == "prefix" else value.rlike(check_regex(key))
        out = F.when(test, F.lit(result)).otherwise(out)
    return out


def json_path(document: Column, path: str) -> Column:
    """A scalar as text, an object or array as JSON, by a path like a.b[0].c."""
    if not re.fullmatch(r"[^.\[\]]+(\[\d+\])*(\.[^.\[\]]+(\[\d+\])*)*", path):
        raise ValueError(f"not a path: {path!r}")
    steps = re.findall(r"([^.\[\]]+)((?:\[\d+\])*)", path)
    return F.get_json_object(document, "$" + "".join(f"['{name}']{index}" for name, index in steps))


def _first_text(document: str | None, path: str) -> str | None:
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(document or "")
    except (ElementTree.ParseError, ValueError):
        return None
    named = lambda e, name: isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name.rpartition(":")[2]
    if path.startswith("//"):
        found = (e for e in root.iter() if named(e, path[2:]))
    else:
        first, *steps = path[1:].split("/")
        at = [root] if named(root, first) else []
        for step in steps:
            at = [e for parent in at for e in parent if named(e, step)]
        found = iter(at)
    element = next(found, None)
    return None if element is None else "".join(element.itertext()).strip() or None


def xml_path(document: Column, path: str) -> Column:
    """Text of the first element at //Tag or /a/b; null if that is empty, or the document isn't well-formed.

    Spark's own XPath functions fail the whole job at one malformed document, so each is parsed
    in batches by Python.
    """
    if not re.fullmatch(r"//[\w:-]+|(/[\w:-]+)+", path):
        raise ValueError(f"not a path: {path!r}")

    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda x: _first_text(x, path)).astype(object)

    return F.pandas_udf(run, "string")(document)


def tag_text(document: Column, tag: str) -> Column:
    """Text between a tag's first start and its end, for markup that isn't well-formed."""
    return F.nullif(F.trim(regex_capture(document, rf"<{re.escape(tag)}(?: [^>]*)?>([^<]*)</{re.escape(tag)}>", 1)), F.lit(""))


def first_of(*values: Column) -> tuple[Column, Column]:
    """The first that isn't null, and its place in the list from 1."""
    place = F.lit(None).cast("int")
    for k, v in reversed(list(enumerate(values, 1))):
        place = F.when(v.isNotNull(), F.lit(k)).otherwise(place)
    return F.coalesce(*values), place


def route(values: dict[str, Column], required: dict[str, str]) -> tuple[dict[str, Column], Column, Column]:
    """Values by name, whether the row fails, and its routing class, given what a missing value does: fail or quarantine."""
    out, fails, waits = {}, F.lit(False), F.lit(False)
    for name, value in values.items():
        on_missing = required.get(name, "fail")
        if on_missing not in ("fail", "quarantine"):
            raise ValueError(f"unknown policy: {on_missing!r}")
        if on_missing == "fail":
            fails = fails | value.isNull()
            out[name] = value
        else:
            waits = waits | value.isNull()
            out[name] = F.coalesce(value, F.lit(UNRESOLVED))
    return out, fails, F.when(waits, F.lit("quarantine")).otherwise("normal")
