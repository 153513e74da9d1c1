"""Sizes, dates and entity tags: parsing at plan time, and as column expressions."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1
# Unit names and what they multiply by.
UNITS = {"": 1, "B": 1} | {f"{u}{s}": base ** (k + 1) for k, u in enumerate("KMGT") for base, ss in ((1000, ("", "B")), (1024, ("I", "IB"))) for s in ss}


def parse_size(text: str) -> int:
    """Bytes of "10", "1.5GiB", "3 kb"; ValueError for anything else, negative sizes and overflow."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    unit = UNITS[m[2].upper()]
    size = int(float(m[1]) * unit) if "." in m[1] else int(m[1]) * unit
    if size > MAX_LONG:
        raise ValueError(f"size overflows: {text!r}")
    return size


def size_of(text: Column) -> Column:
    """parse_size as a column; null where the text isn't a size."""
    number = F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+|[0-9]+\.)\s*([A-Za-z]*)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+|[0-9]+\.)\s*([A-Za-z]*)\s*$", 2))
    by = F.lit(None).cast("decimal(20,0)")
    for name, n in UNITS.items():
        by = F.when(unit == name, F.lit(n).cast("decimal(20,0)")).otherwise(by)
    whole = F.when(~number.contains("."), (number.try_cast("decimal(18,0)") * by).try_cast("bigint"))
    part = F.floor(number.try_cast("double") * by.cast("double"))
    return F.when(number != "", F.coalesce(whole, F.when(number.contains(".") & (part.cast("double") < float(MAX_LONG)), part.try_cast("bigint"))))


def format_size(size: Column) -> Column:
    """IEC units with one decimal, from the exact value."""
    out = F.concat(size.cast("string"), F.lit("B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        scaled = F.call_function("format_number", size / float(1024**k), F.lit("0.0"))
        out = F.when(size >= 1024**k, F.concat(scaled, F.lit(unit))).otherwise(out)
    return out


def parse_date(text: str) -> datetime:
    """RFC 3339 (with fractions) or a plain date, in UTC."""
    try:
        t = datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise ValueError(f"not a date: {text!r}") from e
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


_STAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?)?$"


def timestamp(text: Column) -> Column:
    """A stored timestamp; null where it can't be read."""
    return F.when(text.rlike(_STAMP), F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))


def bad_timestamps(text: Column) -> Column:
    """How many values are there but can't be read (an aggregate)."""
    return F.count_if(text.isNotNull() & timestamp(text).isNull())


def etag(text: Column) -> Column:
    """An entity tag without weakness mark and quotes."""
    return F.regexp_replace(F.trim(text), r'^(W/)?"?|"$', "")


def is_multipart(tag: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(tag), r'^"+|"+$', "").rlike("^.+-[0-9]+$"), F.lit(False))


def same_strong_etag(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (a == b), F.lit(False))


# Layout elements by example, and Spark's patterns for them.
_LAYOUT = (("2006", "yyyy"), ("January", "MMMM"), ("Jan", "MMM"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("PM", "a"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("Z07:00", "XXX"), ("-0700", "xx"), ("MST", "zzz"), ("06", "yy"))


def date_pattern(layout: str) -> str:
    """Spark's pattern for a layout written as an example of one moment (2006-01-02 15:04:05)."""
    out, i, text = "", 0, ""

    def flush() -> None:
        nonlocal out, text
        if text:
            out += "'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text
        text = ""

    while i < len(layout):
        for example, pattern in _LAYOUT:
            if layout.startswith(example, i):
                flush()
                out += pattern
                i += len(example)
                break
        else:
            text += layout[i]
            i += 1
    flush()
    return out


def restore_state(header: Column, now: Column) -> Column:
    """What a restore header says: ongoing, completed, expired or unknown; null without one."""
    expiry = restore_expiry(header)
    done = F.when(expiry.isNotNull() & (expiry < now), F.lit("expired")).otherwise("completed")
    return F.when(header.isNull() | (F.trim(header) == ""), F.lit(None).cast("string")).when(header.contains('ongoing-request="true"'), F.lit("ongoing")).when(header.contains('ongoing-request="false"'), done).otherwise("unknown")


def restore_expiry(header: Column) -> Column:
    date = F.regexp_extract(header, 'expiry-date="[A-Za-z]+, ([^"]+)"', 1)
    return F.when(date != "", F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss z")))
