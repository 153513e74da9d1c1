"""Key templates: capture variables from a key and render new keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_VAR = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def segments(key: Column) -> Column:
    return F.split(key, "/")


def path(template: str, key: Column) -> Column:
    """Renders {filename}, {dir[n]} and {key}; null where the key has no such directory."""
    parts = segments(key)
    out = []
    for text, name, index in re.findall(r"([^{]+)|\{(filename|key|dir)(?:\[(\d+)\])?\}", template):
        if text:
            out.append(F.lit(text))
        elif name == "key":
            out.append(key)
        elif name == "filename":
            out.append(F.element_at(parts, -1))
        else:
            n = int(index)
            out.append(F.when(F.lit(n) < F.size(parts) - 1, F.get(parts, n)))
    return F.concat(*out)


class Rewrite:
    """From a template of segments like {site}/x-{date}/{_} to one built of the captured variables."""

    def __init__(self, source: str, target: str):
        self.groups: list[str] = []
        pattern = []
        for segment in source.split("/"):
            at, expr = 0, ""
            for m in _VAR.finditer(segment):
                expr += re.escape(segment[at : m.start()]) + "([^/]+)"
                self.groups.append(m[1])
                at = m.end()
            pattern.append(expr + re.escape(segment[at:]))
        self.pattern = "^" + "/".join(pattern) + "$"
        names = [g for g in self.groups if g != "_"]
        if len(names) != len(set(names)):
            raise ValueError(f"a variable stands twice: {source!r}")
        self.target = target
        if lost := {m[1] for m in _VAR.finditer(target)} - set(names):
            self.outside = lost
        else:
            self.outside = set()

    def matches(self, key: Column) -> Column:
        return key.rlike(self.pattern)

    def capture(self, key: Column) -> dict[str, Column]:
        return {g: F.when(self.matches(key), F.regexp_extract(key, self.pattern, k)) for k, g in enumerate(self.groups, 1) if g != "_"}

    def render(self, key: Column, given: dict[str, Column] | None = None) -> Column:
        """The new key; null where the source, without slashes at its ends, doesn't match, a variable has no value, or nothing is left."""
        key = F.trim(key, F.lit("/"))
        values = self.capture(key) | (given or {})
        if missing := self.outside - set(values):
            raise ValueError(f"no value for {sorted(missing)}")
        out, at = [], 0
        for m in _VAR.finditer(self.target):
            out += [F.lit(self.target[at : m.start()]), values[m[1]]]
            at = m.end()
        whole = F.concat(*out, F.lit(self.target[at:]))
        return F.when(self.matches(key), F.nullif(F.trim(F.replace(whole, F.lit("//"), F.lit("/")), F.lit("/")), F.lit("")))


def quarantine_key(prefix: str, reason: Column, key: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix.strip("/")), reason, F.ltrim(key, F.lit("/")))


def destination(routing: Column, quarantined: Column, explicit: Column, rewritten: Column) -> Column:
    """Quarantine goes first, then a key that the record names, then the rewritten one; null is an error."""
    return F.when(routing == "quarantine", quarantined).otherwise(F.coalesce(F.nullif(explicit, F.lit("")), rewritten))


def shard_value(value: Column) -> Column:
    """A value fit for a path segment."""
    clean = F.trim(F.regexp_replace(F.trim(value), "[^A-Za-z0-9._=-]+", "_"), F.lit("._-"))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("_empty")).otherwise(clean)
