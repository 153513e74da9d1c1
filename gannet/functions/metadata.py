"""Metadata expressions and policies for moved objects.

An expression is a literal in single quotes, meta.name, meta.name.key.in.json,
urldecode(meta.name) with an optional path, or sys.name; two may be joined by one +.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERM = re.compile(r"'(?P<lit>[^']*)'|(?P<dec>urldecode\()?meta\.(?P<name>[\w-]+)(?(dec)\))(?P<path>(?:\.[\w-]+)*)|sys\.(?P<sys>\w+)")


def expression(text: str, meta: Column, system: dict[str, Column]) -> Column:
    terms = [t.strip() for t in re.split(r"\+(?=(?:[^']*'[^']*')*[^']*$)", text)]
    if len(terms) > 2:
        raise ValueError(f"only one + is allowed: {text!r}")
    out = []
    for term in terms:
        m = _TERM.fullmatch(term)
        if not m:
            raise ValueError(f"not an expression: {term!r}")
        if m["lit"] is not None:
            out.append(F.lit(m["lit"]))
        elif m["sys"]:
            if m["sys"] not in system:
                raise ValueError(f"unknown: sys.{m['sys']}")
            out.append(system[m["sys"]])
        else:
            value = F.try_element_at(meta, F.lit(m["name"]))
            value = F.try_url_decode(value) if m["dec"] else value
            out.append(F.get_json_object(value, "$" + m["path"]) if m["path"] else value)
    return out[0] if len(out) == 1 else F.concat(*out)


def apply_policy(meta: Column, policy: str, given: dict[str, Column]) -> Column:
    """clear keeps only what is given, preserve only what was there unless given is empty, merge lets given win."""
    own = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v)]) if given else F.create_map().cast("map<string,string>")
    own = F.map_filter(own, lambda k, v: v.isNotNull())
    old = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    if policy == "clear":
        return own
    if policy == "preserve" and not given:
        return old
    if policy in ("preserve", "merge"):
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
    raise ValueError(f"unknown policy: {policy!r}")
