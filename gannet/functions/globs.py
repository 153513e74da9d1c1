"""Glob patterns, compiled at plan time to a regular expression and a literal prefix.

`*` and `?` stay within a path segment, `**` as a whole segment spans any number of segments
(elsewhere it means `*`), `[...]` is a class (`!` or `^` negates), `{a,b}` alternatives, and a
backslash escapes. Keys are opaque: nothing in them is normalised.
"""

from __future__ import annotations

import re

META = "*?[{"
_SPECIAL = set(r"\.^$|()[]{}*+?")


class GlobError(ValueError):
    pass


def normalise(pattern: str) -> str:
    """Backslashes that don't escape a special character become slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if nxt and nxt in "*?[]{}\\":
                out.append(c + nxt)
                i += 2
                continue
            out.append("/")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def is_glob(pattern: str) -> bool:
    return first_meta(pattern) >= 0


def first_meta(pattern: str) -> int:
    i = 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] in META:
            return i
        i += 1
    return -1


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def literal_prefix(pattern: str) -> str:
    """The longest literal start of all matches; cut behind the last slash if the pattern has wildcards."""
    pattern = normalise(pattern)
    at = first_meta(pattern)
    if at < 0:
        return unescape(pattern)
    head = pattern[:at]
    return unescape(head[: head.rfind("/") + 1])


def subsume(prefixes: list[str]) -> list[str]:
    """Sorted, without those that begin with another."""
    kept: list[str] = []
    for p in sorted(set(prefixes)):
        if not kept or not p.startswith(kept[-1]):
            kept.append(p)
    return kept


def literal_prefixes(patterns: list[str]) -> list[str]:
    return subsume([literal_prefix(p) for p in patterns])


def _quote(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The expression of the class that opens at i, and where it ends."""
    j, negated = i + 1, False
    if pattern[j : j + 1] in ("!", "^"):
        negated, j = True, j + 1
    items, first = [], True
    while True:
        if j >= len(pattern):
            raise GlobError(f"class isn't closed: {pattern!r}")
        c = pattern[j]
        if c == "]" and not first:
            break
        first = False
        if c == "\\":
            j += 1
            if j >= len(pattern):
                raise GlobError(f"pattern ends in a backslash: {pattern!r}")
            c = "\\" + pattern[j] if not pattern[j].isalnum() else pattern[j]
        elif c in "[]^&\\":
            c = "\\" + c
        items.append(c)
        j += 1
    body = "".join(items)
    return (f"[^/{body}]" if negated else f"(?:(?!/)[{body}])" if "/" in body else f"[{body}]"), j + 1


def to_regex(pattern: str) -> str:
    """An anchored expression in the subset that Java, RE2 and Python share."""
    text = normalise(pattern)
    out = _translate(text)
    return f"^(?:{out})$"


def _translate(p: str) -> str:
    out, i, depth = [], 0, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            if i + 1 >= len(p):
                raise GlobError(f"pattern ends in a backslash: {p!r}")
            out.append(_quote(p[i + 1]))
            i += 2
        elif c == "*":
            j = i
            while p[j : j + 1] == "*":
                j += 1
            opens = i == 0 or p[i - 1] in "/{,"
            closes = j == len(p) or p[j] in "/},"
            if j - i == 2 and opens and closes:
                if p[j : j + 1] == "/":
                    out.append("(?:[^/]*/)*")
                    j += 1
                elif i and p[i - 1] == "/" and out and out[-1] == "/":
                    out[-1] = "(?:/(?s:.*))?"
                else:
                    out.append("(?s:.*)")
            else:
                out.append("[^/]*")
            i = j
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            expr, i = _class(p, i)
            out.append(expr)
        elif c == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        else:
            out.append(_quote(c))
            i += 1
    if depth:
        raise GlobError(f"brace isn't closed: {p!r}")
    return "".join(out)
