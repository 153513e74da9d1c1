"""Text of web pages by layout-aware rendering.

A tree builder reads tags with the usual implied ones (a new paragraph or list item ends the
one before, a table part ends its like, a cell opens its row, a void tag holds nothing); then a renderer writes all
visible text: blocks on lines of their own, paragraphs and headings set off by blank lines,
list items marked and indented, table cells aligned in columns, preformatted text as it stands.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gannet.llm.common import with_row

# How HTML's tags behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("script style head title template noscript noembed noframes iframe object audio video canvas datalist desc defs symbol metadata annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option section summary caption tbody thead tfoot tr td th".split())
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt option optgroup legend summary figcaption".split()) | frozenset(["li", "dd", "dt"])
#: A tag's start closes these open tags, looking no further up than the tags behind them.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
IMPLIED_END["thead"] = IMPLIED_END["tfoot"] = IMPLIED_END["caption"] = IMPLIED_END["colgroup"] = IMPLIED_END["tbody"]
SECTIONS = frozenset(["tbody", "thead", "tfoot"])
#: A start of these closes what isn't a table's part up to the next of the tags behind them.
TABLE_PART = {"tr": {"table", *SECTIONS}, "td": {"table", "tr", *SECTIONS}} | dict.fromkeys([*SECTIONS, "caption", "colgroup"], {"table"})
TABLE_PART["th"] = TABLE_PART["td"]
#: An end tag doesn't reach out of these.
WALL = {"td": {"table"}, "th": {"table"}, "tr": {"table"}, "form": {"table"}, "li": {"ul", "ol", "menu"}}
IN_HEAD = frozenset("base link meta title style script noscript template".split())

#: Input elements that show their value.
SHOWN_INPUT = frozenset(["", *"text search url email tel number submit reset button".split()])
#: What HTML clamps spans to.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

# No two parts of these can take the same characters, so a match never goes back over a text.
_NAME = re.compile(r"[^\s/>]*+")
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)?))?+")
_REST = re.compile(r"[\s/]*+")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  #: nodes and strings


#: What a new tag asks of those open: the nearest or the outermost of some tags that no other of some tags hides.
_ASKED: dict[str, tuple[set | frozenset, set | frozenset, bool]] = {"p": ({"p"}, {"td", "th", "button", "caption", "object"}, True)}
_ASKED |= {f"end {t}": ({t}, WALL[t], True) for t in WALL}
_ASKED |= {f"implied {t}": (*IMPLIED_END[t], False) for t in ("li", "dt", "option", "optgroup", "td", "tr", "tbody", "body")}
_ASKED |= {f"part {t}": (TABLE_PART[t], HIDDEN - TABLE_PART[t], True) for t in ("tr", "td", "tbody")}
_NUMBER = {name: k for k, name in enumerate(_ASKED)}
_SPECIAL = frozenset().union(*[hit | hidden for hit, hidden, _ in _ASKED.values()])
_IMPLIED_AS = {t: _NUMBER["implied " + ({"dd": "dt", "th": "td"}.get(t) or (t if "implied " + t in _NUMBER else "tbody"))] for t in IMPLIED_END}
_PART_AS = {t: _NUMBER["part " + ({"th": "td"}.get(t) or (t if "part " + t in _NUMBER else "tbody"))] for t in TABLE_PART}


class _Open:
    """The open tags. Each knows the answers to _ASKED as seen from it, so that none is searched for, however deep a page nests."""

    def __init__(self, root: Node):
        self.nodes, self.answers, self.count = [root], [(0,) * len(_ASKED)], {}

    def push(self, node: Node) -> None:
        answers = self.answers[-1]
        if node.tag in _SPECIAL:
            at = len(self.nodes)
            answers = tuple((at if nearest or not old else old) if node.tag in hit else 0 if node.tag in hidden else old for (hit, hidden, nearest), old in zip(_ASKED.values(), answers, strict=True))
        self.nodes.append(node)
        self.answers.append(answers)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def close(self, upto: int) -> None:
        for node in self.nodes[upto:]:
            self.count[node.tag] -= 1
        del self.nodes[upto:], self.answers[upto:]

    def ask(self, number: int) -> int:
        return self.answers[-1][number]

    def end(self, tag: str) -> bool:
        """Closes the nearest of these tags; false if there is none to close."""
        if tag in WALL:
            k = self.ask(_NUMBER[f"end {tag}"])
        elif not self.count.get(tag):
            return False
        else:
            k = len(self.nodes) - 1
            while self.nodes[k].tag != tag:  # all these are closed at once
                k -= 1
        if k:
            self.close(k)
        return bool(k) or tag in WALL


def _attributes(source: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from a place behind a tag's name; whether the tag closes itself; where it ends. The first of equal names counts."""
    found: dict[str, str] = {}
    while m := _ATTR.match(source, at):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()
    end = _REST.match(source, at).end()
    return found, source[at:end].endswith("/"), end + 1


def parse(source: str) -> Node:
    """The tree of a page; what isn't a tag is text, open tags end with the page, and a tag that the page's end breaks off is none.

    Takes time in proportion to the page, whatever it holds.
    """
    root = Node("#root")
    stack, at, size = _Open(root), 0, len(source)
    nodes = stack.nodes

    def text(upto: int) -> None:
        if upto > at:
            nodes[-1].children.append(html.unescape(source[at:upto]))

    while at < size:
        open_at = source.find("<", at)
        while open_at >= 0 and not (source[open_at + 1 : open_at + 2].isalpha() and source[open_at + 1].isascii() or source[open_at + 1 : open_at + 2] in ("/", "!", "?")):
            open_at = source.find("<", open_at + 1)
        if open_at < 0:
            text(size)
            break
        text(open_at)
        second = source[open_at + 1 : open_at + 2]
        ending = second == "/"
        if second in "!?" or (ending and not re.match("[a-zA-Z]", source[open_at + 2 : open_at + 3])):
            mark = "-->" if source.startswith("<!--", open_at) else ">"
            found = source.find(mark, open_at + (2 if mark == "-->" else 1))  # <!--> is a whole comment
            at = size if found < 0 else found + len(mark)
            continue
        name = _NAME.match(source, open_at + 1 + ending)
        tag = name[0].lower()
        attrs, itself, at = _attributes(source, name.end())
        if at > size:
            break
        if ending:
            if not stack.end(tag) and tag in ("p", "br"):
                nodes[-1].children.append(Node(tag))
            continue
        if tag in ENDS_P and (k := stack.ask(_NUMBER["p"])):
            stack.close(k)
        if tag in IMPLIED_END:
            if k := stack.ask(_IMPLIED_AS[tag]):
                stack.close(k)
        elif nodes[-1].tag == "head" and tag not in IN_HEAD:
            stack.close(len(nodes) - 1)
        if tag in TABLE_PART and (k := stack.ask(_PART_AS[tag])):
            stack.close(k + 1)
            if tag in ("td", "th") and nodes[-1].tag != "tr":
                nodes[-1].children.append(Node("tr"))
                stack.push(nodes[-1].children[-1])
        node = Node(tag, attrs)
        nodes[-1].children.append(node)
        if tag == "form" and (nodes[-1].tag in ("table", "tr") or nodes[-1].tag in SECTIONS):
            continue  # it holds nothing there: rows and cells stay the table's
        if tag in VOID or (itself and tag not in RAW and tag not in BLOCK):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(source, at)
            node.children.append(html.unescape(source[at : end.start()]) if end and tag in ("textarea", "title") else source[at : end.start() if end else size])
            if not end:
                break
            stop = source.find(">", end.start())
            at = size if stop < 0 else stop + 1
            continue
        stack.push(node)
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return not (a.get("style") and _UNSEEN.search(a["style"]))


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Lines of a block, white space collapsed."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.gap, self.blank = [], False, False

    def text(self, s: str) -> None:
        parts = _SPACE.sub(" ", s)
        if parts == " " or not parts:
            self.gap = self.gap or bool(parts)
            return
        if self.now and (self.gap or parts[0] == " "):
            self.now.append(" ")
        self.now.append(parts.strip(" "))
        self.gap = parts[-1] == " "

    def end(self, keep_empty: bool = False) -> None:
        if self.now or keep_empty:
            self._open()
            self.lines.append("".join(self.now))
        self.now, self.gap = [], False

    def _open(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False

    def space(self) -> None:
        self.end()
        self.blank = True

    def add(self, lines: list[str]) -> None:
        self.end()
        if lines:
            self._open()
            self.lines.extend(lines)


def _finish(work: Generator):
    """Runs a generator that yields others whose results it needs: nesting takes no recursion."""
    stack, value = [work], None
    while True:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
            if not stack:
                return value


def _inside(node: Node, out: _Lines, nested: bool) -> Generator:
    """Writes a node's children."""
    todo: list = [(node.children, 0)]
    ends: list = [None]
    while todo:
        children, k = todo.pop()
        if k == len(children):
            after = ends.pop()
            if after:
                after()
            continue
        todo.append((children, k + 1))
        x = children[k]
        if isinstance(x, str):
            out.text(x)
            continue
        if not visible(x):
            continue
        tag = x.tag
        if tag == "br":
            out.end(keep_empty=bool(out.lines) and not out.now and not out.blank)
        elif tag == "hr":
            out.space()
        elif tag == "img":
            if x.attrs.get("alt"):
                out.text(x.attrs["alt"])
        elif tag == "input":
            if x.attrs.get("value") and x.attrs.get("type", "").lower() in SHOWN_INPUT:
                out.text(f" {x.attrs['value']} ")
        elif tag == "pre":
            out.space()
            out.add("".join(_strings(x)).strip("\n").split("\n"))
            out.space()
        elif tag == "table":
            out.space()
            out.add((yield _table(x)))
            out.space()
        elif tag in ("ul", "ol", "menu"):
            (out.end if nested else out.space)()
            out.add((yield _list(x)))
            (out.end if nested else out.space)()
        elif tag == "q":
            out.text('"' + _SPACE.sub(" ", "".join(_strings(x))) + '"')
        else:
            if tag in SPACED:
                out.space()
                ends.append(out.space)
            elif tag in BLOCK:
                out.end()
                ends.append(out.end)
            else:
                ends.append(None)
            todo.append((x.children, 0))


def _strings(node: Node) -> Iterator[str]:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x.tag == "br":
            yield "\n"
        elif visible(x):
            todo.extend(reversed(x.children))


def _block(node: Node, nested: bool = True) -> Generator:
    out = _Lines()
    yield _inside(node, out, nested)
    out.end()
    return out.lines


def _list(node: Node) -> Generator:
    lines, number = [], 1
    if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")):
        number = int(node.attrs["start"])
    loose = Node("#loose", {}, [])
    for x in [*node.children, None]:
        is_item = isinstance(x, Node) and x.tag == "li"
        parts = []
        if (x is None or is_item) and loose.children:
            parts.append((loose, "  "))
        if is_item and visible(x):
            parts.append((x, f"{number}. " if node.tag == "ol" else "- "))
            number += 1
        for part, mark in parts:
            own = yield _block(part)
            lines.extend((mark if k == 0 else " " * len(mark)) + line if line else "" for k, line in enumerate(own))
        if is_item or x is None:
            loose.children = []
        else:
            loose.children.append(x)
    return lines


def _rows(node: Node) -> Iterator[tuple[int, Node]]:
    """The rows of a table, each with the number of its section."""
    for k, x in enumerate(node.children):
        if isinstance(x, Node) and visible(x):
            if x.tag == "tr":
                yield -1, x
            elif x.tag in SECTIONS:
                yield from ((k, y) for y in x.children if isinstance(y, Node) and y.tag == "tr" and visible(y))


def _strays(node: Node) -> Iterator[Node | str]:
    """What a table or its sections show besides rows."""
    for x in node.children:
        if isinstance(x, str):
            yield x
        elif visible(x):
            if x.tag in SECTIONS or x.tag == "colgroup":
                yield from _strays(x)
            elif x.tag not in ("tr", "col"):
                yield x


def _span(x: Node, name: str, most: int) -> int:
    n = x.attrs.get(name, "").strip()
    return min(max(int(n[:9]), 0 if name == "rowspan" else 1), most) if n.isascii() and n.isdigit() else 1


class _Grid:
    """Where a table's cells stand: those that span rows keep their columns taken in the rows below."""

    def __init__(self) -> None:
        self.until = np.zeros(0, dtype=np.int64)  #: by column: the first row in which it is free again

    def place(self, row: int, at: int, columns: int, rows: int) -> int:
        """The first column from `at` that is free; takes it and those behind it, for so many rows."""
        step = 1
        while at < len(self.until):
            free = self.until[at : at + step] <= row
            if free.any():
                at += int(free.argmax())
                break
            at = min(at + step, len(self.until))
            step *= 2
        if rows > 1:
            if at + columns > len(self.until):
                self.until = np.concatenate([self.until, np.zeros(max(at + columns - len(self.until), len(self.until)), dtype=np.int64)])
            self.until[at : at + columns] = np.maximum(self.until[at : at + columns], row + rows)
        return at


def _columns(grid: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """Where each column begins that a cell begins at: as wide as its cells, with two blanks between; a cell over several makes the last of these wider where they are too narrow."""
    edges = sorted({e for cells in grid for c, span, _ in cells for e in (c, c + span)})
    number = {e: k for k, e in enumerate(edges)}
    wide, over = [0] * len(edges), []
    for cells in grid:
        for c, span, lines in cells:
            need, a, b = max(map(width, lines), default=0), number[c], number[c + span]
            if b - a == 1:
                wide[a] = max(wide[a], need)
            else:
                over.append((b - a, a, b, need))
    starts = {c for cells in grid for c, _, _ in cells}
    gap = [2 if e in starts else 0 for e in edges]
    for _, a, b, need in sorted(over):
        wide[b - 1] += max(need - sum(wide[a:b]) - sum(gap[a + 1 : b]), 0)
    out, at = {}, 0
    for k, e in enumerate(edges):
        at += gap[k] if k else 0
        out[e] = at
        at += wide[k]
    return out


def _table(node: Node) -> Generator:
    out: list[str] = []
    for x in _strays(node):
        if not isinstance(x, str):
            out.extend((yield _block(Node("#", {}, [x]))))
        elif x.strip():
            out.append(_SPACE.sub(" ", x).strip())
    grid: list[list[tuple[int, int, list[str]]]] = []
    places, section = _Grid(), None
    for number, (part, row) in enumerate(_rows(node)):
        if part != section:
            places, section = _Grid(), part  # a cell doesn't reach beyond its section
        at, cells = 0, []
        for x in row.children:
            if isinstance(x, Node) and x.tag in ("td", "th") and visible(x):
                lines, span = (yield _block(x)), _span(x, "colspan", MOST_COLUMNS)
                at = places.place(number, at, span, _span(x, "rowspan", MOST_ROWS) or MOST_ROWS)
                cells.append((at, span, lines))
                at += span
            else:
                stray = x.strip() if isinstance(x, str) else " ".join((yield _block(x))) if visible(x) else ""
                if stray:
                    out.append(_SPACE.sub(" ", stray))
        grid.append(cells)
    start = _columns(grid)
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, used = [], 0
            for c, _, lines in cells:
                if k < len(lines) and lines[k]:
                    pad = max(start[c] - used, 2 if used else 0)
                    line.append(" " * pad + lines[k])
                    used += pad + width(lines[k])
            out.append("".join(line))
    return out


def render(source: str | None) -> str | None:
    """All visible text of a page; null for null, empty for a page that shows none."""
    if source is None:
        return None
    lines = [x.rstrip() for x in _finish(_block(parse(source), False))]
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, source: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: page_id) and text, a row for each row of pages.

    Null pages give null. Repeated rows and null ids are rendered like any other, very long
    pages whole. Columns that
    aren't carried are left out; carrying one named text raises a ValueError. Nothing is shuffled.
    """
    carry = ["page_id"] if carry is None else carry
    if "text" in carry:
        raise ValueError("column text would be written over")
    rows = pages.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(source).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())], ["row", "text"])

    return rows.mapInArrow(run, with_row(rows, "text string")).select("row.*", "text")
