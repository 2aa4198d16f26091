"""HTML extraction: layout-aware rendering of all visible text.

A tree builder applies the implied-tag rules (paragraphs, list items, table parts and options end where the next
begins; end tags close what stands open inside them), a renderer walks the tree with the visibility rules and lays text
out: blocks on their own lines, blank lines where browsers leave margins, list markers and indents, and table cells
padded to the width of their column, with column and row spans. Neither recurses, so elements nest to any depth, and
where an open element of a kind stands is looked up, so a tag costs the same at any depth.

Defined cases
* null or empty html: an empty text. Text without tags: that text, white space collapsed as in a browser.
* broken markup: open elements end with the document, stray end tags are ignored. What stands in a table but in no
  cell or caption is laid out before the table, a form there is empty, and text ends an open head.
* spans are read as in a browser: leading digits, columns up to 1000, rows up to the end of the row group (0: all of them).
  A column in which no cell begins takes no room. Cells over rows show their text in the first of them. Tables that are
  nearly all padding (PADDED_MOST) are not aligned; no text is lost.
* indents stop growing at INDENT_MOST characters; text further in stays there.
* declarations that the standard does not know, sections in brackets among them, are comments.
* repeated rows: each is returned. Empty table: no rows. Only the id is carried over, so other columns cannot clash.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of indent beyond which lists and quotes are not set in further: else nesting would multiply the text.
INDENT_MOST = 120
#: A table whose padding is over so many times its text is not aligned: two spaces stand between cells.
PADDED_MOST = 20

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INVISIBLE = {"head", "title", "script", "style", "template", "noscript", "iframe", "noframes", "object", "svg", "canvas", "audio", "video", "datalist", "math", "map"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "ul"}
MARGIN = {"blockquote", "dl", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "menu", "ol", "p", "pre", "table", "ul", "hr"}
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend"}
TABLE_PARTS = {"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}
#: Elements whose own content is table parts; of other content, only IN_PLACE stays in them.
TABLE_LEVELS = {"table", "thead", "tbody", "tfoot", "tr"}
IN_PLACE = TABLE_PARTS | {"col", "script", "style", "template"}
#: Elements that begin content of another kind inside a table.
APART = {"template", "noscript", "noframes", "iframe", "svg", "math"}
NO_TABLE_LEVEL = {"td", "th", "caption"} | APART
_WHOLE_TABLE = (TABLE_PARTS, {"table"} | APART)
#: What a start tag ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"} | APART),
    "td": ({"td", "th"}, {"table", "tr"} | APART),
    "th": ({"td", "th"}, {"table", "tr"} | APART),
    "thead": _WHOLE_TABLE,
    "tbody": _WHOLE_TABLE,
    "tfoot": _WHOLE_TABLE,
    "caption": _WHOLE_TABLE,
    "colgroup": _WHOLE_TABLE,
}
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str | None] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)
    home: Element | None = field(default=None, repr=False, compare=False)  # of a table: the element it stands in

    @property
    def visible(self) -> bool:
        a = self.attributes
        if self.tag in INVISIBLE or "hidden" in a or _HIDING.search(a.get("style") or ""):
            return False
        return not (self.tag == "dialog" and "open" not in a)


class TreeBuilder(HTMLParser):
    """Builds the tree; the root stands for the document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self._open = [self.root]
        #: By tag, where its open elements stand among all.
        self._at: dict[str, list[int]] = {}

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def _cut(self, at: int) -> None:
        """Ends the open elements from there on."""
        for x in self._open[at:]:
            self._at[x.tag].pop()
        del self._open[at:]

    def _innermost(self, tags: set[str]) -> int:
        """The place of the innermost open element of those tags; 0 if there is none."""
        if len(tags) > len(self._at):
            return max((places[-1] for tag, places in self._at.items() if places and tag in tags), default=0)
        return max((self._at[tag][-1] for tag in tags if self._at.get(tag)), default=0)

    def _end(self, tags: set[str], barriers: set[str]) -> None:
        """Ends the outermost open element of those tags that no barrier encloses."""
        if not any(self._at.get(tag) for tag in tags):
            return
        wall = self._innermost(barriers)
        inside = [places[k] for tag in tags if (places := self._at.get(tag)) and (k := bisect_right(places, wall)) < len(places)]
        if inside:
            self._cut(min(inside))

    def _level(self, levels: set[str]) -> int | None:
        """The place of the innermost of those levels of the table that is being read outside its cells and caption."""
        at = self._innermost(levels)
        return at if at and at > self._innermost(NO_TABLE_LEVEL) else None

    def _add(self, new: Element | str, in_place: bool) -> None:
        """Adds to the open element, or before the table if that is a table level and the content has no place there."""
        here = self._open[-1]
        if not in_place and here.tag in TABLE_LEVELS and (table := self._level({"table"})) is not None:
            self._open[table].home.children.insert(-1, new)  # an open table is the last child
        else:
            here.children.append(new)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "head", "body") and self._at.get(tag):
            return
        if self._open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self._cut(-1)
        if tag in ("table", "form"):
            table = self._level({"table"})
            if table is not None and tag == "form":
                return  # it is closed at once and stays empty
            if table is not None:
                self._cut(table)
        elif tag in TABLE_PARTS and (level := self._level(TABLE_LEVELS)) is not None:
            self._cut(level + 1)
        if tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag == "body" or (tag not in INVISIBLE | {"meta", "link", "base", "html", "#document"} and self._open[-1].tag == "head"):
            self._end({"head"}, set())
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in ("td", "th") and self._open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Element("tr"))
        new = Element(tag, dict(attrs))
        if tag in VOID:
            self._add(new, tag in IN_PLACE)
        else:
            self._push(new)

    def _push(self, new: Element) -> None:
        if new.tag == "table":
            new.home = self._open[-1]
        self._add(new, new.tag in IN_PLACE)
        self._at.setdefault(new.tag, []).append(len(self._open))
        self._open.append(new)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._add(Element("br"), False)
            return
        stop = {"table"} if tag in TABLE_PARTS else set() if tag in APART | {"table"} else {"td", "th", "caption", "table"}
        at = self._innermost({tag})
        if at and self._innermost(stop - {tag}) < at:
            self._cut(at)

    def handle_data(self, data: str) -> None:
        blank = not data.strip(" \t\n\r\f")
        if not blank and self._open[-1].tag in ("head", "colgroup"):
            self._cut(-1)
        self._add(data, blank)


def parse(html: str) -> Element:
    builder = TreeBuilder()
    builder.feed(html)
    if re.match(r"<[a-zA-Z/!?]", builder.rawdata):
        builder.rawdata = ""  # the document ends inside a tag
    builder.close()
    return builder.root


class _Lines:
    """Lays out text: collapsed white space, pending blank lines, and a prefix for each line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self._line: list[str] = []
        self._space = self._began = False
        self.indent = ""
        self.marker = ""
        self._blank = False

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").expandtabs(8).split("\n")
            self._add(first)
            for line in rest:
                self.newline(force=True)
                self._add(line)
            return
        words = _SPACE.split(data)
        for k, word in enumerate(words):
            if k and self._began:
                self._space = True
            if word:
                self._add((" " if self._space and self._began else "") + word)
                self._space = False

    def _add(self, piece: str) -> None:
        if piece:
            if not self._began:
                if self._blank and self.lines:
                    self.lines.append("")
                self._blank = False
                self._line.append(self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker if self.marker else self.indent)
                self.marker = ""
                self._began = True
            self._line.append(piece)

    def newline(self, force: bool = False) -> None:
        if self._began:
            self.lines.append("".join(self._line).rstrip())
        elif force and self.lines and not self._blank:
            self.lines.append("")
        self._line, self._began, self._space = [], False, False

    def block(self, margin: bool) -> None:
        self.newline()
        self._blank |= margin


def _span(cell: Element, name: str, most: int, every: int = 1) -> int:
    """The number with which the attribute begins, up to `most`; 1 if there is none, `every` for a zero."""
    digits = re.match(r"[ \t\n\f\r]*\+?([0-9]+)", cell.attributes.get(name) or "")
    if not digits:
        return 1
    plain = digits[1].lstrip("0")
    return min(int(plain[:9]), most) if plain else every


@dataclass(frozen=True)
class Cell:
    text: str
    start: int  # column
    end: int


def _placed(row: list[tuple[str, int, int]], taken: list[tuple[int, int, int]], nth: int) -> tuple[list[Cell], list[tuple[int, int, int]]]:
    """The cells of the nth row (text, columns, and the row before which it ends) in the columns that cells from above leave, and the columns that are taken in the next row: from, to, and the row before which that ends."""
    cells, at, rest = [], 0, iter([*taken, (sys.maxsize, sys.maxsize, 0)])
    start, end, _ = next(rest)
    for text, columns, _until in row:
        while at >= start:
            at = max(at, end)
            start, end, _ = next(rest)
        cells.append(Cell(text, at, at + columns))
        at += columns
    held = [x for x in taken if x[2] > nth + 1] + [(c.start, c.end, until) for c, (_, _, until) in zip(cells, row, strict=True) if until > nth + 1]
    out: list[tuple[int, int, int]] = []
    for a, b, until in sorted(held):
        if out and out[-1][2] == until and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]), until)
        else:
            out.append((a, b, until))
    return cells, out


def _lay_out(rows: list[list[Cell]]) -> list[str]:
    """A line a row. A column is as wide as the widest cell that covers no other column's beginning."""
    starts = sorted({c.start for row in rows for c in row})
    width = dict.fromkeys(starts, 0)
    for row in rows:
        for c in row:
            after = bisect_right(starts, c.start)
            if after == len(starts) or starts[after] >= c.end:
                width[c.start] = max(width[c.start], len(c.text))
    left = dict(zip(starts, accumulate((width[x] + 2 for x in starts), initial=0), strict=False))
    if sum(left[row[-1].start] for row in rows if row) > PADDED_MOST * (1000 + sum(len(c.text) + 2 for row in rows for c in row)):
        left = dict.fromkeys(starts, 0)
    lines = []
    for row in rows:
        parts, at = [], 0
        for c in row:
            parts.append(" " * (max(left[c.start] - at, 2 if at else 0)) + c.text)
            at += len(parts[-1])
        lines.append("".join(parts).rstrip())
    return lines


#: A step of the walk: it yields the steps that it waits for, and gets what they return.
Step = Generator["Step", str, str]


def _walked(step: Step) -> str:
    """Runs a step and all that it waits for, without recursion."""
    stack, told = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(told))
            told = None
        except StopIteration as e:
            stack.pop()
            told = e.value
    return told


def _table(table: Element, to: _Lines) -> Step:
    rows: list[list[Cell]] = []
    taken: list[tuple[int, int, int]] = []
    for at, part in enumerate(table.children):
        group = isinstance(part, Element) and part.tag in ("thead", "tbody", "tfoot") and part.visible
        if group:
            taken = []  # no cell reaches into another group of rows
        last = len((part if group else table).children)
        for nth, row in enumerate(part.children) if group else [(at, part)]:
            if isinstance(row, str):
                if row.strip():
                    to.text(row, False)  # browsers show stray text before the table
                    to.newline()
            elif row.tag == "tr" and row.visible:
                cells = []
                for c in row.children:
                    if isinstance(c, Element) and c.tag in ("td", "th") and c.visible:
                        text = yield _render(c)
                        cells.append((" ".join(text.split()), _span(c, "colspan", 1000), min(nth + _span(c, "rowspan", 65534, last), last)))
                placed, taken = _placed(cells, taken, nth)
                rows.append(placed)
            elif row.tag == "caption" or row.tag not in ("colgroup", "col", "thead", "tbody", "tfoot", "tr"):
                yield _walk(row, to, False)
                to.newline()
        if group:
            taken = []
    for line in _lay_out(rows):
        if line:
            to.text(line, True)
            to.newline()
    return ""


def _walk(node: Element, to: _Lines, keep: bool) -> Step:
    if not node.visible:
        return ""
    tag = node.tag
    if tag == "br":
        to.newline(force=True)
        return ""
    if tag == "input":
        kind = (node.attributes.get("type") or "text").lower()
        if kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and node.attributes.get("value"):
            to.text(f" {node.attributes['value']} ", False)
        return ""
    block, margin = tag in BLOCK, tag in MARGIN
    outer = to.indent
    if block:
        margin = margin and not (tag in ("ul", "ol", "menu", "dir") and outer.endswith("  "))  # a list in a list item
        to.block(margin)
    if tag == "table":
        yield _table(node, to)
        to.block(margin)
        return ""
    number = 1
    if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", node.attributes.get("start") or ""):
        number = int(node.attributes["start"])
    if tag in ("dd", "blockquote"):
        to.indent += _further(to.indent, 4)
    keep = keep or tag in ("pre", "textarea", "listing", "xmp")
    closed = tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if not closed:
                to.text(child, keep)
        elif child.tag == "li" and tag in ("ul", "ol", "menu", "dir"):
            marker = f"{number}. " if tag == "ol" else "* "
            number += tag == "ol"
            inner = to.indent
            to.indent, to.marker = inner + _further(inner, max(2, len(marker))), marker
            yield _walk(child, to, keep)
            to.newline()
            to.indent, to.marker = inner, ""
        elif not closed or child.tag == "summary":
            yield _walk(child, to, keep)
    to.indent = outer
    if block:
        to.block(margin)
    elif tag in TABLE_PARTS:
        to.text(" ", False)
    return ""


def _further(indent: str, more: int) -> str:
    return " " * more if len(indent) + more <= INDENT_MOST else ""


def _render(node: Element) -> Step:
    to = _Lines()
    for child in node.children:
        if isinstance(child, str):
            to.text(child, False)
        else:
            yield _walk(child, to, False)
    to.newline()
    return "\n".join(to.lines)


def render(html: str) -> str:
    """All visible text of a page, laid out."""
    return _walked(_render(parse(html or ""))).strip("\n")


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id and the text of every page."""
    schema = T.StructType([pages.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(h.as_py()) for h in batch.column(1)], pa.string())], names=schema.names)

    return pages.select(id_col, html_col).mapInArrow(run, schema)
