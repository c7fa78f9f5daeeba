"""HTML to text with layout.

A tokenizer splits markup into tags, text, comments and raw-text elements; a tree builder closes
implied tags (the head, paragraphs, list items, table parts, options) and ignores end tags that match
nothing; inside svg and math ``/>`` closes an element, and HTML tags like ``<p>`` end them;
visibility rules drop elements that are never shown and those hidden by attribute or inline style;
a renderer walks the tree without recursion and emits all visible text: blocks on lines of their own
with blank lines around paragraphs, headings and the like, lists with bullets or numbers and
indentation, preformatted text as it is, and tables with aligned columns.

Scripts are not run and style sheets not read.  White space outside of ``pre`` is one blank.

Defined results: null and empty pages give an empty text; markup that ends early is closed; very
long and deeply nested pages are rendered whole; repeated rows get equal results; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow import small_batches, strings

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript iframe object canvas svg math datalist title meta link base xmp noembed noframes audio video".split())
PARAGRAPH = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCK = PARAGRAPH | set("html body div section article aside nav header footer main address form fieldset li dt dd figcaption details summary hgroup menu center dialog legend hr tr caption thead tbody tfoot".split())
# a start tag on the left closes an open element on the right, up to one of the borders
CLOSES: dict[str, tuple[frozenset, frozenset]] = {}
for _tags, _closed, _borders in (
    ("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("option optgroup", "option", "select"), ("tr", "tr td th caption colgroup", "table"),
    ("td th", "td th", "tr table"), ("thead tbody tfoot", "thead tbody tfoot tr td th caption colgroup", "table"), ("rt rp", "rt rp", "ruby"),
):
    for _tag in _tags.split():
        CLOSES[_tag] = frozenset(_closed.split()), frozenset(_borders.split())
CLOSES_P = BLOCK - {"html", "body", "tr", "caption", "thead", "tbody", "tfoot", "legend"}
P_BORDERS = frozenset("td th table caption button object html body".split())
END_BORDERS = frozenset("table td th".split())  # an end tag for anything but table parts doesn't reach beyond these
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())  # any other start tag ends an open head
# elements inside svg and math that hold HTML again, and HTML tags that end svg and math
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
# input types whose value is shown as something else than text, and those that show a placeholder
NO_VALUE = frozenset("hidden password checkbox radio file image range color".split())
NO_PLACEHOLDER = (NO_VALUE - {"password"}) | {"submit", "button", "reset", "date", "time", "datetime-local", "month", "week"}

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*>?|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
                 r"|(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str], foreign: bool = False):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], foreign


def self_closed(raw: str) -> bool:
    """Does the tag end in ``/>``?  A slash at the end of a value without quotes is a part of the value."""
    if not raw.endswith("/"):
        return False
    words = QUOTED.sub("", raw).split()
    return not (words[-1].partition("=")[2] or (len(words) > 1 and words[-2].endswith("=")))


def tokens(page: str, tree: Builder) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): text, start, end.  The tree has taken a token when the next is asked for."""
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        if m["cdata"] is not None:
            yield "text", m["cdata"], ""
        elif m["end"]:
            yield "end", m["end"].lower(), ""
        elif m["start"]:
            tag = m["start"].lower()
            raw = tag in RAW and not tree.foreign()
            yield "start", tag, m["attributes"]
            if raw:
                end = RAW_END[tag].search(page, at)
                yield "text", page[at:end.start() if end else len(page)], ""
                yield "end", tag, ""
                at = end.end() if end else len(page)


class Builder:
    """The tree in work: open elements, and how many are open of each tag."""

    def __init__(self):
        self.root = Element("#root", {})
        self.stack, self.open = [self.root], Counter()
        self.headed = False  # has anything come that a head can't follow?

    def foreign(self) -> bool:
        """Is the next element one of svg or math, not of HTML?"""
        return self.stack[-1].foreign and self.stack[-1].tag not in HTML_INSIDE

    def push(self, element: Element) -> None:
        self.stack[-1].children.append(element)
        if element.tag not in VOID:
            self.stack.append(element)
            self.open[element.tag] += 1

    def cut(self, k: int) -> None:
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
        del self.stack[k:]

    def leave_head(self) -> None:
        if self.stack[-1].tag == "head":
            self.cut(len(self.stack) - 1)

    def leave_foreign(self) -> None:
        k = len(self.stack)
        while self.stack[k - 1].foreign and self.stack[k - 1].tag not in HTML_INSIDE:
            k -= 1
        self.cut(k)

    def text(self, value: str) -> None:
        if not self.headed or self.stack[-1].tag == "head":
            if value.strip(" \t\n\r\f"):
                self.headed = True
                self.leave_head()
        self.stack[-1].children.append(value)

    def has_p(self) -> bool:
        """Is a paragraph open that a block may close?"""
        if self.open["p"]:
            for e in reversed(self.stack):
                if e.tag == "p":
                    return True
                if e.tag in P_BORDERS:
                    break
        return False

    def close(self, tag: str) -> None:
        if self.open[tag]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    return self.cut(k)
                if self.stack[k].tag in END_BORDERS and tag not in TABLE_PARTS:
                    return None

    def start(self, tag: str, raw: str) -> None:
        if self.foreign() and (tag in ENDS_FOREIGN or (tag == "font" and {"color", "face", "size"} & attributes_of(raw).keys())):
            self.leave_foreign()
        if self.foreign() or tag in ("svg", "math"):
            self.headed = True
            self.leave_head()
            self.push(Element(tag, attributes_of(raw), True))
            if self_closed(raw):
                self.close(tag)
            return
        if tag == "body" and self.open["head"] and not self.open["template"]:
            self.cut(next(k for k, e in enumerate(self.stack) if e.tag == "head"))
        if tag not in HEAD:
            self.leave_head()
        if (tag in ("html", "body") and self.open[tag]) or (tag == "head" and self.headed):
            return
        self.headed |= tag != "html"
        if tag in CLOSES and any(self.open[t] for t in CLOSES[tag][0]):
            closed, borders = CLOSES[tag]
            first = None
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in borders:
                    break
                if self.stack[k].tag in closed:
                    first = k
            if first is not None:
                self.cut(first)
        if tag in CLOSES_P and self.has_p():
            self.close("p")
        self.push(Element(tag, attributes_of(raw)))


def attributes_of(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip() else {}


def build(page: str) -> Element:
    """The tree, with implied tags closed."""
    tree = Builder()
    for kind, value, raw in tokens(page, tree):
        if kind == "text":
            tree.text(unescape(value) if "&" in value and tree.stack[-1].tag not in ("script", "style") else value)
        elif kind == "start":
            tree.start(value, raw)
        elif value == "br" or (value == "p" and not tree.has_p()):
            if value == "br":
                tree.leave_head()
            tree.push(Element(value, {}))
            tree.close(value)
        else:
            tree.close(value)
    return tree.root


def visible(e: Element) -> bool:
    a = e.attributes
    if e.tag in HIDDEN or "hidden" in a or (e.tag == "dialog" and "open" not in a) or (e.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return not ("style" in a and UNSEEN.search(a["style"]))


MAX_INDENT = 20  # levels of indentation shown; deeper ones stay at this depth


def paragraph(e: Element, w: Writer) -> bool:
    """Is the block set off by blank lines?  A list inside a list item is not."""
    return e.tag in PARAGRAPH and not (e.tag in ("ul", "ol") and bool(w.indent))


class Writer:
    """Lines of text; blocks ask for line breaks, words wait until something follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank_wanted = self.space = False
        self.indent: list[str] = []
        self.marker = ""

    def text(self, value: str) -> None:
        """Inline text: white space collapses, also across elements."""
        words = BLANK.sub(" ", value)
        if words[:1] == " " and self.line:
            self.space = True
        words_ = words.strip(" ")
        if not words_:
            return
        self.begin()
        if self.space:
            self.line.append(" ")
        self.line.append(words_)
        self.space = words[-1:] == " "

    def begin(self) -> None:
        if not self.line:
            if self.blank_wanted and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank_wanted = False
            lead = "".join(self.indent[-MAX_INDENT:])
            if self.marker:
                lead = lead[:len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.line.append(lead)
            self.space = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, apart: bool) -> None:
        self.end_line()
        self.blank_wanted |= apart

    def hard_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and not self.blank_wanted and self.lines[-1]:
            self.lines.append("")

    def raw(self, lines: list[str]) -> None:
        """Lines that keep their white space."""
        for x in lines:
            if self.line:
                self.line.append(x)
            else:
                self.begin()
                self.line.append(x)
            self.end_line()

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def plain(root: Element) -> str:
    """All text below an element, as it stands in the page."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            out.append(e)
        elif e.tag == "br":
            out.append("\n")
        elif visible(e):
            stack.extend(reversed(e.children))
    return "".join(out)


def rows_of(table: Element) -> tuple[list[list[Element]], list[Element]]:
    """Rows of cells of a table without those of tables inside; what else it holds (captions, text)."""
    rows: list[list[Element]] = []
    other: list = []
    stack = list(reversed(table.children))
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            if e.strip():
                other.append(e)
        elif not visible(e):
            continue
        elif e.tag in ("thead", "tbody", "tfoot", "colgroup"):
            stack.extend(reversed(e.children))
        elif e.tag == "tr":
            cells = [c for c in e.children if not isinstance(c, str) and c.tag in ("td", "th") and visible(c)]
            other += [c for c in e.children if (c.strip() if isinstance(c, str) else c.tag not in ("td", "th"))]
            rows.append(cells)
        elif e.tag in ("td", "th"):
            rows.append([e])
        else:
            other.append(e)
    return rows, other


def span(e: Element, name: str) -> int:
    value = e.attributes.get(name, "")
    return min(max(int(value), 1), 1000) if value.isdecimal() else 1


MAX_PAD = 120


def placed(grid: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(first column, column behind the last, text) of each cell; cells that reach down keep their columns free below."""
    out, busy = [], {}
    for row in grid:
        cells, below, at = [], {c: n - 1 for c, n in busy.items() if n > 1}, 0
        for text, wide, down in row:
            while at in busy:
                at += 1
            cells.append((at, at + wide, text))
            if down > 1:
                below |= dict.fromkeys(range(at, at + wide), down - 1)
            at += wide
        out.append(cells)
        busy = below
    return out


def table_lines(grid: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text, columns and rows they span) in aligned columns, two blanks apart; all text is kept.

    Only columns that some cell begins in are laid out, so a span is no wider than what it spans.  Cells
    longer than MAX_PAD don't widen their column: what follows them moves to the right.
    """
    rows = placed(grid)
    columns = sorted({a for row in rows for a, _, _ in row})
    number = {c: k for k, c in enumerate(columns)}
    widths = [0] * len(columns)
    behind = lambda b: bisect.bisect_left(columns, b)
    for row in rows:
        for a, b, text in row:
            if behind(b) == number[a] + 1:
                widest = max((len(x) for x in text.split("\n")), default=0)
                widths[number[a]] = max(widths[number[a]], min(widest, MAX_PAD))
    lines = []
    for row in rows:
        if not any(text for *_, text in row):
            continue
        cells = [(number[a], behind(b), text.split("\n")) for a, b, text in row]
        for k in range(max((len(c) for *_, c in cells), default=0)):
            parts, at = [], 0
            for first, end, cell in cells:
                parts += [" " * w for w in widths[at:first]]  # columns of a cell further up
                width = sum(widths[first:end]) + 2 * (end - first - 1)
                parts.append((cell[k] if k < len(cell) else "").ljust(width))
                at = max(end, first + 1)
            lines.append("  ".join(parts).rstrip(" "))
    return lines


def render(root: Element) -> str:
    """Visible text of a tree.  Frames on an explicit stack; a table's cells get writers of their own."""
    out = Writer()
    stack: list[tuple] = [("node", root, out)]
    while stack:
        what, e, w = stack.pop()
        if what == "leave":
            leave(e, w)
        elif what == "table":
            finish_table(e, w)
        elif isinstance(e, str):
            w.text(e)
        elif visible(e):
            stack.extend(enter(e, w))
    return out.result()


def enter(e: Element, w: Writer) -> list[tuple]:
    """What to do for an element, last step first."""
    tag = e.tag
    if tag == "br":
        w.hard_break()
        return []
    if tag == "hr":
        w.block(True)
        return []
    if tag == "img":
        w.text(f" {e.attributes['alt']} " if e.attributes.get("alt", "").strip() else "")
        return []
    if tag == "input":
        a, kind = e.attributes, e.attributes.get("type", "").lower()
        placeholder = "" if kind in NO_PLACEHOLDER or (kind == "password" and a.get("value")) else a.get("placeholder", "")
        shown = a.get("alt", "") if kind == "image" else ("" if kind in NO_VALUE else a.get("value", "")) or placeholder
        w.text(f" {shown} " if shown.strip() else "")
        return []
    if tag in BLOCK:
        w.block(paragraph(e, w))
    if tag == "pre":
        w.raw(plain(e).removeprefix("\n").removesuffix("\n").split("\n"))
        w.block(True)
        return []
    if tag == "table":
        rows, other = rows_of(e)
        cells = [[(Writer(), c) for c in row] for row in rows]
        todo: list[tuple] = [("leave", e, w), ("table", [[(cw, span(c, "colspan"), span(c, "rowspan")) for cw, c in row] for row in cells], w)]
        todo += [("node", Inside(c), cw) for row in reversed(cells) for cw, c in reversed(row)]
        return todo + [("node", x, w) for x in reversed(other)]
    if tag in ("ul", "ol", "menu"):
        number = int(e.attributes["start"]) if e.attributes.get("start", "").lstrip("-").isdecimal() else 1
        for c in e.children:
            if not isinstance(c, str) and c.tag == "li":
                c.attributes["#marker"] = f"{number}. " if tag == "ol" else "- "
                number += 1
    elif tag == "li":
        marker = e.attributes.setdefault("#marker", "- ")
        w.indent.append(" " * len(marker))
        w.marker = marker
    elif tag in ("blockquote", "dd"):
        w.indent.append("  ")
    elif tag in ("td", "th", "option", "button", "legend", "label", "textarea", "select"):
        w.text(" ")
    return [("leave", e, w), *[("node", c, w) for c in reversed(e.children)]]


class Inside(Element):
    """A cell as the root of its own text."""

    def __init__(self, cell: Element):
        super().__init__("#cell", {})
        self.children = cell.children


def leave(e: Element, w: Writer) -> None:
    if e.tag == "li":
        w.end_line()
        w.indent.pop()
        w.marker = ""
    elif e.tag in ("blockquote", "dd"):
        w.end_line()
        w.indent.pop()
    elif e.tag in ("td", "th", "option", "button", "legend", "label", "textarea", "select"):
        w.text(" ")
    if e.tag in BLOCK:
        w.block(paragraph(e, w))


def finish_table(grid: list[list[tuple[Writer, int, int]]], w: Writer) -> None:
    w.raw(table_lines([[(cw.result(), wide, down) for cw, wide, down in row] for row in grid]))


def to_text(page: str) -> str:
    return render(build(page)) if page else ""


def html_text(docs: DataFrame, html: Column) -> Column:
    """Column with the rendered text of an HTML column."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([to_text(x) for x in strings(batch)], pa.string())

    return convert.asNondeterministic()(html)


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines for every page."""
    found = pages.select("page_id", html_text(pages, F.col("html")).alias("text"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))
