"""Layout-aware text of HTML pages.

A tree is built from the tags, with the end tags and elements that HTML lets
authors leave out; elements that are not shown are skipped; the rest is written
as lines: blocks begin a line, paragraphs and the like stand apart by a blank
line, list items carry their mark, and cells of a table stand under each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topshare.llm.common import prepare_workers, texts_of

_TAG = re.compile(
    r"<!--(?:>|.*?(?:-->|\Z))"
    r"|<[!?][^>]*+>?"
    r"|<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<slash2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_UNFINISHED = re.compile(r"<[!?/a-zA-Z]")
#: Elements are nested so deep at most.
_DEEPEST = 512

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The text of these is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_ENTITIES_IN_RAW = frozenset(["textarea", "title"])
_HEAD = frozenset("base link meta script style template title noscript".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_PARAGRAPH = _HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header"
    " hgroup hr main menu nav ol p pre search section table ul".split()
)
_CELLS = frozenset(["td", "th"])
_ROW_GROUPS = frozenset(["thead", "tbody", "tfoot"])
#: A start tag ends the open elements on the left, looked for up to those on the right.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (_CELLS, frozenset(["tr", "table"])),
    "th": (_CELLS, frozenset(["tr", "table"])),
    "tr": (_CELLS | {"tr", "caption", "colgroup"}, frozenset(["table"])),
    **{g: (_CELLS | _ROW_GROUPS | {"tr", "caption", "colgroup"}, frozenset(["table"])) for g in _ROW_GROUPS},
    "a": (frozenset(["a"]), frozenset("table td th li".split())),
    "button": (frozenset(["button"]), frozenset(["table"])),
}
#: An end tag does not reach out of these.
_SCOPE = frozenset("table td th caption html template foreignobject annotation-xml".split())
_TABLE_PARTS = _CELLS | _ROW_GROUPS | {"tr", "caption", "colgroup", "table"}

_NEVER_SHOWN = frozenset(
    "head script style template noscript title iframe noembed noframes object audio video canvas datalist".split()
)
_FOREIGN = frozenset(["svg", "math"])
#: HTML goes on inside these elements of SVG and MathML.
_HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: These start tags end SVG and MathML.
_ENDS_FOREIGN = _HEADINGS | frozenset(
    "b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre ruby s"
    " small span strong strike sub sup table tt u ul var".split()
)
_NOT_DRAWN = frozenset(
    "defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient filter".split()
)
_ANNOTATIONS = frozenset(["annotation", "annotation-xml"])
#: Parts of a formula that stand apart.
_APART_IN_MATH = frozenset("mfrac mtd munder mover munderover".split())
_BARE_SLASH = re.compile(r"=\s*[^\s\"'=]*/\Z")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)

_APART = _HEADINGS | frozenset("p ul ol menu dir dl blockquote pre table fieldset figure".split())
_BLOCKS = _APART | _ENDS_PARAGRAPH | frozenset("html body li dt dd tr caption summary legend option optgroup".split())
#: Cells are filled up to so many characters at most.
WIDEST = 80
#: Tables in tables, deeper than this, are written as blocks.
_DEEPEST_TABLE = 12


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The tree of a page, from ``html`` down, with head and body."""
    return _Builder().build(page)


class _Builder:
    def __init__(self):
        self.root = Node("html")
        self.head = Node("head")
        self.body = Node("body")
        self.root.children = [self.head, self.body]
        self.open = [self.root, self.head]
        self._foreign = False  # whether the page has SVG or MathML so far

    def build(self, page: str) -> Node:
        # Behind the last ">" there is no whole tag, so no search runs in vain to the end of the page.
        at, end = 0, page.rfind(">") + 1
        while at < end:
            match = _TAG.search(page, at, end)
            if match is None:
                self.text(page[at:end])
                break
            if match.start() > at:
                self.text(page[at : match.start()])
            at = match.end()
            name = match["name"] or match["name2"]
            if name is None:
                continue  # comment or declaration
            name = name.lower()
            if match["slash"] or match["slash2"]:
                self.end(name)
                continue
            attrs = match["attrs"] or match["attrs2"] or ""
            self.start(name, _attributes(attrs) if attrs.strip(" /") else {})
            if self._foreign and attrs[-1:] == "/" and self.open[-1].tag == name and not _BARE_SLASH.search(attrs):
                if name in _FOREIGN or self.foreign():
                    self.open.pop()
                    continue
            if name in _RAW:
                stop = _RAW_END[name].search(page, at)
                raw = page[at : stop.start() if stop else len(page)]
                if self.open[-1].tag == name:
                    self.open[-1].children.append(html.unescape(raw) if name in _ENTITIES_IN_RAW else raw)
                at = stop.start() if stop else len(page)
        rest = page[max(at, end) :]
        self.text(rest[: cut.start()] if (cut := _UNFINISHED.search(rest)) else rest)
        return self.root

    def text(self, text: str) -> None:
        if not text:
            return
        if self.open[-1].tag in ("pre", "textarea") and not self.open[-1].children:
            text = text.removeprefix("\n")
        if self.open[-1] is self.head:
            if not text.strip():
                return
            self.open = [self.root, self.body]
        self.open[-1].children.append(html.unescape(text) if "&" in text else text)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if name == "head":
            return
        if name == "body":
            self.body.attrs = attrs | self.body.attrs
            if self.body not in self.open:
                self.open = [self.root, self.body]
            return
        if self.head in self.open and name not in _HEAD and self.open[-1] is self.head:
            self.open = [self.root, self.body]
        if name in _FOREIGN:
            self._foreign = True
        elif self._foreign and name in _ENDS_FOREIGN:
            while at := self.foreign():
                del self.open[at:]
        if name in _ENDS_PARAGRAPH:
            self.pop({"p"}, _SCOPE | {"button"})
        if name in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self.open.pop()
        if name in _ENDS:
            targets, limits = _ENDS[name]
            while self.pop(targets, limits):
                pass
        if name in _CELLS and self.open[-1].tag in _ROW_GROUPS | {"table"}:
            self.push(Node("tr"))
        node = Node(name, attrs)
        if name in _VOID:
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def foreign(self) -> int:
        """The place of the SVG or MathML element whose rules hold now, or 0."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in _FOREIGN:
                return i
            if tag in _HTML_INSIDE:
                return 0
        return 0

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if len(self.open) < _DEEPEST:  # as browsers do; what is inside then stands beside
            self.open.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name == "head":
            if self.head in self.open:
                self.open = [self.root, self.body]
        elif name == "p" and not self.pop({"p"}, _SCOPE):
            self.start("p", {})
            self.pop({"p"}, _SCOPE)
        elif name not in ("html", "body", "p"):
            targets = _HEADINGS if name in _HEADINGS else {name}
            self.pop(targets, frozenset(["html"]) if name in _TABLE_PARTS else _SCOPE)

    def pop(self, targets, limits) -> bool:
        """Close the nearest open element of ``targets``, if it is above any of ``limits``."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in targets and self.open[i] not in (self.head, self.body):
                del self.open[i:]
                return True
            if tag in limits or self.open[i] is self.body:
                return False
        return False


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def _hidden(node: Node, closed: bool) -> bool:
    """Whether an element and all in it takes no part in the layout; ``closed``: it is inside closed details."""
    attrs = node.attrs
    if node.tag in _NEVER_SHOWN or (closed and node.tag != "summary"):
        return True
    if not attrs:
        return node.tag == "dialog"
    if "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs):
        return True
    return bool(_NO_DISPLAY.search(attrs.get("style", "")))


class _Lines:
    """Lines in the making: pending breaks, and marks and indents at their start."""

    def __init__(self):
        self.done: list[str] = []
        self._parts: list[str] = []
        self._ends_in_space = True
        self._gap = 0
        self._indents: list[list[str]] = []  # what the next line starts with, and what later ones do

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if self._ends_in_space:
            text = text[1:] if text[:1] == " " else text
        if text:
            self._parts.append(text)
            self._ends_in_space = text[-1] == " "

    def preformatted(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self._raw(first)
        for line in rest:
            self.new_line()
            self._raw(line)

    def _raw(self, text: str) -> None:
        if text:
            self._parts.append(text)
            self._ends_in_space = False

    def new_line(self) -> None:
        """A line break of the author: an empty line counts."""
        self._flush(True)

    def block(self, apart: int = 0) -> None:
        """End the line; at least ``apart`` blank lines come before the next."""
        self._flush(False)
        self._gap = max(self._gap, apart)

    def indent(self, mark: str, later: str) -> None:
        self._indents.append([mark, later])

    def dedent(self) -> None:
        self._indents.pop()

    def _flush(self, even_empty: bool) -> None:
        line = "".join(self._parts).rstrip(" ")
        self._parts, self._ends_in_space = [], True
        if not line and not even_empty:
            return
        if self.done:
            self.done.extend([""] * self._gap)
        self._gap = 0
        start = "".join([i[0] for i in self._indents])
        if line:
            for i in self._indents:
                i[0] = i[1]
        if line or self.done:
            self.done.append((start + line).rstrip(" ") if not line else start + line)


def render(node: Node, depth: int = 0) -> list[str]:
    """The lines of the visible text of an element."""
    lines = _Lines()
    # What is still to do, the next on top: nodes, texts and ends of elements.
    # With each goes whether it is shown, whether in pre, and where in SVG ("svg", "text") or MathML ("math") it is.
    todo: list[tuple] = [("node", node, True, False, "")]
    lists: list[list] = []
    while todo:
        kind, item, shown, pre, inside = todo.pop()
        if kind == "end":
            item()
            continue
        if isinstance(item, str):
            if shown and inside != "svg":
                (lines.preformatted if pre else lines.text)(item)
            continue
        tag = item.tag
        if inside or tag in _FOREIGN:
            if _not_drawn(item, inside):
                continue
            if seen := item.attrs.get("visibility") if inside != "math" else None:
                shown = seen.strip().lower() == "visible"
            if tag == "mphantom":
                shown = False
        if style := item.attrs.get("style"):
            if seen := _VISIBILITY.search(style):
                shown = seen[1].lower() == "visible"
        if tag == "br":
            if shown:
                lines.new_line()
            continue
        if tag == "hr":
            lines.block(1)
            continue
        apart = 1 if tag in _APART and not (lists and tag in ("ul", "ol", "menu", "dir")) else 0
        if tag == "table" and depth < _DEEPEST_TABLE:
            lines.block(1)
            for row in _table(item, shown, depth + 1):
                if shown:
                    lines._raw(row)
                lines.block()
            lines.block(1)
            continue
        ends = []
        if tag in _BLOCKS:
            lines.block(apart)
            ends.append(lambda a=apart: lines.block(a))
        elif tag in _CELLS:
            lines.text(" ")
        elif inside or tag in _FOREIGN:
            inside, sides = _foreign_inside(item, inside)
            if sides:
                lines.text(" ")
                ends.append(lambda: lines.text(" "))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(item.attrs.get("start"), 1)])
            ends.append(lists.pop)
        elif tag == "li":
            mark = _mark(lists, item)
            lines.indent(mark, " " * len(mark))
            ends += [lambda: lines.block(), lines.dedent]
        elif tag in ("blockquote", "dd"):
            lines.indent("  ", "  ")
            ends += [lambda: lines.block(), lines.dedent]
        pre = pre or tag in ("pre", "textarea", "xmp")
        for end in ends[::-1] if tag not in ("li", "blockquote", "dd") else (ends[0], *ends[:0:-1]):
            todo.append(("end", end, shown, pre, inside))
        closed = tag == "details" and "open" not in item.attrs
        for child in reversed(item.children):
            if isinstance(child, str):
                if not closed:
                    todo.append(("text", child, shown, pre, inside))
            elif not _hidden(child, closed):
                if inside == "math" and tag in _APART_IN_MATH:
                    todo.append(("text", " ", shown, pre, inside))
                todo.append(("node", child, shown, pre, inside))
    lines.block()
    while lines.done and not lines.done[-1]:
        lines.done.pop()
    return lines.done


def _not_drawn(node: Node, inside: str) -> bool:
    """Whether an element of SVG or MathML is left out of the drawing or formula."""
    if inside == "math":
        return node.tag in _ANNOTATIONS
    return node.tag in _NOT_DRAWN and bool(inside) or node.attrs.get("display", "").strip().lower() == "none"


def _foreign_inside(node: Node, inside: str) -> tuple[str, bool]:
    """Where the content of an element of SVG or MathML is, and whether it stands apart from its neighbours."""
    tag, attrs = node.tag, node.attrs
    if tag in _FOREIGN:
        return tag, tag == "svg" or attrs.get("display", "").lower() == "block"
    if tag == "foreignobject" and inside != "math":
        return "", True
    if tag == "text" and inside == "svg":
        return "text", True
    if inside == "text":  # a part with a place of its own
        return inside, "x" in attrs or "y" in attrs or "dy" in attrs
    return inside, inside == "math" and tag in _APART_IN_MATH


def _number(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None and len(text) < 10 else default
    except ValueError:
        return default


def _mark(lists: list[list], item: Node) -> str:
    if not lists or lists[-1][0] != "ol":
        return "- "
    number = _number(item.attrs.get("value"), lists[-1][1])
    lists[-1][1] = number + 1
    return f"{number}. "


def _rows(table: Node) -> Iterator[Node]:
    """Captions and rows, those of row groups included, head first and foot last."""
    parts = [c for c in table.children if isinstance(c, Node) and not _hidden(c, False)]
    order = {"caption": 0, "thead": 1, "tfoot": 3}
    for part in sorted(parts, key=lambda p: order.get(p.tag, 2)):
        if part.tag in _ROW_GROUPS:
            yield from (r for r in part.children if isinstance(r, Node) and not _hidden(r, False))
        else:
            yield part


def _table(table: Node, shown: bool, depth: int) -> list[str]:
    """Rows with the columns under each other; a cell may have several lines."""
    grid: list[list[list[str]] | list[str]] = []
    spans: dict[int, int] = {}  # column: rows that a cell above still covers
    # Text that is in no row stands before the table, wherever it was.
    loose = []
    for part in table.children:
        within = part.children if isinstance(part, Node) and part.tag in _ROW_GROUPS else [part]
        loose += [c for c in within if isinstance(c, str) and c.strip()]
    before = render(_wrapped(loose, shown), depth) if loose else []
    for row in _rows(table):
        if row.tag != "tr":
            before_row = render(_wrapped([row], shown), depth)
            if row.tag == "caption" or not grid:
                before += before_row
            else:
                grid.append([before_row])
            continue
        cells: list[list[str]] = []
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip() or isinstance(cell, Node) and _hidden(cell, False):
                continue
            while spans.get(len(cells), 0) > 0:
                spans[len(cells)] -= 1
                cells.append([])
            attrs = cell.attrs if isinstance(cell, Node) else {}
            column = len(cells)
            cells.append(render(_wrapped([cell], shown), depth))
            wide = max(1, min(_number(attrs.get("colspan"), 1), 100))
            cells += [[] for _ in range(wide - 1)]
            tall = max(1, min(_number(attrs.get("rowspan"), 1), 1000))
            for c in range(column, column + wide):
                spans[c] = tall - 1
        while spans.get(len(cells), 0) > 0:
            spans[len(cells)] -= 1
            cells.append([])
        grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        for i, cell in enumerate(cells[:-1] if len(cells) > 1 else []):
            widths += [0] * (i + 1 - len(widths))
            widths[i] = max(widths[i], min(WIDEST, max(map(len, cell), default=0)))
    lines = list(before)
    for cells in grid:
        for n in range(max(map(len, cells), default=0)):
            row = [cell[n] if n < len(cell) else "" for cell in cells]
            padded = [text.ljust(widths[i]) if i < len(row) - 1 else text for i, text in enumerate(row)]
            lines.append("  ".join(padded).rstrip(" "))
    return lines


def _wrapped(children: list, shown: bool) -> Node:
    node = Node("div", {} if shown else {"style": "visibility:hidden"})
    node.children = [_as_block(c) for c in children]
    return node


def _as_block(child):
    """A cell stands by itself inside its own rendering."""
    if isinstance(child, str) or child.tag not in _CELLS:
        return child
    node = Node("div", child.attrs)
    node.children = child.children
    return node


def visible_text(page: str) -> str:
    return "\n".join(render(parse(page)))


def rendered(page: Column) -> Column:
    """The visible text of every whole page; null counts as empty and has none."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([visible_text(p) for p in texts_of(column)], dtype=object)

    return text(page)


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``page_id, text`` of every row; repeated rows and null ids stay, other columns are not looked at."""
    prepare_workers(pages.sparkSession, 256)
    return pages.select(F.col(id_column).alias("page_id"), rendered(F.col(html_column)).alias("text"))
