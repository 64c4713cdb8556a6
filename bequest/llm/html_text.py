"""HTML extraction: a page's visible text as it would be laid out."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names with a role in parsing or layout, as in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template title noembed noframes iframe object video audio canvas datalist meta link base rp".split()
)
# In formulas and drawings: what is never shown, what holds HTML again, and HTML that ends them.
FOREIGN_UNSEEN = frozenset(
    "defs desc metadata symbol clippath mask pattern marker filter lineargradient radialgradient annotation annotation-xml mphantom".split()
)
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol "
    "p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table ul tr caption thead tbody tfoot".split()
)
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol ul menu dir pre table hr fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
# A start tag closes these open elements, unless one of the second group lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption button object html template".split())
HEADLINE = frozenset("base link meta script style title noscript template".split())

_SPLIT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# What the properties that hide an element may be; other values do not count.
_VALUES = {
    "display": frozenset(
        "none block inline inline-block flow-root flex inline-flex grid inline-grid list-item contents table inline-table "
        "table-row table-cell table-caption table-row-group table-header-group table-footer-group table-column "
        "table-column-group ruby initial inherit unset revert".split()
    ),
    "visibility": frozenset("visible hidden collapse initial inherit unset revert".split()),
}
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_DECLARED = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children", "parent", "foreign")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []
        inside = parent is not None and parent.foreign and parent.name not in HOLDS_HTML
        self.foreign = inside or name in ("svg", "math")


class TreeBuilder:
    """A tree from tags: implied tags are added, missing end tags closed, stray ones left out."""

    def __init__(self, page: str) -> None:
        self.root = Node("#root", {}, None)
        self.at = self.root
        place = 0
        while place < len(page):
            m = _SPLIT.search(page, place)
            if not m:
                break
            if m.start() > place:
                self.text(page[place : m.start()])
            place = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.close(name)
                continue
            attributes = {}
            if m[3] and not m[3].isspace():
                for a in _ATTRIBUTE.finditer(m[3]):
                    value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                    attributes.setdefault(a[1].lower(), html.unescape(value))
            node = self.open(name, attributes)
            if node.foreign and m[3].endswith("/"):
                self.at = node.parent
            elif name in RAW:
                low = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, place)
                end = low.start() if low else len(page)
                raw = page[place:end]
                node.children.append(html.unescape(raw) if name in ("textarea", "title") else raw)
                after = page.find(">", end)
                place = len(page) if after < 0 else after + 1
                self.at = node.parent or self.root
        if place < len(page):
            self.text(page[place:])

    def text(self, raw: str) -> None:
        if self.at.name in ("table", "tbody", "thead", "tfoot", "tr", "colgroup") and raw.isspace():
            return
        if self._names_up_to("head") and self.at.name == "head" and not raw.isspace():
            self.at = self.at.parent or self.root  # text ends a head that was not closed
        self.at.children.append(html.unescape(raw))

    def _names_up_to(self, name: str) -> bool:
        node = self.at
        while node is not None:
            if node.name == name:
                return True
            node = node.parent
        return False

    def _close_through(self, closing: set[str], stop: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of `closing` above which none of `stop` lies."""
        node, found = self.at, None
        while node.parent is not None and node.name not in stop:
            if node.name in closing:
                found = node
            node = node.parent
        if found is not None:
            self.at = found.parent

    def open(self, name: str, attributes: dict[str, str]) -> Node:
        if self.at.name == "head" and name not in HEADLINE and name != "head":
            self.at = self.at.parent
        if name in ENDS_FOREIGN:
            while self.at.foreign and self.at.name not in HOLDS_HTML:
                self.at = self.at.parent
        if name in CLOSES_P:
            self._close_through({"p"}, SCOPE | {"li", "dd", "dt", "div", "section", "article", "blockquote"} - {"p"})
        if name in IMPLIED:
            self._close_through(*IMPLIED[name])
        if name == "tr" and self.at.name == "table":
            self._push("tbody", {})
        elif name in ("td", "th") and self.at.name in ("table", "tbody", "thead", "tfoot"):
            if self.at.name == "table":
                self._push("tbody", {})
            self._push("tr", {})
        elif name == "a":
            self._close_through({"a"}, SCOPE)
        node = self._push(name, attributes)
        if name in VOID:
            self.at = node.parent
        return node

    def _push(self, name: str, attributes: dict[str, str]) -> Node:
        node = Node(name, attributes, self.at)
        self.at.children.append(node)
        self.at = node
        return node

    def close(self, name: str) -> None:
        if name == "br":
            self.open("br", {})
            return
        node = self.at
        scope = SCOPE - {name} if name in ("table", "td", "th", "caption", "button", "object", "template") else SCOPE
        if name in ("html", "body", "table"):
            scope = frozenset(("template",))
        elif name in ("tr", "tbody", "thead", "tfoot"):
            scope = frozenset(("table", "template"))
        while node.parent is not None and node.name != name:
            if node.name in scope:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent
        elif name == "p":
            self.open("p", {})
            self.at = self.at.parent


def declared(style: str) -> dict[str, str]:
    """display and visibility as a style attribute has them: the last valid value, important ones first."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", style).split(";"):
        m = _DECLARED.fullmatch(part)
        if m and m[2].lower() in _VALUES[m[1].lower()]:
            name, important = m[1].lower(), bool(m[3])
            if important >= found.get(name, (False, ""))[0]:
                found[name] = important, m[2].lower()
    return {name: value for name, (_, value) in found.items()}


def hidden(node: Node, style: dict[str, str]) -> bool:
    """Whether an element is left out with all it holds."""
    a = node.attributes
    return (
        node.name in UNSEEN
        or (node.foreign and node.name in FOREIGN_UNSEEN)
        or (node.name == "input" and a.get("type", "").lower() in ("hidden", "password", "checkbox", "radio", "file"))
        or style.get("display") == "none"
        or ("display" not in style and ("hidden" in a or (node.name == "dialog" and "open" not in a)))
    )


def _shown(style: dict[str, str], around: bool) -> bool:
    """Whether an element's own text is visible; what it does not say it has from around it."""
    value = style.get("visibility")
    return around if value in (None, "inherit", "unset", "revert") else value in ("visible", "initial")


def _held(node: Node) -> list[Node | str]:
    """An element's children, of a closed <details> its summary alone."""
    if node.name != "details" or "open" in node.attributes:
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]


class Flow:
    """Lines of one box: collapses space, keeps block spacing and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0  # empty lines wanted before the next text
        self.marker = ""
        self.indent: list[str] = [""]

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(raw.expandtabs(8).split("\n")):
                if i:
                    self.break_line()
                if part:
                    self._begin()
                    self.line += part
            return
        raw = _SPACE.sub(" ", raw)
        if not self.line or self.line.endswith(" "):
            raw = raw.lstrip(" ")
        if raw:
            if not self.line and raw == " ":
                return
            self._begin()
            self.line += raw

    def _begin(self) -> None:
        if not self.line:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
            self.line = self.indent[-1][: len(self.indent[-1]) - len(self.marker)] + self.marker
            self.marker = ""

    def break_line(self) -> None:
        """Ends the line; an empty one stays, as <br><br> shows."""
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        elif self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.line = ""

    def block(self, spaced: bool) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        self.line = ""
        if spaced:
            self.gap = 1

    def done(self) -> list[str]:
        self.block(False)
        lines = self.lines
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        return [x for i, x in enumerate(lines) if x or lines[i - 1]]


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []  # lines, columns and rows of each cell
        self.groups: set[int] = set()  # first rows of row groups
        self.caption: list[str] = []

    def _placed(self) -> list[list[tuple[list[str], int]]]:
        """Lines and columns of each row's cells, empty ones where a cell of a row above still spans."""
        out, held = [], {}
        for n, row in enumerate(self.rows):
            if n in self.groups:
                held = {}
            at, cells, new = 0, [], {}
            for lines, span, deep in row:
                while at in held:
                    cells.append(([], 1))
                    at += 1
                cells.append((lines, span))
                if deep > 1:
                    new.update(dict.fromkeys(range(at, at + span), deep - 1))
                at += span
            held = {c: left - 1 for c, left in held.items() if left > 1} | new
            out.append(cells)
        return out

    def laid_out(self) -> list[str]:
        """Rows with their cells' lines side by side, columns as wide as their widest cell."""
        rows = self._placed()
        columns = max((sum(span for _, span in row) for row in rows), default=0)
        widths = [0] * columns
        for row in rows:
            at = 0
            for lines, span in row:
                if span == 1:
                    widths[at] = max(widths[at], max(map(len, lines), default=0))
                at += span
        out = list(self.caption)
        for row in rows:
            for n in range(max((len(lines) for lines, _ in row), default=0)):
                at, parts = 0, []
                for lines, span in row:
                    room = sum(widths[at : at + span]) + 2 * (span - 1)
                    parts.append((lines[n] if n < len(lines) else "").ljust(room))
                    at += span
                out.append("  ".join(parts).rstrip())
        return out


# Elements that begin or end the text of a drawing, and those that stand apart from what is beside them.
_DRAWING = frozenset("svg text foreignobject".split())
_APART = frozenset("svg text foreignobject math mfrac mtd".split())


def rendered(page: str) -> str:
    """The visible text of a page: blocks apart, lists marked and indented, table cells aligned."""
    root = TreeBuilder(page).root
    flow, flows = Flow(), []
    tables: list[Table] = []
    lists: list[int | None] = []  # the next number, None for bullets
    pre = 0
    drawing: list[bool] = []  # whether text is not shown, as in a drawing outside its text elements
    shown = [True]  # whether the text of each open element is visible
    todo: list[tuple[Node | str, bool]] = [(c, True) for c in reversed(root.children)]
    while todo:
        node, entering = todo.pop()
        if isinstance(node, str):
            if shown[-1] and not (drawing and drawing[-1]):
                flow.text(node, pre > 0)
            continue
        name = node.name
        if entering:
            style = declared(node.attributes["style"]) if "style" in node.attributes else {}
            if hidden(node, style):
                continue
            visible = _shown(style, shown[-1])
            if name == "br":
                flow.break_line()
                continue
            if name == "img":
                if visible and node.attributes.get("alt", "").strip():
                    flow.text(node.attributes["alt"], False)
                continue
            if name == "input":
                if visible:
                    flow.text(f" {node.attributes.get('value', '')} ", False)
                continue
            if name in BLOCK and name not in ("tr", "thead", "tbody", "tfoot"):
                flow.block(name in SPACED and not (lists and name in ("ul", "ol", "menu", "dir", "p")))
            if name == "hr":
                continue
            if name == "pre":
                pre += 1
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
            elif name in ("ul", "menu", "dir"):
                lists.append(None)
            elif name == "ol":
                start = node.attributes.get("start", "1")
                lists.append(int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1)
            elif name == "li":
                marker = "- "
                if lists and lists[-1] is not None:
                    value = node.attributes.get("value", "")
                    if re.fullmatch(r"-?[0-9]{1,9}", value):
                        lists[-1] = int(value)
                    marker = f"{lists[-1]}. "
                    lists[-1] += 1
                depth = min(len(flow.indent), 32)
                flow.indent.append(flow.indent[-1] + " " * len(marker) if depth < 32 else flow.indent[-1])
                flow.marker = marker if depth < 32 and visible else ""
            elif name in ("blockquote", "dd"):
                flow.indent.append(flow.indent[-1] + "    " if len(flow.indent) < 32 else flow.indent[-1])
            elif name == "table":
                tables.append(Table())
            elif name in ("thead", "tbody", "tfoot") and tables:
                tables[-1].groups.add(len(tables[-1].rows))
            elif name == "tr" and tables:
                tables[-1].rows.append([])
            elif name in ("td", "th", "caption") and tables:
                flows.append((flow, lists, pre))
                flow, lists, pre = Flow(), [], 0
            if node.foreign and name in _DRAWING:
                drawing.append(name == "svg")
            if node.foreign and name in _APART:
                flow.text(" ", False)
            shown.append(visible)
            todo.append((node, False))
            todo.extend((c, True) for c in reversed(_held(node)))
            continue
        # leaving
        shown.pop()
        if node.foreign and name in _DRAWING:
            drawing.pop()
        if node.foreign and name in _APART:
            flow.text(" ", False)
        if name == "pre":
            pre -= 1
        elif name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif name in ("blockquote", "dd", "li") and len(flow.indent) > 1:
            flow.block(False)
            flow.indent.pop()
            flow.marker = ""
        elif name in ("td", "th", "caption") and tables and flows:
            lines = flow.done()
            flow, lists, pre = flows.pop()
            if name == "caption":
                tables[-1].caption += lines
            else:
                span, deep = node.attributes.get("colspan", "1"), node.attributes.get("rowspan", "1")
                # 0 rows are all that follow in the group
                rows = (int(deep) or 65534) if re.fullmatch("[0-9]{1,5}", deep) else 1
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                columns = min(max(int(span), 1), 1000) if re.fullmatch("[0-9]{1,4}", span) else 1
                tables[-1].rows[-1].append((lines, columns, min(rows, 65534)))
        elif name == "table" and tables:
            for line in tables.pop().laid_out():
                flow.block(False)
                flow.text(line, True)
            flow.block(False)
        if name in BLOCK and name not in ("tr", "thead", "tbody", "tfoot"):
            flow.block(name in SPACED and not (lists and name in ("ul", "ol", "menu", "dir", "p")))
    return "\n".join(flow.done())


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [rendered(page or "") for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in batch.schema.names if n != "html"), pa.array(texts, pa.string())],
            [*(n for n in batch.schema.names if n != "html"), "text"],
        )


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) of every page: all visible text, laid out.

    Null and empty pages have empty text; ids may be null or repeat; other columns are not read.
    Broken markup is taken as the HTML standard suggests.  An element that is not displayed, or never shown, is
    left out with all it holds; one that is invisible leaves out its own text, but not that of visible
    elements in it.  Of closed details only the summary is shown.
    """
    small_batches(pages.sparkSession)
    read = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return read.mapInArrow(_render, "id long, text string").withColumnRenamed("id", id_col)
