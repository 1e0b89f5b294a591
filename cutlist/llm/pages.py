"""Visible text of HTML pages, laid out as a reader would see it.

A tree builder supplies the tags that HTML lets authors leave out, visibility rules decide what shows, and a renderer
writes blocks on lines of their own, with a blank line around paragraphs, headings, lists and tables; list items
behind their markers; and the cells of a table in aligned columns. All visible text is kept, navigation included.

Hidden are: elements that never show, the ``hidden`` attribute, closed ``details`` and ``dialog``, and what inline styles or
simple style-sheet rules (a tag, a class or an id) give ``display:none`` or ``visibility:hidden``; a descendant made visible
again shows. Rules count as on a screen of ``SCREEN`` pixels: those in at-rules or sheets for other media do not, and of
those that meet an element the important, the more specific and then the last one holds. Conditions other than on width and
height are taken as not met. ``noscript`` does not show, as in a browser that runs scripts.

Each page is one row and is rendered in its task; nothing is shuffled. Elements nested deeper than ``DEPTH`` join
their ancestor at that depth, as in browsers, so that no page exhausts the stack.

Defined cases: null html has null text, an empty page has empty text. Malformed html is repaired, never refused. Rows
with equal ids are separate rows; columns of other names pass through, one named like the added column is replaced.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, quoted, restored

DEPTH = 200
#: Columns of a table beyond this many are written without alignment.
GRID = 200
#: A cell spans at most this many columns, as in HTML.
SPAN = 1000
#: Width and height by which media conditions are decided.
SCREEN = {"width": 1280, "height": 800}

# Roles of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset(
    "head title meta link base style script template noscript noframes iframe object embed audio video canvas datalist "
    "map area param source track col colgroup".split()
)
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html "
    "legend li main nav optgroup option search section summary caption".split()
)
CLOSES_P = BLOCKS - frozenset("body html option optgroup caption legend".split())
#: An opening tag ends these elements, if open, up to the nearest of the limits.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption"), ("tbody", "thead", "tfoot", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
}
#: An end tag or an implied end does not reach beyond these.
WALLS = frozenset("html table td th caption template".split())
_COMMENT_OR_STRING = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_SIMPLE = re.compile(r"[.#]?[A-Za-z][\w-]*")
_FEATURE = re.compile(r"\(\s*(?:(min|max)-)?(width|height)\s*:\s*([0-9]*\.?[0-9]+)\s*(px|em|rem)\s*\)")
_VALUES = {"display": re.compile(r"[a-z][a-z -]*"), "visibility": re.compile("hidden|collapse|visible")}
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """A tree with html, body and table sections in place; ``styles`` holds the style elements and their texts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]
        self.body: Node | None = None
        self.styles: list[tuple[Node, list[str]]] = []

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        # Beyond the depth an element is kept without nesting: what follows joins its ancestor.
        if len(self.stack) < DEPTH:
            self.stack.append(node)

    def _into_body(self) -> None:
        if self.body is None:
            self.body = Node("body", {})
            self.root.children.append(self.body)
            del self.stack[1:]
            self.stack.append(self.body)

    def _end(self, tags: Sequence[str], limits: Sequence[str]) -> None:
        """Close the innermost of ``tags`` and what is open inside it, unless a limit comes first."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in limits:
                return

    def _imply(self, tag: str) -> None:
        """Open what a table part needs around it."""
        top = self.stack[-1].tag
        if tag == "tr" and top == "table":
            self._push(Node("tbody", {}))
        elif tag in ("td", "th"):
            if top == "table":
                self._push(Node("tbody", {}))
            if self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self._push(Node("tr", {}))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._into_body()
                self.body.attrs = {**found, **self.body.attrs}
            return
        if self.body is None and tag not in HEAD_ONLY:
            self._into_body()
        if tag in CLOSES_P:
            self._end(("p",), WALLS)
        if tag in ENDS:
            ends, limits = ENDS[tag]
            # Sections and rows also end the cells and rows open inside the same table.
            for inner in (("td", "th"), ("tr",)) if tag in ("tr", "tbody", "thead", "tfoot") else ():
                self._end(inner, ("table",))
            self._end(ends, limits)
        self._imply(tag)
        if tag in VOID:
            self.stack[-1].children.append(Node(tag, found))
        else:
            self._push(Node(tag, found))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not any(n.tag == "p" for n in self.stack):
            self.handle_starttag("p", [])
            self._end(("p",), ())
        elif tag not in ("html", "body", "head"):
            self._end((tag,), ("table",) if tag not in ("table",) else ())

    @property
    def sheets(self) -> list[str]:
        """The style sheets that hold on a screen."""
        return ["".join(parts) for node, parts in self.styles if on_screen(node.attrs.get("media", ""))]

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "style":
            if not self.styles or self.styles[-1][0] is not self.stack[-1]:
                self.styles.append((self.stack[-1], []))
            self.styles[-1][1].append(data)
        if self.body is None and self.stack[-1] is self.root:
            if not data.strip():
                return
            self._into_body()
        self.stack[-1].children.append(data)


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on the screen."""

    def holds(condition: str) -> bool:
        if condition in ("all", "screen"):
            return True
        feature = _FEATURE.fullmatch(condition)
        if not feature:
            return False
        bound, side, size, unit = feature.groups()
        pixels = float(size) * (1 if unit == "px" else 16)
        return {"min": SCREEN[side] >= pixels, "max": SCREEN[side] <= pixels, None: SCREEN[side] == pixels}[bound]

    def query(text: str) -> bool:
        negated, text = text.startswith("not "), re.sub(r"^(?:only|not)\s+", "", text)
        return all(holds(part.strip()) for part in re.split(r"\sand\s", text)) != negated

    return not media.strip() or any(query(" ".join(q.lower().split())) for q in media.split(","))


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """What a list of declarations says last on display and visibility: whether important, and the value."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in body.split(";"):
        name, _, value = declaration.partition(":")
        name = name.strip().lower()
        if name in _VALUES:
            value, mark, important = (x.strip() for x in value.lower().partition("!"))
            if _VALUES[name].fullmatch(value) and important == ("important" if mark else "") and not (not mark and name in found and found[name][0]):
                found[name] = (bool(mark), value)
    return found


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, without those nested in other rules."""
    sheet = _COMMENT_OR_STRING.sub(lambda m: "''" if m[0][0] in "\"'" else " ", sheet)
    # Of each open block: whether its rules hold, its selectors (None for an at-rule's) and its declarations so far.
    open_: list[tuple[bool, str | None, list[str]]] = []
    done = 0
    for mark in re.finditer(r"[{};]", sheet):
        part, done = sheet[done : mark.start()].strip(), mark.end()
        if mark[0] == "{":
            holds, selectors, _ = open_[-1] if open_ else (True, None, [])
            name, _, condition = part.partition(" ") if " " in part else (part.partition("(")[0], "", part[part.find("(") :])
            name = name.lower()
            if name.startswith("@"):
                other = name in ("@layer", "@supports") and not condition.strip().lower().startswith("not")
                holds = holds and selectors is None and (on_screen(condition) if name == "@media" else other)
                open_.append((holds, None, []))
            else:
                open_.append((holds and selectors is None, part, []))
        elif not open_:
            continue  # a statement, or a brace too many
        else:
            open_[-1][2].append(part)
            if mark[0] == "}":
                holds, selectors, body = open_.pop()
                if holds and selectors is not None:
                    yield selectors, ";".join(body)
    # The end of a sheet closes what is open.
    if open_ and open_[-1][0] and open_[-1][1] is not None:
        yield open_[-1][1], ";".join([*open_[-1][2], sheet[done:]])


class Rules:
    """What simple style-sheet rules say about display and visibility, by tag, .class and #id."""

    def __init__(self, sheets: Sequence[str]):
        #: By property and selector: whether important, how specific, place in the sheets, and the value.
        self.said: dict[str, dict[str, tuple[bool, int, int, str]]] = {name: {} for name in _VALUES}
        place = 0
        for sheet in sheets:
            for selectors, body in style_rules(sheet):
                for name, (important, value) in declared(body).items():
                    for selector in map(str.strip, selectors.split(",")):
                        if _SIMPLE.fullmatch(selector):
                            place += 1
                            # Names of elements are in lower case; those of classes and ids are as they are written.
                            selector = selector if selector[0] in ".#" else selector.lower()
                            new = (important, ".#".find(selector[0]), place, value)
                            self.said[name][selector] = max(new, self.said[name].get(selector, new))

    def names(self, node: Node) -> list[str]:
        return [node.tag, *("." + c for c in node.attrs.get("class", "").split()), "#" + node.attrs.get("id", "")]

    def value(self, node: Node, name: str) -> str | None:
        """What holds for a node by its own style and the sheets; None where nothing is said."""
        said, style = self.said[name], node.attrs.get("style", "")
        found = [said[n] for n in self.names(node) if n in said] if said else []
        if style and name in (own := declared(_COMMENT_OR_STRING.sub(" ", style))):
            found.append((own[name][0], 2, 0, own[name][1]))
        return max(found)[3] if found else None

    def gone(self, node: Node) -> bool:
        """Not displayed, with everything inside."""
        if node.tag in NEVER_SHOWN:
            return True
        display = self.value(node, "display")
        if display is not None and not display.startswith("revert"):
            return display == "none"
        return "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs

    def visible(self, node: Node, inherited: bool) -> bool:
        said = self.value(node, "visibility")
        return inherited if said is None else said == "visible"


class Flow:
    """Lines of one block context: words with single blanks, line breaks and blank lines between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank is due before the next word
        self.gap = 0  # line breaks due before the next text

    def text(self, data: str, kept: bool = False) -> None:
        if kept:
            for n, part in enumerate(data.replace("\r\n", "\n").split("\n")):
                if n:
                    self.newline()
                if part:
                    self._write(part)
            return
        words = _BLANKS.split(data)
        for n, word in enumerate(words):
            if n:
                self.blank = True
            if word:
                self._write(" " + word if self.blank and self.line else word)

    def _write(self, part: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.line.append(part)
        self.blank = False

    def newline(self) -> None:
        """A line break as such: an empty line stays."""
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.blank = [], False

    def block(self, gap: int = 1) -> None:
        """End the line; at least ``gap`` line breaks stand before what follows."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.blank = False
        self.gap = max(self.gap, gap)

    def insert(self, lines: Sequence[str], gap: int = 1) -> None:
        self.block(gap)
        if lines:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.lines += lines
            self.block(gap)

    def done(self) -> list[str]:
        self.block()
        return self.lines


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


class Renderer:
    def __init__(self, rules: Rules):
        self.rules = rules

    def lines(self, node: Node, shown: bool, kept: bool = False) -> list[str]:
        flow = Flow()
        self.children(node, flow, shown, kept)
        return flow.done()

    def children(self, node: Node, flow: Flow, shown: bool, kept: bool) -> None:
        closed = node.tag == "details" and "open" not in node.attrs
        summary = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None)
        for child in node.children:
            if closed and child is not summary:
                continue
            if isinstance(child, str):
                if shown:
                    flow.text(child, kept)
            elif not self.rules.gone(child):
                self.element(child, flow, self.rules.visible(child, shown), kept)

    def element(self, node: Node, flow: Flow, shown: bool, kept: bool) -> None:
        tag = node.tag
        if tag == "br":
            flow.newline()
        elif tag == "hr":
            flow.block(2)
        elif tag == "img" or tag == "input":
            label = "value" if node.attrs.get("type", "").lower() in ("submit", "reset", "button") else "alt"
            if shown and node.attrs.get("type", "").lower() != "hidden" and node.attrs.get(label):
                flow.text(node.attrs[label])
        elif tag in ("ul", "ol", "menu", "dir"):
            self.items(node, flow, shown, kept)
        elif tag == "table":
            flow.insert(self.table(node, shown, kept), 2)
        elif tag == "pre":
            lines = self.lines(node, shown, True)
            flow.insert(lines[1:] if lines and not lines[0] else lines, 2)
        elif tag == "blockquote":
            flow.insert(["  " + x if x else x for x in self.lines(node, shown, kept)], 2)
        elif tag == "dd":
            flow.insert(["  " + x if x else x for x in self.lines(node, shown, kept)])
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            flow.block(gap)
            self.children(node, flow, shown, kept)
            flow.block(gap)
        else:
            self.children(node, flow, shown, kept)

    def items(self, node: Node, flow: Flow, shown: bool, kept: bool) -> None:
        """Items behind their markers, further lines and nested lists indented by the marker's width."""
        digits = re.fullmatch(r"\s*(-?\d{1,9})\s*", node.attrs.get("start", ""))
        number, inner = int(digits[1]) if digits else 1, Flow()
        for child in node.children:
            if isinstance(child, str):
                if shown and child.strip():
                    inner.text(child, kept)
                continue
            if self.rules.gone(child):
                continue
            seen = self.rules.visible(child, shown)
            if child.tag != "li":
                self.element(child, inner, seen, kept)
                continue
            own = re.fullmatch(r"\s*(-?\d{1,9})\s*", child.attrs.get("value", ""))
            number = int(own[1]) if own else number
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = self.lines(child, seen, kept)
            while lines and not lines[0]:
                lines.pop(0)
            if lines or (seen and node.tag == "ol"):
                indent = " " * len(marker)
                inner.insert([(marker + (lines[0] if lines else "")).rstrip(), *(indent + x if x else x for x in lines[1:])])
        # A nested list follows its item's text directly.
        flow.insert(inner.done(), 1 if flow.line or flow.lines and flow.gap == 0 else 2)

    def rows(self, node: Node, shown: bool) -> Iterator[tuple[Node, bool]]:
        for child in node.children:
            if isinstance(child, Node) and not self.rules.gone(child):
                seen = self.rules.visible(child, shown)
                if child.tag == "tr":
                    yield child, seen
                elif child.tag in ("tbody", "thead", "tfoot"):
                    yield from self.rows(child, seen)

    def strays(self, node: Node, flow: Flow, shown: bool, kept: bool) -> None:
        """What stands in a table or its sections outside of rows."""
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    flow.text(child, kept)
            elif child.tag != "tr" and not self.rules.gone(child):
                seen = self.rules.visible(child, shown)
                if child.tag in ("tbody", "thead", "tfoot"):
                    self.strays(child, flow, seen, kept)
                else:
                    self.element(child, flow, seen, kept)

    def table(self, node: Node, shown: bool, kept: bool) -> list[str]:
        """Captions and stray content first, then rows whose columns start at equal places."""
        flow = Flow()
        self.strays(node, flow, shown, kept)
        grid: list[list[tuple[int, int, list[str], bool]]] = []  # column, span, lines, right-aligned
        taken: dict[int, int] = {}  # columns that a cell above still covers
        for row, seen in self.rows(node, shown):
            at, cells = 0, []
            for cell in row.children:
                if not isinstance(cell, Node) or self.rules.gone(cell):
                    if isinstance(cell, str) and seen and cell.strip():
                        flow.text(cell, kept)
                    continue
                while taken.get(at, 0):
                    at += 1
                span, down = (int(v) if (v := cell.attrs.get(k, "1").strip()).isdecimal() and 0 < int(v[:4]) else 1 for k in ("colspan", "rowspan"))
                span, down = min(span, SPAN), min(down, 1 << 16)
                right = "right" in (cell.attrs.get("align", "") + cell.attrs.get("style", "")).lower()
                cells.append((at, span, self.lines(cell, self.rules.visible(cell, seen), kept), right))
                for c in range(at, at + span):
                    taken[c] = down
                at += span
            grid.append(cells)
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
        widths: dict[int, int] = {}
        for cells in grid:
            for at, span, lines, _ in cells:
                if span == 1:
                    widths[at] = max([widths.get(at, 0), *map(width, lines)])
        for cells in grid:  # a wide spanning cell widens its last column
            for at, span, lines, _ in cells:
                if span > 1:
                    room = sum(widths.get(c, 0) + 2 for c in range(at, at + span)) - 2
                    last = at + span - 1
                    widths[last] = widths.get(last, 0) + max(0, max(map(width, lines), default=0) - room)
        columns = sorted(c for c in widths if widths[c])
        starts, place = {}, 0
        for c in columns:
            starts[c] = place
            place += widths[c] + 2
        out = flow.done()
        for cells in grid:
            for n in range(max((len(lines) for _, _, lines, _ in cells), default=0)):
                line, used = [], 0
                for at, span, lines, right in cells:
                    part = lines[n] if n < len(lines) else ""
                    if not part:
                        continue
                    start = next((starts[c] for c in range(at, at + span) if c in starts), used)
                    if right and span == 1:
                        start += widths[at] - width(part)
                    gap = max(start - used, 2 if line else 0)
                    line.append(" " * (gap if len(columns) <= GRID else 2 if line else 0) + part)
                    used += gap + width(part)
                out.append("".join(line))
        return out


def render(html: str) -> str:
    """The visible text of one page."""
    builder = Builder()
    builder.feed(html.replace("\x00", ""))
    builder.close()
    if builder.body is None:
        return ""
    renderer = Renderer(Rules(builder.sheets))
    if renderer.rules.gone(builder.body):
        return ""
    lines = renderer.lines(builder.body, renderer.rules.visible(builder.body, True))
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, html: str = "html", to: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``pages`` with the visible text of ``html``."""
    columns = kept(pages, keep, [to])
    inner = pages.select(*carried(columns), quoted(html).alias("_html"))
    schema = T.StructType(inner.drop("_html").schema.fields).add("_text", "string")
    arrow, at = to_arrow_schema(schema), len(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.as_py() is None else render(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], schema=arrow)

    return inner.mapInArrow(task, schema).select(*restored(columns), F.col("_text").alias(to))
