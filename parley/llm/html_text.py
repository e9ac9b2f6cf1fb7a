"""Operator 10, HTML to text by layout-aware rendering.

A tag scanner feeds a tree builder that supplies implied tags (a paragraph ends at the next block, a list item at the next
item, a cell at the next cell or row, and so on). What the visibility rules leave is laid out: blocks stand apart, list
items carry marks and indents, preformatted text keeps its spaces, and the cells of a table are aligned in columns.

Visibility follows the page's style elements, wherever they stand, and style attributes (``styles``): rules for screens, later
ones and those of more specific selectors win, display and visibility are set both ways. Nothing of an element without
display shows; of a hidden one what is visible again does.

Defined results: a null or empty page has empty text and title; broken or unclosed tags are closed at the end; a lone "<"
is text; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import steps
from .styles import Element, Sheet

TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
# Element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption td th".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure article section".split())
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption li dd dt".split())
#: What an svg element holds that isn't drawn.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
SPAN = re.compile(r"\b(col|row)span\s*=\s*[\"']?\s*(\d{1,4})", re.I)
#: A start tag closes these open elements, but not beyond the given ones.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: What a head may hold; any other tag, or text, ends a head whose end tag is left out.
IN_HEAD = frozenset("title meta link base style script noscript template head".split())
SCOPES = frozenset(["table", "td", "th", "caption", "html", "body"])


def columns(text: str) -> int:
    """How many columns a line takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Text of one block container: lines, with white space folded and blank lines between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.prefix = ""

    def add(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.parts.append(first)
            for line in rest:
                self.end_line(True)
                self.parts.append(line)
        else:
            self.parts.append(SPACE.sub(" ", text))

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.parts)
        self.parts = []
        if not keep:
            line = re.sub(" {2,}", " ", line).strip(" ")
        else:
            line = line.rstrip()
        if not line and not keep:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(self.prefix + line)
        self.prefix = " " * (len(self.prefix) if self.prefix.strip() == "" else 0)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


class Page:
    """Builds and lays out one page."""

    def __init__(self) -> None:
        #: Open elements: (name, without display, what it opened, whether its text is hidden, itself for selectors).
        self.open: list[tuple[str, bool, str, bool, Element | None]] = []
        self.sheet = Sheet()
        #: How many of each name are open, so that most searches among the open elements needn't begin.
        self.names: Counter[str] = Counter()
        self.flows = [Flow()]
        #: Rows of cells: (text, columns, rows).
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.spans: list[tuple[int, int]] = []
        self.lists: list[list] = []
        self.pre = 0
        self.hidden = 0
        self.title = ""

    def _end_head(self) -> None:
        while self.open and self.open[-1][0] == "head":
            self._pop()

    def start(self, name: str, attributes: str) -> None:
        if name not in IN_HEAD:
            self._end_head()
        if name in ENDS_P:
            self._close_to(frozenset(["p"]), SCOPES)
        if name in IMPLIED:
            closed, until = IMPLIED[name]
            while self._close_to(closed, until):
                pass
        if name in ("td", "th") and self.tables and not any(x[0] == "tr" for x in self._since("table")):
            self.start("tr", "")
        if name == "br":
            if not self.hidden:
                self.flows[-1].end_line(self.pre > 0 or not self.flows[-1].parts)
            return
        if name in BLOCKS:
            self._break(name)
        if name == "hr" and not self.hidden and not any(self._look(name, attributes)[:2]):
            self.flows[-1].parts.append("---")
            self._break("hr")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            return
        hidden, unseen, element = self._look(name, attributes)
        opened = ""
        self.hidden += hidden
        if not self.hidden:
            opened = self._open(name, attributes)
            if name == "text" and self.names["svg"]:
                self.flows[-1].end_line()
        self.open.append((name, hidden, opened, unseen, element))
        self.names[name] += 1

    def _look(self, name: str, attributes: str) -> tuple[bool, bool, Element | None]:
        """(whether the element is without display, whether its text is hidden, the element where there are rules)."""
        unseen = bool(self.open) and self.open[-1][3]
        if not attributes and not self.sheet.rules:
            return name == "head" or name in UNDRAWN and self.names["svg"] > 0, unseen, None
        given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(attributes)))}
        element = Element(name, given, next((x[4] for x in reversed(self.open) if x[4]), None)) if self.sheet.rules else None
        display, visibility = self.sheet.look(element, given)
        if display is None:
            display = "hidden" not in given or given["hidden"].lower() == "until-found"
        undrawn = name == "head" or name in UNDRAWN and self.names["svg"] > 0
        return undrawn or not display, unseen if visibility is None else not visibility, element

    def _since(self, name: str) -> Iterator[tuple]:
        for x in reversed(self.open):
            if x[0] == name:
                return
            yield x

    def _open(self, name: str, attributes: str) -> str:
        if name == "pre":
            self.pre += 1
            return "pre"
        if name in ("ul", "ol", "menu", "dir"):
            start = re.search(r"\bstart\s*=\s*[\"']?(\d+)", attributes) if name == "ol" else None
            self.lists.append([name == "ol", int(start[1]) if start and len(start[1]) < 9 else 1])
            return "list"
        if name == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "- "
            if self.lists and self.lists[-1][0]:
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            self.flows[-1].prefix = "  " * depth + mark
            return "item"
        if name == "table":
            self.tables.append([])
            return "table"
        if name == "tr" and self.tables:
            self.tables[-1].append([])
            return ""
        if name in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.flows.append(Flow())
            wide = {k.lower(): max(1, int(n)) for k, n in SPAN.findall(attributes)}
            self.spans.append((min(wide.get("col", 1), 1000), wide.get("row", 1)))
            return "cell"
        if name == "dd":
            self.flows[-1].prefix = "    "
            return "item"
        return ""

    def _break(self, name: str) -> None:
        if self.hidden:
            return
        flow = self.flows[-1]
        flow.end_line()
        if name in APART and not self.lists:
            flow.gap = True

    def end(self, name: str) -> None:
        if name == "p" and not self.names["p"]:
            self._break("p")
            return
        if name == "br":
            self.start("br", "")
            return
        if not self.names[name]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def _close_to(self, names: frozenset, until: frozenset) -> bool:
        """Closes up to the nearest open element of ``names`` that no element of ``until`` hides."""
        if not any(self.names[n] for n in names):
            return False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                while len(self.open) > i:
                    self._pop()
                return True
            if self.open[i][0] in until:
                return False
        return False

    def _pop(self) -> None:
        name, hidden, opened, *_ = self.open.pop()
        self.names[name] -= 1
        if not self.hidden and name in BLOCKS and opened not in ("cell", "table"):
            if opened == "pre":
                self.flows[-1].end_line(bool("".join(self.flows[-1].parts).strip()))
            self._break(name)
        if not self.hidden and name == "text" and self.names["svg"]:
            self.flows[-1].end_line()
        if opened == "pre":
            self.pre -= 1
        elif opened == "list":
            self.lists.pop()
            if not self.lists:
                self.flows[-1].gap = True
        elif opened == "item":
            self.flows[-1].end_line()
            self.flows[-1].prefix = ""
        elif opened == "cell":
            text = self.flows.pop().text()
            self.tables[-1][-1].append((text, *self.spans.pop()))
        elif opened == "table":
            self._lay_table(self.tables.pop())
        self.hidden -= hidden

    @staticmethod
    def _placed(rows: list[list[tuple[str, int, int]]]) -> list[dict[int, tuple[list[str], int]]]:
        """Of each row: column to (lines, column behind it) of the cells that begin there; columns where none begins are left out."""
        taken: dict[int, int] = {}  # column: how many more rows a cell above takes there
        grid = []
        for r in rows:
            line, at = {}, 0
            now = {c for c, n in taken.items() if n}
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            for text, wide, tall in r:
                while at in now:
                    at += 1
                line[at] = (text.split("\n"), at + wide)
                if tall > 1:
                    taken |= dict.fromkeys(range(at, at + wide), tall - 1)
                at += wide
            grid.append(line)
        begins = sorted({c for line in grid for c in line})
        number = {c: i for i, c in enumerate(begins)}
        behind = lambda end: sum(1 for c in begins if c < end) if end not in number else number[end]
        return [{number[c]: (lines, behind(end)) for c, (lines, end) in line.items()} for line in grid]

    def _lay_table(self, rows: list[list[tuple[str, int, int]]]) -> None:
        rows = [r for r in rows if any(c[0] for c in r)]
        flow = self.flows[-1]
        flow.end_line()
        flow.gap = flow.gap or not self.lists
        grid = self._placed(rows)
        width = [0] * max((end for line in grid for _, end in line.values()), default=0)
        cells = [(end - at, at, end, max(map(columns, lines))) for line in grid for at, (lines, end) in line.items()]
        for _, at, end, need in sorted(cells):  # cells of one column first; a wider one widens its last
            width[end - 1] = max(width[end - 1], need - sum(width[at : end - 1]) - 3 * (end - 1 - at))
        for line in grid:
            last = max((end for _, end in line.values()), default=0)
            for k in range(max((len(lines) for lines, _ in line.values()), default=0)):
                shown, at = [], 0
                while at < last:
                    lines, end = line.get(at, ([], at + 1))
                    text = lines[k] if k < len(lines) else ""
                    shown.append(text + " " * (sum(width[at:end]) + 3 * (end - 1 - at) - columns(text)))
                    at = end
                flow.parts.append(" | ".join(shown))
                flow.end_line(True)
        flow.gap = not self.lists

    def text(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._end_head()
        if not self.hidden and data and not (self.open and self.open[-1][3]):
            self.flows[-1].add(html.unescape(data) if "&" in data else data, self.pre > 0)

    def render(self, source: str) -> str:
        at = 0
        self.sheet.read_page(source)
        while m := TAG.search(source, at):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if slash:
                self.end(name)
                continue
            if name in RAW:
                if name not in IN_HEAD:
                    self._end_head()
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                body = source[at : close.start()] if close else source[at:]
                at = close.end() if close else len(source)
                if name == "title" and not self.title and not self.names["svg"]:
                    self.title = SPACE.sub(" ", html.unescape(body)).strip()
                elif name == "textarea" and not any(self._look(name, attributes)[:2]):
                    self.text(body)
                continue
            self.start(name, attributes)
        self.text(source[at:])
        while self.open:
            self._pop()
        return self.flows[0].text()


def render(source: str) -> tuple[str, str]:
    """(title, visible text) of a page."""
    page = Page()
    text = page.render(source)
    return page.title, text


def extract(pages: DataFrame, kept: list[str] = ()) -> DataFrame:
    """Per row of ``pages``: page_id, url, title, text, and the columns ``kept``."""
    carried = ["page_id", "url", *kept]
    rows = pages.select(*carried, "html")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in steps(batches, "html"):
            made = [render(x.decode("utf-8", "replace")) for x in sources]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t for t, _ in made], pa.string()), pa.array([x for _, x in made], pa.string()), *batch.columns[2:-1]], ["page_id", "url", "title", "text", *kept])

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields[:2], T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), *rows.schema.fields[2:-1]]))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages)
