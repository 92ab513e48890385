"""Layout-aware HTML to text: everything a reader would see, laid out in lines.

A tree builder keeps the stack of open elements and supplies implied end tags (paragraphs before
blocks, list items, table rows and cells, options); end tags without an open element are ignored.
Invisible: ``head`` content except nothing, scripts, styles, templates, comments, hidden inputs, the
``hidden`` attribute, ``display:none`` and ``visibility:hidden``. Blocks begin lines; paragraphs,
headings, lists and tables are set off by one empty line. List items carry bullets or numbers,
indented by depth. Cells of a table begin where their column does, rows and columns that they span
included, whatever the table's size. A line of a cell that this would set off by more than ``GAP``
spaces, from the text before it or from the line's begin, is set off by two. ``pre`` keeps its spaces.
A tag that the page's end cuts off is text, with all behind it.

A null page gives null text; an empty one, empty text. Texts may be of any length and depth: time
and output are linear in the page but for a logarithm, and there is no recursion. Repeated rows and null ids each keep their row. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import in_batches, slices

# fixed values: element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template title noembed noframes iframe datalist object audio video canvas svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure hr".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
#: A start tag of the key closes these open elements, up to a boundary.
CLOSES = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Blocks that close an open paragraph.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "figcaption"} | {"hr"}
SCOPE = CELLS | {"table", "caption", "html", "button", "template", "object"}

#: Most spaces that set off a line of a cell: what bounds the output by the page, cell by cell.
GAP = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|[^>])*+)>", re.S)
#: What begins a tag: one that does not end reaches to the end of the page.
_OPENS = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDING = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none")
#: Unlike hiding, what an element inside can take back.
_VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of one flow of text: the page's or a cell's."""

    def __init__(self, indent: str = ""):
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False
        self.indent, self.mark = indent, ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.end_line(True)
                if part:
                    self.put(part)
            return
        if not s:
            return
        s = _SPACE.sub(" ", s)
        if s == " ":
            self.space = True
            return
        if s[0] == " ":
            self.space, s = True, s[1:]
        trailing = s[-1] == " "
        self.put(s[:-1] if trailing else s)
        self.space = trailing

    def put(self, s: str) -> None:
        if not self.now:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.now.append(self.indent + self.mark)
            if self.mark:
                self.indent, self.mark = self.indent + " " * len(self.mark), ""
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def end_line(self, always: bool = False) -> None:
        """Close the line; with ``always`` an empty one too (``br``, ``pre``)."""
        if self.now:
            self.done.append("".join(self.now).rstrip(" "))
            self.now = []
        elif always:
            self.done.append("")
        self.space = False

    def set_off(self) -> None:
        self.end_line()
        self.gap = True

    def finish(self) -> list[str]:
        self.end_line()
        a, b = 0, len(self.done)
        while a < b and not self.done[a]:
            a += 1
        while b > a and not self.done[b - 1]:
            b -= 1
        return self.done[a:b]


class Columns:
    """Which columns are free in the row at hand, as cells of rows above reach down into some."""

    def __init__(self):
        self.begins, self.ends = [0], [1 << 60]  # runs of free columns
        self.back: dict[int, list[tuple[int, int]]] = defaultdict(list)  # runs that a cell leaves, by the row it has left them in
        self.shared: list[tuple[int, int, int]] = []  # cells that reach into columns taken before, and that row

    def first(self, at: int) -> int:
        """The first free column from ``at`` on."""
        return max(at, self.begins[bisect_right(self.ends, at)])

    def take(self, a: int, b: int, row: int) -> None:
        """Columns ``a`` to ``b`` are taken in rows before ``row``."""
        free = self.cut(a, b)
        self.back[row].append((a, b))
        if free < b - a:
            self.shared.append((a, b, row))

    def cut(self, a: int, b: int) -> int:
        """Take columns; gives how many were free."""
        i, j = bisect_right(self.ends, a), bisect_left(self.begins, b)
        runs = list(zip(self.begins[i:j], self.ends[i:j]))
        left = [(x, y) for s, e in runs[:1] + runs[1:][-1:] for x, y in ((s, min(e, a)), (max(s, b), e)) if x < y]
        self.begins[i:j], self.ends[i:j] = [x for x, _ in left], [y for _, y in left]
        return sum(min(e, b) - max(s, a) for s, e in runs)

    def enter(self, row: int) -> None:
        """Free what cells above have left in ``row``."""
        if row not in self.back:
            return
        for a, b in self.back.pop(row):
            i, j = bisect_left(self.ends, a), bisect_right(self.begins, b)
            if i < j:
                a, b = min(a, self.begins[i]), max(b, self.ends[j - 1])
            self.begins[i:j], self.ends[i:j] = [a], [b]
        self.shared = [x for x in self.shared if x[2] > row]
        for a, b, _ in self.shared:
            self.cut(a, b)


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []  # lines and spans (columns, rows) of each cell

    def lines(self) -> list[str]:
        most = max(map(len, self.rows), default=0)
        columns = Columns()
        widths: dict[int, int] = {}  # of columns in which a cell begins
        placed: list[list[tuple[int, list[str]]]] = []
        for n, row in enumerate(self.rows):
            columns.enter(n)
            at, cells = 0, []
            for cell, span, deep in row:
                at, span = columns.first(at), min(span, most)
                widths[at] = max([widths.get(at, 0), *map(width, cell)] if span == 1 else [widths.get(at, 0)])
                cells.append((at, cell))
                if deep > 1:
                    columns.take(at, at + span, n + deep)
                at += span
            placed.append(cells)
        begins, before = {}, 0
        for column in sorted(widths):
            begins[column] = 2 * column + before
            before += widths[column]
        out = []
        for cells in placed:
            lines: list[list[str]] = [[] for _ in range(max((len(cell) for _, cell in cells), default=0))]
            at = [0] * len(lines)
            for column, cell in cells:
                for i, text in enumerate(cell):
                    if text:
                        gap = max(begins[column] - at[i], 2) if lines[i] else begins[column]
                        gap = gap if gap <= GAP else 2
                        lines[i].append(" " * gap + text)
                        at[i] += gap + width(text)
            out += ("".join(parts).rstrip(" ") for parts in lines)
        return out


def attributes(raw: str) -> dict[str, str]:
    """First of each name, lower-cased."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def spanned(value: str | None, most: int, zero: int) -> int:
    """A span attribute: 1 unless it is a number; ``zero`` for 0 (of rows: all that follow)."""
    if value is None or not (value.isascii() and value.isdigit()):
        return 1
    return min(most, int(value[:9])) or zero


class Page:
    """Builds the tree as a stack of open elements and renders on the way."""

    def __init__(self):
        self.open: list[tuple[str, bool, str, bool]] = []  # name, hides, indent and visibility to return to
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a name
        self.hidden = self.pre = 0
        self.unseen = False
        self.flows: list[Lines] = [Lines()]
        self.tables: list[Table] = []
        self.cells: list[tuple[int, int]] = []  # spans of each open cell
        self.numbers: list[int | None] = []  # of each open list: the next number, or none

    def start(self, name: str, raw: str) -> None:
        if name in ENDS_P:
            self.close_to({"p"}, SCOPE)
        if name in CLOSES:
            self.close_to(*CLOSES[name])
        if name in CELLS and self.tables and self.last("tr") < self.last("table"):
            self.start("tr", "")
        a = attributes(raw) if raw and ("=" in raw or "hidden" in raw or "start" in raw) else {}
        if name == "br":
            if not self.hidden and not self.unseen:
                self.flows[-1].end_line(True)
            return
        if name == "hr":
            if not self.hidden and not self.unseen:
                self.flows[-1].set_off()
            return
        if name in VOID:
            hides = "hidden" in a or bool(_HIDING.search(a.get("style", "")))
            if self.hidden or hides or self.unseen_by(a):
                return
            if name == "img" and a.get("alt"):
                self.flows[-1].text(a["alt"], False)
            elif name == "input" and a.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel") and a.get("value"):
                self.flows[-1].text(a["value"], False)
            return
        flow = self.flows[-1]
        hides = name in INVISIBLE or "hidden" in a or (name == "dialog" and "open" not in a) or bool("style" in a and _HIDING.search(a["style"]))
        self.at[name].append(len(self.open))
        self.open.append((name, hides, flow.indent, self.unseen))
        self.unseen = self.unseen_by(a)
        self.hidden += hides
        if self.hidden:
            return
        if name in CELLS and self.tables:
            self.cells.append((spanned(a.get("colspan"), 1000, 1), spanned(a.get("rowspan"), 65_534, 65_534)))
            self.flows.append(Lines())
            return
        if name == "tr" and self.tables:
            self.tables[-1].rows.append([])
            return
        if name in SPACED and not (name in LISTS and self.numbers):
            flow.set_off()
        elif name in BLOCK or name in LISTS:
            flow.end_line()
        if name == "table":
            self.tables.append(Table())
        elif name in LISTS:
            first = a.get("start", "1")
            self.numbers.append((int(first) if first.lstrip("-").isdigit() and first.isascii() else 1) if name == "ol" else None)
        elif name == "li":
            n = self.numbers[-1] if self.numbers else None
            flow.mark = "- " if n is None else f"{n}. "
            if n is not None:
                self.numbers[-1] = n + 1
        elif name in ("dd", "blockquote"):
            flow.indent += "  "
        elif name == "pre":
            self.pre += 1

    def unseen_by(self, a: dict[str, str]) -> bool:
        """Whether an element with these attributes is invisible here: by its own style, else as what it stands in."""
        own = _VISIBILITY.findall(a["style"]) if "style" in a else []
        return own[-1].lower() != "visible" if own else self.unseen

    def last(self, name: str) -> int:
        """Place of the innermost open ``name``, or -1."""
        places = self.at.get(name)
        return places[-1] if places else -1

    def close_to(self, names, bounds) -> None:
        """Close open elements through the outermost of ``names`` this side of ``bounds``."""
        open_names = [n for n in names if self.at.get(n)]
        if not open_names:
            return
        bound = max(map(self.last, bounds))
        cuts = [self.at[n][i] for n in open_names if (i := bisect_right(self.at[n], bound)) < len(self.at[n])]
        while cuts and len(self.open) > min(cuts):
            self.pop()

    def end(self, name: str) -> None:
        if name == "p" and not self.at.get("p"):
            self.start("p", "")
        if name == "br":
            self.start("br", "")
            return
        i = self.last(name)
        if i < 0 or (name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html") and max(map(self.last, SCOPE)) > i):
            return
        while len(self.open) > i:
            self.pop()

    def pop(self) -> None:
        name, hides, indent, self.unseen = self.open.pop()
        self.at[name].pop()
        if self.hidden:
            self.hidden -= hides
            return
        if name in CELLS and self.tables and self.cells:
            lines = self.flows.pop().finish()
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append((lines, *self.cells.pop()))
            return
        flow = self.flows[-1]
        if name == "table" and self.tables:
            flow.set_off()
            for line in self.tables.pop().lines():
                flow.put(line)
                flow.end_line()
            flow.set_off()
        elif name in LISTS and self.numbers:
            self.numbers.pop()
            flow.end_line() if self.numbers else flow.set_off()
        elif name in SPACED:
            flow.set_off()
        elif name in BLOCK and name not in ("tr", "tbody", "thead", "tfoot"):
            flow.end_line()
        if name == "pre":
            self.pre -= 1
        if name in ("li", "dd", "blockquote"):
            flow.indent, flow.mark = indent, ""

    def text(self, s: str) -> None:
        if not self.hidden and not self.unseen and s:
            self.flows[-1].text(html.unescape(s) if "&" in s else s, self.pre > 0)

    def feed(self, page: str) -> str:
        at, n = 0, len(page)
        while at < n:
            i = page.find("<", at)
            m = None
            while i >= 0 and not (m := _TOKEN.match(page, i)) and not _OPENS.match(page, i):
                i = page.find("<", i + 1)  # no tag begins here
            if not m:
                self.text(page[at:])
                break
            self.text(page[at : m.start()])
            at = m.end()
            if m[2]:
                name = m[2].lower()
                self.start(name, m[3])
                if name in RAW and not m[3].endswith("/"):
                    end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                    self.text(page[at : end.start() if end else n])
                    at = end.end() if end else n
                    self.end(name)
            elif m[1]:
                self.end(m[1].lower())
        while self.open:
            self.pop()
        return "\n".join(self.flows[0].finish())


def render(page: str) -> str:
    """The visible text of a page."""
    return Page().feed(page)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every page."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "html", 8 << 20):
            texts = [None if x is None else render(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    return in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")), run, "page_id long, text string")
