"""Layout-aware text of HTML pages.

A tree builder applies the implied end tags of HTML (an open <p> ends at a block, <li>, <dt>, <dd>,
<option>, table rows and cells at their likes, the head at the first tag or text that is no metadata,
svg and math at HTML's own elements) and a renderer lays out what a browser would show:
blocks on lines of their own, a blank line around paragraphs, headings, lists and tables, bullets and
numbers with nested indents, preformatted text as it is, and table cells in aligned columns, with
colspan and rowspan. Not shown: the head, scripts, styles, templates, noscript, embedded content's
fallbacks, svg beyond its <text> and <foreignObject> (so not definitions, nor what <use> repeats),
annotations and phantoms of formulas, closed <details> but for their summary, closed <dialog>, hidden inputs, the hidden
attribute, display:none, and visibility:hidden where no descendant sets it back.

Work and output are in proportion to the page. Tags are read in one pass; a tag that the page's end
cuts off is dropped, a quote that never closes is an ordinary character. Spaces that align the columns
of tables add at most PADDING times the page's length and a constant: beyond that the widest columns,
and then all, are not waited for; cells then stand two spaces apart. Indents end at INDENT. Of rows,
the first COLUMNS columns know of cells that reach down into them.

Cases: null or empty HTML gives an empty text; malformed HTML never fails: unknown end tags are
ignored and unclosed elements end with the page; elements nested deeper than DEPTH become siblings,
their text is kept; repeated rows are rendered each on its own; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import table

DEPTH = 150
#: Spaces for alignment as a multiple of the page, and besides; the widest indent; columns with a memory.
PADDING, FREE_PADDING, INDENT, COLUMNS = 4, 20_000, 40, 1000
BATCH_BYTES = 16 << 20

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set(
    "head title script style template noscript datalist iframe object video audio canvas annotation annotation-xml mphantom".split()
)
#: What an open head may hold; any other tag or text ends it.
METADATA = set("html head title meta link style script base basefont bgsound noframes noscript template".split())
#: HTML elements that end an open svg or math, unless one of the borders (where HTML is at home) lies between.
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p"
    " pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FOREIGN, HOME = {"svg", "math"}, set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Of an svg, what is not drawn in its place.
UNDRAWN = set("defs symbol clippath mask pattern marker lineargradient radialgradient filter desc metadata".split())
#: Blocks, and those of them with a blank line around.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr menu".split())
BLOCKS = SPACED | set(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main"
    " nav optgroup option search section select summary caption tr thead tbody tfoot td th".split()
)
#: A start tag ends the open elements named here, unless one of the borders lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
P_BORDERS = set("table td th caption button object body".split())
#: Elements whose content is no markup, and those of them whose character references count.
RAW, REFERENCED = set("script style xmp iframe noembed noframes textarea title plaintext".split()), {"textarea", "title"}
_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />]*")
_BETWEEN = re.compile(r"[\t\n\r\f /]*")
_ATTRIBUTE = re.compile(r"=?[^\t\n\r\f />=]*")
_EQUALS = re.compile(r"[\t\n\r\f ]*=[\t\n\r\f ]*")
_BARE = re.compile(r"[^\t\n\r\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_ZEROS, _LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")
_WHITE = re.compile(r"[ \t\n\r\f]+")
_DIGITS = re.compile(r"\s*(-?\d{1,6})")


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def style(self, name: str) -> str:
        for part in self.attrs.get("style", "").lower().split(";"):
            key, _, value = part.partition(":")
            if key.strip() == name:
                return value.replace("!important", "").strip()
        return ""

    def number(self, name: str, default: int) -> int:
        found = _DIGITS.match(self.attrs.get(name, ""))
        return int(found[1]) if found else default


def _plain(text: str) -> str:
    """text with its character references resolved."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LARGE.sub("&#9999999", _ZEROS.sub("&#", text))
    return unescape(text)


def _after(pattern: re.Pattern, text: str, at: int) -> int:
    return pattern.match(text, at).end()


class TreeBuilder:
    """Elements and strings of a page, under one root."""

    def __init__(self):
        self.root = Element("#root", {})
        self.open = [self.root]

    def feed(self, html: str) -> None:
        """Read a whole page."""
        html = html.replace("\r\n", "\n")
        self.html, at, n = html, 0, len(html)
        self.last = {c: html.rfind(c) for c in ">\"'"}
        while at < n:
            tag = html.find("<", at)
            while tag >= 0 and not (html[tag + 1 : tag + 2].isalpha() and html[tag + 1].isascii() or html[tag + 1 : tag + 2] in ("/", "!", "?")):
                tag = html.find("<", tag + 1)
            stop = n if tag < 0 else tag
            if stop > at:
                self.handle_data(_plain(html[at:stop]))
            if tag < 0:
                return
            at = self._markup(tag)

    def _markup(self, at: int) -> int:
        """Read what begins with the < at at; returns where it ends."""
        html = self.html
        if html.startswith("<!--", at):
            if html.startswith(">", at + 4) or html.startswith("->", at + 4):
                return html.index(">", at) + 1
            found = _COMMENT_END.search(html, at + 4)
            return found.end() if found else len(html)
        if html.startswith("<![CDATA[", at) and any(x.tag in FOREIGN for x in self.open):
            end = html.find("]]>", at)
            self.handle_data(html[at + 9 : end if end >= 0 else len(html)])
            return end + 3 if end >= 0 else len(html)
        name = _NAME.match(html, at + 2 if html.startswith("/", at + 1) else at + 1)
        if not name:
            end = html.find(">", at)
            return end + 1 if end >= 0 else len(html)
        attrs, at_end = self._attributes(name.end())
        if at_end < 0:
            return len(html)
        tag = name[0].lower()
        if html.startswith("/", at + 1):
            self.handle_endtag(tag)
            return at_end
        if html.startswith("/", at_end - 2):
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
        if tag not in RAW or any(x.tag in FOREIGN for x in self.open):
            return at_end
        close = re.compile(f"</{tag}(?=[\t\n\r\f />])", re.IGNORECASE).search(html, at_end) if tag != "plaintext" else None
        stop = close.start() if close else len(html)
        if stop > at_end:
            self.handle_data(_plain(html[at_end:stop]) if tag in REFERENCED else html[at_end:stop])
        return stop

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes from at on, and the place after the tag's >, or -1 where the page ends before."""
        html, found = self.html, []
        while self.last[">"] >= at:
            at = _after(_BETWEEN, html, at)
            if html.startswith(">", at):
                return found, at + 1
            end = _after(_ATTRIBUTE, html, at)
            name, at, value = html[at:end].lower(), end, ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ("'", '"') and self.last[quote] > at:
                    end = html.index(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    end = _after(_BARE, html, at)
                    value, at = html[at:end], end
            found.append((name, _plain(value)))
        return found, -1

    def handle_starttag(self, tag, attrs):
        if tag not in METADATA:
            self._end_head()
        if tag in BREAKOUT:
            self._end_above(FOREIGN, HOME)
        if tag in BLOCKS:
            self._end_above({"p"}, P_BORDERS)
        if tag in ENDS:
            self._end_above(*ENDS[tag])
        element = Element(tag, dict(reversed(attrs)))
        self.open[-1].children.append(element)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # only svg and math know elements that end with their start tag
        last = self.open[-1]
        if last.tag == tag and not last.children and tag not in BREAKOUT and any(x.tag in FOREIGN for x in self.open):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "br":
            self._end_head()
            self.open[-1].children.append(Element("br", {}))
            return
        border = {"table"} if tag != "table" else set()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if self.open[at].tag in border:
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and _WHITE.sub("", data):
            self._end_head()
        self.open[-1].children.append(data)

    def _end_head(self) -> None:
        if self.open[-1].tag == "head":
            self.open.pop()

    def _end_above(self, tags: set[str], borders: set[str]) -> None:
        """End the outermost open element of tags above the last border."""
        found = 0
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in borders:
                break
            if self.open[at].tag in tags:
                found = at
        if found:
            del self.open[found:]


class Page:
    """Lines of text being laid out. indent goes before every line, mark in its place before the next;
    budget[0] spaces are left for alignment on the whole page."""

    def __init__(self, budget: list[int]):
        self.budget = budget
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent, self.mark = "", None
        self.gap = False

    def text(self, data: str) -> None:
        data = _WHITE.sub(" ", data)
        if data[:1] == " " and (not self.now or self.now[-1].endswith(" ")):
            data = data[1:]
        if data:
            self.now.append(data)

    def pre(self, data: str) -> None:
        first, *more = data.replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for line in more:
            self.end(True)
            self.now.append(line)

    def end(self, even_empty: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if not line and not even_empty:
            return
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append(((self.indent if self.mark is None else self.mark) + line).rstrip())
        self.mark = None

    def space(self) -> None:
        self.end()
        self.gap = True

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _shown(element: Element) -> bool:
    if element.tag in HIDDEN or "hidden" in element.attrs or element.style("display") == "none":
        return False
    if element.tag == "dialog":
        return "open" in element.attrs
    return not (element.tag == "input" and element.attrs.get("type", "").lower() == "hidden")


def _lay(element: Element, page: Page, pre: bool, visible: bool) -> None:
    closed = element.tag == "details" and "open" not in element.attrs
    for child in element.children:
        if closed and (isinstance(child, str) or child.tag != "summary"):
            continue
        if isinstance(child, str):
            if visible:
                page.pre(child) if pre else page.text(child)
            continue
        if not _shown(child):
            continue
        seen = {"hidden": False, "collapse": False, "visible": True}.get(child.style("visibility"), visible)
        tag = child.tag
        if tag == "br":
            page.end(True)
        elif tag == "hr":
            page.space()
            page.now.append("-" * 8)
            page.space()
        elif tag == "table":
            page.space()
            for line in _table(child, pre, seen, page.budget):
                page.now.append(line)
                page.end(True)
            page.space()
        elif tag in BLOCKS or child.style("display") == "block":
            page.space() if tag in SPACED and not (tag in ("ul", "ol", "menu") and element.tag == "li") else page.end()
            outer, mark = page.indent, page.mark
            if tag in ("ul", "ol", "menu"):
                _list(child, page, pre, seen)
            else:
                if tag in ("blockquote", "dd"):
                    page.indent = (page.indent + "  ")[:INDENT]
                _lay(child, page, pre or tag == "pre" or child.style("white-space").startswith("pre"), seen)
            page.end()
            page.indent = outer
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and element.tag == "li"):
                page.space()
        elif tag in ("td", "th", "mtd"):
            page.text(" ")
            _lay(child, page, pre, seen)
        elif tag == "svg":
            _draw(child, page, seen, False)
        else:
            _lay(child, page, pre or tag == "textarea", seen)


def _draw(element: Element, page: Page, visible: bool, inside: bool) -> None:
    """The labels of an svg, one after another; inside: of a <text>."""
    for child in element.children:
        if isinstance(child, str):
            if inside and visible:
                page.text(child)
            continue
        if not _shown(child) or child.tag in UNDRAWN:
            continue
        seen = {"hidden": False, "collapse": False, "visible": True}.get(child.style("visibility"), visible)
        if child.tag == "foreignobject":
            page.end()
            _lay(child, page, False, seen)
            page.end()
        elif child.tag == "text":
            page.text(" ")
            _draw(child, page, seen, True)
            page.text(" ")
        else:
            _draw(child, page, seen, inside)


def _list(element: Element, page: Page, pre: bool, visible: bool) -> None:
    number, outer = element.number("start", 1), page.indent
    for child in element.children:
        if isinstance(child, str) or child.tag != "li":
            holder = Element("div", {})
            holder.children = [child]
            _lay(holder, page, pre, visible)
            continue
        if not _shown(child):
            continue
        number = child.number("value", number)
        mark = f"{number}. " if element.tag == "ol" else "- "
        number += 1
        page.end()
        page.indent, page.mark = (outer + " " * len(mark))[:INDENT], outer + mark
        _lay(child, page, pre, {"hidden": False, "visible": True}.get(child.style("visibility"), visible))
        page.end()
        page.indent, page.mark = outer, None


def _table(element: Element, pre: bool, visible: bool, budget: list[int]) -> list[str]:
    """Lines of a table: captions, then the rows with their cells in aligned columns."""
    captions: list[str] = []
    rows: list[list[Element]] = []

    def gather(parent: Element) -> None:
        row = None
        for child in parent.children:
            if isinstance(child, str):
                if child.strip():
                    rows.append([_held(child)])
                continue
            if not _shown(child):
                continue
            if child.tag == "caption":
                captions.extend(_cell(child, pre, visible, budget))
            elif child.tag in ("thead", "tbody", "tfoot"):
                gather(child)
            elif child.tag == "tr":
                rows.append(_cells(child))
            elif child.tag in ("td", "th"):
                if row is None:
                    rows.append(row := [])
                row.append(child)
            elif child.tag not in ("col", "colgroup"):
                rows.append([_held(child)])

    gather(element)
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}
    spans: list[dict[int, int]] = []
    for row in rows:
        cells, wide, at = {}, {}, 0
        held = dict(taken)
        for cell in row:
            while held.get(at, 0) > 0:
                at += 1
            across = min(max(1, cell.number("colspan", 1)), 1000)
            down = min(max(1, cell.number("rowspan", 1)), 65534)
            cells[at], wide[at] = _cell(cell, pre, visible, budget), across
            for x in range(at, min(at + across, COLUMNS)):
                taken[x] = max(taken.get(x, 0), down)
            at += across
        taken = {x: n - 1 for x, n in taken.items() if n > 1}
        grid.append(cells)
        spans.append(wide)
    widths: dict[int, int] = {}
    for cells, wide in zip(grid, spans):
        for at, lines in cells.items():
            widths.setdefault(at, 0)
            if wide[at] == 1:
                widths[at] = max(widths[at], max(map(len, lines), default=0))
    columns, starts = sorted(widths), {}
    for widest in (None, 200, 80, 40, 16):
        at = 0
        for column in columns:
            starts[column] = at
            at += (widths[column] if widest is None else min(widths[column], widest)) + 2
        # at most so many spaces: a line's last cell begins there
        needed = sum(starts[max(cells)] * max(map(len, cells.values())) for cells in grid if cells)
        if needed <= budget[0]:
            budget[0] -= needed
            break
    else:
        starts = dict.fromkeys(columns, 0)
    out = list(captions)
    for cells in grid:
        parts: list[list[str]] = [[] for _ in range(max(map(len, cells.values()), default=0))]
        ends = [0] * len(parts)
        for column in sorted(cells):
            for i, own in enumerate(cells[column]):
                if own:
                    gap = starts[column] - ends[i] if ends[i] <= starts[column] else 2
                    parts[i].append(" " * gap + own)
                    ends[i] += gap + len(own)
        out.extend("".join(x).rstrip() for x in parts)
    return out


def _held(child) -> Element:
    """A cell around what stands in a table without one."""
    cell = Element("td", {})
    cell.children = [child]
    return cell


def _cells(row: Element) -> list[Element]:
    found = [x for x in row.children if (x.strip() if isinstance(x, str) else _shown(x))]
    return [x if isinstance(x, Element) and x.tag in ("td", "th") else _held(x) for x in found]


def _cell(cell: Element, pre: bool, visible: bool, budget: list[int]) -> list[str]:
    page = Page(budget)
    _lay(cell, page, pre, {"hidden": False, "visible": True}.get(cell.style("visibility"), visible))
    return page.done()


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    page = Page([PADDING * len(html) + FREE_PADDING])
    _lay(builder.root, page, False, True)
    return "\n".join(page.done())


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: its id and visible text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for page_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(page_id)
                texts.append(render(value.as_py()))
                held += len(texts[-1])
                if held > BATCH_BYTES or len(ids) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def op6_layout_text(spark, sf_dir) -> DataFrame:
    """The visible text of all pages."""
    return extract(table(spark, sf_dir, "pages", "page_id", "html"))
