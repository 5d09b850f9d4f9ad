"""HTML extraction: the visible text of a page, laid out as a browser would.

A tree builder reads any markup: missing end tags are implied, void elements have no content,
stray end tags are ignored, comments and raw text (scripts, styles) are no text. Visibility rules
drop what is not displayed. The renderer keeps the spacing of blocks, marks list items by
bullets or numbers with indentation, keeps preformatted text, and aligns the cells of a table in
columns.

Pages are independent, so Spark works on them in narrow passes. Null and empty pages give an empty
text. Repeated rows are rendered one by one. Elements deeper than ``DEEPEST`` join their
ancestor at that depth, as in browsers; no text is lost. Of svg, text is shown where it stands, but not
again where ``use`` refers to it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 200

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset("textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre "
    "search section summary table ul xmp caption tr tbody thead tfoot optgroup option".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir listing hr".split())
#: Start tags that close an open paragraph.
CLOSES_P = BLOCKS - frozenset("body caption dialog html legend option optgroup tbody td tfoot th thead tr".split())
#: An element's start tag closes these if they are open, up to one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: An end tag does not look for its element beyond these.
SCOPES = frozenset("table td th caption html".split())
HIDDEN = frozenset(
    "head script style template noscript title meta link base datalist audio video canvas object iframe "
    "embed noembed noframes param source track area rp".split()
)
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of svg and math whose content is HTML again.
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Start tags that end svg and math.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements of svg whose content is not displayed where they stand.
HIDDEN_SVG = frozenset(
    "clippath defs desc filter lineargradient marker mask metadata pattern radialgradient script style symbol title".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)


def parse(page: str) -> Element:
    """Tree of a page."""
    root = Element("html")
    stack = [root]

    def close(tags: set[str], limits: frozenset | set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return close(tags, limits)
            if stack[i].tag in limits:
                return None
        return None

    def add_text(text: str) -> None:
        if text:
            text = html.unescape(text)
            if stack[-1].tag == "head" and text.strip(" \t\n\f\r"):
                stack.pop()
            stack[-1].children.append(text)

    def foreign() -> int:
        """Place of the svg or math element whose content the next tag is, or 0."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ("svg", "math"):
                return i
            if stack[i].tag in INTEGRATION:
                return 0
        return 0

    any_foreign = False

    at = 0
    for match in iter(lambda: _TAG.search(page, at), None):
        add_text(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "br":
                if stack[-1].tag == "head":
                    stack.pop()
                stack[-1].children.append(Element("br"))
            elif tag == "p" and stack[-1].tag != "head" and not any(e.tag == "p" for e in stack):
                stack[-1].children.append(Element("p"))
            else:
                limits = SCOPES - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"html"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in limits:
                        break
            continue
        attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(match[3])}
        if tag in ("html", "body"):
            # Their content ends the head; the root stands for both.
            close({"head"}, frozenset())
            root.attributes.update({k: v for k, v in attributes.items() if k not in root.attributes})
            continue
        at_foreign = foreign() if any_foreign else 0
        if at_foreign and (tag in BREAKOUT or (tag == "font" and attributes.keys() & {"color", "face", "size"})):
            while at_foreign:
                del stack[at_foreign:]
                at_foreign = foreign()
        if tag == "head" and (len(stack) > 1 or any(not isinstance(x, str) or x.strip(" \t\n\f\r") for x in root.children)):
            continue
        if tag not in IN_HEAD and stack[-1].tag == "head":
            stack.pop()
        if tag in CLOSES_P and not at_foreign:
            close({"p"}, SCOPES | {"button"})
        if tag in IMPLIED and not at_foreign:
            close(*IMPLIED[tag])
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        any_foreign = any_foreign or tag in ("svg", "math")
        if (at_foreign or tag in ("svg", "math")) and re.search(r"(?:^|[\s\"'])/\Z|^[^=]*/\Z", match[3]):
            continue
        if tag in RAW or tag in RAW_WITH_REFERENCES:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            element.children.append(html.unescape(text) if tag in RAW_WITH_REFERENCES else text)
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(element)
    add_text(page[at:])
    return root


def visible(element: Element) -> bool:
    """Whether an element is displayed at all."""
    a = element.attributes
    if element.tag in HIDDEN or "hidden" in a or _HIDING.search(a.get("style", "")):
        return False
    if element.tag == "input" and a.get("type", "").lower() in ("hidden", "checkbox", "radio", "image", "file", "password"):
        return False
    return not (element.tag == "dialog" and "open" not in a)


class _Lines:
    """Lines of a block, with at most one empty line between two."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self._line = ""
        self._gap = self._space = False
        #: Whether the block begins and ends with a gap, which then shows outside of it.
        self.lead = self.trail = False

    def text(self, text: str) -> None:
        for i, word in enumerate(_SPACE.split(text)):
            if i:
                self._space = True
            if word:
                if self._line and self._space:
                    self._line += " "
                self._line += word
                self._space = False

    def line_break(self) -> None:
        self.end_line() if self._line else self.lines.append("")

    def end_line(self) -> None:
        if self._line:
            self._flush_gap()
            self.lines.append(self._line)
        self._line, self._space = "", False

    def _flush_gap(self) -> None:
        if self._gap and not self.lines:
            self.lead = True
        elif self._gap and self.lines[-1]:
            self.lines.append("")
        self._gap = False

    def block(self, lines: list[str], before: bool, after: bool) -> None:
        """Lines of a block, with gaps before and after it."""
        self.end_line()
        if lines:
            self._gap = self._gap or before
            self._flush_gap()
            self.lines += lines
            self._gap = after

    def done(self) -> _Lines:
        self.end_line()
        self.trail = self._gap
        lines = [x.rstrip() for x in self.lines]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        self.lines = lines
        return self


def _render(element: Element, out: _Lines, preformatted: bool) -> None:
    """Add the visible content of an element."""
    number = _first_number(element)
    for child in element.children:
        if isinstance(child, str):
            if preformatted:
                for i, line in enumerate(child.replace("\r\n", "\n").split("\n")):
                    if i:
                        out.line_break()
                    out._line += line
            else:
                out.text(child)
            continue
        if not visible(child):
            continue
        tag = child.tag
        if tag.startswith("annotation") and element.tag == "semantics":
            continue
        if tag == "br":
            out.line_break()
        elif tag == "input":
            out.text(child.attributes.get("value", "") or child.attributes.get("placeholder", ""))
        elif tag == "table":
            out.block(_table(child), True, True)
        elif tag == "svg":
            _svg(child, out, False)
        elif tag == "li":
            inner = _block(child, preformatted).lines
            if number is None:
                mark = "- "
            else:
                number = int(child.attributes["value"]) if re.fullmatch(r"-?\d{1,9}", child.attributes.get("value", "")) else number
                mark, number = f"{number}. ", number + 1
            indent = " " * len(mark)
            out.block([(mark if not i else indent) + x for i, x in enumerate(inner)], False, False)
        elif tag in ("blockquote", "dd"):
            spaced = tag == "blockquote"
            out.block(["  " + x if x else x for x in _block(child, preformatted).lines], spaced, spaced)
        elif tag == "pre":
            out.block(_block(child, True).lines, True, True)
        elif tag in ("td", "th"):
            out.text(" ")
            _render(child, out, preformatted)
            out.text(" ")
        elif tag in BLOCKS:
            nested = element.tag == "li" and tag in ("ul", "ol", "menu", "dir")
            inside = _block(child, preformatted)
            spaced = tag in SPACED and not nested
            out.block(inside.lines, spaced or inside.lead, spaced or inside.trail)
        else:
            _render(child, out, preformatted)


def _svg(element: Element, out: _Lines, shown: bool) -> None:
    """Add the text elements and the embedded HTML of an svg."""
    for child in element.children:
        if isinstance(child, str):
            if shown:
                out.text(child)
        elif child.tag in HIDDEN_SVG or not visible(child) or child.attributes.get("display") == "none" or child.attributes.get("visibility") == "hidden":
            continue
        elif child.tag == "foreignobject":
            inside = _block(child, False)
            out.block(inside.lines, inside.lead, inside.trail)
        elif child.tag == "text":
            out.text(" ")
            _svg(child, out, True)
            out.text(" ")
        else:
            _svg(child, out, shown)


def _first_number(element: Element) -> int | None:
    if element.tag != "ol":
        return None
    start = element.attributes.get("start", "")
    return int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1


def _block(element: Element, preformatted: bool) -> _Lines:
    out = _Lines()
    _render(element, out, preformatted)
    return out.done()


def _span(cell: Element) -> int:
    value = cell.attributes.get("colspan", "1")
    return min(max(int(value), 1), 1000) if re.fullmatch(r"\d{1,6}", value) else 1


def _table(table: Element) -> list[str]:
    """Caption and what is in no cell, then the rows with their cells in aligned columns."""
    captions: list[str] = []
    parts: dict[str, list[list[tuple[list[str], int]]]] = {"thead": [], "tbody": [], "tfoot": []}

    def gather(parent: Element, part: str) -> None:
        loose = Element("tr")
        for child in parent.children:
            if isinstance(child, str):
                captions.extend(_block(Element("div", {}, [child]), False).lines)
            elif not visible(child) or child.tag in ("colgroup", "col"):
                continue
            elif child.tag in parts:
                gather(child, child.tag)
            elif child.tag == "tr":
                parts[part].append(row(child))
            elif child.tag in ("td", "th"):
                loose.children.append(child)
            else:
                captions.extend(_block(Element("div", {}, [child]), False).lines)
        if loose.children:
            parts[part].append(row(loose))

    def row(tr: Element) -> list[tuple[list[str], int]]:
        cells = []
        for child in tr.children:
            if isinstance(child, str) or child.tag not in ("td", "th"):
                if isinstance(child, str) or visible(child):
                    captions.extend(_block(Element("div", {}, [child]), False).lines)
            elif visible(child):
                cells.append((_block(child, False).lines, _span(child)))
        return cells

    gather(table, "tbody")
    rows = [r for part in ("thead", "tbody", "tfoot") for r in parts[part]]
    width: dict[int, int] = {}
    for cells in rows:
        column = 0
        for lines, span in cells:
            if span == 1:
                width[column] = max([width.get(column, 0), *map(len, lines)])
            column += span
    out = list(captions)
    for cells in rows:
        for k in range(max([len(lines) for lines, _ in cells], default=0)):
            line, column = "", 0
            for lines, span in cells:
                room = sum(width.get(c, 0) for c in range(column, column + span)) + 3 * (span - 1)
                line += (" | " if column else "") + (lines[k] if k < len(lines) else "").ljust(room)
                column += span
            out.append(line.rstrip())
    return out


def visible_text(page: str) -> str:
    """Layout-aware text of a page."""
    root = parse(page)
    return "\n".join(_block(root, False).lines) if visible(root) else ""


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row`` (a struct of all given columns) and ``text``, one row for each row."""
    rows = pages.select(
        F.struct("*").alias("row"), F.col(html_col).cast("string").alias("page"), F.lit("").alias("text")
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(page or "") for page in batch.column("page").to_pylist()]
            columns = [batch.column("row"), batch.column("page"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(render, rows.schema).drop("page")
