"""The visible text of an HTML page, laid out as text: tree building with implied tags, visibility, blocks, lists and tables."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

from sheetwise.llm.styles import Styles, marks_of, screen_meets

# Kinds of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set(
    "head script style template noscript title meta link base datalist rp audio video canvas object iframe noembed noframes".split()
)
#: inputs that show a label, and the label without a value
LABELS = {"submit": "Submit", "reset": "Reset", "button": ""}
#: elements in svg and math that are not drawn, whose text is drawn, that hold HTML, and whose children stand apart
UNDRAWN = set("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
DRAWN = set("text foreignobject mi mn mo ms mtext".split())
HOLDS_HTML = set("foreignobject desc title mi mn mo ms mtext annotation-xml".split())
APART = set("mfrac mroot mtable mtr mlabeledtr".split())
#: start tags that end an open svg or math
ENDS_FOREIGN = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
#: blocks with a blank line before and after, and those that only begin a new line
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre figure table fieldset hr xmp listing plaintext".split())
PLAIN = set(
    "html body div section article aside header footer nav main address center details summary dialog form hgroup search figcaption "
    "li dt dd legend option optgroup select textarea tr td th caption thead tbody tfoot".split()
)
BLOCK = SPACED | PLAIN
#: a start tag closes these open elements, up to the given borders
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "rp": ({"rp", "rt"}, {"ruby"}),
    "rt": ({"rp", "rt"}, {"ruby"}),
    "body": ({"head"}, set()),
}
#: a start tag of these closes an open paragraph
CLOSE_P = (SPACED | PLAIN) - {"option", "optgroup", "select", "textarea", "td", "th", "tr", "caption", "thead", "tbody", "tfoot", "html", "body", "legend"}
#: an end tag does not reach beyond these
BORDER = {"td": {"table"}, "th": {"table"}, "tr": {"table"}, "li": {"ul", "ol"}}

START = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
END = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WHITE = re.compile(r"[ \t\n\f\r]+")

#: nesting that is still indented, tables in tables that are still laid out, and the widest padded column
INDENTS, TABLES, WIDEST = 40, 6, 80


#: open elements at most
DEEPEST = 512


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, ""); comments and the like are left out."""
    at, loose, raw = 0, False, ""
    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            yield "text", page[at:stop], raw
            raw, at = "", stop
            continue
        opened = page.find("<", at)
        if opened < 0:
            yield "text", page[at:], ""
            return
        if opened > at:
            yield "text", page[at:opened], ""
        at, nxt = opened, page[opened + 1 : opened + 2]
        if nxt == "!" or nxt == "?":
            comment = page.startswith("<!--", at)
            close = page.find("-->" if comment else ">", at + (2 if comment else 1))
            at = len(page) if close < 0 else close + (3 if comment else 1)
        elif nxt == "/":
            m = END.match(page, at)
            if m:
                yield "end", m[1].lower(), ""
                at = m.end()
            else:
                close = page.find(">", at)
                at = len(page) if close < 0 else close + 1
        elif nxt.isascii() and nxt.isalpha():
            m = None if loose else START.match(page, at)
            if not m:  # a quotation mark that is never closed
                loose, m = True, LOOSE.match(page, at)
            if not m:
                return
            name = m[1].lower()
            yield "start", name, m[2]
            at = m.end()
            if name == "plaintext":  # never ends
                yield "text", page[at:], name
                return
            if name in RAW:
                raw = name
        else:
            yield "text", "<", ""
            at += 1


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def columns(text: str) -> int:
    """The places a text takes up in a fixed-width column."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Text that is written in blocks; a block's lines begin with the prefixes that are open."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.prefixes: list[str] = []
        self.marker: str | None = None

    def write(self, text: str, kept: bool = False) -> None:
        if kept:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in rest:
                self.line(True)
                self.now.append(line)
            return
        for i, word in enumerate(WHITE.split(text)):
            if i:
                self.space = True
            if word:
                if self.space and self.now:
                    self.now.append(" ")
                self.now.append(word)
                self.space = False

    def line(self, always: bool = False) -> None:
        """Ends the current line; an empty one only counts if asked for."""
        text, self.now, self.space = "".join(self.now), [], False
        if not text and not (always and self.lines):
            return
        if text and self.lines and self.gap:
            self.lines += [""] * self.gap
        if text:
            self.gap = 0
            prefix = "".join(self.prefixes[:INDENTS])
            if self.marker is not None:
                prefix, self.marker = prefix[: max(0, len(prefix) - len(self.marker))] + self.marker, None
            text = prefix + text
        self.lines.append(text.rstrip())

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def text(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []

    def laid_out(self) -> list[str]:
        """The rows with their columns aligned; cells may span columns and rows and hold several lines."""
        placed: list[list[tuple[int, int, list[str]]]] = []
        held: dict[int, int] = {}  # column -> rows it is still taken by a cell from above
        width: dict[int, int] = {}
        for row in self.rows:
            at, line = 0, []
            for lines, across, down in row:
                while held.get(at, 0) > 0:
                    at += 1
                line.append((at, across, lines))
                if down > 1:
                    held |= {c: down for c in range(at, at + across)}
                if across == 1:
                    width[at] = max(width.get(at, 0), min(WIDEST, max(map(columns, lines), default=0)))
                at += across
            held = {c: n - 1 for c, n in held.items() if n > 1}
            placed.append(line)
        for line in placed:  # what spans several columns widens the last of them
            for at, across, lines in line:
                if across > 1:
                    rest = sum(width.get(c, 0) + 2 for c in range(at, at + across - 1))
                    need = min(WIDEST, max(map(columns, lines), default=0)) - rest
                    width[at + across - 1] = max(width.get(at + across - 1, 0), need)
        used = sorted(c for c in width if width[c] > 0)
        start, total = {}, 0
        for c in used:
            start[c], total = total, total + width[c] + 2
        out = list(self.caption)
        for line in placed:
            for i in range(max((len(lines) for _, _, lines in line), default=0)):
                text, size = "", 0
                for at, _, lines in line:
                    if i < len(lines) and lines[i]:
                        gap = max(start.get(at, size) - size, 2 if text else 0)
                        text, size = text + " " * gap + lines[i], size + gap + columns(lines[i])
                out.append(text)
        return out


class Element:
    __slots__ = ("tag", "shown", "none", "number", "prefix", "foreign", "drawn", "seen")

    def __init__(self, tag: str, shown: bool, none: bool, number: int = 0, prefix: bool = False, foreign: bool = False, drawn: bool = True):
        self.tag, self.shown, self.none, self.number, self.prefix = tag, shown, none, number, prefix
        self.foreign, self.drawn = foreign, drawn  # in svg or math; whether its own text is drawn there
        self.seen = (tag, frozenset(), {})  # what selectors ask for


class Renderer:
    """Builds the open elements as tags come and writes what is visible."""

    def __init__(self, styles: Styles | None = None):
        self.open: list[Element] = [Element("#page", True, False)]
        self.out = [Lines()]
        self.tables: list[Table | None] = []
        self.cells: list[tuple[int, int]] = []
        self.styles = styles or Styles()
        self.kept = 0  # open elements that keep white space
        self.depth: dict[str, int] = {}

    def _push(self, e: Element) -> None:
        self.open.append(e)
        self.depth[e.tag] = self.depth.get(e.tag, 0) + 1

    def _close_to(self, index: int) -> None:
        while len(self.open) > index:
            self._end(self.open.pop())

    def _find(self, tags: set[str], borders: set[str]) -> int:
        """The outermost open element of ``tags`` within the nearest border; -1 if there is none."""
        if not any(self.depth.get(t) for t in tags):
            return -1
        best = -1
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in borders:
                break
            if tag in tags:
                best = i
                if not borders:
                    break
        return best

    def start(self, tag: str, text: str) -> None:
        if self.open[-1].foreign and tag in ENDS_FOREIGN:
            i = len(self.open) - 1
            while self.open[i - 1].foreign:
                i -= 1
            self._close_to(i)
        if self.open[-1].tag == "head" and tag not in UNSEEN:
            self._close_to(len(self.open) - 1)  # the head ends where something else begins
        if tag in CLOSES and (i := self._find(*CLOSES[tag])) > 0:
            self._close_to(i)
        if tag in CLOSE_P and self.depth.get("p") and (i := self._find({"p"}, {"table", "td", "th", "button", "caption"})) > 0:
            self._close_to(i)
        if tag in ("td", "th") and self.depth.get("table") and self.open[-1].tag != "tr" and self._find({"tr"}, {"table"}) < 0:
            self.start("tr", "")
        given = attributes(text) if text.strip() else {}
        above = self.open[-1]
        inside = above.foreign or tag in ("svg", "math")
        said = self.styles.decided(tag, given, [x.seen for x in self.open[1:]] if self.styles.nested else ()) if self.styles.rules or "style" in given else {}
        display = said.get("display", "revert")
        # what browsers hide by default is shown by a rule of the page
        absent = "hidden" in given or tag == "dialog" and "open" not in given
        none = above.none or tag in UNSEEN or inside and tag in UNDRAWN
        none = none or display == "none" or absent and display.startswith("revert") or said.get("opacity") == "0"
        none = none or above.tag == "details" and above.number == 0 and tag != "summary"
        none = none or tag == "input" and given.get("type", "").lower() not in LABELS
        visibility = said.get("visibility", "inherit")
        shown = above.shown if visibility in ("inherit", "unset") or visibility.startswith("revert") else visibility in ("visible", "initial")
        e = Element(tag, shown, none, number=int("open" in given) if tag == "details" else 0)
        if self.styles.nested:
            e.seen = (tag, marks_of(given), given)
        e.foreign = inside and tag not in HOLDS_HTML
        e.drawn = tag in DRAWN or above.drawn and tag not in ("svg", "math") if inside else above.drawn
        if inside and (tag == "text" or above.tag in APART):
            self.out[-1].space = True
        if tag == "ol":
            e.number = int(given["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", given.get("start", "")) else 0
        if tag == "body" and self.depth.get("body") or tag == "html" and self.depth.get("html"):
            return
        if not none:
            self._begin(e, given)
        if tag not in VOID and not (inside and text.rstrip().endswith("/")):
            self._close_to(DEEPEST)  # deeper elements become siblings, as in browsers
            self._push(e)

    def _begin(self, e: Element, given: dict[str, str]) -> None:
        tag, out = e.tag, self.out[-1]
        if tag == "br":
            out.line(True)
        elif tag in BLOCK:
            out.block(1 if tag in SPACED and not (tag in ("ul", "ol") and self.depth.get("li")) else 0)
        if tag == "input" and e.shown:
            out.write(given.get("value", LABELS[given["type"].lower()]))
        elif tag == "hr" and e.shown:
            out.write("---")
            out.block(1)
        elif tag == "li":
            over = next((x for x in reversed(self.open) if x.tag in ("ul", "ol", "menu", "dir")), None)
            mark = "- "
            if over is not None and over.tag == "ol":
                over.number = int(given["value"]) if re.fullmatch(r"-?\d{1,9}", given.get("value", "")) else over.number + 1
                mark = f"{over.number}. "
            e.prefix = True
            out.prefixes.append(" " * len(mark))
            out.marker = mark if e.shown and len(out.prefixes) <= INDENTS else None
        elif tag in ("dd", "blockquote"):
            e.prefix = True
            out.prefixes.append("    " if tag == "dd" else "> ")
        elif tag in ("pre", "textarea", "xmp", "listing", "plaintext"):
            self.kept += 1
        elif tag == "table":
            self.tables.append(Table() if len([t for t in self.tables if t]) < TABLES else None)
        elif tag == "tr" and self.tables and self.tables[-1]:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and self.tables and self.tables[-1]:
            span = lambda name, most: min(most, int(given[name])) if re.fullmatch(r"[1-9]\d{0,4}", given.get(name, "")) else 1
            self.cells.append((span("colspan", 1000), span("rowspan", 65534)))
            self.out.append(Lines())
            e.prefix = True  # it has lines of its own

    def _end(self, e: Element) -> None:
        self.depth[e.tag] -= 1
        if e.none:
            return
        tag = e.tag
        if tag == "text" and e.foreign or tag in ("svg", "math"):
            self.out[-1].space = True if tag == "text" else self.out[-1].space
            return
        if tag in ("td", "th", "caption") and e.prefix:
            lines, spans = self.out.pop().text(), self.cells.pop()
            table = self.tables[-1]
            if tag == "caption":
                table.caption += lines
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((lines, *spans))
            return
        out = self.out[-1]
        if tag == "table":
            table = self.tables.pop() if self.tables else None
            if table:
                for line in table.laid_out():
                    out.write(line, True)
                    out.line(True)
            out.block(1)
            return
        if tag in ("pre", "textarea", "xmp", "listing", "plaintext"):
            self.kept -= 1
        if tag in BLOCK:
            out.block(1 if tag in SPACED and not (tag in ("ul", "ol") and self.depth.get("li")) else 0)
        elif tag == "#page":
            out.line()
        if e.prefix:
            out.prefixes.pop()
            out.marker = None

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif self.depth.get(tag):
            if tag in ("html", "body"):
                return  # what comes later still belongs to the body
            borders = BORDER.get(tag, set() if tag in ("table", "tbody", "thead", "tfoot") else {"td", "th"})
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    self._close_to(i)
                    return
                if self.open[i].tag in borders:
                    return

    def text(self, text: str, raw: str) -> None:
        over = self.open[-1]
        if over.tag == "head" and text.strip(" \t\n\f\r"):
            self._close_to(len(self.open) - 1)
            over = self.open[-1]
        hidden = over.none or not over.shown or not over.drawn or over.tag == "details" and over.number == 0
        if hidden or over.tag in ("table", "tr", "tbody", "thead", "tfoot") and not text.strip(" \t\n\f\r"):
            return
        self.out[-1].write(text if raw in ("plaintext", "xmp") else html.unescape(text), bool(self.kept))


def styles_of(found: list[tuple[str, str, str]]) -> Styles:
    """The rules of all style sheets of a page that a screen meets, without those in templates and noscript."""
    out, unseen, met = Styles(), 0, True
    for kind, name, more in found:
        if kind == "text":
            if more == "style" and met and not unseen:
                out.read(name)
        elif name in ("template", "noscript"):
            unseen = max(0, unseen + (1 if kind == "start" else -1))
        elif name == "style" and kind == "start":
            given = attributes(more) if more.strip() else {}
            met = screen_meets(given.get("media", "")) and given.get("type", "").lower() in ("", "text/css")
    return out


def render(page: str | None) -> str:
    """All visible text of a page.

    Blocks stand apart as in a browser (paragraphs, headings, lists and tables with a blank line), list items
    carry a dash or their number and are indented, quotations have "> ", the columns of tables are aligned
    (two blanks between them), preformatted text keeps its white space. Not visible: the head, scripts, styles,
    templates, fallback content, elements that are hidden by attribute, by inline style or by a rule of the page
    (tags, classes, ids and attributes of an element and of those around it; see ``Styles``) that a desktop screen meets, and closed details but for their
    summary. Of svg and math the text that they draw is visible.

    Cases: a null or empty page gives an empty text; end tags that are missing or stray and tags that are
    cut off do not fail; elements deeper than ``DEEPEST`` are treated as siblings; indentation ends at ``INDENTS`` levels and columns
    are padded up to ``WIDEST`` places, without losing text.
    """
    if not page:
        return ""
    found = list(tokens(page))
    r = Renderer(styles_of(found))
    for kind, name, more in found:
        if kind == "text":
            r.text(name, more)
        elif kind == "start":
            r.start(name, more)
        else:
            r.end(name)
    r._close_to(1)
    return "\n".join(r.out[0].text())
