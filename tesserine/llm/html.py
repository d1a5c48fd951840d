"""HTML to text by layout: tree with implied tags, visibility rules, blocks, lists and aligned tables.

A small tokenizer feeds a tree builder that closes elements as HTML implies it (a paragraph before
a block, a list item before the next, cells and rows inside tables), opens the rows that cells
imply, and puts what stands between cells and rows before the table. The renderer walks the tree
and writes what a reader would see: hidden elements give nothing, blocks start on their own lines
and keep their blank lines, list items carry bullets or numbers and are indented by depth, and the
cells of a table are padded to common columns.

Elements may be nested to any depth: the builder keeps its own stack, and the renderer is a
generator per element that a loop drives, so neither recurses.

Defined cases: null and empty pages give empty text; unclosed tags, comments and quotes run to
the end; a null id is kept; repeated rows repeat; an empty table gives an empty result. Rules of style
elements are not applied: visibility comes from elements, attributes and style attributes.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import map_texts

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|<([A-Za-z][^\s/>]*+)(?:((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLANK = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
UNSEEN = frozenset("head rp script style title meta link template noscript iframe noembed noframes object audio video canvas datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption thead tbody tfoot figcaption details summary dialog legend option optgroup center menu".split())
#: Inputs that show a label, and the one that they have without a value.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
#: Not shown inside svg and math.
DRAWN_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
#: Elements inside svg and math whose content is HTML again, and HTML that ends a drawing.
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_DRAWING = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Parts of a table outside cells, and what may stand in them; all else moves before the table.
FRAME = frozenset("table thead tbody tfoot tr".split())
#: The greatest spans of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
IN_FRAME = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
#: start tag -> (open elements that it closes, elements that stop the search)
LISTS = frozenset("ul ol menu dl".split())
IMPLIED = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), LISTS),
    "dd": (frozenset(["dt", "dd"]), LISTS),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    **{t: (frozenset("tr td th thead tbody tfoot caption colgroup".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}
#: start tag -> parts of a table in which it stands
STANDS_IN = {"td": FRAME, "th": FRAME, "tr": FRAME - {"tr"}, **{t: frozenset(["table"]) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")}}
CLOSES_P = BLOCK - frozenset("html body tr thead tbody tfoot caption option optgroup legend summary".split())
STOPS_P = frozenset("td th caption button table html object".split())


class Element:
    __slots__ = ("tag", "attrs", "kids", "drawn")

    def __init__(self, tag: str, attrs: str = "", drawn: bool = False):
        self.tag, self.attrs, self.kids, self.drawn = tag, attrs, [], drawn

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(self.attrs)} if self.attrs else {}


class Stack(list):
    """Open elements, with how many of each tag are open, so that a search for a tag that isn't open costs nothing."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.open = {root.tag: 1}

    def push(self, element: Element) -> None:
        self.append(element)
        self.open[element.tag] = self.open.get(element.tag, 0) + 1

    def cut(self, at: int) -> None:
        """Close all elements from ``at`` on."""
        while len(self) > at:
            self.open[self.pop().tag] -= 1

    def has(self, tags) -> bool:
        return any(self.open.get(t) for t in tags)


def parse(page: str) -> Element:
    """The tree of a page; texts are strings among the children."""
    root = Element("#page")
    stack, at = Stack(root), 0

    def close(tags, stops):
        if stack.has(tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    stack.cut(i)
                    return True
                if stack[i].tag in stops:
                    return False
        return False

    def table_at() -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "table"), 0) if stack.has(("table",)) else 0

    def add(kid) -> None:
        """Append to the open element; between the cells of a table, before the table (which is its parent's last child)."""
        if stack[-1].tag == "colgroup" and (kid.tag != "col" if isinstance(kid, Element) else kid.strip(" \t\n\r\f")):
            stack.cut(len(stack) - 1)
        if stack[-1].tag in FRAME and (kid.tag not in IN_FRAME if isinstance(kid, Element) else kid.strip(" \t\n\r\f")) and (i := table_at()):
            stack[i - 1].kids.insert(-1, kid)
        else:
            stack[-1].kids.append(kid)

    def drawing() -> int:
        """Where an open svg or math stands whose rules hold here, or 0."""
        if drawn and drawn[0] < len(stack) and stack[drawn[0]] is drawn[1]:
            for i in range(len(stack) - 1, drawn[0] - 1, -1):
                if stack[i].tag in ("svg", "math"):
                    return i
                if stack[i].tag in HTML_AGAIN:
                    return 0
        return 0

    drawn = None  # outermost drawing: its place in the stack and itself
    while m := TAG.search(page, at):
        if m.start() > at:
            add(unescape(page[at : m.start()]))
        at = m.end()
        if m[2] and m[2].lower() in ("pre", "listing", "textarea"):  # a line break right behind the tag doesn't count
            at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                add(Element("br"))
            elif tag not in VOID:
                close((tag,), ("table",) if tag not in ("table", "body", "html") else ())
            continue
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3] or m[4] or ""
        if tag == "plaintext" and not (drawn and drawing()):
            if "p" in stack.open:
                close(("p",), STOPS_P)
            block = Element("pre")
            block.kids.append(page[at:])
            add(block)
            return root
        inside = drawing() if drawn else 0
        if inside and tag in ENDS_DRAWING:
            stack.cut(inside)
            inside = 0
        if tag == "table":  # one that opens between the cells of another ends that one
            part = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in FRAME or stack[i].tag in STOPS_P), 0) if stack.has(FRAME) else 0
            if stack[part].tag in FRAME:
                stack.cut(table_at() or len(stack))
        if tag in CLOSES_P:
            close(("p",), STOPS_P)
        if tag in IMPLIED:
            while close(*IMPLIED[tag]):
                pass
        if tag in STANDS_IN and (i := table_at()):
            while len(stack) > i + 1 and stack[-1].tag not in STANDS_IN[tag]:
                stack.cut(len(stack) - 1)
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Element("tr")
                stack[-1].kids.append(row)
                stack.push(row)
        element = Element(tag, attrs.rstrip("/"), bool(inside))
        in_frame = stack[-1].tag in FRAME
        add(element)
        if inside and attrs.endswith("/") or tag == "form" and in_frame:
            continue  # a form between cells holds nothing
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if tag in ("textarea", "title"):
                element.kids.append(unescape(page[at : end.start() if end else len(page)]))
            at = end.start() if end else len(page)
            if end:
                at = (page.find(">", at) + 1) or len(page)
        elif tag not in VOID:
            if tag in ("svg", "math") and not inside:
                drawn = len(stack), element
            stack.push(element)
    if at < len(page):
        add(unescape(page[at:]))
    return root


class Lines:
    """Text laid out in lines: words flow, blocks break lines, margins leave at most one blank line."""

    def __init__(self):
        self.done: list[str] = []
        self.now, self.space, self.gap, self.indent, self.bullet = [], False, 0, "", ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.line()
                if part:
                    self._put(part)
            return
        words = BLANK.sub(" ", s)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if words:
            tail = words.endswith(" ")
            self._put((" " if self.space and self.now else "") + words.rstrip(" "))
            self.space = tail

    def _put(self, s: str) -> None:
        if not self.now:
            if self.gap and self.done:
                self.done += [""] * (self.gap - 1)
            self.gap = 0
            self.now.append(self.indent + self.bullet)
            self.bullet = ""
        self.now.append(s)

    def line(self) -> None:
        """End the line; an empty one stays (as after two breaks)."""
        if not self.now:
            if self.gap and self.done:
                self.done += [""] * (self.gap - 1)
            self.gap = 0
        self.done.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def block(self, margin: int) -> None:
        if self.now:
            self.line()
        self.gap = max(self.gap, 1 + margin)
        self.space = False

    def result(self) -> list[str]:
        if self.now:
            self.line()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


def _hidden(element: Element, tag: str) -> bool:
    if tag in UNSEEN or element.drawn and tag in DRAWN_UNSEEN:
        return True
    if not element.attrs:
        return tag == "dialog"
    a = element.attributes()
    display = _declared(a, "display")
    return display == "none" or "hidden" in a and not display or tag == "input" and a.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in a


def _declared(attributes: dict[str, str], name: str) -> str:
    """What a style attribute says last of a property, or nothing; what is marked important goes before the rest."""
    found, strong = "", False
    for part in attributes.get("style", "").lower().split(";"):
        key, _, value = part.partition(":")
        if key.strip() == name and value.strip():
            value, mark, _ = value.partition("!")
            if bool(mark) >= strong:
                found, strong = value.strip(), bool(mark)
    return found


def _seen(element: Element, shown: bool) -> bool:
    if element.attrs and "visibility" in element.attrs.lower():
        said = _declared(element.attributes(), "visibility")
        return False if said in ("hidden", "collapse") else True if said == "visible" else shown
    return shown


def render(element: Element, lines: Lines) -> None:
    """Write what a reader of the element sees; the parts of an element run one after the other, whatever their depth."""
    running = [_shown(element, lines)]
    while running:
        part = next(running[-1], None)
        if part is None:
            running.pop()
        else:
            running.append(part)


def _shown(element: Element, lines: Lines, pre: bool = False, shown: bool = True, depth: int = 0):
    """Renders an element; yields the parts that must run before it goes on."""
    number = _whole(element.attributes().get("start", ""), 1) - 1 if element.tag == "ol" and element.attrs else 0
    closed = element.tag == "details" and "open" not in element.attributes()  # only its summary shows
    for kid in element.kids:
        if isinstance(kid, str):
            if shown and not closed:
                lines.text(kid, pre)
            continue
        tag = kid.tag
        if _hidden(kid, tag) or closed and tag != "summary":
            continue
        seen = _seen(kid, shown)
        if tag == "br":
            if seen:
                lines.line()
            continue
        if tag == "input":
            if seen and kid.attrs:
                a = kid.attributes()
                if a.get("type", "").lower() in BUTTONS:
                    lines.text(a.get("value", BUTTONS[a["type"].lower()]), False)
            continue
        if tag == "table":
            lines.block(1)
            yield _table(kid, lines, depth, seen)
            lines.block(1)
            continue
        if tag not in BLOCK and not (tag == "text" and kid.drawn):
            yield _shown(kid, lines, pre or tag == "textarea", seen, depth)
            continue
        margin = int(tag in SPACED and not (tag in LISTS and depth))
        lines.block(margin)
        indent = lines.indent
        if tag == "li":
            number = _whole(kid.attributes().get("value", ""), number + 1) if kid.attrs else number + 1
            lines.bullet = f"{number}. " if element.tag == "ol" else "- "
            yield _shown(kid, lines, pre, seen, depth)
            lines.bullet = ""
        elif tag in ("ul", "ol", "menu"):
            lines.indent += "  " * bool(depth)
            yield _shown(kid, lines, pre, seen, depth + 1)
        elif tag in ("blockquote", "dd"):
            lines.indent += "  "
            yield _shown(kid, lines, pre, seen, depth)
        else:
            yield _shown(kid, lines, pre or tag == "pre", seen, depth)
        lines.block(margin)
        lines.indent = indent


def _rows(table: Element, shown: bool):
    """The rows of each section: a list of their cells, each with whether its text is visible; a section ends with None."""
    for kid in table.kids:
        if isinstance(kid, Element) and not _hidden(kid, kid.tag):
            seen = _seen(kid, shown)
            if kid.tag == "tr":
                yield [(c, _seen(c, seen)) for c in kid.kids if isinstance(c, Element) and c.tag in ("td", "th") and not _hidden(c, c.tag)]
            elif kid.tag in ("thead", "tbody", "tfoot"):
                yield None
                yield from _rows(kid, seen)
                yield None


def _whole(value: str, other: int) -> int:
    """A whole number at the start of an attribute, or ``other``."""
    m = re.match(r"\s*([+-]?[0-9]{1,9})", value)
    return int(m[1]) if m else other


def _span(cell: Element, name: str, most: int) -> int:
    value = cell.attributes().get(name, "1").strip() if cell.attrs else "1"
    return min(int(value[:9]), most) if value.isdecimal() and value.isascii() else 1


def _table(table: Element, lines: Lines, depth: int, shown: bool = True):
    """Captions and stray content first, then the rows with their cells padded to the widest of each column.

    A cell that spans rows keeps its columns free in the rows below, to the end of its section at most.
    """
    stray = Element("#stray")
    stray.kids = [k for k in table.kids if isinstance(k, str) and k.strip() or isinstance(k, Element) and k.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col")]
    yield _shown(stray, lines, shown=shown, depth=depth)
    lines.block(0)
    grid: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    held: list[tuple[int, int, int]] = []  # columns from and to that cells of earlier rows hold, and up to which row; in order
    for at, row in enumerate(_rows(table, shown)):
        if row is None:
            held = []
            continue
        held = [h for h in held if h[2] >= at]
        cells, col, nth, new = [], 0, 0, []
        for cell, seen in row:
            while nth < len(held) and held[nth][0] <= col:
                col, nth = max(col, held[nth][1]), nth + 1
            inner = Lines()
            yield _shown(cell, inner, shown=seen)
            text = inner.result()
            across, down = max(1, _span(cell, "colspan", MOST_COLUMNS)), _span(cell, "rowspan", MOST_ROWS)
            cells.append((col, text))
            width = max(map(len, text), default=0) if across == 1 else 0
            widths[col] = max(widths.get(col, 0), width)
            if down != 1:  # 0 holds to the end of the section
                new.append((col, col + across, at + (down or MOST_ROWS) - 1))
            col += across
        held = sorted(held + new) if new else held
        grid.append(cells)
    starts, at = {}, 0
    for col in sorted(widths):
        starts[col] = at
        at += widths[col] + 2
    for cells in grid:
        for i in range(max((len(t) for _, t in cells), default=0)):
            out = ""
            for col, text in cells:
                out = out.ljust(starts[col]) if len(out) <= starts[col] or not out else out + "  "
                out += text[i] if i < len(text) else ""
            if out.strip():
                lines.text(out, True)
            lines.block(0)


def page_text(page: str | None) -> str:
    if not page:
        return ""
    lines = Lines()
    render(parse(page), lines)
    return "\n".join(lines.result())


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its id and the visible ``text``."""
    return map_texts(df, lambda: lambda pages: [[page_text(p) for p in pages]], [("text", T.StringType())], id_col, html_col)


def extracted(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The text with its length and number of lines."""
    return extract_text(df, id_col, html_col).select(id_col, "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
