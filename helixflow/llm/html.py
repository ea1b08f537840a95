"""HTML extraction by layout-aware rendering.

A scanner cuts a page into tags, comments and text; a tree builder with implied tags (table sections and rows; p, li,
dd, option, tr, td and others that end where the standard lets them; text that stands in a table but in no cell goes
before the table) makes a tree; visibility rules drop what a browser does not show: head matter, scripts, styles,
templates, media and fallbacks of what a browser can show, hidden and display:none elements, visibility:hidden (but not
visibility:visible within it), closed dialogs and the body of closed details. Style sheets are not read. The renderer
writes all visible text: blocks on lines of their own with an empty line between paragraphs, headings and tables, line
breaks, list marks with nesting, numbers and their styles, preformatted text as it is, options and text areas, text of
svg and math, and table cells, over rows and columns that they span, padded to aligned columns as wide as they show.

Scanner, builder and renderer each pass over the page once, without recursion, so time and memory grow with the page,
however deep or broken it is. Only layout has bounds, never text: indents stop growing at INDENT, and tables are
written cell by cell instead of aligned if they lie deeper than GRIDS in others or if alignment would take more than
PADDING times their own characters.

Defined results: null and empty pages give an empty text; broken markup is repaired as above and never fails; a "<"
that starts no tag is text; a quoted value without a closing quote ends like one without quotes; a tag that the page
ends in is no text. Rows are independent: repeated rows give repeated results, an empty table gives an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_arrays, with_schema

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: Raw elements whose text has character references.
ESCAPABLE = frozenset("textarea title".split())
INVISIBLE = frozenset("head script style template noscript title meta link base iframe noembed noframes audio video canvas datalist rp meter progress".split())
INVISIBLE_SVG = frozenset("title desc defs metadata style script symbol clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table caption tr ul xmp textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu table pre listing xmp plaintext textarea blockquote figure fieldset hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp dd dt li".split())
HEAD_TAGS = frozenset("base link meta title style script noscript template".split())
LISTS = frozenset("ul ol menu dir".split())
PREFORMATTED = frozenset("pre listing xmp plaintext textarea".split())
#: What a new tag closes, and where the search for it stops.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr caption colgroup", "table"),
    "td": ("td th caption colgroup", "table tr"),
    "th": ("td th caption colgroup", "table tr"),
    "caption": ("caption colgroup thead tbody tfoot", "table"),
    "thead": ("thead tbody tfoot tr caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr caption colgroup", "table"),
    "rt": ("rt rp", "ruby"),
    "rp": ("rt rp", "ruby"),
}
ENDS = {k: (a.split(), b.split()) for k, (a, b) in ENDS.items()}
#: No p, list item or closing tag is looked for beyond these.
SCOPE = "table td th caption button object template html svg math".split()
FOREIGN = ("svg", "math")
#: Tags that end svg and math.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_IN_FOREIGN = ("foreignobject", "annotation-xml", "desc")
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
IN_TABLE = {"table": "caption colgroup col thead tbody tfoot tr td th", "thead": "tr td th", "tbody": "tr td th", "tfoot": "tr td th", "tr": "td th"}
IN_TABLE = {k: frozenset(v.split()) | {"script", "style", "template"} for k, v in IN_TABLE.items()}
#: Columns of indent up to which lists and quotes are indented.
INDENT = 64
#: Nested tables that are aligned, and how much longer than its text alignment may make a table.
GRIDS = 4
PADDING = 16

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_LONG_NUMBER = re.compile(r"&#(?:[xX]0*[0-9a-fA-F]{7,}|0*[0-9]{8,});?")
_LONG_ZEROS = re.compile(r"&#([xX]?)0{8,}(?=[0-9a-fA-F])")
_INTEGER = re.compile(r"\s*([+-]?[0-9]{1,9})")
WANTED = frozenset("hidden style open type value alt start reversed colspan rowspan label".split())


def _plain(s: str) -> str:
    """s with character references resolved; numbers beyond all characters give the replacement character."""
    if "&" not in s:
        return s
    if "&#" in s:
        s = _LONG_NUMBER.sub("�", _LONG_ZEROS.sub(r"&#\1", s))
    return unescape(s)


class Node:
    __slots__ = ("attrs", "children", "foreign", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs or {}, [], foreign

    def number(self, name: str, default: int | None = None) -> int | None:
        m = _INTEGER.match(self.attrs.get(name, ""))
        return int(m[1]) if m else default

    def styles(self) -> dict[str, str]:
        """Values of the style attribute; of one property the last counts, before all one that is important."""
        out: dict[str, str] = {}
        kept = set()
        for part in re.sub(r"/\*.*?(?:\*/|$)", "", self.attrs.get("style", ""), flags=re.S).split(";"):
            name, colon, value = part.partition(":")
            name, value = name.strip().lower(), value.strip().lower()
            important = value.endswith("!important")
            if colon and (important or name not in kept):
                out[name] = value.removesuffix("!important").strip()
                if important:
                    kept.add(name)
        return out


class Builder:
    """Makes a tree of Nodes and strings; open elements are found by tag without a search through the stack."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        #: Places in the stack of the open elements of each tag.
        self.open: dict[str, list[int]] = {"html": [0]}
        #: Places of the open blocks.
        self.blocks = [0]
        self.title: Node | None = None

    def last(self, tags) -> int:
        """Place of the nearest open element of these tags, or -1."""
        found = -1
        for t in tags:
            places = self.open.get(t)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def cut(self, place: int) -> None:
        """Closes the element at place and all in it."""
        while len(self.stack) > place:
            self.open[self.stack.pop().tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def close(self, tags, stop) -> None:
        """Closes the nearest open element of these tags unless one of stop is nearer."""
        place = self.last(tags)
        if place > 0 and place > self.last(stop):
            self.cut(place)

    def put(self, what: Node | str, in_table: bool) -> None:
        """Appends to the open element, or before the table where it stands in a table but in no cell."""
        if in_table or self.stack[-1].tag not in TABLE_PARTS or self.stack[-1].foreign:
            self.stack[-1].children.append(what)
            return
        table = self.last(["table"])
        if table < 1:
            self.stack[-1].children.append(what)
            return
        into = self.stack[table - 1].children
        into.insert(len(into) - 1, what)

    def push(self, node: Node) -> None:
        self.put(node, node.tag in IN_TABLE.get(self.stack[-1].tag, ()))
        self.open.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        """Opens an element; whether it stays open."""
        if self.stack[-1].tag == "colgroup" and tag != "col":
            self.cut(len(self.stack) - 1)
        if tag in BREAKS_OUT:
            while (place := self.last(FOREIGN)) > self.last(HTML_IN_FOREIGN):
                self.cut(place)
        elif tag in FOREIGN or self.last(FOREIGN) > self.last(HTML_IN_FOREIGN):
            self.push(Node(tag, attrs, foreign=True))
            if closed:
                self.cut(len(self.stack) - 1)
            return not closed
        if tag in ("html", "body"):
            self.close(["head"], ())
            if tag == "body" and self.last(["body"]) < 0:
                self.push(Node(tag, attrs))
            elif tag == "html":
                self.root.attrs = attrs | self.root.attrs
            return False
        if self.stack[-1].tag == "head" and tag not in HEAD_TAGS:
            self.cut(len(self.stack) - 1)
        if tag in ENDS:
            tags, stop = ENDS[tag]
            while (place := self.last(tags)) > 0 and place > self.last(stop) and (tag not in ("li", "dt", "dd") or place > self.last(SCOPE)):
                self.cut(place)
                if tag in ("li", "dt", "dd", "option"):
                    break
            top = self.stack[-1].tag
            if tag in ("tr", "td", "th") and top == "table":
                self.push(Node("tbody"))
                top = "tbody"
            if tag in ("td", "th") and top in ("thead", "tbody", "tfoot"):
                self.push(Node("tr"))
        if tag in CLOSES_P and self.open.get("p"):
            self.close(["p"], SCOPE)
        if tag == "table" and self.stack[-1].tag in TABLE_PARTS and (place := self.last(["table"])) > 0:
            self.cut(place)
        node = Node(tag, attrs)
        if tag in VOID:
            self.put(node, tag in IN_TABLE.get(self.stack[-1].tag, ()))
            return False
        self.push(node)
        if tag == "title" and self.title is None:
            self.title = node
        return True

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if self.last(["p"]) > self.last(SCOPE):
                self.close(["p"], SCOPE)
            else:
                self.put(Node("p"), False)
        elif tag not in ("html", "body"):
            place = self.last([tag])
            if tag in TABLE_PARTS or tag in ("td", "th", "caption"):
                if place > (self.last(["table"]) if tag != "table" else 0):
                    self.cut(place)
            elif place > 0 and place > self.last([x for x in SCOPE if x != tag]):
                # the end of an inline element does not end a block in it
                if tag in BLOCK or tag in SCOPE or self.blocks[-1] < place:
                    self.cut(place)

    def text(self, s: str) -> None:
        if s:
            if self.stack[-1].tag in ("head", "colgroup") and not s.isspace():
                self.cut(len(self.stack) - 1)
            self.put(s, s.isspace())


def _next(page: str, what: str, at: int, known: dict[str, int]) -> int:
    """Where what stands next from at on, or -1; known keeps what was found, so that a page is searched once."""
    place = known.get(what, 0)
    if 0 <= place < at or what not in known:
        place = known[what] = page.find(what, at)
    return place


def _attributes(page: str, at: int, known: dict[str, int]) -> tuple[int, dict[str, str], bool] | None:
    """(place after the tag, attributes, whether it ends in a slash) of a tag whose name ends at; None: the page ends in it."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        m = _ATTR.match(page, at)
        name, at = m[1], m.end()
        if at >= n:
            return None
        if name is None and not m[2]:
            if page[at] == ">":
                return at + 1, found, page[at - 1] == "/"
            at += 1
            continue
        value = ""
        if m[2]:
            quote = page[at]
            end = _next(page, quote, at + 1, known) if quote in "\"'" else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                b = _BARE.match(page, at)
                value, at = b[0].strip(quote) if quote in "\"'" else b[0], b.end()
        name = (name or "").lower()
        if name in WANTED and name not in found:
            found[name] = _plain(value)


def parse(page: str) -> Builder:
    b, at, n = Builder(), 0, len(page)
    known: dict[str, int] = {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            b.text(_plain(page[at:]))
            break
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if m is None and not closing and after not in ("!", "?"):
            # a "<" that starts no tag
            stop = page.find("<", lt + 1)
            stop = n if stop < 0 else stop
            b.text(_plain(page[at:stop]))
            at = stop
            continue
        if lt > at:
            b.text(_plain(page[at:lt]))
        if m is None:
            at = _skip(page, lt, b, known)
            continue
        tag = m[0].lower()
        got = _attributes(page, m.end(), known)
        if got is None:
            break
        at, attrs, slash = got
        if closing:
            b.end(tag)
        elif b.start(tag, attrs, slash) and tag in RAW and not b.stack[-1].foreign:
            close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at) if tag != "plaintext" else None
            stop = close.start() if close else n
            raw = page[at:stop]
            if raw:
                b.stack[-1].children.append(_plain(raw) if tag in ESCAPABLE else raw)
            b.cut(len(b.stack) - 1)
            end = page.find(">", stop)
            at = end + 1 if close and end >= 0 else n
    return b


def _skip(page: str, lt: int, b: Builder, known: dict[str, int]) -> int:
    """Where a comment, declaration or CDATA section that begins at lt ends."""
    n = len(page)
    if page.startswith("<!--", lt):
        if page.startswith((">", "->"), lt + 4):
            return page.index(">", lt) + 1
        ends = [(e, k) for e, k in ((_next(page, "-->", lt + 4, known), 3), (_next(page, "--!>", lt + 4, known), 4)) if e >= 0]
        return sum(min(ends)) if ends else n
    if page.startswith("<![CDATA[", lt) and b.stack[-1].foreign:
        end = page.find("]]>", lt)
        b.text(page[lt + 9 : end if end >= 0 else n])
        return end + 3 if end >= 0 else n
    end = page.find(">", lt)
    return end + 1 if end >= 0 else n


# ---------------------------------------------------------------- rendering


def width(s: str) -> int:
    """Columns that a line shows: wide characters take two, combining ones and controls none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Rendered lines; `gap` empty lines are due before the next text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.chars = False, 0, 0
        self.prefix = ""
        #: Marks of list items without text yet: where they stand in the prefix.
        self.marks: list[tuple[int, str]] = []

    def word(self, s: str) -> None:
        """Text with white space collapsed."""
        parts = _SPACE.sub(" ", s)
        if parts == " ":
            self.space = self.space or bool(self.line)
            return
        body = parts.strip(" ")
        if self.line and (self.space or parts[:1] == " "):
            self.line.append(" ")
        if body:
            self.line.append(body)
        self.space = parts[-1:] == " "

    def end(self, gap: int = 0) -> None:
        """Ends the line, if it has text; then at least gap empty lines follow."""
        if self.line:
            self.put("".join(self.line).rstrip(" "))
        self.line, self.space = [], False
        self.gap = max(self.gap, gap)

    def put(self, line: str) -> None:
        if self.out:
            self.out += [""] * self.gap
        self.gap = 0
        self.chars += len(line)
        prefix = self.prefix
        for at, mark in self.marks:
            prefix = prefix[:at] + mark + prefix[at + len(mark) :]
        self.marks = []
        self.out.append(prefix + line)

    def indent(self, by: str) -> str:
        """Indents by more, and returns the indent before."""
        before = self.prefix
        if len(before) + len(by) <= INDENT:
            self.prefix = before + by
        return before


class Grid:
    """A table's rows of cells (column, span, lines), and the characters of its texts."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        #: Columns that cells of rows before still cover, by how many rows.
        self.covered: dict[int, int] = {}
        self.column, self.chars, self.cells, self.work = 0, 0, 0, 0

    def row(self) -> None:
        self.covered = {c: k - 1 for c, k in self.covered.items() if k > 1} if self.rows else {}
        self.rows.append([])
        self.column = 0
        self.work += len(self.covered)
        if self.work > PADDING * (self.cells + 64):  # spans far longer than the table has cells
            self.covered = {}

    def cell(self, lines: list[str], chars: int, across: int, down: int) -> None:
        while self.column in self.covered:
            self.column += 1
        across = max(1, min(across, 1000))
        self.rows[-1].append((self.column, across, lines))
        if down > 1 and across * 4 <= self.cells + 64:
            for c in range(self.column, self.column + across):
                self.covered[c] = down
        self.column += across
        self.chars += chars
        self.cells += 1

    def lines(self) -> list[str]:
        wide: dict[int, int] = {}
        sizes = [[[width(x) for x in cell[2]] for cell in row] for row in self.rows]
        for row, size in zip(self.rows, sizes):
            for (c, across, _), w in zip(row, size):
                wide[c] = max(wide.get(c, 0), *w, 0) if across == 1 else wide.get(c, 0)
        columns, x, at = sorted(wide), {}, 0
        for row, size in zip(self.rows, sizes):  # what spans columns widens the last of them
            for (c, across, _), w in zip(row, size):
                if 1 < across <= PADDING:
                    over = [i for i in range(c, c + across) if i in wide]
                    wide[over[-1]] += max(0, max(w) - sum(wide[i] for i in over) - 3 * (len(over) - 1))
        for c in columns:
            x[c] = at
            at += wide[c] + 3
        padded = sum(x[row[-1][0]] * max(len(cell[2]) for cell in row) for row in self.rows if row)
        aligned = padded <= PADDING * (self.chars + 4 * self.cells)
        order = {c: i for i, c in enumerate(columns)}
        out = []
        for row, size in zip(self.rows, sizes):
            high = max((len(cell[2]) for cell in row), default=0)
            if not aligned and high > 1:
                out += [line for cell in row for line in cell[2]]
                continue
            for k in range(high):
                parts: list[str] = []
                at, next_column, used = 0, 0, 0
                for (c, across, lines), w in zip(row, size):
                    i = order[c]
                    if aligned:
                        while next_column < i:  # columns without a cell here
                            at = _pad(parts, at, x[columns[next_column]])
                            parts.append(" | " if next_column + 1 < len(columns) else "")
                            next_column += 1
                            at = self._after(parts, at, x, columns, next_column)
                        at = _pad(parts, at, x[c])
                    if k < len(lines) and lines[k].strip():
                        parts.append(lines[k])
                        at += w[k]
                        used = len(parts)
                    if not aligned:
                        parts.append(" | ")
                        continue
                    stop = i + 1
                    while stop < len(columns) and columns[stop] < c + across:
                        stop += 1
                    if stop < len(columns):
                        at = _pad(parts, at, x[columns[stop]] - 3)
                        parts.append(" | ")
                        at += 3
                    next_column = stop
                if used:  # no separators after the last text
                    out.append("".join(parts[:used]).rstrip(" "))
        return out

    @staticmethod
    def _after(parts: list[str], at: int, x: dict[int, int], columns: list[int], column: int) -> int:
        """Pads the separator just written to the column's place."""
        if column < len(columns):
            bar = parts.pop()
            at = _pad(parts, at, x[columns[column]] - 3)
            parts.append(bar)
            at += 3
        return at


def _pad(parts: list[str], at: int, to: int) -> int:
    if to > at:
        parts.append(" " * (to - at))
        return to
    return at


def _roman(n: int) -> str:
    pairs = zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split())
    out = ""
    for v, s in pairs:
        out += s * (n // v)
        n %= v
    return out


def _mark(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        s, k = "", n
        while k:
            k, r = divmod(k - 1, 26)
            s = chr(97 + r) + s
    elif kind in ("i", "I") and 0 < n < 4000:
        s = _roman(n)
    else:
        return f"{n}. "
    return f"{s.upper() if kind.isupper() else s}. "


class Renderer:
    """Walks a tree with a stack of work: nodes to write, and functions that end what they began."""

    def __init__(self) -> None:
        self.lines = Lines()
        self.grids: list[Grid] = []

    def run(self, root: Node) -> str:
        # (node or text, seen: not visibility:hidden, preformatted), or a function
        work: list = [(c, True, False) for c in reversed(root.children)] if self._shown(root) else []
        while work:
            step = work.pop()
            if callable(step):
                step()
                continue
            node, seen, pre = step
            if isinstance(node, str):
                if seen:
                    self._text(node, pre)
                continue
            self._node(node, seen, pre, work)
        self.lines.end()
        return "\n".join(self.lines.out).rstrip()

    def _text(self, s: str, pre: bool) -> None:
        if not pre:
            self.lines.word(s)
            return
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.lines.line.append(first)
        for x in rest:
            self.lines.put("".join(self.lines.line))
            self.lines.line = [x] if x else []

    @staticmethod
    def _shown(node: Node) -> bool:
        tag, attrs = node.tag, node.attrs
        if tag in (INVISIBLE_SVG if node.foreign else INVISIBLE):
            return False
        if not attrs and tag != "dialog":
            return True
        display = node.styles().get("display") if "style" in attrs else None
        if display is not None:
            return display != "none"
        return not ("hidden" in attrs or (tag == "input" and attrs.get("type", "").strip().lower() == "hidden") or (tag == "dialog" and "open" not in attrs))

    def _node(self, node: Node, seen: bool, pre: bool, work: list) -> None:
        if not self._shown(node):
            return
        tag, lines, children = node.tag, self.lines, node.children
        display = ""
        if "style" in node.attrs:
            styles = node.styles()
            visibility, display = styles.get("visibility"), styles.get("display", "")
            if visibility in ("hidden", "collapse", "visible"):
                seen = visibility == "visible"
        inside = lambda these=children, s=seen, p=pre: work.extend((c, s, p) for c in reversed(these))
        if tag == "br":
            if seen:
                if lines.line:
                    lines.end()
                else:
                    lines.gap = max(lines.gap, 1)
        elif tag == "hr":
            lines.end(1)
        elif tag == "img" or (tag == "input" and node.attrs.get("type", "text").strip().lower() == "image"):
            if seen and node.attrs.get("alt"):
                lines.word(f" {node.attrs['alt']} ")
        elif tag == "input":
            if seen and node.attrs.get("value") and node.attrs.get("type", "text").strip().lower() not in ("checkbox", "radio", "password", "file", "range", "color", "hidden"):
                lines.word(f" {node.attrs['value']} ")
        elif tag == "table":
            self._table(node, seen, pre, work)
        elif tag in LISTS:
            self._list(node, seen, pre, work)
        elif tag in ("dd", "blockquote", "optgroup"):
            gap = int(tag == "blockquote")
            lines.end(gap)
            if tag == "optgroup" and seen and node.attrs.get("label"):
                lines.word(node.attrs["label"])
                lines.end()
            before = lines.indent("> " if gap else "  ")

            def finish(lines=lines, before=before, gap=gap) -> None:
                lines.end()
                lines.prefix = before
                lines.end(gap)

            work.append(finish)
            inside()
        elif tag == "details" and "open" not in node.attrs:
            lines.end()
            work.append(lambda lines=lines: lines.end())
            inside([c for c in children if not isinstance(c, str) and c.tag == "summary"][:1])
        elif tag in PREFORMATTED and not node.foreign:
            lines.end(1)
            if children and isinstance(children[0], str) and tag not in ("xmp", "plaintext"):
                # a line break just after the tag does not count
                children = [re.sub(r"^\r?\n", "", children[0]), *children[1:]]

            def close(lines=lines) -> None:
                if lines.line:
                    lines.put("".join(lines.line))
                    lines.line = []
                while lines.out and not lines.out[-1].strip() and lines.chars:
                    lines.out.pop()
                lines.end(1)

            work.append(close)
            inside(children, seen, True)
        elif (tag in BLOCK and not display.startswith("inline")) or display in ("block", "flex", "grid", "list-item", "table", "flow-root") or (node.foreign and tag in ("text", "svg", "mtr")):
            gap = int(tag in SPACED)
            lines.end(gap)
            work.append(lambda lines=lines, gap=gap: lines.end(gap))
            inside()
        elif node.foreign and tag in ("mtd", "tspan"):
            if seen:
                lines.word(" ")
            inside()
        else:
            inside()

    def _list(self, node: Node, seen: bool, pre: bool, work: list) -> None:
        lines = self.lines
        lines.end(0 if lines.prefix else 1)
        items = [c for c in node.children if not isinstance(c, str) and c.tag == "li" and self._shown(c)]
        kind = node.attrs.get("type", "1").strip()
        back = "reversed" in node.attrs
        number = node.number("start", len(items) if back else 1)
        steps: list = []
        for c in node.children:
            if isinstance(c, str) or c.tag != "li":
                steps.append((c, seen, pre))
                continue
            if not self._shown(c):
                continue
            number = c.number("value", number) if node.tag == "ol" else number
            mark = _mark(number, kind) if node.tag == "ol" else "- "
            number += -1 if back else 1
            visible = seen
            if "style" in c.attrs:
                visibility = c.styles().get("visibility")
                visible = visibility == "visible" if visibility in ("hidden", "collapse", "visible") else seen
            state: dict = {}

            def begin(mark=mark, state=state) -> None:
                lines.end()
                state["before"] = lines.indent(" " * len(mark))
                if lines.prefix != state["before"]:
                    lines.marks.append((len(state["before"]), mark))

            def finish(state=state) -> None:
                lines.end()
                lines.prefix, lines.gap = state["before"], 0
                lines.marks = [m for m in lines.marks if m[0] < len(state["before"])]

            steps += [begin, *((x, visible, pre) for x in c.children), finish]
        steps.append(lambda: lines.end(0 if lines.prefix else 1))
        work.extend(reversed(steps))

    def _table(self, node: Node, seen: bool, pre: bool, work: list) -> None:
        """Cells are written to lines of their own and aligned at the table's end, or, in tables of one column and in deep ones, at once."""
        captions: list = []
        rows: list[tuple[Node, list[Node]]] = []
        other: list = []
        parts = [c for c in node.children]
        parts.reverse()
        foot: list = []
        while parts:
            c = parts.pop()
            if isinstance(c, str):
                continue
            if not self._shown(c):
                continue
            if c.tag == "caption":
                captions.append(c)
            elif c.tag == "tr":
                rows.append((c, [x for x in c.children if not isinstance(x, str) and x.tag in ("td", "th") and self._shown(x)]))
                other += [x for x in c.children if not isinstance(x, str) and x.tag not in ("td", "th")]
            elif c.tag == "tfoot":
                foot.append(c)
            elif c.tag in ("thead", "tbody"):
                parts.extend(reversed(c.children))
            elif c.tag not in ("colgroup", "col"):
                other.append(c)
        for part in foot:  # shown last, wherever it stands
            for c in part.children:
                if not isinstance(c, str) and c.tag == "tr" and self._shown(c):
                    rows.append((c, [x for x in c.children if not isinstance(x, str) and x.tag in ("td", "th") and self._shown(x)]))
        outer = self.lines
        outer.end(1)
        steps: list = []
        for c in captions:
            steps += [*((x, seen, pre) for x in c.children), outer.end]
        for c in other:
            steps += [(c, seen, pre), outer.end]
        simple = all(len(cells) < 2 for _, cells in rows) or len(self.grids) >= GRIDS
        grid = Grid()
        if not simple:
            steps.append(lambda: self.grids.append(grid))
        for _, cells in rows:
            if not simple:
                steps.append(grid.row)
            for i, c in enumerate(cells):
                visible = seen
                if "style" in c.attrs:
                    visibility = c.styles().get("visibility")
                    visible = visibility == "visible" if visibility in ("hidden", "collapse", "visible") else seen
                content = [(x, visible, pre) for x in c.children]
                if simple:
                    if i:
                        steps.append(self._between)
                    steps += content
                else:
                    steps += [self._cell, *content, lambda c=c: self._cell_end(c, outer, grid)]
            if simple:
                steps.append(outer.end)

        def finish() -> None:
            if not simple:
                self.grids.pop()
                self.lines = outer
                for line in grid.lines():
                    outer.put(line)
                outer.chars += grid.chars
            outer.end(1)

        steps.append(finish)
        work.extend(reversed(steps))

    def _between(self) -> None:
        if self.lines.line:
            self.lines.line += [" | "]
            self.lines.space = False

    def _cell(self) -> None:
        self.lines = Lines()

    def _cell_end(self, cell: Node, outer: Lines, grid: Grid) -> None:
        self.lines.end()
        out = self.lines.out
        while out and not out[-1].strip():
            out.pop()
        grid.cell(out or [""], self.lines.chars, cell.number("colspan", 1), cell.number("rowspan", 1))
        self.lines = outer


def extract(page: str | None) -> str:
    """The visible text of a page."""
    return Renderer().run(parse(page).root) if page else ""


def _title_of(b: Builder) -> str:
    return _SPACE.sub(" ", "".join(c for c in b.title.children if isinstance(c, str))).strip(" ") if b.title else ""


def title(page: str | None) -> str:
    return _title_of(parse(page)) if page else ""


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with title and content (the visible text); columns of pages with these names are replaced."""

    def both(page: str | None) -> tuple[str, str]:
        if not page:
            return "", ""
        b = parse(page)
        return _title_of(b), Renderer().run(b.root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [both(x) for x in batch.column(html_col).to_pylist()]
            yield with_arrays(batch, {"title": pa.array([t for t, _ in found], pa.string()), "content": pa.array([c for _, c in found], pa.string())})

    return pages.mapInArrow(run, with_schema(pages, "title string, content string"))
