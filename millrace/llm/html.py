"""Visible text of web pages by layout-aware rendering (operator 4)."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, modest, strings

# Fixed values of the HTML standard: which elements are void, raw, hidden, blocks, and which tags imply an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: Levels of lists that are shown by indentation; deeper ones stand as far in.
DEEPEST = 40
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist object svg math audio video canvas".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
BLOCKS = frozenset("html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section summary table caption tbody thead tfoot tr td th ul xmp".split())
SPACED = frozenset("p blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol ul dir menu pre listing table xmp hr article section".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
}
#: An end tag looks no further up than these, so a stray one cannot close what holds a cell or a list item.
SCOPE = frozenset("html table td th caption template".split())
#: What may stand directly in the parts of a table; all else is moved out, before the table.
TABLE_PARTS = {"table": frozenset("caption colgroup col tbody thead tfoot".split()), "tbody": frozenset(["tr"]), "thead": frozenset(["tr"]), "tfoot": frozenset(["tr"]), "tr": frozenset(["td", "th"]), "colgroup": frozenset(["col"])}
#: Types of input whose value is not shown as text.
NO_VALUE = frozenset("hidden password checkbox radio file image range color".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())

# A quote opens a value only right after the '=' of a name; elsewhere, and where it is never closed, it is a plain character.
_NAME = r"(?:=[^ \t\n\r\f/>=]*+|[^ \t\n\r\f/>=]++)"
_EQUALS = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+"
_UNQUOTED = r"[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[ \t\n\r\f/]++|{_NAME}(?:{_EQUALS}(?:\"[^\"]*+\"|'[^']*+'|{_UNQUOTED})?+)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_EQUALS}(?:\"([^\"]*+)\"|'([^']*+)'|({_UNQUOTED}))?+)?+")
_NO_BOX = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "home")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.home: Node | None = None  # of a part of a table: the element that holds the outermost such table, as its last child


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


class TreeBuilder:
    """A tree from tag soup: implied html, head, body, tbody and tr, implied end tags, unmatched end tags ignored.

    Text and elements that may not stand where they are in a table go before it, as the HTML standard has it.
    """

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        #: Where on the stack the elements of each tag stand, but for the root: depth costs nothing to look through.
        self.open: dict[str, list[int]] = {}
        self.in_head = True

    def top(self) -> Node:
        return self.stack[-1]

    def text(self, s: str) -> None:
        if s and (not self.in_head or s.strip(" \t\n\r\f")):
            if self.in_head and self.top().tag in ("html", "head"):
                self.body({})
            if self.top().home and not s.strip(" \t\n\r\f"):
                return
            self.add(s)

    def add(self, child: Node | str) -> None:
        """Into the open element, or before the table if a part of one is open in which the child may not stand."""
        top = self.top()
        if top.home and (isinstance(child, str) or child.tag not in TABLE_PARTS[top.tag]):
            top.home.children.insert(-1, child)
        else:
            top.children.append(child)

    def body(self, attrs: dict[str, str]) -> None:
        if self.in_head:
            self.in_head = False
            self.cut(1)
            self.push(Node("body", attrs))

    def push(self, node: Node) -> None:
        if node.tag in TABLE_PARTS:
            node.home = self.top().home or (self.top() if node.tag == "table" else None)
        self.add(node)
        self.open.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, size: int) -> None:
        """Close all but the outermost ``size`` elements."""
        while len(self.stack) > size:
            places = self.open[self.stack.pop().tag]
            places.pop()

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of ``tags``, 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        """Close the innermost open element of ``tags`` and all in it, unless a barrier stands between."""
        k = self.innermost(tags)
        if k and k >= self.innermost(barriers) and k >= self.innermost(SCOPE):
            self.cut(k)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if tag == "head":
            if self.in_head and len(self.stack) == 1:
                self.push(Node("head", attrs))
            return
        if tag == "body":
            self.body(attrs)
            return
        if self.in_head:
            if tag in HEAD_ONLY:
                if len(self.stack) == 1:
                    self.push(Node("head", {}))
            elif self.top().tag in ("html", "head"):
                self.body({})
        if tag in ENDS_P:
            self.close(("p",), ())
        if tag in HEADINGS and self.top().tag in HEADINGS:
            self.cut(len(self.stack) - 1)
        if tag in IMPLIED_END:
            tags, barriers = IMPLIED_END[tag]
            if tag in ("tr", "tbody", "thead", "tfoot"):
                self.back_to_table(("table", "tbody", "thead", "tfoot") if tag == "tr" else ("table",))
            elif tag in ("td", "th"):
                self.back_to_table(("table", "tbody", "thead", "tfoot", "tr"))
            else:
                self.close(tags, barriers)
        if tag == "tr" and self.top().tag == "table":
            self.push(Node("tbody", {}))
        if tag in ("td", "th"):
            if self.top().tag == "table":
                self.push(Node("tbody", {}))
            if self.top().tag in ("tbody", "thead", "tfoot"):
                self.push(Node("tr", {}))
        if tag == "a":
            self.close(("a",), ())
        node = Node(tag, attrs)
        if tag in VOID:
            self.add(node)
        else:
            self.push(node)

    def back_to_table(self, tags: tuple[str, ...]) -> None:
        """Close open cells, rows and sections of the innermost table, as far as ``tags``."""
        k = self.innermost(tags)
        if k and k >= self.innermost(("table",)):
            self.cut(k + 1)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.in_head and len(self.stack) > 1 and self.stack[1].tag == "head":
                self.cut(1)
            return
        if tag == "br":
            self.start("br", {})
            return
        same = HEADINGS if tag in HEADINGS else (tag,)
        k, wall = self.innermost(same), self.innermost(("table",))
        if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
            wall = max(wall, self.innermost(SCOPE))
        if tag in FORMATTING:
            wall = max(wall, self.innermost(BLOCKS))
        if k and k >= wall:
            self.cut(k)
        elif tag == "p":
            self.start("p", {})
            self.cut(len(self.stack) - 1)


def parse(page: str) -> Node:
    """The tree of a page. Never fails: what is no tag is text."""
    builder, at = TreeBuilder(), 0
    page = page.replace("\r\n", "\n").replace("\0", "")
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            builder.text(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            builder.end(m[1].lower())
        elif m[2]:
            tag = m[2].lower()
            builder.start(tag, attributes(m[3]) if m[3] and m[3] != "/" else {})
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                stop = close.start() if close and tag != "plaintext" else len(page)
                body = page[at:stop]
                if tag in ("title", "textarea"):
                    body = entities.unescape(body)
                if body:
                    builder.top().children.append(body)
                at = stop
        elif page.startswith("<![CDATA[", m.start()):
            builder.text(page[m.start() + 9 : m.end()].removesuffix("]]>"))
    if at < len(page):
        builder.text(entities.unescape(page[at:]))
    return builder.root


def boxed(node: Node) -> bool:
    """Whether the element has a box at all; without one nothing in it is rendered. Left out by rule: svg and math."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a:
        return False
    return not (a and ("style" in a and _NO_BOX.search(a["style"]) or node.tag == "dialog" and "open" not in a))


def seen_in(node: Node, seen: bool) -> bool:
    """Whether text of the element shows: visibility is inherited, and a descendant may turn it on again."""
    found = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else None
    return found[-1].lower() == "visible" if found else seen


def chosen(select: Node) -> list[Node]:
    """The options that a select shows: all of a list box, else the last one marked as selected, or the first."""
    options, todo = [], select.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and boxed(c):
            if c.tag == "option":
                options.append(c)
            else:
                todo += c.children[::-1]
    size = select.attrs.get("size", "1")
    if "multiple" in select.attrs or size.isdecimal() and int(size) > 1:
        return options
    return ([o for o in options if "selected" in o.attrs] or options[:1])[-1:]


def columns(text: str) -> int:
    """Places that a string takes in a fixed-width font."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Lines:
    """Lines of rendered text: white space collapses, blocks begin new lines, gaps do not add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.pending = False
        self.gap = 0

    def put(self, text: str) -> None:
        if self.now == [] and self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        if self.now == []:
            self.gap = 0
        self.now.append(text)

    def flow(self, text: str) -> None:
        s = _SPACE.sub(" ", text)
        if not s:
            return
        if s == " ":
            self.pending = True
            return
        if s[0] == " " or self.pending:
            if self.now and not self.now[-1].endswith("\t"):
                self.put(" ")
            s = s.lstrip(" ")
        self.pending = s[-1] == " "
        self.put(s.rstrip(" ") if self.pending else s)

    def verbatim(self, text: str) -> None:
        first, *rest = text.expandtabs(8).split("\n")
        if first:
            self.put(first)
        for line in rest:
            self.line(keep=True)
            if line:
                self.put(line)

    def line(self, keep: bool = False) -> None:
        """End the line if it holds anything (or ``keep``)."""
        if self.now or keep:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.pending = False

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.line()
        return self.lines


def rendered(node: Node, seen: bool = True) -> Generator:
    """Lines of all visible text in the element. Asks ``laid_out`` for the lines of each table."""
    out = Lines()
    # an explicit stack: pages may nest deeper than Python's calls. Entries are nodes to enter or actions on leaving.
    todo: list[tuple] = [(0, c, False, 0, seen) for c in reversed(node.children)]
    while todo:
        kind, item, pre, depth, seen = todo.pop()
        if kind:
            item()
            continue
        if isinstance(item, str):
            if seen:
                out.verbatim(item) if pre else out.flow(item)
            continue
        if not boxed(item):
            continue
        tag, seen = item.tag, seen_in(item, seen)
        if tag == "br":
            out.line(keep=True)
            continue
        if tag == "img":
            if seen and item.attrs.get("alt"):
                out.flow(item.attrs["alt"])
            continue
        if tag == "input":
            if seen and item.attrs.get("type", "text").lower() not in NO_VALUE and item.attrs.get("value"):
                out.flow(item.attrs["value"])
            continue
        if tag == "select":
            options = chosen(item)
            if len(options) == 1:
                todo += [(0, c, False, depth, seen_in(options[0], seen)) for c in reversed(options[0].children)]
            else:
                todo += [(0, o, False, depth, seen) for o in reversed(options)]
            continue
        if tag == "table":
            out.block(2)
            for row in (yield table_lines(item, seen)):
                out.put(row)
                out.line(keep=True)
            out.block(2)
            continue
        if tag == "hr":
            out.block(2)
            continue
        gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and depth) else 1 if tag in BLOCKS else 0
        if gap:
            out.block(gap)
        nested = depth + (tag in ("ul", "ol", "menu", "dir"))
        if tag in ("ul", "ol", "menu", "dir"):
            number = int(item.attrs["start"]) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", item.attrs.get("start", "")) else 1
            for c in item.children:
                if isinstance(c, Node) and c.tag == "li":
                    if tag == "ol" and re.fullmatch(r"-?\d{1,9}", c.attrs.get("value", "")):
                        number = int(c.attrs["value"])
                    c.attrs = c.attrs | {" mark": "  " * min(depth, DEEPEST) + (f"{number}. " if tag == "ol" else "- ")}
                    number += 1
        if tag == "li" and seen and any(isinstance(c, Node) or c.strip() for c in item.children):
            out.put(item.attrs.get(" mark", "- "))
        if tag == "dd":
            out.put("    ")
        if tag == "q" and seen:
            out.flow("“")
        inner = pre or tag in ("pre", "listing", "xmp", "textarea", "plaintext")
        if gap:
            todo.append((1, lambda g=gap: out.block(g), False, 0, seen))
        if tag == "q" and seen:
            todo.append((1, lambda: out.put("”"), False, 0, seen))
        todo += [(0, c, inner, nested, seen) for c in reversed(item.children)]
    return out.done()


def span(cell: Node, name: str, most: int) -> int:
    v = cell.attrs.get(name, "1")
    return max(1, min(most, int(v))) if v.isdecimal() else 1


def table_lines(table: Node, seen: bool) -> Generator:
    """Rows of a table with their cells aligned in columns two spaces apart; spans take their places; a caption stands first.

    The tree builder leaves nothing in a table but its parts. Asks ``laid_out`` for the lines of each cell.
    """
    caption, rows = [], []
    order = {"thead": 0, "tbody": 1, "tfoot": 2}
    sections = [c for c in table.children if c.tag in order and boxed(c)]
    for c in table.children:
        if c.tag == "caption" and boxed(c):
            caption += yield rendered(c, seen_in(c, seen))
    for section in sorted(sections, key=lambda s: order[s.tag]):
        shown = seen_in(section, seen)
        rows += [(r.children, seen_in(r, shown)) for r in section.children if boxed(r)]
    grid: list[dict[int, list[str]]] = []
    wide: dict[int, int] = {}
    held: dict[int, int] = {}
    spans: list[dict[int, int]] = []
    for row, shown in rows:
        line, at, over = {}, 0, {}
        taken = {k for k, n in held.items() if n > 0}
        held = {k: n - 1 for k, n in held.items() if n > 1}
        for cell in row:
            while at in taken:
                at += 1
            text = (yield rendered(cell, seen_in(cell, shown))) if boxed(cell) else []
            line[at] = text
            n = span(cell, "colspan", 1000)
            over[at] = n
            if n == 1:
                wide[at] = max([wide.get(at, 0), *map(columns, text)])
            else:
                for k in range(at, at + n):
                    wide.setdefault(k, 0)
            down = span(cell, "rowspan", 65534)
            if down > 1:
                held.update({k: down - 1 for k in range(at, at + n)})
            at += n
        grid.append(line)
        spans.append(over)
    out = list(caption)
    single = len(wide) <= 1
    for line, over in zip(grid, spans, strict=True):
        for k in range(max([len(v) for v in line.values()], default=0)):
            parts, used = [], 0
            for at in sorted(line):
                lead = sum(wide[c] + 2 for c in range(at)) if not single else 0
                text = line[at][k] if k < len(line[at]) else ""
                if text:
                    pad = max(lead - used, 2 if used else 0)
                    parts.append(" " * pad + text)
                    used += pad + columns(text)
            out.append("".join(parts).rstrip())
    return out


def laid_out(node: Node) -> list[str]:
    """Lines of the element. What ``rendered`` and ``table_lines`` ask of each other waits on a stack of its own, so
    tables may stand in tables to any depth."""
    waiting, answer = [rendered(node)], None
    while True:
        try:
            waiting.append(waiting[-1].send(answer))
            answer = None
        except StopIteration as done:
            waiting.pop()
            answer = done.value
            if not waiting:
                return answer


def extract(page: str) -> str:
    """All visible text of a page: one line for each line of a block, a blank line around spaced blocks."""
    return "\n".join(laid_out(parse(page))).strip("\n")


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars) of every row; null and empty pages give empty text.

    Rows are independent: repeated rows and null ids come back as they are; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            texts = [extract(x) for x in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars"])

    rows = modest(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long")
