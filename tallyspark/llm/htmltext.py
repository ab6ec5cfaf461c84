"""HTML extraction by layout-aware rendering: all text that a reader would see, laid out as blocks, lists and tables.

``parse`` builds a tree with the implied start and end tags of HTML; ``Renderer`` walks it with visibility rules.

*Visible* is what isn't in ``HIDDEN_TAGS``, isn't ``hidden``, ``display:none`` or ``visibility:hidden`` by its own style
(a descendant may be ``visibility:visible`` again), isn't in a closed ``details`` (but for its summary) or ``dialog``, and
of a ``select`` the chosen options.  Texts of buttons and text fields count as seen, replacements of images don't.

*Layout.*  White space collapses but in ``pre`` and the like.  Paragraphs, headings, lists, tables and quotations stand
between blank lines, other blocks on lines of their own.  List items carry their bullet or number and are indented by
depth.  Table cells stand in columns, padded to the widest cell of a column; lines longer than ``WIDE`` are wrapped where
another column follows.  Column and row spans are kept, and cells with several lines are laid out side by side.  A table
whose padding would take more than ``PADDING`` characters and 16 to each of its text stands unpadded.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import fewer_splits

WIDE = 60
MOST_SPAN = 1000
PADDING = 1 << 20
#: Deeper elements become siblings, as in browsers; it bounds the recursion.
DEEPEST = 512

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
HIDDEN_TAGS = frozenset("head script style template noscript iframe noembed noframes title meta link base datalist area param source track audio video canvas object svg math map rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre figure table hr fieldset form listing plaintext xmp".split())
LINES = frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split())
BLOCKS = SPACED | LINES
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
CLOSES_P = (SPACED | frozenset("address article aside center details dialog div dir dd dt fieldset figcaption figure footer header hgroup li main nav search section summary".split())) - {"table"}
LIST_ENDS = frozenset("ul ol menu dir".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?>\s++|/|[^\s=/>][^\s=/>]*+(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|))?|=)*+)>|(?P<cut></?[a-zA-Z])", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"([a-z-]+)\s*:\s*([^;]+)")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


class _Builder:
    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]

    def _close_through(self, at: int) -> None:
        del self.stack[at:]

    def _open(self, tags, until) -> int:
        """Place of the innermost open element of ``tags``, -1 if none is open within the scope that ``until`` ends."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                return k
            if tag in until:
                return -1
        return -1

    def _push(self, node: Node, stays: bool = True) -> None:
        self.stack[-1].children.append(node)
        if stays and len(self.stack) < DEEPEST:
            self.stack.append(node)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in CLOSES_P and (k := self._open(("p",), ("table", "td", "th", "caption", "button"))) > 0:
            self._close_through(k)
        if tag == "li":
            k = self._open(("li",), LIST_ENDS | {"table", "td", "th"})
        elif tag in ("dt", "dd"):
            k = self._open(("dt", "dd"), ("dl", "table", "td", "th"))
        elif tag in ("option", "optgroup"):
            k = self._open(("option",) if tag == "option" else ("option", "optgroup"), ("select",))
            if tag == "optgroup" and (outer := self._open(("optgroup",), ("select",))) > 0:
                k = outer
        elif tag in ("td", "th"):
            k = self._open(("td", "th"), ("table",))
        elif tag == "tr":
            k = self._open(("tr",), ("table",))
        elif tag in ("thead", "tbody", "tfoot", "caption", "colgroup"):
            k = self._open(("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            k = len(self.stack) - 1
        elif tag in ("a", "button", "nobr"):
            k = self._open((tag,), BLOCKS)
        elif tag == "body" and (k := self._open(("head",), ())) > 0:
            pass
        else:
            k = -1
        if k > 0:
            self._close_through(k)
        if tag in TABLE_PARTS and self._open(("table",), ()) < 0:
            return  # a part of a table without one
        if tag == "tr" and self.stack[-1].tag == "table":
            self._push(Node("tbody"))
        if tag in ("td", "th") and self.stack[-1].tag != "tr":
            if self.stack[-1].tag == "table":
                self._push(Node("tbody"))
            self._push(Node("tr"))
        if tag in ("html", "body") and self._open((tag,), ()) > 0:
            return
        if tag not in ("html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template") and (k := self._open(("head",), ())) > 0:
            self._close_through(k)  # the body begins
        self._push(Node(tag, attributes), tag not in VOID)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push(Node("br"), False)
            return
        if tag in ("html", "body"):
            return
        until = ("table",) if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("td", "th", "caption") if tag not in ("table",) else ()
        if tag == "li":
            until = LIST_ENDS | set(until)
        k = self._open((tag,), until)
        if k < 0:
            if tag == "p":
                self._push(Node("p"), False)
            return
        if tag in FORMATTING and any(n.tag in BLOCKS for n in self.stack[k + 1 :]):
            del self.stack[k]  # the blocks within go on
            return
        self._close_through(k)

    def text(self, data: str) -> None:
        children = self.stack[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        value = a or b or c
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def parse(source: str) -> Node:
    """The tree of a page: ``Node`` children and strings under a root without a tag of its own."""
    builder, at = _Builder(), 0
    while True:
        m = _TOKEN.search(source, at)
        rest = source[at : m.start() if m else len(source)]
        if rest:
            builder.text(html.unescape(rest) if "&" in rest else rest)
        if not m or m["cut"]:  # a tag that never ends takes the rest with it
            return builder.root
        at = m.end()
        if name := m["start"]:
            name = name.lower()
            inner = m["attributes"]
            builder.start(name, _attributes(inner) if inner and not inner.isspace() else {})
            if name == "plaintext":  # nothing ends it
                if at < len(source):
                    builder.text(source[at:])
                return builder.root
            if name in RAW or name in ESCAPABLE:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                data = source[at : close.start() if close else len(source)]
                if builder.stack[-1].tag == name:
                    if data:
                        builder.text(html.unescape(data) if name in ESCAPABLE else data)
                    builder._close_through(len(builder.stack) - 1)
                at = close.end() if close else len(source)
        elif name := m["end"]:
            builder.end(name.lower())


class _Lines:
    """Lines under construction: collapsing of spaces, pending line ends and blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space = self.blank = False

    def inline(self, data: str) -> None:
        flat = _SPACE.sub(" ", data)
        if flat == " ":
            self.space = True
            return
        if not flat:
            return
        lead = flat[0] == " "
        body = flat.strip(" ")
        if self.current and (self.space or lead):
            self.current.append(" ")
        self.current.append(body)
        self.space = flat[-1] == " "

    def verbatim(self, data: str) -> None:
        first, *more = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if self.space and self.current:
            self.current.append(" ")
        self.space = False
        self.current.append(first)
        for line in more:
            self.newline()
            self.current.append(line)

    def newline(self) -> None:
        self.lines.append("".join(self.current).rstrip(" \t"))
        self.current, self.space = [], False

    def end_line(self) -> None:
        if self.current:
            self.newline()
        self.space = False

    def gap(self) -> None:
        """A blank line before what comes, unless nothing came yet."""
        self.end_line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def block(self, lines: list[str]) -> None:
        self.end_line()
        self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        out = self.lines
        while out and not out[-1]:
            out.pop()
        first = 0
        while first < len(out) and not out[first]:
            first += 1
        return out[first:]


def _roman(n: int) -> str:
    out = ""
    for value, letters in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + letters, n - value
    return out


def _number(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < n < 4000:
        return _roman(n).upper() if kind == "I" else _roman(n)
    return str(n)


def _whole(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "", re.ASCII)
    return int(m[1]) if m else default


def _wrapped(line: str) -> list[str]:
    """A line cut at spaces into lines of ``WIDE`` characters; a longer word stands whole."""
    out, current = [], ""
    for word in line.split(" "):
        if current and len(current) + 1 + len(word) > WIDE:
            out.append(current)
            current = word
        else:
            current = f"{current} {word}" if current else word
    return [*out, current]


def _laid_out(grid: list[dict[int, list[str]]]) -> list[str]:
    """Rows of cells (lines by column) as lines with aligned columns; columns without text are left out."""
    used = sorted({k for cells in grid for k, lines in cells.items() if any(lines)})
    place = {k: i for i, k in enumerate(used)}
    rows = [{place[k]: lines for k, lines in cells.items() if k in place} for cells in grid]
    rows = [{i: [x for line in lines for x in (_wrapped(line) if len(line) > WIDE and i < len(used) - 1 else [line])] for i, lines in cells.items()} for cells in rows]
    width = [0] * len(used)
    for cells in rows:
        for i, lines in cells.items():
            width[i] = max(width[i], max(map(len, lines), default=0))
    ends = [0]
    for w in width:
        ends.append(ends[-1] + w + 2)
    text = sum(len(x) for cells in rows for lines in cells.values() for x in lines)
    padded = sum(ends[max(cells)] * max(map(len, cells.values())) for cells in rows if cells)
    aligned, out = padded <= PADDING + 16 * text, []
    for cells in rows:
        columns = range(max(cells, default=-1) + 1) if aligned else sorted(cells)
        for n in range(max(map(len, cells.values()), default=0)):
            parts = [(cells[i][n] if i in cells and n < len(cells[i]) else "").ljust(width[i] if aligned else 0) for i in columns]
            out.append("  ".join(parts).rstrip(" "))
    return out


class Renderer:
    def lines(self, nodes: list, pre: bool = False, seen: bool = True, depth: int = 0) -> list[str]:
        out = _Lines()
        self._walk(nodes, out, pre, seen, depth)
        return out.done()

    def _walk(self, nodes: list, out: _Lines, pre: bool, seen: bool, depth: int) -> None:
        for node in nodes:
            if isinstance(node, str):
                if seen:
                    out.verbatim(node) if pre else out.inline(node)
            else:
                self._element(node, out, pre, seen, depth)

    def _element(self, node: Node, out: _Lines, pre: bool, seen: bool, depth: int) -> None:
        tag, attributes = node.tag, node.attributes
        if tag in HIDDEN_TAGS:
            return
        if attributes:
            if "hidden" in attributes and attributes["hidden"].lower() != "until-found":
                return
            if tag == "dialog" and "open" not in attributes:
                return
            if style := attributes.get("style"):
                styles = {k: v.strip() for k, v in _DECLARATION.findall(style.lower())}
                if styles.get("display", "").startswith("none"):
                    return
                if visibility := styles.get("visibility", "").split(" ")[0]:
                    seen = visibility == "visible" if visibility in ("visible", "hidden", "collapse") else seen
                if white := styles.get("white-space", "").split(" ")[0]:
                    pre = white.startswith("pre") or white == "break-spaces"
        elif tag == "dialog":
            return
        if tag == "br":
            out.newline()
        elif tag == "wbr":
            pass
        elif tag == "hr":
            out.gap()
        elif tag == "input":
            if seen and attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "tel", "url", "number") and attributes.get("value"):
                out.inline(f" {attributes['value']} ")
        elif tag == "textarea":
            if seen:
                out.block(self.lines(node.children, True, seen, depth))
        elif tag == "select":
            if seen:
                self._select(node, out)
        elif tag == "details" and "open" not in attributes:
            out.end_line()
            self._walk([c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1], out, pre, seen, depth)
            out.end_line()
        elif tag in ("ul", "ol", "menu", "dir"):
            self._list(node, out, pre, seen, depth)
        elif tag == "table":
            self._table(node, out, pre, seen, depth)
        elif tag in ("pre", "listing", "plaintext", "xmp"):
            children = node.children
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            self._spaced(out, self.lines(children, True, seen, depth))
        elif tag == "blockquote":
            self._spaced(out, [f"  {x}" if x else x for x in self.lines(node.children, pre, seen, depth)])
        elif tag == "dd":
            out.block([f"    {x}" if x else x for x in self.lines(node.children, pre, seen, depth)])
        elif tag in SPACED:
            self._spaced(out, self.lines(node.children, pre, seen, depth))
        elif tag in LINES:
            out.end_line()
            self._walk(node.children, out, pre, seen, depth)
            out.end_line()
        else:
            self._walk(node.children, out, pre, seen, depth)

    @staticmethod
    def _spaced(out: _Lines, lines: list[str]) -> None:
        if lines:
            out.gap()
            out.block(lines)
            out.gap()

    @staticmethod
    def _select(node: Node, out: _Lines) -> None:
        options, left = [], list(node.children)
        while left:
            c = left.pop(0)
            if isinstance(c, Node):
                if c.tag == "option":
                    options.append(c)
                left = list(c.children) + left if c.tag != "option" else left
        chosen = [o for o in options if "selected" in o.attributes] or ([] if "multiple" in node.attributes else options[:1])
        for o in chosen:
            out.inline(" " + "".join(c for c in o.children if isinstance(c, str)) + " ")

    def _list(self, node: Node, out: _Lines, pre: bool, seen: bool, depth: int) -> None:
        """Items with their marks; what isn't in an item stands like one without a mark."""
        ordered, kind = node.tag == "ol", node.attributes.get("type", "1")
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        step = -1 if "reversed" in node.attributes else 1
        n = _whole(node.attributes.get("start"), len(items) if step < 0 else 1)
        rows: list[str] = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                n = _whole(child.attributes.get("value"), n) if ordered else n
                probe = _Lines()
                self._element(child, probe, pre, seen, depth + 1)
                lines = probe.done()
                mark = f"{_number(n, kind)}. " if ordered else "- "
                if lines or ordered:
                    n += step
                if lines:
                    rows.append(mark + lines[0])
                    rows += [" " * len(mark) + x if x else x for x in lines[1:]]
            else:
                rows += self.lines([child], pre, seen, depth + 1)
        if not rows:
            return
        if depth:
            out.block(rows)
        else:
            self._spaced(out, rows)

    def _table(self, node: Node, out: _Lines, pre: bool, seen: bool, depth: int) -> None:
        sections: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
        before: list = []
        for child in node.children:
            if isinstance(child, str):
                before += [child] if child.strip() else []
            elif child.tag in sections:
                if not self._gone(child):
                    for c in child.children:
                        if isinstance(c, Node) and c.tag == "tr":
                            if not self._gone(c):
                                sections[child.tag].append(c)
                        elif isinstance(c, Node) or c.strip():
                            before.append(c)
            elif child.tag == "tr":
                sections["tbody"].append(child)
            elif child.tag not in ("colgroup", "col"):
                before.append(child)
        rows = sections["thead"] + sections["tbody"] + sections["tfoot"]
        lead = self.lines(before, pre, seen, depth)  # the caption, and what was misplaced in the table
        grid: list[dict[int, list[str]]] = []
        taken: list[tuple[int, int, int]] = []  # columns from, to, and the row until which they are taken
        for r, row in enumerate(rows):
            cells: dict[int, list[str]] = {}
            grid.append(cells)
            taken = [t for t in taken if t[2] > r]
            column, spans, at = 0, [], 0
            for cell in row.children:
                if isinstance(cell, str) and not cell.strip():
                    continue
                if isinstance(cell, Node) and self._gone(cell):
                    continue
                while at < len(taken) and taken[at][0] <= column:
                    column = max(column, taken[at][1])
                    at += 1
                wide = tall = 1
                if isinstance(cell, Node):
                    wide = min(max(_whole(cell.attributes.get("colspan"), 1), 1), MOST_SPAN)
                    tall = min(max(_whole(cell.attributes.get("rowspan"), 1), 1), len(rows) - r)
                cells[column] = self.lines([cell], pre, seen, depth)
                if tall > 1:
                    spans.append((column, column + wide, r + tall))
                column += wide
            if spans:
                taken = sorted(taken + spans)
        self._spaced(out, lead + _laid_out(grid))

    @staticmethod
    def _gone(node: Node) -> bool:
        return "hidden" in node.attributes or "none" in re.findall(r"display\s*:\s*([a-z]+)", node.attributes.get("style", "").lower())


def render(source: str | None) -> str:
    """The visible text of a page; null or empty gives an empty text."""
    if not source:
        return ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEEPEST))
    lines, out = Renderer().lines(parse(source.replace("\0", "�")).children), []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line.replace("\xa0", " ").rstrip(" "))
    return "\n".join(out)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` but the source, plus text and n_words; columns with these names are replaced.

    Each row is worked on by itself: equal rows give equal rows, an empty table gives an empty table.
    """
    others = [c for c in pages.columns if c not in (column, "text", "n_words")]
    flat = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`").alias("source"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields[:-1]), "text string, n_words long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [render(x) for x in part.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(others))), pa.array(texts, pa.string()), pa.array([len(t.split()) for t in texts], pa.int64())], names=[*others, "text", "n_words"])

    return flat.mapInArrow(run, schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return fewer_splits(extract_pages(pages), pages)
