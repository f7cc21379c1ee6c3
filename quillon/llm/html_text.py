"""Visible text of web pages, laid out as a browser without style sheets would.

A tokenizer feeds a tree builder that adds the tags HTML lets authors leave out; elements that are not shown are skipped
by the visibility rules; and a renderer emits all other text, in the author's order, with block spacing, list markers
and table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm._batch import small_batches

MAX_DEPTH = 512  # as in browsers: deeper elements become siblings, and nothing is lost

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRS = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+""")  # a value in quotes may hold >
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes canvas audio video object datalist title rp area param defs desc metadata symbol annotation annotation-xml".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset menu dir".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center details dialog div dd dt fieldset figcaption footer form header hgroup legend li main nav search section summary optgroup tr caption thead tbody tfoot td th text".split())  # text: of svg
CLOSES_P = PARAGRAPHS | frozenset("address article aside center details dialog div dd dt figcaption footer form header hgroup li main nav search section summary listing plaintext xmp".split())
#: tag -> (open tags that it ends, tags beyond which it doesn't look)
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption colgroup".split()), frozenset(["table", "tr"])),
    "th": (frozenset("td th caption colgroup".split()), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
} | {t: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")}
_P_SCOPE = frozenset("table td th caption button object html body".split())
_P_OR_SCOPE = _P_SCOPE | frozenset(["p"])
_END_SCOPE = frozenset("table td th caption".split())
_TABLE_ONLY = frozenset("table thead tbody tfoot tr".split())
_TABLE = frozenset(["table"])
_TABLE_PARTS = _TABLE_ONLY | frozenset("td th caption".split())
_IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
_IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children = tag, []
        self.attrs: dict[str, str] = {}
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                self.attrs.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))


def parse(page: str) -> Node:
    """The tree of a page; any text is a page. The time it takes is in proportion to the page's length."""
    root = Node("html")
    stack = [root]
    count: dict[str, int] = {}  # open elements by tag

    def push(node: Node) -> None:
        stack.append(node)
        count[node.tag] = count.get(node.tag, 0) + 1

    def close(first: int, last: int | None = None) -> None:
        for x in stack[first:last]:
            count[x.tag] -= 1
        del stack[first:last]

    def innermost(tags: frozenset[str]) -> int:
        if len(stack) > 32 and not any(count.get(t) for t in tags):
            return 0
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in tags), 0)

    def before_table(what: "Node | str") -> bool:
        """Puts what stands between cells before the table."""
        i = innermost(_TABLE)
        if i:
            parent = stack[i - 1]
            parent.children.insert(len(parent.children) - 1, what)
        return bool(i)

    def add_text(text: str) -> None:
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        if stack[-1].tag in _TABLE_ONLY and not text.isspace() and before_table(text):
            return
        if stack[-1].tag == "head" and not text.isspace():
            close(len(stack) - 1)
        stack[-1].children.append(text)

    def open_tag(name: str, attrs: str) -> None:
        if name == "html":
            return
        if name in CLOSES_P and count.get("p"):
            i = innermost(_P_OR_SCOPE)
            if stack[i].tag == "p":
                close(i)
        if name in _IN_TABLE and name not in ("script", "style", "template"):  # ends what stands before the table
            i = innermost(_TABLE_PARTS)
            if i and stack[i].tag in _TABLE_ONLY:
                close(i + 1)
        if name in IMPLIED:
            ends, scope = IMPLIED[name]
            found = None
            if len(stack) <= 32 or any(count.get(t) for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in ends:
                        found = i
            if found is not None:
                close(found)
            if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
        if stack[-1].tag == "head" and name not in _IN_HEAD:
            close(len(stack) - 1)
        if name == "table" and stack[-1].tag in _TABLE_ONLY and (i := innermost(_TABLE)):  # ends the table it stands in
            close(i)
        node = Node(name, attrs)
        if stack[-1].tag in _TABLE_ONLY and name not in _IN_TABLE and innermost(_TABLE):
            if name == "form":  # stays empty
                return
            before_table(node)
        else:
            stack[-1].children.append(node)
        if attrs.endswith("/") and (name in ("svg", "math") or count.get("svg") or count.get("math")):
            return
        if name not in VOID and len(stack) < MAX_DEPTH:
            push(node)

    def end_tag(name: str) -> None:
        if name == "br":
            stack[-1].children.append(Node("br"))
            return
        if not count.get(name):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == name:
                if name in FORMATTING and any(x.tag in BLOCKS for x in stack[i + 1 :]):
                    close(i, i + 1)  # blocks within it go on without it
                else:
                    close(i)
                return
            if stack[i].tag in _END_SCOPE and name not in _TABLE_ONLY and name not in _END_SCOPE:
                return

    at, begin, size, quoted, last = 0, 0, len(page), True, page.rfind(">")
    while (i := page.find("<", at)) >= 0:  # begin: where text begins that is not in the tree yet
        sign = page[i + 1 : i + 2]
        m = _NAME.match(page, i + 2 if sign == "/" else i + 1)
        if m is None and sign not in ("!", "?", "/"):
            at = i + 1
            continue
        if m is None:
            if page.startswith("<!--", i):
                if page.startswith((">", "->"), i + 4):
                    at = page.index(">", i) + 1
                else:
                    end = _COMMENT_END.search(page, i + 4)
                    at = end.end() if end else size
            else:
                close_with = "]]>" if page.startswith("<![CDATA[", i) else ">"
                end = page.find(close_with, i)
                at = end + len(close_with) if end >= 0 else size
            add_text(page[begin:i])
            begin = at
            if page.startswith("<![CDATA[", i):
                add_text(html.escape(page[i + 9 : at].removesuffix("]]>"), quote=False))
            continue
        if i > last:
            break
        stop = _ATTRS.match(page, m.end()).end() if quoted else page.find(">", m.end())
        if quoted and stop >= size:  # quotes that don't close: from here on they mean nothing
            quoted, stop = False, page.find(">", m.end())
        if stop < 0:
            break
        add_text(page[begin:i])
        attrs, name = page[m.end() : stop], m[0].lower()
        at = begin = stop + 1
        if sign == "/":
            end_tag(name)
            continue
        depth = len(stack)
        open_tag(name, attrs)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            raw = page[at : end.start() if end else size]
            at = begin = end.end() if end else size
            if name in ("textarea", "xmp"):
                parent = stack[-1].children[-1] if len(stack) <= depth and stack[-1].children and stack[-1].tag != name else stack[-1]
                (parent.children if isinstance(parent, Node) else stack[-1].children).append(html.unescape(raw) if name == "textarea" else raw)
            if stack[-1].tag == name:
                close(len(stack) - 1)
    add_text(page[begin:])
    return root


class _Writer:
    """Lines of text with collapsed white space and margins between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.margin = 0  # 1: a new line, 2: an empty line before the next text

    def _begin(self) -> None:
        if self.margin == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.margin = 0

    def text(self, text: str) -> None:
        text = _BLANK.sub(" ", text)
        if not self.current:
            text = text.removeprefix(" ")
            if not text:
                return
            self._begin()
        elif self.current[-1].endswith(" "):
            text = text.removeprefix(" ")
        if text:
            self.current.append(text)

    def verbatim(self, text: str) -> None:
        lines = text.expandtabs(8).replace("\r\n", "\n").split("\n")
        for i, line in enumerate(lines):
            if i:
                self.line_break()
            if line:
                if not self.current:
                    self._begin()
                self.current.append(line)

    def line_break(self) -> None:
        if not self.current:
            self._begin()
        self.lines.append("".join(self.current).rstrip(" "))
        self.current = []

    def block(self, margin: int) -> None:
        if self.current:
            self.line_break()
        self.margin = max(self.margin, margin)

    def whole(self, lines: list[str], margin: int) -> None:
        """Lines that are laid out already, as a block of their own."""
        self.block(margin)
        if lines:
            self._begin()
            self.lines += lines
        self.margin = max(self.margin, margin)

    def done(self) -> list[str]:
        self.block(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _shown(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    style = node.attrs.get("style")
    return not style or "display:none" not in re.sub(r"\s", "", style.lower())


def _inked(node: Node, inked: bool) -> bool:
    """Whether text in node is visible, which a child may be within a parent that isn't."""
    style = node.attrs.get("style")
    if style and (m := re.search(r"visibility\s*:\s*(\w+)", style.lower())):
        return m[1] == "visible"
    return inked


def _number(value: str | None, default: int, most: int = 1 << 30) -> int:
    try:
        return min(int(value or default), most)
    except ValueError:
        return default


def _walk(node: Node, out: _Writer, pre: bool, inked: bool, listed: bool = False) -> None:
    index = 1
    if node.tag == "ol":
        index = _number(node.attrs.get("start"), 1)
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if inked and not closed:
                out.verbatim(child) if pre else out.text(child)
            continue
        tag = child.tag
        if not _shown(child) or (closed and tag != "summary"):
            continue
        ink = _inked(child, inked)
        if tag == "br":
            out.line_break()
        elif tag == "table":
            out.whole(_table(child, ink), 2)
        elif tag == "li":
            if node.tag == "ol":
                index = _number(child.attrs.get("value"), index)
                mark = f"{index}. "
                index += 1
            else:
                mark = "- "
            inner = _Writer()
            _walk(child, inner, pre, ink, True)
            lines = inner.done()
            if lines:
                out.whole([mark + lines[0], *(" " * len(mark) * bool(x) + x for x in lines[1:])], 1)
        elif tag in ("blockquote", "dd"):
            inner = _Writer()
            _walk(child, inner, pre, ink)
            out.whole([" " * 4 * bool(x) + x for x in inner.done()], 2 if tag == "blockquote" else 1)
        elif tag == "select":
            options = [o for o in _all(child, "option") if _shown(o)]
            chosen = [o for o in options if "selected" in o.attrs] or options[:1]
            for o in chosen:
                _walk(o, out, False, ink)
        elif tag == "input":
            if ink and child.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                out.text(child.attrs.get("value", ""))
        elif tag == "q":
            if ink:
                out.text('"')
            _walk(child, out, pre, ink)
            if ink:
                out.text('"')
        elif tag in BLOCKS:
            nested = listed and tag in ("ul", "ol", "menu", "dir")
            margin = 2 if tag in PARAGRAPHS and not nested else 1
            out.block(margin)
            _walk(child, out, pre or tag in ("pre", "listing"), ink, listed and tag in ("ul", "ol", "menu", "dir", "div"))
            out.block(margin)
        else:
            _walk(child, out, pre or tag in ("textarea", "xmp"), ink, listed)


def _all(node: Node, tag: str) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            if child.tag == tag:
                yield child
            else:
                yield from _all(child, tag)


def _table(table: Node, inked: bool) -> list[str]:
    """Rows with every cell's lines in its columns, which are as wide as their widest cell and two spaces apart."""
    head: list[tuple[Node, bool]] = []
    body: list[tuple[Node, bool]] = []
    foot: list[tuple[Node, bool]] = []
    out: list[str] = []
    for child in table.children:
        if not isinstance(child, Node) or not _shown(child):
            continue
        ink = _inked(child, inked)
        if child.tag == "caption":
            inner = _Writer()
            _walk(child, inner, False, ink)
            out += inner.done()
        elif child.tag == "tr":
            body.append((child, ink))
        elif child.tag in ("thead", "tbody", "tfoot"):
            part = {"thead": head, "tfoot": foot}.get(child.tag, body)
            part += [(r, _inked(r, ink)) for r in child.children if isinstance(r, Node) and r.tag == "tr" and _shown(r)]
    rows: list[list[tuple[int, int, list[str]]]] = []  # (first column, columns, lines)
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row, ink in head + body + foot:
        cells, column = [], 0
        after = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or not _shown(cell):
                continue
            while column in taken:
                column += 1
            wide, high = max(1, _number(cell.attrs.get("colspan"), 1, 1000)), max(1, _number(cell.attrs.get("rowspan"), 1, 65534))
            inner = _Writer()
            _walk(cell, inner, False, _inked(cell, ink))
            cells.append((column, wide, inner.done()))
            if high > 1:
                after |= {c: high - 1 for c in range(column, column + wide)}
            column += wide
        taken = after
        rows.append(cells)
    width: dict[int, int] = {}
    for cells in rows:
        for column, wide, lines in cells:
            if wide == 1:
                width[column] = max(width.get(column, 0), max(map(len, lines), default=0))
    for cells in rows:
        for column, wide, lines in cells:
            if wide > 1:
                have = sum(width.get(c, 0) for c in range(column, column + wide)) + 2 * (wide - 1)
                need = max(map(len, lines), default=0)
                if need > have:
                    width[column + wide - 1] = width.get(column + wide - 1, 0) + need - have
    begin, x = {}, 0
    for c in range(max(width, default=-1) + 1):
        begin[c] = x
        x += width[c] + 2 if width.get(c) else 0  # empty columns take no room
    for cells in rows:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    line = line.ljust(begin.get(column, 0)) + lines[i]
            out.append(line.rstrip(" "))
    return out


def render(page: str) -> str:
    """All visible text of a page."""
    if sys.getrecursionlimit() < 8 * MAX_DEPTH:
        sys.setrecursionlimit(8 * MAX_DEPTH)
    out = _Writer()
    _walk(parse(page), out, False, True)
    return "\n".join(out.done()).replace("\xa0", " ")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars), a row for every row of pages.

    A null page gives a null text and null n_chars, an empty one and one without visible text an empty text. Any text is
    a page, however broken or long; elements deeper than 512 become siblings. An empty table gives an empty result. Rows are independent, so repeated rows give equal rows; other columns are not read.
    """
    source = small_batches(pages).select(pages[id_col].alias("page_id"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if page.as_py() is None else render(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])

    return source.mapInArrow(run, T.StructType([source.schema["page_id"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
