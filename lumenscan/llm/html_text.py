"""HTML to text as a page would be laid out.

A tolerant tree builder (void elements, implied ends of p, li, dt, dd, option, table parts; end tags close what they
can) gives a tree; visibility rules leave out head, scripts, styles, templates, comments, ``hidden`` and
``display:none``. The renderer emits all visible text: inline text with white space collapsed, block elements on lines
of their own with blank lines around paragraphs and headings, lists with markers and indents, ``pre`` as it stands,
and tables with their columns aligned.

One narrow pass over the rows; nothing is shuffled. The builder knows where each tag is open and the renderer runs on an
explicit stack, tables in tables included, so nesting of any depth is read in time that grows with the page.

Edge cases: null HTML gives null text, empty HTML an empty one. Broken markup is text. A colspan is held at 1,000, as the
HTML standard has it; a colspan or list start that is no number in ASCII digits counts as 1. Lists and quotes nested
deeper than ``MAX_INDENT`` are rendered in whole but not indented further, as indents would grow with the square of the
depth. Repeated rows are rendered each on its own; an empty table gives no rows; other columns, whatever their names, are
not read. Very long pages are rendered whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from lumenscan.llm._common import text_chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object svg canvas audio video title select datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd details dialog div dt fieldset figcaption footer form header html legend li main menu nav section summary tr td th caption tbody thead tfoot option".split())
#: An opening tag closes the open elements named, unless one of the barriers lies between.
_P_ENDS = PARAGRAPH | frozenset("address article aside details div fieldset figcaption footer form header main menu nav section dd dt li".split())
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: What head may hold; any other opening tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
MAX_INDENT = 64
_NUMBER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})(?![0-9])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "hidden")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.hidden = tag in HIDDEN
        if not self.hidden and attributes and ("hidden" in attributes or "style" in attributes or "none" in attributes):
            a = self.get()
            self.hidden = ("hidden" in a and a["hidden"] != "until-found") or bool(_INVISIBLE.search(a.get("style", "")))

    def get(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(self.attributes)))}


def number(text: str, otherwise: int = 1) -> int:
    """The integer an attribute starts with."""
    m = _NUMBER.match(text)
    return int(m[1]) if m else otherwise


class _Open:
    """The open elements, and for each tag the places where it is open."""

    def __init__(self) -> None:
        self.nodes = [Node("#root")]
        self.places: dict[str, list[int]] = {}

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        """Closes what is open from a place on."""
        while len(self.nodes) > to:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The innermost place of any of tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def end(self, tags: frozenset, barriers: frozenset) -> None:
        """Closes the innermost of tags, unless a barrier is open inside it."""
        at = self.last(tags)
        if at and at >= self.last(barriers):
            self.cut(at)

    def text(self, text: str) -> None:
        if self.top().tag == "head" and text.strip(" \t\n\r\f"):
            self.cut(len(self.nodes) - 1)
        self.top().children.append(text)


_CELLS = ("table", "td", "th", "caption")
_PASSES_CELLS = frozenset("table tr tbody thead tfoot body html".split())
_P, _P_BARRIERS = frozenset({"p"}), frozenset({"button", "td", "th", "caption", "table", "object"})
_TR, _TABLE = frozenset({"tr"}), frozenset({"table"})


def parse(html: str) -> Node:
    """The tree of html; leaves are strings."""
    opened = _Open()
    root = opened.top()
    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            opened.text(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened.places.get("p"):
                opened.top().children.append(Node("p"))
            place = opened.last((tag,))
            if place and (tag in _PASSES_CELLS or place >= opened.last(_CELLS)):
                opened.cut(place)
            continue
        if opened.top().tag == "head" and tag not in IN_HEAD:
            opened.cut(len(opened.nodes) - 1)
        if tag in _P_ENDS:
            opened.end(_P, _P_BARRIERS)
        if tag in IMPLIED:
            opened.end(*IMPLIED[tag])
            if tag in ("tbody", "thead", "tfoot"):
                opened.end(_TR, _TABLE)
        node = Node(tag, m[3])
        opened.top().children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            inner = html[at : end.start()] if end else html[at:]
            node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            opened.push(node)
    if at < len(html):
        opened.text(unescape(html[at:]))
    return root


class _Page:
    """Lines of text with block spacing."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.prefix: list[str] = []  # indents
        self.marker = ""
        self.want = 0  # line ends due before the next text

    def inline(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if not self.line:
            text = text.lstrip(" ")
        elif self.line[-1] == " " and text[:1] == " ":
            text = text[1:]
        if not text:
            return
        if not self.line:
            if self.want > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.want = 0
        self.line += text

    def end(self) -> None:
        """Ends the line, if there's one."""
        if self.line:
            indent = "".join(self.prefix[:MAX_INDENT])
            if self.marker:
                indent = indent[: max(0, len(indent) - len(self.marker))] + self.marker
                self.marker = ""
            self.lines.append((indent + self.line).rstrip(" "))
            self.line = ""

    def block(self, paragraph: bool) -> None:
        self.end()
        self.want = max(self.want, 2 if paragraph else 1)

    def raw(self, text: str) -> None:
        self.end()
        if self.want > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.lines += ["".join(self.prefix[:MAX_INDENT]) + x.rstrip() for x in text.strip("\n").split("\n")]
        self.want = 2

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif not n.hidden:
            if n.tag == "br":
                out.append("\n")
            stack += reversed(n.children)
    return "".join(out)


def _table(node: Node) -> Iterator:
    """Rows of a table with its columns aligned; a cell is rendered and its lines joined. Yields the nodes it wants rendered and is sent their texts."""
    rows, stack, caption = [], list(reversed(node.children)), []
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.strip():
                rows.append([_SPACES.sub(" ", n).strip()])
        elif n.hidden:
            continue
        elif n.tag == "caption":
            caption.append(" ".join((yield n).split()))
        elif n.tag == "tr" or n.tag in ("td", "th"):
            cells = [n] if n.tag != "tr" else n.children
            row = []
            for c in cells:
                if isinstance(c, str):
                    if c.strip():
                        row.append(_SPACES.sub(" ", c).strip())
                elif not c.hidden:
                    row.append(" ".join((yield c).split()))
                    row += [""] * (min(max(number(c.get().get("colspan", "1")), 1), 1000) - 1)
            if any(row):
                rows.append(row)
        elif n.tag in ("tbody", "thead", "tfoot", "colgroup"):
            stack += reversed(n.children)
        elif n.children:
            rows.append([" ".join((yield n).split())])
    while rows and len(rows[-1]) == 0:
        rows.pop()
    rows = [r[: max((i + 1 for i, c in enumerate(r) if c), default=0)] for r in rows]
    widths = [max((len(r[i]) for r in rows if i < len(r) and len(r) > 1), default=0) for i in range(max((len(r) for r in rows), default=0))]
    return [c for c in caption if c] + ["  ".join(c.ljust(widths[i]) if i + 1 < len(r) else c for i, c in enumerate(r)).rstrip() for r in rows]


def render(root: Node) -> str:
    """The visible text of a tree. Tables ask for the text of their cells, which may hold tables: the open ones are a stack."""
    running, sent = [_render(root)], None
    while True:
        try:
            wanted = running[-1].send(sent)
        except StopIteration as done:
            running.pop()
            if not running:
                return done.value
            sent = done.value
        else:
            running.append(_render(wanted))
            sent = None


def _render(root: Node) -> Iterator:
    page = _Page()
    lists: list[list] = []
    stack: list[tuple] = [(root, False)]
    while stack:
        n, over = stack.pop()
        if isinstance(n, str):
            page.inline(n)
            continue
        tag = n.tag
        if over:
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                page.block(tag == "blockquote")
                page.prefix.pop()
                page.marker = ""
            elif tag in BLOCK:
                page.block(tag in PARAGRAPH and not (tag in ("ul", "ol") and lists))
            continue
        if n.hidden:
            continue
        if tag == "br":
            if page.line:
                page.end()
            elif page.lines and page.lines[-1]:
                page.lines.append("")
        elif tag == "hr":
            page.block(True)
        elif tag == "img":
            if alt := n.get().get("alt", "").strip():
                page.inline(alt)
        elif tag == "input":
            a = n.get()
            if a.get("type", "text").lower() in ("submit", "button", "reset") and a.get("value"):
                page.inline(a["value"])
        elif tag == "pre" or tag == "textarea":
            page.block(True)
            page.raw(_text_of(n))
        elif tag == "table":
            page.block(True)
            if rows := (yield from _table(n)):
                page.raw("\n".join(rows))
        else:
            if tag in BLOCK:
                page.block(tag in PARAGRAPH and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, number(n.get().get("start", "1")) if tag == "ol" else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                page.prefix.append(" " * len(mark))
                page.marker = mark
            elif tag in ("dd", "blockquote"):
                page.prefix.append("  ")
            stack.append((n, True))
            stack += [(c, False) for c in reversed(n.children)]
    return page.text()


def extract(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract_pages(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """page_id and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "html"):
                yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([extract(x) for x in b.column("html").to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.selectExpr(f"cast(`{key}` as long) page_id", f"`{html}` html").mapInArrow(run, "page_id long, text string")
