"""Layout-aware text of raw web pages.

A tree builder supplies the tags that HTML lets authors leave out, visibility rules take away what a
browser does not show, and a renderer writes the rest as text: blank lines round paragraphs, line
breaks round blocks, markers and indents for lists, and table columns padded to a common width.
All visible text is kept, navigation and notices included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.llm.common import by_value

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Content is text up to the matching end tag.
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = set("head script style template title noscript iframe object audio video canvas datalist noembed noframes".split()) | set(
    "annotation annotation-xml desc defs metadata symbol clippath".split()  # of formulas and drawings
)
#: Inputs that show no text of their value.
VALUELESS = set("hidden password checkbox radio file image color range".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = PARAGRAPHS | set(
    "html body div section article aside header footer nav main address form li dt dd tr td th thead tbody tfoot caption "
    "details summary figcaption center legend option select optgroup menu dir hgroup search".split()
)
#: Blocks that end an open paragraph.
ENDS_P = BLOCKS - set("html body li dt dd tr td th thead tbody tfoot caption option select optgroup legend".split()) | {"li", "dt", "dd"}
#: A start tag ends these open elements, up to the given scope.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Inline end tags do not reach out of these.
SCOPES = {"table", "td", "th", "caption", "html"}
#: Tables nested deeper than this are rendered as blocks.
TABLE_DEPTH = 100
#: Bounds of the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?|</[^>]*>?", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)")
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z-]+)")
SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    """An element with its shown attributes and children (nodes and strings)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    found: dict[str, str] = {}
    for name, one, two, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(one or two or bare))
    return found


def build(page: str) -> Node:
    """The element tree of a page, in one pass; never fails, whatever the page."""
    root = Node("html")
    stack, at, lowered = [root], 0, None

    def close_until(tags: set[str], scope: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in scope:
                return
            if stack[depth].tag in tags:
                del stack[depth:]
                return close_until(tags, scope)

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < len(page):
        match = TOKEN.search(page, at)
        if not match:
            say(page[at:])
            break
        say(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if not tag:
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in SCOPES and tag not in BLOCKS:
                    break
            continue
        if tag in ("html", "body"):
            stack[0].attrs |= _attributes(match[3])
            if tag == "body":
                close_until({"head"}, set())
            continue
        if tag in ENDS_P:
            close_until({"p"}, {"table", "td", "th", "button", "blockquote", "li", "div"} - {tag} if tag != "li" else {"table", "td", "th"})
        if tag in IMPLIED_END:
            close_until(*IMPLIED_END[tag])
        if stack[-1].tag == "head" and tag in BLOCKS:
            stack.pop()
        if stack[-1].tag == "table" and tag in ("td", "th"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, _attributes(match[3]))
        stack[-1].children.append(node)
        if tag in VOID or match[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            end = lowered.find("</" + tag, at) if len(lowered) == len(page) else _find_end(page, tag, at)
            end = len(page) if end < 0 or tag == "plaintext" else end
            if tag not in HIDDEN:
                node.children.append(html.unescape(page[at:end]))
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        stack.append(node)
    return root


def _find_end(page: str, tag: str, at: int) -> int:
    found = re.compile("</" + re.escape(tag), re.IGNORECASE | re.ASCII).search(page, at)
    return found.start() if found else -1


def hidden(node: Node) -> bool:
    """Whether the element is not laid out, nor anything in it."""
    if node.tag in HIDDEN:
        return True
    attrs = node.attrs
    if not attrs:
        return False
    display = DISPLAY.findall(attrs["style"].lower()) if "style" in attrs else None
    if display:
        return display[-1] == "none"
    return "hidden" in attrs or node.tag == "input" and attrs.get("type", "").lower() == "hidden"


def visible(node: Node, inherited: bool) -> bool:
    """Whether the element shows its text: its own visibility, else that of the element around it."""
    own = VISIBILITY.findall(node.attrs["style"].lower()) if "style" in node.attrs else None
    if not own or own[-1] not in ("visible", "hidden", "collapse"):
        return inherited
    return own[-1] == "visible"


class Writer:
    """Text being laid out: collapses blanks, keeps block spacing to one blank line."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = 0  # line breaks due before the next text
        self.blank = False  # a blank is due before the next text
        self.indent = ""
        self.marker = ""

    def space(self, lines: int) -> None:
        self.breaks, self.blank = max(self.breaks, lines), False

    def put(self, text: str) -> None:
        if self.breaks or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.breaks)
            self.parts.append(self.indent[: len(self.indent) - 2 * bool(self.marker)] + self.marker)
            self.breaks, self.marker = 0, ""
        elif self.blank:
            self.parts.append(" ")
        self.blank = False
        self.parts.append(text)

    def flow(self, text: str) -> None:
        body = SPACE.sub(" ", text)
        if body[:1] == " ":
            self.blank, body = True, body[1:]
        if not body:
            return
        ends = body[-1] == " "
        self.put(body[:-1] if ends else body)
        self.blank = ends

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.breaks = min(self.breaks + 1, 2) if not line else max(self.breaks, 0) + 1
            if line:
                self.put(line)

    def text(self) -> str:
        return "".join(self.parts)


def _number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"-?\d{1,9}", text or "", re.ASCII) else default


def render(node: Node, tables: int = 0, shown: bool = True) -> str:
    """The visible text below a node, walked without recursion except for tables in tables.

    ``shown`` is the visibility that the node inherits."""
    out = Writer()
    lists: list[list] = []  # [ordered, next number]
    todo: list = [("open", node, False, shown)]
    while todo:
        kind, item, pre, shown = todo.pop()
        if kind == "text":
            if shown:
                out.verbatim(item) if pre else out.flow(item)
            continue
        if kind == "close":
            if item.tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.space(1 if lists else 2)
            elif item.tag == "li":
                out.indent = out.indent[:-2]
                out.marker = ""
                out.space(1)
            elif item.tag == "dd":
                out.indent = out.indent[:-4]
                out.space(1)
            else:
                out.space(2 if item.tag in PARAGRAPHS else 1)
            continue
        tag = item.tag
        if hidden(item):
            continue
        shown = visible(item, shown)
        if tag == "br":
            out.breaks, out.blank = min(out.breaks + 1, 2), False
            continue
        if tag in ("img", "area"):
            if shown and item.attrs.get("alt", "").strip():
                out.flow(item.attrs["alt"])
            continue
        if tag == "input":
            if shown and item.attrs.get("type", "text").lower() not in VALUELESS and item.attrs.get("value"):
                out.flow(" " + item.attrs["value"] + " ")
            continue
        if tag == "text":  # of a drawing: stands apart
            out.flow(" ")
        if tag == "table" and tables < TABLE_DEPTH:
            out.space(2)
            for line in table_lines(item, tables + 1, shown):
                if line:
                    out.put(line)
                out.space(1)
            out.space(2)
            continue
        pre = pre or tag in ("pre", "textarea", "xmp", "plaintext")
        if tag in BLOCKS:
            nested = lists and tag in ("ul", "ol", "menu", "dir")
            if not (out.marker and tag in ("p", "div")):
                out.space(2 if tag in PARAGRAPHS and not nested else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(item.attrs.get("start", ""), 1)])
            elif tag == "li":
                if lists and lists[-1][0]:
                    number = _number(item.attrs.get("value", ""), lists[-1][1])
                    lists[-1][1] = number + 1
                    marker = f"{number}. "
                else:
                    marker = "- "
                # later lines of the item stand below its first word
                out.marker, out.indent = marker, out.indent + "  "
            elif tag == "dd":
                out.indent += "    "
            todo.append(("close", item, False, shown))
        todo.extend(_children(item, pre, shown))
    return out.text()


def _children(node: Node, pre: bool, shown: bool) -> list:
    return [("text" if isinstance(c, str) else "open", c, pre, shown) for c in reversed(node.children)]


def table_lines(table: Node, tables: int, shown: bool = True) -> list[str]:
    """Rows of the table with cells padded to the width of their column; a cell of several lines
    takes several lines.  Captions and stray content come first.

    A cell over several rows stands in the first and keeps its columns free in the others, as long as
    its group of rows lasts.  Cells that are laid out but not visible stay empty; a row without any
    visible text because of that is left out."""
    rows, before, groups = [], [], 0
    taken: dict[int, int] = {}  # column -> rows for which a cell above still holds it
    last = None
    todo = [(item, 0, shown) for item in reversed(table.children)]
    while todo:
        item, group, seen = todo.pop()
        if isinstance(item, str):
            if seen and item.strip():
                before.append(SPACE.sub(" ", item).strip())
            continue
        if hidden(item):
            continue
        if item.tag in ("thead", "tbody", "tfoot", "form"):
            groups += 1
            seen = visible(item, seen)
            todo.extend((child, groups, seen) for child in reversed(item.children))
        elif item.tag == "tr":
            if group != last:
                taken, last = {}, group
            seen = visible(item, seen)
            cells, at, fresh = [], 0, {}
            for cell in item.children:
                if isinstance(cell, str):
                    if not seen or not cell.strip():
                        continue
                    lines, span, down = [SPACE.sub(" ", cell).strip()], 1, 1
                elif hidden(cell):
                    continue
                else:
                    lines = render(cell, tables, seen).split("\n")
                    span = min(max(_number(cell.attrs.get("colspan", ""), 1), 1), MOST_COLUMNS)
                    down = _number(cell.attrs.get("rowspan", ""), 1)
                    down = MOST_ROWS if down == 0 else min(max(down, 1), MOST_ROWS)
                at = _pass_taken(cells, at, taken)
                cells.append((lines, span))
                if down > 1:
                    fresh |= dict.fromkeys(range(at, at + span), down - 1)
                at += span
            _pass_taken(cells, at, taken)
            taken = {column: left - 1 for column, left in taken.items() if left > 1} | fresh
            if seen or any(any(lines) for lines, _ in cells):
                rows.append(cells)
        else:
            text = render(item, tables, seen)
            if text:
                before.extend(text.split("\n"))
    widths: dict[int, int] = {}
    starts = set()  # columns in which some cell begins: others have no border of their own
    for cells in rows:
        at = 0
        for lines, span in cells:
            starts.add(at)
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines)))
            at += span
    out = before
    for cells in rows:
        for k in range(max((len(lines) for lines, _ in cells), default=0)):
            line, at = [], 0
            for lines, span in cells:
                width = sum(widths.get(i, 0) for i in range(at, at + span)) + 3 * sum(i in starts for i in range(at + 1, at + span))
                line.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            out.append(" | ".join(line).rstrip())
    return out


def _pass_taken(cells: list, at: int, taken: dict[int, int]) -> int:
    """The first free column from ``at``; the columns passed over become one empty cell."""
    start = at
    while at in taken:
        at += 1
    if at > start:
        cells.append(([""], at - start))
    return at


def text_of_page(page: str | None) -> str:
    """All visible text of a page; of null the empty text."""
    return render(build(page)) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and ``text``, one row per row of ``pages``; a null or empty page has the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [text_of_page(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, text string")


by_value(__name__)
