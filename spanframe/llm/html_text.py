"""HTML extraction: layout-aware rendering of all visible text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import in_slices

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)>|(?P<text>[^<]+|<(?!/?[a-zA-Z]))""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)

#: Fixed values of the HTML standard, as far as they matter for layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript datalist title iframe noembed noframes object audio video canvas annotation annotation-xml meta link base param source track area col colgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre listing xmp blockquote figure hr fieldset form".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer header hgroup html legend li main nav optgroup option search section summary caption".split())
_ITEM_WALLS = BLOCK - frozenset("address div p li dt dd".split()) | frozenset("td th button template".split())
#: A start tag closes these open elements, unless one of the barriers lies above.
CLOSES = (
    {tag: (("p",), ("button", "td", "th", "caption")) for tag in BLOCK - {"option", "optgroup", "body", "html", "legend", "caption"}}
    | {"li": (("li", "p"), _ITEM_WALLS)}
    | {tag: (("dt", "dd", "p"), _ITEM_WALLS) for tag in ("dt", "dd")}
    | {tag: (("td", "th", "caption", "colgroup"), ("table",)) for tag in ("td", "th")}
    | {"tr": (("tr", "td", "th", "caption", "colgroup"), ("table",))}
    | {"col": (("caption",), ("table",))}
    | {tag: (("caption", "colgroup"), ("table",)) for tag in ("caption", "colgroup")}
    | {tag: (("thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th"), ("table",)) for tag in ("thead", "tbody", "tfoot")}
    | {"option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",))}
)
#: What may stand in a head; any other start tag or text ends it.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: An end tag does not reach past these.
SCOPE = frozenset("table td th caption html template".split())
#: These end tags reach past cells, up to their table.
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Of a drawing only these show text, unless one of the others lies above.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_UNSEEN = frozenset("title desc metadata defs symbol clippath mask marker pattern".split())
#: HTML start tags that end an open drawing or formula, but not inside these elements of it.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = frozenset(["svg", "math"])
INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: The largest colspan and rowspan that the standard lets a cell have.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def boxed(self) -> bool:
        """Whether the element is laid out at all; what it holds cannot undo this."""
        a = self.attrs
        if self.tag in UNSEEN or "hidden" in a or "popover" in a or (self.tag == "dialog" and "open" not in a) or (self.tag == "input"):
            return False
        return not ("style" in a and _NO_BOX.search(a["style"]))

    def seen(self, around: bool) -> bool:
        """Whether its text is visible, given whether that around it is."""
        found = _VISIBILITY.findall(self.attrs["style"]) if "style" in self.attrs else ()
        return found[-1].lower() == "visible" if found else around


def _attributes(text: str) -> dict:
    found = {}
    for name, value in _ATTR.findall(text) if text else ():
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


class _Stack:
    """Open elements, and the places of those of each tag: closing looks at
    places, so that it takes as long in a deep page as in a flat one."""

    def __init__(self, root: Element):
        self.open, self.places = [root], {}

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of ``tags``, 0 if there is none."""
        return max((p[-1] for p in map(self.places.get, tags) if p), default=0)

    def close(self, tags: tuple, barriers, outermost: bool = True) -> None:
        """Close down to the outermost of ``tags`` above any barrier, or to the
        innermost."""
        if (cut := self.last(tags)) and cut > (wall := self.last(barriers)):
            if outermost:
                inside = (p[bisect_right(p, wall)] for p in map(self.places.get, tags) if p and p[-1] > wall)
                cut = min(inside)
            self.cut(cut)

    def leave_foreign(self) -> None:
        if (at := self.last(FOREIGN)) > self.last(INSIDE):
            self.cut(at)


def build_tree(source: str) -> Element:
    """Elements with implied end tags put in; unmatched end tags are dropped."""
    stack = _Stack(root := Element("html", {}))
    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.match(source, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        if m["text"]:
            text = html.unescape(m["text"]) if "&" in m["text"] else m["text"]
            if stack.open[-1].tag == "head" and not text.isspace():
                stack.close(("head",), ())
            stack.open[-1].children.append(text)
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                if tag == "br":
                    stack.open[-1].children.append(Element("br", {}))
                stack.close((tag,), ({"table"} if tag in TABLE_PARTS else SCOPE) - {tag}, False)
                continue
            foreign = stack.last(FOREIGN)
            if foreign and tag in BREAKS:
                stack.leave_foreign()
            if tag not in HEAD:
                stack.close(("head",), ("template",))
            if tag == "body" and stack.places.get("body"):
                continue
            if tag in CLOSES:
                stack.close(*CLOSES[tag])
            element = Element(tag, _attributes(m["rest"]))
            stack.open[-1].children.append(element)
            if tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                body = source[at : stop.start() if stop else size]
                element.children.append(html.unescape(body) if tag == "textarea" else body)
                at = stop.start() if stop else size
                if stop:
                    at = (source.find(">", at) + 1) or size
            elif tag not in VOID and not ((foreign or tag in FOREIGN) and m["rest"].endswith("/")):
                stack.push(element)
    return root


def _driven(step):
    """Run a generator that yields the generators it needs the values of: calls
    as deep as the page, on a stack of their own."""
    stack, value = [step], None
    while stack:
        try:
            step = stack[-1].send(value)
            stack.append(step)
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class Page:
    """Lines of a block: inline text gathers until a break; breaks of 1 end the
    line, breaks of 2 leave a blank line before the next. With ``pre`` lines
    keep their indents."""

    def __init__(self, pre: bool = False):
        self.lines, self.inline, self.gap, self.pre = [], "", 0, pre

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        self.inline += s.lstrip(" ") if not self.inline or self.inline[-1] in " \n" else s

    def flush(self, gap: int) -> None:
        if self.pre:
            if (body := self.inline.strip("\n")).strip():
                self.put([line.rstrip() for line in body.split("\n")])
        elif self.inline.strip(" \n"):
            self.put([line.strip(" ") for line in self.inline.strip("\n").split("\n")])
        self.inline = ""
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap == 2 and self.lines[-1]:
            self.lines.append("")
        self.lines += lines
        self.gap = 0


def _render(nodes: list, page: Page, in_pre: bool, seen: bool):
    for node in nodes:
        if isinstance(node, str):
            if not seen:
                continue
            if in_pre:
                page.inline += node
            else:
                page.text(node)
            continue
        if not node.boxed():
            continue
        tag, shown = node.tag, node.seen(seen)
        if tag == "br":
            page.inline = page.inline.rstrip(" ") + "\n"
        elif tag in ("table", "ul", "ol", "menu", "dir"):
            page.flush(2)
            if lines := (yield (_table if tag == "table" else _list)(node, shown)):
                page.put(lines)
            page.flush(2)
        elif tag in ("pre", "listing", "xmp"):
            page.flush(2)
            inner = Page(pre=True)
            yield _render(node.children, inner, True, shown)
            inner.flush(0)
            if inner.lines:
                page.put(inner.lines)
            page.flush(2)
        elif tag in ("blockquote", "dd"):
            page.flush(2 if tag == "blockquote" else 1)
            if lines := (yield _lines(node.children, shown)):
                page.put([f"  {x}" if x else "" for x in lines])
            page.flush(2 if tag == "blockquote" else 1)
        elif tag == "details" and "open" not in node.attrs:
            page.flush(1)
            yield _render([c for c in node.children if isinstance(c, Element) and c.tag == "summary"][:1], page, in_pre, shown)
            page.flush(1)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            page.flush(gap)
            yield _render(node.children, page, in_pre, shown)
            page.flush(gap)
        elif tag == "svg":
            for part, visible in _svg_texts(node, shown):
                page.text(" ")
                yield _render(part.children, page, False, visible)
                page.text(" ")
        elif tag == "q":
            yield _render(['"', *node.children, '"'], page, in_pre, shown)
        else:
            yield _render(node.children, page, in_pre, shown)


def _svg_texts(node: Element, seen: bool):
    """The elements of a drawing that show text, and whether they are visible."""
    left = [(node, seen)]
    while left:
        node, seen = left.pop()
        if node.tag in SVG_TEXT:
            yield node, seen
        else:
            left += [(c, c.seen(seen)) for c in reversed(node.children) if isinstance(c, Element) and c.boxed() and c.tag not in SVG_UNSEEN]


def _lines(nodes: list, seen: bool):
    page = Page()
    yield _render(nodes, page, False, seen)
    page.flush(0)
    return page.lines


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*[-+]?\d{1,9}\s*", text) else None


def _list(node: Element, seen: bool):
    out, step = [], -1 if "reversed" in node.attrs else 1
    number = _number(node.attrs.get("start"))
    if number is None:
        number = sum(isinstance(c, Element) and c.tag == "li" and c.boxed() for c in node.children) if step < 0 else 1
    for child in node.children:
        item = isinstance(child, Element) and child.tag == "li"
        if isinstance(child, str) and not child.strip() or isinstance(child, Element) and not child.boxed():
            continue
        lines = yield _lines(child.children if item else [child], child.seen(seen) if item else seen)
        if node.tag == "ol" and item:
            if (value := _number(child.attrs.get("value"))) is not None:
                number = value
            mark, number = f"{number}. ", number + step
        else:
            mark = "- " if item else "  "
        if lines:
            out += [mark + lines[0]] + [" " * len(mark) + x if x else "" for x in lines[1:]]
    return out


def _with_cells(row: Element) -> set[int]:
    """Elements below a row that its cells hang on."""
    found, above, left = set(), {}, [row]
    while left:
        node = left.pop()
        for c in node.children:
            if isinstance(c, Element) and c.boxed():
                if c.tag in ("td", "th"):
                    up = node
                    while up is not row and id(up) not in found:
                        found.add(id(up))
                        up = above[id(up)]
                elif c.tag != "table":
                    above[id(c)] = node
                    left.append(c)
    return found


def _cells(row: Element, seen: bool, above: list[str]):
    """Cells of a row, at whatever depth, and whether they are visible; other
    visible text goes above."""
    out, holds, left = [], _with_cells(row), [(c, seen) for c in reversed(row.children)]
    while left:
        child, around = left.pop()
        if isinstance(child, str):
            if child.strip():
                above.extend((yield _lines([child], around)))
        elif not child.boxed():
            continue
        elif child.tag in ("td", "th"):
            out.append((child, child.seen(around)))
        elif id(child) in holds:
            left += [(c, child.seen(around)) for c in reversed(child.children)]
        else:
            above.extend((yield _lines([child], around)))
    return out


def _span(cell: Element, name: str, most: int) -> int:
    n = _number(cell.attrs.get(name))
    return 1 if n is None or n < 0 or n == 0 and name == "colspan" else min(n or most, most)


def _table(node: Element, seen: bool):
    """Rows of cells padded to their columns' widths, two spaces between; cells
    that span rows keep their columns free in the rows below."""
    above, groups = [], [[]]
    left, implied = [(c, seen) for c in reversed(node.children)], None
    while left:
        child, around = left.pop()
        if child is None:  # a row group ends
            groups.append([])
            implied = None
        elif isinstance(child, str):
            if child.strip():
                above.extend((yield _lines([child], around)))
        elif not child.boxed():
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            groups.append([])
            implied = None
            left.append((None, around))
            left += [(c, child.seen(around)) for c in reversed(child.children)]
        elif child.tag == "tr":
            groups[-1].append((yield _cells(child, child.seen(around), above)))
            implied = None
        elif child.tag in ("td", "th"):
            if implied is None:
                groups[-1].append(implied := [])
            implied.append((child, child.seen(around)))
        else:
            above.extend((yield _lines([child], around)))
    laid, widths, wide = [], {}, {}
    for rows in groups:
        taken = {}  # column -> rows that a cell from above still takes
        for row in rows:
            cells, column, new = [], 0, {}
            for cell, visible in row:
                while taken.get(column):
                    column += 1
                lines = yield _lines(cell.children, visible)
                span, deep = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
                cells.append((column, lines))
                width = max(map(len, lines), default=0)
                if span == 1:
                    widths[column] = max(widths.get(column, 0), width)
                elif width:
                    wide[column, span] = max(wide.get((column, span), 0), width)
                if deep > 1:
                    new |= dict.fromkeys(range(column, column + span), deep)
                column += span
            taken = {c: n - 1 for c, n in (taken | new).items() if n > 1}
            laid.append(cells)
    for (column, span), width in sorted(wide.items()):  # the last column takes what is over
        have = sum(widths[c] + 2 for c in range(column, column + span) if widths.get(c))
        if width + 2 > have:
            last = column + span - 1
            widths[last] = widths.get(last, 0) + width + 2 - have - (0 if widths.get(last) else 2)
    starts, at = {}, 0
    for column in range(max([c for cells in laid for c, _ in cells], default=-1) + 1):
        starts[column] = at
        at += widths[column] + 2 if widths.get(column, 0) > 0 else 0
    out = above
    for cells in laid:
        for i in range(max([len(lines) for _, lines in cells], default=0)):
            text = ""
            for column, lines in cells:
                piece = lines[i] if i < len(lines) else ""
                if piece:
                    text = (text.ljust(starts[column]) if len(text) <= starts[column] else text + "  ") + piece
            out.append(text.rstrip())
    return out


def render(source: str | None) -> str:
    """The visible text of a page. Null and empty pages give the empty text."""
    return "\n".join(_driven(_lines(build_tree(source).children, True))) if source else ""


def extract_text(pages: DataFrame, *, key: str = "page_id", column: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, text (never null), n_chars.

    A null key stays null, repeated rows are rendered each, an empty table gives
    an empty result, other columns are dropped.
    """

    def run(batches):
        for batch in batches:
            rows = list(zip(batch.column(0), batch.column(1)))
            for some in in_slices(rows, lambda r: len(r[1].as_py() or "")):
                texts = [render(h.as_py()) for _, h in some]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k, _ in some], batch.schema.field(0).type), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(column).alias("_html")).mapInArrow(run, f"`{key}` {kind}, text string, n_chars long")
