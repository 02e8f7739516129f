"""HTML to text as laid out: a tree builder with implied tags, visibility rules, and a renderer.

Builder: one pass over tags; start tags close what they imply (a block closes an open p, li
closes li, cells close cells, rows close rows, and so on, within their list or table);
void elements have no content; script, style, title and textarea are raw; an end tag without a
start is dropped, and one for an outer element closes what is open inside. Nesting below
MAX_DEPTH goes on at that depth, as in browsers.

Visible: all text but that of head elements, scripts, styles, templates and embedded content, of
elements with `hidden`, `display: none` or `visibility: hidden` (a child may turn the last back),
by attribute or by a simple selector (tag, .class, #id) of a style element, and of a closed
details but for its summary. Without scripts, noscript is shown.

Layout: white space collapses except in pre; blocks start lines, paragraphs and the like keep a
blank line; lists have marks, numbers and indents; the cells of a table stand in a grid, with
row and column spans, and are padded to columns, cells of several lines as well.

Defined results: null and empty html give an empty text; broken markup gives what a lenient
reader sees; a span that is no number counts as 1; a page that can't be laid out gives its plain
text and is marked as degraded; a page of any length is laid out whole, in the memory of one task;
repeated rows are rendered each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 200
#: What a cell spans at most; blanks between columns are GAP.
MAX_COLUMNS, MAX_ROWS, GAP = 1000, 65534, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
#: Never shown.
UNSEEN = frozenset("head title script style template iframe object embed svg math canvas audio video map datalist link meta base noembed noframes param source track col colgroup".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks with a blank line around.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre figure fieldset hr article section details".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup td th tr tbody thead tfoot caption legend".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag: the open elements that it closes, and those at which the search for them ends.
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th body".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th body".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th body".split())),
    "option": (frozenset(["option"]), frozenset("select datalist body".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset("select body".split())),
    "td": (frozenset(["td", "th"]), frozenset("tr table body".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table body".split())),
    "tr": (frozenset("td th tr caption colgroup".split()), frozenset("table body".split())),
    **{t: (frozenset("td th tr tbody thead tfoot caption colgroup".split()), frozenset("table body".split())) for t in ("tbody", "thead", "tfoot", "caption", "colgroup")},
    "body": (frozenset(["head"]), frozenset()),
}
#: An end tag does not reach beyond these.
WALLS = frozenset("table td th caption template".split())
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_NONE, _HIDDEN, _VISIBLE = (re.compile(p, re.I) for p in (r"(?:^|;)\s*display\s*:\s*none\b", r"(?:^|;)\s*visibility\s*:\s*(?:hidden|collapse)\b", r"(?:^|;)\s*visibility\s*:\s*visible\b"))
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for k, *v in _ATTR.findall(self.attrs):
            if k.lower() == name:
                return unescape(v[0] or v[1] or v[2])
        return None


def build(html: str) -> tuple[Node, list[str]]:
    """The tree below its root, and the contents of style elements."""
    root = Node("html")
    open_, styles, at, low = [root], [], 0, None
    search = _TAG.search
    while m := search(html, at):
        if m.start() > at:
            open_[-1].children.append(html[at : m.start()])
        at = m.end()
        if tag := m[2]:
            tag = tag.lower()
            if tag == "html" or (tag == "body" and any(n.tag == "body" for n in open_)):
                continue
            if tag in CLOSES_P:
                _close(open_, frozenset(["p"]), WALLS | {"button"}, once=True)
                if tag in _HEADINGS and open_[-1].tag in _HEADINGS:
                    open_.pop()
            if implied := IMPLIED.get(tag):
                _close(open_, *implied)
            node = Node(tag, m[3])
            open_[-1].children.append(node)
            if tag in RAW:
                low = low or html.lower()
                end = low.find(f"</{tag}", at)
                end = len(html) if end < 0 else end
                if tag == "style":
                    styles.append(html[at:end])
                elif tag in ("textarea", "xmp"):
                    node.children.append(html[at:end])
                close = html.find(">", end)
                at = len(html) if close < 0 else close + 1
            elif tag not in VOID and len(open_) < MAX_DEPTH:
                open_.append(node)
        elif tag := m[1]:
            tag = tag.lower()
            if tag == "br":
                open_[-1].children.append(Node("br"))
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
        elif m[0].startswith("<![CDATA["):
            open_[-1].children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
    if at < len(html):
        open_[-1].children.append(html[at:])
    return root, styles


def _close(open_: list[Node], tags: frozenset[str], until: frozenset[str], once: bool = False) -> None:
    """Closes the outermost open element of `tags` this side of `until`, with what is open in it."""
    found = 0
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag in until:
            break
        if open_[i].tag in tags:
            found = i
            if once:
                break
    if found:
        del open_[found:]


def hiding(styles: list[str]) -> dict[str, str]:
    """Simple selectors (tag, .class, #id) of style elements that hide: none, hidden or visible."""
    found: dict[str, str] = {}
    for css in styles:
        if "none" not in css and "visib" not in css:
            continue
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
            kind = "none" if _NONE.search(body) else "hidden" if _HIDDEN.search(body) else "visible" if _VISIBLE.search(body) else ""
            if kind:
                found |= {s: kind for x in selectors.split(",") if re.fullmatch(r"[.#]?[\w-]+", s := x.strip())}
    return found


class Lines:
    """Text under layout: lines, the line that is open, and the blank lines owed."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.owed = False

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            for i, x in enumerate([first, *rest]):
                if i:
                    self.lines.append("".join(self.now).rstrip())
                    self.now = []
                if x:
                    self._pay()
                    self.now.append(x)
            self.space = False
            return
        s = _SPACE.sub(" ", s)
        if s[:1] == " ":
            self.space = True
            s = s[1:]
        if s:
            self._pay()
            if self.space and self.now:
                self.now.append(" ")
            self.space = s[-1] == " "
            self.now.append(s[:-1] if self.space else s)

    def _pay(self) -> None:
        if self.owed and not self.now:
            if self.lines:
                self.lines.append("")
            self.owed = False

    def line(self, force: bool = False) -> None:
        if self.now or force:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def gap(self) -> None:
        self.line()
        self.owed = bool(self.lines)

    def put(self, rows: list[str]) -> None:
        self.line()
        if rows:
            self._pay()
            self.lines += rows

    def done(self) -> list[str]:
        self.line()
        rows = self.lines
        while rows and not rows[-1]:
            rows.pop()
        while rows and not rows[0]:
            rows.pop(0)
        return rows


class Renderer:
    def __init__(self, rules: dict[str, str]):
        self.rules = rules

    def shown(self, n: Node, seen: bool) -> bool | None:
        """None: not there at all; else whether its own text is seen."""
        if n.tag in UNSEEN:
            return None
        state = self.rules.get(n.tag) if self.rules else None
        if n.attrs.strip():
            if self.rules:
                for c in (n.get("class") or "").split():
                    state = self.rules.get("." + c, state)
                state = self.rules.get(f"#{n.get('id')}", state)
            low = n.attrs.lower()
            if "hidden" in low and (n.get("hidden") is not None or n.tag == "input"):
                return None
            if "style" in low and (style := n.get("style")):
                state = "none" if _NONE.search(style) else "hidden" if _HIDDEN.search(style) else "visible" if _VISIBLE.search(style) else state
        return None if state == "none" else False if state == "hidden" else True if state == "visible" else seen

    def inside(self, n: Node, out: Lines, seen: bool, keep: bool, depth: int = 0) -> None:
        for c in n.children:
            if isinstance(c, str):
                if seen:
                    out.text(unescape(c) if "&" in c else c, keep)
            else:
                self.element(c, out, seen, keep, depth)

    def element(self, n: Node, out: Lines, seen: bool, keep: bool, depth: int) -> None:
        now = self.shown(n, seen)
        if now is None:
            return
        tag = n.tag
        if tag == "br":
            if now:
                out.line(force=True)
        elif tag == "hr":
            out.gap()
        elif tag == "img":
            if now and (alt := n.get("alt")):
                out.text(alt, False)
        elif tag == "input":
            if now and (value := n.get("value")) and (n.get("type") or "text").lower() not in ("checkbox", "radio", "file", "password", "image"):
                out.text(value, False)
        elif tag in ("ul", "ol", "menu", "dir"):
            (out.line if depth else out.gap)()
            self.list(n, out, now, keep, depth)
            (out.line if depth else out.gap)()
        elif tag == "table":
            out.gap()
            out.put(self.table(n, now))
            out.gap()
        elif tag == "details" and n.get("open") is None:
            out.gap()
            for c in n.children:
                if isinstance(c, Node) and c.tag == "summary":
                    self.element(c, out, now, keep, depth)
            out.gap()
        elif tag in BLOCKS:
            around = out.gap if tag in SPACED else out.line
            around()
            if tag in ("blockquote", "dd"):
                out.put(["  " + x if x else x for x in self.lines(n, now, keep, depth)])
            elif tag == "pre":
                out.put(self.lines(n, now, True, depth))
            else:
                self.inside(n, out, now, keep, depth)
            around()
        else:
            self.inside(n, out, now, keep or tag in ("textarea", "xmp"), depth)

    def lines(self, n: Node, seen: bool, keep: bool, depth: int = 0) -> list[str]:
        out = Lines()
        self.inside(n, out, seen, keep, depth)
        return out.done()

    def list(self, n: Node, out: Lines, seen: bool, keep: bool, depth: int) -> None:
        start = n.get("start") if n.tag == "ol" else None
        number = int(start) if start and re.fullmatch(r"-?\d{1,9}", start.strip()) else 1
        for c in n.children:
            if isinstance(c, str):
                if seen and c.strip():
                    out.text(unescape(c), keep)
                continue
            if c.tag != "li":
                self.element(c, out, seen, keep, depth + 1)
                continue
            if (now := self.shown(c, seen)) is None:
                continue
            rows = self.lines(c, now, keep, depth + 1)
            mark = f"{number}. " if n.tag == "ol" else "- "
            number += 1
            if rows:
                out.put([mark + rows[0], *(" " * len(mark) + x if x else x for x in rows[1:])])

    def table(self, n: Node, seen: bool) -> list[str]:
        """Lines of a table: cells stand in a grid, where a cell may span rows and columns."""
        cells: list[tuple[int, int, int, int, list[str]]] = []  # row, column, rows, columns, lines
        before: list[str] = []
        until: dict[int, int] = {}  # by column: the row before which a cell from above ends
        row, at, group = -1, 0, 0

        def cell(lines: list[str], high: int, wide: int) -> None:
            nonlocal at
            # browsers let a wide cell run over one that spans rows from above; here it goes to the next room
            while taken := [k for k in range(at, at + wide) if until.get(k, 0) > row]:
                at = taken[-1] + 1
            cells.append((row, at, high, wide, lines))
            until.update(dict.fromkeys(range(at, at + wide), row + high))
            at += wide

        def span(c: Node, name: str, most: int) -> int:
            m = re.match(r"[ \t\n\r\f]*\+?([0-9]{1,9})", c.get(name) or "", re.A)
            return min(int(m[1]), most) if m else 1

        def take(c: Node | str, seen: bool) -> None:
            if isinstance(c, str):
                if seen and c.strip():
                    cell([_SPACE.sub(" ", unescape(c)).strip()], 1, 1)
            elif c.tag in ("td", "th"):
                if (now := self.shown(c, seen)) is not None:
                    high = span(c, "rowspan", MAX_ROWS) or MAX_ROWS  # 0: to the end of its group
                    cell(self.lines(c, now, False), high, max(span(c, "colspan", MAX_COLUMNS), 1))
            elif text := self.lines_of(c, seen):
                cell(text, 1, 1)

        def ended() -> None:
            """No cell reaches beyond its group of rows."""
            nonlocal group
            cells[group:] = [(top, k, min(high, row + 1 - top), wide, lines) for top, k, high, wide, lines in cells[group:]]
            group = len(cells)
            until.clear()

        def walk(parent: Node, seen: bool) -> None:
            nonlocal row, at
            loose = False
            for c in parent.children:
                if isinstance(c, str):
                    if seen and c.strip():
                        before.append(_SPACE.sub(" ", unescape(c)).strip())
                    continue
                if (now := self.shown(c, seen)) is None:
                    continue
                if c.tag in ("tbody", "thead", "tfoot"):
                    ended()
                    walk(c, now)
                    ended()
                elif c.tag == "caption":
                    before.extend(self.lines(c, now, False))
                elif c.tag == "tr":
                    row, at, loose = row + 1, 0, False
                    for x in c.children:
                        take(x, now)
                elif c.tag in ("td", "th"):
                    if not loose:
                        row, at, loose = row + 1, 0, True
                    take(c, seen)
                else:
                    before.extend(self.lines_of(c, seen))

        walk(n, seen)
        ended()
        columns = sorted({at for _, at, *_ in cells})  # where a cell starts
        place = {at: k for k, at in enumerate(columns)}
        width, height = [0] * len(columns), [0] * (row + 1)
        for _, at, _, wide, lines in sorted(cells, key=lambda c: c[3]):  # narrow cells first; wide ones widen their last column
            end = bisect_left(columns, at + wide)
            room = sum(width[place[at] : end]) + GAP * (end - place[at] - 1)
            width[end - 1] += max(max(map(len, lines), default=0) - room, 0)
        for top, _, high, _, lines in sorted(cells, key=lambda c: c[2]):
            height[top] = max(height[top], min(len(lines), 1))
            height[top + high - 1] += max(len(lines) - sum(height[top : top + high]), 0)
        left, first = [0], [0]
        for w in width:
            left.append(left[-1] + w + GAP)
        for h in height:
            first.append(first[-1] + h)
        out = [""] * first[-1]
        for top, at, _, _, lines in sorted(cells, key=lambda c: c[1]):
            for k, line in enumerate(lines, first[top]):
                if line:
                    out[k] = out[k].ljust(left[place[at]]) + line
        return before + [x.rstrip() for x in out]

    def lines_of(self, n: Node, seen: bool) -> list[str]:
        out = Lines()
        self.element(n, out, seen, False, 0)
        return out.done()


def render(html: str | None) -> str:
    """All visible text of a page, as laid out."""
    if not html:
        return ""
    root, styles = build(html)
    return "\n".join(Renderer(hiding(styles)).lines(root, True, False))


def plain(html: str) -> str:
    """The text of a page without its tags, line by line: what is left of a page that can't be laid out."""
    return "\n".join(x for line in unescape(_TAG.sub(" ", html)).splitlines() if (x := _SPACE.sub(" ", line).strip()))


def rendered(html: str | None) -> tuple[str, bool]:
    """The text of a page, and whether it is only its plain text: one bad page must not stop a corpus."""
    try:
        return render(html), False
    except Exception:
        return plain(html or ""), True


def render_pages(pages: DataFrame, status: bool = False) -> DataFrame:
    """(page_id, text) for every row of pages (page_id, html); with status, also degraded: the page could not be laid out."""
    names = ["page_id", "text", "degraded"][: 3 if status else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rendered(x.as_py()) for x in b.column(1)]
            columns = [b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([d for _, d in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    schema = "page_id long, text string" + (", degraded boolean" if status else "")
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
