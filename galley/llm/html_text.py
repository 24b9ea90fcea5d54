"""Visible text of HTML pages, laid out as a browser would: blocks, lists and aligned table cells.

A page is cut into tags and text, a tree builder opens and closes elements with the implied tags of
HTML (a new ``li`` ends the last one, a block ends an open ``p``, a ``td`` brings its ``tr``), visibility
rules take out what no reader sees, and a renderer walks the tree: collapsed white space in a line, line
breaks around blocks, a blank line around paragraphs and headings, marks and indents for lists, and
columns of equal width for tables. All visible text is kept, navigation and footers too. Each step takes time
in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title meta link style script template noscript iframe object audio video canvas datalist svg math noembed noframes area base param source track".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside caption center dd details dialog dir div dt figcaption footer form header hgroup legend li main menu nav option optgroup section summary tbody tfoot thead tr".split())
ENDS_P = (BLOCKS - frozenset("html body tr tbody tfoot thead caption option optgroup".split())) | {"hr"}
#: An opened element ends these, up to an element of the boundary.
ENDS = {
    "li": ("li", "ul ol menu dir table td th"), "dt": ("dt dd", "dl table td th"), "dd": ("dt dd", "dl table td th"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th caption", "tr table"), "th": ("td th caption", "tr table"),
    "thead": ("tr td th thead tbody tfoot caption colgroup", "table"), "tbody": ("tr td th thead tbody tfoot caption colgroup", "table"),
    "tfoot": ("tr td th thead tbody tfoot caption colgroup", "table"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPE = frozenset("table td th caption button".split())

#: Tables inside so many others are laid out as plain blocks; their text is kept.
DEEPEST = 20
#: A table is aligned if padding makes it at most so many times as long as its text; else two spaces part its cells.
PADDING = 8
#: Lists and quotations inside so many others are indented no further.
INDENT = 24

_OPEN = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*+)|[!?/])")
#: The rest of a tag: only a value in quotes may hold the sign that ends it.
_REST = re.compile(r"((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_BRACE = re.compile("[{}]")
_SIMPLE = re.compile(r"([A-Za-z][\w-]*+)?+((?:[.#][\w-]++)*+)\Z")
_SAID = re.compile(r"\s*+(display|visibility)\s*+:\s*+([a-z-]++)", re.I)


class Node:
    """An element of the tree; children are nodes and strings."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        if not self.attrs or self.attrs.isspace():
            return {}
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attrs):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return found


class Open:
    """The open elements, root first, with the places of each tag, so that no rule has to walk over them."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """End the elements from place ``at`` on."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost open element with one of the tags, 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def outermost(self, tags: frozenset, after: int) -> int:
        """The place of the outermost of them beyond place ``after``, 0 for none."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, after)) < len(p)]
        return min(found, default=0)


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree of a page and the texts of its style elements."""
    root = Node("html")
    open_, styles, at = Open(root), [], 0
    while True:
        m = _OPEN.search(source, at)
        if text := source[at : m.start() if m else len(source)]:
            text = html.unescape(text) if "&" in text else text
            if open_.top.tag == "head" and text.strip(" \t\n\r\f"):
                _leave_head(open_)
            open_.top.children.append(text)
        if not m:
            return root, styles
        if not m[2]:
            close = ">" if m[0] != "<!--" or source.startswith((">", "->"), m.end()) else "-->"
            at = source.find(close, m.end()) + len(close)
            if at < len(close):
                return root, styles  # a comment that never ends
            continue
        rest = _REST.match(source, m.end())
        if not rest:
            return root, styles  # what follows is inside a tag that never ends
        at, attrs = rest.end(), rest[1]
        tag = m[2].lower()
        if m[1]:
            _end(open_, tag)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                _leave_head(open_)
            if attrs:
                (root if tag == "html" else open_.top).attrs += attrs if tag == "html" or len(open_.nodes) == 1 else ""
            continue
        _make_way(open_, tag)
        node = Node(tag, attrs.rstrip("/"))
        open_.top.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(source, at)
            content = source[at : close.start()]
            if tag == "style":
                styles.append(content)
            elif content:
                node.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
            at = close.end()
            continue
        open_.push(node)


def _leave_head(open_: Open) -> None:
    """Ends a head that nothing has closed."""
    while len(open_.nodes) > 1 and open_.top.tag == "head":
        open_.cut(len(open_.nodes) - 1)


def _make_way(open_: Open, tag: str) -> None:
    """Ends what ``tag`` ends by implication, and opens what it implies."""
    if tag not in UNSEEN:
        _leave_head(open_)
    if tag in ENDS_P and (p := open_.last("p")) > open_.last(*SCOPE):
        open_.cut(p)
    if tag in ENDS:
        ended, boundary = ENDS[tag]
        if first := open_.outermost(ended, open_.last(*(boundary - ended))):
            open_.cut(first)
    if tag in ("td", "th") and open_.top.tag in ("table", "thead", "tbody", "tfoot"):
        row = Node("tr")
        open_.top.children.append(row)
        open_.push(row)


def _end(open_: Open, tag: str) -> None:
    if tag == "br":
        open_.top.children.append(Node("br"))
        return
    barrier = SCOPE if tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption") else ("table",)
    at = open_.last(tag)
    if at and at >= open_.last(*barrier):
        open_.cut(at)
        return
    if tag == "p":  # an end without a start is an empty paragraph
        open_.top.children.append(Node("p"))


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of a style sheet's rules, in one pass; at-rules are passed over with all that is in them."""
    parts, at = [], 0
    while (begin := sheet.find("/*", at)) >= 0:
        parts.append(sheet[at:begin])
        end = sheet.find("*/", begin + 2)
        at = end + 2 if end >= 0 else len(sheet)
    sheet = "".join([*parts, sheet[at:]])
    depth, start, body, inner, selectors = 0, 0, 0, None, ""
    for m in _BRACE.finditer(sheet):
        if m[0] == "{":
            if depth == 0:
                selectors, body, inner = sheet[start : m.start()].rpartition(";")[2], m.end(), None
            elif depth == 1 and inner is None:
                inner = m.start()  # rules inside a rule are passed over
            depth += 1
            continue
        depth = max(0, depth - 1)
        if depth == 0:
            if body > start and not selectors.lstrip().startswith("@"):
                yield selectors, sheet[body : m.start() if inner is None else inner]
            start = m.end()
    if depth and not selectors.lstrip().startswith("@"):
        yield selectors, sheet[body:inner]


def _said(declarations: str) -> dict[str, tuple[bool, str]]:
    """What declarations say of display and visibility: whether it is important, and the value. Later ones win, but not over important ones."""
    found: dict[str, tuple[bool, str]] = {}
    for one in declarations.split(";"):
        if m := _SAID.match(one):
            name, value, important = m[1].lower(), m[2].lower(), "!important" in one.lower().replace(" ", "")
            if name == "visibility" and value not in ("hidden", "collapse", "visible"):
                continue
            if important >= found.get(name, (False,))[0]:
                found[name] = important, value
    return found


class Visibility:
    """Which elements a reader sees, by element, attributes and the page's plain style rules.

    Of all rules that match an element the important ones win, then those with more ids, classes and element names in the
    selector, then the last one; a style attribute stands above rules that aren't important, and all of them above the
    attribute ``hidden``. Rules with combinators or pseudo-classes, and those inside at-rules, aren't applied.

    Rules of one selector are one, and each is filed under the rarest of its id, classes and element, so that an
    element is tested by few of them.
    """

    def __init__(self, styles: list[str]) -> None:
        rules: dict[tuple[str, frozenset, frozenset], dict[str, tuple]] = {}  # selector -> display and visibility: important, weight, order, value
        at = 0
        for sheet in styles:
            for selectors, body in _rules(sheet):
                said = _said(body)
                for s in selectors.split(",") if said else ():
                    if (m := _SIMPLE.match(s.strip())) and m[0]:
                        parts = re.findall(r"[.#][\w-]+", m[2])
                        selector = (m[1] or "").lower(), frozenset(p[1:] for p in parts if p[0] == "."), frozenset(p[1:] for p in parts if p[0] == "#")
                        weight = sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), bool(m[1])
                        at += 1
                        held = rules.setdefault(selector, {})
                        for name, (important, value) in said.items():
                            held[name] = max(held.get(name, (False,)), (important, weight, at, value))
        names = lambda r: [f"#{i}" for i in r[2]] + [f".{c}" for c in r[1]] + ([r[0] or "*"] if not r[1] and not r[2] else [])
        often = Counter(n for r in rules for n in names(r))
        self.filed: dict[str, list[tuple]] = {}
        for r, effect in rules.items():
            self.filed.setdefault(min(names(r), key=lambda n: (often[n], n)), []).append((*r, effect))

    def of(self, node: Node, hidden: bool) -> tuple[bool, bool]:
        """Whether the element makes a box at all, and whether its own text is hidden."""
        if node.tag in UNSEEN:
            return False, hidden
        if not self.filed and (not node.attrs or node.attrs.isspace()):
            return node.tag != "dialog", hidden
        a = node.attributes()
        if node.tag == "input" and a.get("type", "").lower() == "hidden":
            return False, hidden
        best: dict[str, tuple] = {}
        if self.filed:
            classes, ids = set(a.get("class", "").split()), {a.get("id", "")}
            for name in ("*", node.tag, *(f".{c}" for c in classes), *(f"#{i}" for i in ids)):
                for tag, those, that, effect in self.filed.get(name, ()):
                    if tag in ("", node.tag) and those <= classes and that <= ids:
                        for what, rule in effect.items():
                            best[what] = max(best.get(what, rule), rule)
        for what, (important, value) in _said(a["style"]).items() if "style" in a else ():
            if what not in best or important >= best[what][0]:
                best[what] = important, (), 0, value
        display = best["display"][3] if "display" in best else "none" if "hidden" in a or (node.tag == "dialog" and "open" not in a) else ""
        if display == "none":
            return False, hidden
        return True, best["visibility"][3] != "visible" if "visibility" in best else hidden


class Layout:
    """Lines under construction: text, line breaks that are due, and marks of list items."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.due = 0  # line breaks before the next text
        self.space = False  # a collapsed space before the next text
        self.indent = 0
        self.mark = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            lines = s.split("\n")
            for k, line in enumerate(lines):
                if k:
                    self.due += 1
                if line:
                    self._put(line)
            return
        words = _SPACES.sub(" ", s)
        if not words:
            return
        lead, trail, words = words[0] == " ", words[-1] == " ", words.strip(" ")
        self.space |= lead
        if words:
            if self.space and self.parts and not self.due:
                words = " " + words
            self._put(words)
            self.space = trail

    def _put(self, s: str) -> None:
        if self.parts and self.due:
            self.parts.append("\n" * self.due)
        if (self.due or not self.parts) and (self.indent or self.mark):
            s = "  " * max(0, min(self.indent, INDENT) - bool(self.mark)) + self.mark + s.lstrip(" ")
            self.mark = ""
        self.parts.append(s)
        self.due, self.space = 0, False

    def lines(self, n: int) -> None:
        """At least ``n`` line breaks before what follows."""
        if n > self.due:
            self.due = n
        self.space = False

    def done(self) -> str:
        return "".join(self.parts)


def _options(node: Node) -> list[Node]:
    """The option that a closed select shows: the chosen one, else the first."""
    found, todo = [], [node]
    for each in todo:  # grows meanwhile
        for c in each.children:
            if isinstance(c, Node):
                (found if c.tag == "option" else todo).append(c)
    return [next((o for o in found if "selected" in o.attributes()), found[0])] if found else []


def _number(value: str, least: int, most: int) -> int:
    m = re.match(r"\s*(\d{1,9})", value)
    return max(least, min(most, int(m[1]))) if m else least


def render(node: Node, see: Visibility, hidden: bool = False, tables: int = 0) -> str:
    """The text of an element. Walks with a stack of its own: pages nest as deep as they like."""
    out = Layout()
    todo: list = [(node, hidden, False, None)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        child, unseen, keep, lists = item
        if isinstance(child, str):
            if not unseen:
                out.text(child, keep)
            continue
        tag = child.tag
        box, unseen = see.of(child, unseen)
        if not box:
            continue
        if tag == "br":
            out.due, out.space = out.due + 1, False
            continue
        if tag == "input" and not unseen:
            a = child.attributes()
            if a.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image", "color", "range"):
                out.text(a.get("value", ""), False)
            continue
        gap = 2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists) else 1 if tag in BLOCKS else 0
        if gap:
            out.lines(gap)
        if tag == "table" and tables < DEEPEST:
            if text := _table(child, see, unseen, tables + 1):
                for k, line in enumerate(text.split("\n")):
                    if k:
                        out.due += 1
                    if line:
                        out._put(line)
            out.lines(gap)
            continue
        children, after = child.children, []
        if tag == "select":
            children = _options(child)
        elif tag == "details" and "open" not in child.attributes():
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in ("ul", "ol", "menu", "dir"):
            lists = {"next": _number(child.attributes().get("start", "1"), 0, 10**9) if tag == "ol" else None}
            out.indent += 1
            after.append(lambda: setattr(out, "indent", out.indent - 1))
        elif tag == "li":
            if lists and lists["next"] is not None:
                out.mark, lists["next"] = f"{lists['next']}. ", lists["next"] + 1
            else:
                out.mark = "- "
            after.append(lambda: setattr(out, "mark", ""))
        elif tag in ("dd", "blockquote"):
            out.indent += 1
            after.append(lambda: setattr(out, "indent", out.indent - 1))
        elif tag in ("td", "th"):
            out.space = True
        keep = keep or tag in ("pre", "textarea", "xmp")
        if gap:
            todo.append(lambda n=gap: out.lines(n))
        todo += after
        todo += [(c, unseen, keep, lists) for c in reversed(children)]
    return out.done()


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of columns with neighbours that end in the same row made one."""
    out: list[tuple[int, int, int]] = []
    for start, end, last in spans:
        if out and out[-1][2] == last and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end), last)
        else:
            out.append((start, end, last))
    return out


def _table(table: Node, see: Visibility, hidden: bool, depth: int) -> str:
    """Rows as lines (or more, if a cell has several) with columns of equal width, two spaces apart, up to ``PADDING``."""
    rows: list[dict[int, str]] = []
    titles: list[str] = []
    covered: list[tuple[int, int, int]] = []  # columns that cells above cover, as start, end and the last row, by start
    n_rows = sum(sum(isinstance(x, Node) and x.tag == "tr" for x in [c, *c.children]) for c in table.children if isinstance(c, Node))
    todo = [(c, hidden) for c in reversed(table.children)]
    while todo:
        c, unseen = todo.pop()
        if isinstance(c, str):
            if not unseen and c.strip():
                titles.append(_SPACES.sub(" ", c).strip())
            continue
        box, now = see.of(c, unseen)
        if not box:
            continue
        if c.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += [(x, now) for x in reversed(c.children)]
        elif c.tag == "tr":
            row: dict[int, str] = {}
            at, i = 0, 0
            covered = [x for x in covered if x[2] >= len(rows)]
            new: list[tuple[int, int, int]] = []
            for x in c.children:
                if isinstance(x, str):
                    if not now and x.strip():
                        titles.append(_SPACES.sub(" ", x).strip())
                    continue
                seen, _ = see.of(x, now)
                if not seen:
                    continue
                while i < len(covered) and covered[i][0] <= at:
                    at, i = max(at, covered[i][1]), i + 1
                a = x.attributes()
                row[at] = render(x, see, now, depth)
                wide, high = _number(a.get("colspan", "1"), 1, 1000), _number(a.get("rowspan", "1"), 1, 10000)
                if high > 1:
                    new.append((at, at + wide, min(n_rows, len(rows) + high - 1)))
                at += wide
            if new:
                covered = _joined(sorted(covered + new))
            rows.append(row)
        elif text := render(c, see, unseen, depth):
            titles.append(text)
    split = [{k: x.split("\n") for k, x in r.items()} for r in rows]
    columns = sorted({k for r in rows for k in r})
    place = {k: i for i, k in enumerate(columns)}
    widths = [0] * len(columns)
    for r in split:
        for k, x in r.items():
            widths[place[k]] = max(widths[place[k]], *map(len, x))
    starts = [0, *accumulate(w + 2 for w in widths)]
    lines = [[(k, x[n]) for k, x in sorted(r.items()) if n < len(x) and x[n]] for r in split for n in range(max(map(len, r.values()), default=0))]
    padded = sum(starts[place[cells[-1][0]]] + len(cells[-1][1]) for cells in lines if cells)
    aligned = padded <= PADDING * (64 + sum(len(x) for cells in lines for _, x in cells))
    out = list(titles)
    for cells in lines:
        if not aligned:
            out.append("  ".join(x for _, x in cells).rstrip())
            continue
        line: list[str] = []
        at = 0
        for k, x in cells:
            line += [" " * (starts[place[k]] - at), x]
            at = starts[place[k]] + len(x)
        out.append("".join(line).rstrip())
    return "\n".join(out).strip("\n")


def page_text(source: str | None) -> str | None:
    """The visible text of a page, None for None."""
    if source is None:
        return None
    root, styles = parse(source.replace("\r\n", "\n").replace("\r", "\n"))
    return render(root, Visibility(styles))


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """``key``, text, n_lines of every row's page.

    Null pages give a null text and 0 lines, empty ones and ones without visible text ''. Broken markup,
    open tags and tags that never end are read as browsers do; nothing is dropped because of length.
    Repeated rows are rendered one by one, an empty table gives an empty result, other columns are
    ignored. One pass over the scan, nothing is shuffled; a task holds one page's tree at a time.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sources = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                texts = [page_text(s) for s in sources.slice(at, 256).to_pylist()]
                lines = [t.count("\n") + 1 if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=[key, "text", "n_lines"])

    key_type = pages.schema[key].dataType.simpleString()
    return pages.select(key, source).mapInArrow(run, f"{key} {key_type}, text string, n_lines long")


def query(spark, sf_dir):
    """The visible text of every page of ``pages``."""
    from galley.session import table

    return extract(table(spark, sf_dir, "pages"))
