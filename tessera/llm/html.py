"""Visible text of HTML pages, laid out as it would be read.

A tokenizer and a tree builder with implied tags turn any byte of markup into a tree: paragraphs, list items,
table rows and cells end where the next one or their container begins, head and body need no tags. Elements that
aren't shown are left out by tag, attribute, inline style or the rules of the page's own style sheets (tags, classes,
ids, attributes, descendants and children, by specificity; print-only rules don't count). What is merely invisible
may hold what is visible again. Text in drawings and formulas is shown; their titles, definitions and annotations aren't.

What remains is written block by block: paragraphs and headings stand apart by an empty line, list items have markers
and indents of up to ``DEEPEST`` columns, preformatted text keeps its white space. Table cells are aligned by their width
on screen; as in a browser, text in a cell is wrapped, at ``WRAP`` columns, while words stay whole up to ``LONGEST_WORD``;
a cell over several columns widens these.

Nothing recurses, so nesting may be of any depth. Null and empty pages give an empty text; markup that ends
within a tag loses that tag; pages without any tags are plain text. Repeated rows give the same text each; other
columns are kept, but for one of the made column's name.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from .arrow import fields, map_columns

TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
COMMENT_END = re.compile(r"--!?>")
SPACE = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
UNSEEN = frozenset("head script style template datalist audio video canvas iframe noembed noframes map area title".split())
#: Parts of drawings and formulas that aren't shown where they stand.
UNSEEN |= frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that stand apart by an empty line, and those that only begin a line of their own.
APART = HEADINGS | frozenset("p blockquote pre ul ol dl table figure fieldset menu dir".split())
BLOCKS = APART | frozenset("html body div article section nav header footer main aside address center details summary dialog form li dt dd figcaption legend hgroup search optgroup tr td th caption hr text foreignobject".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("html body tr td th caption text foreignobject".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset("td th".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: End tags and implied ends don't reach beyond these.
BARRIERS = frozenset("table td th caption template html button object".split())
SHOWN_INPUTS = frozenset("text search url tel email number submit button reset".split())
#: Columns at which text in cells is wrapped; longer words are broken only beyond the second number.
WRAP, LONGEST_WORD = 80, 1000
#: Lines are indented so far, at most.
DEEPEST = 64
SPAN = 1000


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


def tokens(page: str):
    """("text", s), ("start", tag, attributes), ("end", tag), and raw texts after their start tags."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], None
            return
        if lt > at:
            yield "text", page[at:lt], None
        c = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            m = COMMENT_END.search(page, lt + 4)
            at = m.end() if m else n
        elif c in ("!", "?") or c == "/" and not page[lt + 2 : lt + 3].isalpha():
            gt = page.find(">", lt)
            at = gt + 1 if gt >= 0 else n
        elif c.isalpha() and c.isascii() or c == "/":
            m = TAG.match(page, lt)
            if not m:
                return  # the page ends within a tag
            tag, at = m[1].lower(), m.end()
            if c == "/":
                yield "end", tag, None
                continue
            yield "start", tag, attributes(m[2]) if m[2].strip() else {}
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else n
                yield "raw", page[at:stop], None
                at = stop
        else:
            yield "text", "<", None
            at = lt + 1


class Builder:
    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        self.depth: Counter = Counter()

    def cut(self, k: int) -> None:
        self.depth.subtract(x.tag for x in self.open[k:])
        del self.open[k:]

    def close_to(self, wanted: frozenset[str], barriers: frozenset[str]) -> bool:
        """Closes the nearest open element of ``wanted``, with all inside it, unless a barrier comes first."""
        if not any(self.depth[t] for t in wanted):
            return False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in wanted:
                self.cut(k)
                return True
            if self.open[k].tag in barriers:
                return False
        return False

    def has(self, wanted: frozenset[str], barriers: frozenset[str]) -> bool:
        for x in reversed(self.open[1:]):
            if x.tag in wanted:
                return True
            if x.tag in barriers:
                return False
        return False

    def push(self, tag: str, attrs: dict[str, str] | None = None) -> Element:
        x = Element(tag, attrs)
        self.open[-1].children.append(x)
        self.open.append(x)
        self.depth[tag] += 1
        return x

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            return
        if tag == "body":
            self.close_to(frozenset(("head",)), frozenset())
            if self.depth["body"]:
                return
        elif tag != "head" and tag not in HEAD_ONLY:
            self.close_to(frozenset(("head",)), BARRIERS)
        if tag in ENDS_PARAGRAPH:
            self.close_to(frozenset("p"), BARRIERS)
        if tag == "li":
            self.close_to(frozenset(("li",)), BARRIERS | LISTS)
        elif tag in ("dt", "dd"):
            self.close_to(frozenset(("dt", "dd")), BARRIERS | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close_to(frozenset(("option",)), BARRIERS | {"select"})
            if tag == "optgroup":
                self.close_to(frozenset(("optgroup",)), BARRIERS | {"select"})
        elif tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        elif tag in CELLS or tag == "tr" or tag in SECTIONS or tag == "caption":
            table = frozenset(("table", "template"))
            if self.has(frozenset(("table",)), frozenset(("template",))):
                self.close_to(CELLS | {"caption"}, table)
                if tag not in CELLS:
                    self.close_to(frozenset(("tr",)), table)
                    if tag != "tr":
                        self.close_to(SECTIONS, table)
                elif not self.has(frozenset(("tr",)), table):
                    self.push("tr")
            else:
                return  # table parts outside a table are ignored
        self.push(tag, attrs)
        if tag in VOID:
            self.cut(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", {})
        elif tag == "p":
            if not self.close_to(frozenset("p"), BARRIERS):
                self.start("p", {})
                self.cut(len(self.open) - 1)
        elif tag in HEADINGS:
            self.close_to(HEADINGS, BARRIERS)
        elif tag in ("table", "td", "th", "tr", "caption") or tag in SECTIONS:
            self.close_to(frozenset((tag,)), frozenset(("template",)) if tag == "table" else frozenset(("table", "template")))
        elif tag == "li":
            self.close_to(frozenset(("li",)), BARRIERS | LISTS)
        else:
            self.close_to(frozenset((tag,)), BARRIERS - {tag})

    def text(self, s: str) -> None:
        if self.open[-1].tag == "head" and s.strip():
            self.cut(len(self.open) - 1)
        self.open[-1].children.append(s)


def parse(page: str) -> Element:
    b = Builder()
    for kind, value, attrs in tokens(page):
        if kind == "text":
            b.text(html.unescape(value))
        elif kind == "raw":
            b.open[-1].children.append(html.unescape(value) if b.open[-1].tag in ("textarea", "title") else value)
        elif kind == "start":
            b.start(value, attrs)
        else:
            b.end(value)
    return b.root


# Visibility.

DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
COMPOUND = re.compile(r"(?:[A-Za-z][\w-]*|\*)?(?:[.#][\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\])*")
PART = re.compile(r"([.#]?)([A-Za-z_*][\w-]*|[\w-]+)|\[([\w-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([\w-]+)))?\]")
COMBINATOR = re.compile(r"\s*>\s*|\s+")


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """What a style says of display and visibility: whether it is important, and the value."""
    out: dict[str, tuple[bool, str]] = {}
    for m in DECLARATION.finditer(style):
        name = m[1].lower()
        if name not in out or m[3] or not out[name][0]:
            out[name] = (bool(m[3]), m[2].lower())
    return out


def sheet_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet, those within media rules for a screen included."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
    at, n, skipping = 0, 0, 0  # open blocks, and how many of them belong to something that doesn't count
    for m in re.finditer(r"[{}]", sheet):
        head = sheet[at : m.start()].rpartition(";")[2].strip() if m[0] == "{" else ""
        if m[0] == "}":
            n, skipping = max(0, n - 1), min(skipping, max(0, n - 1))
        elif head.startswith("@") or skipping:
            n += 1
            screen = re.match(r"@(media|supports|layer)\b", head, re.I) and not re.fullmatch(r"@media\s+(only\s+)?print\b[^,]*", head, re.I)
            if not skipping and not screen:
                skipping = n
            skipping = n if skipping else 0
        else:
            n += 1
            end = sheet.find("}", m.end())
            yield head, sheet[m.end() : end if end >= 0 else len(sheet)]
        at = m.end()


@dataclass
class Step:
    """One compound of a selector, as the place that it has among all."""

    tag: str
    names: tuple[tuple[str, str], ...]
    attributes: tuple[tuple[str, str | None], ...]
    #: The compound before it, if any, and whether that must be the parent.
    before: int
    child: bool
    #: What holds for an element that the whole selector matches: by property, its rank and value.
    says: dict[str, tuple[tuple, str]]


def steps_of(selector: str, first: int) -> list[Step] | None:
    """The steps of a selector; None for one that isn't understood."""
    out: list[Step] = []
    at, child = 0, False
    while True:
        m = COMPOUND.match(selector, at)
        if not m or not m[0]:
            return None
        tag, names, attributes_ = "", [], []
        for p in PART.finditer(m[0]):
            if p[3]:
                attributes_.append((p[3].lower(), next((g for g in p.groups()[3:] if g is not None), None)))
            elif p[1]:
                names.append((p[1], p[2]))
            else:
                tag = "" if p[2] == "*" else p[2].lower()
        out.append(Step(tag, tuple(names), tuple(attributes_), first + len(out) - 1 if out else -1, child, {}))
        at = m.end()
        if at == len(selector):
            return out
        m = COMBINATOR.match(selector, at)
        if not m:
            return None
        at, child = m.end(), ">" in m[0]


class Sheets:
    """The rules of a page's style sheets that tell whether something is shown.

    Selectors are matched on the way down: an element knows which steps it matches itself and which ones something above
    it matches, as bits.
    """

    def __init__(self, root: Element):
        self.steps: list[Step] = []
        self.by_key: dict[tuple[str, str], list[int]] = {}
        order, stack = 0, [root]
        while stack:
            x = stack.pop()
            if x.tag == "style":
                for selectors, style in sheet_rules("".join(c for c in x.children if isinstance(c, str))):
                    said = declared(style)
                    for one in selectors.split(",") if said else ():
                        order += 1
                        self.add(one.strip(), said, order)
            stack += [c for c in reversed(x.children) if isinstance(c, Element)]

    def add(self, selector: str, said: dict[str, tuple[bool, str]], order: int) -> None:
        made = steps_of(selector, len(self.steps))
        if made is None:
            return
        names = [n for s in made for n in s.names]
        rank = (sum(k == "#" for k, _ in names), sum(k == "." for k, _ in names) + sum(len(s.attributes) for s in made), sum(bool(s.tag) for s in made))
        made[-1].says = {name: ((important, False, *rank, order), value) for name, (important, value) in said.items()}
        for s in made:
            key = s.names[0] if s.names else ("", s.tag)
            self.by_key.setdefault(key, []).append(len(self.steps))
            self.steps.append(s)

    def match(self, x: Element, parent: int, above: int) -> tuple[int, dict[str, tuple[tuple, str]]]:
        """The steps that an element matches, and what is said of it; ``parent`` and ``above`` are those of its parent and of all above."""
        own = {("", ""), ("", x.tag), *((".", c) for c in x.attrs.get("class", "").split()), ("#", x.attrs.get("id", ""))}
        bits, says = 0, {}
        for i in sorted(i for key in own for i in self.by_key.get(key, ())):
            s = self.steps[i]
            fits = s.tag in ("", x.tag) and own.issuperset(s.names) and all(a in x.attrs and v in (None, x.attrs[a]) for a, v in s.attributes)
            if fits and (s.before < 0 or (parent if s.child else above) >> s.before & 1):
                bits |= 1 << i
                for name, said in s.says.items():
                    if name not in says or said[0] > says[name][0]:
                        says[name] = said
        return bits, says


def shown(x: Element, says: dict[str, tuple[tuple, str]], inside: Element | None, visible: bool) -> tuple[bool, bool]:
    """Whether an element is there at all, and whether its text is visible; ``visible`` is what its parent hands down."""
    if x.tag in UNSEEN:
        return False, False
    if inside is not None and inside.tag == "details" and "open" not in inside.attrs and x.tag != "summary":
        return False, False
    style = x.attrs.get("style")
    if style:
        for name, (important, value) in declared(style).items():
            if name not in says or (important, True) > says[name][0][:2]:
                says = {**says, name: ((important, True), value)}
    display = says["display"][1] if "display" in says else None
    if display == "none" or display is None and ("hidden" in x.attrs or x.tag == "dialog" and "open" not in x.attrs):
        return False, False
    if "visibility" in says:
        value = says["visibility"][1]
        visible = visible if value in ("inherit", "unset") else value not in ("hidden", "collapse")
    return True, visible


# Layout.


def width(s: str) -> int:
    """Columns on a screen: wide characters take two, marks that combine none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def wrapped(line: str, columns: int) -> list[str]:
    """A line's words on lines of so many columns; only a word that is longer than any should be is broken."""
    out: list[str] = []
    now, n = [], 0
    for word in line.split(" "):
        for part in (word[i : i + LONGEST_WORD] for i in range(0, max(1, len(word)), LONGEST_WORD)):
            size = width(part)
            if now and n + 1 + size > columns:
                out.append(" ".join(now))
                now, n = [], 0
            n += size + bool(now)
            now.append(part)
    return [*out, " ".join(now)]


class Writer:
    """Lines with collapsed white space, empty lines between blocks, and indents; with ``columns``, wrapped."""

    def __init__(self, columns: int = 0):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.columns = columns
        self.space = False
        self.blank = False
        self.leads = [""]
        #: How the next line begins, if it is the first one of a list item.
        self.first: str | None = None

    def indent(self, marker: str, as_first: bool) -> None:
        lead = self.leads[-1]
        if as_first:
            self.first = lead + marker
        self.leads.append(lead + " " * len(marker) if len(lead) < DEEPEST else lead)

    def outdent(self) -> None:
        self.leads.pop()

    def flush(self, keep_empty: bool = False, literal: bool = False) -> None:
        line = "".join(self.now)
        if not line.strip() and not keep_empty:
            self.now, self.space = [], False
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.leads[-1]
        parts = [line] if literal or not self.columns or len(line) <= self.columns and line.isascii() else wrapped(line, self.columns)
        for part in parts:
            self.lines.append(((self.first if self.first is not None else lead) + part).rstrip())
            self.first = None
        self.now, self.space = [], False

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s.startswith(" ") and (self.now or self.space):
            self.space = True
        body = s.strip(" ")
        if not body:
            self.space = self.space or bool(s and self.now)
            return
        if self.space and self.now and not self.now[-1].endswith(" "):
            self.now.append(" ")
        self.now.append(body.replace("\u00a0", " "))
        self.space = s.endswith(" ")

    def literal(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.now.append(first)
        for line in rest:
            self.flush(keep_empty=True, literal=True)
            self.now.append(line)

    def block(self, apart: bool, literal: bool = False) -> None:
        self.flush(literal=literal)
        self.blank = self.blank or apart

    def result(self) -> list[str]:
        self.flush()
        return self.lines


#: Columns of a table stand so far apart.
GAP = 2


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        """The cells in columns; spans leave the columns or rows that they reach over empty."""
        grid: list[dict[int, tuple[list[str], int, int]]] = []
        taken: dict[int, int] = {}  # column -> rows that a cell above still reaches over
        for row in self.rows:
            placed: dict[int, tuple[list[str], int, int]] = {}
            column = 0
            below: dict[int, int] = {}
            for cell, across, down in row:
                while taken.get(column, 0) > 0:
                    column += 1
                placed[column] = (cell, across, max(map(width, cell), default=0))
                if down > 1:
                    for c in range(column, column + across):
                        below[c] = down - 1
                column += across
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | below
            grid.append(placed)
        used = sorted({c for placed in grid for c in placed})
        place = {c: i for i, c in enumerate(used)}
        widths = [0] * len(used)
        spans: list[tuple[int, int, int]] = []
        for placed in grid:
            for c, (_, across, size) in placed.items():
                first, last = place[c], bisect_left(used, c + across) - 1
                if first == last:
                    widths[first] = max(widths[first], size)
                else:
                    spans.append((last - first, first, size))
        # A cell over several columns widens the last of them where they don't hold it.
        for more, first, size in sorted(spans):
            lack = size - sum(widths[first : first + more + 1]) - GAP * more
            if lack > 0:
                widths[first + more] += lack
        starts = list(accumulate((w + GAP for w in widths[:-1]), initial=0))
        out = []
        for placed in grid:
            for k in range(max((len(cell) for cell, _, _ in placed.values()), default=0)):
                line, at = [], 0
                for c in sorted(placed):
                    cell = placed[c][0]
                    if k < len(cell) and cell[k]:
                        start = starts[place[c]]
                        line += [" " * (start - at), cell[k]]
                        at = start + width(cell[k])
                out.append("".join(line).rstrip())
        return out


def number(x: Element, name: str, default: int, most: int) -> int:
    m = re.match(r"\s*(\d{1,6})", x.attrs.get(name, ""), re.A)
    return min(max(1, int(m[1])), most) if m else default


def render(root: Element) -> str:
    sheets = Sheets(root)
    writers, tables = [Writer()], []
    counters: list[int | None] = []
    literal = 0
    #: Of each open element: its steps, those of all above and of itself, and whether its text is visible.
    above: list[tuple[int, int, bool]] = [(0, 0, True)]
    stack: list[tuple[bool, object, Element | None]] = [(True, root, None)]
    while stack:
        enter, x, inside = stack.pop()
        w = writers[-1]
        if isinstance(x, str):
            if inside is not None and inside.tag == "details" and "open" not in inside.attrs or not above[-1][2]:
                continue
            if inside is not None and inside.tag in ("table", "tr", *SECTIONS) and not x.strip():
                continue
            (w.literal if literal else w.text)(x)
            continue
        tag = x.tag
        if enter:
            bits, says = sheets.match(x, *above[-1][:2]) if sheets.steps else (0, {})
            there, visible = shown(x, says, inside, above[-1][2])
            if not there:
                continue
            if tag == "br":
                w.flush(keep_empty=bool(w.now) or not w.blank)
                continue
            if tag == "hr":
                w.block(False)
                if visible:
                    w.now.append("---")
                w.block(False)
                continue
            if tag == "wbr" or tag in VOID and tag != "input":
                continue
            if tag == "input":
                if visible and x.attrs.get("type", "text").lower() in SHOWN_INPUTS:
                    w.text(x.attrs.get("value", ""))
                continue
            above.append((bits, above[-1][1] | bits, visible))
            if tag in CELLS and tables:
                writers.append(Writer(WRAP))
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in BLOCKS:
                # Lists inside a list don't stand apart.
                w.block(tag in APART and not (tag in LISTS and counters), literal > 0)
            if tag == "table":
                tables.append(Table())
            elif tag in LISTS:
                counters.append(number(x, "start", 1, 999_999) if tag == "ol" else None)
            elif tag == "li":
                if w.first is not None:
                    w.flush(keep_empty=True)
                marker = "- "
                if counters and counters[-1] is not None:
                    marker = f"{counters[-1]}. "
                    counters[-1] += 1
                w.indent(marker, visible)
            elif tag in ("dd", "blockquote"):
                w.indent("  ", False)
            elif tag in ("pre", "textarea"):
                literal += 1
                if x.children and isinstance(x.children[0], str) and x.children[0].startswith("\n"):
                    x.children[0] = x.children[0][1:]
            elif tag == "option":
                w.text(" ")
            stack.append((False, x, inside))
            stack += [(True, c, x) for c in reversed(x.children)]
            continue
        above.pop()
        if tag in CELLS and tables:
            lines = writers.pop().result()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((lines, number(x, "colspan", 1, SPAN), number(x, "rowspan", 1, 65_534)))
        elif tag == "table":
            lines = tables.pop().lines()
            w.block(False)
            for line in lines:
                w.now.append(line)
                w.flush(keep_empty=True, literal=True)
            w.block(True)
        elif tag in ("pre", "textarea"):
            literal -= 1
            if tag == "pre":
                w.block(True, True)
        elif tag in LISTS:
            counters.pop()
            w.block(not counters)
        elif tag == "li":
            w.block(False)
            w.first = None
            w.outdent()
        elif tag in ("dd", "blockquote"):
            w.block(tag == "blockquote")
            w.outdent()
        elif tag in BLOCKS and tag != "tr":
            w.block(tag in APART, literal > 0)
    return "\n".join(writers[0].result()).strip("\n")


def visible_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the visible text of a column of pages."""
    return map_columns(df, [html], fields(**{out: StringType()}), lambda _, pages: [(visible_text(x),) for x in pages], rows=64)
