"""A forgiving HTML parser that gives block nodes and the text blocks they own, in page order."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

#: Where a comment, a declaration or a tag may start; a tag with quoted attributes from there.
_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

#: Elements whose content is no text of the page.
RAW = frozenset("script style template svg title textarea iframe object select datalist".split())
#: Those of them whose content runs to the first end tag, or to the end of the page.
_TO_END = frozenset("script style title textarea iframe".split())
#: Those that run to their own end tag, over others of their kind; without one only the start tag
#: goes. A start tag of svg, or inside one, that ends in a slash is an empty element.
_SPANNED = RAW - _TO_END
#: Elements that start a block of their own.
BLOCKS = frozenset(
    "html head body main article section div p nav header footer aside form fieldset ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption address details summary dialog menu center hr button label legend noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph.
_ENDS_P = BLOCKS - frozenset("html head body td th tr thead tbody tfoot caption button label legend noscript".split())
#: Start of the key ends an open one of the values, searched up to the nearest of the limits.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "body": (("head",), ("html",)),
}
_P_LIMITS = frozenset("article section div main td th li blockquote body form aside nav header footer figure button".split())


class _Tags:
    """Comments, declarations and tags of a page, found in time linear in its length.

    Every start is settled once: a ``>`` behind it ends it, one inside quotes only where no other
    does. Where quotes fail to close, the ends of all tags to come are worked out together, from
    the end of the page back.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.places: list[int] | None = None  # of > and quotes
        self.ends: list[int] = []  # of a tag whose attributes go on there, outside quotes

    def _work_out(self, position: int) -> None:
        self.places = [m.start() for m in _SPECIAL.finditer(self.source, position)]
        self.ends = [-1] * (len(self.places) + 1)
        behind = {'"': -1, "'": -1}  # the next of each quote
        for k in range(len(self.places) - 1, -1, -1):
            c = self.source[self.places[k]]
            if c == ">":
                self.ends[k] = self.places[k]
            else:
                if behind[c] >= 0:
                    self.ends[k] = self.ends[behind[c] + 1]
                behind[c] = k

    def next(self, position: int, bound: int = -1) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next one; comments have no name.

        A comment that isn't closed before ``bound`` ends there, or with the page.
        """
        source = self.source
        while found := _START.search(source, position):
            start = found.start()
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                end = len(source) if end < 0 else end + 3
                return start, bound if start < bound < end else end, False, "", ""
            if start > self.last:
                position = source.find("<!--", start)
                if position < 0:
                    return None
                continue
            if source[start + 1] in "!?":
                return start, source.find(">", start) + 1, False, "", ""
            if self.places is None:
                if tag := _TAG.match(source, start):
                    return start, tag.end(), bool(tag[1]), tag[2].lower(), tag[3]
                self._work_out(start)
            tag = _NAME.match(source, start)
            end = self.ends[bisect_left(self.places, tag.end())]
            if end < 0:
                end = source.find(">", tag.end())
            return start, end + 1, bool(tag[1]), tag[2].lower(), source[tag.end() : end]
        return None

    def end_tag(self, name: str, position: int) -> tuple[int, int]:
        """(start, end) of the first end tag of that name behind ``position``, or (-1, -1)."""
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.source, position, self.last + 1)
        return found.span() if found else (-1, -1)


def _spans(source: str, position: int) -> dict[int, int]:
    """Ends of the elements in _SPANNED that have an end tag, by the ends of their start tags."""
    read = _Tags(source)
    starts: dict[str, list[int]] = {tag: [] for tag in _SPANNED}
    ends: dict[int, int] = {}
    endless: set[str] = set()
    while found := read.next(position):
        _, position, closing, tag, rest = found
        if tag not in RAW:
            continue
        if closing:
            if starts.get(tag):
                ends[starts[tag].pop()] = position
            continue
        foreign = bool(starts["svg"])
        if (foreign or tag == "svg") and rest.endswith("/"):
            continue
        if tag in _SPANNED:
            starts[tag].append(position)
        elif tag not in endless and not (foreign and tag == "title"):
            if (end := read.end_tag(tag, position)[1]) >= 0:
                position = end
            elif foreign:
                endless.add(tag)
            else:
                break
    return ends


@dataclass
class Page:
    """Block nodes by number (0 is the page itself) and text blocks."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    attributes: list[str] = field(default_factory=lambda: [""])  # class, id and role, lower case
    inputs: list[int] = field(default_factory=lambda: [0])  # form controls right in the node
    marks: list[str] = field(default_factory=lambda: [""])  # value of data-mark, for training pages
    owners: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of the block inside links


def parse(source: str) -> Page:
    """Reads a whole page, in time linear in its length; broken markup never fails.

    Character references are decoded, white space inside a block becomes one space, empty blocks
    go. Scripts, styles, comments and declarations leave nothing. Unclosed elements end with
    their parent; end tags without a start are ignored. Of elements in RAW without an end tag only
    those in _TO_END take the rest of the page.
    """
    page = Page()
    stack: list[int] = [0]
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    pieces: list[str] = []
    linked, in_link = 0, False
    tags, position, size = page.tags, 0, len(source)
    read = _Tags(source)
    spans: dict[int, int] | None = None
    bound = -1  # of comments: the end of the noscript element around
    math = 0  # open elements of math; a start tag inside that ends in a slash is an empty element

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                page.owners.append(stack[-1])
                page.texts.append(text)
                page.linked.append(min(linked, len(text)))
            pieces.clear()
        linked = 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_at[tags[stack.pop()]].pop()

    def nearest(wanted, limits) -> int:
        """Place in the stack of the last open one of ``wanted`` that none of ``limits`` is behind."""
        last = max((open_at[t][-1] for t in wanted if open_at.get(t)), default=-1)
        return last if last >= 0 and all(open_at[t][-1] <= last for t in limits if open_at.get(t)) else -1

    def text(part: str) -> None:
        nonlocal linked
        if "&" in part:
            part = html.unescape(part)
        pieces.append(part)
        if in_link:
            linked += len(part)

    while position < size:
        found = read.next(position, bound)
        if not found:
            text(source[position:])
            break
        start, end, closing, tag, rest = found
        if start > position:
            text(source[position:start])
        position = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                in_link = False
            elif tag == "br":
                flush()
            elif tag == "math":
                math = max(0, math - 1)
            elif tag in BLOCKS:
                flush()
                if open_at.get(tag):
                    close_to(open_at[tag][-1])
                    in_link = False
            continue
        if math and tag in _TO_END and rest.endswith("/"):
            continue
        if tag == "math":
            math += not rest.endswith("/")
            continue
        if tag in RAW:
            if tag in _TO_END:
                end = read.end_tag(tag, position)[1]
                position = end if end >= 0 else size
            elif tag != "svg" or not rest.endswith("/"):
                if spans is None:
                    spans = _spans(source, start)
                position = spans.get(position, position)
            if tag in ("textarea", "select"):
                page.inputs[stack[-1]] += 1
            continue
        if tag == "noscript" and bound < position:
            bound = read.end_tag(tag, position)[0]
            bound = size + 1 if bound < 0 else bound  # no other is looked for
        if tag == "a":
            in_link = True
        elif tag == "br":
            flush()
        elif tag == "input":
            page.inputs[stack[-1]] += 1
        elif tag in BLOCKS:
            flush()
            if tag in _ENDS_P and open_at.get("p") and (k := nearest(("p",), _P_LIMITS)) > 0:
                close_to(k)
                in_link = False
            if tag in _ENDS:
                wanted, limits = _ENDS[tag]
                if any(open_at.get(x) for x in wanted) and (k := nearest(wanted, limits)) > 0:
                    close_to(k)
                    in_link = False
            if tag == "hr":
                continue
            parent, node = stack[-1], len(tags)
            tags.append(tag)
            page.parents.append(parent)
            page.depths.append(len(stack))
            names, mark = "", ""
            if rest and "=" in rest:
                for key, *values in _ATTRIBUTE.findall(rest):
                    key = key.lower()
                    if key in ("class", "id", "role"):
                        names += " " + "".join(values)
                    elif key == "data-mark":
                        mark = "".join(values)
            page.attributes.append(names.lower())
            page.marks.append(mark)
            page.inputs.append(0)
            if not rest.endswith("/") or tag not in VOID:
                open_at.setdefault(tag, []).append(len(stack))
                stack.append(node)
    flush()
    return page
