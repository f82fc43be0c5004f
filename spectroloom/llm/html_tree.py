"""A tolerant HTML reader: the tree of a page's elements and its text runs, in time linear in the page."""

from __future__ import annotations

import html
import re

# HTML's elements without an end tag, with raw text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A new start tag of the key ends an open element of these first.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_CLOSES_P = BLOCK - frozenset("body html head caption legend summary tbody td tfoot th thead tr li dd dt".split())
_P_STOPS, _ITEM_STOPS = ("td", "th", "table", "button", "object"), ("ul", "ol", "dl", "table", "menu")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'/]++|\"[^\"]*\"|'[^']*'|/(?!>)|[\"'])*?)(/?)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|y|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?![\w=-]))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?![a-z])[^>]*(?:>|$)|$", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+")


class Page:
    """A page's elements in order, parents before children, and its text runs.

    ``classes`` and ``ids`` hold the words of each name; ``label`` is the value of an attribute ``y``,
    by which labelled pages say what an element is.
    """

    __slots__ = ("tag", "parent", "classes", "ids", "label", "runs", "breaks", "_stack", "_open")

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.classes, self.ids, self.label = ["#page"], [-1], [()], [()], [""]
        self.runs: list[tuple[int, str, int]] = []  # element, text, block
        self.breaks = 0
        self._stack = [0]
        self._open: dict[str, list[int]] = {}  # by tag, the places of its open elements in the stack
        stack, at, find = self._stack, 0, _TOKEN.search
        while at < len(source):
            m = find(source, at)
            if m is None or m.start() > at:
                self.runs.append((stack[-1], source[at : len(source) if m is None else m.start()], self.breaks))
                if m is None:
                    break
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self.runs.append((stack[-1], html.escape(m[0][9:].removesuffix("]]>")), self.breaks))
                continue
            name = name.lower()
            if name in BLOCK:
                self.breaks += 1
            if m[1]:
                if self._open.get(name):
                    self._pop(self._open[name][-1])
                continue
            self._start(name, m[3])
            if name == "br":
                self.runs.append((stack[-1], " ", self.breaks))
            if name in VOID or m[4] and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                at = _RAW_END[name].search(source, at).end()
                continue
            self._open.setdefault(name, []).append(len(stack))
            stack.append(len(self.tag) - 1)
        self._stack, self._open = [], {}

    def _pop(self, place: int) -> None:
        """Close the open element at a place of the stack and all in it."""
        while len(self._stack) > place:
            self._open[self.tag[self._stack.pop()]].pop()

    def _innermost(self, names: tuple[str, ...]) -> int:
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=0)

    def _close(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        place = self._innermost(names)
        if place > self._innermost(stops):
            self._pop(place)

    def _start(self, name: str, attributes: str) -> None:
        if name in _CLOSES_P:
            self._close(("p",), _P_STOPS)
        if name in ENDS:
            self._close(ENDS[name], _ITEM_STOPS)
        classes, ids, label = [], [], ""
        if attributes and not attributes.isspace():
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key == "y":
                    label = value
                elif key in ("hidden", "aria-hidden"):
                    if value != "false":
                        classes.append(("hidden",))
                else:
                    words = [tuple(_WORDS.findall(x)) for x in value.split()]
                    (ids if key == "id" else classes).extend(w for w in words if w)
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.classes.append(tuple(classes))
        self.ids.append(tuple(ids))
        self.label.append(label)
