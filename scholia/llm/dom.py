"""A small HTML reader: tags to a tree, a tree to blocks of text, and simple tree matching of two trees."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math canvas object video audio".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
_ENDS_P = BLOCK - {"body", "html"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_STOPS = frozenset("ul ol dl table body html article section div td th main".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


#: Elements that stand inside a line of text: they don't make a page's layout.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NUMBER = re.compile(r"\d+")


class Node:
    __slots__ = ("attrs", "chars", "heading", "holds", "index", "kids", "label", "parts", "shape", "size", "story", "tag", "text", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.parts: list[Node | str] = []  # children and text in order
        self.kids: list[Node] = []
        self.label = tag + "." + _NUMBER.sub("#", attrs.get("class", ""))
        self.index = self.shape = -1
        self.chars = self.holds = self.size = self.text = 0  # for wrapper.measure
        self.heading = self.story = False


def parse(page: str) -> Node:
    root = Node("#", {}, None)
    at, pos, size = root, 0, len(page)
    open_: dict[str, int] = {}  # how many elements of each tag are open: no search for one that isn't

    def up_to(n: Node) -> Node:
        nonlocal at
        while at is not n:
            open_[at.tag] -= 1
            at = at.up
        return at

    while pos < size:
        m = _TAG.search(page, pos)
        if m is None:
            at.parts.append(html.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.parts.append(html.unescape(page[pos : m.start()]))
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            n = at
            if open_.get(tag):
                while n.tag != tag:
                    n = n.up
                up_to(n.up)
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3] else {}
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else (size if tag in ("script", "style") else pos)
            continue
        if tag in _ENDS_P and open_.get("p"):
            up_to(_after(at, {"p"}, _STOPS))
        if tag in _CLOSES and any(map(open_.get, _CLOSES[tag])):
            up_to(_after(at, _CLOSES[tag], _STOPS - {"td", "th"} if tag in ("td", "th", "tr", "tbody", "tfoot") else _STOPS))
        n = Node(tag, attrs, at)
        at.parts.append(n)
        at.kids.append(n)
        if tag not in VOID and not m[3].endswith("/"):
            at = n
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _after(at: Node, tags: set[str], stops: frozenset[str] | set[str]) -> Node:
    """Where the next element goes once the nearest open element of these tags is closed."""
    n = at
    while n.up is not None and n.tag not in tags:
        if n.tag in stops:
            return at
        n = n.up
    return at if n.up is None else n.up


def number(root: Node) -> list[Node]:
    """All elements in page order, each knowing its place."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        n.index = len(out)
        out.append(n)
        stack.extend(reversed(n.kids))
    return out


def clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def layout_kids(n: Node) -> list[Node]:
    """The nearest elements below that aren't part of a line of text."""
    if all(x.tag not in INLINE for x in n.kids):
        return n.kids
    out, stack = [], list(reversed(n.kids))
    while stack:
        x = stack.pop()
        if x.tag in INLINE:
            stack.extend(reversed(x.kids))
        else:
            out.append(x)
    return out


class Shapes:
    """Elements of equal layout, told by a number: scores of tree matching are kept by pairs of shapes, not of elements."""

    def __init__(self, kids: Callable[[Node], list[Node]]):
        self.kids_of = kids
        self.known: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.label: list[str] = []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> None:
        """Sets the shape of all elements."""
        order, stack = [], [root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack.extend(self.kids_of(n))
        for n in reversed(order):
            kids = tuple(x.shape for x in self.kids_of(n))
            n.shape = self.known.setdefault((n.label, kids), len(self.known))
            if n.shape == len(self.kids):
                self.kids.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
                self.label.append(n.label)

    def score(self, a: int, b: int) -> int:
        """Simple tree matching: the largest number of pairs of aligned elements of two elements of one label."""
        stack = [(a, b, False)]
        while stack:
            x, y, ready = stack.pop()
            if (x, y) in self.scores:
                continue
            head, tail, xs, ys = self._middle(x, y)
            if not self.kids[x] or not self.kids[y]:
                self.scores[x, y] = 1
            elif not xs or not ys:
                self.scores[x, y] = 1 + sum(self.sizes[k] for k in (*self.kids[x][:head], *self.kids[x][len(self.kids[x]) - tail :]))
            elif ready:
                ends = sum(self.sizes[k] for k in (*self.kids[x][:head], *self.kids[x][len(self.kids[x]) - tail :]))
                self.scores[x, y] = 1 + ends + int(self._forward(xs, ys)[-1])
            else:
                stack.append((x, y, True))
                of: dict[str, set[int]] = {}
                for q in ys:
                    of.setdefault(self.label[q], set()).add(q)
                stack.extend((p, q, False) for p in set(xs) for q in of.get(self.label[p], ()))
        return self.scores[a, b]

    def _middle(self, x: int, y: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
        """How many children at the front and at the end are of the same shapes, so are aligned in some best alignment; and the others."""
        xs, ys = self.kids[x], self.kids[y]
        n = min(len(xs), len(ys))
        head = next((k for k in range(n) if xs[k] != ys[k]), n)
        tail = next((k for k in range(n - head) if xs[-1 - k] != ys[-1 - k]), n - head)
        return head, tail, xs[head : len(xs) - tail], ys[head : len(ys) - tail]

    def pairs(self, x: Node, y: Node) -> list[tuple[Node, Node]]:
        """The children that a best alignment pairs."""
        xs, ys = self.kids_of(x), self.kids_of(y)
        head, tail, mx, my = self._middle(x.shape, y.shape)
        middle = [(xs[head + i], ys[head + j]) for i, j in self.align(mx, my)]
        return [*zip(xs[:head], ys[:head], strict=True), *middle, *zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)]

    def _weights(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of scores by shape of x (0: other labels), and each x's row."""
        shapes, row = np.unique(np.array(xs), return_inverse=True)
        other, column = np.unique(np.array(ys), return_inverse=True)
        table = np.array([[self.scores.get((p, q), 0) if self.label[p] == self.label[q] else 0 for q in other.tolist()] for p in shapes.tolist()])
        return table[:, column], row

    def _forward(self, xs: tuple[int, ...], ys: tuple[int, ...], keep: bool = False) -> np.ndarray | list:
        """Best sums of weights of alignments of all xs with the first j ys; keep: after each x."""
        if len(xs) * len(ys) <= 256:  # a few elements: lists are faster
            last = [0] * (len(ys) + 1)
            table = [last]
            for p in xs:
                row, label = [0] * len(last), self.label[p]
                for j, q in enumerate(ys):
                    best = last[j + 1] if last[j + 1] >= row[j] else row[j]
                    if self.label[q] == label:
                        best = max(best, last[j] + self.scores[p, q])
                    row[j + 1] = best
                table.append(row)
                last = row
            return table if keep else last
        weights, of = self._weights(xs, ys)
        last = np.zeros(len(ys) + 1, np.int32)
        table = [last]
        for r in of:
            row = last.copy()
            np.maximum(row[1:], last[:-1] + weights[r], out=row[1:])
            last = np.maximum.accumulate(row)
            if keep:
                table.append(last)
        return table if keep else last

    def align(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the pairs of a best alignment; in halves where the table would be large."""
        if len(xs) * len(ys) > TABLE and len(xs) > 1:
            m = len(xs) // 2
            left, right = self._forward(xs[:m], ys), self._forward(xs[m:][::-1], ys[::-1])
            cut = int((np.asarray(left) + np.asarray(right)[::-1]).argmax())
            return self.align(xs[:m], ys[:cut]) + [(m + i, cut + j) for i, j in self.align(xs[m:], ys[cut:])]
        table, out = self._forward(xs, ys, True), []
        i, j = len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]


#: Cells of a table of an alignment that is kept whole.
TABLE = 4 << 20


def match(a: Node, b: Node, kids: Callable[[Node], list[Node]] = lambda n: n.kids) -> dict[int, int]:
    """Simple tree matching: index of elements of b to that of the elements of a they are aligned with; kids: an element's children."""
    shapes = Shapes(kids)
    shapes.of(a)
    shapes.of(b)
    shapes.score(a.shape, b.shape)
    out, todo = {}, [(a, b)]
    while todo:
        x, y = todo.pop()
        out[y.index] = x.index
        todo.extend(shapes.pairs(x, y))
    return out
