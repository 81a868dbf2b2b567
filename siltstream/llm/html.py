"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes a sequence of leaf blocks (text between block-level tags) with features of their ancestors' tags,
classes and ids and of their own text.  The field scores each block as main text or not, and each pair of neighbours;
it is fitted by maximum likelihood (forward-backward) on labelled pages, and the best labelling of a page is found by
Viterbi.  Training is small and runs on the driver; pages are decoded in Arrow batches without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|data-main)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
#: Tags that leave a block open.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is inside these is never text of the page: code; raw text, which holds no element of its own kind; markup.
_CODE = frozenset("script style".split())
_RAW = _CODE | frozenset("noscript iframe title textarea".split())
_NESTED = frozenset("template object svg math audio video canvas".split())
_SAME = {tag: re.compile(rf"<(/?){tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in _RAW}
_TREE = {
    tag: re.compile(
        r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s>])[^>]*(?<!/)>.*?(?:</\1(?=[\s/>])|\Z)"
        rf"|<(/?){tag}(?=[\s/>]|\Z)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)",
        re.S | re.I,
    )
    for tag in _NESTED
}
#: A slash at the end of a tag, and not of an attribute without quotes.
_SELF_CLOSED = re.compile(r"(?:\A|[\s\"']|(?:\A|\s)[^\s\"'=]+)/\s*\Z")
#: Start tags that leave the head open.
_HEAD = frozenset("base link meta title script style noscript template".split())
#: A start tag of the key ends an open element of the values.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_SCOPES = frozenset("table td th ul ol dl div article section aside body nav header footer main form blockquote figure".split())


#: Tags that ``_ENDS`` and ``_CLOSE_P`` look for among the open elements.
_ENDED = frozenset("p li dt dd tr td th option".split())


class Node:
    """A place in the tree of block elements: a tag with its names below a parent.  Equal places are one node, so what
    depends on the ancestors is worked out once."""

    __slots__ = ("parent", "tag", "names", "children", "known")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names = parent, tag, names
        self.children: dict[tuple[str, tuple[str, ...]], Node] = {}
        self.known: _Known | None = None  # by the field that owns the tree

    def child(self, tag: str, names: tuple[str, ...]) -> Node:
        node = self.children.get((tag, names))
        if node is None:
            node = self.children[tag, names] = Node(self, tag, names)
        return node

    @property
    def path(self) -> tuple[str, ...]:
        out = []
        node = self
        while node.parent is not None:
            out.append(" ".join([node.tag, *node.names]))
            node = node.parent
        return tuple(reversed(out))


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int  # characters inside links
    main: bool  # label, if the page is a labelled one

    @property
    def path(self) -> tuple[str, ...]:
        """One entry per ancestor: tag and names."""
        return self.node.path


class _Open:
    """The open elements of a page, with counts that tell what is open without looking through all of them."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, bool]] = []  # tag, labelled as main
        self.nodes = [root]  # of the open block elements
        self.inline: list[dict[str, int]] = [{}]  # inline elements open since each open block element
        self.blocks: dict[str, int] = {}
        self.scopes: list[tuple[int, dict[str, int]]] = [(-1, {})]  # place of a scope, and what is open in it of _ENDED
        self.main = self.links = 0

    def push(self, tag: str, names: list[str], main: bool) -> None:
        if tag in _INLINE:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        else:
            self.blocks[tag] = self.blocks.get(tag, 0) + 1
            self.inline.append({})
            self.nodes.append(self.nodes[-1].child(tag, tuple(names)))
            if tag in _ENDED:
                self.scopes[-1][1][tag] = self.scopes[-1][1].get(tag, 0) + 1
            if tag in _SCOPES:
                self.scopes.append((len(self.stack), {}))
        self.stack.append((tag, main))
        self.main += main
        self.links += tag == "a"

    def cut(self, to: int) -> None:
        """Close all elements from place ``to`` on."""
        while len(self.stack) > to:
            tag, main = self.stack.pop()
            self.main -= main
            self.links -= tag == "a"
            if tag in _INLINE:
                self.inline[-1][tag] -= 1
                continue
            self.blocks[tag] -= 1
            self.inline.pop()
            self.nodes.pop()
            if tag in _SCOPES:
                self.scopes.pop()
            if tag in _ENDED:
                self.scopes[-1][1][tag] -= 1

    def place(self, tag: str) -> int:
        """Of the innermost open element with this tag; -1 if there is none, or for an inline one none in the open block."""
        if not (self.inline[-1] if tag in _INLINE else self.blocks).get(tag):
            return -1
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        return at

    def end(self, closes: set[str]) -> None:
        """Close the elements of these tags in the innermost scope, and scopes that are among them."""
        while closes:
            scope, held = self.scopes[-1]
            left, at = sum(held.get(c, 0) for c in closes), len(self.stack)
            while left:
                at -= 1
                left -= self.stack[at][0] in closes
            self.cut(at)
            if scope < 0 or self.stack[scope][0] not in closes:
                return
            self.cut(scope)


def _raw_end(page: str, tag: str, at: int, closed: bool) -> int:
    """Where a raw element whose start tag ends at ``at`` ends: there, if it has no end tag before the next of its kind.

    Code without an end tag goes on to the end of the page, as in browsers.
    """
    code = tag in _CODE and not closed
    for same in _SAME[tag].finditer(page, at):
        if same[1]:
            return same.end()
        if not code:
            return at
    return len(page) if code else at


def _tree_ends(page: str, tag: str) -> dict[int, int]:
    """Begin and end of the elements of a kind that can be nested; those without an end tag are left out."""
    ends: dict[int, int] = {}
    begun: list[int] = []
    for token in _TREE[tag].finditer(page):
        if token[2] is None:
            continue
        if not token[2]:
            if tag not in ("svg", "math") or not _SELF_CLOSED.search(token[3]):
                begun.append(token.start())
        elif begun:
            ends[begun.pop()] = token.end()
    return ends


def blocks(page: str | None, root: Node | None = None) -> list[Block]:
    """Leaf blocks in page order: references decoded, white space runs as one space, empty ones left out.

    Time is linear in the page, however deep its elements are nested.  ``root``: a tree of places to share with other pages.
    """
    out: list[Block] = []
    if not page:
        return out
    opened = _Open(Node(None, "", ()) if root is None else root)
    stack = opened.stack
    parts: list[str] = []
    linked, at, n, labelled = 0, 0, len(page), False
    trees: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked, labelled
        raw = "".join(parts)
        parts.clear()
        if raw and not raw.isspace():
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(opened.nodes[-1], text, linked, labelled))
        linked, labelled = 0, False

    while at < n:
        token = _TOKEN.search(page, at)
        begin = token.start() if token else n
        if begin > at:
            piece = page[at:begin]
            if stack and stack[-1][0] == "head" and not piece.isspace():
                opened.cut(len(stack) - 1)
            parts.append(piece)
            labelled = labelled or opened.main > 0
            if opened.links:
                linked += len(piece)
        if not token:
            break
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag == "br":
                parts.append(" ")
                continue
            place = opened.place(tag)
            if tag not in _INLINE:
                flush()
            if place >= 0:
                opened.cut(place)
            continue
        if stack and stack[-1][0] == "head" and tag not in _HEAD:
            opened.cut(len(stack) - 1)
        if tag in _RAW:
            at = _raw_end(page, tag, at, bool(_SELF_CLOSED.search(token[3])))
            parts.append(" ")
            continue
        if tag in _NESTED:
            if tag not in trees:
                trees[tag] = _tree_ends(page, tag)
            at = trees[tag].get(begin, at)
            parts.append(" ")
            continue
        if tag in ("br", "wbr", "img", "input"):
            parts.append("" if tag == "wbr" else " ")
            continue
        if tag in _VOID:
            flush()
            continue
        if tag not in _INLINE:
            flush()
            opened.end(_ENDS.get(tag) or ({"p"} if tag in _CLOSE_P else set()))
        names, main = [], False
        if token[3] and not token[3].isspace():
            for a in _ATTRIBUTE.finditer(token[3]):
                kind = a[1].lower()
                if kind == "data-main":
                    main = True
                elif kind == "hidden":
                    names.append("hidden")
                else:
                    for name in (a[2] or a[3] or a[4] or "").lower().split():
                        found = _NAME.findall(name)
                        names += found if len(found) == 1 else [f"~{x}" for x in found]
        if token[3].rstrip().endswith("/") and tag in _INLINE:
            continue
        opened.push(tag, names, main)
    flush()
    return out


#: Tags that tell what their inside is for, even without a class or id.
_TELLING = frozenset("article aside body dialog fieldset footer form header main nav".split())


@dataclass(slots=True)
class _Known:
    """What a field knows of a node: which of its features lie above (bits) and their sum, and the sum for its blocks."""

    above: int
    total: float
    base: float
    inner: Node | None  # the innermost ancestor, or itself, that tells what its inside is for
    outer: Node | None  # the one around it
    as_inner: float
    as_outer: float


def _tells(node: Node) -> bool:
    return bool(node.names) or node.tag in _TELLING


def above_features(node: Node) -> set[str]:
    return {f"in {node.tag}", *(f"name {x}" for x in node.names)}


def role_features(place: str, node: Node) -> set[str]:
    return {f"{place} {node.tag}", *(f"{place} name {x}" for x in node.names)}


def joint_features(own: str, inner: Node | None, outer: Node | None) -> list[str]:
    out = [f"own {own}"]
    if inner is not None:
        out.append(f"own {own} inner {inner.tag}")
        if outer is not None:
            out += [f"inner {inner.tag} outer {outer.tag}", f"own {own} inner {inner.tag} outer {outer.tag}"]
    return out


def path_features(node: Node) -> set[str]:
    """Tags and names of all ancestors; those of the innermost telling container and of the one around it apart."""
    out: set[str] = set()
    telling: list[Node] = []
    own, at = node.tag, node
    while at.parent is not None:
        out |= above_features(at)
        if len(telling) < 2 and _tells(at):
            telling.append(at)
            out |= role_features(("inner", "outer")[len(telling) - 1], at)
        at = at.parent
    if node.parent is not None:
        out.update(joint_features(own, *(telling + [None, None])[:2]))
    return out


def container(node: Node) -> Node:
    """The innermost telling place around a block, or the root."""
    while node.parent is not None and not _tells(node):
        node = node.parent
    return node


def text_features(page: list[Block], holders: list[Node] | None = None) -> list[list[str]]:
    """Features of each block's own text, and of all text in containers like its own."""
    holders = holders or [container(b.node) for b in page]
    words = [b.text.count(" ") + 1 for b in page]
    ends = [b.text[-1] in ".!?:\"'" for b in page]
    sums: dict[int, list[int]] = {}
    for b, h, w, e in zip(page, holders, words, ends, strict=True):
        own = sums.setdefault(id(h), [0, 0, 0, 0, 0])
        for i, x in enumerate((w, b.linked, len(b.text), 1, e)):
            own[i] += x
    total, so_far, out = sum(words), 0, []
    for b, h, w, e in zip(page, holders, words, ends, strict=True):
        group = sums[id(h)]
        own = [f"words {min(7, w.bit_length())}", f"linked {min(4, 4 * b.linked // max(len(b.text), 1))}"]
        own += [f"group words {min(9, group[0].bit_length())}", f"group linked {min(4, 4 * group[1] // max(group[2], 1))}"]
        own += [f"group share {4 * group[0] // total}", f"group sentences {4 * group[4] // group[3]}", f"place {4 * so_far // total}"]
        if e:
            own.append("ends a sentence")
        if "©" in b.text:
            own.append("copyright sign")
        so_far += w
        out.append(own)
    return out


#: Places kept from page to page.
_MOST_PLACES = 200_000


@dataclass
class Field:
    """weights: of a feature for main against not; pair[i][j]: of label j after label i; first: of main at the start."""

    weights: dict[str, float]
    pair: tuple[tuple[float, float], tuple[float, float]]
    first: float

    def __post_init__(self) -> None:
        self._bit = {f: 1 << i for i, f in enumerate(sorted(f for f in self.weights if f.startswith(("in ", "name "))))}
        self._root, self._places = Node(None, "", ()), 0

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("weights", "pair", "first")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def read(self, page: str | None) -> list[Block]:
        """The blocks of a page, on a tree of places that pages share."""
        if self._places > _MOST_PLACES:
            self._root, self._places = Node(None, "", ()), 0
        return blocks(page, self._root)

    def _sum(self, features: set[str] | list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in sorted(features))

    def _know(self, node: Node) -> _Known:
        path = []
        while node.known is None:
            path.append(node)
            if node.parent is None:
                break
            node = node.parent
        self._places += len(path)
        for x in reversed(path):
            if x.parent is None:
                x.known = _Known(0, 0.0, 0.0, None, None, 0.0, 0.0)
                continue
            up = x.parent.known
            above, total = up.above, up.total
            for f in sorted(above_features(x)):
                bit = self._bit.get(f, 0)
                if bit & ~above:
                    above, total = above | bit, total + self.weights[f]
            inner, outer = (x, up.inner) if _tells(x) else (up.inner, up.outer)
            x.known = _Known(above, total, 0.0, inner, outer, self._sum(role_features("inner", x)) if inner is x else 0.0, self._sum(role_features("outer", x)) if inner is x else 0.0)
            x.known.base = total + self._sum(joint_features(x.tag, inner, outer)) + (inner.known.as_inner if inner else 0.0) + (outer.known.as_outer if outer else 0.0)
        return path[0].known if path else node.known

    def emissions(self, page: list[Block]) -> list[float]:
        """The score of each block of a page from ``read`` for being main text."""
        known = [b.node.known or self._know(b.node) for b in page]
        root = self._root
        text = text_features(page, [k.inner or root for k in known])
        return [k.base + sum(self.weights.get(f, 0.0) for f in own) for k, own in zip(known, text, strict=True)]

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi."""
        if not page:
            return []
        (p00, p01), (p10, p11) = self.pair
        scores = self.emissions(page)
        no, yes = 0.0, self.first + scores[0]
        back: list[tuple[bool, bool]] = []
        for e in scores[1:]:
            from_yes = (yes + p10 > no + p00, yes + p11 > no + p01)
            no, yes = (yes + p10 if from_yes[0] else no + p00), e + (yes + p11 if from_yes[1] else no + p01)
            back.append(from_yes)
        label = yes > no
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[list[Block]], steps: int = 200, rate: float = 0.1, decay: float = 2e-5, least: int = 4) -> Field:
    """Maximum likelihood by Adam; all pages advance together, position by position, in forward-backward.

    Features of fewer than ``least`` blocks are left out.
    """
    pages = [p for p in pages if p]
    names: dict[str, int] = {}
    found = [[sorted(path_features(b.node)) + own for b, own in zip(p, text_features(p), strict=True)] for p in pages]
    seen_in = Counter(f for p in found for b in p for f in b)
    feats = [[[names.setdefault(f, len(names)) for f in b if seen_in[f] >= least] for b in p] for p in found]
    n, longest = len(pages), max(map(len, pages), default=0)
    if not n:
        return Field({}, ((0.0, 0.0), (0.0, 0.0)), 0.0)
    flat = np.array([f for p in feats for b in p for f in b])
    owner = np.repeat(np.arange(sum(map(len, pages))), [len(b) for p in feats for b in p])
    cell = np.array([i * longest + j for i, p in enumerate(pages) for j in range(len(p))])
    size = np.array([len(p) for p in pages])
    gold = np.zeros((n, longest), int)
    gold.reshape(-1)[cell] = [b.main for p in pages for b in p]
    w = np.zeros(len(names) + 5)  # features, then the pairs 00 01 10 11, then the start
    m, v = np.zeros_like(w), np.zeros_like(w)
    inside = np.arange(longest) < size[:, None]
    for step in range(1, steps + 1):
        e = np.zeros(n * longest)
        e[cell] = np.bincount(owner, w[flat], len(cell))
        e = e.reshape(n, longest)
        score = np.stack([np.zeros_like(e), e], axis=2)
        score[:, 0, 1] += w[-1]
        pair = w[-5:-1].reshape(2, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for j in range(1, longest):
            forward[:, j] = np.logaddexp.reduce(forward[:, j - 1, :, None] + pair, axis=1) + score[:, j]
        for j in range(longest - 2, -1, -1):
            step_back = np.logaddexp.reduce(pair + (backward[:, j + 1] + score[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(inside[:, j + 1, None], step_back, 0.0)
        total = np.logaddexp.reduce(forward[np.arange(n), size - 1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None])[:, :, 1]
        grad = np.zeros_like(w)
        diff = np.where(inside, gold - chance, 0.0)
        grad[: len(names)] = np.bincount(flat, diff.reshape(-1)[cell][owner], len(names))
        grad[-1] = diff[:, 0].sum()
        both = np.exp(forward[:, :-1, :, None] + pair + (score + backward)[:, 1:, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
        seen = np.bincount((2 * gold[:, :-1] + gold[:, 1:])[inside[:, 1:]], minlength=4)
        grad[-5:-1] = seen - both.sum(axis=(0, 1)).reshape(-1)
        grad = grad / n - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    (a, b), (c, d) = w[-5:-1].reshape(2, 2).tolist()
    return Field({k: float(w[i]) for k, i in names.items()}, ((a, b), (c, d)), float(w[-1]))


@lru_cache(1)
def default_field() -> Field:
    """Fitted on the labelled pages of ``html_examples``, once per process."""
    from .html_examples import labelled_pages

    return fit([blocks(p) for p in labelled_pages(nameless=0.3)])


def main_text(page: str | None, model: Field) -> str:
    found = model.read(page)
    return " ".join(b.text for b, good in zip(found, model.decode(found), strict=True) if good)


def extract_main_text(df: DataFrame, model: Field | None = None, *, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """All columns of df plus ``text_col``, which replaces a column of that name: the main blocks, joined by a space.

    Null and empty pages, and pages without main text, give ''.  Markup need not be well-formed or complete; only a
    script or style without an end tag takes the rest of the page, as in browsers.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == text_col.lower() and c != html_col])
    model = model or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                piece = batch.slice(begin, 512)
                texts = [main_text(x.as_py(), model) for x in piece.column(html_col)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*piece.schema.names, text_col])

    return df.mapInArrow(run, df.withColumn(text_col, F.lit("")).schema)
