"""Main text of web pages by wrapper induction.

Pages are parsed into trees of block elements, in which runs of like siblings are one
node (a repeated slot). REFERENCES pages of a host, and then the outlines (trees without texts) of all its pages that
differ, are merged into its wrapper by partial tree alignment: trees are matched by simple tree matching, the recursive maximum matching of
subtrees in order, and what has no partner is inserted beside its neighbour. Each page of the host is aligned
with the wrapper. A text that a node has on nearly all different pages with that node is
template. The other, varying slots are content if they lie in the content region: the
deepest node that holds most of the host's varying text, links not counted. So menus, notices
and other blocks go by where they are in the wrapper. Names decide where structure can't:
elements whose name, class, id or role says that they are menus, adverts, forms, comments and the like are
never content, as those vary too; and on hosts with one page the article (or main) element is the region.

A page is aligned alone, with its host's wrapper (labels and text
hashes) beside it; what is counted for a host is a number per wrapper node and text, summed in
part before the shuffle, over all its different pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, written

#: A text is template when at least this share of the host's different pages with its node has it there, two at least.
TEMPLATE_SHARE = 0.9
#: The region is the deepest node with at least this share of the varying text around it.
REGION_SHARE = 0.8
#: Pages of a host that its wrapper begins with, texts included, at most; all other pages give their outlines.
REFERENCES = 8
#: Parts in which a host's outlines are merged before they meet.
_OUTLINE_PARTS = 64
#: Cells of one alignment table beyond which long runs of children are halved.
_CELLS = 250_000

#: Fixed lists of element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noframes xmp template svg math head object audio video canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul button caption".split()
)
_NEVER = frozenset("nav aside footer form select button dialog menu fieldset option search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
#: Words in a class or id that name something other than content.
_NOISE = re.compile(
    r"(?:^|[^a-z0-9])(?:ads?|adverts?|advertisements?|adsbygoogle|sponsor(?:ed|s)?|promos?|banners?|nav|navbar|navigation|menus?|sidebars?|footers?|"
    r"breadcrumbs?|cookies?|consent|notices?|popups?|modals?|newsletters?|subscribe|subscription|comments?|commentlist|disqus|respond|replies|"
    r"share|sharing|social|related|recommend(?:ed|ations)?|widgets?|pagination|pager|masthead|topbar|toolbar|skip|login|signup|search|hidden)(?:[^a-z0-9]|$)"
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")


class Block:
    """An element, or a run of like elements: a slot of a wrapper."""

    __slots__ = ("children", "content", "items", "label", "linked", "of", "prints_", "shape", "size", "tag")

    def __init__(self, tag: str, label: str, content: bool):
        self.tag, self.label, self.content = tag, label, content
        self.items: list[str | Block] = []
        self.children: list[Block] = []
        self.linked = 0  # characters of text in links
        self.of: list[Block] = []  # what a slot was made of
        self.prints_: tuple[int, ...] | None = None
        self.shape: int | None = None  # a hash of the labels of the tree
        self.size = 1

    def prints(self) -> tuple[int, ...]:
        """Hashes of the block's own texts."""
        if self.prints_ is None:
            self.prints_ = tuple(map(_print, self.texts()))
        return self.prints_

    def texts(self) -> list[str]:
        """Runs of text between child blocks, white space collapsed."""
        out, run = [], []
        for x in [*self.items, None]:
            if isinstance(x, str):
                run.append(x)
            elif run:
                text = " ".join("".join(run).split())
                if text:
                    out.append(text)
                run = []
        return out


def _print(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def _shaped(root: Block) -> int:
    """The shape of a tree; every node in it gets its shape and size."""
    if root.shape is None:
        for b in reversed([*_walk(root, lambda b: b.shape is None)]):
            b.shape = xxhash.xxh64_intdigest(f"{b.label}|{[c.shape for c in b.children]}")
            b.size = 1 + sum(c.size for c in b.children)
    return root.shape


def slots(root: Block) -> Block:
    """The tree with runs of like siblings as one node each, whose children are merged."""
    made: dict[int, Block] = {}
    for b in reversed([*_walk(root)]):
        slot = Block(b.tag, b.label, b.content)
        slot.of, slot.prints_ = [b], b.prints()
        for c in b.children:
            own = made.pop(id(c))
            if slot.children and _alike(slot.children[-1], own):
                merge(slot.children[-1], own)
            else:
                slot.children.append(own)
        made[id(b)] = slot
    return made[id(root)]


def _alike(a: Block, b: Block) -> bool:
    """Whether siblings are one repeated slot: one label, and over half of their nodes match."""
    return a.label == b.label and 4 * matching(a, b) > a.size + b.size


def merge(a: Block, b: Block) -> None:
    """Puts the tree b into a (partial tree alignment): partners become one, the others are inserted in order."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.shape = None
        x.of += y.of
        x.prints_ = tuple(dict.fromkeys(x.prints() + y.prints()))
        if not y.children:
            continue
        if not x.children:
            x.children = [*y.children]
            continue
        pairs = _matched(x.children, y.children)
        partner = {id(d): c for c, d in pairs}
        after: dict[int | None, list[Block]] = {}
        last = None
        for d in y.children:
            if id(d) in partner:
                last = id(partner[id(d)])
            else:
                after.setdefault(last, []).append(d)
        x.children = after.get(None, []) + [e for c in x.children for e in (c, *after.get(id(c), []))]
        todo += pairs


def _listed(root: Block, texts: Callable[[Block], Iterable[int]] = lambda b: ()) -> str:
    """A tree as labels, and of each node, in order, its parent, label and hashes of texts."""
    blocks = [*_walk(root)]
    number = {id(b): i for i, b in enumerate(blocks)}
    parent = {id(c): number[id(b)] for b in blocks for c in b.children}
    labels = [*dict.fromkeys(b.label for b in blocks)]
    at = {x: i for i, x in enumerate(labels)}
    return json.dumps([labels, [[parent.get(id(b), -1), at[b.label], *texts(b)] for b in blocks]], separators=(",", ":"))


def _tree(text: str) -> list[Block]:
    """The nodes of a listed tree, in order."""
    labels, rows = json.loads(text)
    blocks = []
    for parent, label, *prints in rows:
        block = Block(labels[label].partition(".")[0], labels[label], True)
        block.prints_ = tuple(prints)
        if parent >= 0:
            blocks[parent].children.append(block)
        blocks.append(block)
    return blocks


def outline(page: str) -> str:
    """The tree of a page without its texts."""
    return _listed(slots(parse(page)))


def merged_outlines(outlines: list[str]) -> str:
    """The merged tree of outlines."""
    whole, *others = (_tree(x)[0] for x in outlines)
    for x in others:
        merge(whole, x)
    return _listed(whole)


def wrapper(pages: list[str], outlines: Iterable[str] = ()) -> str:
    """The merged tree of pages, and then of outlines: labels, and of each node, in order, its parent, label and the hashes of
    texts that two pages (or the only one) have there."""
    whole, seen = None, []
    for page in pages:
        tree = slots(parse(page))
        if whole is None:
            whole = tree
        else:
            for b in _walk(tree):
                b.prints_ = tuple(dict.fromkeys(b.prints()))
            before = {id(b): b.prints() for b in _walk(whole)}
            pairs = align(whole, tree)
            seen += [(x, set(before[id(x)]) & set(y.prints())) for x, y in pairs]
            merge(whole, tree)
    if whole is None:
        whole = Block("", "", True)
    known: dict[int, set[int]] = {}
    for x, both in seen:
        known.setdefault(id(x), set()).update(both)
    for x in outlines:
        merge(whole, _tree(x)[0])
    return _listed(whole, lambda b: b.prints() if len(pages) < 2 else sorted(known.get(id(b), ())))


def skeleton(page: str) -> str:
    """The wrapper of one page."""
    return wrapper([page])


@lru_cache(maxsize=256)
def _reference(text: str) -> tuple[Block, dict[int, int]]:
    """The tree of a wrapper and the number of each of its nodes."""
    blocks = _tree(text)
    return blocks[0], {id(b): i for i, b in enumerate(blocks)}


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) if v else "" for k, v in _ATTRIBUTE.findall(text)}


def _is_noise(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in _NEVER or (tag == "header" and not in_article) or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if attrs.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return bool(named.strip()) and tag not in ("html", "body", "article", "main") and bool(_NOISE.search(named))


def parse(page: str) -> Block:
    """The tree of block elements; inline text belongs to its block."""
    root = Block("", "", True)
    stack, inline = [root], []  # inline: open noise elements that aren't blocks
    opened: Counter[str] = Counter()
    at, end, link = 0, len(page), False

    def text(a: int, b: int) -> None:
        if a < b and not inline:
            run = entities.unescape(page[a:b])
            stack[-1].items.append(run)
            if link:
                stack[-1].linked += len(run)

    def cut(k: int) -> None:
        opened.subtract(b.tag for b in stack[k:])
        del stack[k:]

    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if inline and inline[-1] == tag:
                inline.pop()
            elif tag in _BLOCK and opened[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                cut(k)
                inline.clear()
                link = False
            elif tag == "a":
                link = False
            continue
        if tag == "br":
            if not inline:
                stack[-1].items.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                stack[-1].items.append(Block("hr", "hr", False))
            continue
        closed = m[3].rstrip(">").endswith("/")
        if tag in _RAW:
            if not closed and tag != "head":
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else (end if tag in ("script", "style", "textarea", "title") else at)
            elif tag == "head":
                stop = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, _skip_raw(page, at))
                at = end if not stop else stop.end() if stop[0].startswith("</") else stop.start()
            continue
        attrs = _attributes(m[3].rstrip(">")) if m[3] != ">" else {}
        noise = _is_noise(tag, attrs, opened["article"] + opened["main"] > 0)
        if tag not in _BLOCK:
            link = link or (tag == "a" and not closed)
            if noise and not closed:
                inline.append(tag)
            continue
        inline.clear()
        link = False
        if stack[-1].tag == "p" and tag not in ("button", "option"):
            cut(len(stack) - 1)
        if tag in _CLOSES and any(opened[x] for x in _CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SCOPE[tag]:
                    break
                if stack[k].tag in _CLOSES[tag]:
                    cut(k)
                    break
        block = Block(tag, f"{tag}.{attrs.get('class', '')}", stack[-1].content and not noise)
        stack[-1].items.append(block)
        stack[-1].children.append(block)
        if not closed:
            stack.append(block)
            opened[tag] += 1
    return root


def _skip_raw(page: str, at: int) -> int:
    """The end of the last script, style or title that begins in the head."""
    inner = re.compile(r"<(script|style|title)\b[^>]*>.*?</\1\s*>|</head\s*>|<body[\s>]", re.I | re.S)
    while (m := inner.search(page, at)) and m[1]:
        at = m.end()
    return at


def _walk(block: Block, into: Callable[[Block], bool] | None = None) -> Iterator[Block]:
    todo = [block]
    while todo:
        yield (b := todo.pop())
        todo += reversed(b.children if into is None else [c for c in b.children if into(c)])


def align(a: Block, b: Block) -> list[tuple[Block, Block]]:
    """Simple tree matching: pairs of blocks of two trees, in order, parents with parents."""
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += _matched(x.children, y.children)
    return pairs


#: Matched nodes of pairs of shapes.
_MATCHES: dict[tuple[int, int], int] = {}
_MOST_MATCHES = 500_000


def matching(x: Block, y: Block) -> int:
    """The most nodes of two trees that can be matched, in order, parents with parents and roots with each other."""
    if len(_MATCHES) > _MOST_MATCHES:
        _MATCHES.clear()
    todo = [(x, y)]
    while todo:
        a, b = todo[-1]
        if a.label != b.label or _known(a, b) is not None:
            todo.pop()
            continue
        missing = [(c, d) for c in a.children for d in b.children if c.label == d.label and _known(c, d) is None]
        if missing:
            todo += {(c.shape, d.shape): (c, d) for c, d in missing}.values()
            continue
        row = [0] * (len(b.children) + 1)
        for c in a.children:
            new = [0]
            for j, d in enumerate(b.children):
                new.append(max(new[-1], row[j + 1], row[j] + (_known(c, d) if c.label == d.label else 0)))
            row = new
        _MATCHES[a.shape, b.shape] = 1 + row[-1]
        todo.pop()
    return _known(x, y) if x.label == y.label else 0


def _known(x: Block, y: Block) -> int | None:
    return x.size if _shaped(x) == _shaped(y) else _MATCHES.get((x.shape, y.shape))


def _weight(x: Block, y: Block) -> float:
    """Matched nodes of two subtrees; equal texts count half a node."""
    return matching(x, y) + (0.5 if x.prints() == y.prints() else 0) if x.label == y.label else 0


def _perfect(x: Block, y: Block) -> bool:
    return x.label == y.label and _shaped(x) == _shaped(y) and x.prints() == y.prints()


def _matched(xs: list[Block], ys: list[Block]) -> list[tuple[Block, Block]]:
    """The heaviest matching of two lists in order.

    Ends that match as well as any can are taken first. Then the list xs is halved, where the
    best values of its halves add up to the most, until a table is of at most _CELLS
    cells (Hirschberg's method), so that memory is bounded whatever the lengths.
    """
    low, n, m = 0, len(xs), len(ys)
    while low < min(n, m) and _perfect(xs[low], ys[low]):
        low += 1
    high = 0
    while high < min(n, m) - low and _perfect(xs[n - 1 - high], ys[m - 1 - high]):
        high += 1
    out = [*zip(xs[:low], ys[:low], strict=True)]
    todo = [(low, n - high, low, m - high)]
    marks = None
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= _CELLS or b - a == 1:
            out += _table(xs[a:b], ys[c:d])
            continue
        if marks is None:
            marks = _marks(xs, ys)
        half = (a + b) // 2
        before, after = _values(marks, range(a, half), c, d, False), _values(marks, range(b - 1, half - 1, -1), c, d, True)
        cut = c + int((before + after).argmax())
        todo += [(half, b, cut, d), (a, half, c, cut)]
    return out + [*zip(xs[n - high :], ys[m - high :], strict=True)]


def _marks(xs: list[Block], ys: list[Block]) -> tuple[np.ndarray, ...]:
    """Weights of pairs of shapes, and the shapes and own texts of both lists as numbers."""
    shapes, texts = [], []
    for bs in (xs, ys):
        kinds: dict[int, int] = {}
        shapes.append((np.array([kinds.setdefault(_shaped(b), len(kinds)) for b in bs]), [*{b.shape: b for b in bs}.values()]))
    known: dict = {}
    texts = [np.array([known.setdefault(b.prints(), len(known)) for b in bs]) for bs in (xs, ys)]
    weights = np.array([[matching(x, y) for y in shapes[1][1]] for x in shapes[0][1]], float)
    return weights, shapes[0][0], shapes[1][0], *texts


def _values(marks: tuple[np.ndarray, ...], rows: range, c: int, d: int, back: bool) -> np.ndarray:
    """At each cut of ys[c:d] the most that the rows gain with what lies before it (or behind it)."""
    step = -1 if back else 1
    weights, xs, ys, xt, yt = marks
    ys, yt = ys[c:d][::step], yt[c:d][::step]
    best = np.zeros(d - c + 1)
    for i in rows:
        w = weights[xs[i]][ys]
        w = w + 0.5 * ((yt == xt[i]) & (w > 0))
        best[1:] = np.maximum(best[1:], best[:-1] + w)
        np.maximum.accumulate(best, out=best)
    return best[::step]


def _table(xs: list[Block], ys: list[Block]) -> list[tuple[Block, Block]]:
    n, m = len(xs), len(ys)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    weights = [[0.0] * m for _ in range(n)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            w = weights[i][j] = _weight(xs[i], ys[j])
            take = below[j + 1] + w if w else -1
            row[j] = max(take, below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if weights[i][j] and best[i][j] == best[i + 1][j + 1] + weights[i][j]:
            out.append((xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def content_of(root: Block) -> list[tuple[Block, str, bool]]:
    """(block, text, inside) in page order of all that isn't marked as something else; inside is what
    belongs to the largest article (or else main) element, or without one everything."""
    out: list[tuple[Block, str]] = []

    def own(block: Block, run: list[str]) -> None:
        text = " ".join("".join(run).split()) if block.content else ""
        if text:
            out.append((block, text))

    tops: dict[int, tuple[int, int]] = {}  # places in out of each article and main
    todo: list[tuple[Block, int, list[str], int]] = [(root, 0, [], 0)]
    while todo:
        block, k, run, since = todo.pop()
        while k < len(block.items):
            x = block.items[k]
            k += 1
            if isinstance(x, str):
                run.append(x)
            else:
                own(block, run)
                todo.append((block, k, [], since))
                todo.append((x, 0, [], len(out)))
                break
        else:
            own(block, run)
            if block.tag in ("article", "main") and len(out) > since:
                tops[id(block)] = (block.tag, since, len(out))
    low, high = 0, len(out)
    for tag in ("article", "main"):
        found = [(a, z) for t, a, z in tops.values() if t == tag]
        if found:
            low, high = max(found, key=lambda r: (sum(len(t) for _, t in out[r[0] : r[1]]), -r[0]))
            break
    return [(b, t, low <= i < high) for i, (b, t) in enumerate(out)]


def page_blocks(page: str, reference: str | None) -> list[tuple[str, int, bool, int, int, bool]]:
    """Unmarked blocks as (text, wrapper node or -1, whether the wrapper knows the text there, its hash
    as a signed number, 0 without a node, characters outside links, inside the page's own article)."""
    root = parse(page)
    found = content_of(root)
    if reference is None or not found:
        return [(t, -1, False, 0, len(t), inside) for _, t, inside in found]
    ref, numbers = _reference(reference)
    node = {id(b): y for x, y in align(slots(root), ref) for b in x.of}
    out, linked = [], set()
    for block, text, inside in found:
        y = node.get(id(block))
        mark = _print(text)
        size = len(text) if id(block) in linked else max(0, len(text) - block.linked)
        linked.add(id(block))
        same = y is not None and mark in y.prints()
        out.append((text, -1 if y is None else numbers[id(y)], same, 0 if y is None else _signed(mark), size, inside))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def decide(reference: str, pages: int, counts: list[tuple[int, int, int]], masses: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """(template as (node, text), nodes of the content region) of a host.

    counts are (node, text, pages that have it there; text 0: pages with the node), masses are
    (node, text, characters, blocks). A host with one different page has neither. The region of a host whose
    text is all constant is empty. In the region of fewer than REFERENCES pages constant texts are template only if they
    are not the most of its blocks: copies of one article aren't a template.
    """
    if pages < 2:
        return [], []
    having = {n: c for n, mark, c in counts if not mark}
    template = {(n, mark) for n, mark, c in counts if mark and c >= max(2, TEMPLATE_SHARE * having[n])}
    root, numbers = _reference(reference)
    nodes = [*_walk(root)]
    mass, fixed, free = {}, {}, {}
    for n, mark, size, blocks in masses:
        if (n, mark) in template:
            fixed[n] = fixed.get(n, 0) + blocks
        else:
            mass[n] = mass.get(n, 0) + size
            free[n] = free.get(n, 0) + blocks
    total = {id(b): mass.get(numbers[id(b)], 0) for b in nodes}
    for b in reversed(nodes):
        for c in b.children:
            total[id(b)] += total[id(c)]
    top = root
    while total[id(top)]:
        if any(c.tag in _HEADINGS and total[id(c)] for c in top.children):
            break  # a heading belongs to the text beside it
        inner = [c for c in top.children if c.children and total[id(c)] >= REGION_SHARE * total[id(top)]]
        if not inner:
            break
        top = inner[0]
    region = [numbers[id(b)] for b in _walk(top)] if total[id(top)] else []
    inside = set(region)
    if pages < REFERENCES and sum(fixed.get(n, 0) for n in inside) > sum(free.get(n, 0) for n in inside):
        template = {t for t in template if t[0] not in inside}
    return sorted(template), region


_FIELDS = ("text", "node", "same", "mark", "size", "inside")
_BLOCKS = pa.list_(pa.struct(list(zip(_FIELDS, (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_()), strict=True))))
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("digest", pa.int64()), ("blocks", _BLOCKS)])
_DECIDED = pa.schema([("host", pa.string()), ("template", pa.list_(pa.struct([("node", pa.int32()), ("mark", pa.int64())]))), ("region", pa.list_(pa.int32()))])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Pages without a host (null or odd urls) are read without a wrapper. A
    null page is empty and has no text; a null id stays null; repeated rows and equal pages of a host count as one
    page in the wrapper and are each returned; other columns are ignored; an
    empty table gives an empty result; very long and deep pages are aligned as all others. A page with nothing
    in its host's region, or whose blocks there are all template, keeps its own article, or else all unmarked text.
    """
    rows = picked(pages, page_id=(id_col, "long"), url=(url_col, "string"), html=(html_col, "string")).withColumn("html", F.coalesce("html", F.lit("")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.withColumn("host", F.nullif(host, F.lit(""))).withColumn("digest", F.xxhash64("html"))
    some = rows.filter("host IS NOT NULL AND html <> ''").groupBy("host", F.pmod(F.shiftright("digest", 8), F.lit(REFERENCES)).alias("part")).agg(F.min_by("html", "digest").alias("html"))
    chosen = some.groupBy("host").agg(F.sort_array(F.collect_list("html")).alias("pages"))  # REFERENCES pages at most

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array([outline(x.as_py()) for x in batch["html"]], pa.string())], names=["host", "outline"])

    def joined_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array([merged_outlines(x.as_py()) for x in batch["outlines"]], pa.string())], names=["host", "outline"])

    # all outlines of a host that differ, merged in parts and then whole
    different_ = rows.filter("host IS NOT NULL AND html <> ''").select("host", "html").mapInArrow(outlined, "host string, outline string").distinct()
    dealt = different_.groupBy("host", F.pmod(F.xxhash64("outline"), F.lit(_OUTLINE_PARTS)).alias("part")).agg(F.sort_array(F.collect_list("outline")).alias("outlines"))
    parts = dealt.select("host", "outlines").mapInArrow(joined_, "host string, outline string")
    chosen = chosen.join(parts.groupBy("host").agg(F.sort_array(F.collect_list("outline")).alias("outlines")), "host")

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wrapper(x.as_py(), y.as_py()) for x, y in zip(batch["pages"], batch["outlines"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(made, pa.string())], names=["host", "reference"])

    # one wrapper a host, of a size that Spark knows: it goes to all tasks if it is small, and meets the pages by host otherwise
    references = written(chosen.mapInArrow(induce, "host string, reference string"), "references")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [[dict(zip(_FIELDS, b, strict=True)) for b in page_blocks(h.as_py(), r.as_py())] for h, r in zip(batch["html"], batch["reference"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["host"], batch["digest"], pa.array(blocks, _BLOCKS)], schema=_PAGE)

    beside = rows.join(references, "host", "left").select("page_id", "url", "host", "digest", "html", "reference")
    schema = "page_id long, url string, host string, digest long, blocks array<struct<text:string,node:int,same:boolean,mark:long,size:int,inside:boolean>>"
    read = written(beside.mapInArrow(run, schema), "blocks")

    slim = F.transform(F.filter("blocks", lambda b: b["node"] >= 0), lambda b: F.struct(b["node"].alias("node"), b["mark"].alias("mark"), b["size"].alias("size")))
    different = read.filter("host IS NOT NULL").select("host", "digest", slim.alias("b")).groupBy("host", "digest").agg(F.first("b").alias("b"))
    nodes = F.transform("b", lambda b: F.struct(b["node"].alias("node"), F.lit(0).cast("long").alias("mark")))
    texts = F.transform(F.filter("b", lambda b: b["mark"] != 0), lambda b: F.struct(b["node"].alias("node"), b["mark"].alias("mark")))
    page = F.struct(F.lit(-1).alias("node"), F.lit(0).cast("long").alias("mark"))
    once = F.transform(F.array_distinct(F.concat(F.array(page), nodes, texts)), lambda x: F.struct(x["node"].alias("node"), x["mark"].alias("mark"), F.lit(1).alias("n"), F.lit(0).alias("size"), F.lit(0).alias("blocks")))
    sizes = F.transform("b", lambda b: F.struct(b["node"].alias("node"), b["mark"].alias("mark"), F.lit(0).alias("n"), b["size"].alias("size"), F.lit(1).alias("blocks")))
    counts = different.select("host", F.inline(F.concat(once, sizes))).groupBy("host", "node", "mark").agg(*[F.sum(c).alias(c) for c in ("n", "size", "blocks")])
    # texts that too few pages with their node have are no template: they are one sum for each node, those of one page first,
    # summed in part before the shuffle
    shared = (F.col("mark") == 0) | (F.col("n") >= 2)
    counts = counts.select("host", "node", F.when(shared, F.col("mark")).otherwise(F.lit(0)).alias("mark"), F.when(shared, F.col("n")).otherwise(F.lit(0)).alias("n"), "size", "blocks")
    counts = counts.groupBy("host", "node", "mark").agg(*[F.sum(c).alias(c) for c in ("n", "size", "blocks")])
    having = counts.filter("mark = 0").select("host", "node", F.col("n").alias("having"))
    often = (F.col("mark") == 0) | (F.col("n") >= F.greatest(F.lit(2.0), TEMPLATE_SHARE * F.col("having")))
    counts = counts.join(having, ["host", "node"]).select("host", "node", F.when(often, F.col("mark")).otherwise(F.lit(0)).alias("mark"), F.when(often, F.col("n")).otherwise(F.lit(0)).alias("n"), "size", "blocks")
    counts = counts.groupBy("host", "node", "mark").agg(*[F.sum(c).alias(c) for c in ("n", "size", "blocks")])
    # a wrapper's nodes and its template's texts
    listed = counts.groupBy("host").agg(F.collect_list(F.struct("node", "mark", "n", "size", "blocks")).alias("counts")).join(references, "host")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, templates, regions = batch["host"].to_pylist(), [], []
            for rows_, reference in zip(batch["counts"].to_pylist(), batch["reference"].to_pylist(), strict=True):
                pages_ = next((r["n"] for r in rows_ if r["node"] < 0), 0)
                of = [r for r in rows_ if r["node"] >= 0]
                template, region = decide(reference, pages_, [(r["node"], r["mark"], r["n"]) for r in of if r["n"]], [(r["node"], r["mark"], r["size"], r["blocks"]) for r in of if r["blocks"]])
                templates.append([{"node": n, "mark": m} for n, m in template])
                regions.append(region)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((hosts, templates, regions), _DECIDED.types, strict=True)], schema=_DECIDED)

    decided = written(listed.mapInArrow(settle, "host string, template array<struct<node:int,mark:long>>, region array<int>"), "decided")
    joined = read.join(decided.filter(F.size("region") > 0), "host", "left")
    varying = F.filter("blocks", lambda b: F.array_contains("region", b["node"]) & ~F.array_contains("template", F.struct(b["node"].alias("node"), b["mark"].alias("mark"))))
    kept = F.when(F.col("region").isNotNull() & (F.size(varying) > 0), varying).otherwise(F.filter("blocks", lambda b: b["inside"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
