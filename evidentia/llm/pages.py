"""Main text of HTML pages by a minimum cut.

A tolerant reader turns a page into blocks (runs of text between block-level boundaries) and the tree of the
elements around them. Both are nodes of one graph. A logistic classifier of a block's own text (length, links,
sentences, list or cell; nothing of what stands around it) gives the cost of calling it content and of calling
it boilerplate; an element's cost comes from what its author calls it: its tag, role and names. These costs are
the capacities from the source and to the sink. Smoothness edges tie each block to its element and each element
to the one around it (DOM proximity), and blocks that follow each other (adjacency), the more so the more of the
tree they share. The cut of the maximum flow is the labelling of least cost. So a short line in an article is
content because its neighbours are, a layout's odd class name is outvoted by the prose below it, and an advert's
fine prose goes with the advert.

A block's cost is at most ``CLIP``, below the weight of one edge, so text by itself overrules no element that
says what it is; together blocks can. Names that mean one thing (an ``aside``, a class ``comments``) cost more
than any text, and tie what they hold to them; names that may mean the layout (``right-sidebar``) cost little.
Nodes whose own capacity exceeds all their edges are labelled at once and folded into their neighbours; Dinic's
algorithm does the rest.

The classifier's weights are fitted around documented prior weights on at most ``SAMPLE`` pages of at most
``SAMPLE_CHARS`` code points, with the pages' semantic elements (article, main, nav, footer, aside) as labels.

Values: null or empty html gives the text ''. Character references are decoded, white space in a block
becomes one space, blocks are joined in page order by two line feeds. Repeated pages are extracted alike, null and
repeated page_ids are handed on, other columns are not read, and an empty table gives an empty result. A page of any
length or depth is read in time proportional to it; tags that never end are text or skipped, and cost no more.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import frugal, small_batches

SAMPLE = 600
SAMPLE_CHARS = 100_000
SCALE = 1000
#: The most that a block's text costs; edges between a block and its element, an element and the one around it, blocks in page order (times the share of the tree that they have in common).
CLIP, OWN, UP, NEXT = 0.9, 1.5, 1.0, 0.3
#: The edge between an element that calls itself boilerplate and the one around it.
ASIDE = 0.05
#: The cost of an element that can only be boilerplate, and what ties its parts to it.
STRONG, BOUND = 1e6, 50.0
#: Costs of elements by what they are called: for content above 0, for boilerplate below.
MAIN, FORM, HEADER, LAYOUT, HINT, GOOD = 4.0, -6.0, -6.0, -3.0, -0.5, 1.0

_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Text that is never shown; in those of the second set only if they end.
_RAW = frozenset("script style textarea title".split())
_UNSEEN = frozenset("noscript template iframe svg object canvas".split())
#: What may stand in a head; anything else ends it.
_HEAD = frozenset("title meta link script style base noscript template".split())
#: What an opening tag ends: the innermost of the first set, not beyond the second.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_BAD_TAGS = frozenset("nav footer aside button select menu dialog noscript".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: Words of names that mean boilerplate, that mean content, and that tell nothing beside another word.
_BAD = frozenset("ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer hidden legal login masthead menu modal nav navbar navigation newsletter notice pagination pager popup popular promo promos promotion recommend recommended recommendations related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
_GOOD = frozenset("article body content entry main post story text articlebody".split())
_PLAIN = frozenset("area bar block body bottom box container content global group holder inner item items link links list main outer page panel primary secondary section site text title top wrap wrapper".split())
_SIDES = frozenset("left right one two three col column columns layout".split())
_NOT = frozenset("no not non without has with hide show is".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Prior weights: bias, length, links, sentences, list item or cell.
PRIOR = np.array([-0.3, 1.2, -3.5, 0.8, -0.8])


class Block:
    __slots__ = ("depth", "element", "linked", "low", "parts", "tag", "text")

    def __init__(self, tag: str, element: int, depth: int, low: int) -> None:
        #: low: how much of the tree it shares with the block before
        self.tag, self.element, self.depth, self.low, self.parts, self.linked, self.text = tag, element, depth, low, [], 0, ""


class Page:
    """Blocks with text, in page order, and the elements around them: each one's parent (-1: none) and cost, and whether it can only be boilerplate."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parent: list[int] = [-1]
        self.cost: list[float] = [0.0]
        self.strong: list[bool] = [False]


def _named(value: str, is_id: bool) -> float:
    """The cost that class names or an id give their element; -STRONG for a name that means boilerplate only."""
    cost, layout = 0.0, False
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        known = set(words)
        if known & _SIDES and not known & _BAD or known <= {"container", "wrapper", "page", "site", "row", "grid"}:
            layout = True
        if known & _NOT or not known:
            continue
        if bad := known & _BAD:
            rest = known - _BAD - _PLAIN
            if not rest:
                return -STRONG
            cost = min(cost, LAYOUT if rest <= _SIDES else 0.0 if is_id else HINT)
        elif "header" in known and known - {"header"} <= _PLAIN - {"title", "content", "body", "text", "section", "item"}:
            cost = min(cost, HEADER)
        elif known & _GOOD and known <= _GOOD | _PLAIN:
            cost = max(cost, GOOD) if cost >= 0 else cost
    return HINT if layout and LAYOUT <= cost < HINT else cost


def element_cost(tag: str, attrs: str, inside: bool) -> float:
    """What an element's tag and attributes say of it; inside: whether it stands in an article or a main element."""
    cost = -STRONG if tag in _BAD_TAGS else MAIN if tag in ("article", "main") else FORM if tag == "form" else 0.0
    if tag == "header" and not inside:
        # an article's own header holds its title, any other is the page's
        cost = HEADER
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "itemprop"):
                if tag not in ("html", "body", "main", "article"):
                    found = _named(value, name == "id")
                    cost = min(cost, found) if found < 0 else max(cost, found) if cost >= 0 else cost
            elif name == "role":
                cost = min(cost, -STRONG) if value.lower() in _BAD_ROLES else max(cost, MAIN) if value.lower() in ("main", "article") and cost >= 0 else cost
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _GONE.search(value):
                cost = -STRONG
    return cost


def read(page: str) -> Page:
    """The page's blocks and elements; the head's and unseen elements' text is none."""
    out = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    open_: dict[str, list[int]] = {}
    links, at, in_head, low, quoted = 0, 0, False, 1, True
    current: Block | None = None
    #: unseen elements that don't end any more
    endless: set[str] = set()
    n, last = len(page), page.rfind(">")

    def text(raw: str) -> None:
        nonlocal current, low, in_head
        words = " ".join(entities.unescape(raw).split()) if "&" in raw else " ".join(raw.split())
        if not words:
            if current and raw:
                current.parts.append(" ")
            return
        in_head = False
        if current is None:
            current = Block(stack[-1][0], stack[-1][1], len(stack), min(low, len(stack)))
            low = len(stack)
        current.parts.append((" " if raw[0].isspace() else "") + words + (" " if raw[-1].isspace() else ""))
        if links:
            current.linked += len(words)

    def close() -> None:
        nonlocal current, links
        if current:
            current.text = " ".join("".join(current.parts).split())
            out.blocks.append(current)
        current, links = None, 0

    def pop_to(i: int) -> None:
        nonlocal low
        while len(stack) > i:
            open_[stack.pop()[0]].pop()
        low = min(low, len(stack))

    def innermost(tags: tuple[str, ...]) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        at = start + 1
        follows = page[at : at + 2]
        if follows[:1] in ("!", "?"):
            end = page.find("-->", at + 1) if page.startswith("!--", at) else page.find(">", at)
            at = n if end < 0 else end + (3 if page.startswith("!--", at) else 1)
            continue
        if not (follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/" and follows[1:].isascii() and follows[1:].isalpha()):
            text("<")
            continue
        if start > last:
            # no tag ends behind here
            text(page[start:])
            break
        m = _TAG.match(page, start) if quoted else None
        if m:
            ends, tag, attrs, at = m[1], m[2].lower(), m[3], m.end()
        else:
            # quotes that never close: from here on the next bracket ends a tag
            quoted, at = False, page.find(">", start) + 1
            named = _NAME.match(page, start)
            ends, tag, attrs = follows[:1] if follows[:1] == "/" else "", named[1].lower(), page[named.end() : at - 1]
        if ends:
            if tag == "head":
                in_head = False
            elif tag == "a":
                links = 0
            elif tag in _BLOCK:
                close()
                i = innermost((tag,))
                if i and i > innermost(("body", "html")) * (tag not in ("body", "html")) and (tag != "p" or i == len(stack) - 1):
                    pop_to(i)
            continue
        if tag in _RAW or tag in _UNSEEN:
            if not attrs.endswith("/"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if not end:
                    endless.add(tag)
                at = end.end() if end else n if tag in _RAW else at
            if current:
                current.parts.append(" ")
            continue
        if tag == "head":
            in_head = True
        elif in_head and tag not in _HEAD:
            in_head = False
        if in_head:
            continue
        if tag == "a":
            links = 1
        elif tag == "br":
            if current:
                current.parts.append(" ")
        elif tag in _BLOCK:
            close()
            if tag != "hr":
                if stack[-1][0] == "p":
                    pop_to(len(stack) - 1)
                if tag in _ENDS:
                    i = innermost(_ENDS[tag][0])
                    if i and i > innermost(_ENDS[tag][1]):
                        pop_to(i)
                cost = element_cost(tag, attrs, bool(open_.get("article") or open_.get("main")))
                out.parent.append(stack[-1][1])
                out.cost.append(cost)
                out.strong.append(cost <= -STRONG)
                open_.setdefault(tag, []).append(len(stack))
                stack.append((tag, len(out.parent) - 1))
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Of each block's own text."""
    rows = []
    for b in found:
        n = len(b.text)
        words = b.text.count(" ") + 1
        ends = sum(b.text.count(c) for c in ".!?。")
        rows.append((1.0, min(math.log1p(n) / 5, 1.5), b.linked / n, min(ends / words * 5, 1.0), float(b.tag in ("li", "td", "th", "option", "button"))))
    return np.array(rows).reshape(-1, len(PRIOR))


def minimum_cut(content: list[int], boiler: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side; content, boiler: capacity from the source and to the sink; edges both ways."""
    n = len(content)
    excess = [c - b for c, b in zip(content, boiler, strict=True)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    tied = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(excess[i]) < tied[i] or excess[i] == 0 and tied[i]:
            continue
        label[i] = excess[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                excess[j] += w if label[i] else -w
                tied[j] -= w
                queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        side = _dinic([excess[i] for i in left], [(place[i], place[j], w) for i in left for j, w in near[i].items() if i < j and label[j] is None])
        for i, k in place.items():
            label[i] = side[k]
    return [bool(x) for x in label]


def _dinic(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    n = len(excess)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(excess):
        if x > 0:
            arc(s, i, x, 0)
        elif x < 0:
            arc(i, t, -x, 0)
    for i, j, w in edges:
        arc(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not cap[e])
                i = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[i] < len(out[i]):
                e = out[i][nxt[i]]
                if cap[e] and level[to[e]] == level[i] + 1:
                    break
                nxt[i] += 1
            if nxt[i] < len(out[i]):
                path.append(e)
                i = to[e]
            elif path:
                e = path.pop()
                i = to[e ^ 1]
                nxt[i] += 1
            else:
                break


def graph(page: Page, weights: np.ndarray) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Capacities from the source and to the sink of the page's blocks, then of the elements that hold one, and the edges."""
    n = len(page.blocks)
    z = np.clip(features(page.blocks) @ weights, -CLIP, CLIP).tolist()
    # an element with neither cost nor more than one part joins that part to what is around it
    parts = [0] * len(page.parent)
    for b in page.blocks:
        e = b.element
        parts[e] += 1
        while e > 0 and parts[e] == 1:
            e = page.parent[e]
            parts[e] += 1
    node: dict[int, int] = {}
    costs, edges = list(z), []

    def place(e: int) -> int:
        if e not in node:
            node[e] = n + len(node)
            costs.append(page.cost[e])
        return node[e]

    def joined(e: int, weight: float) -> tuple[int, float]:
        """The first element from e on that is a node of its own, and what ties a part of e to it."""
        while e > 0 and parts[e] == 1 and not page.cost[e]:
            weight, e = min(weight, BOUND if page.strong[page.parent[e]] else UP), page.parent[e]
        return e, weight

    waiting = []
    for i, b in enumerate(page.blocks):
        e, weight = joined(b.element, BOUND if page.strong[b.element] else OWN)
        if e not in node:
            waiting.append(e)
        edges.append((i, place(e), weight))
        if i:
            edges.append((i - 1, i, NEXT * b.low / max(b.depth, page.blocks[i - 1].depth)))
    while waiting:
        e = waiting.pop()
        if e > 0:
            # what calls itself boilerplate tells little of what is around it
            up, weight = joined(page.parent[e], BOUND if page.strong[page.parent[e]] else ASIDE if page.cost[e] <= LAYOUT else UP)
            if up not in node:
                waiting.append(up)
            edges.append((node[e], place(up), weight))
    content = [round(SCALE * max(c, 0.0)) for c in costs]
    boiler = [round(SCALE * max(-c, 0.0)) for c in costs]
    return content, boiler, [(i, j, round(SCALE * w)) for i, j, w in edges]


def labelled(page: Page, weights: np.ndarray) -> list[bool]:
    """True for content, block by block."""
    return minimum_cut(*graph(page, weights))[: len(page.blocks)] if page.blocks else []


def extract(page: str | None, weights: np.ndarray = PRIOR) -> str:
    found = read(page or "")
    return "\n\n".join(b.text for b, keep in zip(found.blocks, labelled(found, weights), strict=True) if keep)


def _semantic(page: Page) -> list[int]:
    """1 for blocks whose innermost telling element is an article or main, 0 for boilerplate's, -1 for others."""
    by = [-1]
    for e in range(1, len(page.parent)):
        above = by[page.parent[e]]
        by.append(0 if page.strong[e] or above == 0 else 1 if page.cost[e] >= MAIN else above)
    return [by[b.element] for b in page.blocks]


def train(pages: list[str], ridge: float = 5.0, rounds: int = 30) -> np.ndarray:
    """The prior weights, moved by the blocks that semantic elements mark; in a fixed order of pages the result is fixed."""
    xs, ys = [], []
    for p in pages:
        found = read(p)
        y = np.array(_semantic(found))
        if len(y):
            x = features(found.blocks)
            xs.append(x[y >= 0])
            ys.append(y[y >= 0])
    if not xs or len({*np.concatenate(ys).tolist()}) < 2:
        return PRIOR
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    # every block counts alike, both kinds alike, and all together as a number of blocks that the prior can outweigh
    weight = np.where(y == 1, 200 / max(y.sum(), 200), 200 / max((1 - y).sum(), 200))
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * (w - PRIOR)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    # the choice by narrow rows; then only the chosen pages go to the driver
    keyed = pages.select("html", F.xxhash64("page_id", "html").alias("pick")).filter(F.length("html").between(1, SAMPLE_CHARS))
    few = keyed.select("pick").orderBy("pick").limit(sample).distinct()
    rows = keyed.join(F.broadcast(few), "pick").dropDuplicates(["pick"]).orderBy("pick")
    return train([r["html"] for r in rows.collect()])


def main_texts(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")
