"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks with the evidence of the tags and class words above them. A linear classifier turns the
features of a block into costs of calling it content or boilerplate; they are the capacities from the source and to the
sink. Neighbouring blocks, and consecutive blocks under one parent, are tied by smoothness edges, stronger the closer they
stand in the tree. The maximum flow is found by reducing blocks with one or two ties in series and in parallel, which
takes linear time and solves page graphs whole, and by augmenting paths for whatever is left. The blocks on the
source's side of the minimum cut are the main text.

The weights of the classifier have prior values; `fit` moves them, within half and twice the prior, to those that best tell
blocks inside <article> or <main> from blocks outside over the pages given.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import by_rows

#: Attributes as HTML reads them: a quote inside an unquoted value is part of it, and an unclosed quote is a name.
VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+" + VALUE + r"?+)?+)*+)(?:>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)|</>",
    re.S,
)
NAMES = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
#: Their content is no text of the page.
SILENT = frozenset(["script", "style", "template", "select", "option", "button", "head", "audio", "video"])
#: Read as raw text up to the end tag, and no text of the page either.
RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noframes", "noembed"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title head hr".split()
)
#: What may stand in a head; anything else, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: A start tag of the key closes an open element of the value, up to the nearest sectioning element.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Evidence of an element for content (above zero) and for boilerplate (below), in units of log odds.
TAG_WEIGHT = {"article": 6.0, "main": 4.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "header": -6.0, "menu": -12.0, "dialog": -12.0, "fieldset": -12.0}
ROLE_WEIGHT = {"main": 4.0, "article": 6.0, "navigation": -12.0, "banner": -6.0, "contentinfo": -12.0, "complementary": -12.0, "search": -12.0, "form": -12.0, "dialog": -12.0, "alert": -12.0, "menu": -12.0, "menubar": -12.0}
NAME_WEIGHT = {
    **dict.fromkeys(["ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion"], -12.0),
    **dict.fromkeys(["cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "alert", "newsletter", "subscribe", "signup", "login"], -12.0),
    **dict.fromkeys(["comment", "comments", "reply", "replies", "disqus", "respond", "discussion"], -12.0),
    **dict.fromkeys(["sidebar", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "pagination", "pager", "menu", "nav", "navbar", "navigation", "toolbar"], -12.0),
    **dict.fromkeys(["footer", "copyright", "masthead", "search", "form"], -12.0),
    **dict.fromkeys(["header"], -6.0),
    **dict.fromkeys(["article", "content", "post", "entry", "story", "main", "body", "text"], 3.0),
}
#: Class words behind one of these say what a page has, not what the element is.
MODIFIERS = frozenset(["no", "not", "has", "have", "with", "without", "tag", "category", "hide", "show", "is", "js", "open"])
#: On <article> and <main> only these whole class words count against the element.
REMARK = frozenset(["comment", "reply", "ad", "advert", "advertisement", "promo", "teaser", "related", "sponsored"])
CUE = re.compile(
    r"\A\W*(?:©|\(c\) \d{4}|copyright\b|all rights reserved|advertisement\b|sponsored\b|leave a (?:comment|reply)|\d+ comments?\b|related (?:articles|posts|stories)|share (?:this|on)\b|skip to\b|sign (?:up|in)\b|log ?in\b|subscribe\b|(?:we|this site) uses? cookies|accept (?:all )?cookies)",
    re.I,
)
#: Features of a block and their prior weights.
FEATURES = ("bias", "length", "linked", "sentence", "heading", "paragraph", "cue", "names")
PRIOR = (0.5, 0.6, -5.0, 0.5, 1.0, 0.8, -4.0, 1.0)
#: Text share from which a label on an element is not believed if it leaves the page without text.
MOST = 0.8


def evidence(tag: str, attributes: str) -> tuple[float, float]:
    """What the tag and role, and what the class words of an element say."""
    said, named = TAG_WEIGHT.get(tag, 0.0), 0.0
    if not attributes or tag in ("html", "body"):
        return said, 0.0
    strict = tag in ("article", "main")
    for key, *value in NAMES.findall(attributes):
        for token in "".join(value).lower().split():
            if key.lower() == "role":
                said = said or ROLE_WEIGHT.get(token, 0.0)
                continue
            if strict:
                named = -12.0 if token in REMARK else named
                continue
            words = SPLIT.split(token)
            stop = next((k for k, w in enumerate(words) if w in MODIFIERS), len(words))
            for w in words[:stop]:
                weight = NAME_WEIGHT.get(w, 0.0)
                named = min(named, weight) if weight < 0 or named < 0 else max(named, weight)
    return said, named


class Block:
    """A run of text: its nodes in the tree are `node` (where it stands) and `parent` (of the block element it is in)."""

    __slots__ = ("depth", "inner", "linked", "node", "parent", "parts", "shared", "size")

    def __init__(self, node: int, parent: int, inner: str, depth: int, shared: int):
        self.node, self.parent, self.inner, self.depth, self.shared, self.parts, self.linked, self.size = node, parent, inner, depth, shared, [], 0, 0


class Tree:
    """Elements of a page: the number of the parent (smaller than one's own), and the evidence of tag and class words."""

    def __init__(self) -> None:
        self.parent, self.tag, self.said, self.named = [-1], [""], [0.0], [0.0]

    def add(self, parent: int, tag: str, attributes: str) -> int:
        said, named = evidence(tag, attributes)
        self.parent.append(parent)
        self.tag.append(tag)
        self.said.append(said)
        self.named.append(named)
        return len(self.parent) - 1

    def sums(self, doubted: set[int] | None = None) -> tuple[list[float], list[float], list[bool]]:
        """Per element: evidence of tags, and of class words, on the way down to it, and whether it is inside the article.

        The strongest evidence for content counts once, all evidence against it adds up. A header inside an article counts nothing.
        """
        doubted = doubted or set()
        up, down, names_up, names_down, inside = [0.0], [0.0], [0.0], [0.0], [False]
        for k in range(1, len(self.parent)):
            p, said, named = self.parent[k], self.said[k], self.named[k]
            if k in doubted or (inside[p] and self.tag[k] == "header"):
                said, named = max(said, 0.0), max(named, 0.0)
            up.append(max(up[p], said))
            down.append(down[p] + min(said, 0.0))
            names_up.append(max(names_up[p], named))
            names_down.append(names_down[p] + min(named, 0.0))
            inside.append(inside[p] or self.tag[k] in ("article", "main"))
        return [a + b for a, b in zip(up, down, strict=True)], [a + b for a, b in zip(names_up, names_down, strict=True)], inside


def blocks_of(page: str) -> tuple[list[tuple[str, Block]], Tree]:
    """Text blocks in page order, and the tree. White space is one blank, and character references are decoded."""
    tree = Tree()
    stack: list[tuple[str, int]] = []  # tag, number
    out: list[Block] = []
    current: Block | None = None
    at = silent = links = low = 0

    def close(k: int) -> None:
        nonlocal silent, links, low, current
        for name, _ in stack[k:]:
            silent -= name in SILENT
            links -= name == "a"
            if name in BLOCK:
                current = None
        del stack[k:]
        low = min(low, k)

    def text(raw: str) -> None:
        nonlocal current, low
        if not raw or (silent and not (stack[-1][0] == "head" and not raw.isspace())):
            return
        if silent:  # text ends a head
            close(len(stack) - 1)
            if silent:
                return
        if current is None:
            if raw.isspace():
                return
            inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), -1)
            current = Block(stack[-1][1] if stack else 0, stack[inner - 1][1] if inner > 0 else 0, stack[inner][0] if inner >= 0 else "", len(stack), low)
            low = len(stack)
            out.append(current)
        current.parts.append(html.unescape(raw) if "&" in raw else raw)
        current.size += len(raw)
        if links:
            current.linked += len(raw)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            block = tag in BLOCK
            if block:
                current = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if not block and stack[k][0] in BLOCK:  # an inline end tag reaches no further
                    break
            continue
        if silent and tag not in IN_HEAD:
            k = next((k for k, s in enumerate(stack) if s[0] == "head"), -1)
            if k >= 0:
                close(k)
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            current = None
            # a block element ends an open paragraph, and with it what is open inside
            closing = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name in closing:
                    close(k)
                    break
                if name in BLOCK:
                    break
        if tag in VOID or (tag == "head" and out):
            continue
        if m[3] and m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        stack.append((tag, tree.add(stack[-1][1] if stack else 0, tag, m[3])))
        silent += tag in SILENT
        links += tag == "a"
    done = []
    for b in out:
        words = "".join(b.parts).split()
        if words:
            done.append((" ".join(words), b))
    return done, tree


def features(text: str, b: Block, named: float) -> tuple[float, ...]:
    """FEATURES of a block, without what the tags say."""
    n = len(text)
    return (
        1.0, math.log1p(n / 40), b.linked / max(1, b.size), float(text[-1] in ".!?…:;。！？»”\")"), float(len(b.inner) == 2 and b.inner[0] == "h" and b.inner[1].isdigit()),
        float(b.inner in ("p", "blockquote", "pre")), float(n < 200 and CUE.match(text) is not None), named,
    )


def _reduce(odds: list[float], ties: list[dict[int, float]]) -> list[tuple]:
    """Takes nodes of at most two ties out of the network, adding their flow to what is left. Last one out first in."""
    order = []
    ready = [i for i in range(len(odds)) if len(ties[i]) <= 2]
    gone = [False] * len(odds)
    while ready:
        i = ready.pop()
        if gone[i] or len(ties[i]) > 2:
            continue
        gone[i] = True
        near = [*ties[i].items(), (-1, 0.0), (-1, 0.0)][:2]
        (v, a), (w, b) = near
        order.append((i, odds[i], v, a, w, b))
        none, both = min(0.0, a + b - odds[i]), min(a + b, -odds[i])
        first, second = min(a, b - odds[i]), min(b, a - odds[i])
        c = max(0.0, (first + second - none - both) / 2)
        for j, other, gain in ((v, w, first - none - c), (w, v, second - none - c)):
            if j < 0:
                continue
            del ties[j][i]
            odds[j] -= gain
            if other >= 0 and c > 0:
                ties[j][other] = ties[j].get(other, 0.0) + c
        for j in (v, w):
            if j >= 0 and len(ties[j]) <= 2:
                ready.append(j)
    return order


def _augment(odds: list[float], ties: list[dict[int, float]], nodes: list[int]) -> set[int]:
    """The nodes on the source's side of a minimum cut, by shortest augmenting paths."""
    source, sink = {i: max(0.0, odds[i]) for i in nodes}, {i: max(0.0, -odds[i]) for i in nodes}
    room = {i: dict(ties[i]) for i in nodes}
    tiny = 1e-9
    while True:
        came = {i: -1 for i in nodes if source[i] > tiny}
        queue, last = deque(came), -1
        while queue:
            i = queue.popleft()
            if sink[i] > tiny:
                last = i
                break
            for j, c in room[i].items():
                if j not in came and c > tiny:
                    came[j] = i
                    queue.append(j)
        if last < 0:
            return set(came)
        way = [last]
        while came[way[-1]] >= 0:
            way.append(came[way[-1]])
        steps = list(zip(way[1:], way, strict=False))
        flow = min([sink[last], source[way[-1]], *(room[i][j] for i, j in steps)])
        source[way[-1]] -= flow
        sink[last] -= flow
        for i, j in steps:
            room[i][j] -= flow
            room[j][i] += flow


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut. odds > 0 is capacity from the source, < 0 to the sink."""
    ties: list[dict[int, float]] = [{} for _ in odds]
    for a, b, c in edges:
        if a != b and c > 0:
            ties[a][b] = ties[b][a] = ties[a].get(b, 0.0) + c
    left = list(odds)
    order = _reduce(left, ties)
    out = {row[0] for row in order}
    core = [i for i in range(len(odds)) if i not in out]
    kept = _augment(left, ties, core) if core else set()
    side = [i in kept for i in range(len(odds))]
    for i, z, v, a, w, b in reversed(order):
        off = (a if v >= 0 and side[v] else 0.0) + (b if w >= 0 and side[w] else 0.0)
        side[i] = a + b - off - z < off - 1e-12
    return side


def label(found: list[tuple[str, Block]], tree: Tree, weights: tuple[float, ...], doubted: set[int] | None = None) -> list[bool]:
    """True for the blocks that are content."""
    said, named, _ = tree.sums(doubted)
    odds = [said[b.node] + sum(w * x for w, x in zip(weights, features(t, b, named[b.node]), strict=True)) for t, b in found]
    edges = []
    before: dict[int, int] = {}
    for k, (_, b) in enumerate(found):
        if k:
            depth = max(found[k - 1][1].depth, b.depth, 1)
            edges.append((k - 1, k, 1.5 * (b.shared / depth) ** 2))
        j = before.get(b.parent)
        if j is not None and j < k - 1:
            edges.append((j, k, 0.75))
        before[b.parent] = k
    return min_cut(odds, edges)


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """Content blocks joined by line feeds. Null, empty and text-free pages give an empty text.

    Where nothing is left, labels on elements around <article> or <main> are not believed; then those on elements that hold MOST
    of the page's text.
    """
    found, tree = blocks_of(page) if page else ([], None)
    if not found:
        return ""
    keep = label(found, tree, weights)
    if any(keep):
        return "\n".join(t for (t, _), ok in zip(found, keep, strict=True) if ok)
    around: set[int] = set()
    for k, tag in enumerate(tree.tag):
        while tag in ("article", "main") and (k := tree.parent[k]) > 0 and k not in around:
            around.add(k)
    if around:
        keep = label(found, tree, weights, around)
    if not any(keep):
        size = [0] * len(tree.parent)
        for t, b in found:
            size[b.node] += len(t)
        for k in range(len(size) - 1, 0, -1):
            size[tree.parent[k]] += size[k]
        wide = {k for k in range(1, len(size)) if size[k] >= MOST * size[0] and tree.tag[k] not in ("nav", "footer", "menu", "aside")}
        keep = label(found, tree, weights, wide)
    return "\n".join(t for (t, _), ok in zip(found, keep, strict=True) if ok)


def told_cells(page: str | None) -> dict[tuple, int]:
    """Counts of (rounded features, is inside <article> or <main>) of a page that has both kinds of blocks."""
    found, tree = blocks_of(page) if page else ([], None)
    cells: dict[tuple, int] = {}
    if not found:
        return cells
    _, named, inside = tree.sums()
    if len({inside[b.node] for _, b in found}) == 2:
        for t, b in found:
            x = features(t, b, max(-24.0, named[b.node]))
            key = (*(round(v * 8) for v in x), int(inside[b.node]))
            cells[key] = cells.get(key, 0) + 1
    return cells


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = 2000, prior: float = 200.0, steps: int = 60) -> tuple[float, ...]:
    """Weights fitted to the blocks of about `sample` pages, chosen by a hash of their id, that have an <article> or <main>.

    Logistic regression with a Gaussian prior around PRIOR that weighs as much as `prior` blocks. Spark counts blocks by
    rounded features, so the driver gets cells and no blocks. Without such pages the weights are PRIOR.
    """
    n = pages.count()
    if not n:
        return PRIOR
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(5)), F.lit(1_000_000)) < F.lit(int(min(1.0, sample / n) * 1_000_000))
    out = pa.schema([("cell", pa.list_(pa.int32())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(raw: list, part: pa.RecordBatch) -> pa.RecordBatch:
            cells: dict[tuple, int] = {}
            for x in raw:
                for key, k in told_cells(x).items():
                    cells[key] = cells.get(key, 0) + k
            return pa.RecordBatch.from_arrays([pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(cells.values()), pa.int64())], schema=out)

        yield from by_rows(batches, "html", work)

    rows = pages.where(share).select(F.col(html_col).cast("string").alias("html"))
    cells = rows.mapInArrow(run, "cell array<int>, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    if cells.empty:
        return PRIOR
    raw = np.array(cells["cell"].to_list(), float)
    x, y, count = raw[:, :-1] / 8, raw[:, -1], cells["n"].to_numpy(float)
    count = count * np.where(y > 0, 0.5 / count[y > 0].sum(), 0.5 / count[y < 1].sum()) * count.sum()
    mean = np.array(PRIOR)
    w = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (count * (p - y)) + prior * (w - mean)
        h = (x * (count * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
        w = np.clip(w, np.minimum(mean / 2, mean * 2), np.maximum(mean / 2, mean * 2))
    return tuple(w.tolist())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] = PRIOR) -> DataFrame:
    """page_id, url, text and n_chars of every page; one Arrow pass without a shuffle.

    Null and empty pages give an empty text; null ids and urls stay null; repeated pages give repeated rows; an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(raw: list, part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x, weights) for x in raw]
            return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=out)

        yield from by_rows(batches, "html", work)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
