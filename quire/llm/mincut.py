"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks: text between block-level tags, with white space folded. A linear classifier gives
the cost of calling a block content or boilerplate; these are the capacities of its edges to the two
terminals. Its evidence is the block's shape (words, links, punctuation, tag), the names of the containers
around it, and what the markup says outright (inside an article, a navigation, a form). Neighbouring blocks,
and blocks that follow each other in one container, are joined by edges whose capacity falls with their
distance in the tree. The minimum cut, found by maximum flow, is the labelling of least total cost, so a block
that looks like nothing in particular goes with those around it. Blocks whose own cost exceeds all their
smoothness edges are settled first; what is left falls into small graphs.

The weights of shape and names, and the capacities, are fitted to a bounded sample of the pages themselves, with
weak labels from those pages' markup: blocks inside an article, against blocks outside it or in navigation and
the like. The markup is no evidence in the fit, so what is learned holds for pages without such tags. Fixed
weights are the prior that the fit starts from and stays near to; without pages to learn from they are used.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import strings

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MODIFIER = re.compile(r"(?:has|with|no|without|is|js)[-_]|(?:has|with|no|without|is|js)[A-Z]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_RAW = frozenset("script style noscript template title textarea svg math iframe object select option button head audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split()
)
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th blockquote figcaption caption summary address legend".split())
_CELLS = frozenset("li dt dd td th".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
_GOOD_TAGS = frozenset("article main".split())
#: Words in class or id that hardly occur on an article's own text.
_FOREIGN = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead topbar footer copyright sidebar
    widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr popup modal
    subscribe subscription newsletter signup signin login paywall comment comments commentlist replies disqus
    outbrain taboola""".split()
)
#: Words that often mark something else than the article, but also parts of it.
_DOUBTFUL = frozenset(
    """banner toc header foot bottom legal side aside rail more trending popular follow notice notices notification
    alert warning overlay register form search reply respond discussion feedback rating reviews tags tagcloud skip
    teaser disclaimer toolbar""".split()
)
_GOOD_NAMES = frozenset("article content main post entry story body text prose".split())
_CUES = re.compile(
    r"©|\(c\) ?\d{4}|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in|advertisement|sponsored|click here|read more|share (?:this|on)|follow us",
    re.I,
)


@dataclass
class Block:
    text: str
    leaf: str
    path: tuple[int, ...]
    bad: bool
    good: bool
    head: bool
    linked: int
    names: tuple[int, int, int]
    kind: tuple[str, str]


@dataclass
class _Box:
    """An open container; names counts foreign, doubtful and good words of it and all around it."""

    tag: str
    number: int
    bad: bool
    good: bool
    head: bool
    names: tuple[int, int, int]


def _names(attrs: str) -> tuple[set[str], str, bool]:
    """(words of class and id, role, whether the element is hidden)."""
    words, role, hidden = set(), "", False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name in ("class", "id", "itemprop"):
            # names like with-sidebar or has-ads tell what else is on the page
            words |= {x.lower() for one in value.split() if not _MODIFIER.match(one) for x in _PARTS.findall(one)}
        elif name == "role":
            role = value.lower().strip()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
    return words, role, hidden


@cache
def _stop(name: str) -> re.Pattern:
    """Where an element ends whose inside is not looked at."""
    return re.compile(rf"</{name}\b[^>]*(?:>|\Z)" + (r"|<body\b" if name == "head" else ""), re.I)


def _told(words: set[str], above: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(n + bool(words & kind) for n, kind in zip(above, (_FOREIGN, _DOUBTFUL, _GOOD_NAMES), strict=True))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[_Box] = [_Box("", 0, False, False, False, (0, 0, 0))]
    parts: list[str] = []
    open_ended: set[str] = set()  # elements that no later tag closes
    linked, in_link, leaf, number, at, n = 0, 0, "", 0, 0, len(page)
    own: tuple[set[str], bool] = (set(), False)  # what the leaf's attributes say

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                out.append(Block(text, leaf, tuple(x.number for x in stack), top.bad or own[1], top.good, top.head, linked, _told(own[0], top.names), (top.tag, leaf)))
        linked = 0

    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            parts.append(page[at:])
            break
        if cut > at:
            piece = page[at:cut]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        m = _TAG.match(page, cut)
        if not m:
            parts.append("<")
            at = cut + 1
            continue
        at = m.end()
        if m["cdata"] is not None:
            parts.append(html.escape(m["cdata"], quote=False))
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end = name.lower(), (m["end"] or m["end2"]) == "/"
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in _RAW:
            if not end and not attrs.rstrip().endswith("/"):
                stop = None if name in open_ended else _stop(name).search(page, at)
                if not stop:
                    open_ended.add(name)
                if name == "head" and stop and stop[0].lower().startswith("<body"):
                    at = stop.start()
                elif stop:
                    at = stop.end()
                elif name in ("script", "style", "noscript", "template", "title", "textarea", "head"):
                    at = n
            parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if end else 1
            continue
        if name in _INLINE or name in _VOID and name != "hr":
            if name == "br":
                parts.append(" ")
            continue
        flush()
        in_link, own = 0, (set(), False)
        if name in _LEAVES:
            leaf = "" if end else name
            if name != "li" and name != "blockquote" and name != "address":
                if attrs and not end:
                    words, role, hidden = _names(attrs)
                    own = words, hidden or role in _BAD_ROLES
                continue
        else:  # a container ends what is open inside
            leaf = ""
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        if name == "li" and stack[-1].tag == "li":
            stack.pop()
        if name in _VOID or attrs.rstrip().endswith("/"):
            continue
        words, role, hidden = _names(attrs) if attrs else (set(), "", False)
        top = stack[-1]
        number += 1
        good = name in _GOOD_TAGS or role == "main" or role == "article"
        if top.good:  # the head of an article is not that of the page; its headings stay
            head, words = top.head or name == "header" or "header" in words, words - {"header"}
        else:
            head = top.head or name == "header" or "header" in words
        bad = hidden or name in _BAD_TAGS or role in _BAD_ROLES or (name == "header" and not top.good)
        if name == "body" or name == "html":
            bad, words = hidden, set()
        stack.append(_Box(name, number, top.bad or bad, top.good or good, head, _told(words, top.names)))
    flush()
    return out


#: What a block is described by, and the weights that a fit starts from and stays near to.
PRIOR = {
    "any": -1.0,
    "words": 0.7,
    "linked": -5.0,
    "ends like a sentence": 0.5,
    "inner punctuation": 0.3,
    "paragraph": 1.5,
    "heading": 1.5,
    "list item or cell": 0.0,
    "no leaf": -0.5,
    "cue": -4.0,
    "foreign names": -11.0,
    "doubtful names": -2.5,
    "good names": 1.5,
}
#: How many of them, from the first on, are about the block's shape; their sum is held within SHAPE.
_SHAPES = 10
SHAPE = 4.0
#: Fixed log-odds of what the markup says outright.
ARTICLE, OUTSIDE, ELSEWHERE, HEAD = 4.0, -5.0, -14.0, -10.0
#: Shares of neighbours with one label that capacities start from: in one container, in containers of one tag at one
#: depth (as list items are), one step apart in the tree, farther apart.
AGREEING = (0.95, 0.9, 0.7, 0.55)
PULL = 1.5


@dataclass
class CutModel:
    """Weights in the order of PRIOR, and capacities in the order of AGREEING."""

    weights: np.ndarray
    near: np.ndarray


def _capacities(agreeing: np.ndarray) -> np.ndarray:
    """Half the log-odds that neighbours agree, PULL at most."""
    return np.clip(0.5 * np.log(agreeing / (1 - agreeing)), 0.0, PULL)


DEFAULT = CutModel(np.array(list(PRIOR.values())), _capacities(np.array(AGREEING)))


def _described(block: Block) -> list[float]:
    text, leaf = block.text, block.leaf
    words = text.count(" ") + 1
    density = min(1.0, block.linked / len(text))
    return [
        1.0,
        min(5.0, math.log2(words)),
        density if density > 0.3 else 0.0,
        float(text[-1] in ".!?:;\"'»”"),
        min(4.0, math.log2(1 + text.count(". ") + text.count(", "))),
        float(leaf in ("p", "pre", "blockquote")),
        float(leaf in _HEADS),
        float(leaf in _CELLS),
        float(not leaf),
        float(words < 30 and _CUES.search(text) is not None),
        float(min(2, block.names[0])),
        float(min(2, block.names[1])),
        float(min(1, block.names[2])),
    ]


def content_scores(blocks: list[Block], model: CutModel = DEFAULT) -> list[float]:
    """Log-odds of content against boilerplate of each block by itself."""
    has_article = any(b.good and not b.bad and not b.names[0] for b in blocks)
    x = np.array([_described(b) for b in blocks])
    shape = np.clip(x[:, :_SHAPES] @ model.weights[:_SHAPES], -SHAPE, SHAPE)
    score = shape + x[:, _SHAPES:] @ model.weights[_SHAPES:]
    for i, b in enumerate(blocks):
        if b.bad:
            score[i] += ELSEWHERE
        elif has_article:
            score[i] += ARTICLE if b.good else OUTSIDE
        if b.head and b.leaf not in _HEADS:
            score[i] += HEAD
    return score.tolist()


def weak_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks that the markup puts inside an article, 0 for those it puts elsewhere, -1 if it does not say."""
    has_article = any(b.good and not b.bad for b in blocks)
    return [0 if b.bad else -1 if not has_article else int(b.good and not b.head) for b in blocks]


def fit_cut(pages: list[str], weight: float = 300.0, ridge: float = 20.0, neighbours: float = 20.0) -> CutModel:
    """A model fitted to the weak labels of some pages.

    All labelled blocks together weigh as much as `weight` observations, and a weight's distance from its
    prior is paid for by `ridge`; agreeing neighbours are counted on top of `neighbours` presumed ones.
    """
    x, y = [], []
    same, pairs = neighbours * np.array(AGREEING), np.full(len(AGREEING), neighbours)
    for page in pages:
        blocks = blocks_of(page)
        labels = weak_labels(blocks)
        known = [i for i, z in enumerate(labels) if z >= 0]
        x += [_described(blocks[i]) for i in known]
        y += [labels[i] for i in known]
        for i in range(1, len(blocks)):
            if labels[i] >= 0 and labels[i - 1] >= 0:
                d = _nearness(blocks[i - 1], blocks[i])
                pairs[d] += 1
                same[d] += labels[i] == labels[i - 1]
    prior = DEFAULT.weights
    if not x or min(y) == max(y):
        return DEFAULT
    x, y, w = np.array(x), np.array(y, float), prior.copy()
    share = weight / len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = share * (x.T @ (p - y)) + ridge * (w - prior)
        curve = share * (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return CutModel(w, _capacities(np.minimum(same / pairs, 0.999)))


def _nearness(a: Block, b: Block) -> int:
    """How neighbours lie to each other, in the order of AGREEING."""
    shared = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x != y:
            break
        shared += 1
    steps = len(a.path) + len(b.path) - 2 * shared
    if steps == 2 and len(a.path) == len(b.path) and a.kind == b.kind:
        return 1
    return (0, 2)[steps] if steps < 2 else 3


def _edges(blocks: list[Block], model: CutModel = DEFAULT) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and between a block and the last one of the same container."""
    out, last, near = [], {}, model.near.tolist()
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, near[_nearness(blocks[i - 1], block)]))
        before = last.get(block.path)
        if before is not None and before < i - 1:
            out.append((before, i, near[0] / 2))
        last[block.path] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost: positive scores are lost where a node is not content,
    negative ones where it is, and an edge's capacity where its ends differ. Ties go to boilerplate."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    own = list(scores)
    todo = deque(range(n))
    while todo:  # a node that outweighs all its edges has its label in every minimum cut
        i = todo.popleft()
        if label[i] is not None:
            continue
        pull = sum(near[i].values())
        if abs(own[i]) > pull or not near[i]:
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    seen: set[int] = set()
    for start in rest:
        if start in seen:
            continue
        part, queue = [start], [start]
        seen.add(start)
        while queue:
            for j in near[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    part.append(j)
                    queue.append(j)
        for i in _reached(part, own, near):
            label[i] = True
    return [bool(x) for x in label]


def _reached(part: list[int], own: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes of a component on the content side: those that the source reaches when the flow is maximal."""
    source, sink = -1, -2
    flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in part}
    flow[source], flow[sink] = {}, {}
    for i in part:
        if own[i] > 0:
            flow[source][i] = own[i]
            flow[i][source] = 0.0
        elif own[i] < 0:
            flow[i][sink] = -own[i]
            flow[sink][i] = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for y, c in flow[x].items():
                if c > 1e-9 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if sink not in level:
            return {x for x in level if x >= 0}
        ways = {x: list(flow[x]) for x in level}
        path = [source]
        while path:
            x = path[-1]
            if x == sink:
                push = min(flow[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    flow[a][b] -= push
                    flow[b][a] = flow[b].get(a, 0.0) + push
                path = [source]
                continue
            while ways[x]:
                y = ways[x][-1]
                if flow[x].get(y, 0.0) > 1e-9 and level.get(y) == level[x] + 1:
                    path.append(y)
                    break
                ways[x].pop()
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def main_text(page: str, model: CutModel = DEFAULT) -> tuple[str, int, int, int]:
    """(main text, number of blocks, of content blocks, of blocks that the cut labels unlike their own cost)."""
    blocks = blocks_of(page)
    if not blocks:
        return "", 0, 0, 0
    scores = content_scores(blocks, model)
    kept = minimum_cut(scores, _edges(blocks, model))
    lines = [b.text for b, keep in zip(blocks, kept, strict=True) if keep]
    return "\n".join(lines), len(blocks), len(lines), sum((s > 0) != keep for s, keep in zip(scores, kept, strict=True))


def fit_from_pages(df: DataFrame, html_col: str = "html", rows: int = 400, size: int = 1 << 18) -> CutModel:
    """A model of about `rows` of the pages, chosen by a hash of their text; pages over `size` bytes are not
    fitted on, nor are null ones."""
    pages = df.select(F.col(html_col).cast("string").alias("html")).where((F.octet_length("html") > 0) & (F.octet_length("html") <= size))
    share = min(1.0, rows / max(1, pages.count()))
    found = pages.where(F.pmod(F.xxhash64("html", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    return fit_cut(sorted(found["html"].to_pylist()))


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: CutModel | None = None) -> DataFrame:
    """One row for each row of df: `id`, `url`, `text`, `blocks`, `content_blocks`, `moved_blocks` (that the cut
    labels unlike their own cost). Without a model, one is fitted (fit_from_pages).

    Blocks are joined in page order by one line feed. Defined cases: a null or empty page, and one without
    content, has the empty text; unclosed and cut-off tags end where the page does; null ids and urls stay
    null; repeated rows give repeated rows; an empty table gives an empty table.
    """
    known = model or fit_from_pages(df, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "", known) for x in batch.column(2)]
            texts = strings([x[0].encode("utf-8", "replace") for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), texts, *(pa.array([x[i] for x in found], pa.int32()) for i in (1, 2, 3))],
                ["id", "url", "text", "blocks", "content_blocks", "moved_blocks"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "id bigint, url string, text string, blocks int, content_blocks int, moved_blocks int")
