"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks at block-level tags. The nodes of its graph are
the blocks and those elements around them that name a part of the page (by tag
or by class, id or role). Terminal capacities are costs:

- a block's are the log-odds of a logistic classifier over its text alone
  (share of link text, length, sentence marks, heading, list item), trained on
  a bounded sample of the pages: blocks in named parts are its examples;
- a named part's are large, and as large as its blocks are many.

Smoothness edges join a block to the innermost named part around it, a part to
the part around that, neighbouring blocks with a weight that falls with the
steps between them in the element tree, and blocks of one parent. Maximum flow
separates content from boilerplate; so a short or link-filled paragraph amid an
article stays, prose in a menu or among reader comments goes, and parts
with doubtful names, and pages without named parts, are settled by what is
around and in them.

Defined results: a null or empty page, or one without text, has the empty
text; broken markup is read as browsers do in the simple cases (unclosed
elements end with their parents, a cut-off tag is dropped); a block whose cuts
cost alike is boilerplate; nothing is capped, and time is in proportion to the
page for all but graphs of doubtful blocks only; repeated rows are extracted
alike; an empty table gives no rows, and untrained weights where no sampled
page has examples of both kinds; null ids and urls are kept; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and page-part words.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template title textarea svg math object iframe select button".split())
RAW = ("script", "style", "textarea", "title")
BAD_TAGS = frozenset("nav footer aside form menu header dialog".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter pager pagination popup promo promotion related replies respond sidebar signup social sponsor sponsored sponsors subscribe toolbar widget".split())
#: Words that say what a name is made of, not what it is for: in "related-posts" and "ad-slot-1" the word before counts.
CONTAINER_WORDS = frozenset("area bar block body bottom box button buttons col column container content count form group header heading inner item items layout left link links list main outer panel post posts row right section site slot strip text title top trail unit wrap wrapper zone".split())
DOUBTFUL_WORDS = frozenset("login notice promoted rail reader reply search share sharing tags".split())
# Prior weights of the classifier: positive speaks for content.
FEATURES = ("bias", "links", "long", "marks", "heading", "item")
PRIOR = np.array([-1.0, -4.0, 2.0, 0.8, 0.5, -0.5])
#: How far training may move the weights; the largest log-odds of a block.
HOLD, MOST = 0.02, 2.5
#: Capacities: of a named part per block, of a doubtful one; from a block to either, and from part to part.
PART, DOUBT, IN_PART, IN_DOUBT, NESTED = 7.0, 1.5, 5.0, 2.0, 1.0
NEAR, SIBLING = 1.5, 0.25
#: Pages that the classifier is trained on at most.
SAMPLE = 1000

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
#: On the page itself, since lower-casing may lengthen it; a title ends at any closing tag.
_RAW_END = {tag: re.compile("</" if tag == "title" else f"</{tag}", re.A | re.I) for tag in RAW}
_ARTICLE = re.compile(r"<article[\s>/]", re.A | re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.!?;,:]")


class Block:
    """A run of text: its link characters, its element's tag and parent, the named part around it, and steps from the block before."""

    __slots__ = ("links", "parent", "part", "steps", "tag", "text")

    def __init__(self, text: str, links: int, tag: str, parent: int, part: int, steps: int):
        self.text, self.links, self.tag, self.parent, self.part, self.steps = text, links, tag, parent, part, steps


def _named(attributes: str) -> tuple[set[str], set[str]]:
    """What an element's class, id and role say that it is, and all words in them.

    A name is what its last word says that is no container: "site-footer" is a footer, but "widget-theory" a theory and
    "related-work" work. Names like with-sidebar tell of a part elsewhere.
    """
    heads: set[str] = set()
    every: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in "".join(values).lower().split():
                if token.startswith(("with-", "has-", "no-")):
                    continue
                words = _WORD.findall(token)
                every.update(words)
                while len(words) > 1 and words[-1] in CONTAINER_WORDS:
                    words.pop()
                heads.update(words[-1:])
    return heads, every


def blocks(html: str) -> tuple[list[Block], list[tuple[float, int]]]:
    """The page's text blocks in order, and its named parts: 1 for content, -1 for boilerplate, -0.5 for doubt, and the part around."""
    out: list[Block] = []
    parts: list[tuple[float, int]] = []
    stack: list[tuple[int, str, int]] = []  # serial number, tag, innermost named part
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    articles = len(_ARTICLE.findall(html))
    serial = at = links = in_link = silent = depth = 0
    low = 0  # the stack's least height since the last block
    bad = 0  # open elements that are boilerplate by tag

    def flush() -> None:
        nonlocal links, low, depth
        text = _SPACE.sub(" ", unescape("".join(pieces))).strip()
        if text:
            out.append(Block(text, min(links, len(text)), stack[-1][1] if stack else "", stack[-2][0] if len(stack) > 1 else 0, stack[-1][2] if stack else -1, len(stack) + depth - 2 * low))
            low = depth = len(stack)
        pieces.clear()
        links = 0

    def close() -> str:
        nonlocal in_link, silent, low, bad
        _, tag, _ = stack.pop()
        opened[tag] -= 1
        in_link -= tag == "a"
        silent -= tag in SILENT
        bad -= tag in BAD_TAGS and tag != "header"
        low = min(low, len(stack))
        return tag

    while at < len(html):
        start = html.find("<", at)
        m = _TAG.match(html, start) if start >= 0 else None
        end = len(html) if start < 0 else start if m else start + 1
        if end > at and not silent:
            pieces.append(html[at:end])
            if in_link:
                links += len(html[at:end].strip())
        if m is None:
            at = end
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        is_block = tag in BLOCKS
        if is_block:
            flush()
        elif tag in ("br", "wbr"):
            pieces.append(" ")
        if m[1]:
            if opened[tag] > 0:
                while close() != tag:
                    pass
            continue
        if tag in VOID or m[3].endswith("/") and not is_block:
            continue
        if is_block:  # an open paragraph ends; so do a list item and a cell before their like
            while stack and (stack[-1][1] == "p" or stack[-1][1] not in BLOCKS and opened["p"] > 0 or stack[-1][1] == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                close()
        if tag in RAW:
            ending = _RAW_END[tag].search(html, at)
            at = ending.start() if ending else len(html)
            shut = html.find(">", at)
            at = len(html) if shut < 0 else shut + 1
            continue
        if tag == "body":
            for _, t, _ in stack:
                silent -= t in SILENT
                opened[t] -= t != "html"
            stack[:] = [s for s in stack if s[1] == "html"]
            low = min(low, len(stack))
        serial += 1
        around = stack[-1][2] if stack else -1
        heads, words = _named(m[3]) if "=" in m[3] and tag not in ("body", "html") else (set(), set())
        kind = 0.0
        if tag in GOOD_TAGS and not bad and (tag == "main" or articles == 1 or around < 0 or parts[around][0] > 0):
            kind = 1.0
        elif tag in BAD_TAGS and not (tag == "header" and opened["article"] + opened["main"] > 0) or heads & BAD_WORDS:
            kind = -1.0
        elif words & (BAD_WORDS | DOUBTFUL_WORDS):
            kind = -0.5
        if kind:
            parts.append((kind, around))
            around = len(parts) - 1
        bad += tag in BAD_TAGS and tag != "header"
        stack.append((serial, tag, around))
        opened[tag] += 1
        in_link += tag == "a"
        silent += tag in SILENT
    flush()
    return out, parts


def features(page: list[Block]) -> np.ndarray:
    return np.array([[1.0, b.links / len(b.text), min(1.0, len(b.text) / 120), bool(_MARKS.search(b.text)), b.tag in ("h1", "h2", "h3"), b.tag in ("li", "dt", "dd")] for b in page], float).reshape(len(page), len(FEATURES))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method; both classes weigh alike, and weights are held near their priors."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + HOLD * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def graph(page: list[Block], parts: list[tuple[float, int]], weights: np.ndarray) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Terminal capacities (to the source if positive, to the sink if negative) of blocks and named parts, and the edges between them."""
    n = len(page)
    terminals = np.clip(features(page) @ weights, -MOST, MOST).tolist()
    held = Counter(b.part for b in page)
    terminals += [kind * PART * max(1, held[i]) if abs(kind) == 1 else -DOUBT for i, (kind, _) in enumerate(parts)]
    between: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def join(i: int, j: int, c: float) -> None:
        between[i, j] = between.get((i, j), 0.0) + c

    for i, b in enumerate(page):
        if i:
            join(i - 1, i, NEAR / (1 + b.steps))
        if b.parent in last:
            join(last[b.parent], i, SIBLING)
        last[b.parent] = i
        if b.part >= 0:
            join(i, n + b.part, IN_PART if abs(parts[b.part][0]) == 1 else IN_DOUBT)
    for k, (_, around) in enumerate(parts):
        if around >= 0:
            join(n + around, n + k, NESTED)
    return terminals, between


def minimum_cut(scores: list[float], between: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source's side: capacities to the source are positive scores, to the sink negative ones.

    A node whose terminal outweighs all its edges lies on that side in every
    minimum cut; it is taken out and its edges go to its neighbours' terminals.
    What is left is cut by maximum flow along shortest paths, level by level.
    """
    rest, edges = list(scores), [dict() for _ in scores]
    for (i, j), c in between.items():
        edges[i][j] = edges[j][i] = edges[i].get(j, 0.0) + c
    load = [sum(e.values()) for e in edges]
    side: list[bool | None] = [None] * len(rest)
    queue = deque(range(len(rest)))
    while queue:
        i = queue.popleft()
        if side[i] is None and (rest[i] > load[i] + 1e-9 or -rest[i] >= load[i] - 1e-9):
            side[i] = rest[i] > load[i] + 1e-9
            for j, c in edges[i].items():
                rest[j] += c if side[i] else -c
                load[j] -= c
                del edges[j][i]
                queue.append(j)
            edges[i] = {}
    open_ = [i for i, s in enumerate(side) if s is None]
    if open_:
        _flow(rest, edges, open_)
        seen = deque(i for i in open_ if rest[i] > 1e-9)
        for i in seen:
            side[i] = True
        while seen:
            for j, c in edges[seen.popleft()].items():
                if c > 1e-9 and side[j] is None:
                    side[j] = True
                    seen.append(j)
    return [bool(s) for s in side]


def _flow(rest: list[float], edges: list[dict[int, float]], nodes: list[int]) -> None:
    """Sends as much as fits from positive to negative terminals; rest and edges become what is left of the capacities."""
    while True:
        level = {i: 0 for i in nodes if rest[i] > 1e-9}
        queue, reached = deque(level), False
        while queue:
            i = queue.popleft()
            reached |= rest[i] < -1e-9
            for j, c in edges[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return
        ways = {i: list(edges[i]) for i in level}
        for start in [i for i, at in level.items() if not at]:
            path = [start]
            while path and rest[start] > 1e-9:
                i = path[-1]
                if rest[i] < -1e-9:
                    push = min(rest[start], -rest[i], *(edges[a][b] for a, b in zip(path, path[1:], strict=False)))
                    rest[start] -= push
                    rest[i] += push
                    cut = len(path)
                    for k in range(len(path) - 1, 0, -1):
                        a, b = path[k - 1], path[k]
                        edges[a][b] -= push
                        edges[b][a] += push
                        if edges[a][b] <= 1e-9:
                            cut = k
                    del path[cut:]
                    continue
                while ways[i] and not (edges[i][ways[i][-1]] > 1e-9 and level.get(ways[i][-1]) == level[i] + 1):
                    ways[i].pop()
                if ways[i]:
                    path.append(ways[i][-1])
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def labelled(html: str | None, weights: np.ndarray = PRIOR) -> tuple[str, int, int, int]:
    """The main text, the number of blocks, of those on the other side of the cut than their classifier's, and than their innermost named part's."""
    page, parts = blocks(html or "")
    terminals, between = graph(page, parts, weights)
    keep = minimum_cut(terminals, between)[: len(page)]
    apart = sum(b.part >= 0 and (parts[b.part][0] > 0) != k for b, k in zip(page, keep, strict=True))
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k), len(page), sum((t > 0) != k for t, k in zip(terminals, keep, strict=False)), apart


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    return labelled(html, weights)[0]


def train(pages: DataFrame, *, html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights from at most `sample` pages (by hash of the page), of which blocks in named parts are the examples."""
    place = F.xxhash64(html_col).cast("double") / float(1 << 64) + 0.5
    given = pages.select(F.col(html_col).alias("html"), place.alias("place")).filter("html is not null")
    n = given.count()
    picked = given.filter(F.col("place") < min(1.0, 1.5 * sample / max(n, 1))).orderBy("place").limit(sample)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [], []
            for h in batch.column("html"):
                page, parts = blocks(h.as_py())
                page = [b for b in page if b.part >= 0 and abs(parts[b.part][0]) == 1]
                rows.append(features(page))
                marks += [int(parts[b.part][0] > 0) for b in page]
            x = np.concatenate(rows) if rows else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int32()), *(pa.array(c) for c in x.T)], names=["y", *FEATURES])

    # Six numbers for every block of the sampled pages go to the driver.
    found = picked.select("html").mapInArrow(examples, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    return fit(found[list(FEATURES)].to_numpy(float), found["y"].to_numpy(float))


def _rows(weights: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, *counts = zip(*(labelled(h.as_py(), weights) for h in batch.column("html")), strict=True) if batch.num_rows else ((), (), (), ())
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *columns], names=["id", "url", "text", "n_chars", "n_blocks", "n_changed", "n_apart"])

    return rows


def extract(pages: DataFrame, weights: np.ndarray = PRIOR, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: its id, url, text, n_chars, n_blocks and n_changed and n_apart (blocks that the cut labels otherwise than the classifier alone, and than the part named next around them)."""
    id_type = pages.schema[id_col].dataType.simpleString()
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return given.mapInArrow(_rows(weights), f"id {id_type}, url string, text string, n_chars bigint, n_blocks bigint, n_changed bigint, n_apart bigint").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
