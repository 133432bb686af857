"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks: runs of text between the tags that begin or end one. A logistic classifier over a block's
surroundings and its own look, fitted to pages whose article is marked, gives two costs, which are the capacities of its edges to the terminals "content" and
"boilerplate". Blocks that follow each other, and the next block of the same parent, are joined by smoothness edges,
the stronger the more of their ancestors they share. The minimum cut, found by maximum flow, labels the blocks.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_chunks

# What HTML elements mean for blocks.
SILENT = {"script", "style", "noscript", "template", "head", "title", "iframe", "canvas", "audio", "video", "select", "textarea", "option", "datalist", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPH_ENDS = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "search", "fieldset", "label"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog"}
# Words that name what is no article in classes and ids, and words that may stand beside them.
AWAY_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion promoted banner nav navbar navigation menu sidebar rail footer masthead topbar "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notification alert popup modal overlay comment comments commentlist disqus replies reply respond discussion social share sharing "
    "related recommended recommendations newsletter subscribe subscription signup login pagination pager widget toolbar copyright skip outbrain taboola tags byline form search".split()
)
HEADER_WORDS = {"header", "head", "top"}
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
BESIDE = set("site page web global main primary secondary top bottom left right side inner outer mobile desktop wrapper wrap container box block area section list item items links link bar content text widget module unit slot col column row fixed sticky article post entry blog to policy thread".split())

ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# The classifier: what speaks for content (positive) and against it. Fitting starts from these and stays near them where
# pages say nothing; the last two are the marks of an article, which tell the labels and so are no part of the fit.
WEIGHTS = {"base": -0.25, "away": -6.0, "header": -5.0, "links": -1.5, "long": 1.5, "sentence": 0.5, "short": -1.5, "heading": 0.75, "inside": 2.5, "main": 1.0}
MARKS = 2
FIT_PAGES, FIT_BLOCKS = 1000, 200  # about so many pages, and of each the first blocks, that weights are fitted to
TRUST = 0.02  # of the pull towards WEIGHTS, a labelled block
NEAR, SIBLING, SEAM = 2.2, 0.75, 0.4


class Node:
    """An open element: its place in the tree is that of its parent and a number of its own."""

    __slots__ = ("depth", "parent")

    def __init__(self, parent: Node | None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 1


def shared_depth(a: Node | None, b: Node | None) -> int:
    """How many ancestors two elements share, themselves included."""
    while a is not b:
        if a is None or b is not None and b.depth > a.depth:
            b = b.parent
        else:
            a = a.parent
    return a.depth if a else 0


def _words(names: str) -> list[list[str]]:
    """The words of each class or id: 'site-Footer2 promoBox' is [[site, footer], [promo, box]]."""
    return [[w for w in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w] for token in names.split()]


def _is_away(words: list[list[str]]) -> bool:
    """A name counts only if all its words do: 'content-with-sidebar' and 'side-effects' name no boilerplate."""
    return any(any(w in AWAY_WORDS for w in one) and all(w in AWAY_WORDS or w in BESIDE for w in one) for one in words)


class Tags:
    """The ends of a page's tags: the next > that no quotes hold, or the next > at all where quotes are not closed."""

    def __init__(self, page: str):
        self.page, self.open_ended = page, set()  # quotes of which no other one follows

    def end(self, at: int) -> tuple[int, int]:
        """(where the attributes from `at` on end, where the tag ends)."""
        pos = at
        while True:
            m = STOP.search(self.page, pos)
            if not m:
                return len(self.page), len(self.page)
            if m[0] == ">":
                return m.start(), m.end()
            close = -1 if m[0] in self.open_ended else self.page.find(m[0], m.end())
            if close < 0:
                self.open_ended.add(m[0])
                stop = self.page.find(">", m.end())
                return (stop, stop + 1) if stop >= 0 else (len(self.page), len(self.page))
            pos = close + 1


class Block:
    __slots__ = ("linked", "name", "node", "text", "what")

    def __init__(self, text: str, linked: int, node: Node | None, what: tuple[bool, bool, bool, bool], name: str):
        self.text, self.linked, self.node, self.what, self.name = text, linked, node, what, name


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that hold visible text, in page order."""
    out: list[Block] = []
    open_: list[tuple[str, Node, tuple[bool, bool, bool, bool]]] = []  # name, node, (away, header, inside, main)
    count: dict[str, int] = {}  # open elements of each name
    endless: set[str] = set()  # names with no end tag further on
    parts: list[tuple[str, bool]] = []
    plain = (False, False, False, False)
    linked, at, n, tags = 0, 0, len(page), Tags(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                inked = sum(len(t) for t, a in parts if a)
                name, node, what = open_[-1] if open_ else ("", None, plain)
                out.append(Block(text, min(inked, len(text)), node, what, name))
            parts.clear()

    def pop() -> None:
        count[open_.pop()[0]] -= 1

    def close(name: str) -> None:
        if count.get(name):
            while open_[-1][0] != name:
                pop()
            pop()

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            parts.append((page[at:start], linked > 0))
        if start == n:
            break
        m = ASIDE.match(page, start)
        if m:
            at = m.end()
            continue
        m = TAG.match(page, start)
        if not m:
            parts.append(("<", linked > 0))
            at = start + 1
            continue
        stop, at = tags.end(m.end())
        name, closing, given = m[2].lower(), bool(m[1]), page[m.end() : stop]
        if name in SILENT:
            if not closing and not given.rstrip().endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(name)
                    if name not in ("head", "option", "map"):
                        at = n
            if name not in ("option", "map"):
                flush()
            continue
        if name == "a":
            linked = 0 if closing else 1
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        raw = "" if closing else given
        if name in BLOCK:
            flush()
        elif closing or name in VOID or not ("hidden" in raw or "class" in raw or "id" in raw or "role" in raw or "style" in raw or name in AWAY):
            if closing and count.get(name):  # only elements that take their text away are open beside blocks
                flush()
                close(name)
            continue
        if closing:
            close(name)
            continue
        if name in VOID:
            continue
        if name in PARAGRAPH_ENDS and open_ and open_[-1][0] == "p":
            pop()
        if name in ("li", "dd", "dt", "td", "th", "tr", "option") and open_ and open_[-1][0] == name:
            pop()
        away, header, inside, main = open_[-1][2] if open_ else plain
        a = _attributes(raw)
        words = _words(f"{a.get('class', '')} {a.get('id', '')}")
        was = away
        if name not in ("html", "body"):
            away = away or name in AWAY or a.get("role", "").lower() in AWAY_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
            away = away or "display:none" in a.get("style", "").replace(" ", "").lower()
            away = away or name not in ("article", "main") and _is_away(words)
            header = header or ((name == "header" or any(set(w) & HEADER_WORDS and set(w) <= HEADER_WORDS | BESIDE for w in words)) and not inside)
            inside = inside or name in ("article", "main") or a.get("role", "").lower() in ("main", "article")
            main = main or any(set(w) & MAIN_WORDS for w in words)
        if name in BLOCK or away and not was:
            if name not in BLOCK:
                flush()
            open_.append((name, Node(open_[-1][1] if open_ else None), (away, header, inside, main)))
            count[name] = count.get(name, 0) + 1
    flush()
    return out


def features(b: Block) -> list[float]:
    """What the classifier sees of a block, in the order of WEIGHTS."""
    away, header, inside, main = b.what
    words = b.text.count(" ") + 1
    return [1.0, away, header, b.linked / len(b.text), min(words / 25, 2), b.text[-1] in ".!?…", words < 4, b.name in HEADINGS, inside, main]


def preference(b: Block, weights=tuple(WEIGHTS.values())) -> float:
    """How strongly the classifier takes a block for content (negative: for boilerplate)."""
    return sum(w * float(x) for w, x in zip(weights, features(b)))


def fitted(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a logistic classifier of blocks (features without the marks; 1: content) that stays near WEIGHTS.

    Newton's method on the log-likelihood less half the squared distance from WEIGHTS, TRUST of it for each block, so
    that what many pages agree on moves the weights, and without pages they are WEIGHTS.
    """
    prior = np.array(list(WEIGHTS.values()))
    w, pull = prior[:-MARKS].copy(), TRUST * max(len(x), 1)
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - prior[:-MARKS]))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [*w.tolist(), *prior[-MARKS:].tolist()]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: next block, the stronger the nearer in the tree, and next one of the same parent and name.

    Between blocks that differ in whether their names speak against them, an edge has SEAM of its strength.
    """
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            p, q = blocks[i - 1].node, b.node
            deep = max(p.depth if p else 0, q.depth if q else 0)
            seam = SEAM if blocks[i - 1].what[:2] != b.what[:2] else 1.0
            out.append((i - 1, i, seam * NEAR * ((shared_depth(p, q) + 1) / (deep + 1)) ** 2))
        kin = (b.node.parent if b.node else None, b.name)
        if kin in last and last[kin] < i - 1:
            out.append((last[kin], i, SIBLING))
        last[kin] = i
    return out


def minimum_cut(prefer: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the side of content in the cut of least capacity (of equal ones, the smaller side).

    Nodes whose own preference outweighs all their edges are settled first and pass their edges on to their
    neighbours as preferences, which is exact; the rest is solved by augmenting along shortest paths.
    """
    n = len(prefer)
    prefer = list(prefer)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(prefer[i]) <= sum(near[i].values()):
            continue
        label[i] = prefer[i] > 0
        for j, c in near[i].items():
            prefer[j] += c if label[i] else -c
            del near[j][i]
            queue.append(j)
        near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, _flow(left, prefer, near)):
            label[i] = side
    return [bool(x) for x in label]


def _flow(nodes: list[int], prefer: list[float], near: list[dict[int, float]]) -> list[bool]:
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        room[i] = dict(near[i])
    for i in nodes:
        if prefer[i] > 0:
            room[source][i], room[i][source] = prefer[i], 0.0
        elif prefer[i] < 0:
            room[i][sink], room[sink][i] = -prefer[i], 0.0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [i in came for i in nodes]
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] += push


def main_text(page: str, weights=tuple(WEIGHTS.values())) -> str:
    blocks = blocks_of(page)
    kept = minimum_cut([preference(b, weights) for b in blocks], edges_of(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features without the marks, and labels, of the blocks of pages that mark an article and have more than it."""
    for batch, col in text_chunks(batches, "html"):
        rows = []
        for page in col.to_pylist():
            blocks = blocks_of(page)
            inside = [b.what[2] for b in blocks]
            if any(inside) and not all(inside):
                rows += [[*map(float, features(b)[:-MARKS]), float(b.what[2] and not b.what[0])] for b in blocks[:FIT_BLOCKS]]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])


def fit_weights(pages: DataFrame) -> list[float]:
    """Weights fitted to the pages that mark their article among about FIT_PAGES chosen by a hash of page_id; without any, WEIGHTS.

    Of rows that repeat a page_id the first page in order counts, so that the sample has its size whatever is repeated.
    """
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(max(pages.select("page_id").count(), 1))) < FIT_PAGES)
    marked = some.where(F.rlike("html", F.lit("(?i)<(article|main)[\\s>]"))).groupBy("page_id").agg(F.min("html").alias("html"))
    rows = [r["x"] for r in marked.select("html").mapInArrow(_labelled, "x array<double>").collect()]
    rows = sorted(map(tuple, rows))  # sums do not depend on the order in which tasks end
    if not rows:
        return list(WEIGHTS.values())
    x = np.array(rows)
    return fitted(x[:, :-1], x[:, -1])


def _extract(weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_chunks(batches, "html"):
            texts = [main_text(page, weights) for page in col.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (blocks of content joined by an empty line) and n_chars (code points).

    pages needs page_id, url and html; other columns are ignored. A null, empty or tag-only page has an empty text;
    repeated rows are each extracted; broken markup is read as far as it goes; nothing is capped. The classifier's
    weights are fitted to pages that mark their article (see fit_weights), which pages without marks gain from.
    """
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_extract(fit_weights(src)), "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
