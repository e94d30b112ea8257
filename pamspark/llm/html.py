"""Main text of HTML pages: boosted trees over DOM nodes and a hierarchical decoding.

A page becomes a tree of block elements (inline elements belong to the block around them). Each node has features of
its subtree (text, links, tags), its class, id and role tokens and those of its ancestors, its depth and its siblings.
Gradient-boosted trees, fitted on TRAIN_PAGES invented pages of many layouts whose article is known, give each node the
probability to be main text. Decoding chooses for each subtree, bottom-up, to keep it whole, to drop it whole or to
decide child by child, whichever is most likely; so no node is kept inside a dropped one or dropped inside a kept one.

Character references are decoded, white space within a block is one space, blocks are joined by two line ends.
Defined cases: a null or empty html and a page without main text give an empty text; broken or unclosed markup is read
as far as it goes: an element of DROP, iframe, noscript, title or textarea that nothing but its parent, the next of its kind or the
end of the page closes takes only the text up to the next tag with it; the rest of the page is script or style if that is not closed, as
in HTML; repeated rows get equal results; an empty table gives an empty result; other columns pass through,
those named like the results are replaced. Whole pages are read, in memory in proportion to one page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from pamspark.llm.common import blocks
from pamspark.llm.html_pages import Pages

TRAIN_PAGES, SEED = 600, 11
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
#: Tags of the HTML standard, and words that sites use in class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in "script style title textarea iframe noscript".split()}
#: Elements whose subtree is no text; of those in CLOSES a start tag also ends open ones.
DROP = set("svg select datalist optgroup option button object template annotation annotation-xml".split())
CLOSES = {"button": {"button"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "select": {"select"}}
BLOCK = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure "
            "figcaption nav aside header footer form fieldset address details summary center hr".split())
P_ENDS = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NEVER = {"form", "head", "fieldset"}
TAGS = [["article"], ["main"], ["section"], ["div"], ["p"], ["h1"], ["h2", "h3"], ["h4", "h5", "h6"], ["ul", "ol", "dl"], ["li", "dt", "dd"],
        ["nav"], ["aside"], ["header"], ["footer"], ["table", "tr", "tbody"], ["td", "th"], ["blockquote", "pre", "figure"]]
TOKENS = ["content article post entry story body text main prose", "nav navigation menu breadcrumb breadcrumbs topbar",
          "sidebar side rail widget related recommended aside recommend more", "comment comments reply replies discussion disqus respond",
          "ad ads advert advertisement sponsored promo sponsor banner", "footer copyright bottom legal", "header masthead logo head",
          "cookie consent gdpr notice popup modal newsletter subscribe alert signup", "share social tags tag meta byline"]
_WORDS = {w: i for i, line in enumerate(TOKENS) for w in line.split()}
_TAG_OF = {t: i for i, group in enumerate(TAGS) for t in group}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)"
                    r"(?P<attrs>(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|<[!?/][^>]*>|<[a-z!?/][^<>]*\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "own", "linked", "groups", "first", "last", "inside", "links", "count")

    def __init__(self, tag: str, parent: Node | None, groups: set[int]):
        self.tag, self.parent, self.groups = tag, parent, groups
        self.children: list[Node] = []
        self.own, self.linked = 0, 0


@dataclass(slots=True)
class Dropped:
    """An open element of DROP and what was read when it began; held is a count until a block inside it flushes the text."""
    tag: str
    depth: int
    nodes: int
    pieces: int
    held: int | list[str]
    own: int
    linked: int
    children: int
    anchors: int


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order, the first one the root, and the (node, text) pieces of the page."""
    root = Node("root", None, set())
    nodes, stack, pieces = [root], [root], []
    number = {id(root): 0}
    held: list[str] = []
    at, anchors, label = 0, 0, False
    drops: list[Dropped] = []
    unclosed: set[str] = set()

    def text(part: str) -> None:
        if part and not label:
            held.append(part)
            if anchors:
                stack[-1].linked += len(part)

    def flush() -> None:
        if held:
            for d in reversed(drops):
                if not isinstance(d.held, int):
                    break
                d.held = held[: d.held]
            words = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if words:
                stack[-1].own += len(words)
                pieces.append((number[id(stack[-1])], words))

    def raw_end(tag: str, start: int) -> int:
        """Where the raw text that begins at start ends, -1 if it is not closed."""
        if tag in unclosed:
            return -1
        found = RAW[tag].search(page, start)
        while found and not found[1] and tag in ("script", "style"):
            found = RAW[tag].search(page, found.end())
        if not found:
            unclosed.add(tag)
        return found.end() if found and found[1] else -1

    while m := MARKUP.search(page, at):
        text(page[at : m.start()])
        at, label = m.end(), False
        tag = (m["tag"] or "").lower()
        if tag in RAW and not m["end"] and not m["attrs"].endswith("/"):
            end = raw_end(tag, at)
            label = end < 0
            at = end if end >= 0 else len(page) if tag in ("script", "style") else at
            continue
        if tag in DROP:
            if m["end"]:
                i = next((i for i in range(len(drops) - 1, -1, -1) if drops[i].tag == tag), None)
                if i is not None:
                    d = drops[i]
                    del drops[i:], nodes[d.nodes :], pieces[d.pieces :], stack[d.depth :]
                    held[:] = held[: d.held] if isinstance(d.held, int) else d.held
                    stack[-1].own, stack[-1].linked, anchors = d.own, d.linked, d.anchors
                    del stack[-1].children[d.children :]
            elif not m["attrs"].endswith("/"):
                for i, d in enumerate(drops):
                    if d.tag in CLOSES.get(tag, ()):
                        del drops[i:]
                        break
                top = stack[-1]
                drops.append(Dropped(tag, len(stack), len(nodes), len(pieces), len(held), top.own, top.linked, len(top.children), anchors))
                label = True
            continue
        if tag == "br":
            held.append(" ")
        if not tag or tag in VOID and tag != "hr":
            continue
        if tag == "a":
            anchors = 0 if m["end"] else 1
        if tag not in BLOCK:
            continue
        flush()
        floor = drops[-1].depth - 1 if drops else 0
        if m["end"]:
            # no paragraph is ended from inside a dropped element, other elements are, and end it
            for depth in range(len(stack) - 1, floor if tag == "p" else 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            while drops and drops[-1].depth > len(stack):
                drops.pop()
            anchors = 0
            continue
        if tag in P_ENDS and any(n.tag == "p" for n in stack[floor + 1 :][-2:]):
            while stack[-1].tag != "p":
                stack.pop()
            stack.pop()
        ends = SAME_ENDS.get(tag)
        if ends:
            for depth in range(len(stack) - 1, floor, -1):
                if stack[depth].tag in ("ul", "ol", "dl", "table"):
                    break
                if stack[depth].tag in ends:
                    del stack[depth:]
                    break
        names = " ".join("".join(x) for x in ATTRIBUTE.findall(m["attrs"])) if "=" in m["attrs"] else ""
        node = Node(tag, stack[-1], {_WORDS[w] for w in re.split(r"[^a-z]+", names.lower()) if w in _WORDS})
        stack[-1].children.append(node)
        number[id(node)] = len(nodes)
        nodes.append(node)
        if tag != "hr":
            stack.append(node)
    text(page[at:])
    flush()
    return nodes, pieces


def node_features(nodes: list[Node]) -> np.ndarray:
    """A row of numbers for each node."""
    for n in reversed(nodes):
        n.inside = n.own + sum(c.inside for c in n.children)
        n.links = n.linked + sum(c.links for c in n.children)
        n.count = 1 + sum(c.count for c in n.children)
    whole, out, before = max(nodes[0].inside, 1), [], 0
    depth: dict[int, int] = {}
    above: dict[int, set[int]] = {}
    tags_above: dict[int, set[int]] = {}
    place: dict[int, tuple[int, int, int]] = {}
    for n in nodes:
        up = n.parent
        depth[id(n)] = depth[id(up)] + 1 if up else 0
        above[id(n)] = above[id(up)] | up.groups if up else set()
        tags_above[id(n)] = tags_above[id(up)] | {_TAG_OF.get(up.tag, -1)} if up else set()
        if n.children:
            same: dict[str, int] = {}
            for c in n.children:
                same[c.tag] = same.get(c.tag, 0) + 1
            for i, c in enumerate(n.children):
                place[id(c)] = (i, len(n.children), same[c.tag])
        index, siblings, alike = place.get(id(n), (0, 1, 1))
        row = [0.0] * (len(TAGS) * 2 + len(TOKENS) * 2)
        if n.tag in _TAG_OF:
            row[_TAG_OF[n.tag]] = 1.0
        for k in tags_above[id(n)]:
            if k >= 0:
                row[len(TAGS) + k] = 1.0
        for k in n.groups:
            row[2 * len(TAGS) + k] = 1.0
        for k in above[id(n)]:
            row[2 * len(TAGS) + len(TOKENS) + k] = 1.0
        row += [np.log1p(n.inside), n.inside / whole, n.links / max(n.inside, 1), n.inside / n.count, n.own / max(n.inside, 1), depth[id(n)],
                index / siblings, siblings, alike / siblings, before / whole, n.inside / max(up.inside, 1) if up else 1.0, len(n.children)]
        out.append(row)
        before += n.own
    return np.array(out)


class Trees:
    """Gradient-boosted regression trees for a yes-or-no label, grown level by level over binned numbers."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            feature, cut, value = self._grow(binned, y - p, p * (1 - p))
            self.trees.append((feature, cut, value))
            score += RATE * value[self._leaf(binned, feature, cut)]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int16)

    @staticmethod
    def _leaf(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (binned[np.arange(len(binned)), feature[at]] > cut[at])
        return at - (2**DEPTH - 1)

    @staticmethod
    def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**DEPTH - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        at = np.zeros(len(g), np.int64)
        for depth in range(DEPTH):
            low, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-6)
            for f in range(binned.shape[1]):
                cell = (at - low) * (BINS + 1) + binned[:, f]
                gs = np.bincount(cell, g, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(cell, h, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                top = gain[:, :-1].argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best + 1e-9
                best = np.where(better, value, best)
                feature[low : low + width] = np.where(better, f, feature[low : low + width])
                cut[low : low + width] = np.where(better, top, cut[low : low + width])
            at = 2 * at + 1 + (binned[np.arange(len(g)), feature[at]] > cut[at])
        leaf = at - inner
        return feature, cut, np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        binned, score = self._bin(x), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            score += RATE * value[self._leaf(binned, feature, cut)]
        return 1 / (1 + np.exp(-np.clip(score, -12, 12)))


@lru_cache
def trained(count: int = TRAIN_PAGES, seed: int = SEED) -> Trees:
    """Trees fitted on invented pages: a node is main text if most text of its subtree is."""
    x, y, source = [], [], Pages(seed)
    for _ in range(count):
        page, main = source.page()
        nodes, pieces = parse(page)
        wanted, good = {" ".join(b.split()) for b in main}, np.zeros(len(nodes))
        number = {id(n): i for i, n in enumerate(nodes)}
        for i, words in pieces:
            if words in wanted:
                good[i] += len(words)
        for n in reversed(nodes):
            if n.parent:
                good[number[id(n.parent)]] += good[number[id(n)]]
        rows = node_features(nodes)
        some = np.array([n.inside > 0 for n in nodes])
        x.append(rows[some])
        y.append((good / np.maximum([n.inside for n in nodes], 1) > 0.5)[some])
    return Trees(np.concatenate(x), np.concatenate(y).astype(float))


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most likely choice in which every node below a kept one is kept and none below a dropped one."""
    number = {id(n): i for i, n in enumerate(nodes)}
    keep, drop, best, choice = (np.zeros(len(nodes)) for _ in range(4))
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        below = [number[id(c)] for c in n.children]
        weight = (0.5 + np.log1p(n.own) if n.own else 0.5) * (n.inside > 0)
        keep[i] = weight * np.log(p[i]) + sum(keep[c] for c in below)
        drop[i] = weight * np.log(1 - p[i]) + sum(drop[c] for c in below)
        if n.tag in NEVER:
            keep[i] = -np.inf
        # a node that is split keeps its own text only by its own odds
        split = sum(best[c] for c in below) + (weight * max(np.log(p[i]), np.log(1 - p[i])) if n.own else 0.0) if below else -np.inf
        options = (drop[i], keep[i], split)
        choice[i] = int(np.argmax(options))
        best[i] = max(options)
    state = np.zeros(len(nodes), bool)
    fixed: dict[int, float] = {}
    for i, n in enumerate(nodes):
        up = fixed.get(number[id(n.parent)], 2) if n.parent else 2
        fixed[i] = choice[i] if up == 2 else up
        state[i] = fixed[i] == 1 or fixed[i] == 2 and n.own > 0 and p[i] > 0.5 and n.tag not in NEVER
    return state


def main_text(page: str | None, trees: Trees) -> str:
    nodes, pieces = parse(page or "")
    if not pieces:
        return ""
    p = np.clip(trees(node_features(nodes)), 1e-4, 1 - 1e-4)
    kept = decode(nodes, p)
    return "\n\n".join(words for i, words in pieces if kept[i])


def extract(pages: DataFrame, html: str = "html", trees: Trees | None = None) -> DataFrame:
    """pages with text and n_chars in place of html."""
    held = pages.sparkSession.sparkContext.broadcast(trees or trained())
    rest = [c for c in pages.columns if c not in ("text", "n_chars", html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, html):
            texts = many(batch.column(html).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*rest, "text", "n_chars"])

    fields = [f for f in pages.schema.fields if f.name in rest]
    return pages.select(*rest, html).mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def many(pages: list[str | None], trees: Trees, group: int = 200) -> list[str]:
    """Main texts of many pages; the nodes of a group of pages go through the trees together."""
    out = []
    for at in range(0, len(pages), group):
        parsed = [parse(p or "") for p in pages[at : at + group]]
        rows = [node_features(nodes) for nodes, _ in parsed]
        p = np.clip(trees(np.concatenate(rows)), 1e-4, 1 - 1e-4)
        ends = np.cumsum([len(r) for r in rows])
        for (nodes, pieces), part in zip(parsed, np.split(p, ends[:-1])):
            kept = decode(nodes, part)
            out.append("\n\n".join(words for i, words in pieces if kept[i]))
    return out
