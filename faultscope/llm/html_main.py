"""Main text of web pages: boosted trees over the nodes of a page, decoded as a tree.

A page becomes a tree of its block elements. Gradient-boosted trees give each node the
log odds of holding main text from the density of its subtree, its own and its
ancestors' attribute tokens, its depth and its siblings. Decoding chooses the subtree
that contains the root and has the largest sum of log odds: a node is kept only below
kept nodes, and a node whose whole subtree counts against it is dropped with all of it,
so no descendant contradicts an ancestor.

The trees are fitted on a bounded sample of pages. Pages that mark their article say
which nodes are main text; from their paragraphs further pages of other layouts (menus,
sidebars, notices, adverts, forms, reader comments, articles without article elements)
are composed, whose right answer is known by construction.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import slices
from faultscope.llm.dom import Node, blocks_of, features, read_page
from faultscope.staging import stage

#: Pages that the trees are fitted on, at most about so many, and layouts composed of each.
SAMPLE, LAYOUTS = 300, 4
TREES, DEPTH, BINS, RATE, LEAF = 60, 4, 24, 0.2, 20.0
STEP = 1 << 20
_DROP_TAGS = {"nav", "footer", "aside", "form"}
_DROP_TOKENS = {"ad", "ads", "advert", "menu", "nav", "sidebar", "comment", "comments", "cookie", "consent", "newsletter", "sponsored", "share", "related", "footer", "navbar", "breadcrumbs", "promo"}


# ------------------------------------------------------------------ training pages


def seed_labels(nodes: list[Node]) -> np.ndarray | None:
    """Which nodes hold main text on a page that marks its article; None if it doesn't."""
    roots = [k for k, x in enumerate(nodes) if x.marked or x.tag in ("article", "main")]
    if not roots:
        return None
    by_mark = any(nodes[k].marked for k in roots)
    keep = np.zeros(len(nodes), bool)
    inside = np.zeros(len(nodes), bool)
    filled = np.zeros(len(nodes), bool)
    for k, x in enumerate(nodes):
        dropped = x.tag in _DROP_TAGS or _DROP_TOKENS.intersection(x.tokens)
        below = k > 0 and inside[x.parent]
        inside[k] = x.marked or below if by_mark else (x.tag in ("article", "main") or below) and not dropped
        filled[k] = inside[k] and x.text > 0
    for k in range(len(nodes) - 1, -1, -1):
        keep[k] |= filled[k]
        if keep[k] and k:
            keep[nodes[k].parent] = True
    return keep


def _pick(rng: np.random.Generator, options: str) -> str:
    return str(rng.choice(options.split()))


def _box(rng, names: str, inner: str, tags: str = "div div section") -> str:
    kind = "id" if rng.random() < 0.3 else "class"
    tag = _pick(rng, tags)
    return f'<{tag} {kind}="{_pick(rng, names)}">{inner}</{tag}>'


def _links(rng, words: list[str], n: int) -> str:
    items = [f'<a href="/{k}">{" ".join(rng.choice(words, rng.integers(1, 4)))}</a>' for k in range(n)]
    style = rng.integers(0, 3)
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style == 0 else " | ".join(items) if style == 1 else "".join(f"<div>{x}</div>" for x in items)


def compose(blocks: list[str], others: list[str], rng: np.random.Generator) -> str:
    """A page of another layout around ``blocks``; elements of the main text have ``data-main``."""
    safe = [entities.escape(b) for b in blocks]
    prose = [entities.escape(x) for x in others] or ["..."]
    words = " ".join(safe + prose).split() or ["..."]

    def teaser(n: int = 12) -> str:
        return " ".join(str(rng.choice(prose)).split()[:int(rng.integers(3, n + 1))]) or "..."

    chance = rng.random
    body = []
    for k, text in enumerate(safe):
        tag = ("h1" if k == 0 and len(text) < 120 else _pick(rng, "p p p p p p div blockquote li h2 pre"))
        body.append(f"<ul data-main><li data-main>{text}</li></ul>" if tag == "li" else f"<{tag} data-main>{text}</{tag}>")
        if chance() < 0.08:
            body.append(_box(rng, "ad advert sponsored promo", teaser(), "div aside"))
        if chance() < 0.04:
            body.append(_box(rng, "related share social newsletter", _links(rng, words, 3) if chance() < 0.6 else f"<p>{teaser()}</p>"))
    if body and chance() < 0.2:
        body[0] = f"<header data-main>{body[0]}</header>"

    def comment() -> str:
        return _box(rng, "comment comment-body reply", f"<p>{str(rng.choice(prose))}</p>" if chance() < 0.7 else teaser(30), "div li div")

    comments = _box(rng, "comments comment-list responses discussion reader-comments", f"<h3>{teaser(3)}</h3>" + "".join(comment() for _ in range(int(rng.integers(1, 6)))), "div section div ol")
    form = f"<form action='/x'><label>{teaser(4)}</label><input name=q><p>{teaser(8)}</p><button>Go</button></form>"
    if chance() < 0.25:
        body.append(comments)
        comments = ""
    inner = "".join(body)
    style = rng.integers(0, 5)
    main = (f"<article>{inner}</article>" if style == 0 else f"<main>{inner}</main>" if style == 1 else inner if style == 2 else
            _box(rng, "content post entry article-body story main-text post-content", inner))
    if chance() < 0.3:
        main = _box(rng, "main wrap container col", main, "div main section")
    side = f"<aside>{_links(rng, words, 5)}</aside>" if chance() < 0.4 else _box(rng, "sidebar widget related-posts trending", (_links(rng, words, 4) if chance() < 0.5 else "".join(f"<p>{teaser(20)}</p>" for _ in range(3))), "div aside")
    menu = f"<nav>{_links(rng, words, int(rng.integers(3, 9)))}</nav>" if chance() < 0.5 else _box(rng, "menu navbar nav breadcrumbs toc", _links(rng, words, int(rng.integers(3, 9))))
    head = f"<header>{teaser(4)}{menu if chance() < 0.5 else ''}</header>" if chance() < 0.6 else _box(rng, "header masthead top-bar", teaser(4))
    foot = f"<footer>&copy; {teaser(6)}</footer>" if chance() < 0.6 else _box(rng, "footer copyright legal", teaser(8))
    parts = [head, menu if chance() < 0.6 else "", _box(rng, "cookie-notice consent notice newsletter alert", f"<p>{teaser(20)}</p>") if chance() < 0.5 else "",
             _box(rng, "ad advert banner-ad", teaser(10)) if chance() < 0.5 else "", side if chance() < 0.3 else "", main, comments if chance() < 0.5 else "",
             form if chance() < 0.4 else "", side if chance() < 0.3 else "", foot if chance() < 0.8 else ""]
    page = "".join(parts)
    return f"<html><body>{_box(rng, 'page wrapper site', page) if chance() < 0.3 else page}</body></html>"


def article_blocks(page: str) -> list[str]:
    """Blocks of the article of a page that marks it, else none."""
    nodes = read_page(page)
    keep = seed_labels(nodes)
    return [] if keep is None else blocks_of(nodes, keep)


def training_rows(page: str, seed: int, others: list[tuple[int, str]], layouts: int = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of a page and of the layouts composed of it.

    ``others`` are (seed, block) of any pages; what a page takes of them depends on its own
    seed alone, so neighbours in a batch or file have no say.
    """
    nodes = read_page(page)
    keep = seed_labels(nodes)
    text = [] if keep is None else blocks_of(nodes, keep)
    made_x, made_y = [np.zeros((0, features(read_page("")).shape[1]), np.float32)], [np.zeros(0, bool)]
    if text:
        made_x.append(features(nodes))
        made_y.append(keep)
        rng = np.random.default_rng(seed & 0x7FFFFFFF)
        foreign = [b for s, b in others if s != seed]
        foreign = [foreign[k] for k in rng.permutation(len(foreign))[:40]]
        for _ in range(layouts):
            page = read_page(compose(text, foreign, rng))
            made_x.append(features(page))
            made_y.append(seed_labels(page))
    return np.concatenate(made_x), np.concatenate(made_y)


# ------------------------------------------------------------------ boosted trees


@dataclass
class Boosted:
    """Binary trees of one depth, level by level: feature and threshold per inner node."""
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2 ** DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic boosting with histograms of quantile bins and Newton leaves."""
    n, width = x.shape
    if not n:
        x = np.zeros((1, width), np.float32)
    inner = 2 ** DEPTH - 1
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]) 
    share = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    margin = np.full(n, np.log(share / (1 - share)))
    found = ([], [], [])
    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, wide = 2 ** level - 1, 2 ** level
            local = at - first
            best, where = np.full(wide, 1e-6), np.zeros((wide, 2), np.int64)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                key = local * BINS + binned[f]
                gs, hs = (np.cumsum(np.bincount(key, weights=v, minlength=wide * BINS).reshape(wide, BINS), axis=1) for v in (g, h))
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                gain[(hl < LEAF / 20) | (ht - hl < LEAF / 20)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(wide), top]
                better = value > best
                best[better] = value[better]
                where[better] = np.stack([np.full(wide, f), top], axis=1)[better]
            for k in range(wide):
                if best[k] > 1e-6 and where[k, 1] < len(cuts[where[k, 0]]):
                    feature[first + k], threshold[first + k] = where[k, 0], cuts[where[k, 0]][where[k, 1]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        end = at - inner
        gs, hs = np.bincount(end, weights=g, minlength=inner + 1), np.bincount(end, weights=h, minlength=inner + 1)
        leaf = -RATE * gs / (hs + 1)
        margin += leaf[end]
        for part, value in zip(found, (feature, threshold, leaf)):
            part.append(value)
    shape = (len(found[0]), inner)
    return Boosted(np.array(found[0], np.int64).reshape(shape), np.array(found[1]).reshape(shape), np.array(found[2]).reshape(-1, inner + 1), float(np.log(share / (1 - share))) if n else 0.0)


# ------------------------------------------------------------------ decoding


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """The best choice of nodes in which nobody is kept below somebody dropped."""
    gain = np.asarray(log_odds, np.float64).copy()
    gain[0] = 0.0
    parent = [x.parent for x in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    keep = gain > 0
    keep[0] = True
    for k in range(1, len(nodes)):
        keep[k] &= keep[parent[k]]
    return keep


def train(pages: DataFrame, limit: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> Boosted:
    """Trees fitted on ``limit`` different pages, those of the smallest hashes of id and html.
    Tasks make the rows, the driver fits them; the order and layout of the table have no say."""
    rows = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.col(id_col), F.col(html_col)).alias("seed")).where("html is not null")
    # A table of ``limit`` numbers, however many rows repeat a page.
    least = rows.select("seed").distinct().orderBy("seed").limit(limit)
    chosen = stage(rows.join(F.broadcast(least), "seed").groupBy("seed").agg(F.min("html").alias("html")), "training-pages")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, html in zip(batch.column("seed").to_pylist(), batch.column("html").to_pylist()):
                short = [b for b in article_blocks(html) if len(b) < 2000][:3]
                yield pa.RecordBatch.from_arrays([pa.array([seed] * len(short), pa.int64()), pa.array(short, pa.string())], names=["seed", "block"])

    # Three short blocks a page at most.
    others = sorted((r.seed, r.block) for r in chosen.select("seed", "html").mapInArrow(cut, "seed long, block string").collect())
    shared = pages.sparkSession.sparkContext.broadcast(others)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, html in zip(batch.column("seed").to_pylist(), batch.column("html").to_pylist()):
                x, y = training_rows(html, seed, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([seed]), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["seed", "x", "y"])

    got = chosen.select("seed", "html").mapInArrow(make, "seed long, x binary, y binary").toArrow().sort_by("seed")
    y = np.frombuffer(b"".join(got["y"].to_pylist()), bool)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), -1) if len(y) else np.zeros((0, 1), np.float32)
    return boost(x, y.astype(np.float64))


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    read = [read_page(p) for p in pages]
    if not len(model.feature):
        # Nothing was learnt: keep what no element name or attribute speaks against.
        odds = [np.array([-1.0 if x.tag in _DROP_TAGS | {"header"} or _DROP_TOKENS.intersection(x.tokens) else 1.0 for x in nodes]) for nodes in read]
        for nodes, own in zip(read, odds):
            for k in range(len(nodes)):
                own[k] = -1.0 if k and own[nodes[k].parent] < 0 else own[k]
    else:
        sizes = np.cumsum([len(nodes) for nodes in read])[:-1]
        odds = np.split(model.log_odds(np.concatenate([features(nodes) for nodes in read])), sizes)
    return ["\n".join(blocks_of(nodes, decode(nodes, own))) for nodes, own in zip(read, odds)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points of text).

    White space inside a block is one blank, blocks are joined by a line feed in page
    order, character references are decoded. A null or empty page, and one without main
    text, has the empty text. Pages are read whole; what is cut short or never closed is
    read as browsers do. Repeated rows give the same text; other columns are not read.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(pages, sample, id_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", STEP):
                texts = main_texts(part.column("html").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
