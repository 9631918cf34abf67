"""A small tree of a page: its block elements, their text, and features of each."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title iframe canvas audio video datalist".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
FOREIGN = frozenset("svg math".split())
# Seen, and nodes of their own within a line of text: the model decides.
OWN_NODE = FOREIGN | frozenset("object select textarea button".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | OWN_NODE
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SECTIONS = ["nav", "header", "footer", "aside", "form", "article", "main", "section"]
BLOCKS = ["div", "p", "heading", "li", "list", "table", "quote", "inline", "other"]
_BLOCK_OF = {"div": 0, "p": 1, "li": 3, "dd": 3, "dt": 3, "ul": 4, "ol": 4, "dl": 4, "menu": 4, "table": 5, "tbody": 5, "thead": 5, "tr": 5, "td": 5, "th": 5, "blockquote": 6, "pre": 6, "figure": 6, "figcaption": 6}
TOKENS = {
    "content": "article post entry content main story body text prose page single blog news read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc links tabs pagination pager toolbar skip",
    "edge": "header masthead banner top topbar logo brand footer bottom copyright legal colophon credits imprint",
    "side": "sidebar side aside widget related recommended trending popular teaser teasers more rail archive tags",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner affiliate adsense",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread responses reader readers feedback",
    "notice": "cookie cookies consent notice alert gdpr newsletter subscribe signup popup modal overlay paywall warning login message",
    "share": "share sharing social follow like buttons author byline meta bio print",
}
_GROUP_OF: dict[str, list[int]] = {}
for _k, _names in enumerate(TOKENS.values()):
    for _name in _names.split():
        _GROUP_OF.setdefault(_name, []).append(_k)
HASHED = 16
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WHITE = re.compile(r"\s+")
_UNENDED = re.compile(r"<[A-Za-z/!?]")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    marked: bool
    #: Text and child numbers in order; None is a break between two blocks of text.
    parts: list = field(default_factory=list)
    text: int = 0
    links: int = 0
    words: int = 0
    stops: int = 0
    below: int = 1
    blocks: int = 0


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0, [], False)]
        #: Open elements: name, and the node they are or lie in.
        self.open: list[tuple[str, int]] = [("html", 0)]
        #: Open elements whose content is not shown: the unseen one, then all that was opened in it.
        self.unseen: list[str] = []
        #: How many of each name are among them.
        self.hidden: dict[str, int] = {}
        self.links = 0
        #: How many of each name are open, and where: no end tag needs a search.
        self.count: dict[str, int] = {"html": 1}
        self.at: dict[str, list[int]] = {}

    def _close(self, at: int) -> None:
        for name, node in self.open[at:]:
            self.count[name] -= 1
            places = self.at[name]
            if places and places[-1] >= at:
                del places[bisect_left(places, at):]
            self.links -= name == "a"
            if node != self.open[at - 1][1] and self.nodes[node].tag == name:
                above = self.nodes[self.nodes[node].parent]
                if name not in INLINE:
                    above.parts.append(None)
        del self.open[at:]

    def _show(self) -> None:
        self.unseen.clear()
        self.hidden.clear()

    def _hide(self, tag: str) -> None:
        self.unseen.append(tag)
        self.hidden[tag] = self.hidden.get(tag, 0) + 1

    def _foreign(self) -> bool:
        return any(self.count.get(x) for x in FOREIGN)

    def _last(self, names, stop=frozenset()) -> int:
        """Place of the last open element of these names, 0 when one of ``stop`` lies behind it."""
        last = max((self.at[x][-1] for x in names if self.at.get(x)), default=0)
        barrier = max((self.at[x][-1] for x in stop if self.at.get(x)), default=0)
        return last if last >= barrier else 0

    def handle_starttag(self, tag, attrs):
        if self.unseen:
            if self.unseen[-1] == "head" and tag not in HEAD or tag == "body" and self.unseen[0] == "head":
                self._show()
            else:
                if tag not in VOID and tag not in ("head", "html"):
                    self._hide(tag)
                return
        if tag in ("html", "body") and len(self.nodes) > 1 and self.count.get("body"):
            return
        if tag in UNSEEN:
            self._hide(tag)
            return
        if tag == "br":
            self.handle_data(" ")
            return
        while tag in ENDS_P and self._foreign():  # HTML ends a drawing or formula that is still open
            self._close(self._last(FOREIGN))
        if tag in ENDS_P and self.count.get("p"):
            at = self._last({"p"}, {"table", "td", "th", "button", "object"})
            if at:
                self._close(at)
        if tag in SIBLINGS and any(self.count.get(x) for x in SIBLINGS[tag]):
            at = self._last(SIBLINGS[tag], SCOPE[tag])
            if at:
                self._close(at)
        if tag in VOID:
            if tag == "hr":
                self.nodes[self.open[-1][1]].parts.append(None)
            return
        tokens, marked = [], False
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                tokens += [w.lower() for w in _WORDS.findall(value)]
            elif name == "data-main":
                marked = True
        here = self.open[-1][1]
        if self._foreign() or tag in INLINE and not tokens and tag not in OWN_NODE:
            node = here
        else:
            node = len(self.nodes)
            above = self.nodes[here]
            if tag not in INLINE:
                above.parts.append(None)
            above.parts.append(node)
            self.nodes.append(Node(tag, here, above.depth + 1, tokens, marked))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        before = len(self.unseen)
        self.handle_starttag(tag, attrs)
        if len(self.unseen) > before or tag not in VOID and self._foreign():
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.unseen:
            if self.hidden.get(tag):
                name = None
                while name != tag:
                    name = self.unseen.pop()
                    self.hidden[name] -= 1
                return
            if self.unseen[0] == "head" or not self.count.get(tag):
                return
            self._show()  # the end of an element around it
        if tag == "p" and not self.count.get("p"):
            self.nodes[self.open[-1][1]].parts.append(None)
        if tag not in ("html", "body") and self.count.get(tag):
            at = self._last({tag}) if tag in ("table", "td", "th") else self._last({tag}, {"table", "td", "th"})
            if at:
                self._close(at)

    def handle_data(self, data):
        if self.unseen:
            if self.unseen[-1] != "head" or not data.strip():
                return
            self._show()
        node = self.nodes[self.open[-1][1]]
        node.parts.append(data)
        n = len(data) - data.count(" ")
        node.text += n
        node.words += data.count(" ") + 1
        node.stops += data.count(".") + data.count(",") + data.count("!") + data.count("?")
        if self.links:
            node.links += n


def read_page(html: str) -> list[Node]:
    """Nodes of a page in document order; parents come before their children."""
    reader = _Reader()
    reader.feed(html)
    # What is left begins with a tag or comment that never ends: nothing of it is shown, and
    # the parser would try it again from every "<" in it.
    if _UNENDED.match(reader.rawdata):
        reader.rawdata = ""
    reader.close()
    return reader.nodes


FEATURES = 20 + 2 * len(SECTIONS) + len(BLOCKS) + 2 * len(TOKENS) + HASHED


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: text density of its subtree, attribute tokens, depth, siblings."""
    n = len(nodes)
    own = np.array([(x.text, x.links, x.words, x.stops) for x in nodes], np.float64)
    total = own.copy()
    below, children, blocks = np.ones(n), np.zeros(n), np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    rank = np.zeros(n)
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        total[p] += total[k]
        below[p] += below[k]
        children[p] += 1
        blocks[p] += blocks[k] + (nodes[k].tag == "p")
        key = (p, nodes[k].tag)
        same[key] = same.get(key, 0) + 1
        rank[k] = children[p]
    out = np.zeros((n, FEATURES), np.float32)
    page = max(1.0, total[0, 0])
    parent = np.array([max(0, x.parent) for x in nodes])
    text, links, words, stops = total.T
    seen_before = np.concatenate(([0.0], np.cumsum(own[:, 0])[:-1]))
    heads = np.array([x.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for x in nodes], float)
    has_head = heads.copy()
    for k in range(n - 1, 0, -1):
        has_head[parent[k]] = max(has_head[parent[k]], has_head[k])
    out[:, :20] = np.stack([
        np.log1p(text), np.log1p(own[:, 0]), text / page, text / below, np.log1p(text / below), links / np.maximum(1, text), stops / np.maximum(1, words),
        text / np.maximum(1, words), np.log1p(words), np.array([x.depth for x in nodes]), np.log1p(below), np.log1p(children), np.log1p(children[parent]),
        rank / np.maximum(1, children[parent]), np.array([same.get((x.parent, x.tag), 1) for x in nodes]) / np.maximum(1, children[parent]),
        np.log1p(blocks), seen_before / page, text / np.maximum(1, text[parent]), links[parent] / np.maximum(1, text[parent]), has_head], axis=1)
    at = 20
    width = len(SECTIONS)
    for k, x in enumerate(nodes):
        if x.tag in SECTIONS:
            out[k, at + SECTIONS.index(x.tag)] = 1
        block = 2 if heads[k] else 7 if x.tag in INLINE else _BLOCK_OF.get(x.tag, 8)
        out[k, at + 2 * width + block] = 1
        groups = at + 2 * width + len(BLOCKS)
        for token in x.tokens:
            for g in _GROUP_OF.get(token, ()):
                out[k, groups + g] = 1
            out[k, groups + 2 * len(TOKENS) + zlib.crc32(token.encode()) % HASHED] = 1
        if k:
            p = x.parent
            out[k, at + width:at + 2 * width] = np.maximum(out[p, at:at + width], out[p, at + width:at + 2 * width])
            g, m = groups, len(TOKENS)
            out[k, g + m:g + 2 * m] = np.maximum(out[p, g:g + m], out[p, g + m:g + 2 * m])
    return out


def blocks_of(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """Text of the kept nodes, block by block in page order, white space made single."""
    out, now = [], []
    stack = [iter(nodes[0].parts)] if keep[0] else []
    while stack:
        part = next(stack[-1], False)
        if part is False:
            stack.pop()
        elif isinstance(part, str):
            now.append(part)
        elif part is None:
            if now:
                out.append("".join(now))
                now = []
        elif keep[part]:
            stack.append(iter(nodes[part].parts))
    out.append("".join(now))
    return [b for b in (_WHITE.sub(" ", x).strip() for x in out) if b]
