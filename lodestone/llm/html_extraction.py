"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree. Every element gets features (subtree text and tag counts, link density,
attribute tokens, depth, place among its siblings), boosted regression trees in numpy give the
log-odds that it belongs to the main text, and a dynamic programme over the tree picks the most
likely labels under the rule that below a dropped element everything is dropped.

The trees are trained here, on labelled pages that a seeded generator writes (no data is read), once
per Python process that asks for them.

Blocks are block-level elements' own text: white space becomes one space, the ends are trimmed and
empty blocks vanish; a <br> is white space.

Scripts, styles and their kin, form controls and drawings are never text; all else is left to the trees. Every step is linear in a page's
length, however its tags nest or stray.

Edge cases: null, empty and tag-free html without words gives an empty text; text outside any element
belongs to the body; unclosed and cut-off markup is closed at the end, and a cut-off tag is dropped;
repeated rows get equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts_of

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
NEVER = frozenset("script style title textarea noscript template iframe noembed noframes head select option button svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img object canvas audio video meter progress output math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
#: What an opening tag ends, and the elements that stop the search for it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"})}

#: A tag ends at the first > outside its quotes; a quote that never closes is a character like others, so that no tag becomes text.
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
CUT_OFF = re.compile(r"<[/!a-zA-Z]")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKENS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

# Attribute tokens and tags that the features count.
GROUPS = (
    frozenset("article content main post entry story body text prose markdown read copy blog news".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar toolbar skip links".split()),
    frozenset("ad ads advert advertisement adsense adbox banner sponsor sponsored promo promoted dfp outbrain taboola".split()),
    frozenset("sidebar side aside related recommended recommend widget rail more popular trending teaser".split()),
    frozenset("footer header masthead copyright legal colophon credits head foot site top bottom".split()),
    frozenset("cookie consent notice gdpr alert popup modal overlay message banner newsletter subscribe signup".split()),
    frozenset("comment comments reply replies discussion disqus respond thread reader".split()),
    frozenset("form search login share social sharing tags meta byline author rating vote button input".split()),
)
TAGS = ("html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "p", "h1", "h2", "ul", "li", "table", "blockquote", "pre", "figure")
TAG_AT = {t: i + 1 for i, t in enumerate(TAGS)}
FLAT = frozenset("nav header footer aside form".split())


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "at", "block")

    def __init__(self, tag: str, parent, tokens=()):
        self.tag, self.parent, self.children, self.tokens = tag, parent, [], tokens


class Chain:
    """The open elements, and for each tag where it stands among them, so that no search walks the tree."""

    def __init__(self, root: Node):
        self.open, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def last(self, tags) -> int:
        """The innermost place of any of the tags; 0, the root's, without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        """Ends the element at the place, and all inside it."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()


def parse(page: str) -> Node:
    """The page's tree. A child is a Node or a text, in page order. An end tag of nothing open is passed over."""
    root = Node("html", None)
    chain, blocks, has_body = Chain(root), [0], False  # blocks: the places of open elements that aren't inline
    at, n = 0, len(page)
    while at < n:
        node = chain.open[-1]
        m = MARK.search(page, at)
        if not m:
            cut = CUT_OFF.search(page, max(at, page.rfind(">") + 1))
            node.children.append(page[at : cut.start()] if cut else page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at, tag = m.end(), m[2]
        if not tag or m[0][-1] != ">":
            continue
        tag = tag.lower()
        place = 0
        if m[1]:
            place = chain.last((tag,))
        elif tag == "html" or tag == "body" and has_body:
            continue
        else:
            if tag in ENDS:
                ended, stops = ENDS[tag]
                place = chain.last(ended)
                place = place if place > chain.last(stops) else 0
            if tag in CLOSES_P and not place and chain.open[blocks[-1]].tag == "p":
                place = blocks[-1]
        if place:
            chain.close(place)
            while blocks[-1] >= place:
                blocks.pop()
            node = chain.open[-1]
        if m[1]:
            continue
        tokens = ()
        if "=" in m[3]:
            tokens = tuple(t for a in ATTRIBUTE.finditer(m[3]) for t in TOKENS.findall((a[2] or a[3] or a[4] or "").lower()))
        child = Node(tag, node, tokens)
        node.children.append(child)
        has_body |= tag == "body" and node is root
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            child.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            if tag not in INLINE:
                blocks.append(len(chain.open))
            chain.push(child)
    return root


def scored_nodes(root: Node) -> tuple[list[Node], np.ndarray]:
    """Block elements in page order with their features; inline and never-shown elements belong to their block."""
    nodes, rows = [], []

    def measure(node: Node) -> tuple[int, int, int, int, int, int]:
        """words, characters, characters in links, links, paragraphs, elements below, commas in the subtree."""
        chars = words = linked = links = paragraphs = below = commas = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c)
                words += c.count(" ") + 1 if not c.isspace() else 0
                commas += c.count(",") + c.count(".")
            elif c.tag not in NEVER:
                a = stack[c]
                words, chars, linked, links, paragraphs, below, commas = words + a[0], chars + a[1], linked + a[2], links + a[3], paragraphs + a[4], below + a[5] + 1, commas + a[6]
                if c.tag == "a":
                    linked, links = linked + a[1] - a[2], links + 1
                elif c.tag == "p":
                    paragraphs += 1
        return words, chars, linked, links, paragraphs, below, commas

    order, stack, todo = [], {}, [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in NEVER)
    for node in reversed(order):
        stack[node] = measure(node)
    whole = max(1, stack[root][1])
    depth = {root: (0, 0, 0, 0, 1, 0, ())}
    seen = 0
    for node in order:
        level, inside, place, siblings, bad, good, _ = depth[node]
        kids = [c for c in node.children if isinstance(c, Node) and c.tag not in NEVER and c.tag not in INLINE]
        hits = [sum(t in g for t in node.tokens) for g in GROUPS] if node.tokens else [0] * len(GROUPS)
        if node.tag not in INLINE:
            words, chars, linked, links, paragraphs, below, commas = stack[node]
            node.at = node.block = len(nodes)
            nodes.append(node)
            up = stack[node.parent] if node.parent else stack[node]
            rows.append([TAG_AT.get(node.tag, 0), node.tag in FLAT, node.tag in ("article", "main"), level, place, max(0, siblings - 1 - place), np.log1p(words), np.log1p(chars), chars / whole, chars / max(1, up[1]), linked / max(1, chars), links / (below + 1), paragraphs, below, chars / (below + 1), commas / max(1, words), seen / whole, bad > 1, good, *hits])
        else:
            node.block = node.parent.block
        nested = (bad + (node.tag in FLAT or sum(hits[1:]) > 0), good or node.tag in ("article", "main") or hits[0] > 0)
        for i, c in enumerate(kids):
            depth[c] = (level + 1, 0, i, len(kids), *nested, ())
        for c in node.children:
            if isinstance(c, str):
                seen += len(c)
            elif c.tag in INLINE and c.tag not in NEVER:
                depth[c] = (level, 1, 0, 0, *nested, ())
    return nodes, np.array(rows, np.float32)


class BoostedTrees:
    """Log-loss boosting of depth-limited trees over per-feature histogram cuts."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, cuts: int = 24, least: float = 8.0):
        self.rounds, self.depth, self.rate, self.cuts, self.least = rounds, depth, rate, cuts, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.cuts + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        width, n_features = self.cuts + 1, x.shape[1]
        flat = binned + np.arange(n_features) * width
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            size = (1 << (self.depth + 1)) - 1
            feature, cut, value = np.zeros(size, np.int32), np.full(size, np.inf, np.float32), np.zeros(size, np.float32)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth + 1):
                for node in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = np.flatnonzero(at == node)
                    if not len(rows):
                        continue
                    sg, sh = g[rows].sum(), h[rows].sum()
                    value[node] = self.rate * sg / (sh + 1)
                    if level == self.depth or sh < 2 * self.least / 10:
                        continue
                    k = flat[rows].ravel()
                    hg = np.bincount(k, np.repeat(g[rows], n_features), n_features * width).reshape(n_features, width).cumsum(1)[:, :-1]
                    hh = np.bincount(k, np.repeat(h[rows], n_features), n_features * width).reshape(n_features, width).cumsum(1)[:, :-1]
                    gain = hg**2 / (hh + 1) + (sg - hg) ** 2 / (sh - hh + 1) - sg**2 / (sh + 1)
                    gain[(hh < self.least / 10) | (sh - hh < self.least / 10)] = 0
                    for i, e in enumerate(edges):
                        gain[i, len(e) :] = 0
                    i, j = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[i, j] <= 1e-6:
                        continue
                    feature[node], cut[node] = i, edges[i][j]
                    at[rows] = 2 * node + 1 + (binned[rows, i] > j)
            self.trees.append((feature, cut, value))
            f += value[at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, every = np.full(len(x), self.start, np.float32), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                split = np.isfinite(cut[at])
                at = np.where(split, 2 * at + 1 + (x[every, feature[at]] > cut[at]), at)
            f += value[at]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """True for kept nodes: the most likely labels where a dropped node's whole subtree is dropped. The root is kept."""
    keep, drop = -np.logaddexp(0, -odds.astype(float)), -np.logaddexp(0, odds.astype(float))
    best_keep, best_drop, above = keep.copy(), drop.copy(), np.full(len(nodes), -1)
    for i in range(len(nodes) - 1, 0, -1):
        above[i] = up = nodes[i].parent.block
        best_keep[up] += max(best_keep[i], best_drop[i])
        best_drop[up] += best_drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[:1] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[above[i]] and best_keep[i] >= best_drop[i]
    return kept


def written(root: Node, nodes: list[Node], kept: np.ndarray) -> str:
    """Kept blocks' texts in page order."""
    blocks, open_ = [], []

    def close() -> None:
        if open_:
            text = SPACE.sub(" ", entities.unescape("".join(open_))).strip()
            if text:
                blocks.append(text)
            open_.clear()

    todo: list = [(root, True)]
    while todo:
        item, shown = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if shown:
                open_.append(item)
        elif item.tag in NEVER:
            continue
        elif item.tag in INLINE:
            if item.tag == "br":
                open_.append(" ")
            todo.extend((c, shown) for c in reversed(item.children))
        else:
            close()
            mine = bool(kept[item.at])
            todo.append((None, False))
            todo.extend((c, mine) for c in reversed(item.children))
    close()
    return "\n".join(blocks)


# The training pages: shapes of main text and of what surrounds it.
_MAIN = ('<article>{}</article>', '<main>{}</main>', '<main><article>{}</article></main>', '<div class="post-content">{}</div>', '<div id="content"><div class="entry">{}</div></div>', '<section class="article-body">{}</section>', '<div class="story"><div class="text">{}</div></div>', '<div>{}</div>', '<div class="wrapper"><article class="post">{}</article></div>')
_MENU = ('<nav><ul>{}</ul></nav>', '<div class="menu"><ul>{}</ul></div>', '<header><nav>{}</nav></header>', '<ul class="nav">{}</ul>', '<div id="navbar"><ul>{}</ul></div>', '<div class="breadcrumbs">{}</div>')
_JUNK = ('<div class="ad">{}</div>', '<div class="advert banner"><p>{}</p></div>', '<aside><h3>Related</h3><p>{}</p></aside>', '<aside>{}</aside>', '<div class="sidebar"><p>{}</p><p>{}</p></div>', '<div class="cookie-notice"><p>{}</p><button>OK</button></div>', '<div id="cookie-consent">{}</div>', '<form action="/s"><label>{}</label><input name="q"></form>', '<div class="newsletter"><form><p>{}</p><input></form></div>', '<div class="share">{}</div>', '<div role="alert">{}</div>', '<div class="sponsored"><span>{}</span></div>', '<div class="promo">{}</div>', '<div class="related"><ul><li>{}</li><li>{}</li></ul></div>')
_TOP = ('<header><h2>{}</h2></header>', '<header><div class="logo">{}</div></header>', '<div class="site-header">{}</div>', '<div id="masthead"><p>{}</p></div>')
_FOOT = ('<footer>&copy; {}</footer>', '<footer><p>{}</p></footer>', '<div class="footer">&copy; {}</div>', '<div id="site-footer"><p>{}</p><ul><li><a href="/p">{}</a></li></ul></div>')
_COMMENTS = ('<div class="comments"><h2>Comments</h2>{}</div>', '<section id="comments">{}</section>', '<ol class="comment-list">{}</ol>')
_COMMENT = ('<div class="comment"><p>{}</p></div>', '<li class="comment"><b>{}</b><p>{}</p></li>', '<article class="comment"><p>{}</p></article>')


def _training_page(rng: np.random.Generator) -> tuple[str, str]:
    """A page, and a mark that stands in every text of its main part."""
    pick = lambda shapes: shapes[rng.integers(len(shapes))]
    mark = "⁣"

    def say(low: int, high: int, m: str = "") -> str:
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(rng.integers(low, high + 1))]
        for i in range(7, len(words), int(rng.integers(6, 14))):
            words[i] += rng.choice([".", ",", "."])
        return m + " ".join(words).capitalize() + "."

    def fill(shape: str, low: int, high: int) -> str:
        return shape.format(*(say(low, high) for _ in range(shape.count("{}"))))

    links = lambda n: "".join(f'<li><a href="/{i}">{say(1, 2)}</a></li>' for i in range(n))

    def main() -> str:
        out = [f"<h1>{say(2, 9, mark)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.integers(1, 14) if rng.random() < 0.8 else rng.integers(14, 50)):
            u = rng.random()
            if u < 0.68:
                out.append(f"<p>{say(1, 90, mark)}</p>")
            elif u < 0.78:
                out.append(f"<p><b>{say(2, 12, mark)}<br>")
            elif u < 0.83:
                out.append(f"<h2>{say(1, 8, mark)}</h2>")
            elif u < 0.87:
                out.append("<ul>" + "".join(f"<li>{say(1, 14, mark)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif u < 0.90:
                out.append(f"<blockquote><p>{say(4, 30, mark)}</p></blockquote>")
            elif u < 0.93:
                out.append(f'<p>{say(3, 30, mark)} <a href="/x">{say(1, 5)}</a> {say(3, 20)}</p>')
            elif u < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{say(1, 4, mark)}</td><td>{say(1, 4, mark)}</td></tr>" for _ in range(rng.integers(2, 5))) + "</table>")
            elif u < 0.97:
                out.append(f"<pre>{say(3, 20, mark)}</pre>")
            else:
                out.append(fill(pick(_JUNK), 2, 25))
        return "".join(out)

    parts = []
    if rng.random() < 0.4:
        parts.append(fill(pick(_TOP), 1, 8))
    if rng.random() < 0.85:
        parts.append(pick(_MENU).format(links(int(rng.integers(2, 12)))))
    for _ in range(rng.integers(0, 3)):
        parts.append(fill(pick(_JUNK), 2, 30))
    parts.append(pick(_MAIN).format(main()))
    if rng.random() < 0.3:
        parts.append(pick(_COMMENTS).format("".join(fill(pick(_COMMENT), 2, 40) for _ in range(rng.integers(1, 8)))))
    for _ in range(rng.integers(0, 3)):
        parts.append(fill(pick(_JUNK), 2, 30))
    if rng.random() < 0.85:
        parts.append(fill(pick(_FOOT), 2, 20))
    return f"<html><head><title>{say(2, 6)}</title><script>var a='{say(1, 3)}'</script></head><body>{''.join(parts)}</body></html>", mark


@lru_cache
def trained(pages: int = 700, seed: int = 20_017) -> BoostedTrees:
    """Trees for the generator's pages: a node is main text if a marked text lies below it, and it is no ancestor of the whole page's rest only by that."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for _ in range(pages):
        page, mark = _training_page(rng)
        root = parse(page)
        nodes, x = scored_nodes(root)
        inside = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            todo = list(nodes[i].children)
            while todo and not inside[i]:
                c = todo.pop()
                if isinstance(c, str):
                    inside[i] = mark in c
                elif c.tag in INLINE:
                    todo.extend(c.children)
                elif c.tag not in NEVER:
                    inside[i] = inside[c.at]
        xs.append(x)
        ys.append(inside)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str], trees: BoostedTrees) -> list[str]:
    """The main texts of pages. The trees score all of their nodes at once."""
    parsed = [(root, *scored_nodes(root)) for root in map(parse, pages)]
    odds = trees.log_odds(np.concatenate([x for _, _, x in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for root, nodes, x in parsed:
        out.append(written(root, nodes, decode(nodes, odds[at : at + len(x)])))
        at += len(x)
    return out


def main_text(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    trees = trees or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", most_bytes=2 << 20, most_rows=512):
            texts = extract(texts_of(b, "html"), trees)
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
