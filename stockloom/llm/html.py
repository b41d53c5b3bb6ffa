"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into its block elements and elements with attributes; text belongs
to the nearest of them.  For each node a boosted-tree classifier gives the
log-odds that it is part of the article, from its tag, the words in its attributes,
those of its ancestors, the density of text and links below it, depth and siblings.
Decoding chooses, with the largest total, one state per node: before, inside or cut.
On every path from the root the states come in this order, so nothing below a part
that was cut is taken up again and no node inside can contradict its ancestors.

The classifier is trained here, from a bounded number of pages: their article
elements are the positive part, and labelled menus, headers, footers, side bars,
notices, adverts, forms and comments are set into copies of them, with containers
of other names, so that it does not depend on one page layout.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.boosting import BoostedTrees
from stockloom.llm.common import text_or_empty

TRAIN_PAGES = 240
TRAIN_PAGE_BYTES = 1 << 16
VARIANTS = 6
ENTER_COST = 1.0
CUT_COST = 1.0
_LABEL = "data-boilerplate"

INLINE = set(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set(
    "script style head title noscript template iframe object svg canvas audio video select option textarea button "
    "datalist math map".split()
)
CLOSES_P = set(
    "address article aside blockquote center details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table ul".split()
)
# A start tag ends an open element of these names, unless one of the scopes is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
P_SCOPE = {"table", "td", "th", "caption", "button", "object"}

TAG_GROUPS = [
    "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div", "section", "article", "main", "nav", "header",
    "footer", "aside", "form fieldset label", "table tbody thead tr td th", "blockquote pre figure figcaption", "a",
    "html body",
]
_GROUP = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags.split()}
# Words of class, id and role attributes by what they name.
WORDS = [
    "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header masthead topbar banner branding logo hero",
    "footer bottom copyright colophon legal imprint",
    "sidebar side rail widget related recommended recommendations trending popular aside complementary more tags",
    "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription signup paywall "
    "privacy disclaimer message toast",
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion adsense dfp commercial",
    "form search login register contact input",
    "comment comments reply replies discussion disqus respond reader feedback reviews",
    "share sharing social follow like print author byline meta",
    "article content main post entry story body text page prose articlebody maincontent",
]
_WORD = {word: k for k, words in enumerate(WORDS) for word in words.split()}
_GOOD = len(WORDS) - 1
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STRONG_TAGS = {"nav", "footer", "aside", "form"}


def attribute_groups(attrs: list[tuple[str, str | None]]) -> int:
    """Bit set of the word groups that class, id and role name."""
    found = 0
    for name, value in attrs:
        if value and name in ("class", "id", "role", "itemprop"):
            for word in _SPLIT.findall(value):
                group = _WORD.get(word.lower())
                if group is not None:
                    found |= 1 << group
    return found


class Page(HTMLParser):
    """Nodes of a page in document order and its text pieces."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.words: list[int] = []
        self.label: list[bool] = []
        self.links: list[int] = []
        self.pieces: list[tuple[int, str]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, node, whether its text is unseen
        self.counts: dict[str, int] = {}
        self._push("#root", [], True)
        self.feed(html)
        self.close()

    def _push(self, tag: str, attrs: list, node: bool) -> None:
        above = self.open[-1][1] if self.open else -1
        unseen = bool(self.open) and (self.open[-1][2] or tag in UNSEEN)
        if node:
            self.parent.append(above)
            self.tag.append(tag)
            self.words.append(attribute_groups(attrs))
            self.label.append(any(name == _LABEL for name, _ in attrs))
            self.links.append(0)
            above = len(self.tag) - 1
        self.open.append((tag, above, unseen))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _pop_to(self, names: set[str], scope: set[str]) -> None:
        if not any(self.counts.get(name) for name in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in names:
                for tag, _, _ in self.open[k:]:
                    self.counts[tag] -= 1
                del self.open[k:]
                return
            if self.open[k][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._pop_to({"p"}, P_SCOPE)
        if tag in ENDS:
            self._pop_to(*ENDS[tag])
        if tag in VOID:
            self.handle_break(tag)
            return
        inline = tag in INLINE
        if not inline:
            self.handle_break(tag)
        self._push(tag, attrs, not inline or any(name in ("class", "id", "role", _LABEL) for name, _ in attrs))
        if tag == "a":
            self.links[self.open[-1][1]] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_break(self, tag: str) -> None:
        if tag not in INLINE and tag not in ("img", "input", "link", "meta"):
            self.pieces.append((self.open[-1][1], " "))

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            self.handle_break(tag)
        elif self.counts.get(tag) and tag != "#root":
            self._pop_to({tag}, set() if tag != "p" else P_SCOPE)
            if tag not in INLINE:
                self.handle_break(tag)

    def handle_data(self, data: str) -> None:
        tag, node, unseen = self.open[-1]
        if not unseen:
            self.pieces.append((node, data))
            if self.counts.get("a"):
                self.links[node] += len(data) << 20


def node_features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(features, own text lengths) of every node of a page."""
    n = len(page.tag)
    parent = np.array(page.parent, dtype=np.int64)
    own, marks, before = np.zeros(n), np.zeros(n), np.zeros(n)
    read, last = 0, 0
    for node, piece in page.pieces:
        while last <= node:
            before[last] = read
            last += 1
        size = len(piece) - piece.count(" ")
        own[node] += size
        read += size
        if size > 20:
            marks[node] += piece.count(".") + piece.count(",") + piece.count("?") + piece.count("!")
    before[last:] = read
    packed = np.array(page.links, dtype=np.int64)
    anchors, linked = (packed & (1 << 20) - 1).astype(float), (packed >> 20).astype(float)
    text, tags, link_text, link_count, punctuation = own.copy(), np.ones(n), linked.copy(), anchors.copy(), marks.copy()
    paragraphs = np.array([tag == "p" for tag in page.tag], dtype=float)
    depth, ancestors = np.zeros(n), np.zeros(n, dtype=np.int64)
    tag_ancestors = np.zeros(n, dtype=np.int64)
    group = np.array([_GROUP.get(tag, len(TAG_GROUPS)) for tag in page.tag])
    words = np.array(page.words, dtype=np.int64)
    siblings, index = np.zeros(n), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        ancestors[k] = ancestors[p] | words[p]
        tag_ancestors[k] = tag_ancestors[p] | 1 << group[p]
        index[k] = siblings[p]
        siblings[p] += 1
    for k in range(n - 1, 0, -1):
        p = parent[k]
        text[p] += text[k]
        tags[p] += tags[k]
        link_text[p] += link_text[k]
        link_count[p] += link_count[k]
        punctuation[p] += punctuation[k]
        paragraphs[p] += paragraphs[k]
    up = np.maximum(parent, 0)
    whole = max(text[0], 1.0)
    bits = [group == g for g in range(len(TAG_GROUPS))]
    bits += [words >> g & 1 for g in range(len(WORDS))]
    bits += [ancestors >> g & 1 for g in range(len(WORDS))]
    bits += [tag_ancestors >> g & 1 for g in range(6, 13)]
    numbers = [
        np.minimum(depth, 40),
        np.log1p(own),
        np.log1p(text),
        np.log1p(tags),
        np.log1p(text / tags),
        link_text / np.maximum(text, 1.0),
        link_text[up] / np.maximum(text[up], 1.0),
        np.log1p(link_count),
        text / whole,
        text / np.maximum(text[up], 1.0),
        text[up] / whole,
        punctuation / np.maximum(text, 20.0),
        np.log1p(paragraphs),
        np.log1p(paragraphs[up]),
        before / whole,
        (before + text) / whole,
        np.log1p(siblings),
        np.log1p(siblings[up]),
        index / np.maximum(siblings[up], 1.0),
        text[up] / np.maximum(siblings[up], 1.0) / whole,
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in bits + numbers], axis=1), own


def decode(page: Page, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether each node is inside the article, by the best consistent choice of states."""
    n = len(odds)
    gain = np.clip(odds, -8, 8) * (1 + np.minimum(own, 1000) / 100)
    inside, outside = gain.copy(), np.zeros(n)
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        inside[p] += max(inside[k], -CUT_COST)
        outside[p] += max(outside[k], inside[k] - ENTER_COST)
    state = np.zeros(n, dtype=np.int8)  # 0 before, 1 inside, 2 cut
    for k in range(1, n):
        above = state[page.parent[k]]
        if above == 0:
            state[k] = inside[k] - ENTER_COST > outside[k]
        elif above == 1:
            state[k] = 1 if inside[k] > -CUT_COST else 2
        else:
            state[k] = 2
    return state == 1


def main_text(page: Page, kept: np.ndarray) -> str:
    """Text of the kept nodes: white space is one space, blocks are joined by one."""
    parts, gap = [], False
    for node, piece in page.pieces:
        if kept[node]:
            parts.append(" " + piece if gap else piece)
            gap = False
        else:
            gap = True
    return " ".join("".join(parts).split())


# Training.


def _sentences(page: Page) -> list[str]:
    return [s for s in (" ".join(piece.split()) for _, piece in page.pieces) if s]


def _fragment(rng: random.Random, texts: list[str]) -> str:
    """A labelled piece of boilerplate filled with ``texts``."""

    def few(low: int, high: int) -> str:
        words = rng.choice(texts).split()
        start = rng.randrange(len(words))
        return " ".join(words[start : start + rng.randint(low, high)])

    def named(tags: str, group: int, share: float = 0.85) -> tuple[str, str]:
        tag = rng.choice(tags.split())
        if tag == "div" or rng.random() < 0.4:
            words = WORDS[group].split()
            if tag != "div" or rng.random() < share:
                name = rng.choice(words)
                name = rng.choice([name, f"{name}-{rng.choice(words)}", f"site-{name}", f"{name}-box"])
                return tag, f' {rng.choice(["class", "class", "id"])}="{name}"'
        return tag, ""

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{few(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def paragraphs(n: int, low: int = 4, high: int = 60) -> str:
        return "".join(f"<p>{few(low, high)}</p>" for _ in range(n))

    kind = rng.randrange(9)
    if kind == 0:
        tag, names = named("nav nav div", 0)
        body = links(rng.randint(2, 9))
    elif kind == 1:
        tag, names = named("header div", 1)
        body = rng.choice([few(1, 6), f"<h2>{few(1, 5)}</h2>", links(3), paragraphs(1, 2, 12)])
    elif kind == 2:
        tag, names = named("footer div", 2)
        body = rng.choice([f"&copy; {few(3, 30)}", paragraphs(2, 3, 25), few(2, 20) + links(3)])
    elif kind == 3:
        tag, names = named("aside div", 3)
        body = f"<h3>{few(1, 4)}</h3>" + rng.choice([links(rng.randint(2, 6)), paragraphs(2, 4, 40), few(4, 40)])
    elif kind == 4:
        tag, names = named("div section", 4, 1.0)
        body = rng.choice([few(4, 30), paragraphs(1), paragraphs(1) + "<button>OK</button>"])
    elif kind == 5:
        tag, names = named("div", 5, 1.0)
        body = rng.choice([few(3, 40), paragraphs(1), f'<a href="/x">{few(2, 12)}</a>'])
    elif kind == 6:
        tag, names = "form", ""
        body = f"<label>{few(1, 4)}</label><input><p>{few(2, 12)}</p><button>{few(1, 2)}</button>"
    elif kind == 7:
        tag, names = named("section div", 7, 1.0)
        each = rng.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<div>{}</div>"])
        body = f"<h3>{few(1, 3)}</h3>" + "".join(
            each.format(rng.choice([few(4, 50), paragraphs(1), f"<b>{few(1, 2)}</b>" + paragraphs(2)])) for _ in range(rng.randint(1, 6))
        )
    else:
        tag, names = named("div", 8, 1.0)
        body = rng.choice([links(3), few(2, 10), paragraphs(1, 2, 10)])
    if kind in (4, 5, 7, 8) and not names:
        names = f' class="{rng.choice(WORDS[kind].split())}"'
    return f"<{tag}{names} {_LABEL}>{body}</{tag}>"


_CONTAINER = re.compile(r"<(/?)(article|main)\b[^>]*>", re.I)
_AFTER_P = re.compile(r"</p>|</h[1-6]>", re.I)


def variants(html: str, rng: random.Random, count: int = VARIANTS) -> Iterator[tuple[Page, np.ndarray]]:
    """Copies of a page with labelled boilerplate and other containers, and which nodes are article."""
    seen = list(_CONTAINER.finditer(html))
    if not seen or seen[0].group(1) or not seen[-1].group(1):
        return
    texts = _sentences(Page(html)) or ["x"]
    head, inner, tail = html[: seen[0].start()], html[seen[0].end() : seen[-1].start()], html[seen[-1].end() :]
    for k in range(count):
        tag, names = ("article", "") if k == 0 else (rng.choice(["article", "main", "div", "section", "div"]), "")
        if k and rng.random() < 0.5:
            word = rng.choice(WORDS[_GOOD].split())
            names = f' {rng.choice(["class", "id"])}="{rng.choice([word, f"{word}-{rng.choice(WORDS[_GOOD].split())}"])}"'
        body = inner
        if k and rng.random() < 0.25:  # articles of one or two blocks
            stops = [m.end() for m in _AFTER_P.finditer(body)]
            body = body[: stops[min(rng.randint(0, 2), len(stops) - 1)]] if stops else body
        if k and rng.random() < 0.6:
            for stop in sorted((m.end() for m in _AFTER_P.finditer(body)), reverse=True):
                if rng.random() < 0.12:
                    body = body[:stop] + _fragment(rng, texts) + body[stop:]
        wrap = rng.choice(["", "", "<div>", '<div class="container">', '<div id="wrapper"><div>']) if k else ""
        front = "".join(_fragment(rng, texts) for _ in range(rng.randint(0, 3))) if k else ""
        back = "".join(_fragment(rng, texts) for _ in range(rng.randint(0, 4))) if k else ""
        unwrap = "</div>" * wrap.count("<div")
        page = Page(f"{head}{wrap}{front}<{tag}{names} data-article>{body}</{tag}>{back}{unwrap}{tail}")
        yield page, article_nodes(page, f"{tag}", names)


def article_nodes(page: Page, tag: str, names: str) -> np.ndarray:
    """Training labels: inside the largest ``tag`` and not in boilerplate."""
    n = len(page.tag)
    size = np.zeros(n)
    for node, piece in page.pieces:
        size[node] += len(piece)
    cut = np.zeros(n, dtype=bool)
    for k in range(1, n):
        strong = page.tag[k] in _STRONG_TAGS
        cut[k] = cut[page.parent[k]] or page.label[k] or strong
    for k in range(n - 1, 0, -1):
        if not cut[k]:
            size[page.parent[k]] += size[k]
    wanted = attribute_groups([("class", names)]) if names else 0
    roots = [k for k in range(n) if page.tag[k] == tag and not cut[k] and page.words[k] & wanted == wanted]
    inside = np.zeros(n, dtype=bool)
    if roots:
        # The innermost of the largest, so that a wrapper is not taken for the article.
        inside[max(roots, key=lambda k: (size[k], k))] = True
    for k in range(1, n):
        inside[k] |= inside[page.parent[k]]
    return inside & ~cut


def train(pages: list[str], seed: int = 5) -> BoostedTrees | None:
    """Classifier from pages with an article or main element; None without any."""
    rng = random.Random(seed)
    xs, ys = [], []
    for html in pages:
        for page, label in variants(html, rng):
            xs.append(node_features(page)[0][1:])
            ys.append(label[1:].astype(float))
    if not xs:
        return None
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def plain_odds(features: np.ndarray) -> np.ndarray:
    """Stand-in without training pages: text-rich parts outside boilerplate tags and names."""
    tags, words = len(TAG_GROUPS), len(WORDS)
    bad = features[:, [8, 9, 10, 11, 12]].any(axis=1) | features[:, tags : tags + _GOOD].any(axis=1)
    base = tags + 2 * words + 7
    return np.where(bad | (features[:, base + 5] > 0.5), -4.0, 0.5 + 0.2 * (features[:, base + 2] - 3))


def extract(pages: list[str], model: BoostedTrees | None, nodes_at_once: int = 1 << 15) -> list[str]:
    """Main texts of pages; nodes of several pages are scored together."""
    out = [""] * len(pages)
    held: list[tuple[int, Page, np.ndarray, np.ndarray]] = []

    def score() -> None:
        if not held:
            return
        features = np.concatenate([found for _, _, found, _ in held])
        odds = model.log_odds(features) if model is not None else plain_odds(features)
        first = 0
        for k, page, found, own in held:
            out[k] = main_text(page, decode(page, odds[first : first + len(found)], own))
            first += len(found)
        held.clear()

    nodes = 0
    for k, html in enumerate(pages):
        if html:
            page = Page(html)
            held.append((k, page, *node_features(page)))
            nodes += len(page.tag)
        if nodes >= nodes_at_once:
            score()
            nodes = 0
    score()
    return out


def training_pages(pages: DataFrame, count: int = TRAIN_PAGES, most_bytes: int = TRAIN_PAGE_BYTES) -> list[str]:
    """About ``count`` pages of at most ``most_bytes`` bytes with an article or main
    element, chosen by the hash of their content."""
    usable = pages.where((F.octet_length("html") <= most_bytes) & F.col("html").rlike("(?i)<(article|main)[ >]"))
    total = usable.count()
    if not total:
        return []
    place = F.pmod(F.xxhash64("html", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(place < min(1.0, count / total)).select(place.alias("place"), "html").distinct()
    return [row["html"] for row in chosen.orderBy("place", "html").limit(2 * count).collect()]


def extract_pages(
    pages: DataFrame,
    model: BoostedTrees | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; trains on ``pages`` unless given a model.

    Null and empty pages have empty text, as have pages without an article.  Null ids
    and urls and repeated rows are carried along; other columns are not read; an empty
    table gives no rows.  Whole pages are read, whatever their length or depth.
    """
    rows = pages.select(
        pages[id_column].alias("page_id"), pages[url_column].alias("url"), text_or_empty(pages[html_column]).alias("html")
    )
    if model is None:
        model = train(training_pages(rows))
    schema = T.StructType(
        [rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, schema)
