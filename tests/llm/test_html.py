import html as entities
import re

import numpy as np
import pytest

from stockloom.llm import html as H
from stockloom.llm.boosting import BoostedTrees


@pytest.fixture(scope="module")
def pages(llm, small):
    return llm.read.parquet(f"{small}/pages.parquet")


@pytest.fixture(scope="module")
def sources(pages):
    return [r.html for r in pages.orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(sources):
    return H.train(sources)


def article(page):
    return re.search(r"<article>(.*)</article>", page, re.S)[1]


def plain(markup):
    markup = re.sub(r"<[^>]+>", "", re.sub(r"<(?:/?p|br|/?h1)>", " ", markup))
    return " ".join(entities.unescape(markup).split())


def test_articles_of_the_table(pages):
    rows = H.extract_pages(pages).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    right = [r.text == plain(article(source[r.page_id])) for r in rows]
    assert np.mean(right) > 0.95
    assert all(r.n_chars == len(r.text) for r in rows)


LAYOUTS = {
    "div": '<body><div id="top-menu"><a>Home</a> <a>News</a></div><div class="cookie-banner">We use cookies. Accept.</div>'
    '<div id="content">{}</div><div class="sidebar"><h3>Related</h3><ul><li><a>Another story</a></li></ul></div>'
    '<div id="comments"><div class="comment"><p>Great article, I really liked it a lot, thanks.</p></div></div>'
    '<div class="footer">All rights reserved</div></body>',
    "main": "<body><header><h1>Site</h1><nav><a>x</a></nav></header><main>{}<aside>Sign up now</aside></main>"
    '<section class="comments"><p>I think so too. But then, one must say no.</p></section>'
    "<form><p>Subscribe today</p><input></form><footer><p>Contact us</p></footer></body>",
    "inner": '<body><nav><ul><li><a>x</a></li></ul></nav><article>{}<div class="ad">Buy now, it is good.</div>'
    '<div class="share-buttons"><a>Tweet</a></div></article><div class="notice">This site is closing.</div></body>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_other_layouts(sources, model, name):
    bodies = [article(s) for s in sources]
    found = H.extract([LAYOUTS[name].replace("{}", b) for b in bodies], model)
    assert np.mean([f == plain(b) for f, b in zip(found, bodies)]) > 0.9


def test_parsing():
    page = H.Page("<p>a<b>b</b>c<br>d<p>e&amp;&#233;&nbsp; f<script>var x='</p>'</script><!-- no --><ul><li>g<li>h</ul>")
    kept = np.ones(len(page.tag), dtype=bool)
    assert H.main_text(page, kept) == "abc d e&é f g h"
    assert H.main_text(H.Page("<title>t</title><style>s</style>x<textarea>y</textarea>"), np.ones(9, dtype=bool)) == "x"


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(2)
    page = H.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><div>d</div>")
    n = len(page.tag)
    for _ in range(40):
        odds, own = rng.normal(0, 3, n), rng.integers(0, 300, n).astype(float)
        kept = H.decode(page, odds, own)
        gain = np.clip(odds, -8, 8) * (1 + np.minimum(own, 1000) / 100)

        def worth(states):
            total = 0.0
            for k in range(1, n):
                a, b = states[page.parent[k]], states[k]
                if b < a or (a, b) == (0, 2):
                    return None
                total += gain[k] * (b == 1) - H.ENTER_COST * (a == 0 and b == 1) - H.CUT_COST * (a == 1 and b == 2)
            return total

        best = max(
            w for code in range(3 ** (n - 1)) if (w := worth([0, *[code // 3**k % 3 for k in range(n - 1)]])) is not None
        )
        states = [0] * n
        for k in range(1, n):
            states[k] = 1 if kept[k] else (2 if states[page.parent[k]] else 0)
        assert abs(worth(states) - best) < 1e-9


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    model = BoostedTrees(rounds=40).fit(x[:1500], y[:1500])
    assert np.mean((model.log_odds(x[1500:]) > 0) == y[1500:]) > 0.95


def test_odd_pages(llm, model):
    schema = "page_id long, url string, html string, text string, n_chars string"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<article><p>" + "Only this one. " * 5000), (3, "u", deep),
            (4, "u", "plain words"), (5, "u", "</p></b><<>& <a <b"), (6, "u", "<!--")]
    df = llm.createDataFrame([(*r, "x", "x") for r in rows], schema)
    found = H.extract_pages(df, model).collect()
    assert len(found) == len(rows)
    assert [r.text for r in found if r.page_id in (1, 2)] == ["", "", ""]
    assert len(next(r for r in found if r.page_id is None).text.split()) == 15000
    assert H.extract_pages(df).count() == len(rows)
    assert H.extract_pages(llm.createDataFrame([], schema)).count() == 0


def test_words_behind_long_attributes_are_seen():
    long = " ".join(f"u-{'abcdefgh'[k % 8]}x{k}" for k in range(90))
    assert len(long) > 500
    alone = H.attribute_groups([("class", "sidebar")])
    assert alone and H.attribute_groups([("class", f"{long} sidebar")]) & alone == alone
