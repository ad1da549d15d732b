import html
import re
import time

import numpy as np
import pytest

from lodestone.llm import html_extraction as hx


def test_main_text_of_the_small_table(spark):
    path = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    out = hx.op7_html_extraction(spark, path)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    for r in out.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_generated_pages_that_training_did_not_see():
    rng, right, n = np.random.default_rng(99), 0, 120
    for _ in range(n):
        page, mark = hx._training_page(rng)
        (text,) = hx.extract([page], hx.trained())
        lines = text.split("\n")
        marked = sum(mark in x for x in lines)
        everything = len(re.findall(mark, page))
        right += marked >= 0.95 * everything and len(lines) - marked <= 0.1 * len(lines) + 1
    assert right / n > 0.85


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""), ("<p></p>", ""), ("<script>var x = '<p>no</p>';</script>", ""),
        ("<body><article><h1>A &amp; B</h1><p>one  two\n three</p><p>x<br>y</p></article></body>", "A & B\none two three\nx y"),
    ],
)
def test_small_pages(page, expected):
    assert hx.extract([page], hx.trained()) == [expected]


@pytest.mark.parametrize("page", ["<b>" * 250_000 + "x</i>" * 50_000, "<div>" * 100_000 + "<li>x</li>" * 50_000, "<p><div>" + "<b>" * 100_000 + "<div>y</div>" * 50_000, "<li><ul>" + "<div>" * 100_000 + "<li></li>" * 50_000])
def test_parsing_stray_and_nested_tags_is_linear(page):
    began = time.process_time()
    hx.parse(page)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("page", ["<b>{}<div>x</div>", "<div>{}<li>x</li>", "<b>{}<div><i>y</i></div>", "<a {}\"", "</{}>", "<p title='{}x\""])
def test_extraction_is_linear(page):
    start, end = page.split("{}")
    took = []
    for size in (250_000, 500_000, 1_000_000):
        html_ = start * (size // 2 // len(start)) + end * (size // 2 // len(end))
        began = time.process_time()
        hx.extract([html_], hx.trained())
        took.append(time.process_time() - began)
    assert took[2] < 8 * took[0] + 2  # four times, if linear; sixteen, if quadratic


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<p title="a>quoted text</p>', "quoted text"), ("<p title='a>it\"s here</p>", 'it"s here'), ('<p title="a>b" id=\'c>one</p><p>two</p>', "one\ntwo"), ('<p>whole</p><p title="cut off', "whole"), ("<p>3 < 4 and </ x", "3 < 4 and"),
        ('<p title="a>b">kept</p>', "kept"), ("<p>it's</p><p>isn't</p>", "it's\nisn't"),
    ],
)
def test_open_quotes_never_become_text(page, expected):
    root = hx.parse(page)
    nodes, _ = hx.scored_nodes(root)
    assert hx.written(root, nodes, np.ones(len(nodes), bool)) == expected


def test_formulas_and_media_text_inside_an_article_stay():
    page = "<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Sums</h1><p>We see <math><mi>x</mi></math> here, and it is a long enough sentence to be kept.</p><p>Another <object>fallback</object> sentence stands here, with some more words.</p></article></body>"
    assert hx.extract([page], hx.trained()) == ["Sums\nWe see x here, and it is a long enough sentence to be kept.\nAnother fallback sentence stands here, with some more words."]


def test_dropped_parents_drop_their_children():
    root = hx.parse("<body><nav><p>a</p><div><p>b</p></div></nav><article><p>c</p></article></body>")
    nodes, _ = hx.scored_nodes(root)
    rng = np.random.default_rng(0)
    for _ in range(200):
        odds = rng.normal(size=len(nodes)) * 3
        kept = hx.decode(nodes, odds)
        assert all(kept[n.parent.at] for i, n in enumerate(nodes) if i and kept[i])

    def likelihood(labels):
        return sum(-np.logaddexp(0, -o if k else o) for o, k in zip(odds[1:], labels[1:]))

    import itertools

    odds = rng.normal(size=len(nodes)) * 2
    best = max(((True, *x) for x in itertools.product([False, True], repeat=len(nodes) - 1) if all((True, *x)[n.parent.at] or not (True, *x)[i] for i, n in enumerate(nodes) if i)), key=likelihood)
    assert likelihood(hx.decode(nodes, odds)) == pytest.approx(likelihood(best))


def test_parser_takes_broken_markup():
    for page in ["<", "<p", "<p class='x", "</div></p>", "<!-- open", "<a<b>c", "<script>never closed", "<p>a<p>b<li>c<td>d", "<title>t", "<!DOCTYPE", "&amp", "<br/><br><img src=x>", "<div " * 50, "\x00<p>\x00", "<b>" * 3000 + "deep"]:
        assert isinstance(hx.extract([page], hx.trained())[0], str)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>text that is long enough to be seen here, really</p>" * 3000, "x"), (3, "u", "<p>text that is long enough to be seen here, really</p>" * 3000, "x"), (None, "u", "plain words", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = hx.main_text(pages).collect()
    assert len(out) == 5 and [r["text"] for r in out if r["page_id"] in (1, 2)] == ["", ""]
    assert len({r["text"] for r in out if r["page_id"] == 3}) == 1
    assert hx.main_text(pages.limit(0)).count() == 0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = hx.BoostedTrees(rounds=30).fit(x, y)
    assert ((trees.log_odds(x) > 0) == (y > 0)).mean() > 0.97
