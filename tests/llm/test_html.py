"""Main text of bare pages and odd rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from evalbench.llm import html

PAGES = [
    ("<p>Hello world, this is the only paragraph of the page.</p>", "Hello world, this is the only paragraph of the page."),
    ("A bare   sentence\n without markup &amp; more", "A bare sentence without markup & more"),
    ("<html><body><p>One paragraph in a body, nothing else.</p></body></html>", "One paragraph in a body, nothing else."),
    ("<html><head><title>t</title></head><body>Plain body text.</body></html>", "Plain body text."),
    ("<p>Hi</p>", "Hi"),
    ("<blockquote>Quoted words only.</blockquote>", "Quoted words only."),
    ("<pre>x = 1</pre>", "x = 1"),
    ("<div><p>First.</p><p>Second.</p></div>", "First.\n\nSecond."),
    ("<html><body><nav><ul><li><a href=/>home</a></li></ul></nav><p>One paragraph after a menu.</p><footer>(c) x</footer></body></html>", "One paragraph after a menu."),
    ("<nav><a href=x>menu</a></nav>", ""),
    ("<footer>copyright me</footer>", ""),
    ("<div class='comments'><p>Nice one.</p></div>", ""),
    ("<form><label>Name</label><input></form>", ""),
    ("<script>var x = '<p>no</p>';</script>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_bare_pages(page, text):
    assert next(html.extract([page], html.trained())) == text


def test_bare_pages_that_were_not_trained_on():
    model, right = html.trained(), 0
    pages = html.plain_pages(200, seed=77)
    for page in pages:
        want = [t for t in html.parse(page).runs.values() if t.startswith("X")]
        right += next(html.extract([page], model)) == "\n\n".join(want)
    assert right >= 0.97 * len(pages)


def test_odd_rows(spark):
    article = "<html><body><nav><a href=/>menu</a></nav><article><h1>Title</h1><p>Some text, long enough to read.</p></article></body></html>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 100_000 + "</p>"), (4, "x", "<div>" * 5000 + "deep" + "</div>" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("text", "n_chars")})
    got = html.main_text(df).collect()
    assert [(r.page_id, r.text) for r in got[:4]] == [(1, "Title\n\nSome text, long enough to read.")] * 2 + [(2, ""), (3, "")]
    assert got[4].n_chars == 499_999 and len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    empty = html.main_text(df.where("page_id = 99"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def layouts(seed):
    """(page, blocks of its article) by layout, with words that the training pages do not have."""
    r = random.Random(seed)
    words = lambda a, b: " ".join("".join(r.choice("etaoinshrdlcmuw") for _ in range(r.randint(2, 8))) for _ in range(r.randint(a, b)))
    line = lambda: words(5, 18).capitalize() + "."
    menu = "<nav><ul>" + "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(5)) + "</ul></nav>"
    page = lambda main, after="": f"<html><head><title>t</title></head><body>{menu}{main}{after}<footer>&copy; {words(2, 5)} {line()}</footer></body></html>"
    title, by, one, two = words(2, 8), words(2, 4), line(), line()
    long = [" ".join(line() for _ in range(4)) for _ in range(5)]
    article = lambda head, *blocks: f"<article>{head}{''.join(f'<p>{b}</p>' for b in blocks)}</article>"
    yield "header", page(article(f"<header><h1>{title}</h1></header>", one)), [title, one]
    yield "header, two", page(article(f'<header class="entry-header"><h1>{title}</h1></header>', one, two)), [title, one, two]
    yield "byline", page(article(f"<header><h1>{title}</h1><p>{by}</p></header>", one)), [title, by, one]
    yield "header, long", page(article(f"<header><h1>{title}</h1></header>", *long)), [title, *long]
    yield "in main", page(f"<main>{article(f'<header><h1>{title}</h1></header>', one, two)}</main>"), [title, one, two]
    yield "comments", page(article(f"<h1>{title}</h1>", *long), f"<section><h3>{r.randint(1, 9)} comments</h3><ul><li>{line()}</li><li>{line()}</li></ul></section>"), [title, *long]
    yield "newsletter", page(article(f"<h1>{title}</h1>", *long), f"<div><h3>Subscribe to our newsletter</h3><p>{line()}</p></div>"), [title, *long]
    yield "imprint", page(article(f"<h1>{title}</h1>", *long), f"<div>Imprint {words(2, 4)}</div>"), [title, *long]
    yield "body class", f'<html><body class="header-fixed"><p>{one}</p></body></html>', [one]
    yield "related box", f'<article><p>{one}</p><div class="related"><p>{line()}</p></div><p>{two}</p></article>', [one, two]
    yield "site header", page(article(f"<h1>{title}</h1>", one), "").replace("<nav>", f"<header><p>{words(1, 3)}</p></header><nav>"), [title, one]


def test_layouts():
    model = html.trained()
    right, empty = collections.Counter(), collections.Counter()
    for seed in range(30):
        for name, page, blocks in layouts(seed):
            got = next(html.extract([page], model))
            right[name] += got == "\n\n".join(blocks)
            empty[name] += not got
    assert not sum(empty.values()) and min(right[name] for name, *_ in layouts(0)) >= 27, (right, empty)
    bare = [next(html.extract([f'<article><p>{t}</p><p><a href="/x">more</a></p></article>'], model)) for t in ("A sentence of a short article.", "One more sentence, which is a little longer than the other.", "Short.")]
    assert all(bare)


def test_clashing_columns_repeats_and_empty_tables(spark):
    page = "<article><header><h1>Title</h1></header><p>Words of the article.</p></article>"
    rows = spark.createDataFrame([(1, "u", page)] * 3, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("text", "n_chars", "TEXT2")})
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in html.main_text(rows).collect()] == [(1, "u", "Title\n\nWords of the article.", 28)] * 3
    assert html.main_text(rows.where("false")).collect() == []
