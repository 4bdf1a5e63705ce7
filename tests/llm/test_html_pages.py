import time

import pytest

from loamspark.llm import html_extraction as H

CASES = {
    "<p data-x=it's>Hello there</p><p>World again</p>": "Hello there World again",
    '<p title="a>Hello there</p><p>World again</p>': "Hello there World again",
    "<p a = 'x>y' b=\"q>r\" c=d/e checked>t</p>": "t",
    "a<!-->b<!--->c<!-- d -->e": "abce",
    "1 < 2 <b>bold</b> </ >end": "1 < 2 bold end",
    "<p>a</p><!doctype": "a",
    "<p>a</p><!-- never ends": "a",
    "<br/>x<p/>y": "x y",
    '<article><p>one</p><div class="user-comments">no</div><div class="google-ads">no</div><div class="cookie-law">no</div><p>two</p></article>': "one two",
    '<div class="has-sidebar"><p>stays</p></div><div class="sidebar">no</div>': "stays",
}


@pytest.mark.parametrize("html", CASES)
def test_tags_and_names(html):
    assert H.extract(html) == CASES[html]


@pytest.mark.parametrize("html", ['<a "' * 250_000, "<div>x" * 100_000, '<p title="' * 100_000, "<!--" * 250_000, "<p>x" * 200_000, "<" * 1_000_000, "<script>" * 120_000, "<a href='x" * 100_000])
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    H.extract(html)
    whole = time.process_time() - began
    began = time.process_time()
    H.extract(html[: len(html) // 4])
    assert whole < 1 + 8 * (time.process_time() - began)


def found(spark, pages):
    rows = spark.createDataFrame([(i, "https://host.example/" + str(i), h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in H.main_texts(spark, rows).orderBy("page_id").collect()]


def test_near_copies_on_a_host_keep_their_text(spark):
    words = lambda k, i: " ".join(f"word{k}x{i}x{j}" for j in range(25))
    story = [words("s", i) for i in range(5)]
    own = [[*story, f"line edited {k} " * 4] for k in range(4)] + [[words(k, i) for i in range(6)] for k in range(3)]
    page = lambda text: f"<html><body><div class='top'><a href='/'>Home</a></div><div id='text'><h2>Introduction</h2>{''.join(f'<p>{x}</p>' for x in text)}</div><div class='footer'>All rights</div></body></html>"
    texts = found(spark, [page(x) for x in own])
    assert texts == [" ".join(" ".join(["Introduction", *x]).split()) for x in own]


def test_template_drops_constant_blocks_around_an_article(spark):
    words = lambda k, i: " ".join(f"word{k}x{i}x{j}" for j in range(25))
    note = "The same note stands on every page of this host"
    page = lambda k: f"<body><div class='x1'>Other things {k}</div><div id='text'><p>{note}</p><p>{words(k, 1)}</p><p>{words(k, 2)}</p></div></body>"
    pages = [page(k) for k in range(8)]
    assert found(spark, pages) == [f"{words(k, 1)} {words(k, 2)}" for k in range(8)]
    assert all(note in H.extract(p) for p in pages)  # without the template it would stay
