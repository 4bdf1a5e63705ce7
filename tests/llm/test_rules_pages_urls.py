"""Quality rules, HTML extraction and URL filters against plain versions."""

import re
from collections import Counter

from loamspark.llm import html_extraction, quality_rules, queries, url_filter
from loamspark.llm.common import read_table

DATA = "/root/testdata/sf0.001"


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_plain_counting(spark):
    made = [(10_001, None), (10_002, ""), (10_003, " \n\t"), (10_004, "é𝒳\u00a0y " * 30), (10_005, "a b c d e f g h\n" * 2), (10_005, "a b c d e f g h\n" * 2), (None, "x"), (10_006, "same line\n" * 40_000)]
    docs = read_table(spark, DATA, "documents").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = quality_rules.judge(docs.selectExpr("*", "1 AS n_words", "true AS kept")).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        want = counted(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(docs.limit(0)).count() == 0


HEAD = "<html><head><title>t</title><script>var a='</p><b>x';</script></head><body><nav><ul><li>Home<li>About</ul></nav>"
TAIL = "<div class='sidebar'>links</div><section id=comments><p>nice post</p></section><footer>&copy; us</footer></body></html>"


def test_template_is_found_without_article_elements(spark):
    page = lambda i: f"{HEAD}<div class=top>Welcome to the site</div><div class=body><p>Story {i} &amp; more<p>of <b>it</b>{i}</div><div class=tip>Read our terms now</div>{TAIL}"
    rows = [(i, f"http://H.example.org/{i}", page(i), 0) for i in range(8)] + [(90, None, None, 0), (91, "x", "", 0), (92, "http://one.example.org", "<p>alone <i>here</i>&nbsp;&#233;</p><!-- no --><style>p{}</style>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in html_extraction.main_texts(spark, pages).collect()}
    assert len(got) == len(rows) and all(got[i]["text"] == f"Story {i} & more of it{i}" for i in range(8))
    assert got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "alone here é" and got[92]["n_chars"] == 12
    by_join = html_extraction.main_texts(spark, pages, html_extraction.Params(broadcast=0)).collect()
    assert sorted(map(tuple, by_join), key=str) == sorted(map(tuple, got.values()), key=str)
    assert html_extraction.main_texts(spark, pages.limit(0)).count() == 0


def test_names_never_remove_the_article():
    text = html_extraction.extract
    own = "<h1>Title</h1><p>A long enough paragraph of the article.</p>"
    want = "Title A long enough paragraph of the article."
    assert text(f"<body><div class='content has-sidebar'><article>{own}</article></div></body>") == want
    assert text(f"<body><form><nav>menu</nav><article>{own}</article><input></form></body>") == want
    assert text(f"<body><main class='search-results related'>{own}</main><footer>f</footer></body>") == want
    assert text(f"<body><div class=sidebar><div>{own}</div></div></body>") == want
    assert text("<article><h2 class='section-header'>Head</h2><p class='alert-level'>Level</p><math>x</math></article>") == "Head Level x"
    assert text(f"<body><article><header><h1>Title</h1></header><p>A long enough paragraph of the article.</p></article><section id='comment-list'><article class='comment'>me too</article><article>and me</article></section></body>") == want
    assert text(f"<article>{own}<div class='ad-banner'>Buy</div><aside>Also</aside></article>") == want


def test_constant_blocks_go_and_layouts_have_their_own(spark):
    """Unmarked notices inside articles and two layouts on one host: only the template tells them."""
    story = lambda i: f"<h1>Story {i}</h1><p>Only page {i} says this, at some length, number {i}.</p>"
    one = lambda i: f"<body><div class=x><article>{story(i)}<div>Sign up to hear from us.</div></article></div></body>"
    two = lambda i: f"<body><div class=top>All our pages</div><div class=y><div class=z>{story(i)}</div><div class=w>Seen on every page of this kind.</div></div></body>"
    rows = [(i, f"http://h.org/{i}", one(i) if i < 5 else two(i)) for i in range(15)] + [(50 + i, "http://same.org/", one(0)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i} Only page {i} says this, at some length, number {i}." for i in range(15)}
    for params in (html_extraction.Params(), html_extraction.Params(broadcast=0, part=2)):
        got = {r["page_id"]: r["text"] for r in html_extraction.main_texts(spark, pages, params).collect()}
        assert {i: got[i] for i in range(15)} == want
        assert {got[50 + i] for i in range(4)} == {want[0] + " Sign up to hear from us."}  # wholly constant pages keep their text
    assert all(html_extraction.extract(h) != want[i] for i, _, h in rows[:15])  # without the template


def test_vectors_equal_plain_counting(spark):
    from loamspark.llm.common import Scratch

    rows = [(i, f"http://h.org/{i}", f"<body><div>a</div>{'<ul><li>b</ul>' if i % 2 else ''}<p>c{i}</p><div>d</div></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_extraction.occurrences(pages).collect()
    vector = {}
    for i, _, h in rows:
        _, nodes, tags = html_extraction.page(h)
        for k, n in (Counter(t for t, _ in tags) + Counter(x.key for x in nodes)).items():
            vector.setdefault(k, {})[i] = n
    classes = {}
    for r in found:
        if r["kind"] < 2:
            classes.setdefault((r["low"], r["high"]), set()).add(r["token"] & html_extraction.BIG)
    plain = {}
    for k, v in vector.items():
        plain.setdefault(tuple(sorted(v.items())), set()).add(k)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, plain.values()))
    roles = html_extraction.templates(spark, pages, html_extraction.Params(), Scratch(spark, "test")).collect()
    assert sum(r["role"] == "text" for r in roles) == 3


def test_articles_of_the_pages(spark):
    import html

    for r, p in zip(queries.op9_html_extract(spark, DATA).orderBy("page_id").collect(), read_table(spark, DATA, "pages").orderBy("page_id").collect(), strict=True):
        own = re.search(r"(?s)<article[^>]*>(.*?)</article>", p["html"])[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if re.match(r"</?b\b", m[0]) and not m[0].startswith("<br") else " ", own)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def plain_verdict(url):
    head, found, rest = (url or "").partition("://")
    rest = rest if found else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = lambda d: host == d or host.endswith("." + d)
    ruled = max((r for r in url_filter.RULES if fits(r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])), key=len, default=None)
    return host, path, ruled, url_filter.RULES[ruled] if ruled else "block" if any(map(fits, url_filter.LISTED)) else "allow"


def test_verdicts_equal_plain_ones(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "https://example.net", "x://example.net/en", "x://b.example.com/de/1", "x://notexample.com/de/", "x://o.org/fr/", "x://ÄA.org?x/fr/", "x://ads-track.example.com/", "x://a.b.CASINO-win.example.com/p", "x://xads-track.example.com", "x://casino-win.example.org/fr/", "x://u@h:80/p"]
    rows = list(enumerate(urls)) + [(99, "x://a.org"), (99, "x://a.org")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([(x,) for x in (*url_filter.LISTED, None, "")], "key string")
    for params in (url_filter.Params(), url_filter.Params(broadcast=0)):
        got = url_filter.judge(spark, pages, listed, params=params).collect()
        assert sorted(((r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in got), key=str) == sorted(((i, plain_verdict(u)) for i, u in rows), key=str)
    assert url_filter.judge(spark, pages.limit(0), listed).count() == 0 and url_filter.judge(spark, pages, listed.limit(0)).count() == len(rows)
