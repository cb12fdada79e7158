import html
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.html import LEAST_PAGES, LOW_IMPORTANCE, Page, _digest, main_texts, style_tree_noise
from tallyspark.llm.queries import op8_html_extraction

FULL = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class=x>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Menu</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<aside>side</aside><main><article><h1>Head&amp;line</h1><p>One <b>two
three<br><p>Four&nbsp;five<!-- <p>gone</p> --><div class="ad">buy</div><ul><li>item 1<li>item 2</ul><form><p>mail</p></form></article>
<section id="comments"><p>first!</p></section></main><footer><p>&copy; all</footer></body></html>"""


def test_parts_of_a_page():
    assert Page(FULL).main_text(set()) == "Head&line One two three Four five item 1 item 2"
    assert Page("plain <i>te</i>xt &lt;b&gt; <p>x").main_text(set()) == "plain text <b> x"
    assert Page("<div><p>a</p><p><a href=x>link link</a></p></div><script>never ends").main_text(set()) == "a"
    assert Page("").main_text(set()) == ""


def page(i, extra="", notice="<p>Sign up to get all of our stories by mail</p>"):
    return f"<html><body><div class=w><div class=top>{notice}</div><div class=body><p>Own text {i} of page {i * 7}</p>{extra}</div></div></body></html>"


def test_style_tree_removes_what_the_site_repeats(spark):
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(100 + i, "http://b.example/", page(0)) for i in range(20)]
    rows += [(200, None, page(3)), (201, "http://c.example/x", None), (202, "http://c.example/y", ""), (None, "http://a.example/", page(5, "<p>y</p>" * 30000))]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Own text {i} of page {i * 7}" for i in range(20))
    whole = "Sign up to get all of our stories by mail Own text {} of page {}"
    assert all(got[100 + i] == whole.format(0, 0) for i in range(20))  # copies of one page say nothing of the site
    assert got[200] == whole.format(3, 21) and got[201] == "" and got[202] == ""
    assert got[None] == "Own text 5 of page 35" + " y" * 30000
    assert main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_query_gives_the_articles(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op8_html_extraction(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = re.sub(r"</?b>", "", article)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_what_few_articles_share_stays(spark):
    cell = lambda i: "<table><tr><th>Year</th></tr><tr><td>{}</td></tr></table>".format(1900 + i) if i < 8 else ""
    rows = [(i, f"http://a.example/{i}", page(i, cell(i))) for i in range(60)]
    # Near copies of one article and nothing else, and a site whose article mark stands around a line of every page.
    rows += [(100 + i, f"http://b.example/{i}", f"<body><article><p>The same paragraph</p><p>Edition {i}</p></article></body>") for i in range(8)]
    rows += [(200 + i, f"http://c.example/{i}", f"<body><p>Our motto</p><article><p>Own words {i}</p><blockquote>A quotation</blockquote></article></body>") for i in range(20)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i} of page {i * 7}" + (f" Year {1900 + i}" if i < 8 else "") for i in range(60))
    assert all(got[100 + i] == f"The same paragraph Edition {i}" for i in range(8))
    assert all(got[200 + i] == f"Own words {i} A quotation" for i in range(20))


def test_embedded_elements_end_where_they_end():
    text = lambda x: Page(f"<body><article>{x}</article><p>outside</p></body>").main_text(set())
    assert text('<p>a <svg viewBox="0 0"/> b</p><p>c <svg><g><text>no</text></g></svg> d</p>') == "a b c d"
    assert text("<p>a <math/> b</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><p>c</p>") == "a b so x=1 holds c"
    assert text("<p>a</p><div><svg><path d='m'></div><p>b <svg><rect/><p>c</p>") == "a b c"
    assert text("<div>a<canvas>no</div><p>b</p><div><iframe src=x></div><noscript><p>no</p></noscript><p>c</p>") == "a b c"
    assert text("<object data=x><p>in its place</p></object><figure><img src=x><figcaption>A caption</figcaption></figure>") == "in its place A caption"
    assert text("<p>a <select><option>no<option>no</select> b<template><p>no</p></template></p><svg><foreignObject><p>no</p></foreignObject></svg>c") == "a b c"
    assert Page("<p>a <math><mi>x</mi></math> b</p><figure><figcaption>no</figcaption></figure>").main_text(set()) == "a b"


def test_tags_of_any_length_are_tags():
    text = lambda x: Page(f"<body><article>{x}</article><p>outside</p></body>").main_text(set())
    many = " ".join(f'data-{i}="v > {i}"' for i in range(3000))
    assert text(f"<p>Good.</p><script {many}>var bad=1; if (a < b) document.write('<p>no')</script><style {many}>p{{}}</style><p {many}>End.</p>") == "Good. End."
    assert text(f'<p>a</p><p title="{"x>" * 20000}">b</p><img alt=\'{"<p>" * 9000}\'>c') == "a b c"
    assert text("<p>a</P ><p class=x>b</p x='>'> c<br/>d</ p>e<>f<3<p>g <!-->h--> i") == "a b c de<>f<3 g h--> i"
    assert text("<p>a <ab" + "c" * 5000 + ">b</p>") == "a b"
    assert Page("<p>a</p><p title='never closed>b</p>").main_text(set()) == "a b"


@pytest.mark.parametrize("opened,stays", [
    ('<div class="notice-period">', True), ('<section id="related">', True), ('<div class="social history">', True), ('<section id="discussion">', True), ('<p class="share-price">', True), ('<div class="header-note">', True), ('<p class="page-2">', True),
    ('<div class="ad">', False), ('<div class="ad-slot-3">', False), ('<div class="adBox">', False), ('<div class="cookie-notice">', False), ('<ul class="share_buttons">', False), ('<section id="comments">', False), ('<div class="comment-list">', False), ('<div class="discussion">', False), ('<div class="x related-posts">', False), ("<div hidden>", False), ("<div style='display: none'>", False), ("<nav>", False), ("<form>", False),
])
def test_names_in_an_article(opened, stays):
    tag = re.match(r"<(\w+)", opened)[1]
    got = Page(f"<article><p>Good.</p>{opened}Two weeks.</{tag}><p>End.</p></article>").main_text(set())
    assert got == ("Good. Two weeks. End." if stays else "Good. End.")


HOSTILE = {
    "long tags": lambda k: "<p " + "a=1 " * k + ">" + "x</p>" * k,
    "quotes of two kinds": lambda k: "<a b=\"'\" c='\"'>" * k,
    "unclosed quotes": lambda k: '<a href="x ' * k,
    "paragraphs with blocks": lambda k: "<p><div>" * k + "x",
    "tags without an end": lambda k: "<a <a " * k,
    "scripts without an end": lambda k: "<script " * (k // 8),
    "closing tags of nothing": lambda k: "<div>" + "<span>x</p>" * k,
    "deep drawings": lambda k: "<svg>" + "<g>" * k + "x",
    "declarations": lambda k: "<!x " * k,
    "mixed quotes": lambda k: "<a b='\"c " * k,
    "rows": lambda k: "<table>" + "<tr><td>x" * k,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_time_in_proportion(kind):
    import time

    def seconds(k):
        start = time.process_time()
        Page(HOSTILE[kind](k)).main_text(set())
        return time.process_time() - start

    seconds(500)
    assert seconds(32_000) < 14 * seconds(4_000) + 0.5


def naive_noise(pages):
    """The paths and texts of low importance of one host, from lists of whole pages and the definition alone."""
    import math

    parsed = {source: Page(source) for source in pages}
    h = len(parsed)
    layouts, texts, outside = {}, {}, set()
    for source, p in parsed.items():
        for path, v in p.layouts.items():
            layouts.setdefault(path, {}).setdefault(v, set()).add(source)
        for path, noise, main, text, _ in p.blocks:
            if not noise:
                texts.setdefault(path, {}).setdefault(text, set()).add(source)
                if not main:
                    outside.add((path, text))
    out = set()
    for path, by_text in texts.items():
        m = len(set().union(*by_text.values()))
        if m < LEAST_PAGES:
            continue
        importance = {t: 1 - math.log(len(s)) / math.log(h) for t, s in by_text.items()}
        out |= {path ^ _digest(t) for t, x in importance.items() if x < LOW_IMPORTANCE and (path, t) in outside}
        shared = [t for t in by_text if len(by_text[t]) > 1]
        if not any((path, t) in outside for t in shared):
            continue
        content = sum(importance[t] * len(by_text[t]) for t in by_text) / sum(len(s) for s in by_text.values())
        shown = 0.0
        if path in layouts:
            n = len(set().union(*layouts[path].values()))
            if n >= LEAST_PAGES and any(len(s) > 1 for s in layouts[path].values()):
                shares = [len(s) / n for s in layouts[path].values()]
                shown = -sum(x * math.log(x) for x in shares) / math.log(n)
        if content < LOW_IMPORTANCE and shown < LOW_IMPORTANCE:
            out.add(path)
    return out


def test_tree_equals_a_naive_one_and_decides(spark):
    """Pages that mark no article: what the site repeats goes by the tree alone."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    pages = []
    for i in range(60):
        body = "".join(f"<p>{' '.join(word() for _ in range(12))}</p>" for _ in range(r.randrange(1, 4)))
        legend = "<ul><li>first choice</li><li>second choice</li></ul>" if i % 30 else "<ul><li>only choice</li></ul>"
        pages.append(f"<html><body><div class=top><p>The house of {'things' if i != 7 else 'thongs'}</p></div><div class=text>{body}<p>{'a common saying' if i % 2 else 'another saying'}</p></div>{legend}</body></html>")
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)] + [(99, "http://a.example/x", pages[0])], "page_id bigint, url string, html string")
    tree = F.when(F.lit(True), F.lit(1).cast("bigint"))
    got = {x.noise & 0xFFFFFFFFFFFFFFFF for x in style_tree_noise(df.select(tree.alias("tree"), "html")).collect()}
    assert got == naive_noise(pages) and got
    texts = {x.page_id: x.text for x in main_texts(df).collect()}
    assert "The house of things" not in texts[3] and "first choice" not in texts[3] and "common saying" in texts[3]
    assert texts[3] != Page(pages[3]).main_text(set())
