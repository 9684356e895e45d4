import math
import random
import html as lib
import re
from collections import Counter

import pytest

from quern.llm import html_text as H
from quern.llm.html_text import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><a href=x>home</a></header><nav><ul><li><a>Menu</a><li><a>More</a></ul></nav>
<div id="cookie-banner">We use cookies on this site, and this text is long enough to look like content.</div>
%s
<div class="ad">Buy this now, a very good product with a long description, today only.</div>
<aside class=sidebar><p>Sidebar with a long text that should not be in there at all, really not.</p></aside>
<section id="comments"><p>Nice article, says the reader with a comment that is long.</p></section>
<form><label>Name</label><textarea>text</textarea></form><footer>&copy; x</footer></body></html>"""
BODY = """<h2>Title</h2><p>First paragraph with quite some text in it &amp; more, <a href=q>a link</a> to
   follow&hellip;<p>Short.<ul><li>one</li><li>two</li></ul><div class="advert">An advert inside the article, and not a short one.</div>
<p>Last <b>bold</b>paragraph, line<br>break, with text enough to count as the main content.</p>"""
WANT = "Title\nFirst paragraph with quite some text in it & more, a link to follow…\nShort.\none\ntwo\nLast boldparagraph, line break, with text enough to count as the main content."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', '<div id=content class="has-sidebar">%s</div>'])
def test_the_article_is_all_that_stays(wrap):
    assert main_text(PAGE % (wrap % BODY)) == WANT


@pytest.mark.parametrize(
    "page,want",
    [(None, ""), ("", ""), ("plain <b>text</b>", "plain text"), ("<p>cut <b", "cut"), ("<article><p>a &am", "a &am"), ("<p>a</p><script>x</p>", "a"), ("<p>&lt;i&gt; &#233;&nbsp;x", "<i> é x"), ("<![CDATA[x]]><p>b", "b"), ("<nav>menu <article><p>text", "text"), ("<div hidden>no</div><p>yes</p>", "yes"), ("<!-- c --><p>x<!-- y -->z", "xz")],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_deep_nesting_and_long_text():
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<article><p>" + "word " * 200_000)) == 999_999


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def truth(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        inner = re.sub(r"<(?:[a-zA-Z/!?][^<>]*)?\Z", "", inner)
        parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub("<br>", " ", inner))
        return "\n".join(x for x in (" ".join(lib.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x)

    got = {r["page_id"]: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == truth(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_nulls_repeats_and_more_columns(spark):
    rows = [(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert Counter(map(tuple, extract_text(df).collect())) == Counter([(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)])
    assert extract_text(df.limit(0)).collect() == []


LONG = "A sentence of the body that is long enough to be read as text, with more than one clause in it. " * 3


def test_articles_are_no_more_than_a_prior():
    card = '<article class="card"><h3><a href=x>A related story</a></h3><p>Its teaser, in one short line of text.</p></article>'
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = "\n".join(["Title", LONG.strip(), LONG.strip(), "Short.", LONG.strip()])
    assert main_text(f"<div class=story>{body}</div><div>{card * 4}</div>") == want
    assert main_text(f"<main><div class=story>{body}</div>{card * 4}</main>") == want
    assert main_text(f"<div><p>{LONG[:97]}</p></div><article>{body}</article>") == want


@pytest.mark.parametrize("name", ["comment", "teaser", "promo-card"])
def test_an_article_by_name_something_else_is_not_read(name):
    assert main_text(f'<article><p>{LONG}</p></article><article class="{name}"><p>{LONG[:97]} else</p></article>') == LONG.strip()


@pytest.mark.parametrize("part", ['<h2 id="related-work">x y</h2>', '<h2 id="search-results">x y</h2>', '<p id="notice-period">x y</p>', '<h2 id="ad-hoc-networks">x y</h2>', '<p>x <span class="comment">y</span></p>', "<p><label>x</label> <math><mi>y</mi></math></p>", "<p>x <object>y</object></p>", "<p><map>x</map> y</p>"])
def test_the_articles_own_text_stays_whatever_its_names(part):
    assert main_text(f"<article><p>{LONG}</p>{part}</article>") == f"{LONG.strip()}\nx y"


@pytest.mark.parametrize("names", ['class="entry-content no-comments"', 'id=content class="no-ads"', 'class="post comments-closed"', 'class="entry-content comments"', 'class="category-ads post"', 'class="has-ads"'])
def test_names_that_do_not_mark_the_container(names):
    assert main_text(f"<div {names}><p>{LONG}</p></div>") == LONG.strip()
    assert main_text(f"<article {names}><p>{LONG}</p></article>") == LONG.strip()


@pytest.mark.parametrize("part", ['<div class="ad content">x</div>', '<div class="commentBody">x</div>', '<ul class="share"><li>x</ul>', '<p class="advert">x</p>', '<div class="sponsored-content">x</div>', '<div class="no-js nav">x</div>'])
def test_names_that_mark_a_container(part):
    assert main_text(f"<article><p>{LONG}</p>{part}</article>") == LONG.strip()


def slow_regions(ratios, lines, sigma, threshold):
    """Plain pages line by line: smoothed ratio, threshold by the deviation, regions with a line above it."""
    n = len(ratios)
    level = []
    for i in range(n):
        near = [(j, math.exp(-0.5 * ((i - j) / sigma) ** 2)) for j in range(max(0, i - int(3 * sigma)), min(n, i + int(3 * sigma) + 1))]
        level.append(sum(ratios[j] * w for j, w in near) / sum(w for _, w in near))
    mean = sum(level) / n
    deviation = math.sqrt(sum((x - mean) ** 2 for x in level) / n)
    regions = {line[3] for line, x in zip(lines, level) if n == 1 or x >= threshold * deviation}
    kept = [line[3] in regions for line in lines]
    for i in range(n - 2, -1, -1):
        kept[i] = kept[i] or (lines[i][5] and kept[i + 1])
    return [line[0] for line, keep in zip(lines, kept) if keep]


def test_regions_of_plain_pages_against_brute_force():
    r = random.Random(1)
    some = 0
    for _ in range(400):
        lines = [("x" * r.choice([3, 8, 40, 300]), r.randrange(1, 9), r.randrange(3), r.randrange(5), H.PLAIN, r.random() < 0.2) for _ in range(r.randrange(1, 25))]
        ratios = [max(0, len(t) - links) / (tags + 1) for t, tags, links, *_ in lines]
        got = H.content_lines(lines)
        assert got == slow_regions(ratios, lines, H.SIGMA, H.THRESHOLD)
        some += 0 < len(got) < len(lines)
    assert some > 50
