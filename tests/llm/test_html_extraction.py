"""Main text of pages: whole tables against a plain reading, single pages against the text they should give."""

import html
import re

import pytest

from veridex.llm import common, html_extraction
from veridex.llm.html_extraction import main_text
from veridex.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "A sentence of the article, with commas, and an end. Then one more; and then the last one, too."
PAGES = {
    "boilerplate around an article": (
        f"""<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies, ok?</div>
        <main><article><h1>Head &amp; line</h1><p>{LONG} It has <b>bo</b>ld\ntext.</p><ul><li>Item one</li><li>Item two</li></ul><p>Short.</p><table><tr><td>a<td>b</table><div class="share-buttons"><a href=x>Tweet</a></div>
        <aside>Side note</aside><section id="comments"><article class="comment"><p>{LONG}</p></article></section></article></main><div class="sidebar"><p>{LONG}</p></div><form><label>Mail</label></form><footer>&copy; me</footer></body></html>""",
        f"Head & line {LONG} It has bold text. Item one Item two Short. a b",
    ),
    "no names at all": (
        f"""<body><div><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></div><div><div><h2>Title</h2><div class="t">{LONG}</div><div class="t">Short.</div><div class="t">{LONG}</div></div><div><i>Buy now</i></div></div><div>Copyright 2020</div></body>""",
        f"Title {LONG} Short. {LONG}",
    ),
    "elements left open": ("<p>Only text, no end. <p>Second <br>line&nbsp; x", "Only text, no end. Second line x"),
    "no elements": ("just text &#233; &lt;p&gt; &unknown; 1 < 2", "just text é <p> &unknown; 1 < 2"),
    "scripts and comments": ("<body><script>var a='<p>x</p>';</script><p>Hello, world.</p><style>p{}</style><!-- <p>no</p> --><p hidden>no</p></body>", "Hello, world."),
    "a form around the page": (f"<body><form id=all><div class=content><h1>Big</h1><p>{LONG}</p></div></form></body>", f"Big {LONG}"),
    "a sidebar class around the page": (f'<body><div class="with-sidebar"><article><p>{LONG}</p></article></div></body>', LONG),
    "header of an article": (f"<body><article><header><h1>Top</h1></header><p>{LONG}</p></article></body>", f"Top {LONG}"),
    "an advert between paragraphs": (f'<article><p>{LONG}</p><div class="ad">Buy.</div><p>{LONG}</p><span class="promo">Hurry, <b>now</b></span></article>', f"{LONG} {LONG}"),
    "only a menu": ("<nav><a href=a>Home</a></nav>", ""),
    "a script without an end": ("<p>One, two.</p><script>var x = '<p>no</p>'", "One, two."),
    "signs in attributes": (f'<article><p title="a > b" data-x=\'<i>\'>{LONG}</p></article>', LONG),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def plain(page):
    """For pages of the tables, whose article has a start and an end tag: what stands between them, without tags."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())


def test_query_equals_plain_reading(spark):
    got = {r.page_id: r for r in QUERIES["op12_html_extraction"](spark, SF).collect()}
    pages = common.table(spark, SF, "pages").collect()
    assert len(got) == len(pages) > 0
    for p in pages:
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, plain(p.html), len(plain(p.html)))


def test_scores_follow_the_definition():
    page = html_extraction.parse("<body><div>x, y<ul><li>one two. three<li><a href=a>four</a></ul></div><p>five; six, seven" + "<div><p>eight.</div>" * 3)
    got = html_extraction.scores(page.blocks, page.parents)

    def up(path):
        return [path] + (up(page.parents[path]) if page.parents[path] >= 0 else [])

    def means(path):
        """Of the blocks at and below a path, leaning on its parent's with the weight of one block."""
        mine = [b for b in page.blocks if path in up(b.path)]
        length, signs = sum(len(b.text) for b in mine), sum(len(re.findall("[.,;]", b.text)) for b in mine)
        if path == 0:
            return length / len(mine), signs / len(mine)
        a, b = means(page.parents[path])
        return (length + a) / (len(mine) + 1), (signs + b) / (len(mine) + 1)

    for path in {b.path for b in page.blocks}:
        own = [b for b in page.blocks if b.path == path]
        a, b = means(page.parents[path])
        length, signs = sum(len(x.text) for x in own), sum(len(re.findall("[.,;]", x.text)) for x in own)
        want = (length + a) / (len(own) + 1) * (1 + (signs + b) / (len(own) + 1)) * (1 - sum(x.links for x in own) / length)
        assert got[path] == pytest.approx(want)


def test_awkward_rows(spark):
    page = f"<p>{LONG}</p>"
    rows = [(None, None, page, "a"), (1, "u", None, "b"), (1, "u", "", "c"), (2, None, page, "d"), (2, None, page, "d"), (3, "v", f"<article>{page * 20_000}</article>", "e"), (4, "w", "<div>" * 20_000 + "x", "f")]
    got = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((str(r.page_id), str(r.url), r.n_chars) for r in got.collect()) == sorted((str(i), str(u), len(main_text(h or ""))) for i, u, h, _ in rows)
    assert len(main_text(rows[5][2])) == 20_000 * (len(LONG) + 1) - 1
    assert html_extraction.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
