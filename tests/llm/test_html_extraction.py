from __future__ import annotations

import re
from html import unescape

import pytest

from demandpanel.llm import html_extraction as hx

PAGES = "page_id long, url string, html string"
PRIOR = hx.weights({})
LOREM = "the quick brown fox jumps over the lazy dog again and again until night falls"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CASES = {
    "plain": (page(f"<article><h1>Head</h1><p>{LOREM}</p></article>"), f"Head {LOREM}"),
    "menu and footer": (page(f'<nav><ul><li><a href="/x">Menu words here</a></li></ul></nav><article><p>{LOREM}</p></article><footer>&copy; site</footer>'), LOREM),
    "inner notices": (page(f'<main><p>{LOREM}</p><aside>aside text</aside><div class="ad-box">buy this now</div><div class="cookie-notice">we use cookies</div><p>tail words</p></main>'), f"{LOREM} tail words"),
    "comments": (page(f'<article><p>{LOREM}</p></article><section id="comments"><h2>Comments</h2><article class="comment"><p>{LOREM} {LOREM}</p></article></section>'), LOREM),
    "forms and sidebars": (page(f'<div class="sidebar">links and more links</div><div><p>{LOREM}</p><form><input value="x"><label>Your mail</label><button>Go</button></form><p>end</p></div>'), f"{LOREM} end"),
    "scripts": (page(f'<script>var t="</p><p>bad</p>";</script><style>p{{a:b}}</style><article><p>{LOREM}<script>x</script> more</p><!-- <p>no</p> --><noscript>off</noscript></article>'), f"{LOREM} more"),
    "entities and inline": (page(f"<article><p>A&amp;B &lt;tag&gt; &#233;&#x1F642; f<b>oo</b>b<i>ar</i><br>line</p><p>{LOREM}</p></article>"), f"A&B <tag> é🙂 foobar line {LOREM}"),
    "page header": (page(f'<header><h1>Site</h1><p>slogan of this site</p></header><article><header><h1>Title</h1></header><p>{LOREM}</p></article>'), f"Title {LOREM}"),
    "unclosed": (f"<html><body><nav><ul><li>menu<article><p>{LOREM}<p>two<b>bold</article><footer>foot", f"{LOREM} twobold"),
    "attributes with marks": (page(f'<article title="a > b" data-x=\'</article>\'><p class="lead">{LOREM}</p></article>'), LOREM),
    "names that are no hints": (page(f'<div class="no-sidebar content loading header-less"><p>{LOREM}</p></div>'), LOREM),
    "roles": (page(f'<div role="navigation">menu</div><div role="main"><p>{LOREM}</p></div><div role="contentinfo">foot</div>'), LOREM),
    "bare text": (LOREM, LOREM),
    "less than": (page(f"<article><p>1 < 2 and 3 <4 {LOREM}</p></article>"), f"1 < 2 and 3 <4 {LOREM}"),
    "cut off": (f"<article><p>{LOREM} <a hr", f"{LOREM} <a hr"),
    "unnamed menu": (page("<div>" + '<ul><li><a href="/">Some menu entry</a></li></ul>' * 9 + f"</div><div><p>{LOREM} <a href='/'>with a link</a> inside</p></div>"), f"{LOREM} with a link inside"),
    "nothing": (page("<nav>menu</nav>"), ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, want = CASES[name]
    assert hx.main_text(html, PRIOR) == want


def best_sum(values):
    return max((sum(values[i:j]) for i in range(len(values)) for j in range(i, len(values) + 1)), default=0)


def test_the_scan_finds_the_largest_sum():
    html = page("<p>one</p><table><tr><td>x</td></tr></table><ul><li>a b c d e f g</li></ul><hr><hr><hr><hr><hr><p>two three four five six seven eight nine</p>")
    weight = {**PRIOR, "hr": -3.0}
    values = [n * weight[key] for key, n in hx._events([p for p, _ in hx.content_parts(html)])]
    words = hx.main_text(html, weight).split()
    assert words == "two three four five six seven eight nine".split()
    assert best_sum(values) == pytest.approx(8 * weight[hx.WORD])


def test_weights_follow_the_labelled_pages(spark):
    rows = [(i, "u", page(f"<div>x</div><article><p>{LOREM}</p></article><div>y</div>")) for i in range(60)] + [(99, "u", None), (98, "u", page("<p>no label</p>"))]
    learned = hx.train(spark.createDataFrame(rows, PAGES).repartition(3))
    assert learned["div"] < PRIOR["div"] < PRIOR["p"] * 0.9 or learned["div"] < learned["p"]
    assert learned[hx.WORD] > 0 and learned["#word:p"] > 0 > learned[hx.LINKED]
    assert all(v < 0 for k, v in learned.items() if not k.startswith(hx.WORD) and k != hx.CUT)


MARKED = {
    "article bearing a listed class": "<div class='menu'>a b</div><article class='banner'><p>T one two</p></article>",
    "article bearing a listed id": "<article id='share'><p>T one two</p></article>",
    "article under a listed class": "<div class='login'><article><p>T one two</p></article></div>",
    "article in a form": "<form action='x'><article><p>T one two</p></article></form>",
    "unnamed parts around the article": f"<div class='top'>Slogan {LOREM}</div><article><p>T one two</p></article><div class='replies'><p>Great post {LOREM}</p></div>",
    "comments as articles": "<article><p>T one two</p></article><div id='comments'><article class='comment'><p>me too</p></article></div>",
    "heading with a listed id": "<article><h2 id='comments'>T one</h2><p>two</p></article>",
    "unclosed advert": "<article><p class='ad'>buy<p>T one</p><ul><li class='promo'>deal<li>two</ul></article>",
    "unclosed advert at the end of its box": "<article><div><p class='ad'>buy</div>T one two</article>",
}


@pytest.mark.parametrize("name", MARKED)
def test_marked_articles_are_whole(name):
    assert hx.main_text(page(MARKED[name]), PRIOR) == "T one two"


def test_without_marks_and_names_the_scan_decides(spark):
    """Pages teach that words of bare boxes and links lie outside; a page without marks or listed names is cut by the scan."""
    boxes = f"<div>{LOREM}</div><ul><li><a href='x'>{LOREM}</a></li></ul>"
    rows = [(i, "u", page(f"<nav>{boxes}</nav>{boxes}<article><h1>Head line</h1><p>{LOREM}</p><p>{LOREM}</p></article>{boxes}")) for i in range(40)]
    learned = hx.train(spark.createDataFrame(rows, PAGES))
    html = page(f"<div class='zone7'>Slogan and other words here</div><div class='q'><h1>Head line</h1><p>{LOREM}</p><p>{LOREM}</p></div><div class='zone9'>More for you to read</div>")
    assert hx.main_text(html, learned) == f"Head line {LOREM} {LOREM}"


def test_query_rows_nulls_repeats_empty_and_long(spark):
    long = page("<article>" + f"<p>{LOREM}</p>" * 20_000 + "</article>")
    rows = [(1, "u", None), (2, None, ""), (3, "u", CASES["plain"][0]), (3, "u", CASES["plain"][0]), (None, "u", long)]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "'c' AS text", "1 AS n_chars")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in hx.extract(frame, hx.train(frame)).collect()), key=lambda r: str(r[:2]))
    plain = CASES["plain"][1]
    whole = " ".join([LOREM] * 20_000)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", plain, len(plain)), (3, "u", plain, len(plain)), (None, "u", whole, len(whole))], key=lambda r: str(r[:2]))
    none = spark.createDataFrame([], PAGES)
    assert hx.extract(none, hx.train(none)).collect() == []


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    text = {r["page_id"]: r["text"] for r in hx.extract(pages, hx.train(pages)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        assert text[r["page_id"]] == " ".join(unescape(re.sub("</?(?:p|br|h1)>", " ", re.sub("</?b>", "", inner))).split())


def test_backtracking_stays_linear():
    assert hx.main_text('<a title="' * 50_000, PRIOR) is not None
    assert hx.main_text("<" * 200_000, PRIOR) == "<" * 200_000
