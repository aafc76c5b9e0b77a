"""Main text of pages: what goes, what stays, the two passes, and odd or hostile pages."""

import os
from time import perf_counter

import pytest

from lexiforge.llm import htmltext as H

LONG = "It was the best of times and the worst of times for all of us, and that is how it was to be in the end."
MORE = "The people of the town had been told that the bridge was closed, but they went on to the river as they did on each day."
PAGE = f"""<!DOCTYPE html><html lang="en" class="has-sidebar"><head><title>A title</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="with-comments"><header><h1>My site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>{LONG}</p> -->
<div class="ad">Buy the best of the things that you want and be happy with all of them for the rest of it.</div>
<article><header><h1>Fish &amp; chips</h1></header><p>{LONG}<script>x="<p>no</p>"</script></p><p>Short.<p><b>{MORE}<br>On&nbsp;and
   on.</p><aside><p>{LONG}</p></aside><p class="ad-box">{LONG}<p>Ends <span class="share">Share this</span> well</p><form><p>{LONG}</p></form>
<div id="cookieNotice">{LONG}</div><p style="display: none">{LONG}</p><ul><li>One<li>Two</ul><p><a href="x">All linked words of this list are here</a></p><div class="comment-list"><p>{LONG}</p></div></article>
<section id="comments"><article><p>{LONG}</p></article></section><aside class="related"><article><p>{LONG}</p></article></aside>
<footer>&copy; us, {LONG}</footer>"""


def test_what_goes_and_what_stays():
    assert H.main_text(PAGE).split("\n") == ["Fish & chips", LONG, "Short.", MORE + " On and on.", "Ends well", "One", "Two"]


@pytest.mark.parametrize("holder", ["main", 'div role="main"', 'div class="post-content"', 'section itemprop="articleBody"', "article"])
def test_holders_of_articles(holder):
    page = f"<nav>Menu of the site</nav><div class='layout no-sidebar'><{holder}><h2>Hi</h2><p>Few words.</p><div class='article-header'>By me</div></{holder.split()[0]}></div><footer>The end</footer>"
    assert H.main_text(page) == "Hi\nFew words.\nBy me"


def test_second_pass_takes_the_nearest_label():
    page = f"<p>{LONG}</p><p>After good.</p><h2>Before good</h2><p>{MORE}</p><p>Near the good.</p><p>Near the bad.</p><p>Words <a href=x>and this link is far longer than the words</a></p><p>At the end.</p>"
    assert H.main_text(page).split("\n") == [LONG, "After good.", "Before good", MORE, "Near the good."]
    found = H.blocks(page)
    H.label(found)
    assert [b.label for b in found] == ["good"] * 5 + ["bad"] * 3


def test_unknown_languages_are_judged_without_stop_words():
    long = "чытаць кнігу ўдзень і ўначы пад дрэвам каля ракі дзе цячэ вада і спяваюць птушкі ўсё лета"
    assert H.main_text(f"<nav>меню</nav><div><p>{long}</p></div><footer>канец</footer>") == long
    assert H.main_text("no markup at all") == "" and H.main_text(LONG) == LONG and H.main_text(f"x < y & z &lt; {LONG}") == f"x < y & z < {LONG}"


def test_hostile_pages_take_linear_time():
    n = 200_000
    pages = ["<" * n, "<div>" * n, "<a '" * n, "<p \"" * n, "<div " + "x" * 5 * n, "<script>" * n, "<!--" * n, "</div>" * n, "<div class='" + "ad-" * n + "'>", "&" * n, "&amp" * n, "<p>" + "x " * n, "<nav><article>" * (n // 10), "<div><p>" * n + "</div>" * n, "<p>a" * n, f"<article><p>{LONG}</p>" + "<div>x" * n]
    for p in pages:
        at = perf_counter()
        H.main_text(p)
        assert perf_counter() - at < 8, p[:20]


@pytest.mark.parametrize("page", [None, "", "<", "</", "<!", "<!--", "<a", "<p", "</p", "<script", "<script>x", "<p>\x00", "<article>", "<b></article>", "<p><p></nav></article>", "&#x110000; &#55296; &bogus;"])
def test_broken_pages(page):
    assert isinstance(H.main_text(page), str)


def test_rows(spark):
    rows = [(1, "u", PAGE, "z"), (1, "u", PAGE, "z"), (None, None, None, None), (2, "v", "", "z"), (3, "w", f"<article>{'😀 the ' * 50_000}</article>", "z")]
    got = H.with_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [0, len(H.main_text(PAGE)), len(H.main_text(PAGE)), 0, 50_000 * 6 - 1] and all(len(r.text) == r.n_chars for r in got)
    assert H.with_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_given_pages_give_their_articles(spark):
    """The given pages hold one plain article each, which a plain cut finds."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        own = re.sub(r"</?(p|h1)>", "\0", re.search(r"(?s)<article>(.*?)</article>", r.html).group(1)).replace("<br>", " ")
        blocks = [" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", own).split("\0")]
        assert H.main_text(r.html) == "\n".join(b for b in blocks if b)
