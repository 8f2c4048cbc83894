"""Pages whose wrappers are named like boilerplate keep their article."""

from __future__ import annotations

import re

import pytest

from brindle.llm.htmltext import BOILERPLATE, COMMENTS, TEXT, main_text, named_kind
from conftest import SF_SMALL

ARTICLE = "<h1>Head</h1><p>One sentence of the article, which goes on for a while.</p><p>And another one, of some length too.</p>"
LINES = "Head\nOne sentence of the article, which goes on for a while.\nAnd another one, of some length too."
REST = '<nav><a href="/">home</a></nav>{}<aside>Read this too.</aside><footer>All rights reserved.</footer>'
WRAPPERS = [
    '<form id="aspnetForm">', '<div class="layout-sidebar-right">', '<div class="page-has-sidebar">', '<div class="two-column-sidebar-layout">', '<div class="elementor-widget">',
    '<div class="share-enabled">', '<aside class="main">', "<dialog open>", '<div class="widget"><form><section id="overlay">', '<section class="ads banner">',
]


def closed(wrapper):
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrapper)))


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_around_an_article(wrapper):
    page = f"{wrapper}{REST.format(f'<article>{ARTICLE}</article>')}{closed(wrapper)}"
    assert main_text(f"<body>{page}</body>") == LINES
    assert main_text(f"<main>{wrapper}<article>{ARTICLE}</article>{closed(wrapper)}</main>") == LINES


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_around_a_page_without_marks(wrapper):
    assert main_text(f"<body>{REST.format(wrapper + ARTICLE + closed(wrapper))}</body>") == LINES


@pytest.mark.parametrize("name", ["post comments-open", "page-has-sidebar", "elementor-widget", "share-enabled", "sidebar", "no-sidebar has-ads"])
def test_names_of_the_article(name):
    assert main_text(REST.format(f'<article class="{name}">{ARTICLE}</article>')) == LINES


def test_marks_in_boilerplate_are_none():
    comments = "".join(f'<article class="comment-body"><p>Reader {i} says something.</p></article>' for i in range(9))
    teasers = '<aside><article><h2>Teaser</h2><p>Short one.</p></article></aside>'
    for box in ('<section id="comments">', '<div class="comment-list">', '<div class="comments-area">'):
        page = f"<article>{ARTICLE}</article>{box}{comments}{closed(box)}{teasers}"
        assert main_text(page) == LINES
        assert main_text(f'<form id="f">{page}</form>') == LINES
        assert main_text(f"<main>{page}</main>") == LINES


def test_names_within_an_article():
    page = '<article><h1 class="banner-title">Head</h1><p class="related-study">A study.</p><p>Press <button>now</button>.</p><div class="ad-slot">Buy.</div><div class="share-buttons">Share</div><button>Menu</button></article>'
    assert main_text(page) == "Head\nA study.\nPress now."


def test_names():
    assert [named_kind(x) for x in ("ad", "adSlot", "ads-container", "social-share", "cookie_bar", "related-posts", "newsletter-form")] == [BOILERPLATE] * 7
    assert [named_kind(x) for x in ("comments", "comment-list", "disqus_comments")] == [COMMENTS] * 3
    assert [named_kind(x) for x in ("comments-open", "related-study", "banner-title", "has-sidebar", "sidebar-layout", "cookie-enabled", "", "--", "loading", "badge")] == [TEXT] * 10


def test_words_never_vanish():
    assert main_text('<div class="notice"><p>Only this.</p></div><footer>x</footer>') == "Only this."
    assert main_text('<div id="comments"><p>Only this.</p></div><nav>x</nav>') == "Only this."
    assert main_text("<nav>x</nav><footer>y</footer><script>z</script>") == ""
    assert main_text('<main></main><div class="comments"><p>a</p></div>') == "a"


def test_given_pages_in_wrappers(spark):
    rows = [r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("html").collect()]
    for html in rows:
        text = main_text(html)
        assert text
        for w in ('<form id="aspnetForm">', '<div class="layout-sidebar-right">'):
            assert main_text(re.sub(r"<body[^>]*>", lambda m: m[0] + w, html)) == text
        assert main_text(html.replace("<article>", '<article class="post comments-open">')) == text
