"""Main text of pages: planted templates under names outside any list, comments, wrappers, nesting."""

import time

import pytest

from studyforge.llm.html_text import Page, furniture, main_text

ARTICLE = [f"Paragraph {i} of the story tells what happened at place number {i} in some detail." for i in range(6)]
STORY = "".join(f"<p>{t}</p>" for t in ARTICLE)
LONG = "<p>" + "Buy our things now, they are the best things that money can buy. " * 60 + "</p>"


def text_of(html, winners=()):
    return Page(html).extract(list(winners)).split("\n")


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "comments-area", "commentlist", "related-posts", "site-footer", "left-sidebar", "cookie-bar", "ad-slot", "adSlot", "main-menu", "ads_wrapper", "page-notice", "newsletter-box", "share-buttons", "top-nav", "breadcrumb-trail", "signup-form", "site-header", "global-navbar"])
@pytest.mark.parametrize("inside", [True, False])
def test_named_furniture_goes_whatever_its_size(name, inside):
    for block in (f'<div class="{name}">{LONG}</div>', f'<section id="{name}"><ul><li>{LONG}</li></ul></section>'):
        html = f"<body><article><h1>Title</h1>{STORY}{block if inside else ''}</article>{'' if inside else block}</body>"
        assert text_of(html) == ["Title", *ARTICLE], name
    html = f'<body><div class="w"><div class="c"><h1>Title</h1>{STORY}</div><div class="{name}">{LONG}</div></div></body>'
    assert text_of(html) == ["Title", *ARTICLE]


@pytest.mark.parametrize("name", ["has-sidebar", "content", "article-body", "post", "entry-content", "text-column", "headline", "reading", "loaded", "commonplace", "comments-open"])
def test_other_names_stay(name):
    html = f'<body><div class="page"><div class="{name}"><h2>Part</h2>{STORY}</div></div></body>'
    assert text_of(html) == ["Part", *ARTICLE] and furniture(name) == ""


def test_wrappers_and_articles_of_comments():
    wrapped = f'<body><form id="aspnet"><div class="layout sidebar"><main>{STORY}</main></div></form></body>'
    assert text_of(wrapped) == ARTICLE
    plain_form = f"<body><form><div>{STORY}</div></form></body>"
    assert text_of(plain_form) == ARTICLE
    form = f"<body><article>{STORY}<form><p>Your name</p><label>Mail address</label><input></form></article></body>"
    assert text_of(form) == ARTICLE
    replies = "".join(f'<li><article class="comment-body"><p>Reply {i}: I do not agree with this at all, and I say so.</p></article></li>' for i in range(30))
    assert text_of(f'<body><article>{STORY}</article><div id="comments"><ol class="comment-list">{replies}</ol></div></body>') == ARTICLE
    assert text_of(f"<body><article>{STORY}</article>{replies}</body>") == ARTICLE


def test_article_in_two_containers_stays_whole(spark):
    split = f'<html><body><div class="wrap"><div class="first">{"".join(f"<p>{t}</p>" for t in ARTICLE[:5])}</div><div class="second"><p>{ARTICLE[5]}</p></div></div></body></html>'
    usual = f'<html><body><div class="wrap"><div class="first">{STORY}</div></div></body></html>'
    pages = [(i, f"http://a.example/{i}", usual) for i in range(9)] + [(9, "http://a.example/9", split)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(ARTICLE) for i in range(10)}


def test_a_short_page_follows_its_host(spark):
    usual = f'<body><div class="a"><div class="lead"><p>{ARTICLE[0]}</p></div><div class="text">{STORY}</div></div></body>'
    short = f'<body><div class="a"><div class="lead"><p>{ARTICLE[0]}</p></div><div class="text"><p>Ok.</p></div></div></body>'
    pages = [(i, "http://b.example/", usual) for i in range(5)] + [(5, "http://b.example/", short)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[5] == ARTICLE[0] + "\nOk."


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<div><p>a" * 25_000, "<span>" * 50_000 + "x" + "</b>" * 50_000, "<ul><li>a" * 20_000, '<div class="ad-box">' * 50_000 + "<h1>x</h1>", "<article>" * 30_000 + "y" + "</section>" * 30_000])
def test_deep_nesting_is_linear(html):
    began = time.process_time()
    page = Page(html)
    page.extract([page.name(page.best())] if page.best() is not None else [])
    assert time.process_time() - began < 4
