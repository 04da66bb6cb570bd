"""Class, id and title words inside an article are evidence only; boilerplate around and inside it still goes."""

from __future__ import annotations

import re

import pytest
from conftest import SF

from scholium.llm import html_text

LONG = "This paragraph is a good deal longer than a menu entry and belongs to the article that the page is about, all of it."
KEPT = [
    f'<h2 id="related-work">Related work</h2><p>{LONG}</p>',
    f'<h2 id="search-algorithms">Search algorithms</h2><p>{LONG}</p>',
    f'<section id="legal-analysis"><h2>Legal analysis</h2><p>{LONG}</p><p>{LONG}</p></section>',
    f'<div class="social-history"><p>{LONG}</p></div>',
    f'<blockquote id="quote-alert">{LONG}</blockquote>',
    f'<p title="the hidden gem">{LONG}</p>',
    f"<p data-note='class=\"ad\" hidden'>{LONG}</p>",
    f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section>',
    f'<div class="content sidebar-right"><p>{LONG}</p></div>',
    f'<p id=search>{LONG}</p>',
    f'<figure class="banner-of-the-town"><figcaption>{LONG}</figcaption></figure>',
]
GONE = [
    '<div class="comments"><p>{0}</p><p>{0}</p></div>', '<ul class="related-posts"><li><a href="/x">Another page</a></li></ul>',
    '<div class="share-buttons"><a href="/f">Share this</a></div>', '<div id="cookie-banner"><p>{0}</p></div>', "<aside><p>{0}</p></aside>",
    '<form><label>{0}</label></form>', '<div class="ad"><p>{0}</p></div>', '<div hidden><p>{0}</p></div>', '<div role="navigation"><a href="/">Home</a></div>',
    '<div class="comment-list"><ul><li><div><p>{0}</p></div></li></ul></div>', '<p class="newsletter">{0}</p>',
]
OTHER = "Quite another text that is as long as the article's paragraphs are, but stands in a part of the page that is left out."


@pytest.fixture(scope="module")
def models(spark):
    return [html_text.Model(), html_text.train(spark.read.parquet(f"{SF}/pages.parquet"))]


def plain(fragment):
    lines = re.split(r"</(?:h2|p|blockquote|figcaption)>", fragment)
    return [re.sub(r"<[^>]*>", "", x) for x in lines if re.sub(r"<[^>]*>", "", x)]


def page(inner, mark="article"):
    return f"<html><body class='has-sidebar no-comments'><nav><a href='/'>Home</a></nav><{mark}><h1>The title</h1><p>{LONG} First.</p>{inner}<p>{LONG} Last.</p></{mark}><footer>(c)</footer></body></html>"


@pytest.mark.parametrize("fragment", KEPT)
def test_words_of_boilerplate_inside_an_article(models, fragment):
    for model in models:
        want = "\n".join(["The title", f"{LONG} First.", *plain(fragment), f"{LONG} Last."])
        assert html_text.extract(page(fragment), model) == want
        assert html_text.extract(page(fragment, 'div class="post-content"').replace("</div class=\"post-content\">", "</div>"), model) == want


@pytest.mark.parametrize("fragment", GONE)
def test_boilerplate_inside_an_article(models, fragment):
    for model in models:
        assert html_text.extract(page(fragment.format(OTHER)), model) == "\n".join(["The title", f"{LONG} First.", f"{LONG} Last."])


def test_a_very_long_page(models):
    inner = "".join(f"<div class='a{i}'><p>{LONG} {i}</p></div>" for i in range(20_000))
    got = html_text.extract(page(inner), models[0]).split("\n")
    assert len(got) == 20_003 and got[-2] == f"{LONG} 19999"
    deep = "<div>" * 5000 + f"<p>{LONG}</p>" + "</div>" * 5000
    assert html_text.extract(page(deep), models[0]).count(LONG) == 3


def test_attributes_one_by_one():
    found = html_text._attributes(""" class=a title="x class='b' hidden" ID = 'c d' hidden CLASS="e" data-x=/y/ """)
    assert found == {"class": "a", "title": "x class='b' hidden", "id": "c d", "hidden": "", "data-x": "/y/"}
