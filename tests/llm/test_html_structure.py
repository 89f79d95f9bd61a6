"""Wrappers, unclosed and self-closing elements, class words, and time linear in the page."""

import time

import pytest

from catalogspark.llm import html

BODY = " ".join(f"word{i}" for i in range(60)) + "."
P = f"<p>{BODY}</p>"
MENU = "<nav><a>Home</a><a>About</a></nav>"


@pytest.mark.parametrize("page,text", [
    (f'<div class="page search-enabled">{MENU}<article>{P}</article></div>', BODY),
    (f'<div class="comments-enabled">{P}</div>', BODY),
    (f'<div class="sidebar-left"><article>{P}</article></div>', BODY),
    (f'<article><p>Intro here.</p><svg class=i />{P}</article>', f"Intro here.\n\n{BODY}"),
    (f'<article><p>Intro here.</p><svg><text>lost</text></svg>{P}</article>', f"Intro here.\n\n{BODY}"),
    (f'<article>{P}<section class="related-work"><p>Related work is long.</p></section></article>', f"{BODY}\n\nRelated work is long."),
    (f'<article>{P}<div class="ad-hoc">Ad hoc ways.</div><div class="ad-slot">Buy now</div></article>', f"{BODY}\n\nAd hoc ways."),
    (f'<article><div class="article-header"><h1>The title</h1></div>{P}</article>', f"The title\n\n{BODY}"),
    (f'<article>{P}<div class="related-posts"><a>More</a></div><ul class="share buttons"><li>Post it</li></ul></article>', BODY),
    (f'<div class="site-header">Name of the site</div><article>{P}</article>', BODY),
    (f'<article>{P}<div class="commentList"><article class="comment"><p>First!</p></article></div></article>', BODY),
])
def test_structures(page, text):
    assert html.main_text(f"<html><body>{page}</body></html>", {}) == text


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x y z", "<span>" * 100_000 + "x", "<div><p><span>" * 30_000 + "text" + "</span></p></div>" * 30_000,
    "<ul><li>" * 50_000 + "a b", "</b>" * 100_000, "<span>" * 30_000 + "<div>x</span></div>" * 30_000,
])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    html.main_text(page, {})
    assert time.process_time() - start < 6  # a fraction of a second to two; the square would take minutes


def test_weights_decide():
    """The best region follows the learned weights: without them the long block outside wins."""
    page = f"<html><body><div><p>{BODY}</p></div><table><tr><td>{BODY} {BODY} {BODY}</td></tr></table></body></html>"
    learned = {"~p|6|False": 3.0, "~6|False": -3.0, "~td|6|False": -3.0}
    assert html.main_text(page, learned) == BODY
    assert html.main_text(page, {}) != BODY
