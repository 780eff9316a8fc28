"""Pages in which a class name, an open tag or their size once lost the article."""
import time

import pytest

from parlance.llm import html_main

LONG = "It is the way of the world that the men and the women of it are to be with each other and not by themselves for as long as they have been in it. " * 2
PARTS = f"<h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
WANT = "\n".join(["Title", LONG.strip(), "Short one.", LONG.strip()])


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "content footer-visible", "story-related", "wrap notice-board", "page-header wide", "main"])
def test_a_class_around_the_page_loses_nothing(name):
    page = f"<body><nav><a href=/>Home</a></nav><div class='{name}'>{PARTS}<div class='sidebar'><p>{LONG[:100]}</p></div></div><div class='cookie-notice'>We use cookies</div></body>"
    assert html_main.main_text(page) == WANT
    assert html_main.main_text(f"<div class='{name}'><article>{PARTS}</article></div>") == WANT


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "related", "site-footer"])
def test_a_smaller_element_with_such_a_class_goes(name):
    assert html_main.main_text(f"<div>{PARTS}</div><div class='{name}'><p>{LONG}</p></div>") == WANT


def test_open_raw_elements_end():
    assert html_main.main_text(f"<head><title>A title<body>{PARTS}") == WANT
    assert html_main.main_text(f"<div><h1>Title</h1><button>Share<p>{LONG}</p><p>Short one.</p><p>{LONG}</p><button>Like</button></div>") == WANT
    assert html_main.main_text(f"<title>x</title>{PARTS}<select><option>One<option>Two</select><textarea>write</textarea><script>var p='<p>';</script>") == WANT


def test_inline_advert_inside_a_paragraph():
    assert html_main.main_text(f"<p>{LONG}<span class=ad>Buy this</span></p><p>{LONG}</p>") == "\n".join([LONG.strip()] * 2)


@pytest.mark.parametrize("page", ["<b><i>" * 150_000 + PARTS, "<b>x</i>" * 200_000, "<div>" * 60_000 + PARTS + "</div>" * 60_000, f"<div class=related>{PARTS * 8000}</div>", "<span></b>" * 200_000 + "</span>" * 200_000])
def test_pages_of_megabytes_take_seconds(page):
    began = time.time()
    html_main.main_text(page)
    assert time.time() - began < 20
