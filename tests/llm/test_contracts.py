"""Pages and texts that contracts name: parts that are no article, broken markup, signs that are no letters."""

import time

import pytest

from oddsmill.llm.html_text import main_text, tags
from oddsmill.llm.language import has_letter

STORY = "<p>" + "This is the text of a story that is long enough to be kept whole. " * 4 + "</p>"


def page(part):
    return main_text(f"<html><body><div class='page'><h1>Title</h1>{STORY}{part}{STORY}</div></body></html>")


@pytest.mark.parametrize("opening", ["form", 'div class="notice"', 'div class="gdpr-privacy-message"', 'div class="comment-thread"', 'div class="ad-slot-300x250-inarticle"', 'p class="feedback"', 'section id="share-bar"', 'div class="cookieBanner"'])
def test_parts_that_are_no_article(opening):
    words = STORY[3:-4] if opening.startswith("p ") else STORY
    assert page(f"<{opening}>{words}</{opening.split()[0]}>") == page("")


@pytest.mark.parametrize("opening", ['div class="ad-free"', 'div class="has-sidebar layout"', "form", 'div class="search"'])
def test_wrappers_of_the_text_stay(opening):
    text = main_text(f"<html><body><{opening}><h1>Title</h1>{STORY}</{opening.split()[0]}></body></html>")
    assert text.startswith("Title\n\nThis is the text")


def test_attributes_and_broken_tags():
    assert list(tags('a<b c="x>y" d=it\'s>t</B ><!-- <i> -->')) == [(1, 19, "b", False, ' c="x>y" d=it\'s'), (20, 25, "b", True, " "), (25, 37, None, False, "")]
    assert page("<p>See <a href=it's>the link</a> here, 1 < 2 and <3.</p>").split("\n\n")[2] == "See the link here, 1 < 2 and <3."
    assert "rest of it" in page('<p>An unclosed <a href="x>quote</a> and the rest of it</p>')


@pytest.mark.parametrize("broken", ["<a '", '<a x="', "<a x='\"", "<!--", "</", "<a x= <", "<form>", "<style>", "<p><b>", "<div><span>", "</i><hr>x<b>"])
def test_broken_pages_take_time_in_proportion(broken):
    began = time.process_time()
    for end in ("", ">", "\" ' >x"):
        main_text(broken * 100_000 + end)
    assert time.process_time() - began < 12


def test_letters():
    assert not any(map(has_letter, ["", "12 ½ ² ① !", "３４", "_"])) and all(map(has_letter, ["²a", "漢", "é", "ª"]))
