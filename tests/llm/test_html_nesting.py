"""Broken nesting: time in proportion to the page, and the same lines as well-formed tags."""

from __future__ import annotations

import time

from attesto.llm import html_text


def test_stray_and_unclosed_tags_take_linear_time():
    for page in ("<div>" * 50_000 + "</p>" * 50_000 + "the end", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "the end", "<p>" * 50_000 + "</section>" * 50_000 + "the end"):
        began = time.perf_counter()
        assert html_text.main_text(page) == "the end"
        assert time.perf_counter() - began < 10


def test_end_tags_close_what_they_name():
    assert html_text.main_text("<article><p>one <b>two</i> three</p></article>") == "one two three"
    assert html_text.main_text("<article><div><p>kept text of the article</div></p></article><nav><p>menu</nav>") == "kept text of the article"
