"""Operator 7 on HTML as it is written: left-out end tags, wrappers named by role words, comments, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.llm.html_extract import extract, extract_pages


@pytest.mark.parametrize("page, text", [
    ('<article><p class="ad">Buy<p>Real one</p><p>Real two</p></article>', "Real one\nReal two"),
    ('<ul><li class="share">Share<li>Item two<li>Item three</ul><p>End</p>', "Item two\nItem three\nEnd"),
    ('<article><ul><li>one<ul><li class="ads">buy<li>inner</ul>still one<li>two</ul></article>', "one\ninner\nstill one\ntwo"),
    ('<table><tr><td>a cell<td class="ad">buy<tr><td>c</table>', "a cell\nc"),
    ('<dl><dt>x<dd class="share">s<dt>y<dd>z</dl>', "x\ny\nz"),
    ('<article><p>a <b>bold<p class="promo">buy<div>c</div></article>', "a bold\nc"),
    ("<article><table><tr><td><p>in a cell<td>next</table>after</article>", "in a cell\nnext\nafter"),
    ("<p>one<p>two", "one\ntwo"),
])
def test_left_out_end_tags(page, text):
    assert extract(page, None) == text


@pytest.mark.parametrize("page, text", [
    ('<div class="ad-free story"><p>Long text of the page</p></div>', "Long text of the page"),
    ('<section class="widget-docs">All the text</section>', "All the text"),
    # a plain role word on what holds most of the text is a wrapper, on less it is what it says
    ('<div class="widget"><p>Most of the text of this page is here</p></div><p>more</p>', "Most of the text of this page is here\nmore"),
    ('<div class="widget"><p>buy</p></div><p>Most of the text of this page is here</p>', "Most of the text of this page is here"),
    # comments go however long they are
    ('<div><p>Short text</p></div><div id="respond">Your very long reply goes here, dear reader</div><ol class="replies"><li>Me too, and at length</ol>', "Short text"),
    ('<article><h2 id="discussion-of-ads">Ads</h2><p>x</p><div class="comments"><p>first!</p></div></article>', "Ads\nx"),
])
def test_wrappers_and_comments(page, text):
    assert extract(page, None) == text


def test_very_long_pages_and_deep_nesting():
    long = "<article>" + "<p>word &amp; word" * 50_000 + "</article>"
    assert extract(long, None) == "\n".join(["word & word"] * 50_000)
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"


def test_clashing_columns_and_repeats(spark):
    rows = [(1, "http://a.b/x", "<article><p>one<p>two</article>"), (1, "http://a.b/x", "<article><p>one<p>two</article>"), (2, None, None), (None, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted(map(str, extract_pages(pages).collect()))
    more = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "key", "template", "text", "n_chars", "token", "tokens")])
    assert sorted(map(str, extract_pages(more).collect())) == plain and sum("one\\ntwo" in r for r in plain) == 2
    assert extract_pages(pages.limit(0)).count() == 0
