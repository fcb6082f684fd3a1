"""What names of elements and equal texts decide in the wrappers."""
from __future__ import annotations

import random

import pytest

from dossier.llm import html_wrappers

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("page", [
    '<body class="no-sidebar"><p>own words</p></body>', '<body class="sidebar"><p>own words</p></body>',
    '<article class="post comments-open"><p>own words</p></article>', '<div class="content with-sidebar"><p>own words</p></div>',
    '<main class="share-price"><p>own words</p></main>', '<div class="modal"><article>own words</article></div>',
    '<div class="overflow-hidden"><p>own words</p></div>', '<div style="overflow:hidden"><p>own words</p></div>',
    '<div aria-hidden="false"><p>own words</p></div>', '<div data-role="dialog"><p>own words</p></div>',
    '<div title="x hidden"><p>own words</p></div>', '<body><form><article>own words</article><input></form></body>',
    '<div hidden>x</div><p>own words</p>', '<p>own words</p><div style="color: red; display : none">x</div>'])
def test_names_do_not_empty_a_page(page):
    known = html_wrappers.slots(html_wrappers.wrapper_of(page))
    assert html_wrappers.main_text(page, known) == "own words"


def test_whole_names_still_skip():
    page = '<div class="sidebar wide">x</div><section class="comments"><p>y</p></section><nav><main>z</main></nav><p>own words</p>'
    assert html_wrappers.main_text(page, html_wrappers.slots(html_wrappers.wrapper_of(page))) == "own words"


def test_texts_on_most_pages_are_template(spark):
    page = "<body><div><p>We use cookies, read on.</p></div><div><p>story {} with words</p><p>{}</p></div></body>"
    rows = [(k, "http://t/%d" % k, page.format(k, "often" if k < 2 else "end %d" % k)) for k in range(6)]
    rows += [(k, "http://same/%d" % k, page.format(0, "x")) for k in range(10, 20)]  # copies of one page: nothing differs
    rows += [(k, "http://few/%d" % k, page.format(k, "x")) for k in range(20, 22)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    assert [got[k] for k in range(6)] == ["story %d with words %s" % (k, "often" if k < 2 else "end %d" % k) for k in range(6)]
    assert got[10] == "We use cookies, read on. story 0 with words x" and "cookies" in got[20]


@pytest.mark.parametrize("pages", [1, 2, 3, 6, 20])
def test_main_parts_keep_equal_texts_on_any_number_of_pages(spark, pages):
    page = "<body><div>Site</div><article><h2>Summary</h2><p>story %d</p></article></body>"
    rows = [(k, "http://h/%d" % k, page % k) for k in range(pages)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: "Summary story %d" % k for k in range(pages)}


def test_depth_and_length_do_not_matter(spark):
    deep = "<body>" + "<div>" * 100_000 + "deep text" + "</div>" * 50_000 + "<p>more</p>"
    rows = [(1, "http://h/1", deep), (2, "http://h/2", "<body><p>flat</p></body>"), (3, "http://h/3", deep),
            (4, "http://i/4", "<article>" + "<p>some words</p><b>x</b>" * 50_000 + "</article>"), (5, "http://h/5", "<div>" * 900 + "end")]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == got[3] == "deep text more" and got[2] == "flat" and got[5] == "end"
    assert got[4] == " ".join(["some words x"] * 50_000)


def test_wrappers_survive_writing():
    one = html_wrappers.wrapper_of("<ul><li>a</li><li>b<i>c</i></li></ul><p>x</p><div><p>y</p></div>z")
    assert html_wrappers.from_rows(html_wrappers.rows_of(one)) == one
    assert html_wrappers.aligned(one, one) == html_wrappers.aligned(html_wrappers.from_rows(html_wrappers.rows_of(one)), one)


def test_alignment_is_longest():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([[rng.choice("abcd"), "", []] for _ in range(rng.randrange(9))] for _ in range(2))
        found = html_wrappers._matches(a, b)
        assert all(a[i][0] == b[j][0] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                rows[i + 1][j + 1] = rows[i][j] + 1 if a[i][0] == b[j][0] else max(rows[i][j + 1], rows[i + 1][j])
        assert len(found) == rows[-1][-1]
