"""Main text under other names, with furniture and content that no list knows, and from broken html."""

import re
import time

import pytest

from maskloom.llm import mainext

SF = "/root/testdata/sf0.01"
MENU = '<div class="qq"><a href="/1">Home</a> <a href="/2">About us</a> <a href="/3">Shop</a></div>'
COMMENTS = "<div class='kx'><h3>Responses</h3>" + "".join(
    f"<div class='ky'><b>{who}</b><p>{says}</p><a href='#'>Reply</a></div>" for who, says in (("Bob", "Liked this a lot."), ("Eve", "Not sure, really."))
) + "</div>"
PROSE = "<p>Words of some length, and more of them. A second sentence follows, then it ends.</p>"


@pytest.fixture(scope="module")
def learnt(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seen = pages.where("page_id < 150")
    return mainext.train(seen), [r["html"] for r in pages.where("page_id >= 200").orderBy("page_id").limit(40).collect()]


def article_text(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|section|div)\b[^>]*>", re.sub(r"</?(?:b|math|mi)>", "", inner).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(mainext.html.unescape(b).split()) for b in blocks) if x)


PROBES = {
    "as it is": (lambda h: h, lambda h: h),
    "another container": (lambda h: h.replace("<article>", '<div class="zz1">').replace("</article>", "</div>"), lambda h: h),
    "listed word on a paragraph": (lambda h: h.replace("<p>", '<p class="related-work">', 1), lambda h: h),
    "prose in a form section": (
        lambda h: h.replace("</h1>", f'</h1><section class="form">{PROSE}</section>'), lambda h: h.replace("</h1>", f"</h1>{PROSE}")
    ),
    "formula": (lambda h: h.replace("</article>", "<p>so <math><mi>x</mi></math> is</p></article>"), ) * 2,
    "unlisted menu inside": (lambda h: h.replace("</article>", MENU + "</article>"), lambda h: h),
    "unlisted menu before": (lambda h: h.replace("<article>", MENU + "<article>"), lambda h: h),
    "unlisted comments": (lambda h: h.replace("</article>", "</article>" + COMMENTS), lambda h: h),
    "all at once": (
        lambda h: h.replace("<article>", MENU + '<div class="b1">').replace("</article>", "</div>" + COMMENTS), lambda h: h
    ),
}


@pytest.mark.parametrize("name", PROBES)
def test_structure_decides(learnt, name):
    model, pages = learnt
    change, kept = PROBES[name]
    right = [mainext.extract([change(page)], model)[0] == article_text(kept(page)) for page in pages]
    assert sum(right) >= len(right) - 1


@pytest.mark.parametrize("source", [
    "<a " * 350_000, '<a "' * 250_000, "<div>" * 60_000 + "</b>" * 150_000, "<a '<a \"" * 120_000, "<!" * 500_000, "<p><b>" * 60_000,
])
def test_broken_html_takes_linear_time(source):
    start = time.process_time()
    mainext.parse(source)
    assert time.process_time() - start < 2


def test_odd_tables(spark, learnt):
    model, pages = learnt
    rows = [(1, "u", None), (None, "u", ""), (1, "u", pages[0]), (1, "u", pages[0]), (2, None, "<p>" + "word, more. " * 200_000)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = mainext.main_texts(frame, model).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and max(r["n_chars"] for r in got) == 2_399_999
    assert [r["text"] for r in got].count(article_text(pages[0])) == 2
    assert mainext.main_texts(frame.limit(0), model).collect() == [] and mainext.train(frame.limit(0)) is None
