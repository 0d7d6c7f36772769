"""Main-text extraction: blocks, the field, held-out layouts and the given pages."""

import html as entities
import itertools
import random
import re

import numpy as np
import pytest

from __spark_entry__ import queries
from hearthline.llm import labelled_pages as lp
from hearthline.llm import main_text as mt
from hearthline.llm.dom import blocks

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, n_chars long"


@pytest.fixture(scope="module")
def model():
    return mt.fit(lp.labelled_pages([], 0, 700))


def texts(html):
    return [b.text for b in blocks(html)]


@pytest.mark.parametrize("html, expected", [
    ("<p>a &amp; b&nbsp;&lt;c&gt; &#233;&#x4e2d; &copy", ["a & b <c> é中 ©"]),
    ("<p>one<b>two</b> <i> three</i><br>four\n\t five<p>six", ["onetwo three four five", "six"]),
    ("<script>var x = '<p>no</p>';</script><style>p{}</style>yes<!-- <p>no</p> --><!-->more<!doctype html>", ["yesmore"]),
    ("<SCRIPT>no", []),
    ("<head><title>no</title><meta a='>'></head><body>x<template>no</template></body>", ["x"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><th>g</table>", list("abcdefg")),
    ("<div>a<p>b</div>c</p>d</b></i>", ["a", "b", "cd"]),
    ('<a title="1 > 2" href=x>link</a> 3 < 4 <p class="unfinished', ["link 3 < 4"]),
    ("", []), ("   ", []), ("plain", ["plain"]), ("<", ["<"]), ("<p", []), ("</p>x", ["x"]),
    ("<svg><text>no</text></svg><div hidden>h</div>", ["h"]),
])
def test_blocks(html, expected):
    assert texts(html) == expected


def test_blocks_know_their_links_and_elements():
    found = blocks('<nav id="top7" class="Menu"><ul><li><a href="/">Home</a> now<li>x</ul></nav><div hidden>y')
    assert [(b.path, b.link_chars) for b in found] == [
        ("/nav>Menu top0/ul>/li>", 4), ("/nav>Menu top0/ul>/li>", 0), ("/div> ~hidden", 0)]


def test_quoting_does_not_take_quadratic_time():
    assert texts("<a " * 100_000) == [] and texts('<a b="' * 30_000 + "<p>x") is not None
    assert len(texts("<div>" * 2000 + "x")) == 1 and texts("<" * 20_000) == ["<" * 20_000]


def test_viterbi_finds_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        for _ in range(20):
            scores, trans, start = rng.normal(0, 2, n).tolist(), rng.normal(0, 1, (2, 2)), float(rng.normal())

            def value(labels):
                return (sum(s for s, y in zip(scores, labels) if y) + start * labels[0]
                        + sum(trans[a, b] for a, b in itertools.pairwise(labels)))

            best = max(itertools.product((0, 1), repeat=n), key=value)
            assert mt.viterbi(scores, trans, start) == list(best)


def test_held_out_layouts(model):
    layouts, scorer, wrong, total = lp.Layouts(500, [], []), mt.Scorer(model), 0, 0
    for _ in range(200):
        html, labels = layouts.page()
        found = blocks(html)
        if len(found) == len(labels):
            total += len(labels)
            wrong += sum(a != b for a, b in zip(scorer.decode(found), labels))
    assert total > 3000 and wrong <= 0.01 * total


PARAGRAPHS = ["The harbour was closed for three days while divers looked for the lost anchor of the ferry.",
              "On Friday they found it, only a few metres from the pier, and the first boats left again at noon."]


@pytest.mark.parametrize("page", [
    "<nav><a href=/>Home</a></nav><article><h1>T</h1>{}</article><footer>© 2024</footer>",
    "<header><p>Site name</p></header><main><h1>T</h1>{}</main><aside><h3>Most read</h3><p>" + PARAGRAPHS[0] + "</p></aside>",
    "<div class=cookie-notice><p>We use cookies to give you the best experience on our site.</p></div><article><h1>T</h1>{}"
    "<section class=comments><h3>2 comments</h3><div class=comment><p>" + PARAGRAPHS[1] + "</p></div></section></article>",
    "<div class=menu><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></div><div class=post-content><h1>T</h1>{}</div>"
    "<form><label>E-mail</label><input><button>Subscribe</button></form><div class=footer>All rights reserved</div>",
    "<article><h1>T</h1>{}<div class='ad'>" + PARAGRAPHS[0] + "</div></article><div id=sidebar><ul><li>Popular</ul></div>",
])
def test_written_pages(model, page):
    html = page.format("".join(f"<p>{p}</p>" for p in PARAGRAPHS))
    assert mt.main_blocks(html, mt.Scorer(model))[0] == ["T", *PARAGRAPHS]


def test_given_pages(spark):
    """The pages of the table mark their article; the query must return it to the letter."""
    found = {r.page_id: r for r in queries()["op11_main_text"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", article.replace("<br>", " ")))
        expected = "\n\n".join(t for t in (" ".join(entities.unescape(p).split()) for p in parts) if t)
        assert (found[r.page_id].text, found[r.page_id].url, found[r.page_id].n_chars) == (expected, r.url, len(expected))


def test_odd_pages(spark):
    long_page = "<article><h1>T</h1>" + "".join(f"<p>{random.Random(i).choice(PARAGRAPHS)} {i}</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", long_page), (3, "u", long_page), (4, "u", "<nav>only</nav>"),
            (5, "u", "<article><p>" + "x" * 300_000 + "</p></article>"), (6, "u", "\x00<&#0;&bogus;")]
    pages = spark.createDataFrame([(*r, "text", 1) for r in rows], SCHEMA)
    found = mt.extract_main_text(pages).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    assert (by_id[1].text, by_id[2].text, by_id[2].url, by_id[4].text) == ("", "", None, "")
    assert by_id[3].n_main == 5001 and by_id[5].n_chars == 300_000
    assert mt.extract_main_text(pages.limit(0)).count() == 0
