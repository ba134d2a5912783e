"""HTML extraction against a plain version, on pages of several makes."""

from __future__ import annotations

import html
import random
import re
import time
from pathlib import Path

import pytest

from ebbtide.llm import html_text
from ebbtide.llm.html_text import main_text

ONE = "The ships of the old harbour were moored along the wall, and the men who worked on them had not been paid for a month, so they sat on the quay and waited."
TWO = "It was said that the owners had sold the fleet to a company from the north, which is why the men would not leave the boats, and so it was for all of the winter."
NOTICE = "We use cookies on this site so that it is as good as it can be for you and for all of the others who are on it, and this is how it has to be for us."
FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def plain(page):
    """Pages with one flat article: cut out, split at its block tags."""
    body = page[page.index("<article>") : page.index("</article>")]
    parts = re.split("</?(?:p|h1|h2|li|ul|article|blockquote)>", body)
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if t)


def random_page(seed):
    r = random.Random(seed)

    def words(n):
        return " ".join(r.choice(ONE.split() + ["R&amp;D", "caf&eacute;", "a&nbsp;b", "&#8212;", "x\n\t y", "<b>bold</b>", "<i>it", "<a href='/z'>link</a>"]) for _ in range(n))

    boxes = [
        f"<nav><ul><li><a href=/a>{words(2)}</a></li><li><a href=/b>More</a></ul></nav>", f"<div class='ad'>{words(30)}</div>", f"<aside>{words(40)}</aside>",
        f"<div id=cookie-notice><p>{NOTICE}</p></div>", f"<form action=/s><label>Mail</label><p>{words(25)}</p><input name=q></form>", "<script>if (a < b) x('</p>');</script>",
        f"<section class='comments'><h3>Comments</h3><p>{TWO}</p></section>", "<style>p > a {margin:0}</style>", f"<!-- {ONE} -->", f"<header><h1>Site</h1>{words(9)}</header>",
    ]
    article = f"<article><h1>{words(5)}</h1>" + "".join(r.choice([f"<p>{words(n)}</p>", f"<p>{words(n)}", f"<blockquote>{words(n)}</blockquote>", f"<h2>{words(2)}</h2>"]) for n in [60, *r.choices(range(1, 90), k=8)])
    r.shuffle(boxes)
    cut = r.randrange(len(boxes))
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(boxes[:cut])}{article}</article>{''.join(boxes[cut:])}<footer>&copy; {words(20)}</footer></body></html>"


def test_marked_articles_equal_the_plain_version():
    for seed in range(60):
        page = random_page(seed)
        assert main_text(page) == plain(page)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_given_pages_equal_the_plain_version(spark):
    pages = spark.read.parquet(str(FOLDER / "pages.parquet"))
    rows = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    given = pages.collect()
    assert len(rows) == len(given)
    for r in given:
        assert rows[r["page_id"]]["text"] == plain(r["html"])
        assert rows[r["page_id"]]["url"] == r["url"]


def test_pages_without_an_article_element():
    page = f"""<body class="has-sidebar"><div class="site-header"><h1>Site</h1></div><div id=topNav><a href=a>One</a> <a href=b>Two</a></div>
    <div class=x1><h2>Old ships</h2><p>{ONE}</p><p>Short one.</p><p>{TWO} <a href=z>more</a></p><ul><li>and a point</li></ul></div>
    <div class="sideBar"><p>{ONE}</p></div><div class=x2><a href=1>First story of the week</a> <a href=2>Second story of the week</a></div>
    <div id="comments"><p>{TWO}</p></div><div role="alert">{NOTICE}</div><div><p>Copyright 2020 The owners</p></div></body>"""
    assert main_text(page) == "\n\n".join(["Old ships", ONE, "Short one.", f"{TWO} more", "and a point"])


def test_neighbours_decide_short_blocks():
    page = f"<div><p>{ONE}</p><p>He left.</p><p>{TWO}</p></div><div><p><a href=a>{ONE}</a></p><p>Menu of the day</p><p><a href=b>{TWO}</a></p></div>"
    assert main_text(page) == f"{ONE}\n\nHe left.\n\n{TWO}"


def test_a_form_or_class_around_the_article_does_not_hide_it():
    assert main_text(f"<form id=f><div class=nav>x</div><h1>Title</h1><p>{ONE}</p></form>") == f"Title\n\n{ONE}"
    assert main_text(f"<div class='sidebar left'><article><h1>Title</h1><p>{ONE}</p></article></div>") == f"Title\n\n{ONE}"
    assert main_text(f"<main><p>{TWO}</p><aside class=related><article><p>{ONE}</p></article></aside></main>") == TWO


def test_other_languages_are_judged_by_length():
    text = "Старые корабли стояли вдоль стены гавани, и люди не получали денег уже месяц. " * 3
    assert main_text(f"<div>{text}</div><footer>низ</footer>") == text.strip()


def test_breaks_and_broken_markup():
    assert main_text(f"<article>{ONE}<br>same<br><br>{TWO}</article>") == f"{ONE} same\n\n{TWO}"
    assert main_text("<article>1 < 2 &lt; 3 & 4 <!-- open <b>bold</b></article>") == "1 < 2 < 3 & 4 bold"
    assert main_text('<article><a href="x>y</a> text') == "y text"
    assert main_text("<article>before<script>var a = 1;") == "before"
    assert main_text("<article>a<textarea>b</article>") == "ab"
    assert main_text("<article><P CLASS='Ad'>no</P><p hidden>no<p style='display: none'>no</p>yes</article>") == "yes"


@pytest.mark.parametrize("part", ["<div>", "<!--", '<a "', "<b><p>", "<textarea>", "</p>", "<", "<div class=ad><h1>", "<a href=x><div>x", "</script", "<p>x"])
def test_time_grows_with_the_page(part):
    began = time.time()
    main_text(part * 50_000)
    assert time.time() - began < 20


def test_awkward_rows(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 2), (None, "v", "no tags & all", 3), (4, "w", f"<article>{'<p>long words ' * 60_000}</article>", 4), (5, "x", "  <p> </p>\x00", 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int").repartition(2)
    out = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract_text(pages).collect()}
    assert html_text.extract_text(pages).count() == 6
    assert out[1, "u"] == out[2, None] == ("", 0)
    assert out[None, "v"] == ("no tags & all", 13)
    assert out[4, "w"][1] == 60_000 * 12 - 2
    empty = html_text.extract_text(spark.createDataFrame([], pages.schema))
    assert empty.columns == ["page_id", "url", "text", "n_chars"]
    assert empty.collect() == []
