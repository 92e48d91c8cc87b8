import html
import re
import time

import pytest

from wordloom.llm.common import read_table
from wordloom.llm.text_density import extract_main_text, main_text

SF_DIR = "/root/testdata/sf0.001"
FRAME = "<html><head><title>T</title><script>if (a<b) x('</p>');</script></head><body>{}</body></html>"
LONG = "Many plain words without any link stand in this paragraph so that it is dense enough to count. "


def text_of(body):
    return main_text(FRAME.format(body))[0]


def test_boilerplate_around_an_article_goes():
    body = (
        "<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies. " + LONG + "</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>One&nbsp;two\n three.<p>" + LONG + "</article>"
        "<aside>Side</aside><section id=comments><article class=comment><p>" + LONG * 3 + "</p></article></section>"
        "<form><p>Search</p><input value=x></form><footer>&copy; foot</footer>"
    )
    assert text_of(body) == "Title & more\nOne two three.\n" + LONG.strip()


def test_boilerplate_inside_an_article_goes():
    body = f"<article><p>{LONG}</p><div class='ad banner'>Buy</div><script>x</script><p>End.</p><div class=share>Share</div></article>"
    assert text_of(body) == f"{LONG.strip()}\nEnd."


def test_article_without_semantic_elements():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(9))
    body = f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div><div><a href=/>x</a></div>"
    assert text_of(body) == "\n".join([LONG.strip()] * 3)


@pytest.mark.parametrize("wrapper", ["form id=aspnetForm", "div class='sidebar-right'", "div id=page class='menu-open'", "div role=form"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_a_wrapper_of_the_whole_page_is_no_frame(wrapper, inner):
    content = f"<{inner}><p>{LONG}</p><p>{LONG}</p></{inner}>"
    around = "<nav><a href=/>Home</a></nav><div class=sidebar><p>Side notes</p></div>"
    assert text_of(f"<{wrapper}>{around}{content}<div class=comments><p>{LONG}</p></div></{wrapper.split()[0]}>") == "\n".join([LONG.strip()] * 2)
    assert text_of(f"<main><{wrapper}>{around}{content}</{wrapper.split()[0]}></main>") == "\n".join([LONG.strip()] * 2)


def test_a_wrapper_in_a_wrapper_and_a_head_that_is_not_closed():
    assert text_of(f"<form><div class=menu-open><div class=nav-layout><p>{LONG}</p></div><footer>foot</footer></div></form>") == LONG.strip()
    assert main_text(f"<html><head><title>T</title><body><div><p>{LONG}</p></div>")[0] == LONG.strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        (" \n", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\nb"),
        ("<b>a</b> <i>b</i>c", "a bc"),
        ("<p>a<br>b</p>", "a\nb"),
        ("<p>1 < 2 &lt;b&gt; &#65;&#x42;</p>", "1 < 2 <b> AB"),
        ("<p>x<!-- <p>no</p> -->y</p>", "xy"),
        ("<p>x</p><!-- never closed <p>no</p>", "x"),
        ("<article><p>a <a title=it's href='x>y'>b</a> c</p></article>", "a b c"),
        ("<article><p>whole</p><p class=", "whole"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a\nb\nc\nd\ne"),
        ("<article><p>a</p></b></div></article>", "a"),
        ("<script>only</script>", ""),
    ],
)
def test_markup(page, text):
    assert main_text(page)[0] == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "x" * 100 + "</div>" * 5000)[0] == "x" * 100
    long = "word " * 200_000
    assert main_text(f"<article><p>{long}</p></article>")[0] == long.strip()
    assert main_text("<a href='" * 3000)[0] == ""


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (3, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, threshold string")
    found = extract_main_text(pages)
    assert found.columns == ["page_id", "url", "text", "threshold"]
    assert sorted((str(r.page_id), r.text) for r in found.collect()) == [("1", "a"), ("1", "a"), ("3", ""), ("None", "")]
    assert extract_main_text(pages.limit(0)).count() == 0


def by_template(page):
    """The pages of the test tables hold one article; its lines are its blocks."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    lines = re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?p>|</?h1>", "\n", inner)).split("\n")
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in lines) if t)


def test_all_pages(spark):
    pages = read_table(spark, SF_DIR, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    found = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert found == {k: by_template(v) for k, v in source.items()}


@pytest.mark.parametrize(
    "page",
    ["<b>" * 20000, "<a " * 40000, "<b>" * 20000 + "<h2>" * 20000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000, "<script>" + "</script " * 40000, "<li>" + "<b>" * 20000 + "<h2>" * 20000],
)
def test_tags_that_do_not_end_take_linear_time(page):
    def taken(times):
        start = time.perf_counter()
        main_text(page * times)
        return time.perf_counter() - start

    taken(1)
    assert taken(4) < 8 * max(taken(1), 0.1)


def test_what_stands_after_the_last_tag():
    assert main_text("<p>a</p>b <c d")[0] == "a\nb"
    assert main_text("<p>a</p>b < c <!-- d")[0] == "a\nb < c"
