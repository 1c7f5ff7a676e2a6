import re
import time

import pytest

from shelfmerge.llm.extract_text import extract_main_text, main_text

LONG = "This is a paragraph of the article with enough words to count as text in any window of lines."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<article><h1>T &amp; U</h1><p>a\n  b<b>c</b>&nbsp;d<br>e</p></article>", "T & U\na bc d e"),
        ("<nav><a>m</a></nav><article><p>x</p><div class='ad'>buy</div><p>y</p></article><footer>f</footer>", "x\ny"),
        ("<article><p>x<aside>no</aside></p><form>q<input></form><script>var a='</p>'</script><p>y</article>", "x\ny"),
        ("<article><p>one<p>two<p>three", "one\ntwo\nthree"),
        ("<article><p>x</p><section id=comments><p>rude</p></section></article><p>after</p>", "x"),
        ("<div class='page with-sidebar'><article><p>kept</p></article></div>", "kept"),
        ("<article><ul><li><a href='/x'>link one</a></li><li>two</li></ul></article>", "link one\ntwo"),
        (f"<ul><li><a href=/>menu</a></li><li><a href=/>more</a></li></ul><div><h1>Title</h1><p>{LONG}</p><p>To.</p><p>{LONG}</p></div><div class=footer>c</div>", f"Title\n{LONG}\nTo.\n{LONG}"),
        ("<p>tiny</p>", "tiny"),
        ("<div><h1>Short note</h1><p>A short paragraph here.</p><p>Another one of five words.</p></div>", "Short note\nA short paragraph here.\nAnother one of five words."),
        ("<ul><li><a href=/>only</a></li><li><a href=/>links</a></li></ul>", ""),
        ("<article><p class='related'>r</p><div class='social-history'>s</div><div class='post-comments'>c</div><p class='related'>t</p></article>", "r\ns\nt"),
        (f"<div class='has-sidebar'><div class='social'>f</div><p>{LONG}</p><div id='left-sidebar'>s</div></div>", LONG),
        ("<article>a < b <b <i>c</i> &#99999999999999999999; &#x110000; d</article>", "a < b c \ufffd \ufffd d"),
        ("<article><p title='x>y' class=\"q\">one</p><p title='odd>two</p><p>three</p></article>", "one\ntwo\nthree"),
        ("<!-- <article>no</article> --><article>yes &#233;&eacute; &lt;b&gt;</article>", "yes éé <b>"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_the_mark_is_a_prior_and_lets_nothing_between_through():
    page = "<article><p>A</p></article><p>Buy now cheap</p><article><p>B</p></article>"
    assert main_text(page) == "A\nB"
    page = "<article><p>one</p></article><p>between</p><p>them</p><article><p>two</p></article><p>after</p><p>all</p>"
    assert main_text(page) == "one\ntwo"
    teaser = f"<article><p>{LONG}</p><p>{LONG}</p></article>" + "<p><a href='/'>x y</a></p>" * 4 + "<article><p>Other</p></article>"
    assert main_text(teaser) == f"{LONG}\n{LONG}"  # a short one elsewhere does not surge
    assert main_text(teaser, window=7) == f"{LONG}\n{LONG}\nOther"


@pytest.mark.parametrize("tag", ["div", "section", "article"])
def test_links_do_not_cut_off_the_end(tag):
    close = "A closing paragraph of some sixty characters, or nearly that."
    links = "<ul>" + "<li><a href='/x'>a link of the article</a></li>" * 3 + "</ul>"
    page = f"<{tag}><p>{LONG}</p><p>{LONG}</p>{links}<p>{close}</p></{tag}><footer>Imprint</footer>"
    text = main_text(page).split("\n")
    assert text[-1] == close and text.count(LONG) == 2 and "Imprint" not in text
    twice = f"<{tag}><p>{LONG}</p>{links}<p>middle</p>{links}<p>{close}</p></{tag}>" + links + "<div><p>no</p></div>"
    kept = [t for t in main_text(twice).split("\n") if not t.startswith("a link")]
    assert kept == [LONG, "middle", close]


@pytest.mark.parametrize("mark", ["article", "div"])
def test_parts_of_names_do_not_decide(mark):
    kept = ["share-price", "ad-hoc", "comment-analysis", "newsletter-history", "shared"]
    gone = ["ad", "ad-slot", "post-comments", "comment-list", "share-buttons", "cookie-banner-2", "ads"]
    page = f"<{mark}><p>{LONG}</p>" + "".join(f"<p class='{c}'>{c} {LONG}</p>" for c in kept + gone) + f"</{mark}>"
    assert main_text(page) == "\n".join([LONG, *(f"{c} {LONG}" for c in kept)])


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>" * 100_000 + "</b>" * 100_000, "<a '" * 200_001 + ">", "<a \"'>" * 150_001, "<!--" * 200_000, "<script>" * 100_000,
     "&#" * 400_000, "<![" * 300_000, "<p class='" * 100_000 + ">", "<p" * 300_000 + ">", "<a x=\"" + "'>\" <a y='" * 100_000],
)
def test_a_megabyte_of_broken_markup_takes_linear_time(page):
    began = time.process_time()
    main_text(page)
    main_text("<article>" + page + ">")
    assert time.process_time() - began < 6


def truth(html):
    """What the test tables' pages hold between article tags, block by block."""
    import html as h

    body = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|h2|li|ul|div)[^>]*>", body)
    lines = [" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(df.selectExpr("*", "'x' as text")).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        assert got[r.page_id].text == truth(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_the_window_finds_the_same_without_marks(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    unmarked = [re.sub(r"(</?)(?:article|main)\b", r"\1div", p or "") for p in pages]
    assert sum(main_text(a) == main_text(b) for a, b in zip(pages, unmarked)) >= 0.98 * len(pages)


def test_long_and_broken(spark):
    rows = [(1, None, None), (2, "u", "<" * 100_000), (3, "u", "<article>" + "<div>" * 5000 + "deep"), (4, "u", "<article><p>" + "w " * 500_000), (4, "u", "&#xZZ;&"), (5, "u", "<p class='a" + "b" * 1000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.n_chars for r in got}[3] == 4
    assert extract_main_text(df.limit(0)).count() == 0
