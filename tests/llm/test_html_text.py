import pytest

from capaflow.llm import html_text as H
from capaflow.llm.catalog import op2_html_text

LONG = "This paragraph is long enough for a surge, with eighty characters and some more of them to be sure."


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.<br><p>End</article><footer>f</footer>", f"Title\n{LONG}\nShort.\nEnd"),
    # no article element: from the surge to the dive
    (f"<div class=menu><a>One</a></div><div><h2>T</h2><p>{LONG}</p><p>s</p></div><div id=comments><p>{LONG}</p></div>", f"T\n{LONG}\ns"),
    (f"<body><div id='cookie-notice'>{LONG}</div><div>{LONG}</div><aside>{LONG}</aside><form>{LONG}</form>", LONG),
    (f"<main><header><h1>H</h1></header><p>{LONG}</p></main><header>{LONG}</header>", f"H\n{LONG}"),
    (f"<div class='entry-header'><h1>H</h1></div><div class='has-sidebar'><p>{LONG}</p></div>", f"H\n{LONG}"),
    # references, white space, scripts with markup, comments, a page cut off
    (f"<p>a &amp; b &lt;c&gt; &#233;&nbsp;x\n\t y {LONG}</p><script>var t='<p>no</p>'</script><!-- <p>no</p> --><p>z &am", f"a & b <c> é x y {LONG}\nz &am"),
    (f"<p>{LONG}</p><p>cut <b", f"{LONG}\ncut"),
    ("<article><h1>Tiny</h1><p>No.</article><footer>" + LONG + "</footer>", "Tiny\nNo."),
    ("<p>short page</p>", "short page"),
    (f"<ul><li>one {LONG}<li>two</ul>", f"one {LONG}\ntwo"),
    (f"<article><p>{LONG}<p>A <a href=x>link</a> inside<ul><li><a>only link</a></ul><p>end</article>", f"{LONG}\nA link inside\nonly link\nend"),
    (f"<div class=widget><p>{LONG}</p></div>", LONG),  # a name alone does not empty a page
    (f"<div class=wrap><p>{LONG}</p><article class=comment><p>{LONG}</p></article></div>", LONG),
    ("plain text without markup", "plain text without markup"),
    ("", ""), (None, ""), ("<script>x", ""), ("<p> \n </p>", ""),
])
def test_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><p>{LONG}{LONG}</p><div class=ad>x</div><p>He died in 1990.</p></div>", f"{LONG}{LONG}\nHe died in 1990."),
    (f"<body><h1>T</h1><div class=share>s</div><div><p>{LONG}</p><p>s</p></div>", f"T\n{LONG}\ns"),
    (f"<div><p>{LONG}</p><div class=share>s</div><h2>H</h2><ul><li>one</ul><div class=related>r</div><section><p>end</p></section></div>",
     f"{LONG}\nH\none\nend"),
    (f"<div><div>{LONG}</div><div>{LONG}</div><div class=ad>x</div><div>He died.</div></div>", f"{LONG}\n{LONG}\nHe died."),
    # a short article in parts
    ("<div><p>Short one.</p><div class=ad>x</div><p>Short two.</p></div>", "Short one.\nShort two."),
    # what lies in no box of the article stays out
    (f"<div><div>Slogan</div><nav>n</nav><div><p>{LONG}</p><p>s</p></div><div class=social>f</div><div><p>Imprint</p><p>x</p></div></div>",
     f"{LONG}\ns"),
])
def test_removed_elements_do_not_cut_an_article(page, text):
    assert H.main_text(page) == text


LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Topic number {k}</a></li>" for k in range(6)) + "</ul>"


@pytest.mark.parametrize(("page", "text"), [
    # unmarked lists of links go, before, between and after
    (f"<article>{LINKS}<h1><a href=x>T</a></h1><p>{LONG}</p>{LINKS}<p>End.</p>{LINKS}</article>", f"T\n{LONG}\nEnd."),
    (f"<main><div>{LINKS}</div><div><h2><a href=x>T</a></h2><p>{LONG}</p><p><a href=x>Source</a></p></div></main>", f"T\n{LONG}\nSource"),
    # so do short blocks apart from the text, but not the article's own ones
    (f"<article><div>By J</div><div class=share>s</div><div><p>{LONG}</p><p>e</p></div><div class=ad>x</div><div><p>Not</p><p>ice</p></div></article>",
     f"By J\n{LONG}\ne"),
    (f"<article>{LINKS}</article>", "\n".join(f"Topic number {k}" for k in range(6))),
])
def test_surge_and_dive_decide_inside_an_article(page, text):
    assert H.main_text(page) == text


def test_stretches_by_surge_and_dive():
    assert H.stretches([5, 5, 0, 0, 0, 90, 3, 0, 2, 0, 0, 0, 4]) == [(5, 9)]
    assert H.stretches([5, 5, 0, 0, 0, 4]) == [(0, 2)]
    assert H.stretches([]) == [] == H.stretches([0, 0])


def test_very_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 30_000 + "</article><footer>f</footer>"
    assert H.main_text(page) == "\n".join([LONG] * 30_000)
    assert H.main_text("<div>" * 20_000 + LONG) == LONG


def test_query(spark, folder):
    rows = [(1, "u", f"<article><p>é{LONG}</article>", "x", 1), (2, None, None, "y", 2), (None, "u", "", "z", 3), (1, "u", f"<article><p>é{LONG}</article>", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = op2_html_text(spark, folder(pages=pages)).collect()
    assert sorted((str(r.page_id), r.n_chars, r.text) for r in got) == sorted(
        [("1", len(LONG) + 1, f"é{LONG}")] * 2 + [("2", 0, ""), ("None", 0, "")])
    assert op2_html_text(spark, folder(pages=pages.where("false"))).count() == 0
    assert H.extract(pages, keep=("page_id", "text")).columns == ["page_id", "text", "n_chars"]


def test_stray_and_deep_tags_take_linear_time():
    """End tags that close nothing, or cannot reach what they would close, cost nothing however deep the page is."""
    import time
    n = 40_000
    for page in ("<div>" * n + "</x>" * n + "text" * 30, "<a>" + "<div>" * n + "</a>" * n + "text" * 30, "<b>" * n + "<hr>" * n + "text" * 30,
                 "<li><article>" + "<div>" * n + "</li>" * n + "text" * 30, "<ul>" + "<li><b>" * n + "text" * 30):
        began = time.process_time()
        assert H.main_text(page) == ("" if page.startswith("<a>") else "text" * 30)   # all of it is a link's text
        assert time.process_time() - began < 20
