from __future__ import annotations

import pytest

from shelfwise.llm.html_extract import extract, main_text

LONG = "The river is wide and the people of the town go to it in the morning for water, and that was the way it is."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<!-- open", ""), ("<script>x</p>", ""),
    ("<p>a &amp; b<script>x<p>", "a & b"), ("<div>Hello<br>world", "Hello world"), ("&lt;b&gt; x &nbsp;\n y", "<b> x y"),
    ("<nav>menu</nav><p>Short text.</p><footer>f</footer>", "Short text."),
    (f"<nav><p>{LONG}</p></nav><article><h1>Title</h1><p>{LONG}</p><p>End.</p></article><footer>{LONG}</footer>", f"Title\n{LONG}\nEnd."),
    (f"<article><header><h1>T</h1></header><p>{LONG}</article><div class='comments'><p>{LONG}</p></div>", f"T\n{LONG}"),
    (f"<div id=sidebar><p>{LONG}</p></div><main><p>{LONG}<p>Two <a href='/x'>link</a> here.</main>", f"{LONG}\nTwo link here."),
    (f"<div><p>{LONG}</p><div class='ad'>Buy this now</div><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    (f"<p>{LONG}</p><ul><li><a href=a>One link</a><li><a href=b>Other link</a></ul>", LONG),
    (f"<form><p>{LONG}</p></form><p style='display:none'>{LONG}</p><p>{LONG}</p>", LONG),
    (f'<p data-class="ad">{LONG}</p><style>p{{x}}</style><title>no</title>', LONG),
    (f"<aside><p>{LONG}</p></aside></div></p><p>{LONG}", LONG),
])
def test_cases(page, text):
    assert main_text(page) == text


def test_undecided_blocks_follow_their_neighbours():
    page = f"<p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div class=menu>{LONG}</div><p>Lone.</p><div class=menu>{LONG}</div>"
    assert main_text(page) == f"{LONG}\nShort one.\n{LONG}"


def test_pathological_markup_ends():
    assert main_text("<a href='" * 3000 + "x") is not None
    assert main_text("<div>" * 5000 + "deep text") == "deep text"
    assert len(main_text(f"<article><p>{LONG * 5000}</p></article>")) == len(LONG * 5000)


def test_operator(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x", 1), (1, "u", f"<p>{LONG}</p>", "x", 1), (2, None, None, "x", 1), (None, "u", "<nav>a</nav>", "x", 1)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = sorted([tuple(r) for r in extract(spark.createDataFrame(rows, schema)).collect()], key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert extract(spark.createDataFrame([], schema)).count() == 0


RUSSIAN = "Широкая река течёт через старый город, и утром жители приходят сюда за водой, как приходили их деды. " * 3
POLISH = "Szeroka rzeka płynie przez stare miasto, rankiem mieszkańcy przychodzą tutaj po wodę, jak dawniej ich dziadkowie. " * 3
CHINESE = "宽阔的河流穿过古老的城市，每天清晨居民们来到这里取水，就像他们的祖辈一样。" * 8


@pytest.mark.parametrize("text", [RUSSIAN, POLISH, CHINESE])
def test_languages_without_listed_stop_words(text):
    text = text.strip()
    page = f"<nav><a href=a>A</a></nav><div><p>{text}</p><p>{text}</p></div><ul><li><a href=b>{text}</a></ul><footer>{text}</footer>"
    assert main_text(page) == f"{text}\n{text}"


def test_long_block_of_another_script_on_a_page_with_listed_stop_words():
    assert main_text(f"<p>{LONG}</p><p>{RUSSIAN}</p><p>{LONG}</p>") == f"{LONG}\n{RUSSIAN.strip()}\n{LONG}"


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "layout no-sidebar", "page with-menu"])
def test_names_of_layouts_mark_nothing(wrapper):
    assert main_text(f"<div class='{wrapper}'><p>{LONG}</p></div>") == LONG


@pytest.mark.parametrize("wrapper", ["content sidebar", "search", "social page"])
@pytest.mark.parametrize("name", ["article", "main"])
def test_marked_wrapper_does_not_hide_an_article(wrapper, name):
    inside = f"<{name}><p>{LONG}</p><div class=ad>{LONG}</div></{name}>"
    assert main_text(f"<div class='{wrapper}'><p>{LONG}</p>{inside}<div class=comments><article>{LONG}</article></div></div>") == LONG
    assert main_text(f"<div hidden><{name}>{LONG}</{name}></div>") == ""
    # beside an article without marks it is a teaser or a comment
    assert main_text(f"<{name}>{LONG} End.</{name}><div class='{wrapper}'><article>{LONG}</article></div>") == f"{LONG} End."


def test_paragraphs_with_many_links_inside_an_article():
    half, whole = f"{LONG[:50]}<a href=x>{LONG[50:]}</a>", f"<a href=x>{LONG}</a>"
    assert main_text(f"<article><p>{LONG}</p><p>{half}</p><p>{whole}</p><ul><li><a href=y>Next</a></ul></article>") == f"{LONG}\n{LONG}\n{LONG}"
    assert main_text(f"<div><p>{LONG}</p><p>{half}</p></div>") == LONG


P = "<p>The first part of the text is about the river and the town that it runs through in the north of the country.</p>"
Q = "<p>It was in the second year of the work that the people of the town had to leave their houses by the water.</p>"


def _text(part):
    return part[3:-4]


@pytest.mark.parametrize("wrapper", ['<div class="page-with-sidebar">', '<div class="layout-sidebar-right">', '<div class="ad-free">', '<form id="aspnetForm" action="x">',
                                     '<div class="has-sidebar no-ads">'])
def test_wrappers_that_only_mention_boilerplate_keep_the_page(wrapper):
    end = "</form>" if wrapper.startswith("<form") else "</div>"
    assert main_text(f"<html><body>{wrapper}{P}{Q}{end}</body></html>") == _text(P) + "\n" + _text(Q)


@pytest.mark.parametrize("part", ['<header class="entry-header"><h1>The title of it</h1></header>', '<div class="post-header"><h1>The title of it</h1></div>',
                                  '<section id="related-work">{}</section>', '<section id="search-algorithms">{}</section>', '<div class="side-by-side">{}</div>'])
def test_parts_of_an_article_stay(part):
    filled = part.format(Q)
    want = "The title of it" if "title" in part else _text(Q)
    assert want in main_text(f"<html><body><article>{filled}{P}</article></body></html>")


def test_code_and_lists_between_paragraphs_stay():
    code = "<pre>" + "def f(x): return g(x) + h(x)  " * 12 + "</pre>"
    names = "<ul><li>" + "granite basalt marble quartz slate " * 9 + "</li></ul>"
    text = main_text(f"<html><body><div>{P}{code}{Q}{names}{P}</div></body></html>")
    assert "return g(x)" in text and "granite basalt" in text


def test_boilerplate_still_goes():
    page = (f'<html><body><div class="site-sidebar">{Q}</div><div id="cookie-banner">{Q}</div><article>{P}<div class="related-posts">{Q}</div>'
            f'<div class="comments">{Q}</div><form>{Q}</form></article><div class="comment-list">{Q}</div></body></html>')
    assert main_text(page) == _text(P)
