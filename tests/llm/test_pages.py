import time

import pytest

from cargolens.llm import pages as P

LONG = "This is one of the long paragraphs that the page has in it, and it is here so that the rules can see it as text. " * 2


@pytest.mark.parametrize("chrome", [
    "<nav><a href=/a>A</a> and the menu of it all</nav>", "<header><h1>The site</h1></header>",
    "<footer>&copy; the site and all of its owners</footer>", "<aside><p>" + LONG + "</p></aside>",
    "<div class='cookie-notice'>" + LONG + "</div>", "<div id=adBox>" + LONG + "</div>",
    "<form><label>Name</label><input><button>Go</button></form>", "<script>var a = '<p>" + LONG + "</p>';</script>",
    "<style>p{}</style>", "<section class=comments><article><p>" + LONG + "</p></article></section>",
    "<!-- <p>" + LONG + "</p> -->", "<div role=navigation>" + LONG + "</div>", "<div hidden>" + LONG + "</div>"])
@pytest.mark.parametrize("page", ["<body>{0}<article><h1>Title</h1><p>{1}<p>Short.</article>{0}</body>",
                                  "<body>{0}<div><h1>Title</h1><p>{1}</p><p>Short.</p></div>{0}</body>"])
def test_what_is_not_the_article_goes(chrome, page):
    assert P.main_text(page.format(chrome, LONG)) == f"Title\n\n{' '.join(LONG.split())}\n\nShort."


def test_references_white_space_and_breaks():
    page = "<article><p>a&amp;lt; &copy;x&nbsp;&#233; <b>b</b>c<br>d \n e</p><p> </p><p>3 < 4 &am &amp</p></article>"
    assert P.main_text(page) == "a&lt; ©x é bc d e\n\n3 < 4 &am &"


def test_ambiguous_blocks_take_the_label_of_decided_neighbours():
    links = "".join(f"<li><a href={i}>one more of the links</a></li>" for i in range(5))
    page = f"<body><ul>{links}<li>Odd</li>{links}</ul><p>{LONG}</p><p>Odd too</p><p>{LONG}</p></body>"
    assert P.main_text(page).split("\n\n")[1] == "Odd too" and "Odd\n" not in P.main_text(page)


def test_cut_pages_and_empty_ones():
    assert P.main_text(None) == P.main_text("") == P.main_text("<html><body></body></html>") == ""
    assert P.main_text("<article><p>whole<p>cut <a href=\"x") == "whole\n\ncut"
    assert P.main_text("<article><p>a</p><script>x") == "a"
    assert P.main_text("plain") == "plain"


@pytest.mark.parametrize("wrapper", ["class='has-sidebar'", "class=no-sidebar", "id='content-sidebar-wrap'",
                                     "class='layout sidebar'", "class='page banner-top'", "id=widget_area"])
@pytest.mark.parametrize("region", ["main", "article", "div class=entry-content"])
def test_layout_wrappers_do_not_hide_the_article(wrapper, region):
    tag = region.split()[0]
    page = (f"<body><div {wrapper}><{region}><h1>Title</h1><p>{LONG}</p><div class=share>Share</div><p>Short.</p></{tag}>"
            f"<aside><article><p>{LONG}</p></article></aside></div></body>")
    assert P.main_text(page) == f"Title\n\n{' '.join(LONG.split())}\n\nShort."


def test_teasers_in_a_marked_wrapper_do_not_join_the_article():
    page = f"<article><p>{LONG}</p></article><div class=related><article><p>{LONG} more</p></article></div>"
    assert P.main_text(page) == " ".join(LONG.split())


def test_links_and_copyright_lines_of_the_article_stay():
    inside = ["See the full report of the committee .", "© is the sign that the law asks for.", "One reference", "Two"]
    page = (f"<article><p>{LONG}</p><p>See <a href=r>the full report of the committee</a> .</p><p>{inside[1]}</p>"
            f"<ul><li><a href=1>One reference</a></li><li><a href=2>Two</a></li></ul></article><p>&copy; owners</p>")
    assert P.main_text(page).split("\n\n") == [" ".join(LONG.split()), *inside]


def test_rows(make):
    df = make([(1, "u", "<p>Hello you</p>", 5), (1, "u", "<p>Hello you</p>", 5), (2, None, None, 6)],
              "page_id int, url string, html string, n_chars int")
    got = P.extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "Hello you", 9)] * 2 + [(2, "", 0)]
    assert P.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<body><form id=aspnetForm><nav>Menu</nav><article><h1>Title</h1><p>{0}</p></article></form></body>",
    "<body><form id=aspnetForm><h1>Title</h1><p>{0}</p></form></body>"])
def test_a_form_around_the_page_does_not_hide_it(page):
    assert P.main_text(page.format(LONG)) == f"Title\n\n{' '.join(LONG.split())}"


def test_ids_made_from_titles_do_not_mark():
    parts = ["<h2 id=related-work>Related work</h2>", f"<section id=social-impact><p>{LONG}</p></section>",
             f"<section id='comments-on-the-bill'><h3 id=comments>Comments on the bill</h3><p>{LONG}</p></section>"]
    page = f"<article><p>{LONG}</p>{''.join(parts)}<section id=comments><p>{LONG}</p></section></article>"
    long_ = " ".join(LONG.split())
    assert P.main_text(page).split("\n\n") == [long_, "Related work", long_, "Comments on the bill", long_]


def test_marked_and_hidden_inline_elements_go():
    page = (f"<article><p>One <span style='display: none'>no <span>no</span> no</span>two <a class=share href=x>Share</a>"
            f"<span class=ad>buy</span>three <span>four</span> <em class=note>five</em></p><p>{LONG}<span hidden>never closed</p><p>Six</p></article>")
    assert P.main_text(page).split("\n\n") == ["One two three four five", " ".join(LONG.split()), "Six"]


def test_bare_blocks_at_both_ends_of_an_unmarked_page_go():
    page = (f"<body><div>Home</div><div>Products</div><h1>Title</h1><p>{LONG}</p><div>Between</div><p>{LONG}</p><p>Last words</p>"
            "<div>All rights reserved</div></body>")
    long_ = " ".join(LONG.split())
    assert P.main_text(page).split("\n\n") == ["Title", long_, "Between", long_, "Last words"]


@pytest.mark.parametrize("part", ["<p>short {0}</p>", "<td>{0}", "<div>{0}", "</b></i></div>{0}", "<span class=ad>{0}"])
def test_work_grows_with_the_page_alone(part):
    start = time.process_time()
    P.main_text("<body>" + "".join(part.format(i) for i in range(100_000)) + "</body>")
    assert time.process_time() - start < 15


def test_clashing_columns(make):
    df = make([(1, "x", "<p>Hi</p>", "y")], "page_id int, _html string, html string, text string")
    assert [tuple(r) for r in P.extract_pages(df).collect()] == [(1, "x", "Hi", 2)]
