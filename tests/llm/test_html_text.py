import time

import pytest

from footfall.llm.html_text import extract, main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p>First   para<b>graph</b>\n here.<br>Next line.<p>Short.</p><ul><li>One<li>Two</ul></article>"
TEXT = "Title & more First paragraph here. Next line. Short. One Two"


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<header>Site name</header><nav><a href='/'>Home</a></nav>{}<footer>&copy; 2024</footer>",
        "<div class='cookie-notice'>We use cookies, accept them please, it is a long text about cookies.</div>{}",
        "<aside>Other news</aside><div id='sidebar'><p>Side</p></div>{}<form><label>Mail</label><input></form>",
        "<script>var x = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> -->{}",
        "{}<section class='comments'><h2>Comments</h2><p>I think that this is a very nice article indeed, thank you.</p></section>",
        "<div class='ad banner'>Buy this now, it is very cheap today and only today.</div>{}<div role='complementary'>x</div>",
    ],
)
def test_only_the_article(around):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{around.format(ARTICLE)}</body></html>"
    assert main_text(page) == TEXT


def test_without_an_article_element():
    paragraphs = "".join(f"<p>This is paragraph number {k} with a good deal of text in it.</p>" for k in range(6))
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2>{paragraphs}<p>End.</p></div><div><a href='/'>Imprint</a></div></body>"
    found = main_text(page)
    assert found.startswith("Head This is paragraph number 0") and found.endswith("in it. End.") and "Link" not in found


def paragraphs(name, n):
    return "".join(f"<p>This is paragraph {name} {k} with a good deal of text in it.</p>" for k in range(n))


def test_split_content_is_kept_whole():
    found = main_text(f"<body><ul><li><a href='/'>Link</a></ul><div>{paragraphs('one', 6)}</div><div>{paragraphs('two', 4)}</div></body>")
    assert all(f"one {k} " in found for k in range(6)) and all(f"two {k} " in found for k in range(4))
    three = "".join(f"<article>{paragraphs(name, n)}</article>" for name, n in (("one", 4), ("two", 4), ("three", 2)))
    assert "three 1 " in main_text(f"<body>{three}</body>")


@pytest.mark.parametrize("name", ["content no-sidebar", "site has-banner", "post tag-news"])
def test_a_word_in_the_name_of_a_wrapper_drops_no_main_text(name):
    assert main_text(f"<body><div class='{name}'><nav>Home</nav>{ARTICLE}</div></body>") == TEXT
    assert "one 5 " in main_text(f"<body><div class='{name}'>{paragraphs('one', 6)}</div><p>Imprint</p></body>")
    comments = f"<div class='comments'><article class='comment'>{paragraphs('comment', 9)}</article></div>"
    assert main_text(f"<body><div class='{name}'>{ARTICLE}</div>{comments}</body>") == TEXT


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<nav>Home</nav>", "<!-- x", "<p", "<![weird", "<script>x"])
def test_pages_without_text(page):
    assert main_text(page) == "" or "<" not in main_text(page)


def test_long_and_deep_pages():
    start = time.time()
    assert len(main_text("<article>" + "<p>word word word.</p>" * 30_000 + "</article>")) == 30_000 * 16 - 1
    main_text("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert time.time() - start < 20


def test_table(spark):
    rows = [(1, "http://a", ARTICLE), (1, "http://a", ARTICLE), (2, None, None), (None, "http://b", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS n_chars")
    found = extract(pages).collect()
    assert sorted([tuple(r) for r in found], key=str) == sorted(
        [(1, "http://a", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "http://b", "", 0)], key=str
    )
    assert extract(pages.limit(0)).collect() == []
