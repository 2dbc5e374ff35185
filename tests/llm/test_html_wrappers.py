"""Names that rule out elements, on wrappers of whole pages."""

import pytest

from tagloom.llm.html_extract import main_text

BODY = "".join(f"<p>Paragraph {i} of the text, which is long enough, with marks.</p>"
               for i in range(6))
WANT = "\n".join(f"Paragraph {i} of the text, which is long enough, with marks."
                 for i in range(6))
MENU = "<nav><p>Home, news, more.</p></nav><div class='sidebar'><p>Latest, popular.</p></div>"
COMMENTS = ("<div class='comments-area'><ol>" + "".join(
    f"<li class='comment'><article class='comment-body'><p>Answer {i}, not so.</p></article></li>"
    for i in range(40)) + "</ol></div>")
RELATED = "<div class='related'><article><p>Read this too, please.</p></article></div>"
WRAPPERS = ["post category-x tag-news", "right-sidebar page", "container comments-open",
            "site fixed-header x", "layout-side tags"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("inner", ["{}", "<article class='post tag-a'>{}</article>",
                                   "<main>{}</main>", "<div role=main>{}</div>"])
def test_wrapper_of_the_whole_page(name, inner):
    page = f"<body><div class='{name}'>{MENU}{inner.format(BODY)}</div></body>"
    assert main_text(page) == WANT


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrapper_among_others(name):
    ad = "<div class='ad'><p>Buy this, now.</p></div>"
    for inner in (BODY, f"<article>{BODY}{ad}</article>", f"<div class='tag-x'>{BODY}</div>{ad}"):
        assert main_text(f"{MENU}<div id='{name}'>{inner}</div>{ad}") == WANT


@pytest.mark.parametrize("name", [None, *WRAPPERS])
def test_comments_and_teasers_stay_out(name):
    page = f"<article>{BODY}</article>{RELATED}{COMMENTS}"
    page = f"<div class='{name}'>{page}</div>" if name else page
    assert main_text(f"<body>{MENU}{page}</body>") == WANT
    assert main_text(f"<body>{MENU}{RELATED}{page}</body>") == WANT


def test_nested_wrappers():
    page = f"<div class='has-sidebar'><div class='side'><div class='tag-x'>{BODY}</div></div></div>"
    assert main_text(f"<div class='widget-page'>{page}</div>{MENU}") == WANT


def test_small_named_elements_stay_out_without_article():
    page = f"<div>{BODY}</div><div class='comments'><p>I, for one, do not agree, at all.</p></div>"
    assert main_text(page) == WANT


@pytest.mark.parametrize("name", ["post tag-news", "widget-text"])
def test_named_element_holds_the_text_of_the_article(name):
    page = f"<article><h1>Title</h1><div class='{name}'>{BODY}</div></article>{RELATED}"
    assert main_text(MENU + page) == f"Title\n{WANT}"
