import pytest

from codonlake.llm import html

TEASER = "a teaser text of about thirty words that leads to some other page and would be main text if the link around it were lost " * 2


@pytest.mark.parametrize("inner", ["div", "span", "h3", "p"])
def test_links_last_over_block_tags(inner):
    items = f"<li><a href='/x'><{inner}>{TEASER}</{inner}></a></li>" * 6
    assert html.main_text(f"<body><ul>{items}</ul></body>") == ""


@pytest.mark.parametrize(
    "page, linked",
    [
        ("<p><a href=x>one<br>two</a> three</p>", [1, 1]),
        ("<p><a href=x>one two</p><p>three four</p>", [2, 0]),
        ("<p><a href=x>one two<p>three four</p>", [2, 0]),
        ("<div><p><a href=x>one</div>two", [1, 0]),
        ("<p><a name=top>one two</p>", [0]),
        ("<a href=x><div><p>one</p>two</div></a>three", [1, 1, 0]),
    ],
)
def test_where_links_end(page, linked):
    assert [block[2] for block in html.blocks(page)] == linked
