"""Titles, short sections and unclear marks of pages."""

import pytest

from lemmagraph.llm.htmltext import main_text

P = "<p>" + "Long words, of a first paragraph here. " * 4 + "</p>"
Q = "<p>" + "And of a second one, which goes on and on. " * 4 + "</p>"


def begins(html):
    return [x[:10] for x in main_text(html).split("\n")]


@pytest.mark.parametrize(
    "html",
    [
        f'<body><h1>Title</h1><div class="content">{P}{Q}</div>',
        f'<body><h1>Title</h1><div class="wrap"><div class="content">{P}{Q}</div></div>',
        f'<body><div class="top"><h1>Title</h1></div><div><div class="content">{P}{Q}</div></div>',
        f"<body><nav>One, two</nav><h1>Title</h1><div>{P}{Q}</div><footer>Foot</footer>",
    ],
)
def test_a_title_beside_the_text_is_kept(html):
    assert begins(html) == ["Title", "Long words", "And of a s"]


def test_short_sections_are_kept():
    short = "<p>Short one, not long</p><ul><li>one</li><li>two</li></ul>"
    longer = "<p>This one, too, has words, some of them plain, and ends here with a little more text.</p>"
    assert begins(f"<div id=c><section><h2>A</h2>{P}{Q}</section><section><h2>B</h2>{short}</section></div>") == ["A", "Long words", "And of a s", "B", "Short one,", "one", "two"]
    assert begins(f"<div id=c><section><h2>A</h2>{P}{Q}</section><section><h2>B</h2>{longer}</section></div>") == ["A", "Long words", "And of a s", "B", "This one, "]
    table = "<table><tr><th>Year</th><th>Value</th></tr><tr><td>1999</td><td>7</td></tr></table>"
    assert begins(f"<div>{P * 4}{Q * 4}</div><div><h2>Results</h2>{table}</div>")[8:] == ["Results", "Year", "Value", "1999", "7"]
    assert begins(f"<div>{P}</div>{table}<div>{Q}</div>") == ["Long words", "Year", "Value", "1999", "7", "And of a s"]


LINKS = "<a href=a>One</a>, <a href=b>Two</a> <a href=c>Three</a>"


@pytest.mark.parametrize("name", ["page-menu", "page-sidebar", "sidebar-wrapper", "menu-wrap"])
def test_unclear_marks_go_by_their_links(name):
    for inside in (LINKS, "Four short words"):
        assert begins(f'<main><div class="{name}">{inside}</div>{P}{Q}<div class="{name}">{inside}</div></main>') == ["Long words", "And of a s"]
        assert begins(f'<article>{P}<div class="{name}">{inside}</div>{Q}</article>') == ["Long words", "And of a s"]
    assert begins(f'<body><nav>x</nav><div class="{name}">{P}{Q}</div>') == ["Long words", "And of a s"]


def test_joined_marks_and_related_links_go():
    comments = '<ol class="commentlist"><li>' + "Bad comment, long and bad. " * 9 + "</li></ol>"
    assert begins(f"<main>{P}{Q}{comments}</main>") == ["Long words", "And of a s"]
    assert begins(f"<div>{P}{Q}</div><div><h3>More to read</h3>{LINKS}</div>") == ["Long words", "And of a s"]


def test_formulas_inside_a_paragraph_stay():
    html = f"<article>{P}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math>, as said.</p></article>"
    assert main_text(html).split("\n")[1] == "So x=1, as said."
