"""Main text of pages: hand-made pages and the given ones."""

import html
import re

import pytest

from mercato.llm.common import read
from mercato.llm.html_extract import extract, main_text, op10_html_extract
from tests.conftest import SF_SMALL

LONG = "A paragraph with a good deal of text in it, long enough to stand for an article."
CASES = [
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<div><p>One &nbsp; two<br>three</p></div>", "One two three"),
    (f"<body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>"
     f"<div id=content><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
     f"<div class='comments'><p>{LONG} said a reader</p></div></div>"
     f"<div class=sidebar><p>About me</p></div><div id=footer>c 2020</div></body>",
     f"Title\n\n{LONG}\n\nShort.\n\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}<form><label>Mail</label><input></form><p>End &lt; here</article>"
     f"<section id=comments><article class=comment><p>{LONG}</p></article></section>",
     f"T\n\n{LONG}\n\nEnd < here"),
    (f"<form><main><p>{LONG}</p></main></form><div class='cookie-notice'>{LONG}{LONG}</div>", LONG),
    (f"<p>{LONG}</p><script>var a = '<p>no</p>';</script><style>p {{}}</style><!-- no -->", LONG),
    (f"<article><p>{LONG}</p><div class='adverts'><p>Buy</p></div><aside>Note</aside></article>", LONG),
    (f"<div class=menu><a>one</a></div><article><p>Tiny.</p></article><footer>{LONG}</footer>", "Tiny."),
    ("<p>unclosed <b>bold <i>x</p><p>next", "unclosed bold x\n\nnext"),
    ("<nav><p>only a menu</p></nav>", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert main_text(page) == text


def test_given_pages(spark):
    """In the given pages the text is the article element's."""
    pages = {r.page_id: r.html for r in read(spark, SF_SMALL, "pages").collect()}
    rows = op10_html_extract(spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split())
                  for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (2, "u", "", "x"), (2, "u", "<p>b", "x"),
            (2, "u", "<p>b", "x"), (3, "u", "<p>" + "word " * 100_000, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text[:9], r.n_chars) for r in extract(table).collect())
    assert got == [("1", "u", "", 0), ("2", "u", "", 0), ("2", "u", "b", 1), ("2", "u", "b", 1),
                   ("3", "u", "word word", 499_999), ("None", "None", "a", 1)]
    assert extract(table.limit(0)).count() == 0


REGIONS = [
    # Title and lead stand in a block of their own.
    (f"<div class=post><div class=head><h1>T</h1><p>Lead. {LONG}</p></div><div class=body>"
     + f"<p>{LONG}</p>" * 8 + "</div></div>", "\n\n".join(["T", f"Lead. {LONG}"] + [LONG] * 8)),
    (f"<div><h1>T</h1></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"T\n\n{LONG}\n\n{LONG}"),
    # Short lines at the ends of a page without structure are text.
    (f"<body><p>Hm.</p><p>- Oh?</p><p>- Ah.</p><p>- Yes?</p><p>- No!</p>" + f"<p>{LONG}</p>" * 5
     + "<p>- So?</p><p>- Yes.</p><p>- No.</p><p>- Why?</p><p>The end.</p>"
     "<p><a href=x>Home</a></p><p>&copy; 2020 us</p></body>",
     "\n\n".join(["Hm.", "- Oh?", "- Ah.", "- Yes?", "- No!"] + [LONG] * 5
                 + ["- So?", "- Yes.", "- No.", "- Why?", "The end."])),
]


@pytest.mark.parametrize("page,text", REGIONS)
def test_regions_without_article(page, text):
    assert main_text(page) == text


LINKS = "<ul><li><a href=a>One source</a><li><a href=b>Two sources</a><li><a href=c>Three sources</a></ul>"
NAMED = [
    # Names made from headings, and a list of links, are parts of the article.
    (f"<article><h1>T</h1><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG} (d)</p></section>"
     f"<div id='related-work'><p>{LONG} (r)</p></div><section id=search><p>{LONG} (s)</p></section>"
     f"<p id=menu>{LONG} (m)</p><div class=notice>{LONG} (n)</div><h2>Sources</h2>{LINKS}</article>",
     "\n\n".join(["T", LONG, "Discussion"] + [f"{LONG} ({x})" for x in "drsmn"]
                 + ["Sources", "One source", "Two sources", "Three sources"])),
    # A name with links or hardly any text is still no part, nor are reader comments.
    (f"<article><p>{LONG}</p><div class=related>{LINKS}</div><div class=share><b>Mail</b> <b>it</b></div>"
     f"<div class='comments'><p>{LONG} said a reader</p></div><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<pre><article><p>{LONG} <span class='token comment'># one</span></p></article>", f"{LONG} # one"),
    # The same in a region without an article; outside of it, names and menus say enough.
    (f"<body><div class=links>{LINKS}</div><div class=text><p>{LONG}</p><section id=search><p>{LONG} (s)</p>"
     f"</section><h2>Sources</h2>{LINKS}</div><div id=sidebar><p>{LONG}</p></div></body>",
     f"{LONG}\n\n{LONG} (s)\n\nSources\n\nOne source\n\nTwo sources\n\nThree sources"),
    (f"<body>{LINKS}<p>{LONG}</p><p>{LONG}</p><div id=sidebar><p>{LONG}</p></div>{LINKS}</body>",
     f"{LONG}\n\n{LONG}"),
]


@pytest.mark.parametrize("page,text", NAMED)
def test_named_blocks_and_links_inside_the_text(page, text):
    assert main_text(page) == text
