import re

import pytest

from tracewright.llm import html_text

ARTICLE = "<article><h1>Title here</h1><p>First, of all: a paragraph with some words.</p><p>Second one&nbsp;&amp;\n more.</p></article>"
WANT = "Title here\n\nFirst, of all: a paragraph with some words.\n\nSecond one & more."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("<script>x('<p>no</p>')</script>", ""), ("plain words", "plain words"),
        (f"<html><body><nav><a href=x>Menu</a></nav>{ARTICLE}<footer>end</footer></body></html>", WANT),
        (f"<body class='no-sidebar'><header>Site</header><aside>side</aside><div class=\"cookie-notice\">We use cookies, many, very many, so many.</div>{ARTICLE}"
         "<form><p>Mail, please</p><input></form><section id=comments><p>I, for one, liked it, a lot, really.</p></section></body>", WANT),
        ("<div id=a><p>Short.</p></div>", "Short."),
        ("<article><p>One<p>Two<br>lines<ul><li>x<li>y</ul>tail</article>", "One\n\nTwo lines\n\nx\n\ny\n\ntail"),
        ("<article><p><b>Bold.<br><p>Next</b> one.</p></article>", "Bold.\n\nNext one."),
        ("<article><p>a &lt;b&gt; &#233;&#x41; &unknown; 1 < 2</p></article>", "a <b> éA &unknown; 1 < 2"),
        ("<article><!-- no <p>x</p> --><p title='>'>kept</p><p>cut", "kept\n\ncut"),
        ("<article><p>a &am<b>p;</b> b &amp;lt; c</p></article>", "a &amp; b &lt; c"),
        ("<article><header><h1>Masthead</h1></header><p>Body, text.</p><footer>By me</footer></article>", "Body, text."),
        ("<ARTICLE><P>Upper</P><STYLE>p{}</STYLE></ARTICLE>", "Upper"),
        ("<article><p>Text, text, text.</p><div class='share social'>Share</div><p hidden>no</p><blockquote>Quote</blockquote></article>", "Text, text, text.\n\nQuote"),
        ("<div><p>" + "<a href=x>link, link, link</a> " * 20 + "</p></div><div><p>Real text, with commas, here.</p></div>", "Real text, with commas, here."),
    ],
)
def test_extraction(page, want):
    assert html_text.extract_main_text(page) == want


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 30000 + "<p>core</p>" + "</div>" * 30000
    assert html_text.extract_main_text(deep) == "core"
    assert html_text.extract_main_text("<article>" + "<p>x</i></b>" * 30000 + "</article>").count("x") == 30000
    assert html_text.extract_main_text("<p a='" + "x" * 200000) == ""
    assert html_text.extract_main_text("<" * 100000).count("<") == 100000


def brute(page):
    """The article of the test corpus by its own template."""
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_query_gives_the_articles_of_all_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.op3_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_rows_pass_through(spark):
    rows = [(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (2, "u", "<p>x</p>", "t"), (2, "u", "<p>x</p>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extract_pages(df).collect())
    assert got == [(0, "u", "x", 1), (1, "", "", 0), (2, "u", "x", 1), (2, "u", "x", 1)]
    assert html_text.extract_pages(df.where("false")).count() == 0
