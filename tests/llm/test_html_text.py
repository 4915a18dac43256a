"""Main text of pages: markup, templates of hosts, odd pages."""

import re
from html import unescape

import pandas as pd
import pytest
from conftest import DATA

from variegate.llm import html_text as h
from variegate.llm.queries import op9_site_templates


def text_of(page, template=()):
    root = h.parse(page)
    h.hash_subtrees(root)
    return h.main_text(root, set(template))


@pytest.mark.parametrize(("page", "expected"), [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"),
    ("<p>a &amp; b&nbsp;c &#x41;&lt;p&gt;</p>", "a & b c A<p>"),
    ("<div>x<br>y <b>z</b>w</div>", "x y zw"),
    ("<nav>menu</nav><div class='side-bar ad'>ad</div><p>t</p><footer>f</footer>", "t"),
    ("<body><header>site</header><article><header><h1>T</h1></header><p>x</p></article>z</body>",
     "T\n\nx"),
    ("<article><p>x</p><aside>no</aside><form>no</form><div id=comments><p>no</div></article>", "x"),
    ("<article>a<article class=comment>no</article></article>", "a"),
    ("<script>if (a<b) '<p>no</p>'</script><style>p{}</style><p>yes", "yes"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<p title='a > b'>x</p>", "x"), ("1 < 2 and <3", "1 < 2 and <3"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ("</p></div>a<//p>", "a<//p>"), ("<div role=navigation>no</div>b", "b"),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<p>É x\t\ty</p>", "É x y"),
    ("<h1>Ads</h1><p class='lead'>platform</p>", "Ads\n\nplatform"),
    ("<div class='layout has-sidebar'><article><p>x</p></article></div>", "x"),
    ("<article><div class='article-header'><h1>T</h1></div><p>x</p></article>", "T\n\nx"),
    ("<main><p>lead</p><article><p>more</p></article></main>", "lead\n\nmore"),
    ("<article><p class='search-results'>found</p><p class='no-ads legal-news'>news</p></article>",
     "found\n\nnews"),
    ("<main><p>one</p></main><div><main><p>two</p></main></div><article>three</article>",
     "one\n\ntwo\n\nthree"),
    ("<div id='sidebar'><article><p>x</p></article><nav>no</nav></div>", "x"),
    ("<main><p>x</p><div class='cookie-banner'>no</div><div class='site-footer'>no</div>"
     "<div class='related-posts'><article>no</article></div><div class='adSlot'>no</div></main>", "x"),
    ("<aside><article>no</article></aside><p>x</p>", "x"),
])
def test_pages(page, expected):
    assert text_of(page) == expected


def test_deep_and_long():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert text_of(deep) == "x"
    assert len(text_of("<p>" + "word " * 300_000)) == 5 * 300_000 - 1


def test_template_by_host(spark):
    """A block without any mark goes if it recurs on a host, and stays elsewhere."""
    box = "<div><a href=/x>About this site</a></div>"
    rows = [(i, f"http://a.org/{i}", f"<div>own {i}</div>{box}<p>text {i}</p>", 0) for i in range(20)]
    rows += [(50, "http://b.org/", f"{box}<p>b</p>", 0), (51, None, f"{box}<p>n</p>", 0)]
    rows += [(60 + i, f"http://c.org/{i}", f"{box}<article><p>same</p><p>own {i}</p></article>", 0)
             for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, hash int")
    found = {r.page_id: r.text for r in h.extract(df).collect()}
    assert len(found) == len(rows)
    assert found[3] == "own 3\n\ntext 3"
    assert found[50] == "About this site\n\nb" and found[51] == "About this site\n\nn"
    assert found[62] == "same\n\nown 2"  # a repeated paragraph of the article is text


def test_template_in_main_beside_articles(spark):
    """What recurs in a main element goes where an article holds the text, and stays elsewhere."""
    rows = [(i, f"http://a.org/{i}", f"<main><div>Read our paper</div><article><p>own {i}</p></article></main>")
            for i in range(8)]
    rows += [(20 + i, f"http://b.org/{i}", f"<main><div>Read our paper</div><p>own {i}</p></main>")
             for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in h.extract(df).collect()}
    assert found[3] == "own 3" and found[23] == "Read our paper\n\nown 3"
    off = {r.page_id: r.text for r in h.extract(df, least_pages=1000).collect()}
    assert off[3] == "Read our paper\n\nown 3"


def test_copies_of_a_page_count_once(spark):
    rows = [(i, "http://a.org/", "<div>all of it</div>") for i in range(30)]
    rows += [(100 + i, f"http://a.org/{i}", f"<p>own {i}</p>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.text for r in h.extract(df).collect()} == {"all of it", "own 0", "own 1", "own 2"}


def test_counts_against_loops(spark):
    """By host, the different pages that hold a subtree; the threshold grows with their root."""
    box = "<div>shared box</div>"
    rows = [(i, f"http://a.org/{i}", (box if i % 10 == 0 else "") + f"<p>own {i}</p>") for i in range(200)]
    rows += [(1000 + i, f"http://b.org/{i}", (box if i % 10 == 0 else "") + f"<p>own {i}</p>") for i in range(150)]
    rows += rows[:50]
    pages: dict = {}
    for _, url, page in rows:
        pages.setdefault(url.split("/")[2], set()).add(page)
    gone = {host for host, own in pages.items()
            if (n := sum(box in p for p in own)) >= h.LEAST_PAGES and n >= len(own) ** 0.5}
    assert gone == {"a.org", "b.org"}
    few = rows[200:] + [(5000 + i, f"http://b.org/more{i}", f"<p>more {i}</p>") for i in range(100)]
    for table, left_in in ((rows, set()), (few, {"a.org", "b.org"})):
        df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(5)
        kept = {r.url.split("/")[2] for r in h.extract(df).collect() if "shared box" in r.text}
        assert kept == left_in


def test_query_is_the_article(spark):
    found = op9_site_templates(spark, DATA).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{DATA}/pages.parquet").set_index("page_id")
    assert len(found) == len(pages)
    for page_id, page in pages.html.items():
        inner = page[page.index("<article>") + 9:page.index("</article>")]
        parts = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", x))).strip()
                 for x in re.split(r"</?(?:p|h1)>", inner)]
        expected = "\n\n".join(x for x in parts if x)
        assert found.text[page_id] == expected and found.n_chars[page_id] == len(expected)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None), (1, "x", ""), (1, "x", "")],
                               "page_id long, url string, html string")
    assert [r.text for r in h.extract(df).collect()] == [""] * 3
    assert h.extract(df.limit(0)).count() == 0
