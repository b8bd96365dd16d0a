import html
import re

import pytest
from pyspark.sql import functions as F

from gleanspark.llm.queries import QUERIES
from gleanspark.llm.site_style import _text, host_of, main_texts, parsed
from tests.llm.cases import CLASHING, ROWS


def shown(page):
    return _text(parsed(page.encode()), set())


def plain(page):
    """The given pages' own shape, by splitting: an article of headings and paragraphs."""
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", inside[1] if inside else "")
    shown = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks)
    return "\n\n".join(b for b in shown if b)


def test_query_on_the_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op13_main_text"](spark, folder).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))
    assert sum(r.n_chars for r in rows) > 100_000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no markup &amp; &#8212; at&nbsp;all", "no markup & — at all"),
        ("<p>one<p>two <b>bold</b>er<br>three</p>tail", "one\n\ntwo bolder three\n\ntail"),
        ("<p>a &lt;p&gt; b<!-- c <p>d --> e</p><script>var t='</p>';</script><style>p{}</style>", "a <p> b e"),
        ("<ul><li>x<li>y <i>z</i></ul><table><tr><td>1<td>2<tr><td>3</table>", "x\n\ny z\n\n1\n\n2\n\n3"),
        ("<header>H</header><main><header>kept</header><p>m</p></main><footer>F</footer>", "kept\n\nm"),
        ("<nav>n</nav><div class='side-bar x sidebar'>s</div><div id=comments><p>c</p></div><p>p</p>", "p"),
        ("<div class='has-sidebar'><p>p</p></div><div role=banner>b</div><div hidden>h</div>", "p"),
        ("<article><h1>T</h1><div class='ad box'>buy</div><p>A</p><form>f<p>g</form></article><p>out</p>", "T\n\nA"),
        ("<div class=related><article>teaser</article></div><article>real</article>", "real"),
        ("<div class='page footer-fixed'><article>only</article></div>", "only"),
        ("<article>a<article class='comment'>c</article>b</article>", "a\n\nb"),
        ("<p title='a > b' data-x=\"c>d\">x</p><a href=/y/>z</a>", "x\n\nz"),
        ("<p title=\"open>x</p><p>y", "x\n\ny"),
        ("<b><p>in<p>side</b> out", "in\n\nside out"),
        ("<title>t</title><textarea><p>q</textarea><p>r</p></div></p>s<", "r\n\ns<"),
    ],
)
def test_shapes_of_pages(page, text):
    assert shown(page) == text


def test_deep_and_odd_pages_end():
    assert shown("<div>" * 30_000 + "x") == "x"
    assert shown("<p>" * 30_000 + "x") == "x"
    assert shown("<a b='" * 20_000).strip() == shown("<a b='" * 20_000)
    assert shown("<" * 50_000) == "<" * 50_000
    assert shown("<!--" * 50_000) == ""


def site(host, n, same="Follow us on all networks. All rights kept."):
    return [
        (
            f"http://{host}/{i}",
            f"<html><body><div><a href='/home'>Home</a><a href='/all'>All</a></div><div><h2>Title {i}</h2><p>Text {i} of its own.</p>"
            f"{'<p>More.</p>' * (i % 3)}</div><section><p>{same}</p></section></body></html>",
        )
        for i in range(n)
    ]


def made(spark, rows):
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in main_texts(pages.repartition(4)).collect()}


def test_what_a_host_repeats_goes(spark):
    whole = "<div><h2>One</h2><p>page</p></div><section><p>copied</p></section>"
    rows = site("a.example", 9) + site("b.example", 3) + [(f"http://c.example/{i}", whole) for i in range(9)]
    got = made(spark, rows + site("d.example", 1) + [("http://d.example/copy", "<p>x</p>" + whole)] * 8)
    for i in range(9):
        assert got[i] == "\n\n".join([f"Title {i}", f"Text {i} of its own."] + ["More."] * (i % 3))
    assert all("Follow us" in got[i] and "Home" in got[i] for i in (9, 10, 11))  # too few pages to tell
    assert {got[i] for i in range(12, 21)} == {"One\n\npage\n\ncopied"}  # copies of one page
    assert {got[i] for i in range(22, 30)} == {"x\n\nOne\n\npage\n\ncopied"}


def test_a_repeated_paragraph_of_an_article_stays(spark):
    rows = [(u, h.replace("<section>", "<article>").replace("</section>", f" {u}</article>")) for u, h in site("a.example", 9)]
    assert all("Follow us on all networks." in t and "Home" not in t for t in made(spark, rows).values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, None if i == 4 else f"HTTP://u:p@Host.example:80/{i}", t) for i, t in ROWS], "page_id long, url string, html string")
    hosts = docs.select(host_of(F.col("url")).alias("h")).distinct().collect()
    assert {r.h for r in hosts} == {"host.example", ""}
    odd = docs.withColumns({c: F.lit("x") for c in [*CLASHING, "host", "k2", "removed", "c0"]})
    rows = sorted(((r.page_id, r.text, r.n_chars) for r in main_texts(odd).collect()), key=str)
    want = [" ".join((t or "").split()) for _, t in ROWS]
    assert rows == sorted(((i, t, len(t)) for (i, _), t in zip(ROWS, want, strict=True)), key=str)
    assert main_texts(odd.where("false")).count() == 0
