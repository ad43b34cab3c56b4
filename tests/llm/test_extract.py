import html
import re
import time

from pyspark.sql import functions as F

from rillflow.llm import extract


def plain(page):
    """For the generated pages only: headings and paragraphs of the article, by searching."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br)>", re.sub(r"</?(?:b|a)\b[^>]*>", "", inner))
    return "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id] == (r.url, plain(r.html), len(plain(r.html)))


def test_page_without_article_tag():
    body = "".join(f"<p>Sentence {i}, which is rather long, as articles are; it has marks. And a second one.</p>" for i in range(6))
    page = (
        "<body><header><h2>Site</h2></header><div id=top-menu><a href=x>One</a> <a href=y>Two</a></div><div class='main-text'><h1>Title</h1>"
        f"{body}<ul><li>point one, short<li>point two</ul></div><div class=links><a href=1>More</a></div><div class='user-comments'><p>I agree, so much; very long comment. "
        "Yes, indeed.</p></div><div class=tiny>x</div><aside>A side.</aside><form><p>Name</p><input></form><footer>F</footer></body>"
    )
    text = extract.main_text(page)
    assert text.startswith("Title\nSentence 0,") and "point one, short\npoint two" in text
    assert not re.search(r"One|agree|side|Name|Site|More|^x$|^F$", text, re.M)


def test_markup_and_entities():
    page = (
        "<article><header><h1>Head &amp; <i>tail</i></h1></header><!-- <p>no</p> --><p title='a > b'>A&nbsp;&lt;b&gt; 1 < 2,\n\t two<script>var x='</p>'</script>.<p>B&eacute;&#233;&#x1F600;"
        "<div class=\"ad-box\">Buy</div><table><tr><td>c1<td>c2</table><div class=comments><p>hm</p></div></article><p>after</p><p cut"
    )
    assert extract.main_text(page) == "Head & tail\nA <b> 1 < 2, two.\nBéé😀\nc1\nc2"


def test_names_and_hidden_parts():
    page = (
        "<main><div class='entry-header'><h1>Title</h1></div><div class='advertorial-x'>Buy</div><section id=comments><p>first!</p></section><div style='display: none'>gone</div>"
        "<p>Body text.</p><div class='cookie-notice'>We use</div><div role=complementary>aside</div><blockquote>Quoted.</blockquote><div class='related-posts'><ul><li>x</ul></div></main>"
    )
    assert extract.main_text(page) == "Title\nBody text.\nQuoted."


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain words only"), (4, "u", "<p>" * 20_000), (4, "u", "<div><b>x" * 20_000), (5, "u", "<article><p>" + "word, " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted(map(tuple, extract.extract(pages).collect()), key=str)
    assert len(got) == 6 and {r[2] for r in got if r[0] in (1, 2)} == {""}
    assert next(r for r in got if r[0] is None)[2:] == ("plain words only", 16)
    assert next(r for r in got if r[0] == 5)[3] == 599_999
    assert extract.extract(pages.limit(0)).count() == 0


def test_article_tag_only_adds_weight():
    body = "".join(f"<p>Sentence {i}, which is rather long, as articles are; it has marks. And a second one.</p>" for i in range(6))
    card = "<article><p>Card</p></article>"
    assert "Sentence 5," in extract.main_text(f"<body><div class=text>{body}</div>{card}</body>")
    inside = f"<article>{body}<div class=x><div class=y>Go</div><div class=z>On</div><div class=q>Up</div></div></article>"
    assert extract.main_text(inside).endswith("second one.\nGo") and "Up" not in extract.main_text(inside)  # next to a paragraph the smoothed weight is higher


def test_hostile_pages_take_linear_time():
    size = 400_000
    tail = "<article><p>The end, at last.</p></article>"
    units = ["<i></b>", "<a b='c ", "<p <", "<a b='>'", "<a", "<b><div><i></b>", "<li>", "<td>", "<!-", "&amp", "</", "<a href=\"", "<x y='\"", "<ul><li><p>"]
    for unit in units:
        page = unit * (size // len(unit))
        begin = time.process_time()
        extract.main_text(page + tail)
        extract.main_text("<i>" * (size // 6) + "</b>" * (size // 8) + page)
        assert time.process_time() - begin < 20, unit


def test_the_ratios_decide_without_article_tags():
    words = "Long sentences, as in a story; they have many words and marks, too. "
    pages = [
        f"<body><div class=x{k}><a href=1>Home</a></div><div class=text><h1>Title {k}</h1>" + f"<p>{words * 3}</p>" * 5
        + "</div>" + "".join(f"<div class=t{i}>w{i}</div>" for i in range(12)) + "</body>" for k in range(10)
    ]
    for k, page in enumerate(pages):
        text = extract.main_text(page)
        assert text.startswith(f"Title {k}\nLong") and "w11" not in text and "Home" not in text
        assert "w11" in extract.main_text(page, share=0)
