"""Page extraction."""

from pyspark.sql import functions as F

from curalens.operators import extract
from curalens.operators.extract import parse_page

LONG = "This is a sentence about a house by the lake. " * 12


def test_article_without_chrome():
    page = parse_page(f"<html><head><title>T</title></head><body><nav>Property for sale</nav><article><p>{LONG}</p>"
                      f"<div class='related-posts'><p>Other for $3 million</p></div><ul><li><a href='/x'>List</a></li></ul>"
                      "</article><footer>Sell $1</footer></body></html>")
    assert page["title"] == "T" and page["text"].startswith("T This is a sentence")
    assert "for sale" not in page["text"] and "$3" not in page["text"] and "List" not in page["text"]
    assert page["hrefs"] == ["/x"]


def test_short_article_uses_whole_root():
    page = parse_page("<body><article><p>short</p></article><div>outside</div></body>")
    assert page["text"] == "short outside"


def test_og_title_and_scripts():
    page = parse_page('<meta property="og:title" content=" Big "><title>small</title><script>var a="<p>no</p>"</script><p>yes</p>')
    assert page["title"] == "Big" and "no" not in page["text"] and "yes" in page["whole_text"]


def test_unclosed_tags():
    page = parse_page(f"<article><p><b>{LONG}<br><p>second<p>third</article>")
    assert page["text"].endswith("second third")


def test_whole_text_is_kept():
    body = "word " * 30000
    assert len(parse_page(f"<article><p>{body}</p></article>")["text"]) == len(body.strip())


def test_image_urls(spark):
    html = ('<meta property="og:image" content="/lead.jpg"><article><img src="/logo.png"><img data-src="/a-800x600.jpg" '
            'src="/blank.gif"><img src="/a.jpg"><img srcset="/s.jpg 300w, /l.jpg 1200w"></article>'
            '<script>{"u":"https:\\/\\/cdn.com\\/g.webp?x=1"}</script>')
    df = spark.createDataFrame([(1, "https://h.com/p/", html)], "id int, url string, html string")
    row = extract.extract_pages(df, ["id", "url"]).select(
        extract.image_urls(F.col("image_refs"), F.col("url")).alias("all"),
        extract.image_urls(F.col("image_refs"), F.col("url"), skip_lead=F.lit(True)).alias("rest")).first()
    assert row["all"] == ["https://h.com/lead.jpg", "https://h.com/a-800x600.jpg", "https://h.com/l.jpg",
                          "https://cdn.com/g.webp?x=1"]
    assert row.rest == row["all"][1:]


def test_links_resolved_once(spark):
    html = f"<article><p>{LONG}</p><a href='b'>1</a><a href='/p/b'>2</a><a href='#x'>3</a><a href='mailto:a@b.c'>4</a></article>"
    df = spark.createDataFrame([(1, "https://h.com/p/q", html)], "id int, url string, html string")
    row = extract.extract_pages(df, ["id", "url"]).select(extract.resolved_links(F.col("hrefs"), F.col("url")).alias("l")).first()
    assert row.l == ["https://h.com/p/b"]


def test_any_markup_gives_a_row_in_linear_time():
    import time
    for page in ("<div>" * 100_000 + "deep", "<b>" * 100_000 + "open", "<p>x" * 50_000, "</i>" * 100_000 + "end", "<ul><li>" * 20_000 + "x"):
        began = time.perf_counter()
        assert extract.parse_page(page)["whole_text"].split()[-1] in ("deep", "open", "x", "end")
        assert time.perf_counter() - began < 20
    bad = extract.parse_page("<p>before</p><![foo[ bar ]]><p>after</p>")
    assert bad["whole_text"] == "before after" and bad["parse_error"].startswith("AssertionError")
    assert extract.parse_page("<p>good</p>")["parse_error"] is None
