"""Golden pairs for column functions."""

import pytest
from pyspark.sql import functions as F

from curalens.functions import photos, places, urls, values
from curalens.operators.reporting import note_plain


def one(spark, build, *args):
    row = spark.createDataFrame([args], " , ".join(f"a{i} string" for i in range(len(args))))
    return row.select(build(*[F.col(f"a{i}") for i in range(len(args))]).alias("x")).first().x


@pytest.mark.parametrize("text, value, currency", [
    ("$1,250,000", 1250000, "USD"), ("US$1,250,000", 1250000, "USD"), ("€850,000", 850000, "EUR"),
    ("£1.2m", 1200000, "GBP"), ("$3.4M", 3400000, "USD"), ("NT$12,000,000", 12000000, "TWD"),
    ("3,980 萬", 39800000, "TWD"), ("1.2億", 120000000, "TWD"), ("$1.5k", 1500, "USD"), ("980万円", 9800000, "JPY"),
    ("$500,000 — 万一の際は", 500000, "USD"),
    ("３９８０万円", 39800000, "JPY"), ("１.２億", 120000000, "TWD"), ("$\u00a05\u00a0m", 5000000, "USD"), ("٣٠\u3000万", 300000, "JPY"), ("Price on request", None, None), ("", None, None), (None, None, None)])
def test_price(spark, text, value, currency):
    got = one(spark, values.price_parts, text)
    assert (got.value, got.currency) == (None if value is None else pytest.approx(value), currency)


@pytest.mark.parametrize("text, year", [
    ("1868", 1868), ("built in 1902", 1902), ("c. 1920s", 1920), ("1890–1900", 1890), ("Built 1999, renovated 2018", 1999),
    ("Unit 4501", None), ("90210", None), ("約1920年", None), ("（1920）", 1920), ("1,250,000", None), (None, None)])
def test_year(spark, text, year):
    assert one(spark, values.parse_year, text) == year


@pytest.mark.parametrize("url, want", [
    ("https://a.com/x/", "https://a.com/x"), ("https://a.com/x#top", "https://a.com/x"), ("https://a.com/", "https://a.com/"),
    ("https://a.com/x/?q=1/", "https://a.com/x?q=1/"), (" https://a.com/x// ", "https://a.com/x"), ("https://a.com", "https://a.com")])
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize_url, url) == want


@pytest.mark.parametrize("href, base, want", [
    ("/b", "https://a.com/x/y", "https://a.com/b"), ("b", "https://a.com/x/y", "https://a.com/x/b"),
    ("../b", "https://a.com/x/y/z", "https://a.com/x/b"), ("//c.com/q", "https://a.com/x", "https://c.com/q"),
    ("?p=2", "https://a.com/x?p=1", "https://a.com/x?p=2"), ("https://d.com/", "https://a.com", "https://d.com/"),
    ("b", "https://a.com", "https://a.com/b"), ("./b?c=../d", "https://a.com/x/", "https://a.com/x/b?c=../d")])
def test_absolute(spark, href, base, want):
    assert one(spark, urls.absolute_url, href, base) == want


def test_host(spark):
    assert one(spark, urls.host_of, "https://u@WWW.Example.com:80/x") == "example.com"
    assert one(spark, urls.authority, "https://WWW.Example.com:80/x") == "www.example.com:80"
    assert one(spark, lambda u: urls.on_any_domain(urls.host_of(u), ["example.com"]), "https://a.b.example.com/") is True
    assert one(spark, lambda u: urls.on_any_domain(urls.host_of(u), ["example.com"]), "https://notexample.com/") is False


@pytest.mark.parametrize("text, want", [
    ("713 sq ft", "713 sq ft (Approx. 66㎡)"), ("2 acres", "2 acres (Approx. 8,094㎡)"), ("120 sqm", "120 sqm"), ("large", "large")])
def test_area(spark, text, want):
    assert one(spark, values.area_with_metric, text) == want


def test_addresses(spark):
    text = "11012 S Kilpatrick Avenue #2NE, Oak Lawn IL 60453"
    got = one(spark, lambda t: places.us_addresses(t), text)[0]
    assert (got.address, got.city) == ("11012 S Kilpatrick Avenue #2NE, Oak Lawn, IL 60453", "Oak Lawn")
    two = "1 Office Rd, New York, NY 10001 and 95 Highland Way, Inverness, CA 94937"
    assert one(spark, lambda u, t: places.pick_address(u, F.lit(None).cast("string"), t),
               "https://x.com/95-highland-inverness-ca", two).city == "Inverness"
    assert one(spark, lambda u, t: places.pick_address(u, F.lit(None).cast("string"), t), "https://x.com/1", two) is None
    assert one(spark, lambda t: places.pick_tw_address(t, F.lit("")), "臺北市中山區雅寓").address == "台北市中山區"
    assert one(spark, lambda t: places.pick_tw_address(F.lit(""), t), "高雄市左營區 地址：新北市板橋區大明街").city == "新北市"


def test_places(spark):
    assert one(spark, places.place_label, "London", "London", "United Kingdom") == "London, UK"
    assert one(spark, places.country_code, " España. ") == "ES"
    assert one(spark, places.flag, "Japan") == "\U0001F1EF\U0001F1F5"
    assert one(spark, places.flag, "Atlantis") == ""
    assert one(spark, lambda t: places.display_title(F.lit(None).cast("string"), t), "1 Main St - MLS# 3 - Broker") == "1 Main St"


@pytest.mark.parametrize("url, want", [
    ("https://h.com/wp-content/uploads/a.jpg?w=300", "https://h.com/wp-content/uploads/a.jpg"),
    ("https://h.com/wp-content/uploads/a.jpg?w=80", "https://h.com/wp-content/uploads/a.jpg?w=80"),
    ("https://h.com/wp-content/uploads/a-740x492.jpg", "https://h.com/wp-content/uploads/a.jpg"),
    ("https://h.com/wp-content/uploads/a-150x150.jpg", "https://h.com/wp-content/uploads/a-150x150.jpg"),
    ("https://h.com/wp-content/uploads/a.jpg?sig=1", "https://h.com/wp-content/uploads/a.jpg?sig=1"),
    ("https://h.com/media/a-740x492.jpg", "https://h.com/media/a-740x492.jpg")])
def test_original_upload(spark, url, want):
    assert one(spark, photos.original_upload_url, url) == want


def test_photo_identity(spark):
    same = {one(spark, photos.photo_identity, u) for u in (
        "https://H.com/a.jpg", "http://h.com/a-1600x1067.jpg?x=1", "https://h.com/A@2x.jpg", "https://h.com/a-scaled.jpg")}
    assert len(same) == 1


def test_note_plain(spark):
    assert one(spark, note_plain, "## Title\n**bold** and __this__\n  # kept\n") == "Title\nbold and this\n# kept"
