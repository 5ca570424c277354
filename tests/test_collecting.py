"""Listing rules by source, backfill budgets and places in groups, against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from curalens.functions.ranks import grouped_place
from curalens.operators import collecting as op
from curalens.schemas import SUPPLIED  # noqa: F401  (schemas load before sources)
from curalens.sources.standins import SOURCES

SETTINGS = "key string, location_from string, require_location boolean, country string, price_patterns array<string>, max_details int"


def source_frame(spark):
    rows = [(f"s{i}", f"Site {i}", "listing", "S", "crawl", True, False, [], [r"/agents/"], None, i) for i in range(4)]
    return spark.createDataFrame(rows, SOURCES)


def page(price, address, photo=True):
    image = '<meta property="og:image" content="/p/1.jpg"><img src="/p/1.jpg">' if photo else ""
    return f"<html><head><title>Home</title>{image}</head><body><article><p>A house. {price}</p><p>{address}</p></article></body></html>"


def test_each_source_is_read_by_its_own_rules(spark):
    pages = [
        (1, "s0", "https://a.example.com/1", page("$250,000", "12 Elm Street, Oak Lawn, IL 60453")),
        (2, "s0", "https://a.example.com/2", page("$250,000", "somewhere")),
        (3, "s1", "https://b.example.com/3", page("1,200 萬 or $99,999,000", "地址：臺北市中山區民生東路1號")),
        (4, "s1", "https://b.example.com/4", page("$250,000", "地址：臺北市中山區民生東路1號")),
        (5, "s2", "https://c.example.com/5", page("USD300,000 was $310,000", "12 Elm Street, Oak Lawn, IL 60453")),
        (6, "s2", "https://c.example.com/6", page("$310,000", "nowhere", photo=False)),
        (7, "s3", "https://d.example.com/7", page("$310,000", "nowhere")),
        (8, "s2", "https://c.example.com/agents/8", page("$310,000", "nowhere")),
        (9, "s2", "https://c.example.com/9", page("$310,000", "nowhere")),
        (10, "s2", "https://c.example.com/5#top", page("$310,000", "nowhere")),
    ]
    settings = [("s0", "address", True, "United States", [r"\$[\d,]{5,}"], None), ("s1", "tw_address", True, "Taiwan", [r"[\d,]+\s?萬"], 40),
                ("s2", "none", False, "Chile", [r"USD[\d,]{5,}", r"\$[\d,]{5,}"], 2)]
    frame = spark.createDataFrame(pages, "page_id long, source string, url string, html string")
    known = spark.createDataFrame([], "source_url string")
    for most in (None, 40):
        judged = op.listing_intake(frame, source_frame(spark), known, spark.createDataFrame(settings, SETTINGS), most_details=most)
        got = {r.page_id: r for r in judged.collect()}
        assert {i: r.outcome for i, r in got.items()} == {
            1: "candidate", 2: "no location", 3: "candidate", 4: "no price", 5: "candidate", 6: "no photo", 7: "no settings", 9: "over limit", 10: "duplicate"}
        assert (got[1].price, got[1].location_city, got[1].location_country, got[1].is_for_sale) == ("$250,000", "Oak Lawn", "United States", True)
        assert (got[3].price, got[3].location_city, got[3].for_sale_evidence) == ("1,200 萬", "台北市", "Site 1 の物件ページ")
        assert (got[5].price, got[5].location_city, got[5].location_country) == ("USD300,000", None, "Chile")     # the first pattern wins, no address is taken
        assert "A house." in got[1].content_text and got[9].content_text is None
    stats = {r.source: r for r in op.listing_stats(frame, judged).collect()}
    assert (stats["s2"].seen_urls, stats["s2"].matched_urls, stats["s2"].fetched, stats["s2"].candidate, stats["s2"].over_limit) == (5, 3, 2, 1, 1)
    assert stats["s0"].no_location_samples == ["https://a.example.com/2"] and stats["s3"].no_settings == 1 and stats["s3"].no_price_samples == []


def test_backfill_equals_the_loop(spark):
    rng = random.Random(4)
    links = [(rng.choice(["hot", "hot", "a", "b", "c"]), f"u{i}", rng.randrange(200), rng.random() < 0.4) for i in range(600)]
    budgets = {"hot": (50, 3), "a": (None, 35), "b": (4, None)}
    want, done = {}, defaultdict(int)
    for source, url, _, inserts in sorted(links, key=lambda r: (r[0], r[2], r[1])):
        own, used = budgets.get(source, (None, 0))
        budget = min(own if own is not None else 10 ** 9, 40 - (used or 0))
        if done[source] >= budget:
            want[url] = "over budget"
        else:
            want[url] = "inserted" if inserts else "passed over"
            done[source] += inserts
    fresh = spark.createDataFrame(links, "source string, url string, position long, inserts boolean").repartition(6)
    limits = spark.createDataFrame([(k, *v) for k, v in budgets.items()], "source string, max_backfill int, used long")
    assert {r.url: r.outcome for r in op.take_backfill(fresh, limits, 40).collect()} == want


def test_places_in_groups_with_a_hot_one_and_nulls(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.randrange(1000), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, a long, b long").repartition(9)
    got = {r.b: (r.place, r.before) for r in grouped_place(frame, ["g"], ["a", "b"], flag=F.col("b") % 3 == 0, flagged="before").collect()}
    groups = defaultdict(list)
    for g, a, b in rows:
        groups[g].append((a, b))
    want = {}
    for members in groups.values():
        flagged = 0
        for place, (_, b) in enumerate(sorted(members), 1):
            want[b] = (place, flagged)
            flagged += b % 3 == 0
    assert got == want
    assert grouped_place(frame.limit(0), ["g"], ["a"]).count() == 0
