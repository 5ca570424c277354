"""Slots that hold together over steps, and what the plans of reports and candidates read."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curalens.config import PostConfig
from curalens.operators import collecting, lists, reporting, slots
from curalens.plans.registry import all_queries
from curalens.sources.standins import Views

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 3, 5, 3, 0)                      # Tuesday noon in Tokyo
POSTS = ("id long, property_id long, kind string, state string, scheduled_at timestamp, published_at timestamp, parent_post_id long, attempts int, "
         "media_id string")
CFG = PostConfig(plan_days=2)


def anchor(spark):
    return spark.createDataFrame([(NOW,)], "now timestamp")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_planned_stories_know_their_parents_and_come_due(spark):
    posts = spark.createDataFrame([(7, 50, "feed", "published", NOW - timedelta(days=9), NOW - timedelta(days=9), None, 1, "m7"),
                                   (9, 51, "story", "planned", NOW + timedelta(days=30), None, None, 0, None)], POSTS)
    props = spark.createDataFrame([(i, "delivered", "name", "text", float(i), "s") for i in range(51, 70)],
                                  "id long, status string, display_name string, caption_body string, score double, source string").withColumn("series", F.lit(None).cast("string"))
    new = slots.plan_posts(anchor(spark), posts, props.filter("id < 54"), CFG)
    rows = sorted(new.collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(10, 10 + len(rows))) and {r.state for r in rows} == {"planned"}
    feeds = {r.property_id: r.id for r in rows if r.kind == "feed"}
    stories = {r.property_id: r.parent_post_id for r in rows if r.kind == "story"}
    assert set(feeds) == {51, 52, 53} and stories == {52: feeds[52], 53: feeds[53]}                  # 51 has its story already
    assert [(r.kind, r.parent_post_id) for r in rows if r.property_id is None] == [("reel", None)]
    both = posts.unionByName(new, allowMissingColumns=True)
    out = both.withColumn("state", F.when(F.col("id") == feeds[53], "published").otherwise(F.col("state")))
    due = lists.stories_due(out, str(NOW + timedelta(days=5))).collect()
    assert [r.property_id for r in due] == [53]


def test_occupancy_ends_with_the_last_slot_and_no_slot_means_no_plan(spark):
    last = datetime(2024, 3, 6, 11, 0)                # 20:00 on the last day
    names = ["2024-03-05 04:00", "2024-03-05 11:00", "2024-03-06 00:00", "2024-03-06 04:00"]
    full = [(i, 1, "feed", "planned", datetime.fromisoformat(n), None, None, 0, None) for i, n in enumerate(names)]
    props = spark.createDataFrame([(i, "delivered", "name", "text", 1.0, "s") for i in range(9)],
                                  "id long, status string, display_name string, caption_body string, score double, source string").withColumn("series", F.lit(None).cast("string"))
    after = (8, 1, "feed", "planned", last + timedelta(hours=2), None, None, 0, None)
    got = slots.plan_posts(anchor(spark), spark.createDataFrame([*full, after], POSTS), props, CFG).filter("kind = 'feed'").collect()
    assert [r.scheduled_at for r in got] == [last]    # a post after the last slot takes no place
    held = spark.createDataFrame([*full, (9, 1, "feed", "planned", last, None, None, 0, None)], POSTS)
    assert slots.plan_posts(anchor(spark), held, props, CFG).count() == 0


def test_requeue_of_each_kind(spark):
    posts = spark.createDataFrame([
        (1, 1, "feed", "published", NOW, NOW, None, 2, "m1"), (2, 1, "reel", "published", NOW, NOW, None, 1, "m2"), (3, 2, "feed", "published", NOW, NOW, None, 1, "m3"),
        (4, 3, "feed", "planned", datetime(2024, 3, 5, 4, 0), None, None, 0, None), (5, 4, "story", "skipped", NOW, None, None, 0, None),
        (6, 5, "feed", "published", NOW, NOW, None, 1, "m6")], POSTS)
    ids = spark.createDataFrame([(1, False), (2, None), (3, True), (5, False), (6, False)], "id long, now boolean")
    got = {r.id: r for r in slots.requeue(anchor(spark), posts, ids, CFG).collect()}
    at = {i: r.scheduled_at for i, r in got.items()}
    assert at == {1: datetime(2024, 3, 5, 11, 0), 2: datetime(2024, 3, 5, 4, 0), 3: NOW, 6: datetime(2024, 3, 6, 0, 0)}
    assert all((r.state, r.attempts, r.media_id, r.published_at, r.reason) == ("planned", 0, None, None, None) for r in got.values())
    short = {r.id: (r.state, r.media_id, r.reason) for r in slots.requeue(anchor(spark), posts, ids.filter("id <> 3"), CFG, horizon_days=1).collect()}
    assert short == {1: ("planned", None, None), 2: ("planned", None, None), 6: ("published", "m6", "no slot")}


def test_compact_keeps_posts_without_a_slot(spark):
    posts = spark.createDataFrame([(i, i, "feed", "planned", NOW + timedelta(hours=1, minutes=i), None, None, 0, None) for i in range(8)], POSTS)
    got = {r.id: (r.slot_at is None, r.reason) for r in slots.compact(anchor(spark), posts, CFG).collect()}
    assert {i for i, (none, _) in got.items() if none} == {5, 6, 7} and got[7] == (True, "no slot")


def test_reports_read_events_once(spark):
    v = Views(spark, SF)
    assert len(re.findall(r"Location: InMemoryFileIndex[^\n]*events\.parquet", executed(reporting.cube_rows(v.posts, v.properties, v.images, "Asia/Tokyo")))) == 1 or \
        executed(reporting.cube_rows(v.posts, v.properties, v.images, "Asia/Tokyo")).count("events.parquet") == 1
    assert "events.parquet" not in executed(all_queries()["insights_top"](spark, SF))


def test_links_are_chosen_without_texts(spark):
    assert "text:string" not in executed(all_queries()["relink"](spark, SF)).replace("text:string,lang", "")
    v = Views(spark, SF)
    pages = v.entries.select("id", "text").join(v.article_links, "id").withColumn("url", F.lit("u"))
    plan = executed(collecting.relink(v.properties, v.sources, pages))
    exchanges = re.findall(r"Exchange [^\n]*\n(?:[^\n]*\n)?", plan)
    assert not any("text#" in e for e in exchanges)


def test_candidates_from_rows_with_their_own_links(spark):
    rows = [(1, "s", "Site", "A", False, "https://a.example.com/1", "t1", 0, "This home is for sale for $1,250,000 today.", ["https://www.zillow.com/homedetails/1_zpid/"], "p1"),
            (2, "s", "Site", "A", False, "https://a.example.com/1", "t2", 1, "This home is for sale for $2,250,000 today.", [], "p2"),
            (3, "s", "Site", "A", False, "https://a.example.com/3", "t3", 2, "Nothing here.", [], "p3")]
    kept = spark.createDataFrame(rows, "id long, source string, source_name string, source_rank string, assume_for_sale boolean, url string, title string, position long, "
                                       "text string, links array<string>, thumbnail string")
    got = collecting.build_candidates(kept, None).collect()
    assert [(r.id, r.content_text, r.thumbnail, r.listing_url) for r in got] == [(1, rows[0][8], "p1", rows[0][9][0])]
