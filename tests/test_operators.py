"""Operators on small frames: guards, ties, NULLs, and brute-force comparisons."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from curalens import config
from curalens.functions.ranks import global_row_number, histogram_median
from curalens.operators import collecting, images, lists, matching, merging, reporting, reviewing, slots
from curalens.operators.post_fold import POST_STATES, step

T0 = datetime(2024, 1, 1)


def test_first_per_key_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 2), (4, None, 5)], "id int, k string, o int")
    assert sorted(r.id for r in merging.first_per_key(df, ["k"], ["o"]).collect()) == [2, 3, 4]


def test_insert_once(spark):
    old = spark.createDataFrame([("u1",)], "source_url string")
    new = spark.createDataFrame([("u1", 1), ("u2", 3), ("u2", 2)], "source_url string, seq int")
    assert [(r.source_url, r.seq) for r in merging.insert_once(old, new, ["source_url"], ["seq"]).collect()] == [("u2", 2)]


def test_rules(spark):
    tags = ["a"] * 3 + ["b"] * 2 + ["c"] * 4 + ["other"] * 9
    feedback = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "id long, reason_tag string")
    rules = spark.createDataFrame([("c", 3, "avoid c", "dismissed"), ("z", 1, "avoid z", "approved")],
                                  "reason_tag string, hit_count long, proposal string, state string")
    got = {r.reason_tag: (r.hit_count, r.state) for r in lists.rule_candidates(feedback, rules).collect()}
    assert got == {"a": (3, "proposed"), "c": (4, "dismissed"), "z": (1, "approved")}


def test_delivery_queue(spark):
    rows = [(1, "approved", 0, None, 5.0), (2, "approved", 1, T0 - timedelta(seconds=601), 9.0),
            (3, "approved", 1, T0 - timedelta(seconds=10), 9.0), (4, "approved", 3, None, 9.0), (5, "pending", 0, None, 9.0),
            (6, "approved", 0, None, 7.0)]
    df = spark.createDataFrame(rows, "id int, status string, delivery_attempts int, delivery_attempted_at timestamp, score double")
    assert [r.id for r in lists.delivery_queue(df, "2024-01-01 00:00:00").collect()] == [6, 1, 2]


def test_price_sort_puts_unknown_last(spark):
    rows = [(1, "pending", 100.0, "USD"), (2, "pending", 20000.0, "JPY"), (3, "pending", 5.0, "XXX"), (4, "pending", None, None),
            (5, "pending", 90.0, "GBP")]
    props = spark.createDataFrame(rows, "id int, status string, price_value double, price_currency string")
    rates = spark.createDataFrame(list(config.FALLBACK_JPY_PER.items()), "currency string, jpy_per double")
    none = spark.createDataFrame([], "property_id int, folder_name string, delivered_at timestamp")
    for sort, want in (("price_desc", [2, 5, 1, 4, 3]), ("price_asc", [1, 5, 2, 4, 3])):
        got = [r.id for r in lists.ranked_listings(props, none, rates, sort=sort).collect()]
        assert got == want
    assert [r.id for r in lists.ranked_listings(props, none, None, sort="price_asc").collect()][0] == 3


@pytest.mark.parametrize("far", [0, 10 ** 15])
def test_global_row_number(spark, far):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, 2.0, 2.0])) for i in rng.sample(range(10000), 3000)] + [(far + 20_000, 2.0)]      # clustered ids
    df = spark.createDataFrame(rows, "id long, score double")
    got = {r.id: r.rn for r in global_row_number(df, "score", "id").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {ident: i + 1 for i, (ident, _) in enumerate(want)}


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_histogram_median(spark, n):
    values = [random.Random(n + i).randint(0, 4) for i in range(n)]
    hist = spark.createDataFrame([("g", v) for v in values], "k string, v int").groupBy("k", "v").agg(F.count("*").alias("c"))
    assert histogram_median(hist, ["k"], "v", "c").first().median == statistics.median(values)
    assert histogram_median(hist, ["k"], "v", "c", upper=True).first().median == sorted(values)[n // 2]


def test_post_events_fold_over_buckets(spark):
    rng = random.Random(3)
    actions = ["claim", "finish", "fail", "skip", "abandon", "retry", "requeue", "noise"]
    rows = [(p, T0 + timedelta(seconds=rng.randint(0, 5000)), s, rng.choice(actions)) for p in range(5) for s in range(80)]
    want = {}
    for post, _, _, action in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        state, tries = want.get(post, ("planned", 0))
        code, tries = step(action, POST_STATES.index(state), tries, 3)
        want[post] = (POST_STATES[code], tries)
    df = spark.createDataFrame(rows, "post_id int, at timestamp, seq int, action string")
    for rows_of_a_piece in (1, 7, 1000):
        got = {r.post_id: (r.state, r.attempts) for r in merging.apply_post_events(df, piece_rows=rows_of_a_piece).collect()}
        assert got == want
    assert set(POST_STATES) >= {s for s, _ in want.values()}


def test_running_failures_over_pieces(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for source in "abc":
        run, stop = 0, None
        for seq in sorted(rng.sample(range(400), 150)):
            failed = rng.random() < 0.45
            rows.append((source, seq, failed))
            run = run + 1 if failed else 0
            if run >= 5 and stop is None:
                stop = seq
        want[source] = stop
    rows += [("d", i, True) for i in range(40, 60)]
    want["d"] = 44
    df = spark.createDataFrame(rows, "source string, seq long, failed boolean")
    for width in (3, 7, 4096):
        got = collecting.running_failures(df, limit=5, width=width).collect()
        assert {r.source: r.stop_seq for r in got} == want
        assert all(r.fetched == (want[r.source] is None or r.seq <= want[r.source]) for r in got) and len(got) == len(rows)


def detail(story, style, gate=""):
    return (f'{{"gate":"{gate}","axes":[{{"key":"story","raw":{story},"weight":0.5,"reason":"r"}},{{"key":"style","raw":{style},'
            f'"weight":0.5,"reason":""}}],"flags":{{"one_of_a_kind":{"true" if style else "false"}}}}}')


def reviewed(spark):
    rows = [(1, "approved", 80.0, detail(90, 100)), (2, "delivered", 60.0, detail(70, 100)), (3, "rejected", 70.0, detail(60, 0)),
            (4, "pending", 50.0, detail(1, 1)), (5, "rejected", 10.0, "{broken"), (6, "approved", 0.0, detail(20, 0, "story=20 < 40"))]
    return spark.createDataFrame(rows, "id long, status string, score double, score_detail string")


def test_axis_gap_ignores_broken_detail(spark):
    got = {r.key: r for r in reviewing.axis_gap(reviewed(spark), {"story": 0.5, "style": 0.5}).collect()}
    assert (got["story"].n_approved, got["story"].n_rejected) == (3, 1)
    assert got["story"].gap == pytest.approx(60 - 60) and got["style"].note == "works"


def test_review_numbers(spark):
    df = reviewed(spark)
    assert reviewing.precision_at_k(df).first().precision_at_k == pytest.approx(200 / 3)
    assert reviewing.missed_high(df).first().missed_high == 1
    kinds = [(r.kind, r.story, r.n) for r in reviewing.gate_kinds(df).collect()]
    assert kinds == [("story_min", 20.0, 1)]
    totals = reviewing.review_totals(df).first()
    assert (totals.approved, totals.rejected, totals.pending, totals.no_detail, totals.approved_gated) == (3, 2, 1, 1, 1)


def test_precision_with_ties_is_by_id(spark):
    rows = [(i, "approved" if i % 3 == 0 else "rejected", 50.0) for i in range(30)] + [(99, "rejected", 90.0)]
    df = spark.createDataFrame(rows, "id long, status string, score double")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    k = sum(r[1] == "approved" for r in rows)
    want = 100 * sum(r[1] == "approved" for r in order[:k]) / k
    assert reviewing.precision_at_k(df).first().precision_at_k == pytest.approx(want)


def posts(spark, rows):
    return spark.createDataFrame(rows, "id long, property_id long, kind string, state string, published_at timestamp, reach long")


def test_unmeasured_posts_stay_out_of_the_average(spark):
    monday = datetime(2024, 1, 7, 15)  # Monday 00:00 in Tokyo
    df = posts(spark, [(1, 1, "feed", "published", monday, 100), (2, 2, "feed", "published", monday, None),
                       (3, 3, "feed", "published", monday - timedelta(seconds=1), 30),
                       (4, 4, "feed", "published", monday + timedelta(days=21), 5)])
    rows = {str(r.week): r for r in reporting.weekly_totals(df, "Asia/Tokyo").collect()}
    assert (rows["2024-01-08"].reach_avg, rows["2024-01-08"].measured, rows["2024-01-08"].prev_total) == (100.0, 1, 30)
    assert rows["2024-01-29"].prev_posts == 0
    wins = {str(r.day): r for r in reporting.daily_winners(df, "Asia/Tokyo").collect()}
    assert wins["2024-01-08"].id == 1 and wins["2024-01-08"].picked_by == "reach" and wins["2024-01-07"].picked_by == "recent"


def test_too_few_posts_say_nothing(spark):
    df = posts(spark, [(i, i, "feed", "published", T0 + timedelta(hours=i), 10) for i in range(5)])
    props = spark.createDataFrame([(i, "loft", True, True, True, "Spain", "X", 1900, 50.0) for i in range(5)],
                                  "id long, genre string, style_identified boolean, one_of_a_kind boolean, provenance_visible "
                                  "boolean, location_country string, architect string, year_built_value int, score double")
    none = spark.createDataFrame([], "property_id long, source_url string, origin_url string, position int")
    cube = reporting.report_cube(df, props, none, "Asia/Tokyo")
    hist = reporting.trend_histogram(cube)
    got = reporting.insights_top(hist, reporting.cube_weeks(cube)).collect()
    assert [r.finding for r in got] == ["nothing yet"]


def test_number_audit(spark):
    rows = [(1, "8本で168、30%増", "8本 / 168"), (2, "7〜8本。次に1つ", "8本"), (3, "1,200 が 1200", "1200 です")]
    df = spark.createDataFrame(rows, "id int, body string, source string")
    got = {r.id: r.unsupported for r in reporting.number_audit(df).collect()}
    assert got == {1: ["30"], 2: ["7"], 3: []}


def test_page_match(spark):
    props = spark.createDataFrame([(1, "Oak House", "The Oak", "6922 N Owen Avenue")],
                                  "id long, display_name string, title string, street_address string")
    hits = spark.createDataFrame([(1, "https://x.com/p/6922-n-owen-avenue", None, 1), (1, "https://y.com/the-north-avenue", None, 2),
                                  (1, "https://z.com/", "Oak and Owen", 3)], "property_id long, url string, title string, position int")
    assert {(r.position, r.points) for r in matching.page_match(props, hits).collect()} == {(1, 3), (3, 2)}


def test_usable_pages_caps(spark):
    rows = [(1, f"https://a.com/{i}", None, i) for i in range(5)] + [(1, "https://www.zillow.com/x", None, 9)] + [
        (1, f"https://h{i}.com/#f", None, 10 + i) for i in range(8)]
    hits = spark.createDataFrame(rows, "property_id long, url string, title string, position int")
    known = spark.createDataFrame([(1, "https://a.com/0#z")], "property_id long, url string")
    blocked = spark.createDataFrame([("zillow.com",)], "domain string")
    got = [r.url for r in matching.usable_pages(hits, known, blocked).orderBy("place").collect()]
    assert got == ["https://a.com/1", "https://a.com/2", "https://h0.com/", "https://h1.com/", "https://h2.com/", "https://h3.com/"]


def test_image_order(spark):
    p = spark.createDataFrame([(1, 7, "3,1,9"), (2, 7, None)], "id long, property_id long, image_order string")
    im = spark.createDataFrame([(7, i) for i in (1, 2, 3, 4)], "property_id long, position int")
    got = {}
    for r in images.image_order(p, im).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.position)
    assert got == {1: [3, 1, 2, 4], 2: [1, 2, 3, 4]}


def test_hand_moved_post_uses_its_day(spark):
    cfg = config.PostConfig(post_times=["09:00"], plan_days=2)
    anchor = spark.sql("SELECT TIMESTAMP '2024-01-01 16:00:00' AS now")  # 01:00 on the 2nd in Tokyo
    grid = slots.slot_grid(anchor, cfg)
    assert [str(r.slot_at) for r in grid.orderBy("slot_at").collect()] == ["2024-01-02 00:00:00", "2024-01-03 00:00:00"]
    taken = spark.sql("SELECT TIMESTAMP '2024-01-01 23:59:00' AS scheduled_at")
    assert [str(r.slot_at) for r in slots.open_slots(grid, taken, cfg).collect()] == ["2024-01-03 00:00:00"]


def test_reviews_never_touch_delivered(spark):
    props = spark.createDataFrame([(1, "delivered", 2, T0), (2, "pending", 2, T0)],
                                  "id long, status string, delivery_attempts int, reviewed_at timestamp")
    ev = spark.createDataFrame([(1, T0, 1, "reject", "no"), (2, T0, 1, "approve", None), (2, T0, 2, "reject", " ")],
                               "property_id long, at timestamp, seq int, action string, reason string")
    got = {r.id: (r.status, r.delivery_attempts) for r in merging.apply_reviews(props, ev).collect()}
    assert got == {1: ("delivered", 2), 2: ("approved", 0)}


def test_copy_refuses_a_filled_target(spark, tmp_path):
    from curalens.sources import tables
    df = spark.range(5)
    report = tables.copy_tables({"t": df}, str(tmp_path / "c"))
    tables.check_copy(report)
    assert report.first().same
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        tables.copy_tables({"t": df}, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="differ"):
        tables.check_copy(tables.compare_counts({"t": df}, {"t": spark.range(4)}))


def test_usable_pages_deal_rows_by_listing_once(spark):
    """Most pages have one of a few hosts: rows dealt by host meet in a few tasks, however many there are."""
    hits = spark.range(4000).selectExpr("id % 1000 AS property_id", "concat('https://', IF(id % 2 = 0, 'a.open.com/', 'x.shut.com/'), id, '#f') AS url",
                                        "id AS position")
    known = spark.range(100).selectExpr("id AS property_id", "concat('https://a.open.com/', id) AS url")
    blocked = spark.createDataFrame([("shut.com",), (None,)], "domain string")
    pages = matching.usable_pages(hits, known, blocked)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(host" not in plan and plan.count("Exchange hashpartitioning(property_id") == 1
    rows = pages.collect()
    assert {r.host for r in rows} == {"a.open.com"} and {r.property_id % 2 for r in rows} == {0} and len(rows) == 1000
    known_urls = {r.url for r in known.collect()}
    assert not known_urls & {r.url for r in rows}


def test_page_match_moves_no_derived_text(spark):
    props = spark.createDataFrame([(1, "Casa Verdemar", None, None)], "id long, display_name string, title string, street_address string")
    hits = spark.createDataFrame([(1, "https://a.com/casa-verdemar", None, 1)], "property_id long, url string, title string, position long")
    found = matching.page_match(props, hits)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_said" not in plan[plan.index("Join"):]                # words are cut above the join
    assert [r.points for r in found.collect()] == [3]
