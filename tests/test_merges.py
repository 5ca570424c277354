"""A merge with an empty table of changes gives the snapshot back."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from curalens.operators import merging, post_fold
from curalens.sources.standins import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def same(left, right):
    columns = sorted(right.columns)
    left, right = left.select(*columns), right.select(*columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


MERGES = {
    "merge_scores": lambda v: merging.merge_scores(v.properties, v.assessments.limit(0).withColumn("score", F.col("story_score").cast("double"))),
    "fill_blanks": lambda v: merging.fill_blanks(v.properties, v.assessments.limit(0), ["display_name", "architect"]),
    "apply_reviews": lambda v: merging.apply_reviews(v.properties, v.review_events.limit(0)),
    "delivery_failures": lambda v: merging.delivery_failures(v.properties, v.table("orders").limit(0).selectExpr(
        "o_orderkey AS property_id", "o_orderdate AS at", "o_orderkey AS seq", "'x' AS message")),
    "retry_delivery": lambda v: merging.retry_delivery(v.properties, v.properties.select("id").limit(0)),
    "clear_scores": lambda v: merging.clear_scores(v.properties, v.properties.select("id").limit(0)),
    "set_series": lambda v: merging.set_series(v.properties, v.properties.selectExpr("id AS property_id", "series").limit(0)),
    "set_listing": lambda v: merging.set_listing(v.properties, v.properties.selectExpr(
        "id AS property_id", "listing_status AS value", "mls_number AS mls", "listing_status_note AS note", "listing_status_at AS at").limit(0)),
    "set_image_page": lambda v: merging.set_image_page(v.properties, v.properties.selectExpr("id AS property_id", "image_page_url AS url").limit(0)),
}


@pytest.mark.parametrize("name", sorted(MERGES))
def test_no_changes(views, name):
    assert same(MERGES[name](views), views.properties)


def test_no_edits(views):
    none = views.table("events").limit(0).selectExpr("event_id AS post_id", "event_id AS seq", "ts AS at", "event_type AS field", "event_type AS value", "true AS by_hand")
    assert same(merging.edit_posts(views.posts, none), views.posts)


def test_a_rejection_after_an_approval(spark):
    props = spark.createDataFrame([(1, "approved", None, 3, "broke"), (2, "rejected", "old", 1, "broke"), (3, "delivered", None, 2, None)],
                                  "id long, status string, reject_reason string, delivery_attempts int, delivery_error string").withColumns(
        {"delivery_attempted_at": F.lit("2024-01-01").cast("timestamp"), "reviewed_at": F.lit(None).cast("timestamp")})
    events = spark.createDataFrame([(1, "approve", None, 1), (1, "reject", " no ", 2), (3, "reset", None, 1)],
                                   "property_id long, action string, reason string, seq long").withColumn("at", F.timestamp_seconds("seq"))
    got = {r.id: r for r in merging.apply_reviews(props, events).collect()}
    assert (got[1].status, got[1].reject_reason, got[1].delivery_attempts, got[1].delivery_error, got[1].delivery_attempted_at) == ("rejected", "no", 0, None, None)
    assert (got[2].status, got[2].reject_reason, got[2].delivery_attempts, got[2].delivery_error) == ("rejected", "old", 1, "broke")
    assert (got[3].status, got[3].delivery_attempts) == ("delivered", 2)


def test_a_hand_edit_keeps_its_mark(spark):
    posts = spark.createDataFrame([(1, "planned", "c", "1", "n"), (2, "planned", "c", "1", "n")], "id long, state string, caption string, image_order string, note string").withColumn(
        "caption_edited_at", F.lit(None).cast("timestamp"))
    edits = spark.createDataFrame([(1, "caption", "mine", True, 1), (1, "caption", "machine", False, 2)],
                                  "post_id long, field string, value string, by_hand boolean, seq long").withColumn("at", F.timestamp_seconds("seq"))
    got = {r.id: r for r in merging.edit_posts(posts, edits).collect()}
    assert got[1].caption == "machine" and got[1].caption_edited_at is not None and got[1].note == "n"
    assert got[2].caption == "c" and got[2].caption_edited_at is None and got[2].note == "n"


def fold_by_hand(post, events, limit):
    """One event after the other on one row."""
    row = dict(post)
    for e in events:
        state, tries, act = row["state"], row["attempts"], e["action"]
        movable, back = state in ("planned", "failed", "skipped"), act == "requeue" and state == "published"
        if act in post_fold.MOVING:
            code, row["attempts"] = post_fold.step(act, post_fold.POST_STATES.index(state), tries, limit)
            row["state"] = post_fold.POST_STATES[code]
        if act == "finish":
            row |= {"published_at": e["at"], "media_id": e["value"], "error": None}
        elif act == "fail":
            row["error"] = e["value"]
        elif back or (act == "retry" and state in ("failed", "skipped")):
            row["error"] = None
        if back:
            row |= {"published_at": None, "media_id": None, "permalink": None}
        if (act == "reschedule" and movable) or (back and e["value_at"]):
            row["scheduled_at"] = e["value_at"]
        elif act in ("caption", "image_order") and movable:
            row[act] = e["value"]
            if act == "caption" and e["by_hand"]:
                row["caption_edited_at"] = e["at"]
        elif act == "note":
            row["note"] = e["value"].strip() or None
        elif act in ("share", "unshare") and state == "published":
            row["story_shared_at"] = e["at"] if act == "share" else None
        elif act == "permalink":
            row["permalink"] = e["value"]
    return row


POST_SCHEMA = ("id long, state string, attempts int, scheduled_at timestamp, error string, published_at timestamp, media_id string, caption string, "
               "caption_edited_at timestamp, image_order string, note string, story_shared_at timestamp, permalink string")
EVENT_SCHEMA = "post_id long, at timestamp, seq long, action string, value string, other string, value_at timestamp, by_hand boolean"


@pytest.mark.parametrize("seed,piece_rows,spread", [(1, 3, 40), (2, 1024, 1), (3, 16, 100_000)])
def test_the_fold_equals_one_event_after_the_other(spark, seed, piece_rows, spread):
    rng, zero = random.Random(seed), datetime(2024, 1, 1)
    posts = [(i, rng.choice(post_fold.POST_STATES), rng.randrange(3), zero, None, None, None, "cap", None, None, None, None, None) for i in range(6)]
    events = [(rng.choice([0, 0, 0, 1, 2, 3, 9]), zero + timedelta(seconds=rng.randrange(spread)), i, rng.choice(post_fold.ACTIONS + ["other"]),
               rng.choice([" ", f"v{i}"]), None, rng.choice([None, zero + timedelta(days=i)]), rng.random() < 0.5) for i in range(400)]
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    dicts = [dict(zip(names, e)) for e in sorted(events, key=lambda e: (e[1], e[2]))]
    columns = [c.split()[0] for c in POST_SCHEMA.split(", ")]
    want = {p[0]: fold_by_hand(dict(zip(columns, p)), [e for e in dicts if e["post_id"] == p[0]], 3) for p in posts}
    got = post_fold.fold_posts(spark.createDataFrame(posts, POST_SCHEMA), spark.createDataFrame(events, EVENT_SCHEMA).repartition(5), piece_rows=piece_rows)
    assert {r.id: r.asDict() for r in got.collect()} == want


def test_the_fold_without_events_and_in_unknown_states(spark):
    posts = spark.createDataFrame([(1, "odd", 7), (2, "failed", 9), (3, None, None)], "id long, state string, attempts int")
    none = spark.createDataFrame([], EVENT_SCHEMA)
    assert sorted(tuple(r) for r in post_fold.fold_posts(posts, none).collect()) == [(1, "odd", 7), (2, "failed", 9), (3, None, None)]
    now = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, now, 1, "skip"), (2, now, 1, "claim"), (3, now, 1, "abandon")], "post_id long, at timestamp, seq long, action string")
    assert {tuple(r) for r in post_fold.fold_posts(posts, events).collect()} == {(1, "odd", 7), (2, "failed", 9), (3, "skipped", 0)}
    again = spark.createDataFrame([(2, now, 1, "retry"), (2, now, 2, "claim")], "post_id long, at timestamp, seq long, action string")
    assert post_fold.fold_posts(posts, again).filter("id = 2").first() == (2, "publishing", 1)


def test_a_hundred_thousand_events_in_one_second(spark):
    rng = random.Random(3)
    acts = [rng.choice(["claim", "finish", "fail", "skip", "retry", "requeue", "note"]) for _ in range(100_000)]
    events = spark.createDataFrame([(7, a, f"v{i}", i) for i, a in enumerate(acts)], "post_id long, action string, value string, seq long").withColumn(
        "at", F.lit("2024-01-01").cast("timestamp")).repartition(5)
    state, tries, note = 0, 0, None
    for i, a in enumerate(acts):
        if a == "note":
            note = f"v{i}"
        else:
            state, tries = post_fold.step(a, state, tries, 3)
    posts = spark.createDataFrame([(7, "planned", 0, None)], "id long, state string, attempts int, note string")
    assert tuple(post_fold.fold_posts(posts, events).first()) == (7, post_fold.POST_STATES[state], tries, note)
    assert tuple(merging.apply_post_events(events).first()) == (7, post_fold.POST_STATES[state], tries)
    runs = post_fold.pieces_of(events, 1024).groupBy("post_id", "part", "piece").count().agg(F.max("count")).first()[0]
    assert runs <= 1024
