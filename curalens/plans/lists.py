"""Lists, queues, joins and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens.operators import lists as op
from curalens.plans.registry import query
from curalens.sources import tables

NOW = "2001-08-01 00:00:00"
POST_NOW = "2024-01-20 03:00:00"
BACKFILL_FIELDS = ["display_name", "caption_body", "style_name"]

query("source_outcomes", """
SELECT source, count(*) AS collected, count(score) AS scored, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'delivered') AS delivered,
  count(*) FILTER (status = 'pending') AS pending, max(score) AS best_score
FROM properties GROUP BY source""")(lambda v: op.source_outcomes(v.properties))

query("sources_report", """
SELECT p.*, CASE WHEN s.mode IS NULL THEN 'none' WHEN s.mode <> 'crawl' THEN 'manual only' WHEN s.enabled THEN 'on'
  ELSE 'off' END AS crawl
FROM (SELECT source, count(*) AS collected, count(score) AS scored, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'delivered') AS delivered,
  count(*) FILTER (status = 'pending') AS pending, max(score) AS best_score FROM properties GROUP BY source) p
LEFT JOIN sources s ON s.key = p.source""")(lambda v: op.sources_report(v.properties, v.sources))

query("count_by_status", "SELECT status, count(*) AS n FROM properties GROUP BY status")(
    lambda v: v.properties.groupBy("status").agg(F.count("*").alias("n")))
query("posts_by_state", "SELECT state, count(*) AS n FROM posts GROUP BY state")(
    lambda v: v.posts.groupBy("state").agg(F.count("*").alias("n")))
query("unscored_count", "SELECT count(*) AS n FROM properties WHERE score IS NULL AND status = 'pending'")(
    lambda v: v.properties.filter("score IS NULL AND status = 'pending'").agg(F.count("*").alias("n")))
query("unscored", "SELECT id, source FROM properties WHERE score IS NULL AND status = 'pending'")(
    lambda v: op.unscored(v.properties).select("id", "source"))

query("tag_counts", """SELECT reason_tag, count(*) AS hits FROM feedback
WHERE reason_tag IS NOT NULL AND reason_tag <> 'other' GROUP BY reason_tag""")(lambda v: op.tag_counts(v.feedback))
query("rule_candidates", """
WITH h AS (SELECT reason_tag, count(*) AS hits FROM feedback WHERE reason_tag <> 'other' GROUP BY 1 HAVING count(*) >= 3)
SELECT coalesce(r.reason_tag, h.reason_tag) AS reason_tag, coalesce(h.hits, r.hit_count) AS hit_count,
  coalesce(r.state, 'proposed') AS state, coalesce(r.proposal, 'avoid ' || h.reason_tag) AS proposal
FROM rules r FULL JOIN h ON h.reason_tag = r.reason_tag""")(lambda v: op.rule_candidates(v.feedback, v.rules))
query("approved_rules", "SELECT reason_tag, proposal FROM rules WHERE state = 'approved'")(
    lambda v: op.approved_rules(v.rules).select("reason_tag", "proposal"))
query("recent_reasons", """
SELECT reason_tag, id, reason, rn FROM (SELECT *, row_number() OVER (PARTITION BY reason_tag ORDER BY id DESC) AS rn
FROM feedback WHERE reason_tag IS NOT NULL) WHERE rn <= 10""")(
    lambda v: op.recent_reasons(v.feedback).select("reason_tag", "id", "reason", F.col("rn").cast("long").alias("rn")))
query("latest_reasons", "SELECT id, reason FROM feedback ORDER BY id DESC LIMIT 30")(
    lambda v: op.latest_reasons(v.feedback, 30).select("id", "reason"))
query("untagged", "SELECT id, reason FROM feedback WHERE reason_tag IS NULL ORDER BY id LIMIT 10")(
    lambda v: op.untagged(v.feedback, 10).select("id", "reason"))

# Ranked lists. Every sort key is one query; the rank is part of the result.
_ORDER = {
    "score": "score DESC NULLS LAST, id DESC", "newest": "collected_at DESC, id DESC",
    "oldest": "collected_at ASC, id ASC", "price_desc": "price_value DESC NULLS LAST, id DESC",
    "price_asc": "price_value ASC NULLS LAST, id DESC", "built_oldest": "year_built_value ASC NULLS LAST, id DESC",
}


def _sorted(name):
    return lambda v: op.ranked_listings(v.properties, v.deliveries, None, sort=name, placed=True).select("id", "score", "place")


for _name, _order in _ORDER.items():
    query(f"sort_keys_{_name}", f"SELECT id, score, row_number() OVER (ORDER BY {_order}) AS place FROM properties WHERE status = 'pending'")(
        _sorted(_name))

query("status_list", """
SELECT p.id, p.score, p.series, d.folder_name, d.delivered_at FROM properties p
LEFT JOIN deliveries d ON d.property_id = p.id
WHERE status = 'delivered' AND score >= 40 AND series = 'island'""")(
    lambda v: op.ranked_listings(v.properties, v.deliveries, None, status="delivered", min_score=40.0, series="island",
                                 limit=None).select("id", "score", "series", "folder_name", "delivered_at"))
query("page_of", """SELECT id, score FROM properties WHERE status = 'pending'
ORDER BY score DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100""")(
    lambda v: op.ranked_listings(v.properties, v.deliveries, None, limit=50, offset=100).select("id", "score"))
query("fx_to_jpy", """
SELECT p.id, round(p.price_value * f.jpy_per, 2) AS price_jpy FROM properties p
LEFT JOIN fx_rates f ON f.currency = p.price_currency""")(
    lambda v: op.fx_to_jpy(v.properties, v.fx_rates).select("id", F.round("price_jpy", 2).alias("price_jpy")))
query("sort_price_fx", """
SELECT p.id, round(p.price_value * f.jpy_per, 2) AS price_jpy,
  row_number() OVER (ORDER BY p.price_value * f.jpy_per DESC NULLS LAST, id DESC) AS place FROM properties p
LEFT JOIN fx_rates f ON f.currency = p.price_currency WHERE status = 'pending'""")(
    lambda v: op.ranked_listings(v.properties, v.deliveries, v.fx_rates, sort="price_desc", placed=True)
    .select("id", F.round("price_jpy", 2).alias("price_jpy"), "place"))
query("fx_invert", """
SELECT currency, round_even(1 / per_jpy, 4) AS jpy_per FROM
  (SELECT 'C' || n_nationkey AS currency, n_nationkey * 0.0017::DOUBLE AS per_jpy FROM nation)
WHERE per_jpy > 0""")(
    lambda v: _invert(v))


def _invert(v):
    from curalens.functions.values import rate_from_quote
    quotes = v.table("nation").selectExpr("concat('C', n_nationkey) AS currency",
                                          "n_nationkey * CAST(0.0017 AS DOUBLE) AS per_jpy")
    return (quotes.select("currency", rate_from_quote(F.col("per_jpy")).alias("jpy_per"))
            .filter("jpy_per IS NOT NULL"))


query("replace_rates", """SELECT currency, arg_max(jpy_per, fetched_at) AS jpy_per, max(fetched_at) AS fetched_at
FROM fx_readings GROUP BY currency""")(lambda v: op.newest_rates(v.fx_readings))
query("fx_effective", """
WITH s AS (SELECT currency, arg_max(jpy_per, fetched_at) AS jpy_per, max(fetched_at) AS fetched_at FROM fx_readings
  GROUP BY currency)
SELECT currency, jpy_per, 'stored' AS origin, (SELECT max(fetched_at) FROM s) AS as_of,
  (SELECT max(fetched_at) FROM s) <= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY AS stale FROM s""")(
    lambda v: op.effective_rates(op.newest_rates(v.fx_readings), v.fx_rates, NOW))

# Joins.
query("join_delivery", """
SELECT p.id, p.status, d.folder_name, d.delivered_at FROM properties p LEFT JOIN deliveries d ON d.property_id = p.id
""")(lambda v: op.join_delivery(v.properties, v.deliveries).select("id", "status", "folder_name", "delivered_at"))
query("join_unposted", """
SELECT p.id, p.score FROM properties p
WHERE p.status = 'delivered' AND p.display_name IS NOT NULL AND p.caption_body IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM posts o WHERE o.property_id = p.id AND o.kind = 'feed')""")(
    lambda v: op.postable(v.properties, v.posts, None).select("id", "score"))
query("join_post_property", """
SELECT o.id, o.property_id, o.published_at, o.reach, p.genre, p.location_country, p.score FROM posts o
LEFT JOIN properties p ON p.id = o.property_id
WHERE o.state = 'published' AND o.published_at >= TIMESTAMP '2024-01-07 15:00:00'
  AND o.published_at < TIMESTAMP '2024-01-14 15:00:00'""")(
    lambda v: op.posts_with_property(
        op.published_between(v.posts, "2024-01-07 15:00:00", "2024-01-14 15:00:00", None), v.properties)
    .select("id", "property_id", "published_at", "reach", "genre", "location_country", "score"))
query("join_replan", """
SELECT o.id, o.property_id, o.scheduled_at, p.display_name FROM posts o JOIN properties p ON p.id = o.property_id
WHERE o.kind = 'feed' AND o.state IN ('planned', 'failed') AND o.caption_edited_at IS NULL""")(
    lambda v: op.replan_rows(v.posts, v.properties).select("id", "property_id", "scheduled_at", "display_name"))
query("post_with_property", """
SELECT o.id, o.property_id, o.scheduled_at, o.state, p.display_name, p.source FROM posts o
LEFT JOIN properties p ON p.id = o.property_id
WHERE o.scheduled_at <= TIMESTAMP '2024-01-20 03:00:00' AND o.state IN ('planned', 'failed')""")(
    lambda v: op.scheduled_posts(v.posts, v.properties, POST_NOW, ["planned", "failed"])
    .select("id", "property_id", "scheduled_at", "state", "display_name", "source"))
query("image_counts", """
SELECT property_id, count(*) AS image_count, count(origin_url) AS foreign_images,
  min({'p': position, 'u': source_url}).u AS cover FROM images GROUP BY property_id""")(
    lambda v: op.image_counts(v.images))
query("under_quota", """
SELECT p.id, p.status, coalesce(i.n, 0) AS image_count FROM properties p
LEFT JOIN (SELECT property_id, count(*) AS n FROM images GROUP BY 1) i ON i.property_id = p.id
WHERE p.status IN ('approved', 'delivered') AND p.source_url LIKE 'http%' AND coalesce(i.n, 0) < 4""")(
    lambda v: op.under_quota(v.properties, v.images, 4).select("id", "status", "image_count"))
query("thin_stock", """
SELECT id FROM properties WHERE status = 'pending' AND score IS NOT NULL
  AND id IN (SELECT property_id FROM images GROUP BY property_id HAVING count(*) <= 7)""")(
    lambda v: op.thin_stock(v.properties, v.images).select("id"))
query("slot_clash", """
SELECT a.id, a.scheduled_at FROM posts a WHERE a.state = 'planned' AND a.kind = 'feed' AND EXISTS (
  SELECT 1 FROM posts b WHERE b.kind = 'feed' AND b.state IN ('planned', 'publishing', 'published')
    AND b.scheduled_at = a.scheduled_at AND b.id <> a.id)""")(
    lambda v: op.slot_clashes(v.posts, v.posts.filter("state = 'planned' AND kind = 'feed'").select("id", "scheduled_at")))
query("occupied_slots", """
SELECT id, scheduled_at, state FROM posts WHERE kind = 'feed' AND state IN ('planned', 'publishing', 'published', 'failed')
  AND scheduled_at <= TIMESTAMP '2024-01-20 03:00:00'""")(
    lambda v: op.occupied_slots(v.posts, POST_NOW).select("id", "scheduled_at", "state"))
query("story_parent", """
SELECT s.id, s.parent_post_id FROM posts s JOIN posts p ON p.id = s.parent_post_id
WHERE s.kind = 'story' AND s.state = 'planned' AND p.state = 'published'
  AND s.scheduled_at <= TIMESTAMP '2024-01-20 03:00:00'""")(
    lambda v: op.stories_due(v.posts, POST_NOW).select("id", "parent_post_id"))
query("reconcile_media", """
SELECT o.id, CASE WHEN c.present THEN 'present' WHEN NOT c.present THEN 'gone' ELSE 'unknown' END AS media_state
FROM posts o LEFT JOIN media_checks c ON c.media_id = o.media_id WHERE o.state = 'published' AND o.media_id IS NOT NULL
""")(lambda v: op.reconcile_media(v.posts, v.media_checks).select("id", "media_state"))
query("reach_by_media", """
SELECT o.id, CASE WHEN r.read_at IS NOT NULL THEN r.reach ELSE o.reach END AS reach, r.read_at AS reach_checked_at
FROM posts o LEFT JOIN (SELECT media_id, arg_max(reach, read_at) AS reach, max(read_at) AS read_at
  FROM reach_readings GROUP BY 1) r ON r.media_id = o.media_id""")(
    lambda v: op.reach_by_media(v.posts, v.reach_readings).select("id", "reach", "reach_checked_at"))
query("pick_name", r"""
WITH n AS (SELECT o.media_id, max(coalesce(p.display_name, p.title)) AS listing FROM posts o
  LEFT JOIN properties p ON p.id = o.property_id WHERE o.media_id IS NOT NULL GROUP BY 1)
SELECT m.id, coalesce(n.listing, nullif(regexp_extract(m.caption, '【\s*(.+?)\s*】', 1), ''),
  list_filter(string_split(m.caption, chr(10)), lambda x: x NOT IN ('・', '', 'lead'))[1]) AS name
FROM posts m LEFT JOIN n ON n.media_id = m.media_id""")(
    lambda v: op.pick_names(v.posts.select("id", "media_id", "caption"), v.posts, v.properties, ["・", "lead"])
    .select("id", "name"))
query("asof_note", """
WITH w AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate + INTERVAL 23 YEAR) AS DATE) AS week_start FROM orders),
n AS (SELECT week_start, arg_max(body, {'c': created_at, 'i': id}) AS body FROM weekly_notes GROUP BY 1)
SELECT w.week_start, n.body, n.week_start AS note_week FROM w ASOF LEFT JOIN n ON w.week_start >= n.week_start""")(
    lambda v: op.asof_notes(v.table("orders").selectExpr(
        "CAST(date_trunc('WEEK', o_orderdate + INTERVAL 23 YEARS) AS DATE) AS week_start").distinct(), v.weekly_notes))
query("note_weeks", """
SELECT DISTINCT CAST(date_trunc('week', published_at + INTERVAL 9 HOUR) AS DATE) AS week_start FROM posts
WHERE state = 'published' AND date_trunc('week', published_at + INTERVAL 9 HOUR) + INTERVAL 7 DAY <= DATE '2024-01-29'
  AND CAST(date_trunc('week', published_at + INTERVAL 9 HOUR) AS DATE) NOT IN
    (SELECT week_start FROM weekly_notes WHERE week_start <> DATE '2024-01-15')""")(
    lambda v: op.note_weeks(v.posts, v.weekly_notes.filter("week_start <> DATE '2024-01-15'"),
                            "2024-01-29 03:00:00", "Asia/Tokyo"))

# Queues and targets.
query("delivery_queue", """
SELECT id, delivery_attempts, delivery_attempted_at FROM properties
WHERE status = 'approved' AND delivery_attempts < 3
  AND (delivery_attempted_at IS NULL OR delivery_attempted_at <= TIMESTAMP '2001-08-01' - INTERVAL 600 SECOND)
ORDER BY delivery_attempts, delivery_attempted_at NULLS FIRST, score DESC NULLS LAST, id""")(
    lambda v: op.delivery_queue(v.properties, NOW).select("id", "delivery_attempts", "delivery_attempted_at"))
query("queue_size", "SELECT count(*) AS n FROM properties WHERE status = 'approved' AND delivery_attempts < 3")(
    lambda v: v.properties.filter("status = 'approved' AND delivery_attempts < 3").agg(F.count("*").alias("n")))
query("due_posts", """
SELECT id, kind, scheduled_at FROM posts WHERE state = 'planned' AND attempts < 3 AND kind IN ('feed', 'story')
  AND scheduled_at <= TIMESTAMP '2024-01-20 03:00:00' AND scheduled_at >= TIMESTAMP '2024-01-19 21:00:00'""")(
    lambda v: op.due_posts(v.posts, POST_NOW, kinds=["feed", "story"], not_before="2024-01-19 21:00:00")
    .select("id", "kind", "scheduled_at"))
query("stale_posts", """SELECT id, scheduled_at FROM posts WHERE state = 'planned'
  AND scheduled_at < TIMESTAMP '2024-01-20 03:00:00'""")(
    lambda v: op.stale_posts(v.posts, POST_NOW).select("id", "scheduled_at"))
query("next_due", """SELECT min(scheduled_at) AS next_at FROM posts WHERE state = 'planned' AND attempts < 3
  AND scheduled_at >= TIMESTAMP '2024-01-20 03:00:00'""")(lambda v: op.next_due(v.posts, not_before=POST_NOW))
query("status_targets", """
SELECT id, listing_status_at FROM properties WHERE status IN ('approved', 'delivered')
  AND (source_url LIKE 'http%' OR listing_url LIKE 'http%')
ORDER BY listing_status_at NULLS FIRST, id DESC""")(
    lambda v: op.status_targets(v.properties).select("id", "listing_status_at"))
query("relink_targets", "SELECT id, source, status FROM properties WHERE listing_url IS NULL OR listing_url = ''")(
    lambda v: op.relink_targets(v.properties).select("id", "source", "status"))
query("backfill_targets", """
SELECT id, status FROM properties WHERE scored_at IS NOT NULL AND (display_name IS NULL OR caption_body IS NULL
  OR style_name IS NULL OR length(display_name) > 40)""")(
    lambda v: op.backfill_targets(v.properties, BACKFILL_FIELDS).select("id", "status"))
query("rescore_targets", """
SELECT id, scored_at FROM properties WHERE status = 'pending' AND scored_at < TIMESTAMP '1999-01-01'""")(
    lambda v: op.rescore_targets(v.properties, ["pending"], "1999-01-01 00:00:00").select("id", "scored_at"))
query("published_between", """
SELECT id, published_at FROM posts WHERE kind = 'feed' AND state = 'published'
  AND published_at >= TIMESTAMP '2024-01-07 15:00:00' AND published_at < TIMESTAMP '2024-01-14 15:00:00'""")(
    lambda v: op.published_between(v.posts, "2024-01-07 15:00:00", "2024-01-14 15:00:00").select("id", "published_at"))
query("awaiting_story", """
SELECT o.id, o.published_at, p.title, p.location_city, p.listing_url FROM posts o
LEFT JOIN properties p ON p.id = o.property_id WHERE o.kind = 'feed' AND o.state = 'published'
  AND o.published_at >= TIMESTAMP '2024-01-13 15:00:00' AND o.published_at < TIMESTAMP '2024-01-14 15:00:00'""")(
    lambda v: op.posts_with_property(
        op.published_between(v.posts, "2024-01-13 15:00:00", "2024-01-14 15:00:00"), v.properties)
    .select("id", "published_at", "title", "location_city", "listing_url"))
query("reach_targets", """
SELECT id, media_id, published_at, reach FROM posts WHERE state = 'published' AND media_id IS NOT NULL
  AND published_at >= TIMESTAMP '2024-01-20 03:00:00'""")(
    lambda v: op.reach_targets(v.posts, POST_NOW).select("id", "media_id", "published_at", "reach"))
query("reviewed_rows", """
SELECT id, source, source_rank, status, score, genre, year_built, style_identified FROM properties
WHERE score IS NOT NULL""")(
    lambda v: op.reviewed_rows(v.properties).select("id", "source", "source_rank", "status", "score", "genre",
                                                    "year_built", "style_identified"))
query("deletable", """
SELECT id FROM properties WHERE status <> 'delivered' AND id IN (SELECT property_id FROM image_skips
  WHERE reason = 'broken')""")(
    lambda v: op.deletable(v.properties, ids=v.image_skips.filter("reason = 'broken'").selectExpr("property_id AS id"))
    .select("id"))

# Counts.
query("skip_reasons", """
SELECT s.property_id, s.reason, count(*) AS n, min(s.source_url) AS sample FROM image_skips s
JOIN properties p ON p.id = s.property_id WHERE p.status = 'approved' GROUP BY 1, 2""")(
    lambda v: op.skip_reasons(v.image_skips, v.properties))
query("delivery_errors", """
SELECT source, trim(string_split(coalesce(delivery_error, 'untried'), ':')[1]) AS error_head, count(*) AS n,
  count(*) FILTER (delivery_attempts >= 3) AS stuck FROM properties WHERE status = 'approved' GROUP BY 1, 2""")(
    lambda v: op.delivery_errors(v.properties))
query("image_report", """
SELECT property_id, reason, count(*) AS n FROM (SELECT property_id, 'kept' AS reason FROM images
  UNION ALL SELECT property_id, reason FROM image_skips) t GROUP BY 1, 2""")(
    lambda v: op.image_report(v.images, v.image_skips))
query("backfill_cost", """
SELECT count(*) AS n, CAST(sum(length(content_text)) AS BIGINT) AS chars,
  CAST(floor(sum(length(content_text)) / 2.5 + count(*) * 1200) AS BIGINT) AS tokens_in, count(*) * 800 AS tokens_out,
  round(floor(sum(length(content_text)) / 2.5 + count(*) * 1200) / 1e6 + count(*) * 800 / 1e6 * 5, 4) AS dollars
FROM properties WHERE scored_at IS NOT NULL AND (display_name IS NULL OR caption_body IS NULL OR style_name IS NULL
  OR length(display_name) > 40)""")(
    lambda v: op.reading_cost(op.backfill_targets(v.properties, BACKFILL_FIELDS), 800))
query("rescore_cost", """
SELECT status, count(*) AS n, CAST(sum(length(content_text)) AS BIGINT) AS chars,
  CAST(floor(sum(length(content_text)) / 2.5 + count(*) * 1200) AS BIGINT) AS tokens_in, count(*) * 400 AS tokens_out,
  round(floor(sum(length(content_text)) / 2.5 + count(*) * 1200) / 1e6 + count(*) * 400 / 1e6 * 5, 4) AS dollars
FROM properties WHERE scored_at IS NOT NULL AND status <> 'delivered' GROUP BY status""")(
    lambda v: op.reading_cost(op.rescore_targets(v.properties), 400, ["status"]))
query("lookup_cost", """
SELECT count(*) AS n, CAST(sum(least(coalesce(i.n, 0), 2)) AS BIGINT) AS lookups,
  round(sum(least(coalesce(i.n, 0), 2)) * 0.0035, 4)::DOUBLE AS dollars FROM properties p
LEFT JOIN (SELECT property_id, count(*) AS n FROM images GROUP BY 1) i ON i.property_id = p.id
WHERE p.status IN ('approved', 'delivered') AND coalesce(i.n, 0) < 10""")(
    lambda v: op.lookup_cost(v.properties, v.images))
query("status_summary", """
SELECT coalesce(listing_status, 'unchecked') AS listing_status, count(*) AS n,
  coalesce(listing_status, 'unchecked') IN ('sold', 'off_market') AS gone
FROM properties WHERE status IN ('approved', 'delivered') GROUP BY 1""")(lambda v: op.status_summary(v.properties))
query("copy_tables", """
SELECT 'orders' AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS same FROM orders
UNION ALL SELECT 'lineitem', count(*), count(*), true FROM lineitem""")(lambda v: _copy(v))


def _copy(v):
    import uuid

    from curalens.session import work_dir
    target = f"{work_dir(v.spark)}/copy-{uuid.uuid4().hex}"
    return tables.copy_tables({n: v.table(n) for n in ("orders", "lineitem")}, target)
