"""State changes over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens.operators import merging as op
from curalens.operators.post_fold import fold_posts
from curalens.plans.registry import query


def _lofts(v):
    return v.properties.filter("genre = 'loft'").select("id")


query("insert_once", """
WITH known AS (SELECT 'https://x.example.com/' || (l_partkey % 5000) AS source_url FROM lineitem WHERE l_returnflag = 'A'),
inc AS (SELECT 'https://x.example.com/' || (l_orderkey % 9000) AS source_url, l_orderkey * 1000 + l_partkey AS seq,
  l_suppkey AS source FROM lineitem WHERE l_returnflag <> 'A')
SELECT source_url, min(seq) AS seq FROM inc
WHERE source_url NOT IN (SELECT source_url FROM known) GROUP BY source_url""")(
    lambda v: op.insert_once(
        v.table("lineitem").filter("l_returnflag = 'A'").selectExpr(
            "concat('https://x.example.com/', l_partkey % 5000) AS source_url"),
        v.table("lineitem").filter("l_returnflag <> 'A'").selectExpr(
            "concat('https://x.example.com/', l_orderkey % 9000) AS source_url", "l_orderkey * 1000 + l_partkey AS seq",
            "l_suppkey AS source"), ["source_url"], ["seq"]).select("source_url", "seq"))
query("insert_once_posts", """
WITH inc AS (SELECT * FROM posts WHERE state = 'planned'), cur AS (SELECT * FROM posts WHERE state = 'published')
SELECT property_id, kind, min(id) AS id FROM inc i WHERE property_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM cur c WHERE c.property_id = i.property_id AND c.kind = i.kind) GROUP BY 1, 2
UNION ALL SELECT property_id, kind, id FROM inc WHERE property_id IS NULL""")(
    lambda v: op.insert_once(v.posts.filter("state = 'published'"),
                             v.posts.filter("state = 'planned'").select("property_id", "kind", "id"),
                             ["property_id", "kind"], ["id"]))
query("merge_scores", """
WITH a AS (SELECT * EXCLUDE (summary), 'because ' || story_score AS score_reason, 'short ' || property_id AS summary, '12 Pine Road' AS street_address
  FROM assessments WHERE story_score > 30)
SELECT p.id, CASE WHEN a.property_id IS NOT NULL THEN CAST(a.story_score AS DOUBLE) ELSE p.score END AS score,
  CASE WHEN a.property_id IS NOT NULL THEN TIMESTAMP '2024-05-01 00:00:00' ELSE p.scored_at END AS scored_at,
  CASE WHEN a.property_id IS NOT NULL THEN a.score_reason ELSE 'old' END AS score_reason,
  CASE WHEN a.property_id IS NOT NULL THEN a.summary ELSE 'old' END AS summary,
  CASE WHEN a.property_id IS NOT NULL THEN nullif(a.genre, '') ELSE p.genre END AS genre,
  CASE WHEN a.property_id IS NOT NULL THEN nullif(a.year_built, '') ELSE p.year_built END AS year_built,
  CASE WHEN a.property_id IS NOT NULL THEN TRY_CAST(nullif(regexp_extract(coalesce(a.year_built, ''), '\\b(1[0-9]{3}|20[0-9]{2})s?\\b', 1), '') AS INT)
    ELSE p.year_built_value END AS year_built_value,
  coalesce(p.street_address, a.street_address) AS street_address,
  coalesce(p.location_city, nullif(a.city, '')) AS location_city,
  coalesce(p.location_country, nullif(a.country, '')) AS location_country,
  coalesce(p.price, nullif(a.price, '')) AS price,
  CASE WHEN a.property_id IS NOT NULL THEN a.one_of_a_kind ELSE p.one_of_a_kind END AS one_of_a_kind,
  p.reject_reason, p.status, p.listing_url
FROM properties p LEFT JOIN a ON a.property_id = p.id""")(
    lambda v: op.merge_scores(
        v.properties.withColumns({"score_reason": F.lit("old"), "summary": F.lit("old")}),
        v.assessments.filter("story_score > 30").withColumns({
            "score": F.col("story_score").cast("double"), "scored_at": F.lit("2024-05-01").cast("timestamp"),
            "score_reason": F.concat(F.lit("because "), "story_score"), "summary": F.concat(F.lit("short "), "property_id"),
            "street_address": F.lit("12 Pine Road")})
        .select("property_id", "score", "scored_at", "score_reason", "summary", "street_address", "genre", "architect", "year_built", "display_name",
                "city", "country", "price", "style_identified", "one_of_a_kind", "provenance_visible"))
    .select("id", "score", "scored_at", "score_reason", "summary", "genre", "year_built", "year_built_value", "street_address", "location_city",
            "location_country", "price", "one_of_a_kind", "reject_reason", "status", "listing_url"))
query("fill_blanks", """
SELECT p.id, CASE WHEN length(p.display_name) > 40 AND a.display_name <> '' THEN a.display_name
    ELSE coalesce(p.display_name, nullif(a.display_name, '')) END AS display_name,
  coalesce(p.architect, nullif(a.architect, '')) AS architect
FROM properties p LEFT JOIN assessments a ON a.property_id = p.id""")(
    lambda v: op.fill_blanks(v.properties, v.assessments, ["display_name", "architect"])
    .select("id", "display_name", "architect"))
query("apply_reviews", """
WITH e AS (SELECT property_id, arg_max({'a': action, 'r': reason, 't': "at"}, {'t': "at", 's': seq}) AS ev,
    bool_or(action IN ('approve', 'reset')) AS clears
  FROM review_events WHERE action <> 'reject' OR reason IS NOT NULL GROUP BY 1),
m AS (SELECT p.*, CASE WHEN p.status <> 'delivered' THEN e.ev END AS ev, p.status <> 'delivered' AND coalesce(e.clears, false) AS clears
  FROM properties p LEFT JOIN e ON e.property_id = p.id)
SELECT id, CASE WHEN ev IS NULL THEN status WHEN ev.a = 'approve' THEN 'approved' WHEN ev.a = 'reject' THEN 'rejected' ELSE 'pending' END AS status,
  CASE WHEN ev IS NULL THEN reject_reason WHEN ev.a = 'reject' THEN ev.r END AS reject_reason,
  CASE WHEN ev IS NULL THEN reviewed_at WHEN ev.a = 'reset' THEN NULL ELSE ev.t END AS reviewed_at,
  CASE WHEN clears THEN 0 ELSE delivery_attempts END AS delivery_attempts,
  CASE WHEN NOT clears THEN delivery_error END AS delivery_error,
  CASE WHEN NOT clears THEN delivery_attempted_at END AS delivery_attempted_at, image_page_url, price, listing_status_note
FROM m""")(
    lambda v: op.apply_reviews(v.properties, v.review_events)
    .select("id", "status", "reject_reason", "reviewed_at", "delivery_attempts", "delivery_error", "delivery_attempted_at", "image_page_url", "price",
            "listing_status_note"))
query("review_feedback", """
SELECT e.property_id, e.reason, e.at AS created_at FROM review_events e JOIN properties p ON p.id = e.property_id
WHERE e.action = 'reject' AND e.reason IS NOT NULL AND p.status <> 'delivered'""")(
    lambda v: op.feedback_from_reviews(v.properties, v.review_events).drop("seq"))
# The fold as a scan: code = state * 4 + attempts.
query("apply_post_events", """
WITH l AS (SELECT post_id, list(CASE action WHEN 'claim' THEN 1 WHEN 'finish' THEN 2 WHEN 'fail' THEN 3
  WHEN 'skip' THEN 4 WHEN 'retry' THEN 5 END ORDER BY "at", seq) AS acts FROM post_events GROUP BY 1),
r AS (SELECT post_id, list_reduce(list_prepend(0, acts), lambda c, a: CASE
    WHEN a = 1 AND c // 4 = 0 AND c % 4 < 3 THEN 4 + c % 4 + 1
    WHEN a = 2 THEN 8 + c % 4
    WHEN a = 3 THEN CASE WHEN c % 4 >= 3 THEN 12 + c % 4 ELSE c % 4 END
    WHEN a = 4 AND c // 4 IN (0, 3) THEN 16 + c % 4
    WHEN a = 5 AND c // 4 IN (3, 4) THEN 0 ELSE c END) AS c FROM l)
SELECT post_id, ['planned', 'publishing', 'published', 'failed', 'skipped', 'deleted'][c // 4 + 1] AS state,
  CAST(c % 4 AS INT) AS attempts FROM r""")(lambda v: op.apply_post_events(v.post_events))
# The whole fold, event by event: each element carries the post as it is after it.
_MOVABLE, _BACK = "x.s IN ('planned', 'failed', 'skipped')", "(e.a = 'requeue' AND x.s = 'published')"
_RESET = f"((e.a = 'retry' AND x.s IN ('failed', 'skipped')) OR {_BACK})"
query("fold_posts", f"""
WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 3 ELSE event_id // 12 * 3 END AS post_id, ts AS "at", event_id AS seq,
    ['claim', 'note', 'finish', 'caption', 'fail', 'share', 'retry', 'permalink', 'claim', 'reschedule', 'requeue', 'skip', 'image_order',
     'finish', 'unshare', 'abandon', 'claim'][event_id // 3 % 17 + 1] AS action, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'v' || event_id END AS value,
    'c' || event_id AS other, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 1 DAY END AS value_at, event_id % 5 = 0 AS by_hand FROM events),
l AS (SELECT post_id, list({{'a': action, 'at': "at", 'v': value, 'o': other, 't': value_at, 'h': by_hand, 's': NULL::VARCHAR, 'n': NULL::INT,
    'sch': NULL::TIMESTAMP, 'err': NULL::VARCHAR, 'pub': NULL::TIMESTAMP, 'mid': NULL::VARCHAR, 'cap': NULL::VARCHAR, 'hand': NULL::TIMESTAMP,
    'ord': NULL::VARCHAR, 'note': NULL::VARCHAR, 'sh': NULL::TIMESTAMP, 'perma': NULL::VARCHAR}} ORDER BY "at", seq) AS evs FROM e GROUP BY 1),
f AS (SELECT p.id, list_reduce(list_prepend({{'a': NULL::VARCHAR, 'at': NULL::TIMESTAMP, 'v': NULL::VARCHAR, 'o': NULL::VARCHAR, 't': NULL::TIMESTAMP,
    'h': NULL::BOOLEAN, 's': p.state, 'n': p.attempts, 'sch': p.scheduled_at, 'err': p.error, 'pub': p.published_at, 'mid': p.media_id, 'cap': p.caption,
    'hand': p.caption_edited_at, 'ord': p.image_order, 'note': p.note, 'sh': NULL::TIMESTAMP, 'perma': NULL::VARCHAR}}, coalesce(l.evs, [])),
  lambda x, e: {{'a': e.a, 'at': e.at, 'v': e.v, 'o': e.o, 't': e.t, 'h': e.h,
    's': CASE WHEN e.a = 'claim' AND x.s = 'planned' AND x.n < 3 THEN 'publishing' WHEN e.a = 'finish' THEN 'published'
      WHEN e.a = 'fail' THEN CASE WHEN x.n >= 3 THEN 'failed' ELSE 'planned' END WHEN e.a = 'abandon' THEN 'skipped'
      WHEN e.a = 'skip' AND x.s IN ('planned', 'failed') THEN 'skipped' WHEN {_RESET} THEN 'planned' ELSE x.s END,
    'n': CASE WHEN e.a = 'claim' AND x.s = 'planned' AND x.n < 3 THEN x.n + 1 WHEN {_RESET} THEN 0 ELSE x.n END,
    'sch': CASE WHEN e.a = 'reschedule' AND {_MOVABLE} THEN e.t WHEN {_BACK} AND e.t IS NOT NULL THEN e.t ELSE x.sch END,
    'err': CASE WHEN e.a = 'fail' THEN e.v WHEN e.a = 'finish' OR {_RESET} THEN NULL ELSE x.err END,
    'pub': CASE WHEN e.a = 'finish' THEN e.at WHEN {_BACK} THEN NULL ELSE x.pub END,
    'mid': CASE WHEN e.a = 'finish' THEN e.v WHEN {_BACK} THEN NULL ELSE x.mid END,
    'cap': CASE WHEN e.a = 'caption' AND {_MOVABLE} THEN e.v ELSE x.cap END,
    'hand': CASE WHEN e.a = 'caption' AND e.h AND {_MOVABLE} THEN e.at ELSE x.hand END,
    'ord': CASE WHEN e.a = 'image_order' AND {_MOVABLE} THEN e.v ELSE x.ord END,
    'note': CASE WHEN e.a = 'note' THEN nullif(trim(e.v), '') ELSE x.note END,
    'sh': CASE WHEN e.a = 'share' AND x.s = 'published' THEN e.at WHEN e.a = 'unshare' AND x.s = 'published' THEN NULL ELSE x.sh END,
    'perma': CASE WHEN e.a = 'permalink' THEN e.v WHEN {_BACK} THEN NULL ELSE x.perma END}}) AS r
  FROM posts p LEFT JOIN l ON l.post_id = p.id)
SELECT id, r.s AS state, r.n AS attempts, r.sch AS scheduled_at, r.err AS error, r.pub AS published_at, r.mid AS media_id, r.cap AS caption,
  r.hand AS caption_edited_at, r.ord AS image_order, r.note AS note, r.sh AS story_shared_at, r.perma AS permalink FROM f""")(
    lambda v: fold_posts(v.posts.withColumns({"story_shared_at": F.lit(None).cast("timestamp"), "permalink": F.lit(None).cast("string")}),
                         v.table("events").selectExpr(
        "IF(event_id % 3 = 0, 3, event_id div 12 * 3) AS post_id", "ts AS at", "event_id AS seq",
        "element_at(array('claim', 'note', 'finish', 'caption', 'fail', 'share', 'retry', 'permalink', 'claim', 'reschedule', 'requeue', 'skip', "
        "'image_order', 'finish', 'unshare', 'abandon', 'claim'), CAST(event_id div 3 % 17 + 1 AS INT)) AS action",
        "IF(event_id % 9 = 0, ' ', concat('v', event_id)) AS value", "concat('c', event_id) AS other",
        "IF(event_id % 4 <> 0, ts + INTERVAL 1 DAY, NULL) AS value_at", "event_id % 5 = 0 AS by_hand"))
    .select("id", "state", "attempts", "scheduled_at", "error", "published_at", "media_id", "caption", "caption_edited_at", "image_order", "note",
            "story_shared_at", "permalink"))
_FIELDS = "['caption', 'image_order', 'note', 'scheduled_at', 'story_shared', 'permalink']"
query("edit_posts", f"""
WITH e AS (SELECT event_id // 16 * 3 AS post_id, event_id AS seq, ts AS at, {_FIELDS}[event_id % 6 + 1]
    AS field, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'v' || event_id END AS value, event_id % 4 = 0 AS by_hand FROM events),
l AS (SELECT post_id, field, arg_max({{'v': value, 'at': "at"}}, seq) AS x, max(CASE WHEN by_hand THEN "at" END) AS hand FROM e GROUP BY 1, 2)
SELECT p.id, CASE WHEN p.state IN ('planned', 'failed', 'skipped') AND c.x IS NOT NULL THEN c.x.v ELSE p.caption END AS caption,
  CASE WHEN p.state IN ('planned', 'failed', 'skipped') AND c.hand IS NOT NULL THEN c.hand ELSE p.caption_edited_at END
    AS caption_edited_at,
  CASE WHEN p.state IN ('planned', 'failed', 'skipped') AND i.x IS NOT NULL THEN i.x.v ELSE p.image_order END
    AS image_order, CASE WHEN n.x IS NOT NULL THEN nullif(trim(n.x.v), '') ELSE p.note END AS note,
  CASE WHEN p.state IN ('planned', 'failed', 'skipped') AND s.x IS NOT NULL THEN s.x.at + INTERVAL 2 DAY ELSE p.scheduled_at END AS scheduled_at,
  CASE WHEN p.state = 'published' AND h.x IS NOT NULL THEN CASE WHEN trim(h.x.v) <> '' THEN h.x.at END
    ELSE CASE WHEN p.id % 2 = 0 THEN p.scheduled_at END END AS story_shared_at, CASE WHEN k.x IS NOT NULL THEN k.x.v END AS permalink
FROM posts p LEFT JOIN l c ON c.post_id = p.id AND c.field = 'caption'
LEFT JOIN l i ON i.post_id = p.id AND i.field = 'image_order' LEFT JOIN l n ON n.post_id = p.id AND n.field = 'note'
LEFT JOIN l s ON s.post_id = p.id AND s.field = 'scheduled_at' LEFT JOIN l h ON h.post_id = p.id AND h.field = 'story_shared'
LEFT JOIN l k ON k.post_id = p.id AND k.field = 'permalink'""")(
    lambda v: op.edit_posts(v.posts.withColumns({"story_shared_at": F.expr("IF(id % 2 = 0, scheduled_at, NULL)"), "permalink": F.lit(None).cast("string")}),
                            v.table("events").selectExpr(
        "event_id div 16 * 3 AS post_id", "event_id AS seq", "ts AS at",
        "element_at(array('caption', 'image_order', 'note', 'scheduled_at', 'story_shared', 'permalink'), CAST(event_id % 6 + 1 AS INT)) AS field",
        "IF(event_id % 11 = 0, ' ', concat('v', event_id)) AS value", "event_id % 4 = 0 AS by_hand", "ts + INTERVAL 2 DAYS AS value_at"))
    .select("id", "caption", "caption_edited_at", "image_order", "note", "scheduled_at", "story_shared_at", "permalink"))
query("delivery_failures", """
WITH f AS (SELECT l_orderkey AS property_id, count(*) AS n, max(l_shipdate) AS at,
  arg_max('broke at ' || l_partkey, {'t': l_shipdate, 's': l_partkey * 100 + l_linenumber}) AS message
  FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1)
SELECT p.id, CAST(p.delivery_attempts + coalesce(f.n, 0) AS BIGINT) AS delivery_attempts,
  coalesce(f.message, p.delivery_error) AS delivery_error, coalesce(f.at, p.delivery_attempted_at) AS delivery_attempted_at
FROM properties p LEFT JOIN f ON f.property_id = p.id""")(
    lambda v: op.delivery_failures(v.properties, v.table("lineitem").filter("l_discount >= 0.09").selectExpr(
        "l_orderkey AS property_id", "l_shipdate AS at", "l_partkey * 100 + l_linenumber AS seq",
        "concat('broke at ', l_partkey) AS message"))
    .select("id", "delivery_attempts", "delivery_error", "delivery_attempted_at"))
query("retry_delivery", """
SELECT id, CASE WHEN status = 'approved' AND source = 'src0' THEN 0 ELSE delivery_attempts END AS delivery_attempts,
  CASE WHEN status = 'approved' AND source = 'src0' THEN NULL ELSE delivery_error END AS delivery_error
FROM properties""")(
    lambda v: op.retry_delivery(v.properties, v.properties.filter("source = 'src0'").select("id"))
    .select("id", "delivery_attempts", "delivery_error"))
query("undo_delivery", """
SELECT id, CASE WHEN status = 'delivered' AND genre = 'loft' THEN 'approved' ELSE status END AS status,
  CASE WHEN status = 'delivered' AND genre = 'loft' THEN 0 ELSE delivery_attempts END AS delivery_attempts
FROM properties""")(
    lambda v: op.undo_delivery(v.properties, v.deliveries, _lofts(v))[0]
    .select("id", "status", "delivery_attempts"))
query("undo_delivery_rows", """SELECT property_id, folder_name FROM deliveries
WHERE property_id NOT IN (SELECT id FROM properties WHERE genre = 'loft')""")(
    lambda v: op.undo_delivery(v.properties, v.deliveries, _lofts(v))[1]
    .select("property_id", "folder_name"))
query("purge_dropped", """
SELECT 'p' || id AS media, id AS post_id FROM posts WHERE state NOT IN ('skipped', 'deleted')""")(
    lambda v: op.purge_dropped(v.posts.selectExpr("concat('p', id) AS media", "id AS post_id"), v.posts))
query("clear_stale_skips", """
SELECT s.property_id, s.source_url, s.reason FROM image_skips s
WHERE s.reason NOT IN ('too_small', 'wrong_type')
  OR s.property_id NOT IN (SELECT id FROM properties WHERE status <> 'delivered')""")(
    lambda v: op.clear_stale_skips(v.image_skips, v.properties).select("property_id", "source_url", "reason"))
query("clear_scores", """
SELECT id, CASE WHEN status <> 'delivered' AND source = 'src0' THEN NULL ELSE score END AS score,
  CASE WHEN status <> 'delivered' AND source = 'src0' THEN NULL ELSE scored_at END AS scored_at FROM properties""")(
    lambda v: op.clear_scores(v.properties, v.properties.filter("source = 'src0'").select("id"))
    .select("id", "score", "scored_at"))
query("set_series", """
SELECT p.id, CASE WHEN p.status <> 'delivered' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')
  THEN CASE WHEN o.o_orderpriority = '2-HIGH' THEN 'lake' END ELSE p.series END AS series
FROM properties p JOIN orders o ON o.o_orderkey = p.id""")(
    lambda v: op.set_series(v.properties, v.table("orders").filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").selectExpr(
        "o_orderkey AS property_id", "IF(o_orderpriority = '2-HIGH', 'lake', '') AS series")).select("id", "series"))
query("set_listing", """
WITH c AS (SELECT l_orderkey AS property_id, arg_max({'v': CASE l_returnflag WHEN 'A' THEN 'sold' ELSE 'active' END,
    'm': CASE WHEN l_partkey % 2 = 0 THEN 'M' || l_partkey END, 'n': 'page says ' || l_returnflag, 't': ts}, ts) AS x
  FROM (SELECT *, l_shipdate + to_seconds(l_partkey * 10 + l_linenumber) AS ts FROM lineitem)
  WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT p.id, CASE WHEN c.x IS NOT NULL THEN c.x.v ELSE p.listing_status END AS listing_status,
  CASE WHEN c.x IS NOT NULL THEN c.x.t ELSE p.listing_status_at END AS listing_status_at,
  CASE WHEN c.x IS NOT NULL THEN c.x.n ELSE p.listing_status_note END AS listing_status_note,
  coalesce(c.x.m, p.mls_number) AS mls_number FROM properties p LEFT JOIN c ON c.property_id = p.id""")(
    lambda v: op.set_listing(v.properties, v.table("lineitem").selectExpr(
        "l_orderkey AS property_id", "CASE l_returnflag WHEN 'A' THEN 'sold' WHEN 'R' THEN 'active' END AS value",
        "CASE WHEN l_partkey % 2 = 0 THEN concat('M', l_partkey) END AS mls", "concat('page says ', l_returnflag) AS note",
        "l_shipdate + make_interval(0, 0, 0, 0, 0, 0, l_partkey * 10 + l_linenumber) AS at"))
    .select("id", "listing_status", "listing_status_at", "listing_status_note", "mls_number"))
query("set_feedback_tag", """
SELECT id, coalesce(reason_tag, CASE WHEN reason LIKE '%LOW%' THEN 'other' END) AS reason_tag FROM feedback""")(
    lambda v: op.set_feedback_tag(v.feedback, v.feedback.filter("reason_tag IS NULL AND reason LIKE '%LOW%'")
                                  .selectExpr("id", "'other' AS reason_tag")).select("id", "reason_tag"))
query("decide_rules", """
SELECT reason_tag, CASE WHEN hit_count > 30 THEN 'approved' WHEN hit_count > 25 THEN 'dismissed' ELSE state END AS state
FROM rules""")(
    lambda v: op.decide_rules(v.rules, v.rules.selectExpr(
        "reason_tag", "CASE WHEN hit_count > 30 THEN 'approved' WHEN hit_count > 25 THEN 'dismissed' ELSE 'maybe' END "
        "AS decision")).select("reason_tag", "state"))
query("set_image_page", """
SELECT id, CASE WHEN status = 'approved' AND genre = 'loft' THEN 'https://photos.example.com/' || id ELSE image_page_url END AS image_page_url,
  CASE WHEN status = 'approved' AND genre = 'loft' THEN 0 ELSE delivery_attempts END AS delivery_attempts,
  CASE WHEN status = 'approved' AND genre = 'loft' THEN NULL ELSE delivery_error END AS delivery_error FROM properties""")(
    lambda v: op.set_image_page(v.properties, _lofts(v).selectExpr(
        "id AS property_id", "concat('https://photos.example.com/', id) AS url"))
    .select("id", "image_page_url", "delivery_attempts", "delivery_error"))
query("delete_candidates", "SELECT id, status FROM properties WHERE NOT (source = 'src0' AND status <> 'delivered')")(
    lambda v: op.delete_candidates(v.properties, source="src0").select("id", "status"))
query("replace_note", """
SELECT week_start, arg_max(id, {'c': created_at, 'i': id}) AS id, arg_max(body, {'c': created_at, 'i': id}) AS body,
  arg_max(source, {'c': created_at, 'i': id}) AS source, max(created_at) AS created_at FROM weekly_notes
WHERE week_start < DATE '2024-01-15' GROUP BY 1""")(lambda v: op.replace_note(v.weekly_notes, "2024-01-15"))
query("clear_images", """
SELECT property_id, source_url, position FROM images WHERE property_id NOT IN
  (SELECT id FROM properties WHERE status <> 'delivered' AND source = 'src0')""")(
    lambda v: op.clear_images(v.images, v.image_skips, v.properties, v.properties.filter("source = 'src0'").select("id"))[0]
    .select("property_id", "source_url", "position"))
query("refresh_values", """
SELECT id, round(price_value, 2) AS price_value, CASE WHEN price = 'Price on request' THEN NULL ELSE price_currency END
  AS price_currency, year_built_value FROM properties""")(
    lambda v: op.refresh_values(v.properties).select("id", F.round("price_value", 2).alias("price_value"),
                                                     "price_currency", "year_built_value"))
