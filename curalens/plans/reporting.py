"""Weekly report over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens.functions.clock import week_bounds
from curalens.operators import reporting as op
from curalens.plans.registry import query

ZONE = "Asia/Tokyo"
_WEEK = "CAST(date_trunc('week', published_at + INTERVAL 9 HOUR) AS DATE)"
_TOTALS = f"""
w AS (SELECT {_WEEK} AS week, count(*) AS posts, count(reach) AS measured, CAST(coalesce(sum(reach), 0) AS BIGINT)
  AS reach_total, coalesce(avg(reach), 0) AS reach_avg FROM posts WHERE state = 'published' GROUP BY 1),
t AS (SELECT w.*, coalesce(p.posts, 0) AS prev_posts, coalesce(p.reach_total, 0) AS prev_total,
  coalesce(p.reach_avg, 0) AS prev_avg FROM w LEFT JOIN w p ON p.week = w.week - 7)"""
_MIX = f"""
m AS (SELECT {_WEEK} AS week, coalesce(p.genre, 'unknown') AS genre, coalesce(p.location_country, 'unknown') AS country
  FROM posts o LEFT JOIN properties p ON p.id = o.property_id WHERE o.state = 'published')"""
# Straight from the posts of each window, without the pre-aggregation the plan uses.
_TREND = f"""
wk AS (SELECT DISTINCT {_WEEK} AS week FROM posts WHERE state = 'published'),
ic AS (SELECT property_id, count(*) AS image_count FROM images GROUP BY 1),
r AS (SELECT {_WEEK} AS week, o.reach, coalesce(p.genre, 'unknown') AS genre, coalesce(ic.image_count, 0) >= 8 AS photos,
  coalesce(p.style_identified, false) AS style_identified, coalesce(p.one_of_a_kind, false) AS one_of_a_kind,
  coalesce(p.provenance_visible, false) AS provenance_visible,
  coalesce(p.location_country = 'United States', false) AS united_states, p.year_built_value AS y,
  coalesce(trim(p.architect) <> '', false) AS architect_known, p.score AS s
  FROM posts o JOIN properties p ON p.id = o.property_id LEFT JOIN ic ON ic.property_id = o.property_id
  WHERE o.state = 'published' AND o.kind = 'feed' AND o.reach IS NOT NULL),
x AS (SELECT wk.week AS report_week, r.* EXCLUDE (week) FROM wk JOIN r ON r.week <= wk.week AND r.week > wk.week - 56),
ln AS (SELECT report_week, CASE WHEN count(y) >= 4 THEN floor(median(y)) END AS yl, CASE WHEN count(s) >= 4 THEN median(s)
  END AS sl FROM x GROUP BY 1),
tg AS (SELECT report_week, arg_min(genre, {{'a': -avg_reach, 'g': genre}}) AS top_genre FROM (SELECT report_week, genre,
  avg(reach) AS avg_reach FROM x GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
sd AS (SELECT x.report_week, x.reach, unnest([
  {{'axis': 'genre', 'mark': tg.top_genre, 'yes': x.genre = tg.top_genre}},
  {{'axis': 'photos', 'mark': NULL, 'yes': photos}}, {{'axis': 'style_identified', 'mark': NULL, 'yes': style_identified}},
  {{'axis': 'one_of_a_kind', 'mark': NULL, 'yes': one_of_a_kind}},
  {{'axis': 'provenance_visible', 'mark': NULL, 'yes': provenance_visible}},
  {{'axis': 'united_states', 'mark': NULL, 'yes': united_states}},
  {{'axis': 'built_before', 'mark': CAST(ln.yl AS VARCHAR), 'yes': CASE WHEN ln.yl IS NOT NULL THEN coalesce(y < ln.yl, false) END}},
  {{'axis': 'architect_known', 'mark': NULL, 'yes': architect_known}},
  {{'axis': 'score_at_least', 'mark': CAST(ln.sl AS VARCHAR), 'yes': CASE WHEN ln.sl IS NOT NULL THEN coalesce(s >= ln.sl, false) END}}
  ]) AS e FROM x JOIN ln ON ln.report_week = x.report_week LEFT JOIN tg ON tg.report_week = x.report_week),
pr AS (SELECT report_week, e.axis AS axis, e.mark AS mark, avg(reach) FILTER (e.yes) AS a, avg(reach) FILTER (NOT e.yes) AS b,
  count(*) FILTER (e.yes) AS na, count(*) FILTER (NOT e.yes) AS nb FROM sd WHERE e.yes IS NOT NULL GROUP BY 1, 2, 3),
sp AS (SELECT report_week, axis, mark, CASE WHEN a >= b THEN 'yes' ELSE 'no' END AS winner, greatest(a, b) AS left_avg,
  least(a, b) AS right_avg, CASE WHEN a >= b THEN na ELSE nb END AS n_left, CASE WHEN a >= b THEN nb ELSE na END AS n_right,
  CASE WHEN least(a, b) = 0 THEN 1.0 ELSE greatest(a, b) / least(a, b) END AS lift FROM pr WHERE na >= 2 AND nb >= 2),
st AS (SELECT *, CASE WHEN least(n_left, n_right) >= 3 AND lift >= 1.15 THEN 'trend' WHEN lift >= 1.05 THEN 'hint'
  ELSE 'info' END AS strength FROM sp)"""


def _round(df, *names, to=4):
    return df.withColumns({n: F.round(n, to) for n in names})


def _cube(v):
    return op.report_cube(v.posts, v.properties, v.images, ZONE)


def _insights(v):
    cube = _cube(v)
    return op.insights_top(op.trend_histogram(cube), op.cube_weeks(cube))


def _hist(v):
    return op.trend_histogram(_cube(v))


query("weekly_totals", f"""WITH {_TOTALS.strip()}
SELECT week, posts, measured, reach_total, round(reach_avg, 4) AS reach_avg, prev_posts, prev_total,
  round(prev_avg, 4) AS prev_avg FROM t""")(
    lambda v: _round(op.weekly_totals(v.posts, ZONE), "reach_avg", "prev_avg"))
query("week_over_week", f"""WITH {_TOTALS.strip()}
SELECT week, reach_total - prev_total AS total_delta, round(reach_avg - prev_avg, 4) AS avg_delta FROM t""")(
    lambda v: _round(op.week_over_week(op.weekly_totals(v.posts, ZONE)), "avg_delta"))
query("weekly_mix", f"""WITH {_MIX.strip()}
SELECT week, 'genre' AS dimension, genre AS value, count(*) AS n FROM m GROUP BY 1, 3
UNION ALL SELECT week, 'country', country, count(*) FROM m GROUP BY 1, 3""")(
    lambda v: op.weekly_mix(v.posts, v.properties, ZONE))
query("weekly_stock", """
SELECT CAST(date_trunc('week', collected_at + INTERVAL 9 HOUR) AS DATE) AS week, count(*) AS collected,
  (SELECT count(*) FROM properties WHERE status = 'pending') AS pending,
  (SELECT count(*) FROM properties WHERE status IN ('approved', 'delivered')) AS approved_waiting
FROM properties GROUP BY 1""")(lambda v: op.weekly_stock(v.properties, ZONE))
query("genre_trend", f"""
WITH r AS (SELECT {_WEEK} AS week, coalesce(p.genre, 'unknown') AS genre, o.reach FROM posts o
  JOIN properties p ON p.id = o.property_id WHERE o.state = 'published' AND o.reach IS NOT NULL),
wk AS (SELECT DISTINCT {_WEEK} AS week FROM posts WHERE state = 'published')
SELECT wk.week AS report_week, r.genre, count(*) AS posts, round(avg(r.reach), 4) AS reach_avg FROM wk
JOIN r ON r.week <= wk.week AND r.week > wk.week - 56 GROUP BY 1, 2""")(
    lambda v: _round(op.genre_trend(v.posts, v.properties, ZONE), "reach_avg"))
_SPLIT = ("SELECT report_week, axis, mark, winner, round(left_avg, 4) AS left_avg, round(right_avg, 4) AS right_avg, n_left, "
          "n_right, round(lift, 6) AS lift")
query("split_lift", f"WITH {_TREND.strip()} {_SPLIT} FROM st")(
    lambda v: _round(_round(op.split_lift(_hist(v)), "left_avg", "right_avg"), "lift", to=6).drop("strength"))
query("split_axes", f"WITH {_TREND.strip()} SELECT DISTINCT report_week, axis, mark FROM st")(
    lambda v: op.split_lift(_hist(v)).select("report_week", "axis", "mark"))
query("split_strength", f"WITH {_TREND.strip()} SELECT strength, axis, count(*) AS n FROM st GROUP BY 1, 2")(
    lambda v: op.split_lift(_hist(v)).groupBy("strength", "axis").agg(F.count("*").alias("n")))
query("decision_medians", f"""WITH {_TREND.strip()}
SELECT report_week, 'built_before' AS axis, yl AS line FROM ln WHERE yl IS NOT NULL
UNION ALL SELECT report_week, 'score_at_least', round(sl, 4) FROM ln WHERE sl IS NOT NULL""")(
    lambda v: _round(op.decision_lines(_hist(v)), "line"))
query("insights_top", f"""WITH {_TREND.strip()},
sz AS (SELECT report_week, count(*) AS rows FROM x GROUP BY 1),
rk AS (SELECT st.*, row_number() OVER (PARTITION BY report_week ORDER BY CASE strength WHEN 'trend' THEN 0 WHEN 'hint' THEN 1
  ELSE 2 END, lift DESC, list_position(['genre', 'photos', 'style_identified', 'one_of_a_kind', 'provenance_visible',
  'united_states', 'built_before', 'architect_known', 'score_at_least'], axis)) AS place FROM st
  WHERE report_week IN (SELECT report_week FROM sz WHERE rows >= 6)),
tp AS (SELECT * FROM rk WHERE place <= 4),
ld AS (SELECT wk.week AS report_week, CASE WHEN coalesce(sz.rows, 0) < 6 THEN 'nothing yet'
    WHEN NOT EXISTS (SELECT 1 FROM tp WHERE tp.report_week = wk.week) THEN 'nothing to compare'
    WHEN NOT EXISTS (SELECT 1 FROM tp WHERE tp.report_week = wk.week AND tp.strength <> 'info') THEN 'all alike' END AS finding
  FROM wk LEFT JOIN sz ON sz.report_week = wk.week)
SELECT report_week, CAST(place AS INT) AS place, axis AS finding, strength, round(lift, 6) AS lift FROM tp
UNION ALL SELECT report_week, 0, finding, 'info', NULL FROM ld WHERE finding IS NOT NULL""")(
    lambda v: _round(_insights(v), "lift", to=6))
query("split_stock", f"""WITH {_TREND.strip()}
SELECT report_week, top_genre, (SELECT count(*) FROM properties p WHERE p.status = 'pending' AND p.score IS NOT NULL
  AND p.genre = tg.top_genre) AS stock FROM tg""")(lambda v: op.split_stock(_hist(v), v.properties))
query("weekly_checks", f"""WITH {_TOTALS.strip()}, {_MIX.strip()},
g AS (SELECT week, max(n) AS top FROM (SELECT week, genre, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT week, count(*) FILTER (country IN ('USA', 'United States')) AS us FROM m GROUP BY 1)
SELECT t.week, posts = measured AS all_measured, us * 2 <= posts AS countries_mixed, posts <= 2 OR top * 2 <= posts
  AS genres_mixed FROM t JOIN g ON g.week = t.week JOIN u ON u.week = t.week""")(
    lambda v: op.weekly_checks(op.weekly_totals(v.posts, ZONE), op.weekly_mix(v.posts, v.properties, ZONE)))
query("post_baseline", """
SELECT o.id, o.reach, round(b.baseline_avg, 4) AS baseline_avg, b.baseline_n FROM posts o LEFT JOIN (
  SELECT kind, avg(reach) AS baseline_avg, count(*) AS baseline_n FROM posts WHERE state = 'published' AND reach IS NOT NULL
  AND published_at >= TIMESTAMP '2024-03-10' - INTERVAL 56 DAY GROUP BY 1) b ON b.kind = o.kind
WHERE o.state = 'published'""")(
    lambda v: _round(op.post_baseline(v.posts, "2024-03-10 00:00:00"), "baseline_avg")
    .select("id", "reach", "baseline_avg", "baseline_n"))
query("best_of_week", f"""
SELECT week, id, reach FROM (SELECT {_WEEK} AS week, id, reach, row_number() OVER (PARTITION BY {_WEEK}
  ORDER BY reach DESC, published_at, id) AS rn FROM posts WHERE state = 'published' AND reach IS NOT NULL) WHERE rn = 1""")(
    lambda v: op.best_of_week(v.posts, ZONE))
_DAY = "CAST(published_at + INTERVAL 9 HOUR AS DATE)"
query("daily_winner", f"""
WITH d AS (SELECT {_WEEK} AS week, {_DAY} AS day, id, reach, row_number() OVER (PARTITION BY {_DAY}
    ORDER BY coalesce(reach, 0) DESC, published_at, id) AS rn, count(*) OVER (PARTITION BY {_DAY}) AS n
  FROM posts WHERE state = 'published' AND kind <> 'reel')
SELECT week, day, id, reach, CASE WHEN max(n) OVER (PARTITION BY week) > 1 THEN 'reach' ELSE 'recent' END AS picked_by
FROM d WHERE rn = 1""")(lambda v: op.daily_winners(v.posts, ZONE))
query("publish_delay", """
SELECT id, minutes, CASE WHEN minutes > 0 THEN '+' || minutes ELSE 'on time' END AS shown FROM (
  SELECT id, CAST(round_even((epoch_us(published_at) - epoch_us(scheduled_at)) / 60e6, 0) AS BIGINT) AS minutes
  FROM posts WHERE state = 'published')""")(
    lambda v: op.publish_delays(v.posts.filter("state = 'published'")).select("id", "minutes", "shown"))
query("delay_class", """
SELECT CASE state WHEN 'published' THEN CASE WHEN round_even((epoch_us(published_at) - epoch_us(scheduled_at)) / 60e6, 0) <= 10
    THEN 'normal' ELSE 'late' END WHEN 'planned' THEN 'not out' WHEN 'failed' THEN 'not out' END AS delay, count(*) AS n
FROM posts GROUP BY 1""")(lambda v: op.publish_delays(v.posts).groupBy("delay").agg(F.count("*").alias("n")))
query("week_bounds", """
SELECT id, date_trunc('week', published_at + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS week_from,
  date_trunc('week', published_at + INTERVAL 9 HOUR) + INTERVAL 7 DAY - INTERVAL 9 HOUR AS week_to
FROM posts WHERE state = 'published'""")(
    lambda v: v.posts.filter("state = 'published'").select(
        "id", week_bounds(F.col("published_at"), ZONE)[0].alias("week_from"),
        week_bounds(F.col("published_at"), ZONE)[1].alias("week_to")))
_NUM = r"[0-9]+(?:[.,][0-9]+)?"
query("number_audit", rf"""
WITH n AS (SELECT id, regexp_extract_all(body, '{_NUM}') AS nums, regexp_split_to_array(body, '{_NUM}') AS gaps,
  list_transform(regexp_extract_all(source, '{_NUM}'), lambda x: replace(x, ',', '')) AS have FROM weekly_notes),
t AS (SELECT id, have, list_transform(range(1, len(nums) + 1), lambda i: {{'n': replace(nums[i], ',', ''),
  'tail': array_to_string(list_transform(range(i, len(nums) + 1), lambda j: gaps[j + 1] || coalesce(nums[j + 1], '')), '')}})
  AS parts FROM n),
c AS (SELECT id, have, list_distinct(list_transform(list_filter(parts, lambda p: length(string_split(p.n, '.')[1]) >= 2
  OR regexp_matches(p.tail, '^[〜～~\-–—ー、,.／/や0-9]*[本枚点件％%倍割]')), lambda p: p.n)) AS seen FROM t)
SELECT id, array_to_string(list_sort(list_filter(seen, lambda x: NOT list_contains(have, x))), ',') AS unsupported,
  len(list_filter(seen, lambda x: NOT list_contains(have, x))) > 0 AS refused FROM c""")(
    lambda v: op.number_audit(v.weekly_notes).select("id", F.array_join("unsupported", ",").alias("unsupported"), "refused"))
query("note_plain", r"""
SELECT doc_id, length(plain) AS plain_chars, md5(plain) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(
  replace(replace('# **' || text || '**', '**', ''), '__', ''), '(?m)^#+[^\S\n]*', '', 'g'), '^\s+|\s+$', '', 'g') AS plain
FROM documents)""")(
    lambda v: v.table("documents").select(
        "doc_id", op.note_plain(F.concat(F.lit("# **"), "text", F.lit("**"))).alias("plain"))
    .select("doc_id", F.length("plain").cast("long").alias("plain_chars"), F.md5("plain").alias("digest")))
