"""Streaming jobs over the supplied event table, run until all of it is used."""

from __future__ import annotations

from curalens.plans.registry import query
from curalens.sources import standins
from curalens.sources.landing import landing_path
from curalens.streaming import jobs
from curalens.streaming.levels import admitted, current_rows


def _start(v, name: str):
    folder = landing_path(v.spark, name)
    own = jobs.stream_session(v.spark)
    return own, jobs.read_events(own, f"{v.base}/events.parquet*"), folder


def _posts(events):
    return events.selectExpr(*standins._POST_COLUMNS).filter("state = 'published'")


def _appended(v, name, build, partition_by=None):
    own, events, folder = _start(v, name)
    jobs.land_appends(build(events), folder, partition_by)
    return own.read.parquet(f"{folder}/rows")


def _updated(v, name, build, keys):
    own, events, folder = _start(v, name)
    jobs.land_updates(build(events), folder, keys)
    return current_rows(own, folder, keys)


def _admitted(v, name, build, key):
    own, events, folder = _start(v, name)
    jobs.land_once(build(events), folder, key)
    return admitted(own, folder, key)


_URL = "concat('https://x.example.com/', user_id, '/', event_type) AS source_url"
query("stream_insert_once", """
SELECT DISTINCT 'https://x.example.com/' || user_id || '/' || event_type AS source_url FROM events""")(
    lambda v: _admitted(v, "insert-once", lambda e: e.selectExpr(_URL), "source_url"))
query("stream_latest_reach", """
SELECT media_id, arg_max(reach, read_at) AS reach, max(read_at) AS read_at, count(*) AS readings FROM reach_readings
GROUP BY 1""")(
    lambda v: _updated(v, "latest-reach", lambda e: jobs.latest_reach(e.selectExpr(
        "concat('m', event_id - event_id % 5) AS media_id", "ts AS read_at", "CAST(floor(value * 10) AS BIGINT) AS reach",
        "event_id AS seq")), ["media_id"]))
query("stream_weekly", """
SELECT date_trunc('week', published_at + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS week_from, count(*) AS posts,
  count(reach) AS measured, CAST(sum(reach) AS BIGINT) AS reach_total FROM posts WHERE state = 'published' GROUP BY 1""")(
    lambda v: _updated(v, "weekly", lambda e: jobs.weekly(_posts(e)), ["week_from"]))
query("stream_trend", """
WITH p AS (SELECT *, date_trunc('week', published_at + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS wk FROM posts
  WHERE state = 'published')
SELECT wk - to_days(CAST(7 * i AS INT)) AS window_from, wk - to_days(CAST(7 * i AS INT)) + INTERVAL 56 DAY AS window_to, kind,
  count(reach) AS posts, CAST(sum(reach) AS BIGINT) AS reach_total FROM p JOIN range(8) r(i) ON true GROUP BY 1, 2, 3""")(
    lambda v: _updated(v, "trend", lambda e: jobs.trend(_posts(e)), ["window_from", "window_to", "kind"]))
query("stream_stale", """
SELECT event_id AS id, CASE WHEN value > 360 THEN 'stale' ELSE 'due' END AS route FROM events""")(
    lambda v: _appended(v, "stale", lambda e: jobs.route_stale(e.selectExpr(
        "event_id AS id", "ts AS arrived_at", "ts - make_interval(0, 0, 0, 0, 0, 0, value * 60) AS scheduled_at")), ["route"])
    .select("id", "route"))
query("stream_retry", """
SELECT user_id AS item_id, least(count(*), 3) AS attempts, count(*) >= 3 AS given_up, CASE WHEN count(*) < 3
  THEN max(ts) + INTERVAL 600 SECOND END AS next_try_at FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1""")(
    lambda v: _updated(v, "retry", lambda e: jobs.retry_state(e.filter("event_type = 'error' AND value > 60").selectExpr(
        "user_id AS item_id", "ts AS at")), ["item_id"]))
# What has come out by the end: the watermark is the newest failure less ten minutes.
query("stream_retry_timers", """
WITH f AS (SELECT user_id AS item_id, ts AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM events WHERE event_type = 'error' AND value > 60),
w AS (SELECT max("at") - INTERVAL 10 MINUTE AS passed FROM f)
SELECT item_id, CAST(n AS INTEGER) AS attempt, 'retry' AS outcome, "at" + INTERVAL 600 SECOND AS "at" FROM f, w WHERE n < 3
  AND (again >= "at" + INTERVAL 600 SECOND OR (again IS NULL AND "at" + INTERVAL 600 SECOND <= passed))
UNION ALL SELECT item_id, CAST(n AS INTEGER), 'given up', "at" FROM f WHERE n = 3""")(
    lambda v: _appended(v, "retry-timers", lambda e: jobs.retries(e.filter("event_type = 'error' AND value > 60").selectExpr(
        "user_id AS item_id", "ts AS at"))))
