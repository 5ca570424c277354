"""Slot planning over the supplied tables. ``now`` is two days after the first event."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens.config import PostConfig
from curalens.operators import slots as op
from curalens.plans.registry import query

CFG = PostConfig(plan_days=14)
_GRID = """
n AS (SELECT min(ts) + INTERVAL 2 DAY AS now FROM events),
gr AS (SELECT CAST(now + INTERVAL 9 HOUR AS DATE) + CAST(i AS INT) AS day, (CAST(now + INTERVAL 9 HOUR AS DATE) + CAST(i AS INT))
    + t - INTERVAL 9 HOUR AS slot_at, now FROM n, range(14) r(i), (VALUES (INTERVAL 9 HOUR), (INTERVAL 13 HOUR), (INTERVAL 20 HOUR)) v(t)),
g AS (SELECT CAST(day AS DATE) AS day, slot_at FROM gr WHERE slot_at > now)"""
_OPEN = _GRID + """,
o AS (SELECT scheduled_at, CAST(scheduled_at + INTERVAL 9 HOUR AS DATE) AS day FROM calendar WHERE kind = 'feed'
  AND state IN ({states})),
u AS (SELECT g.day, greatest(3 - count(o.day), 0) AS places, count(o.day) AS used FROM (SELECT DISTINCT day FROM g) g
  LEFT JOIN o ON o.day = g.day GROUP BY 1),
f AS (SELECT g.*, row_number() OVER (PARTITION BY g.day ORDER BY g.slot_at) AS rn, u.places FROM g JOIN u ON u.day = g.day
  WHERE g.slot_at NOT IN (SELECT scheduled_at FROM o)),
op AS (SELECT day, slot_at, CAST(row_number() OVER (ORDER BY slot_at) AS INT) AS slot_no FROM f WHERE rn <= places)"""
_HOLD = "'planned', 'publishing', 'published', 'failed'"
_BEST = """,
p AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) AS INT) AS place FROM properties p
  WHERE status = 'delivered' AND display_name IS NOT NULL AND caption_body IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM calendar o WHERE o.property_id = p.id AND o.kind = 'feed'))"""


def _anchor(v):
    return v.table("events").agg((F.min("ts") + F.expr("INTERVAL 2 DAYS")).alias("now"))


def _free(v):
    return op.open_slots(op.slot_grid(_anchor(v), CFG), op.occupied_by(v.calendar), CFG)


query("slot_grid", f"WITH {_GRID.strip()} SELECT day, slot_at FROM g")(lambda v: op.slot_grid(_anchor(v), CFG))
query("next_reel", """
WITH n AS (SELECT min(ts) + INTERVAL 2 DAY AS now FROM events),
d AS (SELECT now, CAST(now + INTERVAL 9 HOUR AS DATE) AS day FROM n),
m AS (SELECT now, CAST(day + CAST((7 - (isodow(day) - 1)) % 7 AS INT) AS DATE) AS mon FROM d)
SELECT CASE WHEN mon + INTERVAL 10 HOUR > now THEN mon + INTERVAL 10 HOUR ELSE mon + INTERVAL 7 DAY + INTERVAL 10 HOUR END
  AS reel_at FROM m""")(lambda v: op.next_reel(_anchor(v), CFG))
query("slot_capacity", f"WITH {_OPEN.strip().format(states=_HOLD)} SELECT day, used, places FROM u")(
    lambda v: op.slot_capacity(op.slot_grid(_anchor(v), CFG), op.occupied_by(v.calendar), CFG))
query("open_slots", f"WITH {_OPEN.strip().format(states=_HOLD)} SELECT day, slot_at, slot_no FROM op")(_free)
query("zip_slots", f"""WITH {_OPEN.strip().format(states=_HOLD)}{_BEST}
SELECT slot_no, slot_at, day, p.id AS property_id, p.id IS NULL AS short_of_stock FROM op LEFT JOIN p ON p.place = slot_no""")(
    lambda v: op.zip_slots(_free(v), op.postable(v.properties, v.calendar, None), CFG))
_UNTIL = _OPEN.replace("AND state IN ({states})", "AND state IN ({states}) AND scheduled_at <= (SELECT max(slot_at) FROM g) + INTERVAL 1 MINUTE")
query("plan_posts", f"""WITH {_UNTIL.strip().format(states=_HOLD)}{_BEST},
fd AS (SELECT p.id AS property_id, slot_at, slot_no FROM op JOIN p ON p.place = slot_no),
m AS (SELECT now, CAST(CAST(now + INTERVAL 9 HOUR AS DATE) + CAST((7 - (isodow(CAST(now + INTERVAL 9 HOUR AS DATE)) - 1)) % 7 AS INT) AS DATE)
  AS mon FROM n),
rl AS (SELECT CASE WHEN mon + INTERVAL 10 HOUR > now THEN mon + INTERVAL 10 HOUR ELSE mon + INTERVAL 7 DAY + INTERVAL 10 HOUR
  END AS at_ FROM m),
al AS (SELECT slot_no, property_id, 'feed' AS kind, slot_at AS scheduled_at FROM fd
UNION ALL SELECT slot_no, property_id, 'story', slot_at + INTERVAL 5 MINUTE FROM fd WHERE property_id NOT IN (SELECT property_id
  FROM calendar WHERE kind = 'story' AND property_id IS NOT NULL)
UNION ALL SELECT 2147483647, NULL, 'reel', at_ FROM rl WHERE at_ NOT IN (SELECT scheduled_at FROM calendar WHERE kind = 'reel'
  AND state IN ({_HOLD})) AND EXISTS (SELECT 1 FROM op)),
nb AS (SELECT *, (SELECT max(id) FROM calendar) + row_number() OVER (ORDER BY slot_no, kind) AS id FROM al)
SELECT CAST(id AS BIGINT) AS id, property_id, kind, 'planned' AS state, scheduled_at,
  CASE WHEN kind = 'story' THEN CAST(max(CASE WHEN kind = 'feed' THEN id END) OVER (PARTITION BY slot_no) AS BIGINT) END AS parent_post_id
FROM nb""")(lambda v: op.plan_posts(_anchor(v), v.calendar, v.properties, CFG))
query("compact", f"""WITH {_GRID.strip()},
c AS (SELECT id, state, scheduled_at FROM calendar WHERE kind = 'feed'
  AND scheduled_at > (SELECT now FROM n) AND scheduled_at <= (SELECT max(slot_at) FROM g) + INTERVAL 1 MINUTE),
o AS (SELECT scheduled_at, CAST(scheduled_at + INTERVAL 9 HOUR AS DATE) AS day FROM c WHERE state IN ('published', 'publishing')),
u AS (SELECT g.day, greatest(3 - count(o.day), 0) AS places FROM (SELECT DISTINCT day FROM g) g LEFT JOIN o ON o.day = g.day
  GROUP BY 1),
f AS (SELECT g.slot_at, row_number() OVER (PARTITION BY g.day ORDER BY g.slot_at) AS rn, u.places FROM g JOIN u ON u.day = g.day
  WHERE g.slot_at NOT IN (SELECT scheduled_at FROM o)),
fr AS (SELECT slot_at, row_number() OVER (ORDER BY slot_at) AS no FROM f WHERE rn <= places),
pl AS (SELECT id, scheduled_at, row_number() OVER (ORDER BY scheduled_at, id) AS no FROM c WHERE state = 'planned'),
tl AS (SELECT slot_at, no - (SELECT count(*) FROM pl) AS no FROM fr WHERE no > (SELECT count(*) FROM pl)),
sk AS (SELECT id, scheduled_at, row_number() OVER (ORDER BY scheduled_at, id) AS no FROM c WHERE state = 'skipped'),
mv AS (SELECT pl.id, pl.scheduled_at, fr.slot_at FROM pl LEFT JOIN fr ON fr.no = pl.no
  UNION ALL SELECT sk.id, sk.scheduled_at, coalesce(tl.slot_at, (SELECT max(slot_at) FROM tl), (SELECT max(slot_at) FROM g))
  FROM sk LEFT JOIN tl ON tl.no = sk.no)
SELECT *, CASE WHEN slot_at IS NULL THEN 'no slot' END AS reason FROM mv WHERE scheduled_at <> slot_at OR slot_at IS NULL""")(lambda v: op.compact(_anchor(v), v.calendar, CFG))
query("reschedule", f"""WITH {_GRID.strip()},
l AS (SELECT now, (SELECT max(slot_at) FROM g) + INTERVAL 1 MINUTE AS until FROM n),
p AS (SELECT id, kind, state, scheduled_at FROM calendar),
t AS (SELECT id, kind, scheduled_at FROM p, l WHERE state = 'planned' AND (scheduled_at < now OR (kind = 'feed'
  AND scheduled_at <= until AND scheduled_at NOT IN (SELECT slot_at FROM g)))),
fr AS (SELECT slot_at, row_number() OVER (ORDER BY slot_at) AS no FROM g WHERE slot_at NOT IN (SELECT scheduled_at FROM p, l
  WHERE kind = 'feed' AND scheduled_at >= now AND scheduled_at <= until)),
m AS (SELECT now, CAST(CAST(now + INTERVAL 9 HOUR AS DATE) + CAST((7 - (isodow(CAST(now + INTERVAL 9 HOUR AS DATE)) - 1)) % 7 AS INT) AS DATE)
  AS mon FROM n),
rl AS (SELECT CASE WHEN mon + INTERVAL 10 HOUR > now THEN mon + INTERVAL 10 HOUR ELSE mon + INTERVAL 7 DAY + INTERVAL 10 HOUR
  END AS at_ FROM m),
k AS (SELECT *, row_number() OVER (ORDER BY scheduled_at, id) AS no FROM t WHERE kind <> 'reel')
SELECT id, kind, scheduled_at, (SELECT at_ FROM rl) AS slot_at, NULL AS reason FROM t WHERE kind = 'reel'
UNION ALL SELECT k.id, kind, scheduled_at, slot_at, CASE WHEN slot_at IS NULL THEN 'no slot' END FROM k LEFT JOIN fr ON fr.no = k.no""")(
    lambda v: op.reschedule(_anchor(v), v.calendar, CFG))
query("requeue", f"""WITH {_GRID.strip().replace("range(14)", "range(31)")},
kd AS (SELECT unnest(['feed', 'reel', 'story']) AS kind),
fr AS (SELECT kind, slot_at, row_number() OVER (PARTITION BY kind ORDER BY slot_at) AS no FROM kd, g WHERE NOT EXISTS (SELECT 1 FROM calendar c
  WHERE c.kind = kd.kind AND c.scheduled_at = g.slot_at AND c.state IN ('planned', 'publishing'))),
b AS (SELECT *, 2 AS attempts, 'm' || id AS media_id, scheduled_at AS published_at, id % 5 = 0 AS now_, CASE WHEN id % 5 <> 0 THEN
  row_number() OVER (PARTITION BY kind, id % 5 = 0 ORDER BY id) END AS no FROM calendar WHERE state = 'published'
  AND id IN (SELECT id // 50 FROM properties WHERE score > 40)),
m AS (SELECT b.*, CASE WHEN now_ THEN (SELECT now FROM n) ELSE fr.slot_at END AS slot_at FROM b LEFT JOIN fr ON fr.no = b.no AND fr.kind = b.kind)
SELECT id, kind, CASE WHEN slot_at IS NULL THEN state ELSE 'planned' END AS state, coalesce(slot_at, scheduled_at) AS scheduled_at,
  CASE WHEN slot_at IS NULL THEN attempts ELSE 0 END AS attempts, CASE WHEN slot_at IS NULL THEN media_id END AS media_id,
  CASE WHEN slot_at IS NULL THEN published_at END AS published_at, CASE WHEN slot_at IS NULL THEN 'no slot' END AS reason
FROM m""")(
    lambda v: op.requeue(_anchor(v), v.calendar.withColumns({
        "attempts": F.lit(2), "media_id": F.concat(F.lit("m"), "id"), "published_at": F.col("scheduled_at")}),
        v.properties.filter("score > 40").selectExpr("id div 50 AS id").distinct().withColumn("now", F.expr("id % 5 = 0")), CFG)
    .select("id", "kind", "state", "scheduled_at", "attempts", "media_id", "published_at", "reason"))
