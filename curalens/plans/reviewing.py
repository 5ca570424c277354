"""Review analytics over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens import config
from curalens.operators import reviewing as op
from curalens.plans.registry import query

_YES = "status IN ('approved', 'delivered')"
_DECIDED = f"score IS NOT NULL AND status IN ('approved', 'delivered', 'rejected')"
_WEIGHTS = "CASE key " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in config.AXIS_WEIGHTS.items()) + " END"
_GAP = f"""
x AS (SELECT status, unnest(axes) AS axis FROM properties WHERE {_DECIDED} AND has_detail),
g AS (SELECT axis.key AS key, count(*) FILTER ({_YES}) AS n_approved, count(*) FILTER (NOT {_YES}) AS n_rejected,
  avg(axis.raw) FILTER ({_YES}) AS approved_mean, avg(axis.raw) FILTER (NOT {_YES}) AS rejected_mean FROM x GROUP BY 1),
a AS (SELECT *, approved_mean - rejected_mean AS gap, {_WEIGHTS} AS weight FROM g)"""


def _rounded(df, *names, to=6):
    return df.withColumns({n: F.round(n, to) for n in names})


query("axis_gap", f"""WITH {_GAP.strip()}
SELECT key, n_approved, n_rejected, round(approved_mean, 6) AS approved_mean, round(rejected_mean, 6) AS rejected_mean,
  round(gap, 6) AS gap, weight, CASE WHEN gap >= 15 THEN 'works' WHEN gap <= -15 THEN 'works the wrong way'
  WHEN abs(gap) < 5 THEN 'no difference' ELSE 'weak' END AS note FROM a""")(
    lambda v: _rounded(op.axis_gap(v.properties, config.AXIS_WEIGHTS), "approved_mean", "rejected_mean", "gap"))
query("flag_rate", f"""
WITH x AS (SELECT status, unnest([{{'k': 'provenance_visible', 'v': provenance_visible}},
  {{'k': 'style_identified', 'v': flag_style}}, {{'k': 'one_of_a_kind', 'v': flag_unique}}]) AS f
  FROM properties WHERE {_DECIDED} AND has_detail),
r AS (SELECT f.k AS flag, 100.0::DOUBLE * count(*) FILTER ({_YES} AND f.v) / count(*) FILTER ({_YES}) AS a,
  100.0::DOUBLE * count(*) FILTER (NOT {_YES} AND f.v) / count(*) FILTER (NOT {_YES}) AS b FROM x GROUP BY 1)
SELECT flag, round(a, 6) AS approved_rate, round(b, 6) AS rejected_rate, round(a - b, 6) AS points FROM r""")(
    lambda v: _rounded(op.flag_rate(v.properties), "approved_rate", "rejected_rate", "points"))
query("score_spread", f"""
SELECT CASE WHEN {_YES} THEN 'approved' ELSE 'rejected' END AS outcome, count(*) AS n, min(score) AS low,
  round(median(score), 4) AS middle, max(score) AS high FROM properties WHERE {_DECIDED} GROUP BY 1""")(
    lambda v: _rounded(op.score_spread(v.properties), "middle", to=4))
query("precision_at_k", f"""
WITH d AS (SELECT id, score, {_YES} AS yes, row_number() OVER (ORDER BY score DESC, id) AS rn FROM properties
  WHERE {_DECIDED}), k AS (SELECT count(*) FILTER (yes) AS k FROM d)
SELECT (SELECT k FROM k) AS k, count(*) FILTER (yes) AS hits,
  round(100.0::DOUBLE * count(*) FILTER (yes) / (SELECT k FROM k), 6) AS precision_at_k FROM d
WHERE rn <= (SELECT k FROM k)""")(lambda v: _rounded(op.precision_at_k(v.properties), "precision_at_k"))
query("missed_high", f"""
SELECT count(*) FILTER (score > (SELECT median(score) FROM properties WHERE score IS NOT NULL AND {_YES})) AS missed_high
FROM properties WHERE score IS NOT NULL AND status = 'rejected'""")(lambda v: op.missed_high(v.properties))
query("gate_kinds", f"""
SELECT CASE WHEN gate LIKE 'story=%' THEN 'story_min' WHEN gate LIKE '築年%' THEN 'built_before' ELSE gate END AS kind,
  CASE WHEN gate LIKE 'story=%' THEN CAST(regexp_extract(gate, 'story=([0-9]+)', 1) AS DOUBLE) END AS story,
  count(*) AS n FROM properties WHERE score IS NOT NULL AND {_YES} AND has_detail AND gate <> '' GROUP BY 1, 2""")(
    lambda v: op.gate_kinds(v.properties))
query("approved_mix", f"""
WITH d AS (SELECT coalesce(genre, 'unknown') AS genre, source, coalesce(source_rank, 'unknown') AS rank,
  coalesce(CAST(year_built_value // 10 * 10 AS VARCHAR), 'unknown') AS decade,
  coalesce(location_country, 'unknown') AS country FROM properties WHERE score IS NOT NULL AND {_YES})
SELECT 'genre' AS dimension, genre AS value, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'rank', rank, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'decade', decade, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'country', country, count(*) FROM d GROUP BY 2""")(lambda v: op.approved_mix(v.properties))
query("columns_filled", f"""
SELECT count(*) AS reviewed, count(style_identified) AS style_identified, count(one_of_a_kind) AS one_of_a_kind,
  count(provenance_visible) AS provenance_visible FROM properties WHERE {_DECIDED}""")(
    lambda v: op.columns_filled(v.properties, ["style_identified", "one_of_a_kind", "provenance_visible"]))
query("weight_proposal", f"""WITH {_GAP.strip()},
b AS (SELECT *, sum(weight) OVER () AS budget, greatest(gap, 0) AS good FROM a),
c AS (SELECT *, sum(good) OVER () AS total FROM b),
h AS (SELECT *, greatest(round_even((weight + good / total * budget) / 2 * 20, 0) / 20, 0.05) AS f0 FROM c WHERE total > 0),
s AS (SELECT *, round_even(f0 / sum(f0) OVER () * budget * 20, 0) / 20 AS f1 FROM h),
r AS (SELECT *, budget - sum(f1) OVER () AS rest, row_number() OVER (ORDER BY gap DESC, key) AS place FROM s)
SELECT key, round(gap, 6) AS gap, weight, round(CASE WHEN place = 1 THEN round_even(f1 + rest, 2) ELSE f1 END, 4)
  AS proposed FROM r""")(
    lambda v: _rounded(_rounded(op.weight_proposal(op.axis_gap(v.properties, config.AXIS_WEIGHTS)), "gap"), "proposed",
                       to=4))
query("review_examples", f"""
SELECT id, score, coalesce(display_name, CASE WHEN title LIKE '% - MLS%' THEN string_split(title, ' - MLS')[1]
  ELSE title END) AS name, coalesce(genre, 'unknown') AS genre, style_name, location_city
FROM properties WHERE score IS NOT NULL AND {_YES} ORDER BY score DESC, id LIMIT 12""")(
    lambda v: op.review_examples(v.properties))
query("review_totals", f"""
SELECT count(*) FILTER ({_YES}) AS approved, count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status <> 'pending' AND NOT has_detail) AS no_detail,
  count(*) FILTER ({_YES} AND has_detail AND gate <> '') AS approved_gated FROM properties WHERE score IS NOT NULL""")(
    lambda v: op.review_totals(v.properties))
