"""Scores over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens.operators import scoring as op
from curalens.plans.registry import query

_RAW = """
c AS (SELECT a.property_id AS id, greatest(least(a.story_score, 100), 0) AS story,
    CASE WHEN a.genre IN ('architect', 'adaptive_reuse', 'hidden_gem', 'penthouse', 'loft') THEN a.genre ELSE 'unknown' END
      AS genre, a.style_identified, a.one_of_a_kind, a.is_for_sale, a.built, a.story_reason, a.provenance_visible, coalesce(a.provenance_note, '') AS provenance_note,
    a.summary, p.source, p.source_rank, p.is_for_sale AS by_signal, s.kind IS NOT NULL AS site,
    lower(coalesce(nullif(a.city, ''), p.location_city, '')) AS city,
    lower(coalesce(nullif(a.country, ''), p.location_country, '')) AS country,
    coalesce(nullif(a.price, ''), p.price, '') AS price
  FROM assessments a JOIN properties p ON p.id = a.property_id
  LEFT JOIN (SELECT * FROM sources WHERE kind = 'listing') s ON s.key = p.source),
x AS (SELECT *, CAST(story AS DOUBLE) AS r_story, CASE WHEN style_identified THEN 100.0 ELSE 0.0 END::DOUBLE AS r_style,
    CASE WHEN one_of_a_kind THEN 100.0 ELSE 0.0 END::DOUBLE AS r_one,
    CASE source_rank WHEN 'S' THEN 100.0 WHEN 'A' THEN 70.0 WHEN 'B' THEN 40.0 ELSE 0.0 END::DOUBLE AS r_source,
    CASE WHEN site THEN 0.0 WHEN by_signal AND is_for_sale THEN 100.0 WHEN by_signal OR is_for_sale THEN 50.0 ELSE 0.0
      END::DOUBLE AS r_sale,
    CASE genre WHEN 'architect' THEN 100.0 WHEN 'adaptive_reuse' THEN 87.5 WHEN 'hidden_gem' THEN 75.0
      WHEN 'penthouse' THEN 62.5 WHEN 'loft' THEN 50.0 ELSE 20.0 END::DOUBLE AS r_genre,
    CASE WHEN city = '' AND country = '' THEN 50.0
      WHEN country IN ('united states', 'portugal', 'spain', 'taiwan') THEN 100.0 ELSE 20.0 END::DOUBLE AS r_area,
    CASE WHEN price = '' THEN 0.0 ELSE 100.0 END::DOUBLE AS r_price,
    CASE WHEN story < 40 AND NOT style_identified AND NOT one_of_a_kind THEN 'story=' || story || ' < 40'
      WHEN built >= 2000 THEN '築年 ' || built || ' ≧ 2000' ELSE '' END AS gate FROM c),
t AS (SELECT *, CASE WHEN gate <> '' THEN 0.0::DOUBLE ELSE round(0.0::DOUBLE + r_story * 0.25::DOUBLE + r_style * 0.15::DOUBLE
    + r_one * 0.15::DOUBLE + r_source * 0.1::DOUBLE + r_sale * 0.1::DOUBLE + r_genre * 0.15::DOUBLE + r_area * 0.05::DOUBLE
    + r_price * 0.05::DOUBLE, 1) END AS score FROM x)"""


def _scored(v):
    return op.score_listings(v.properties, v.assessments, v.sources)


def _raw(key):
    return F.filter("axes", lambda a: a["key"] == key)[0]["raw"].alias(key)


query("score_axes", f"""WITH {_RAW.strip()}
SELECT id, r_story AS story, r_style AS style, r_one AS one_of_a_kind, r_source AS source, r_sale AS for_sale,
  r_genre AS genre, r_area AS area, r_price AS price FROM t""")(
    lambda v: op.score_axes(op.assess_listings(v.properties, v.assessments, v.sources)).select(
        "id", *[_raw(k) for k in ("story", "style", "one_of_a_kind", "source", "for_sale", "genre", "area", "price")]))
query("score_gate", f"WITH {_RAW.strip()} SELECT id, gate FROM t")(lambda v: _scored(v).select("id", "gate"))
query("score_total", f"WITH {_RAW.strip()} SELECT id, score FROM t")(lambda v: _scored(v).select("id", "score"))
query("score_detail", f"""WITH {_RAW.strip()}
SELECT id, '{{"gate":"' || gate || '","axes":[{{"key":"story","raw":' || r_story || ',"weight":0.25,"reason":"' || story_reason
  || '"}},{{"key":"style","raw":' || r_style || ',"weight":0.15,"reason":"'
  || CASE WHEN style_identified THEN 'style known' ELSE 'style unknown' END
  || '"}},{{"key":"one_of_a_kind","raw":' || r_one || ',"weight":0.15,"reason":"'
  || CASE WHEN one_of_a_kind THEN 'single piece' ELSE 'may exist more than once' END
  || '"}},{{"key":"source","raw":' || r_source || ',"weight":0.1,"reason":"' || source || '(' || coalesce(source_rank, '?')
  || ')"}},{{"key":"for_sale","raw":' || r_sale || ',"weight":0.1,"reason":"' || CASE WHEN site THEN 'listing site'
     WHEN by_signal AND is_for_sale THEN 'signal and judgement' WHEN by_signal OR is_for_sale THEN 'one of two'
     ELSE 'nothing' END
  || '"}},{{"key":"genre","raw":' || r_genre || ',"weight":0.15,"reason":"' || genre
  || '"}},{{"key":"area","raw":' || r_area || ',"weight":0.05,"reason":"' || CASE WHEN city = '' AND country = ''
     THEN 'place unknown' WHEN r_area = 100 THEN 'in focus' ELSE 'out of focus' END
  || '"}},{{"key":"price","raw":' || r_price || ',"weight":0.05,"reason":"' || CASE WHEN price = '' THEN 'no price'
     ELSE substr(price, 1, 20) END
  || '"}}],"flags":{{"provenance_visible":' || provenance_visible || ',"style_identified":' || style_identified
  || ',"one_of_a_kind":' || one_of_a_kind || ',"llm_is_for_sale":' || is_for_sale || '}},"provenance_note":"' || provenance_note || '"}}'
  AS score_detail FROM t""")(
    lambda v: _scored(v).select("id", "score_detail"))
query("score_run_stats", f"""WITH {_RAW.strip()}
SELECT count(*) AS scored, count(*) FILTER (score < 30) AS below, count(*) FILTER (score >= 80) AS highlighted,
  count(*) FILTER (length(summary) > 80) AS long_summaries FROM t""")(lambda v: op.score_run_stats(_scored(v)))
query("assessment_clean", """
SELECT property_id, greatest(least(story_score, 100), 0) AS story_score, CASE WHEN genre IN ('architect', 'adaptive_reuse',
  'hidden_gem', 'penthouse', 'loft') THEN genre ELSE 'unknown' END AS genre, is_for_sale FROM assessments""")(
    lambda v: op.clean_assessment(v.assessments).select("property_id", "story_score", "genre", "is_for_sale"))
query("rescore", """
SELECT id, score, CASE WHEN gate <> '' THEN 0.0::DOUBLE ELSE round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(axes,
  lambda a: a.raw * CASE a.key WHEN 'story' THEN 0.5::DOUBLE WHEN 'style' THEN 0.3::DOUBLE WHEN 'price' THEN 0.2::DOUBLE
  ELSE 0.0::DOUBLE END)), lambda s, x: s + x), 1) END AS new_score FROM properties WHERE has_detail""")(
    lambda v: op.rescore(v.properties, {"story": 0.5, "style": 0.3, "price": 0.2}).select("id", "score", "new_score"))
query("judgement", """
SELECT id, CASE WHEN NOT has_detail THEN '' WHEN story_reason <> '' THEN story_reason ELSE 'style' END AS judgement,
  concat_ws(',', CASE WHEN style_identified THEN 'style_identified' END, CASE WHEN one_of_a_kind THEN 'one_of_a_kind' END,
  CASE WHEN provenance_visible THEN 'provenance_visible' END) AS marks FROM properties""")(
    lambda v: op.judgement(v.properties).select("id", "judgement", F.array_join("marks", ",").alias("marks")))
