"""Collection over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curalens.operators import collecting as op
from curalens.operators.extract import html_links
from curalens.operators.signals import detect_signals, is_candidate
from curalens.plans.registry import query
from curalens.plans.texts import _DETECT, _normal
from curalens.session import work_dir
from curalens.schemas import struct
from curalens.sources import tables
from curalens.sources.local import config_frame

CUTOFF = "2024-01-10 00:00:00"
NOW = "2024-02-01 00:00:00"
OUTCOMES = ["no link", "url rule", "old", "known", "no text", "kept"]


def _folder(v, name: str) -> str:
    return f"{work_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


_FATE = f"""
e AS (SELECT en.*, {_normal('en.link')} AS url, s.homes_only, s.assume_for_sale, s.name AS source_name, s.rank AS source_rank
  FROM entries en LEFT JOIN sources s ON s.key = en.source),
ou AS (SELECT *, CASE WHEN coalesce(link, '') = '' THEN 'no link'
  WHEN regexp_matches(url, '/agents/') OR (homes_only AND NOT regexp_matches(url, '/homes/')) THEN 'url rule'
  WHEN published_at < TIMESTAMP '{CUTOFF}' THEN 'old' WHEN url IN (SELECT source_url FROM known_entry_urls) THEN 'known'
  WHEN trim(text) = '' THEN 'no text' ELSE 'kept' END AS outcome FROM e)"""


def _fate(v):
    return op.entry_filter(v.entries, v.sources, v.known_entry_urls, CUTOFF)


query("entry_filter", f"WITH {_FATE.strip()} SELECT id, url, outcome FROM ou")(
    lambda v: _fate(v).select("id", "url", "outcome"))
query("collect_stats", f"""WITH {_FATE.strip()}
SELECT source, count(*) AS entries, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o.replace(' ', '_')}" for o in OUTCOMES)}
FROM ou GROUP BY source""")(lambda v: op.collect_stats(_fate(v), OUTCOMES))
query("known_urls", f"""
SELECT id, {_normal('link')} AS url FROM entries WHERE link IS NOT NULL
  AND {_normal('link')} NOT IN (SELECT source_url FROM known_entry_urls)""")(lambda v: _unknown(v))


def _unknown(v):
    from curalens.functions.urls import normalize_url
    from curalens.operators.lists import known_rows
    rows = v.entries.filter("link IS NOT NULL").select("id", normalize_url(F.col("link")).alias("url"))
    return known_rows(rows, v.known_entry_urls).select("id", "url")


query("build_candidates", f"""WITH {_FATE.strip()}, {_DETECT.strip()},
pk AS (SELECT id, arg_max(u, {{'d': regexp_matches(p, '[0-9]'), 'n': length(p) - length(replace(p, '/', '')), 'o': -i}}) AS url
  FROM (SELECT id, unnest(links) AS u, generate_subscripts(links, 1) AS i, regexp_extract(unnest(links),
    '^https?://[^/]*([^?#]*)', 1) AS p FROM sg WHERE len(links) > 0) WHERE p NOT IN ('', '/')
    AND NOT regexp_matches(p, '(?i)/(?:agents?|team|about|contact|blog|search)(?:/|$)')
    AND NOT regexp_matches(p, '(?i)report') GROUP BY 1),
c AS (SELECT ou.id, ou.source, ou.source_rank, ou.url AS source_url, sg.score AS signal_score, pk.url AS listing_url,
  row_number() OVER (PARTITION BY ou.url ORDER BY ou.position, ou.id) AS rn FROM ou JOIN sg ON sg.id = ou.id
  LEFT JOIN pk ON pk.id = ou.id WHERE ou.outcome = 'kept' AND (sg.score >= 2 OR ou.assume_for_sale))
SELECT id, source, source_rank, source_url, signal_score, listing_url FROM c WHERE rn = 1""")(
    lambda v: op.build_candidates(op.kept_entries(v.entries, v.sources, v.known_entry_urls, CUTOFF), v.article_links).select(
        "id", "source", "source_rank", "source_url", "signal_score", "listing_url"))
query("feed_fallback", """
SELECT e.id, p.page_id IS NULL AS from_feed_only, CASE WHEN p.page_id IS NULL THEN length(e.text)
  ELSE length('page ' || p.html) END AS chars FROM entries e LEFT JOIN pages p ON p.page_id * 3 = e.id""")(
    lambda v: op.feed_fallback(
        v.entries.select("id", F.concat(F.lit("u"), "id").alias("url"), "text"),
        v.table("pages").selectExpr("concat('u', page_id * 3) AS url", "concat('page ', html) AS text"))
    .select("id", "from_feed_only", F.length("text").cast("long").alias("chars")))
query("failure_class", """
SELECT source, CASE WHEN status = 404 THEN 'no feed here' WHEN status = 403 THEN 'refused' WHEN status = 429 THEN 'rate limited'
  WHEN status = 500 THEN 'HTTP 500' WHEN problem = 'connect' THEN 'no connection' ELSE problem END AS reason, count(*) AS n
FROM fetch_log WHERE failed GROUP BY 1, 2""")(
    lambda v: v.fetch_log.filter("failed").groupBy(
        "source", op.failure_class(F.col("status"), F.col("problem")).alias("reason")).agg(F.count("*").alias("n")))
query("running_failures", """
WITH r AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY source ORDER BY seq) AS wins FROM fetch_log),
f AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY source, wins ORDER BY seq) AS n FROM r),
s AS (SELECT source, min(seq) AS stop_seq FROM f WHERE failed AND n >= 3 GROUP BY 1)
SELECT l.source, l.seq, s.stop_seq, s.stop_seq IS NULL OR l.seq <= s.stop_seq AS fetched FROM fetch_log l
LEFT JOIN s ON s.source = l.source""")(
    lambda v: op.running_failures(v.fetch_log).select("source", "seq", "stop_seq", "fetched"))
query("dedupe_url", f"""
SELECT url, min(page_id) AS page_id FROM (SELECT page_id, {_normal('url')} AS url FROM pages) GROUP BY 1""")(
    lambda v: op.dedupe_url(v.table("pages").select("page_id", "url", F.col("page_id").alias("position")))
    .select("url", "page_id"))

_INDEX = f"""
ix AS (SELECT source, {_normal('url')} AS url, position FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source,
  'https://www.' || source || '.example.com/' || lang || '/homes/' || (doc_id % 900) || '/' AS url, doc_id AS position FROM documents)),
fe AS (SELECT source, {_normal('link')} AS url, position FROM entries WHERE link IS NOT NULL)"""


def _index(v):
    from curalens.functions.urls import normalize_url
    return v.table("documents").selectExpr(
        "IF(doc_id % 3 = 0, 'src0', source) AS source",
        "concat('https://www.', source, '.example.com/', lang, '/homes/', doc_id % 900, '/') AS url", "doc_id AS position"
    ).withColumn("url", normalize_url(F.col("url")))


def _feed(v):
    from curalens.functions.urls import normalize_url
    return v.entries.filter("link IS NOT NULL").select("source", normalize_url(F.col("link")).alias("url"), "position")


query("index_backfill", f"""WITH {_INDEX.strip()},
o AS (SELECT source, url, min(position) AS position FROM ix GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position, url) AS rn FROM o WHERE NOT EXISTS
  (SELECT 1 FROM fe WHERE fe.source = o.source AND fe.url = o.url) AND url NOT IN (SELECT source_url FROM known_entry_urls))
SELECT source, url, position, CAST(rn AS INT) AS rn FROM f""")(
    lambda v: op.index_backfill(_index(v), _feed(v), v.known_entry_urls).select("source", "url", "position", "rn"))
_BUDGETS = """
bg AS (SELECT s.key AS source, CASE WHEN s.ordinal % 3 <> 2 THEN 5 + s.ordinal END AS own, coalesce(u.n, 0) AS used FROM sources s
  LEFT JOIN (SELECT source, count(*) // 40 AS n FROM entries GROUP BY 1) u ON u.source = s.key)"""
query("backfill_budget", f"""WITH {_INDEX.strip()}, {_BUDGETS.strip()},
o AS (SELECT source, url, min(position) AS position FROM ix GROUP BY 1, 2),
b AS (SELECT o.*, position % 3 <> 0 AS inserts, least(bg.own, greatest(30 - coalesce(bg.used, 0), 0)) AS budget FROM o LEFT JOIN bg ON bg.source = o.source),
r AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (inserts) OVER (PARTITION BY source ORDER BY position, url ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) AS before FROM b WINDOW w AS (PARTITION BY source ORDER BY position, url))
SELECT source, url, CAST(rn AS BIGINT) AS rn, CASE WHEN before >= budget THEN 'over budget' WHEN inserts THEN 'inserted' ELSE 'passed over' END AS outcome
FROM r""")(
    lambda v: op.take_backfill(
        _index(v).groupBy("source", "url").agg(F.min("position").alias("position")).withColumn("inserts", F.col("position") % 3 != 0),
        v.sources.selectExpr("key AS source", "CASE WHEN ordinal % 3 <> 2 THEN 5 + ordinal END AS max_backfill").join(
            v.entries.groupBy("source").agg(F.expr("count(*) div 40").alias("used")), "source", "left"), 30)
    .select("source", "url", "rn", "outcome"))
query("feed_plus_index", f"""WITH {_INDEX.strip()},
b AS (SELECT *, false AS from_index FROM fe UNION ALL (SELECT *, true FROM ix))
SELECT source, url, arg_min(from_index, {{'f': from_index, 'p': position}}) AS from_index,
  arg_min(position, {{'f': from_index, 'p': position}}) AS position FROM b GROUP BY 1, 2""")(
    lambda v: op.feed_plus_index(_feed(v), _index(v)).select("source", "url", "from_index", "position"))
query("scan_index_links", f"""
WITH h AS (SELECT page_id, 'src' || (page_id % 5) AS source, {_normal('url')} AS page, regexp_extract(url, '^[a-z]+://[^/]*', 0) AS origin,
  list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS hrefs FROM pages),
l AS (SELECT page_id, source, page, origin || unnest(hrefs) AS link FROM h),
n AS (SELECT source, page_id, page, {_normal('link')} AS url FROM l)
SELECT DISTINCT n.source, n.url FROM n JOIN sources s ON s.key = n.source
WHERE n.url <> n.page AND NOT regexp_matches(n.url, '/agents/') AND (NOT s.homes_only OR regexp_matches(n.url, '/homes/'))""")(
    lambda v: op.index_links(v.table("pages").withColumn("source", F.expr("concat('src', page_id % 5)")), v.sources,
                             html_links(F.col("html"), F.col("url"))).select("source", "url"))


def _sitemaps(v):
    """Two levels of sitemaps over the page URLs, a few links each."""
    p = v.table("pages").selectExpr("page_id", "url", "concat('src', page_id % 5) AS source", "page_id div 100 AS leaf")
    leaf = F.expr("concat('https://', source, '.example.com/map-', leaf, '.xml')")
    leaves = p.groupBy("source", "leaf").agg(F.array_join(F.transform(
        F.collect_list("url"), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), "").alias("xml"))
    roots = leaves.groupBy("source", F.expr("leaf div 100").alias("root")).agg(F.array_join(F.transform(
        F.collect_list(leaf), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))), "").alias("xml"))
    root_url = F.expr("concat('https://', source, '.example.com/root-', root, '.xml')")
    maps = leaves.select("source", leaf.alias("url"), "xml").unionByName(roots.select("source", root_url.alias("url"), "xml"))
    return roots.select("source", root_url.alias("url")), maps


query("scan_sitemap", """
SELECT DISTINCT 'src' || (page_id % 5) AS source, CAST(1 AS INT) AS level, url AS loc FROM pages
WHERE regexp_matches(url, '/(en|fr|de|es)/[0-9]+')""")(
    lambda v: op.sitemap_walk(*_sitemaps(v), detail=r"/(en|fr|de|es)/\d+", depth=3))


def _landed(v):
    path = _folder(v, "feed")
    v.entries.selectExpr("source", "link", "title", "'' AS summary", "text AS content",
                         "IF(position % 2 = 0, published_at, NULL) AS published", "published_at AS updated", "position"
                         ).write.json(path)
    return tables.read_feed_entries(v.spark, path)


query("scan_feed", """SELECT position, source, link, length(text) AS chars, published_at FROM entries""")(
    lambda v: _landed(v).select("position", "source", "link", F.length("content").cast("long").alias("chars"), "published_at"))


def _tsv(v):
    path = _folder(v, "tsv")
    rows = v.table("supplier").selectExpr(
        "concat_ws('\\t', concat('area', s_nationkey), s_name, concat('https://site', s_suppkey, '.example.com')) AS line")
    head = v.spark.range(1).select(F.lit("Area\tName\tURL").alias("line")).unionByName(
        v.spark.range(1).select(F.lit("# note\tx\thttps://skipped.example.com").alias("line")))
    rows.unionByName(head).write.text(path)
    return tables.read_candidates_tsv(v.spark, path)


query("scan_candidates_tsv", """
SELECT 'area' || s_nationkey AS area, s_name AS name, 'https://site' || s_suppkey || '.example.com' AS url FROM supplier""")(
    lambda v: _tsv(v))


def _csv(v):
    path = _folder(v, "csv")
    tables.write_csv(op.survey_verdict(v.robots), path)
    return v.spark.read.csv(path, header=True, schema="domain string, verdict string, blocked string").fillna("", ["blocked"])


_VERDICT = """
WITH f AS (SELECT domain, min(position) AS s FROM robots GROUP BY 1)
SELECT domain, CASE WHEN s % 9 = 4 THEN 'not readable' WHEN s % 9 = 5 THEN 'allowed' WHEN s % 4 = 0 THEN 'refused'
  WHEN s % 4 = 1 THEN 'partly' ELSE 'allowed' END AS verdict, CASE WHEN s % 9 IN (4, 5) THEN '' WHEN s % 4 = 0
  THEN '/homes,/listing,/properties,/property,/search' WHEN s % 4 = 1 THEN '/search' ELSE '' END AS blocked FROM f"""
query("survey_verdict", _VERDICT)(lambda v: op.survey_verdict(v.robots))
query("sink_csv", _VERDICT)(_csv)
query("manual_entry", """
WITH m AS (SELECT c_custkey AS id, 'https://www.src' || (c_custkey % 30) || '.example.com/by-hand/' || (c_custkey % 700) AS url,
  c_nationkey FROM customer),
f AS (SELECT url, min(id) AS id FROM m WHERE url NOT IN (SELECT source_url FROM properties) GROUP BY 1)
SELECT f.id, f.url, coalesce(s.key, 'manual') AS source, s.rank AS source_rank, '手動入力（人がページを確認して登録）' || CASE
  WHEN m.c_nationkey > 5 THEN ' / 価格: $' || m.c_nationkey ELSE '' END || CASE WHEN m.c_nationkey > 10 THEN ' / seen' ELSE '' END
  AS for_sale_evidence FROM f JOIN m ON m.id = f.id LEFT JOIN sources s ON f.url LIKE s.base_url || '/%'""")(
    lambda v: op.manual_entries(v.table("customer").selectExpr(
        "c_custkey AS id", "concat('https://www.src', c_custkey % 30, '.example.com/by-hand/', c_custkey % 700, '/#x') AS url",
        "IF(c_nationkey > 5, concat('$', c_nationkey), NULL) AS price", "IF(c_nationkey > 10, 'seen', '') AS note"),
        v.sources, v.properties).select("id", "url", "source", "source_rank", "for_sale_evidence"))
query("sources_union", """
SELECT s.key, s.kind, count(*) AS listings FROM sources s JOIN properties p ON p.source = s.key
WHERE s.kind = 'editorial' OR s.mode = 'crawl' GROUP BY 1, 2""")(
    lambda v: op.sources_union(v.sources.filter("kind = 'editorial'"), v.sources.filter("kind = 'listing'")).join(
        v.properties.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("listings")), "key")
    .select("key", "kind", "listings"))


def _judged(v):
    """Entries with their signal verdict."""
    found = detect_signals(v.entries.join(v.article_links, "id")).withColumn("assume_for_sale", F.lit(False))
    return found.withColumn("is_candidate", is_candidate()).select("source", "published_at", "text", "is_candidate")


_PACE = f"""
g AS (SELECT source, count(*) AS entries, count(published_at) AS dated, min(published_at) AS a, max(published_at) AS b,
  count(*) FILTER (score >= 2) AS candidates FROM (SELECT sg.score, e.source, e.published_at FROM sg JOIN entries e ON e.id = sg.id)
  GROUP BY 1),
w AS (SELECT *, CASE WHEN dated >= 2 AND b > a THEN (epoch(b) - epoch(a)) / 86400.0 END AS days,
  (epoch(TIMESTAMP '{NOW}') - epoch(b)) / 86400.0 AS age FROM g),
pc AS (SELECT *, (dated - 1) / days AS per_day, coalesce(age > 30, false) AS stale FROM w),
pw AS (SELECT *, CASE WHEN stale THEN 0.0 ELSE per_day * (candidates / entries) * 7 END AS per_week FROM pc)"""
_EXCERPT = """
o AS (SELECT source, length(text) AS c, row_number() OVER (PARTITION BY source ORDER BY length(text)) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM entries),
ex AS (SELECT source, CAST(c AS BIGINT) AS upper_median FROM o WHERE rn = n // 2 + 1)"""
query("feed_pace", f"""WITH {_DETECT.strip()}, {_PACE.strip()}
SELECT source, entries, dated, round(days, 4) AS window_days, round(per_day, 4) AS per_day, round(age, 4) AS newest_age, stale,
  candidates, round(per_week, 4) AS per_week FROM pw""")(
    lambda v: op.feed_pace(_judged(v), NOW).select(
        "source", "entries", "dated", *[F.round(c, 4).alias(c) for c in ("window_days", "per_day", "newest_age", "per_week")],
        "stale", "candidates"))
query("excerpt_only", f"WITH {_EXCERPT.strip()} SELECT source, upper_median, upper_median < 800 AS excerpt_only FROM ex")(
    lambda v: op.excerpt_only(v.entries).select("source", F.col("upper_median").cast("long").alias("upper_median"), "excerpt_only"))
query("feed_survey", f"""WITH {_DETECT.strip()}, {_PACE.strip()}, {_EXCERPT.strip()},
fl AS (SELECT replace(source, 'src', 'feed') AS source, arg_min(CASE WHEN status = 404 THEN 'no feed here' WHEN status = 403
  THEN 'refused' WHEN status = 429 THEN 'rate limited' WHEN status = 500 THEN 'HTTP 500' WHEN problem = 'connect'
  THEN 'no connection' ELSE problem END, seq) AS reason FROM fetch_log WHERE failed GROUP BY 1)
SELECT pw.source, true AS readable, NULL AS reason, entries, upper_median, round(per_day, 4) AS per_day,
  round(per_week, 4) AS per_week, stale, stale OR NOT (upper_median < 800 AND candidates = 0) AS reliable FROM pw
JOIN ex ON ex.source = pw.source
UNION ALL SELECT source, false, reason, NULL, NULL, NULL, NULL, NULL, NULL FROM fl""")(
    lambda v: op.feed_survey(_judged(v), v.fetch_log.filter("failed").select(
        F.replace("source", F.lit("src"), F.lit("feed")).alias("source"), "seq",
        op.failure_class(F.col("status"), F.col("problem")).alias("reason")), NOW).select(
        "source", "readable", "reason", "entries", F.col("upper_median").cast("long").alias("upper_median"),
        F.round("per_day", 4).alias("per_day"), F.round("per_week", 4).alias("per_week"), "stale",
        F.when(F.col("readable"), F.col("reliable")).alias("reliable")))
query("listing_candidates", f"""
WITH f AS (SELECT source, {_normal('url')} AS u, min(page_id) AS page_id FROM listing_pages WHERE source IN ('src0', 'src2', 'src4')
  GROUP BY 1, 2),
k AS (SELECT DISTINCT {_normal('url')} AS u FROM pages WHERE url LIKE '%utm_source%'),
n AS (SELECT p.page_id, p.source, CASE WHEN p.page_id <> f.page_id THEN 'duplicate' WHEN k.u IS NOT NULL THEN 'known' END AS fate
  FROM listing_pages p JOIN f ON f.source = p.source AND f.u = {_normal('p.url')} LEFT JOIN k ON k.u = f.u)
SELECT page_id, source, CASE WHEN fate IS NOT NULL THEN fate WHEN page_id % 4 = 3 THEN 'no price' WHEN page_id % 5 = 4 THEN 'no location' WHEN page_id % 7 = 6
  THEN 'no photo' ELSE 'candidate' END AS outcome, CASE WHEN fate IS NULL AND page_id % 4 <> 3 THEN '$' || format('{{:,}}', 250000 + page_id * 1000)
  END AS price, CASE WHEN fate IS NULL AND page_id % 5 <> 4 THEN 'City' || chr(CAST(97 + page_id % 26 AS INT)) END AS location_city
FROM n""")(
    lambda v: op.listing_candidates(v.listing_pages, v.sources, _utm(v), [r"\$[\d,]{5,}"]).select(
        "page_id", "source", "outcome", "price", "location_city"))


def _offers(v):
    """Listing pages of three kinds of sites: US addresses, Taiwanese addresses with prices in 萬, and no addresses."""
    taiwan = ("replace(html, '</article>', concat(IF(page_id % 3 <> 2, concat('<p>總價 ', 1000 + page_id, ' 萬</p>'), ''), "
              "IF(page_id % 4 <> 1, concat('<p>地址：', element_at(array('台北市', '臺中市', '高雄市'), CAST(page_id % 3 + 1 AS INT)), '中山區南京東路', "
              "page_id, '號</p>'), ''), '</article>'))")
    return v.listing_pages.withColumn("html", F.expr(f"IF(page_id % 5 = 2, {taiwan}, html)"))


def _settings(v):
    """Settings of the listing sources (configuration, one row per source)."""
    dollars, wan = [r"USD[\d,]{5,}", r"\$[\d,]{5,}"], [r"[\d,]+\s?萬"]
    rows = [("src0", "address", True, "United States", dollars, 40), ("src2", "tw_address", True, "Taiwan", wan, 1000),
            ("src4", "none", False, "Japan", dollars, 60)]
    return config_frame(v.spark, rows, struct("key string, location_from string, require_location boolean, country string, price_patterns array<string>, "
                                              "max_details int"))


def _intake(v):
    return op.listing_intake(_offers(v), v.sources, _utm(v), _settings(v), most_details=1000)


_INTAKE = f"""
f AS (SELECT source, {_normal('url')} AS u, min(page_id) AS page_id FROM listing_pages WHERE source IN ('src0', 'src2', 'src4') GROUP BY 1, 2),
k AS (SELECT DISTINCT {_normal('url')} AS u FROM pages WHERE url LIKE '%utm_source%'),
n AS (SELECT p.page_id, p.source, {_normal('p.url')} AS url, CASE WHEN p.page_id <> f.page_id THEN 'duplicate' WHEN k.u IS NOT NULL THEN 'known' END AS fate
  FROM listing_pages p JOIN f ON f.source = p.source AND f.u = {_normal('p.url')} LEFT JOIN k ON k.u = f.u),
m AS (SELECT *, CASE WHEN fate IS NOT NULL THEN fate WHEN row_number() OVER (PARTITION BY source, fate IS NULL ORDER BY page_id) > CASE source
  WHEN 'src0' THEN 40 WHEN 'src2' THEN 1000 ELSE 60 END THEN 'over limit' END AS early FROM n),
x AS (SELECT *, CASE WHEN early IS NOT NULL THEN NULL WHEN source = 'src2' THEN CASE WHEN page_id % 3 <> 2 THEN (1000 + page_id) || ' 萬' END
    WHEN page_id % 4 <> 3 THEN '$' || format('{{:,}}', 250000 + page_id * 1000) END AS price,
  CASE WHEN early IS NOT NULL OR source = 'src4' THEN NULL WHEN source = 'src2' THEN CASE WHEN page_id % 4 <> 1 THEN ['台北市', '台中市', '高雄市'][page_id % 3 + 1] END
    ELSE 'City' || chr(CAST(97 + page_id % 26 AS INT)) END AS city FROM m),
jd AS (SELECT page_id, source, url, CASE WHEN early IS NOT NULL THEN early WHEN price IS NULL THEN 'no price' WHEN city IS NULL AND source <> 'src4' THEN 'no location'
  WHEN page_id % 7 = 6 THEN 'no photo' ELSE 'candidate' END AS outcome, price, city AS location_city, CASE WHEN early IS NULL THEN CASE source WHEN 'src0'
  THEN 'United States' WHEN 'src2' THEN 'Taiwan' ELSE 'Japan' END END AS location_country,
  CASE WHEN early IS NULL THEN 'Source ' || substr(source, 4) || ' の物件ページ' END AS for_sale_evidence FROM x)"""
query("listing_intake", f"""WITH {_INTAKE.strip()}
SELECT page_id, source, outcome, price, location_city, location_country, for_sale_evidence FROM jd""")(
    lambda v: _intake(v).select("page_id", "source", "outcome", "price", "location_city", "location_country", "for_sale_evidence"))
query("listing_stats", f"""WITH {_INTAKE.strip()},
t AS (SELECT source, count(*) AS seen_urls FROM listing_pages WHERE source IN ('src0', 'src2', 'src4') GROUP BY 1),
s AS (SELECT source, array_to_string(list(url ORDER BY page_id)[1:10], ' ') AS no_price_samples FROM jd WHERE outcome = 'no price' GROUP BY 1)
SELECT t.source, t.seen_urls, count(*) FILTER (outcome <> 'duplicate') AS matched_urls,
  count(*) FILTER (outcome IN ('candidate', 'no price', 'no location', 'no photo')) AS fetched, count(*) FILTER (outcome = 'candidate') AS candidate,
  count(*) FILTER (outcome = 'known') AS known, count(*) FILTER (outcome = 'over limit') AS over_limit, count(*) FILTER (outcome = 'no price') AS no_price,
  count(*) FILTER (outcome = 'no location') AS no_location, count(*) FILTER (outcome = 'no photo') AS no_photo,
  coalesce(any_value(s.no_price_samples), '') AS no_price_samples
FROM t JOIN jd ON jd.source = t.source LEFT JOIN s ON s.source = t.source GROUP BY 1, 2""")(
    lambda v: op.listing_stats(v.listing_pages.filter("source IN ('src0', 'src2', 'src4')"), _intake(v)).select(
        "source", "seen_urls", "matched_urls", "fetched", "candidate", "known", "over_limit", "no_price", "no_location", "no_photo",
        F.array_join("no_price_samples", " ").alias("no_price_samples")))


def _utm(v):
    from curalens.functions.urls import normalize_url
    return v.table("pages").filter("url LIKE '%utm_source%'").select(normalize_url(F.col("url")).alias("source_url"))


query("relink", """
SELECT p.id, CASE WHEN s.kind = 'listing' THEN p.source_url WHEN d.doc_id IS NULL THEN NULL
    WHEN d.doc_id % 5 = 0 THEN 'https://homes.savills.com/list/' || d.doc_id || '/a/b'
    WHEN d.doc_id % 3 = 0 THEN 'https://www.zillow.com/homedetails/' || d.doc_id || '_zpid/' END AS listing_url,
  CASE WHEN s.kind = 'listing' THEN 'copied' WHEN d.doc_id % 5 = 0 OR d.doc_id % 3 = 0 THEN 'found' ELSE 'not found' END AS how
FROM properties p LEFT JOIN sources s ON s.key = p.source LEFT JOIN documents d ON d.doc_id = p.id
WHERE p.listing_url IS NULL""")(
    lambda v: op.relink(v.properties, v.sources, v.entries.select("id", "text").join(v.article_links, "id").join(
        v.properties.select("id", F.col("source_url").alias("url")), "id")))
