"""Images and page matching over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens import config
from curalens.functions import photos
from curalens.operators import images as op
from curalens.operators import matching as match
from curalens.plans.registry import query
from curalens.schemas import struct
from curalens.sources.local import config_frame

_GENERIC = ", ".join(f"'{w}'" for w in config.GENERIC_WORDS)
_BLOCK_LIST = ", ".join(f"('{d}')" for d in config.BLOCKED_DOMAINS)
_BLOCKED = f"""
bl AS (SELECT * FROM (VALUES {_BLOCK_LIST}) t(domain) UNION SELECT 'src' || i || '.example.com' FROM range(20) t(i)
  WHERE i % 8 = 0)"""
_HOST = r"regexp_replace(regexp_extract(lower({u}), '^[a-z]+://([^/?#]*)', 1), '^www\.', '')"
_IS_BLOCKED = "EXISTS (SELECT 1 FROM bl WHERE {h} = domain OR {h} LIKE '%.' || domain)"


def _host(u):
    return _HOST.format(u=u)


def _is_blocked(u):
    return _IS_BLOCKED.format(h=_host(u))


def _words(t):
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^a-z0-9]+'), lambda w: w <> ''))"


_TERMS = f"""
idt AS (SELECT id, list_filter({_words('street_address')}, lambda w: regexp_matches(w, '^[0-9]{{3,}}$'))[1] AS street_number,
  list_distinct(list_filter(list_concat({_words('display_name')}, {_words('title')}, {_words('street_address')}),
    lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) >= 3 AND w NOT IN ({_GENERIC}))) AS terms FROM properties)"""
_MATCH = _TERMS + f""",
fd AS (SELECT h.*, i.street_number, i.terms, list_concat({_words('h.url')}, {_words('h.title')}) AS found
  FROM page_hits h JOIN idt i ON i.id = h.property_id),
pm AS (SELECT property_id, url, title, position, CASE WHEN list_contains(found, street_number) THEN 2 ELSE 0 END
  + coalesce(list_sum(list_transform(list_filter(terms, lambda w: list_contains(found, w)), lambda w: CASE WHEN length(w) >= 6
    THEN 2 ELSE 1 END)), 0) AS points FROM fd)"""


def _usable(hits: str, known: str) -> str:
    return f"""
cl AS (SELECT property_id, regexp_replace(url, '#.*$', '') AS url, position FROM {hits}),
ft AS (SELECT property_id, url, min(position) AS position FROM cl GROUP BY 1, 2),
fr AS (SELECT *, {_host('url')} AS host FROM ft WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.property_id = ft.property_id
  AND regexp_replace(k.url, '#.*$', '') = ft.url) AND NOT {_is_blocked('url')}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY property_id, host ORDER BY position, url) AS s FROM fr),
us AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY position, url) AS place FROM s1 WHERE s <= 2)"""


def _blocked(v):
    listed = config_frame(v.spark, [(d,) for d in config.BLOCKED_DOMAINS], struct("domain string"))
    return match.blocked_domains(listed, v.sources)


query("url_domain_join", f"""WITH {_BLOCKED.strip()}
SELECT id, listing_url FROM properties WHERE listing_url IS NOT NULL AND {_is_blocked('listing_url')}""")(
    lambda v: match.url_domain_join(v.properties.filter("listing_url IS NOT NULL").select("id", "listing_url"), _blocked(v),
                                    "listing_url"))
query("blocked_domains", f"""WITH {_BLOCKED.strip()}
SELECT p.source, count(*) AS n FROM properties p JOIN sources s ON s.key = p.source
JOIN bl ON bl.domain = replace(s.base_url, 'https://www.', '') GROUP BY 1""")(
    lambda v: v.properties.groupBy("source").agg(F.count("*").alias("n")).join(
        v.sources.select(F.col("key").alias("source"), F.regexp_replace("base_url", r"^https://www\.", "").alias("domain")),
        "source").join(_blocked(v), "domain").select("source", "n"))
query("source_by_domain", f"""
WITH b AS (SELECT replace(base_url, 'https://www.', '') AS domain, key, rank, row_number() OVER (ORDER BY kind <> 'listing',
  ordinal) AS o FROM sources)
SELECT p.page_id AS id, coalesce(arg_min(b.key, b.o), 'manual') AS source, arg_min(b.rank, b.o) AS source_rank
FROM (SELECT page_id, 'https://m.src' || (page_id % 25) || '.example.com/x' AS url FROM pages) p
LEFT JOIN b ON {_host('p.url')} = b.domain OR {_host('p.url')} LIKE '%.' || b.domain GROUP BY 1""")(
    lambda v: match.source_by_domain(v.table("pages").selectExpr(
        "page_id AS id", "concat('https://m.src', page_id % 25, '.example.com/x') AS url"), v.sources)
    .select("id", "source", "source_rank"))
query("lookup_source", """
SELECT p.id, coalesce(s.name, p.source) AS source_name, s.mode FROM properties p LEFT JOIN sources s ON s.key = p.source""")(
    lambda v: match.lookup_source(v.properties, v.sources).select("id", "source_name", "mode"))
query("status_url", f"""WITH {_BLOCKED.strip()}
SELECT id, CASE WHEN listing_url LIKE 'http%' AND NOT {_is_blocked('listing_url')} THEN listing_url
  WHEN source_url LIKE 'http%' AND NOT {_is_blocked('source_url')} THEN source_url END AS check_url FROM properties""")(
    lambda v: match.status_urls(v.properties, _blocked(v)).select("id", "check_url"))
query("identity_terms", f"""WITH {_TERMS.strip()}
SELECT id, street_number, array_to_string(list_sort(terms), ' ') AS terms FROM idt""")(
    lambda v: match.identity_terms(v.properties).select("id", "street_number", F.array_join(F.array_sort("terms"), " ")
                                                        .alias("terms")))
query("page_match", f"""WITH {_MATCH.strip()}
SELECT property_id, url, title, position, CAST(points AS INT) AS points FROM pm WHERE points >= 2""")(
    lambda v: match.page_match(v.properties, v.page_hits).select("property_id", "url", "title", "position", "points"))
query("usable_pages", f"""
WITH kn AS (SELECT property_id, origin_url AS url FROM images WHERE origin_url IS NOT NULL),
{_BLOCKED.strip()},{_usable('page_hits', 'kn')}
SELECT property_id, url, host, CAST(place AS INT) AS place FROM us WHERE place <= 6""")(
    lambda v: match.usable_pages(v.page_hits, op.visited_origins(v.images), _blocked(v))
    .select("property_id", "url", "host", "place"))
query("search_query", """
SELECT id, trim(concat_ws(' ', coalesce(display_name, title), street_address, location_city)) AS query FROM properties""")(
    lambda v: match.search_query(v.properties).select("id", "query"))

query("image_accept", """
SELECT CASE WHEN mime NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'wrong_type' WHEN least(width, height) < 640
  THEN 'too_small' WHEN origin_url IS NOT NULL AND stddev < 3 THEN 'flat' END AS skip_reason, property_id, count(*) AS n
FROM images GROUP BY 1, 2""")(
    lambda v: op.image_accept(v.images).groupBy("property_id", "skip_reason").agg(F.count("*").alias("n")))
query("image_positions", """
WITH c AS (SELECT property_id, max(position) AS m, count(*) AS n FROM images WHERE origin_url IS NULL GROUP BY 1),
f AS (SELECT property_id, source_url, row_number() OVER (PARTITION BY property_id ORDER BY fetched_at, source_url) AS rn
  FROM images WHERE origin_url IS NOT NULL)
SELECT f.property_id, f.source_url, CASE WHEN f.rn <= 5 - coalesce(c.n, 0) THEN CAST(coalesce(c.m, 0) + f.rn AS INT) END AS position,
  CASE WHEN f.rn > 5 - coalesce(c.n, 0) THEN 'over limit' END AS reason FROM f LEFT JOIN c ON c.property_id = f.property_id""")(
    lambda v: op.image_positions(op.undo_fill(v.images), v.images.filter("origin_url IS NOT NULL").selectExpr(
        "property_id", "source_url", "fetched_at AS arrival"), 5).select("property_id", "source_url", "position", "reason"))
query("image_order", """
WITH h AS (SELECT DISTINCT property_id, position FROM images),
x AS (SELECT p.id, p.property_id, h.position, coalesce(nullif(coalesce(list_position(list_transform(string_split(p.image_order,
  ','), lambda s: CAST(s AS INT)), h.position), 0), 0), 1000) AS k FROM posts p JOIN h ON h.property_id = p.property_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, position) AS place FROM x)
SELECT id, position, CAST(place AS INT) AS place FROM r WHERE place <= 10""")(
    lambda v: op.image_order(v.posts, v.images).select("id", "position", "place"))
query("folder_sequence", """
SELECT id AS property_id, 'lot' || lpad(CAST((SELECT max(CAST(regexp_replace(folder_name, '[^0-9]', '', 'g') AS BIGINT))
  FROM deliveries) + row_number() OVER (ORDER BY id) AS VARCHAR), 9, '0') AS folder_name FROM properties
WHERE status = 'approved'""")(
    lambda v: op.folder_sequence(v.deliveries, v.properties.filter("status = 'approved'").selectExpr("id AS property_id")))
query("photoless", """
WITH l AS (SELECT property_id, min({'p': position, 'u': source_url, 's': stddev}).s AS s FROM images GROUP BY 1)
SELECT p.id, CASE WHEN l.property_id IS NULL THEN 'no image' ELSE 'flat' END AS why FROM properties p
LEFT JOIN l ON l.property_id = p.id WHERE p.status <> 'delivered' AND (l.property_id IS NULL OR l.s < 3)""")(
    lambda v: op.photoless(v.properties, v.images).select("id", "why"))
query("probe_urls", """
SELECT property_id, source_url, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY property_id
  ORDER BY position, source_url) AS rn FROM images) WHERE rn <= 2""")(
    lambda v: op.probe_urls(v.images).select("property_id", "source_url", "rn"))
query("undo_fill", "SELECT property_id, source_url FROM images WHERE origin_url IS NULL")(
    lambda v: op.undo_fill(v.images).select("property_id", "source_url"))
query("visited_origins", """SELECT DISTINCT property_id, origin_url AS url FROM images WHERE origin_url IS NOT NULL""")(
    lambda v: op.visited_origins(v.images))
query("already_have", """
WITH c AS (SELECT property_id, source_url FROM images),
g AS (SELECT DISTINCT property_id, source_url FROM images WHERE mime = 'image/jpeg'),
o AS (SELECT DISTINCT property_id, source_url FROM image_skips)
SELECT c.property_id, CASE WHEN g.source_url IS NOT NULL THEN 'taken' WHEN o.source_url IS NOT NULL THEN 'skipped before'
  ELSE 'new' END AS state, count(*) AS n FROM c
LEFT JOIN g ON g.property_id = c.property_id AND g.source_url = c.source_url
LEFT JOIN o ON o.property_id = c.property_id AND o.source_url = c.source_url GROUP BY 1, 2""")(
    lambda v: op.already_have(v.images.select("property_id", "source_url"), v.images.filter("mime = 'image/jpeg'"),
                              v.image_skips).groupBy("property_id", "state").agg(F.count("*").alias("n")))
query("fill_plan", f"""
WITH ic AS (SELECT property_id, count(*) AS n FROM images GROUP BY 1),
sh AS (SELECT p.id AS property_id, 10 - coalesce(ic.n, 0) AS need FROM properties p LEFT JOIN ic ON ic.property_id = p.id
  WHERE p.status IN ('approved', 'delivered') AND coalesce(ic.n, 0) < 10),
kn AS (SELECT property_id, origin_url AS url FROM images WHERE origin_url IS NOT NULL
  UNION ALL (SELECT id, source_url FROM properties) UNION ALL (SELECT id, listing_url FROM properties WHERE listing_url IS NOT NULL)),
{_BLOCKED.strip()},{_MATCH},
pk AS (SELECT * FROM pm WHERE points >= 2 AND property_id IN (SELECT property_id FROM sh)),{_usable('pk', 'kn')}
SELECT us.property_id, us.url, CAST(us.place AS INT) AS place, sh.need FROM us JOIN sh ON sh.property_id = us.property_id
WHERE us.place <= 6""")(
    lambda v: op.fill_plan(v.properties, v.images, v.page_hits, _blocked(v)).select("property_id", "url", "place", "need"))

_UPLOADS = """SELECT l_orderkey AS id, 'https://Photos.Example.com/' || CASE WHEN l_partkey % 3 = 0 THEN 'media/' ELSE
  'wp-content/uploads/' END || 'Villa-' || l_partkey || CASE l_linenumber WHEN 1 THEN '-740x492' WHEN 2 THEN '-150x150'
  WHEN 3 THEN '@2x' WHEN 4 THEN '-scaled' ELSE '' END || '.jpg' || CASE l_suppkey % 5 WHEN 0 THEN '?w=300' WHEN 1 THEN '?w=80'
  WHEN 2 THEN '?sig=abc&w=900' ELSE '' END AS url FROM lineitem"""
_SPARK_UPLOADS = [
    "l_orderkey AS id", "concat('https://Photos.Example.com/', IF(l_partkey % 3 = 0, 'media/', 'wp-content/uploads/'), 'Villa-', "
    "l_partkey, CASE l_linenumber WHEN 1 THEN '-740x492' WHEN 2 THEN '-150x150' WHEN 3 THEN '@2x' WHEN 4 THEN '-scaled' "
    "ELSE '' END, '.jpg', CASE l_suppkey % 5 WHEN 0 THEN '?w=300' WHEN 1 THEN '?w=80' WHEN 2 THEN '?sig=abc&w=900' ELSE '' END) "
    "AS url"]
query("photo_identity", f"""
WITH u AS ({_UPLOADS})
SELECT regexp_replace(regexp_replace(regexp_replace(replace(lower(regexp_extract(url, '^([^?]*)', 1)), 'https://', ''),
  '-[0-9]{{2,5}}x[0-9]{{2,5}}(\\.[a-z]{{3,4}})$', '\\1'), '[@_-][23]x(\\.[a-z]{{3,4}})$', '\\1'), '-scaled(\\.[a-z]{{3,4}})$', '\\1')
  AS identity, count(*) AS n FROM u GROUP BY 1""")(
    lambda v: v.table("lineitem").selectExpr(*_SPARK_UPLOADS).groupBy(
        photos.photo_identity(F.col("url")).alias("identity")).agg(F.count("*").alias("n")))
query("original_upload_url", f"""
WITH u AS ({_UPLOADS})
SELECT CASE WHEN url NOT LIKE '%/wp-content/uploads/%' OR url LIKE '%w=80' OR url LIKE '%sig=%' THEN url
  ELSE replace(regexp_extract(url, '^([^?]*)', 1), '-740x492', '') END AS original, count(*) AS n FROM u GROUP BY 1""")(
    lambda v: v.table("lineitem").selectExpr(*_SPARK_UPLOADS).groupBy(
        photos.original_upload_url(F.col("url")).alias("original")).agg(F.count("*").alias("n")))
query("srcset_largest", """
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'https://h.example.com/a/' || p_partkey || '-m.jpg'
  WHEN p_size <= 20 THEN 'https://h.example.com/s.jpg' ELSE 'https://h.example.com/a/' || p_partkey || '-l.jpg' END AS url
FROM part""")(
    lambda v: v.table("part").selectExpr(
        "p_partkey AS id", "concat('/s.jpg 400w, ', p_partkey, '-l.jpg ', p_size * 20, 'w, ', p_partkey, '-m.jpg ', "
        "IF(p_size % 3 = 0, '2000w', '2x')) AS srcset")
    .select("id", photos.srcset_largest(F.col("srcset"), F.lit("https://h.example.com/a/index.html?x=1")).alias("url")))
