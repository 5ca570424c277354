"""DuckDB definitions of the domain tables, for the result checks."""

from __future__ import annotations

from curalens import config

_YEAR = "(1800 + (o_custkey * 7 + o_orderkey) % 220)"
_AMOUNT = "CAST(trunc(o_totalprice) AS BIGINT)"
_TAGS = ", ".join(f"'{t}'" for t in config.FEEDBACK_TAGS)
_FX = ", ".join(f"('{c}', CAST({r} AS DOUBLE))" for c, r in config.FALLBACK_JPY_PER.items())

ORACLE_VIEWS = {
    "properties": f"""
SELECT o_orderkey AS id,
  CASE WHEN o_custkey % 3 = 0 THEN 'src0' ELSE 'src' || (o_custkey % 20) END AS source,
  CASE WHEN o_custkey % 20 < 4 THEN 'S' WHEN o_custkey % 20 < 10 THEN 'A' WHEN o_custkey % 20 < 17 THEN 'B' END
    AS source_rank,
  'https://www.src' || (o_custkey % 20) || '.example.com/listing/' || o_orderkey AS source_url,
  CASE o_orderkey % 3 WHEN 1 THEN 'https://www.zillow.com/homedetails/' || o_orderkey
    WHEN 2 THEN 'https://homes.example.net/p/' || o_orderkey END AS listing_url,
  CASE WHEN o_orderkey % 4 = 0 THEN (100 + o_orderkey % 900) || ' Java Drive, City' || (o_custkey % 25)
    || ', FL 33435 - MLS# A' || (10000000 + o_orderkey) ELSE 'Customer House ' || o_custkey END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0
    THEN 'A very long headline that is not really a name ' || o_orderkey ELSE 'Maison ' || o_custkey END
    AS display_name,
  CASE WHEN o_orderkey % 8 <> 0 THEN 'body ' || o_orderkey END AS caption_body,
  repeat(o_orderpriority, CAST(1 + o_orderkey % 40 AS INT)) AS content_text,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN '$' || format('{{:,}}', {_AMOUNT})
    WHEN 1 THEN '€' || {_AMOUNT} WHEN 2 THEN '£' || ({_AMOUNT} // 100000) || '.' || (({_AMOUNT} // 10000) % 10) || 'm'
    WHEN 3 THEN 'NT$' || format('{{:,}}', {_AMOUNT} * 30) WHEN 4 THEN format('{{:,}}', {_AMOUNT} // 100) || ' 萬'
    ELSE 'Price on request' END END AS price,
  CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN {_AMOUNT} WHEN 1 THEN {_AMOUNT}
    WHEN 2 THEN ({_AMOUNT} // 10000) * 100000 WHEN 3 THEN {_AMOUNT} * 30 WHEN 4 THEN ({_AMOUNT} // 100) * 10000
    END END AS DOUBLE) AS price_value,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE ['USD', 'EUR', 'GBP', 'TWD', 'TWD', 'XXX'][o_orderkey % 6 + 1] END
    AS price_currency,
  CASE WHEN o_orderkey % 9 <> 0 THEN 'City' || (o_custkey % 25) END AS location_city,
  'Region' || (o_custkey % 5) AS location_region,
  CASE WHEN o_orderkey % 31 <> 0 THEN ['United States', 'United States', 'Portugal', 'Spain', 'Taiwan', 'Japan',
    'United Kingdom', 'France'][o_custkey % 8 + 1] END AS location_country,
  CASE WHEN o_orderkey % 4 <> 2 THEN (100 + o_orderkey % 900) || ' Corondale '
    || ['Avenue', 'Street', 'Lane'][o_custkey % 3 + 1] END AS street_address,
  o_orderstatus <> 'F' AS is_for_sale,
  CASE WHEN o_orderkey % 11 <> 0 THEN ['architect', 'loft', 'hidden_gem', 'adaptive_reuse', 'penthouse']
    [o_custkey % 5 + 1] END AS genre,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Architect ' || (o_custkey % 50) END AS architect,
  CASE o_orderkey % 5 WHEN 0 THEN 'built in ' || {_YEAR} WHEN 1 THEN 'c. ' || {_YEAR} || 's'
    WHEN 2 THEN {_YEAR} || '–' || ({_YEAR} + 10) WHEN 4 THEN 'Unit 4501' END AS year_built,
  CAST(CASE WHEN o_orderkey % 5 < 3 THEN {_YEAR} END AS INT) AS year_built_value,
  CASE WHEN o_custkey % 3 = 0 THEN ['Art Deco', 'Victorian', 'Brutalist', 'Mid-Century'][o_custkey % 4 + 1] END
    AS style_name,
  CASE WHEN o_custkey % 7 = 0 THEN 'warehouse' END AS usage_type, CAST(NULL AS VARCHAR) AS structure,
  CASE o_orderkey % 4 WHEN 0 THEN ({_AMOUNT} % 5000 + 100) || ' sq ft' WHEN 1 THEN '1.5 acres'
    WHEN 2 THEN '120 sqm' END AS building_area,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN NULL ELSE floor(o_totalprice / 500) / 10.0::DOUBLE END
    AS score,
  CASE WHEN o_orderkey % 12 = 0 THEN 'story=' || (o_orderkey % 40) || ' < 40'
    WHEN o_orderkey % 12 = 6 THEN '築年 ' || {_YEAR} || ' ≧ 2000' ELSE '' END AS gate,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'told by ' || o_custkey END AS story_reason,
  NOT (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AND o_orderkey % 13 <> 0 AS has_detail,
  [{{'key': 'story', 'raw': CAST((o_orderkey * 7) % 101 AS DOUBLE)}},
   {{'key': 'style', 'raw': CASE WHEN o_custkey % 3 = 0 THEN 100.0 ELSE 0.0 END}},
   {{'key': 'one_of_a_kind', 'raw': CASE WHEN o_orderkey % 4 = 1 THEN 100.0 ELSE 0.0 END}},
   {{'key': 'source', 'raw': CASE WHEN o_custkey % 20 < 4 THEN 100.0 WHEN o_custkey % 20 < 10 THEN 70.0
      WHEN o_custkey % 20 < 17 THEN 40.0 ELSE 0.0 END}},
   {{'key': 'for_sale', 'raw': CAST((o_orderkey % 3) * 50 AS DOUBLE)}},
   {{'key': 'genre', 'raw': CAST(20 + (o_custkey % 5) * 20 AS DOUBLE)}},
   {{'key': 'area', 'raw': CAST(20 + (o_custkey % 3) * 40 AS DOUBLE)}},
   {{'key': 'price', 'raw': CASE WHEN o_totalprice > 200000 THEN 100.0 ELSE 0.0 END}}] AS axes,
  o_custkey % 3 = 0 AS flag_style, o_orderkey % 4 = 1 AS flag_unique,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_custkey % 3 = 0 END AS style_identified,
  CASE WHEN o_orderkey % 10 = 8 THEN NULL ELSE o_orderkey % 4 = 1 END AS one_of_a_kind,
  o_totalprice < 100000 AS provenance_visible,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'delivered'
    ELSE 'approved' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'rejected' ELSE 'approved' END END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN 'island' END AS series,
  CAST(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 5 ELSE 0 END AS INT) AS delivery_attempts,
  CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 5 > 0 THEN CASE o_orderkey % 4
    WHEN 1 THEN 'no images: all were too small' WHEN 2 THEN 'page gone: 404' WHEN 3 THEN 'upload: timeout' END END
    AS delivery_error,
  CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 5 > 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 48 AS INT)) END
    AS delivery_attempted_at,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'active' WHEN 2 THEN 'pending' WHEN 3 THEN 'sold'
    WHEN 4 THEN 'off_market' ELSE 'unknown' END AS listing_status,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 5 DAY END AS listing_status_at,
  CASE WHEN o_orderkey % 4 = 0 THEN 'A' || (10000000 + o_orderkey) END AS mls_number,
  CASE WHEN o_orderstatus NOT IN ('O', 'F') AND o_orderkey % 2 = 0 THEN 'not for us: ' || o_orderpriority END AS reject_reason,
  CASE WHEN o_orderkey % 10 = 3 THEN 'https://pages.example.com/' || o_orderkey END AS image_page_url,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'seen as ' || o_orderpriority END AS listing_status_note,
  o_orderdate AS collected_at,
  CASE WHEN NOT (o_orderstatus = 'O' AND o_orderkey % 3 = 0) THEN o_orderdate + INTERVAL 1 DAY END AS scored_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 2 DAY END AS reviewed_at
FROM orders""",
    "deliveries": """
SELECT o_orderkey AS property_id, 'lot' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS folder_name,
  CAST(o_orderkey % 10 + 1 AS INT) AS image_count, o_orderdate + INTERVAL 3 DAY AS delivered_at
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0""",
    "images": """
SELECT l_orderkey AS property_id, 'https://img' || (l_suppkey % 10) || '.example.com/' || l_partkey || '-'
    || l_linenumber || '-' || CAST(trunc(l_quantity) AS INT) || '.jpg' AS source_url,
  CASE WHEN l_returnflag <> 'N' THEN 'https://pages' || (l_suppkey % 7) || '.example.org/' || (l_orderkey % 50) END
    AS origin_url,
  CAST(400 + l_partkey % 1600 AS INT) AS width, CAST(300 + l_suppkey * 7 % 1500 AS INT) AS height,
  ['image/jpeg', 'image/png', 'image/webp', 'image/gif'][l_partkey % 4 + 1] AS mime,
  CAST(l_suppkey % 9 AS DOUBLE) AS stddev, l_linenumber AS position, l_shipdate AS fetched_at
FROM lineitem""",
    "image_skips": """
SELECT l_orderkey AS property_id, 'https://img' || (l_suppkey % 10) || '.example.com/' || l_partkey || '-'
    || l_linenumber || '-' || CAST(trunc(l_quantity) AS INT) || '.jpg' AS source_url,
  ['too_small', 'wrong_type', 'failed', 'robots', 'broken'][l_linenumber % 5 + 1] AS reason, l_shipdate AS created_at
FROM lineitem WHERE l_discount >= 0.08""",
    "posts": """
SELECT event_id AS id, CASE WHEN event_id % 17 <> 0 THEN user_id * 50 + event_id % 50 END AS property_id,
  CASE event_type WHEN 'signup' THEN 'story' WHEN 'purchase' THEN 'reel' ELSE 'feed' END AS kind,
  ['published', 'published', 'published', 'published', 'published', 'published', 'planned', 'failed', 'skipped',
   'publishing'][event_id % 10 + 1] AS state,
  date_trunc('hour', ts) AS scheduled_at, CASE WHEN event_id % 10 < 6 THEN ts END AS published_at,
  CASE WHEN event_type = 'signup' THEN event_id - 1 END AS parent_post_id,
  CASE WHEN event_id % 10 < 6 THEN 'm' || event_id END AS media_id,
  CASE WHEN event_id % 10 < 6 AND event_id % 7 <> 3 THEN CAST(floor(value * 10) AS BIGINT) END AS reach,
  CAST(event_id % 4 AS INT) AS attempts, CASE WHEN event_id % 10 = 7 THEN 'upload: timeout' END AS error,
  CASE WHEN event_id % 3 = 0 THEN 'lead' || chr(10) || '【 Villa ' || event_id || ' 】'
    ELSE '・' || chr(10) || 'plain line ' || event_id END AS caption,
  CASE WHEN event_id % 6 = 0 THEN ts END AS caption_edited_at,
  CASE WHEN event_id % 5 = 0 THEN '3,1,9' END AS image_order,
  CASE WHEN event_id % 4 = 1 THEN 'remember ' || event_id END AS note
FROM events""",
    "reach_readings": """
SELECT 'm' || (event_id - event_id % 5) AS media_id, ts AS read_at, CAST(floor(value * 10) AS BIGINT) AS reach
FROM events""",
    "media_checks": """
SELECT 'm' || event_id AS media_id, CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS present
FROM events WHERE event_type <> 'signup'""",
    "feedback": f"""
SELECT o_orderkey * 10 AS id, o_orderkey AS property_id, 'not convincing: ' || o_orderpriority || ' ' || o_custkey
    AS reason,
  CASE WHEN o_custkey % 10 < 8 THEN [{_TAGS}][o_custkey % 10 + 1] END AS reason_tag,
  o_orderdate + INTERVAL 2 DAY AS created_at
FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0""",
    "rules": """
SELECT reason_tag, count(*) AS hit_count, 'avoid ' || reason_tag AS proposal,
  CASE WHEN reason_tag LIKE '%t%e' THEN 'dismissed' WHEN reason_tag LIKE 'n%' THEN 'approved' ELSE 'proposed' END
    AS state
FROM feedback WHERE created_at < TIMESTAMP '1996-01-01' AND reason_tag IS NOT NULL GROUP BY reason_tag""",
    "weekly_notes": """
SELECT c.conv_id * 1000 + c.turn AS id, CAST(DATE '2023-11-06' + CAST(7 * (c.conv_id % 12) AS INT) AS DATE) AS week_start,
  c.text || ' ' || length(c.text) || '本 / ' || c.turn || '〜' || (c.turn + 2) || '枚' AS body,
  b.text || ' ' || length(b.text) || ' and ' || (c.turn + 2) AS source,
  make_timestamp((1704067200 + c.conv_id * 60 + c.turn) * 1000000) AS created_at
FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn
WHERE c.role = 'assistant'""",
    "fx_readings": """
SELECT ['USD', 'EUR', 'GBP', 'TWD', 'JPY', 'HKD'][o_custkey % 6 + 1] AS currency, o_totalprice / 1000 AS jpy_per,
  o_orderdate + to_seconds(o_orderkey) AS fetched_at
FROM orders""",
    "raw_pages": "SELECT * FROM pages",
    "page_status": """
SELECT page_id, url, html, CAST(CASE page_id % 20 WHEN 7 THEN 404 WHEN 13 THEN 410 ELSE 200 END AS INT) AS status
FROM pages""",
    "listing_pages": """
SELECT page_id, 'src' || (page_id % 5) AS source, url, replace(html, '</article>',
  CASE WHEN page_id % 4 <> 3 THEN '<p>Offered at $' || format('{:,}', 250000 + page_id * 1000) || '</p>' ELSE '' END
  || CASE WHEN page_id % 5 <> 4 THEN '<p>' || (100 + page_id) || ' Highland Way, City'
     || chr(CAST(97 + page_id % 26 AS INT)) || ', CA 94937</p>' ELSE '' END
  || CASE page_id % 6 WHEN 0 THEN '<p>Listing status: Active</p>' WHEN 1 THEN '<p>just sold</p>'
     WHEN 2 THEN '<script>{"availability":"https://schema.org/SoldOut"}</script>'
     WHEN 3 THEN '<p>This listing was removed</p>' ELSE '' END
  || CASE WHEN page_id % 3 = 0 THEN '<p>MLS# ab' || (1000000 + page_id) || '</p>' ELSE '' END
  || CASE WHEN page_id % 7 <> 6 THEN '<img src="/photos/' || page_id || '-800x600.jpg"><img src="/photos/' || page_id
     || '.jpg"><img srcset="/p/' || page_id || '-s.jpg 300w, /p/' || page_id
     || '-l.jpg 1200w"><img src="/assets/logo.png">' ELSE '' END
  || '<a href="https://www.compass.com/homedetails/' || page_id || '/unit">see</a></article>') AS html
FROM pages""",
    "entries": """
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source, lang,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE 'https://www.' || source || '.example.com/' || lang || '/'
    || CASE WHEN doc_id % 9 = 0 THEN 'agents/' ELSE 'homes/' END || (doc_id % 800)
    || ['', '/', '#top', '?page=2'][doc_id % 4 + 1] END AS link,
  substr(text, 1, 60) AS title,
  CASE doc_id % 7 WHEN 0 THEN text || ' It is on the market for $' || format('{:,}', 100000 + doc_id * 37) || '.'
    WHEN 1 THEN 'The works cost €' || (10 + doc_id % 90) || ' million then. ' || text || ' The house is now for sale.'
    WHEN 2 THEN text || ' This home is for sale.' WHEN 3 THEN text || ' It once cost £' || doc_id || 'k.'
    WHEN 4 THEN text || ' Now asking price on request, listing at $' || (1 + doc_id % 9) || '.5 million or '
      || (100 + doc_id) || '万円.'
    WHEN 5 THEN text || ' Currently listed, price upon application.' ELSE text END AS text, n_chars,
  CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id % 960 AS INT)) END
    AS published_at, doc_id AS position
FROM documents""",
    "article_links": """
SELECT doc_id AS id, list_filter([
  CASE WHEN doc_id % 3 = 0 THEN 'https://www.zillow.com/homedetails/' || doc_id || '_zpid/' END,
  CASE WHEN doc_id % 4 = 0 THEN 'https://www.compass.com/agents/jane' END,
  CASE WHEN doc_id % 5 = 0 THEN 'https://homes.savills.com/list/' || doc_id || '/a/b' END,
  CASE WHEN doc_id % 6 = 0 THEN 'https://inhabit.corcoran.com/market-report-2026' END,
  'https://notcompass.com/x/' || doc_id], lambda x: x IS NOT NULL) AS links
FROM documents""",
    "known_entry_urls": """
SELECT 'https://www.' || source || '.example.com/' || lang || '/homes/' || (doc_id % 800) AS source_url
FROM documents WHERE n_chars > 2500""",
    "sources": """
SELECT 'src' || i AS key, 'Source ' || i AS name, CASE WHEN i % 4 = 0 THEN 'listing' ELSE 'editorial' END AS kind,
  substr('SAB', CAST(i % 3 + 1 AS INT), 1) AS rank, CASE WHEN i % 8 = 0 THEN 'manual_only' ELSE 'crawl' END AS mode,
  i % 5 <> 0 AS enabled, i % 6 = 0 AS assume_for_sale, i % 2 = 1 AS homes_only,
  'https://www.src' || i || '.example.com' AS base_url, CAST(i AS INT) AS ordinal
FROM range(20) t(i)""",
    "fx_rates": f"SELECT * FROM (VALUES {_FX}) t(currency, jpy_per)",
    "page_hits": """
SELECT l_orderkey AS property_id, ['https://www.zillow.com/', 'https://blog.homes.example.net/',
    'https://img.example.org/', 'https://press.example.com/'][l_suppkey % 4 + 1]
  || CASE WHEN l_partkey % 3 = 0 THEN (100 + l_orderkey % 900) || '-corondale-' ELSE 'the-north-avenue-' END
  || (l_partkey % 40) || CASE WHEN l_linenumber % 2 = 0 THEN '#photos' ELSE '' END AS url,
  CASE WHEN l_partkey % 5 = 0 THEN 'Maison by the sea' WHEN l_partkey % 5 = 1 THEN 'Customer House' END AS title,
  l_partkey * 1000 + l_suppkey * 7 + l_linenumber AS position
FROM lineitem""",
    "fetch_log": """
SELECT 'src' || (user_id % 20) AS source, event_id AS seq, event_type IN ('error', 'click') AS failed,
  CASE event_type WHEN 'error' THEN [404, 403, 429, 500][event_id % 4 + 1] WHEN 'click' THEN NULL ELSE 200 END AS status,
  CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'connect' ELSE 'timeout' END END AS problem
FROM events""",
    "robots": """
SELECT 'site' || (s_suppkey % 400) || '.example.com' AS domain,
  'https://site' || (s_suppkey % 400) || '.example.com/start' AS url, s_suppkey AS position,
  s_suppkey % 9 <> 4 AS fetched, s_suppkey % 9 = 5 AS missing, s_suppkey
FROM supplier""",
    "post_events": """
SELECT user_id AS post_id, ts AS at, event_id AS seq,
  ['claim', 'fail', 'finish', 'skip', 'retry', 'fail', 'claim'][event_id % 7 + 1] AS action
FROM events""",
    "calendar": """
SELECT user_id AS id, user_id * 50 AS property_id,
  CASE user_id % 5 WHEN 3 THEN 'story' WHEN 4 THEN 'reel' ELSE 'feed' END AS kind,
  ['published', 'planned', 'planned', 'skipped', 'publishing', 'failed', 'skipped'][user_id % 7 + 1] AS state,
  date_trunc('hour', min(ts)) + to_hours(CAST(user_id * 7 AS INT)) AS scheduled_at
FROM events GROUP BY user_id""",
    "review_events": """
SELECT l_orderkey AS property_id, l_shipdate AS at, l_partkey * 100 + l_linenumber AS seq,
  CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'reset' END AS action,
  CASE WHEN l_partkey % 5 <> 0 THEN 'reason ' || l_partkey END AS reason
FROM lineitem""",
    "assessments": f"""
SELECT o_orderkey AS property_id, CAST((o_orderkey * 13) % 131 - 15 AS INT) AS story_score,
  'because ' || o_custkey AS story_reason,
  CASE o_custkey % 7 WHEN 0 THEN 'castle' WHEN 1 THEN NULL ELSE ['architect', 'adaptive_reuse', 'hidden_gem',
    'penthouse', 'loft'][o_custkey % 5 + 1] END AS genre,
  o_custkey % 3 = 0 AS style_identified, o_orderkey % 4 = 1 AS one_of_a_kind,
  o_totalprice < 100000 AS provenance_visible, o_orderkey % 2 = 0 AS is_for_sale,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'built in ' || {_YEAR} ELSE '' END AS year_built,
  CASE WHEN o_orderkey % 3 <> 0 THEN {_YEAR} END AS built,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Town' || (o_custkey % 30) END AS city,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ['Spain', 'Japan', 'Taiwan'][o_custkey % 3 + 1] END AS country,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '$' || o_orderkey END AS price,
  'summary ' || repeat('x', CAST(o_orderkey % 100 AS INT)) AS summary,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Villa ' || o_custkey ELSE '' END AS display_name, '' AS architect,
  CASE o_orderkey % 8 WHEN 0 THEN 'deed of ' || o_custkey WHEN 1 THEN NULL ELSE '' END AS provenance_note
FROM orders""",
}
