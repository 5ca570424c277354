"""Text, URL and signal columns over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalens import config
from curalens.functions import places, urls, values
from curalens.operators import extract, signals
from curalens.operators.hashtags import hashtags
from curalens.operators.listing_status import listing_status, mls_number
from curalens.plans.registry import query

# URLs. The page URLs come with queries, fragments and trailing slashes.
_NORMAL = r"""regexp_replace(regexp_replace(regexp_extract(regexp_replace({u}, '#.*$', ''), '^[^?]*', 0),
  '(://[^/]+/.*[^/])/+$', '\1'), '(://[^/]+)/{{2,}}$', '\1') || regexp_extract(regexp_replace({u}, '#.*$', ''), '\?.+$', 0)"""


def _normal(u):
    return _NORMAL.format(u=u)


query("normalize_url", f"SELECT page_id, {_normal('url')} AS url FROM pages")(
    lambda v: v.table("pages").select("page_id", urls.normalize_url(F.col("url")).alias("url")))
query("host_of", r"""
SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS domain,
  regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') AS host FROM pages""")(
    lambda v: v.table("pages").select("page_id", urls.authority(F.col("url")).alias("domain"),
                                      urls.host_of(F.col("url")).alias("host")))
query("url_filter", """
SELECT e.id, NOT regexp_matches(e.link, '/agents/') AND (NOT s.homes_only OR regexp_matches(e.link, '/homes/')) AS allowed
FROM entries e JOIN sources s ON s.key = e.source WHERE e.link IS NOT NULL""")(
    lambda v: v.entries.filter("link IS NOT NULL").join(v.sources, F.col("source") == F.col("key")).select(
        "id", urls.url_allowed(F.col("link"), F.col("url_include"), F.col("url_exclude")).alias("allowed")))
query("extract_title", """
SELECT page_id, nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')), '') AS title FROM pages""")(
    lambda v: v.table("pages").select("page_id", extract.html_title(F.col("html")).alias("title")))
query("extract_links", """
WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*', 0) AS origin, unnest(list_distinct(
  regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1))) AS href FROM pages)
SELECT page_id, origin || href AS link FROM h WHERE href LIKE '/%'""")(
    lambda v: v.table("pages").select("page_id", F.explode(extract.html_links(F.col("html"), F.col("url"))).alias("link")))
# The supplied pages have one frame: title, navigation, advert, article, footer. Paragraphs of the article count
# from 400 characters on, else the article or the page.
query("extract_text", r"""
WITH h AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS a,
    regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)', 1, 's'), '<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs') AS b FROM pages),
s AS (SELECT page_id, a, [t, a, regexp_replace(a, '<h1>.*?</h1>', ' ', 's'), b] AS raw, regexp_split_to_array(a, '<[^>]*>') AS pieces FROM h),
d AS (SELECT page_id, a, list_transform(list_transform(raw, lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')), lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g'))) AS v,
    list_sum(list_transform(pieces, lambda x: length(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')))) AS n FROM s),
x AS (SELECT page_id, a, nullif(v[1], '') AS title, CASE WHEN length(v[3]) >= 400 THEN v[3] WHEN n >= 400 THEN v[2] ELSE v[4] END AS body FROM d)
SELECT page_id, title, length(concat_ws(' ', title, nullif(body, '')))::INT AS chars, md5(concat_ws(' ', title, nullif(body, ''))) AS digest,
  len(list_distinct(regexp_extract_all(a, '<a\s[^>]*?href="([^"]*)"', 1)))::INT AS links FROM x""")(
    lambda v: extract.extract_pages(v.table("pages"), ["page_id", "url"]).select(
        "page_id", "title", F.length("text").alias("chars"), F.md5("text").alias("digest"),
        F.size(extract.resolved_links(F.col("hrefs"), F.col("url"))).alias("links")))
query("image_urls", """
SELECT page_id, origin || '/photos/' || page_id || '-800x600.jpg' AS image, 1 AS place FROM
  (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*', 0) AS origin FROM pages WHERE page_id % 7 <> 6)
UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*', 0) || '/p/' || page_id || '-l.jpg', 2 FROM pages
  WHERE page_id % 7 <> 6""")(
    lambda v: extract.extract_pages(v.listing_pages, ["page_id", "url"]).select(
        "page_id", F.posexplode(extract.image_urls(F.col("image_refs"), F.col("url"), 30)).alias("at", "image"))
    .select("page_id", "image", (F.col("at") + 1).alias("place")))
query("url_patterns", r"""
WITH p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'),
  lambda x: x <> '') AS parts FROM pages)
SELECT CASE WHEN len(parts) > 1 THEN '/' || parts[1] || '/' ELSE '/' END AS segment, count(*) AS n, arg_min(url, page_id)
  AS sample FROM p GROUP BY 1 ORDER BY n DESC, min(page_id) LIMIT 8""")(
    lambda v: v.table("pages").groupBy(urls.first_segment(F.col("url")).alias("segment")).agg(
        F.count("*").alias("n"), F.min_by("url", "page_id").alias("sample"), F.min("page_id").alias("first"))
    .orderBy(F.col("n").desc(), "first").limit(8).drop("first"))

# Prices and years.
query("parse_price", """
SELECT id, round(price_value, 2) AS price_value, CASE WHEN price = 'Price on request' THEN NULL ELSE price_currency END
  AS price_currency FROM properties""")(
    lambda v: v.properties.select("id", values.price_parts(F.col("price")).alias("p")).select(
        "id", F.round("p.value", 2).alias("price_value"), F.col("p.currency").alias("price_currency")))
query("parse_year", r"""
SELECT id, try_cast(nullif(regexp_extract(year_built, '\b(1[0-9]{3}|20[0-9]{2})s?\b', 1), '') AS INT) AS built
FROM properties""")(lambda v: v.properties.select("id", values.parse_year(F.col("year_built")).alias("built")))
query("area_to_sqm", """
SELECT id, CASE WHEN building_area LIKE '%sq ft' THEN building_area || ' (Approx. '
    || format('{:,}', CAST(round_even(CAST(split_part(building_area, ' ', 1) AS DOUBLE) * 0.09290304, 0) AS BIGINT)) || '㎡)'
  WHEN building_area LIKE '%acre%' THEN building_area || ' (Approx. 6,070㎡)' ELSE building_area END AS area
FROM properties""")(lambda v: v.properties.select("id", values.area_with_metric(F.col("building_area")).alias("area")))

# Places.
_COUNTRIES = ", ".join(f"('{n}', '{c}')" for n, c in config.COUNTRY_ALPHA2.items())
query("country_code", f"""
SELECT p.id, c.code, CASE WHEN c.code IS NULL THEN '' ELSE chr(127397 + ascii(c.code[1])) || chr(127397 + ascii(c.code[2]))
  END AS flag FROM properties p LEFT JOIN (VALUES {_COUNTRIES}) c(name, code) ON c.name = lower(p.location_country)""")(
    lambda v: v.properties.select("id", places.country_code(F.concat(F.lit(" "), "location_country", F.lit("."))).alias("code"),
                                  places.flag(F.col("location_country")).alias("flag")))
query("place_label", """
SELECT id, concat_ws(', ', location_city, location_region, CASE location_country WHEN 'United States' THEN 'USA'
  WHEN 'United Kingdom' THEN 'UK' ELSE location_country END) AS place FROM properties""")(
    lambda v: v.properties.select("id", places.place_label(F.col("location_city"), F.col("location_region"),
                                                           F.col("location_country")).alias("place")))
query("display_title", """
SELECT id, coalesce(display_name, string_split(title, ' - MLS')[1]) AS heading, CASE WHEN street_address IS NOT NULL THEN
  concat_ws(', ', street_address, location_city, location_region, location_country) WHEN title LIKE '%Java%'
  THEN string_split(title, ' - MLS')[1] ELSE '' END AS address FROM properties""")(
    lambda v: v.properties.select(
        "id", places.display_title(F.col("display_name"), F.col("title")).alias("heading"),
        places.search_address(F.col("street_address"), F.col("location_city"), F.col("location_region"),
                              F.col("location_country"), F.col("title")).alias("address")))
_US_TEXT = """(100 + o_orderkey % 900) || ' Kilpatrick Avenue #2NE, Oak ' || chr(CAST(65 + o_custkey % 26 AS INT)) || 'awn IL 60'
  || (100 + o_custkey % 900) || ' call us at 1 Office Road, New York, NY 10001'"""
_US_SPARK = ("concat(100 + o_orderkey % 900, ' Kilpatrick Avenue #2NE, Oak ', chr(65 + o_custkey % 26), 'awn IL 60', "
             "100 + o_custkey % 900, ' call us at 1 Office Road, New York, NY 10001')")
query("us_address", f"""
SELECT o_orderkey AS id, (100 + o_orderkey % 900) || ' Kilpatrick Avenue #2NE, Oak ' || chr(CAST(65 + o_custkey % 26 AS INT))
  || 'awn, IL 60' || (100 + o_custkey % 900) AS first_address, 'New York' AS last_city FROM orders""")(
    lambda v: v.table("orders").select("o_orderkey", places.us_addresses(F.expr(_US_SPARK)).alias("a")).select(
        F.col("o_orderkey").alias("id"), F.col("a")[0]["address"].alias("first_address"),
        F.element_at("a", -1)["city"].alias("last_city")))
query("pick_address", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Lake Town' WHEN 1 THEN 'New York' WHEN 2 THEN NULL ELSE 'Reno' END AS city
FROM orders""")(
    lambda v: v.table("orders").selectExpr(
        "o_orderkey AS id",
        "IF(o_orderkey % 4 = 0, '5 High Road, Lake Town, CA 94000', 'A house') AS title",
        "concat('https://x.example.com/', IF(o_orderkey % 4 = 1, '9-park-new-york-', 'p-'), o_orderkey) AS url",
        "concat('12 Main Street, Reno, NV 89501', IF(o_orderkey % 4 < 3, ' or 1 Office Road, New York, NY 10001', '')) AS body")
    .select("id", places.pick_address(F.col("url"), F.col("title"), F.col("body"))["city"].alias("city")))
query("pick_tw_address", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '台北市中山區' WHEN 1 THEN '新北市板橋區' WHEN 2 THEN NULL
  ELSE '台中市西區' END AS address FROM orders""")(
    lambda v: v.table("orders").selectExpr(
        "o_orderkey AS id", "IF(o_orderkey % 4 = 0, '臺北市中山區 靜巷', '雅寓') AS title",
        "CASE o_orderkey % 4 WHEN 1 THEN '公司在 高雄市左營區 很久。地址： 新北市板橋區大明街' "
        "WHEN 2 THEN '公司在 高雄市左營區 或者 臺南市東區' ELSE '位於 臺中市西區 的房子' END AS body")
    .select("id", places.pick_tw_address(F.col("title"), F.col("body"))["address"].alias("address")))
_RULES = [("mid-century", ["#MidCentury", "#Mcm"]), ("art deco", ["#ArtDeco"]), ("loft", ["#Loft"]),
          ("penthouse", ["#Penthouse"]), ("warehouse", ["#Warehouse", "#Loft"]), ("brutalis", ["#Brutalism"])]
query("hashtags", """
WITH h AS (SELECT id, lower(concat_ws(' ', style_name, genre, structure, usage_type, title)) AS t FROM properties)
SELECT id, concat_ws(' ', '#Home', CASE WHEN t LIKE '%mid-century%' THEN '#MidCentury #Mcm' END,
  CASE WHEN t LIKE '%art deco%' THEN '#ArtDeco' END, CASE WHEN t LIKE '%loft%' THEN '#Loft' END,
  CASE WHEN t LIKE '%penthouse%' THEN '#Penthouse' END, CASE WHEN t LIKE '%warehouse%' THEN CASE WHEN t LIKE '%loft%'
  THEN '#Warehouse' ELSE '#Warehouse #Loft' END END, CASE WHEN t LIKE '%brutalis%' THEN '#Brutalism' END, '#Architecture')
  AS tags FROM h""")(
    lambda v: v.properties.select("id", F.array_join(hashtags(
        ["style_name", "genre", "structure", "usage_type", "title"], ["#Home"], _RULES, ["#Architecture", "#Home"]), " ")
        .alias("tags")))

# Listing pages.
query("listing_status", """
SELECT page_id, CASE WHEN page_id % 20 IN (7, 13) THEN 'off_market' ELSE CASE page_id % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'sold'
  WHEN 2 THEN 'sold' WHEN 3 THEN 'off_market' ELSE 'unknown' END END AS status,
  CASE WHEN page_id % 20 = 7 THEN 'gone: 404' WHEN page_id % 20 = 13 THEN 'gone: 410' ELSE CASE page_id % 6
  WHEN 0 THEN 'label: Listing status: Active' WHEN 1 THEN 'text: just sold'
  WHEN 2 THEN 'data: "availability":"https://schema.org/SoldOut"' WHEN 3 THEN 'text: This listing was removed' ELSE '' END END
  AS evidence FROM pages""")(
    lambda v: v.listing_pages.select("page_id", listing_status(
        F.col("html"), F.expr("CASE page_id % 20 WHEN 7 THEN 404 WHEN 13 THEN 410 ELSE 200 END")).alias("s")).select(
        "page_id", F.col("s.value").alias("status"), F.col("s.evidence").alias("evidence")))
query("mls_number", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'AB' || (1000000 + page_id) END AS mls FROM pages""")(
    lambda v: v.listing_pages.select("page_id", mls_number(F.col("html")).alias("mls")))
query("first_price", """
SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN '$' || format('{:,}', 250000 + page_id * 1000) END AS price FROM pages""")(
    lambda v: v.listing_pages.select("page_id", first_price_of(F.col("html")).alias("price")))


def first_price_of(text):
    from curalens.operators.collecting import first_price
    return first_price(text, [r"NT\$[\d,]+", r"\$[\d,]{5,}"])


# Signals. The check finds keyword positions one by one and compares intervals.
_KW = ", ".join(f"'{k}'" for k in config.SALE_KEYWORDS)
_PATTERNS = ", ".join("'(?i)" + p + "'" for p in config.PRICE_PATTERNS)
_DOMAINS = ", ".join(f"'{d}'" for d in config.LISTING_DOMAINS)
_DETECT = rf"""
t AS (SELECT e.id, e.source, e.text, lower(e.text) AS low, l.links FROM entries e JOIN article_links l ON l.id = e.id),
kp AS (SELECT id, k, k_no, string_split(low, k) AS parts FROM t, (SELECT unnest([{_KW}]) AS k, generate_subscripts([{_KW}], 1)
  AS k_no) kk WHERE contains(low, k)),
ks AS (SELECT id, k, k_no, list_transform(range(1, len(parts)), lambda i: CAST(list_sum(list_transform(parts[1:i],
  lambda p: length(p))) + (i - 1) * length(k) AS BIGINT)) AS starts FROM kp),
k1 AS (SELECT id, k, k_no, unnest(starts) AS s FROM ks),
pp AS (SELECT id, p_no, regexp_extract_all(text, pat) AS hits, regexp_split_to_array(text, pat) AS gaps FROM t,
  (SELECT unnest([{_PATTERNS}]) AS pat, generate_subscripts([{_PATTERNS}], 1) AS p_no) pt),
ps AS (SELECT id, p_no, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'i': i, 'h': hits[i], 's': CAST(
  list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)
  AS BIGINT)}})) AS m FROM pp),
pn AS (SELECT id, p_no, m.i AS i, trim(m.h) AS found, EXISTS (SELECT 1 FROM k1 WHERE k1.id = ps.id
  AND m.s - 200 <= k1.s + length(k1.k) AND k1.s <= m.s + length(m.h) + 200) AS near FROM ps),
pf AS (SELECT id, near, found, min(p_no * 100000 + i) AS o FROM pn GROUP BY 1, 2, 3),
pa AS (SELECT id, string_agg(found, '|' ORDER BY o) FILTER (near) AS prices, string_agg(found, '|' ORDER BY o)
  FILTER (NOT near) AS ignored FROM pf GROUP BY 1),
kk AS (SELECT id, string_agg(k, '|' ORDER BY k_no) AS keywords, arg_min(k, k_no) AS k FROM kp GROUP BY 1),
ll AS (SELECT id, list_filter(links, lambda u: len(list_filter([{_DOMAINS}], lambda d:
  regexp_extract(u, '^https?://([^/]*)', 1) = d OR ends_with(regexp_extract(u, '^https?://([^/]*)', 1), '.' || d))) > 0) AS links
  FROM t),
sg AS (SELECT t.id, t.source, t.text, t.low, coalesce(kk.keywords, '') AS keywords, kk.k, coalesce(pa.prices, '') AS prices,
  coalesce(pa.ignored, '') AS ignored, ll.links, (kk.keywords IS NOT NULL)::INT + (pa.prices IS NOT NULL)::INT
  + (len(ll.links) > 0)::INT AS score FROM t LEFT JOIN kk ON kk.id = t.id LEFT JOIN pa ON pa.id = t.id
  JOIN ll ON ll.id = t.id)"""


def _found(v):
    return signals.detect_signals(v.entries.join(v.article_links, "id"))


def _bar(name, out=None):
    return F.array_join(name, "|").alias(out or name)


query("signal_detect", f"""WITH {_DETECT.strip()}
SELECT id, keywords, prices, ignored, array_to_string(links, '|') AS listing_links, score FROM sg""")(
    lambda v: _found(v).select("id", _bar("keywords"), _bar("prices"), _bar("ignored_prices", "ignored"), _bar("listing_links"),
                               "score"))
query("price_near_keyword", f"""WITH {_DETECT.strip()}
SELECT id, prices <> '' AS has_near, ignored <> '' AS has_far FROM sg""")(
    lambda v: _found(v).select("id", (F.size("prices") > 0).alias("has_near"), (F.size("ignored_prices") > 0).alias("has_far")))
query("near_miss", f"""WITH {_DETECT.strip()}
SELECT CASE WHEN keywords <> '' AND prices <> '' THEN '' WHEN keywords <> '' AND ignored <> '' THEN 'price too far'
  WHEN keywords <> '' THEN 'keyword without price' WHEN prices <> '' OR ignored <> '' THEN 'price without keyword' ELSE '' END
  AS near_miss, source, count(*) AS n FROM sg GROUP BY 1, 2""")(
    lambda v: signals.near_miss(_found(v)).groupBy("near_miss", "source").agg(F.count("*").alias("n")))
query("signal_candidates", f"""WITH {_DETECT.strip()}
SELECT sg.id, sg.score FROM sg LEFT JOIN sources s ON s.key = sg.source WHERE sg.score >= 2 OR s.assume_for_sale""")(
    lambda v: _found(v).join(v.sources.select(F.col("key").alias("source"), "assume_for_sale"), "source", "left")
    .filter(signals.is_candidate()).select("id", "score"))
_WS = r"'[ \t\n\r\f\v]+'"
query("signal_evidence", rf"""WITH {_DETECT.strip()},
x AS (SELECT *, instr(low, k) - 1 AS a FROM sg)
SELECT id, concat_ws(' / ', CASE WHEN k IS NOT NULL THEN '記載: "' || trim(regexp_replace(substr(text, greatest(a - 60, 0) + 1,
    least(a + length(k) + 60, length(text)) - greatest(a - 60, 0)), {_WS}, ' ', 'g')) || '"' END,
  CASE WHEN prices <> '' THEN '価格表記: ' || array_to_string(string_split(prices, '|')[1:3], ', ') END,
  CASE WHEN len(links) > 0 THEN '不動産サイトへのリンク: ' || array_to_string(list_transform(links[1:3],
    lambda u: regexp_extract(u, '^https?://([^/]*)', 1)), ', ') END) AS evidence FROM x""")(
    lambda v: signals.with_contexts(_found(v)).select("id", "evidence"))
query("context_window", rf"""WITH {_DETECT.strip()},
x AS (SELECT *, instr(low, k) - 1 AS a FROM sg WHERE k IS NOT NULL),
y AS (SELECT id, text, greatest(a - 70, 0) AS b, least(a + length(k) + 70, length(text)) AS e FROM x)
SELECT id, CASE WHEN b > 0 OR e < length(text) THEN '…' || trim(regexp_replace(substr(text, b + 1, e - b), {_WS}, ' ', 'g')) || '…'
  ELSE trim(regexp_replace(text, {_WS}, ' ', 'g')) END AS context FROM y""")(
    lambda v: signals.with_contexts(_found(v)).filter("keyword_context IS NOT NULL").select(
        "id", F.col("keyword_context").alias("context")))
query("pick_listing_url", """
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'https://homes.savills.com/list/' || doc_id || '/a/b'
  WHEN doc_id % 3 = 0 THEN 'https://www.zillow.com/homedetails/' || doc_id || '_zpid/'
  ELSE 'https://notcompass.com/x/' || doc_id END AS url FROM documents""")(
    lambda v: v.article_links.select("id", signals.pick_listing_url(F.col("links")).alias("url")))
