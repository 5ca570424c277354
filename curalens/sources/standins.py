"""Domain tables derived from the supplied tables.

Each view is a plain projection (at most one join) over a supplied table, so
column pruning and filters reach the Parquet scan and the work of every query
grows with the input. ``o_orderkey`` is the listing id, ``event_id`` the post
id, a ``lineitem`` row is an image, a ``documents`` row a feed entry.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalens import config
from curalens.schemas import SOURCES, struct
from curalens.sources.local import config_frame
from curalens.sources.tables import read_table

_STATUS = ("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN IF(o_orderkey % 3 = 0, 'delivered', 'approved') "
           "ELSE IF(o_orderkey % 2 = 0, 'rejected', 'approved') END")
_AMOUNT = "CAST(o_totalprice AS BIGINT)"
_YEAR = "(1800 + (o_custkey * 7 + o_orderkey) % 220)"
_SCORE = (f"CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN NULL "
          "ELSE floor(o_totalprice / 500) / CAST(10 AS DOUBLE) END")
_STYLE_FLAG = "CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_custkey % 3 = 0 END"
_UNIQUE_FLAG = "CASE WHEN o_orderkey % 10 = 8 THEN NULL ELSE o_orderkey % 4 = 1 END"
_TRIES = "CAST(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 5 ELSE 0 END AS INT)"
_GATE = (f"CASE WHEN o_orderkey % 12 = 0 THEN concat('story=', o_orderkey % 40, ' < 40') "
         f"WHEN o_orderkey % 12 = 6 THEN concat('築年 ', {_YEAR}, ' ≧ 2000') ELSE '' END")
_RANK = ("CASE WHEN o_custkey % 20 < 4 THEN 'S' WHEN o_custkey % 20 < 10 THEN 'A' "
         "WHEN o_custkey % 20 < 17 THEN 'B' END")
# Raw axis values by key.
AXIS_RAW = {
    "story": "(o_orderkey * 7) % 101",
    "style": "IF(o_custkey % 3 = 0, 100, 0)",
    "one_of_a_kind": "IF(o_orderkey % 4 = 1, 100, 0)",
    "source": "CASE WHEN o_custkey % 20 < 4 THEN 100 WHEN o_custkey % 20 < 10 THEN 70 "
              "WHEN o_custkey % 20 < 17 THEN 40 ELSE 0 END",
    "for_sale": "(o_orderkey % 3) * 50",
    "genre": "20 + (o_custkey % 5) * 20",
    "area": "20 + (o_custkey % 3) * 40",
    "price": "IF(o_totalprice > 200000, 100, 0)",
}


def _detail() -> str:
    axes = ", ',', ".join(
        f"'{{\"key\":\"{k}\",\"raw\":', {raw}, ',\"weight\":{config.AXIS_WEIGHTS[k]},\"reason\":\"', "
        + ("IF(o_orderkey % 5 = 0, '', concat('told by ', o_custkey))" if k == "story" else f"'{k}'") + ", '\"}'"
        for k, raw in AXIS_RAW.items())
    flags = ("'\"provenance_visible\":', IF(o_totalprice < 100000, 'true', 'false'), ',\"style_identified\":', "
             "IF(o_custkey % 3 = 0, 'true', 'false'), ',\"one_of_a_kind\":', "
             "IF(o_orderkey % 4 = 1, 'true', 'false')")
    return (f"CASE WHEN ({_SCORE}) IS NULL THEN NULL WHEN o_orderkey % 13 = 0 THEN '{{broken' "
            f"ELSE concat('{{\"gate\":\"', {_GATE}, '\",\"axes\":[', {axes}, '],\"flags\":{{', {flags}, "
            f"'}},\"provenance_note\":\"\"}}') END")


_PROPERTY_COLUMNS = [
    "o_orderkey AS id",
    "CASE WHEN o_custkey % 3 = 0 THEN 'src0' ELSE concat('src', o_custkey % 20) END AS source",
    f"{_RANK} AS source_rank",
    "concat('https://www.src', o_custkey % 20, '.example.com/listing/', o_orderkey) AS source_url",
    "CASE o_orderkey % 3 WHEN 1 THEN concat('https://www.zillow.com/homedetails/', o_orderkey) "
    "WHEN 2 THEN concat('https://homes.example.net/p/', o_orderkey) END AS listing_url",
    "CASE WHEN o_orderkey % 4 = 0 THEN concat(100 + o_orderkey % 900, ' Java Drive, City', o_custkey % 25, "
    "', FL 33435 - MLS# A', 10000000 + o_orderkey) ELSE concat('Customer House ', o_custkey) END AS title",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN "
    "concat('A very long headline that is not really a name ', o_orderkey) "
    "ELSE concat('Maison ', o_custkey) END AS display_name",
    "CASE WHEN o_orderkey % 8 <> 0 THEN concat('body ', o_orderkey) END AS caption_body",
    "repeat(o_orderpriority, CAST(1 + o_orderkey % 40 AS INT)) AS content_text",
    f"CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CASE o_orderkey % 6 "
    f"WHEN 0 THEN concat('$', format_number({_AMOUNT}, 0)) WHEN 1 THEN concat('€', {_AMOUNT}) "
    f"WHEN 2 THEN concat('£', {_AMOUNT} div 100000, '.', ({_AMOUNT} div 10000) % 10, 'm') "
    f"WHEN 3 THEN concat('NT$', format_number({_AMOUNT} * 30, 0)) "
    f"WHEN 4 THEN concat(format_number({_AMOUNT} div 100, 0), ' 萬') ELSE 'Price on request' END END AS price",
    f"CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN {_AMOUNT} WHEN 1 THEN "
    f"{_AMOUNT} WHEN 2 THEN ({_AMOUNT} div 10000) * 100000 WHEN 3 THEN {_AMOUNT} * 30 "
    f"WHEN 4 THEN ({_AMOUNT} div 100) * 10000 END END AS DOUBLE) AS price_value",
    "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE element_at(array('USD', 'EUR', 'GBP', 'TWD', 'TWD', 'XXX'), "
    "CAST(o_orderkey % 6 + 1 AS INT)) END AS price_currency",
    "CASE WHEN o_orderkey % 9 <> 0 THEN concat('City', o_custkey % 25) END AS location_city",
    "concat('Region', o_custkey % 5) AS location_region",
    "CASE WHEN o_orderkey % 31 <> 0 THEN element_at(array('United States', 'United States', 'Portugal', 'Spain', "
    "'Taiwan', 'Japan', 'United Kingdom', 'France'), CAST(o_custkey % 8 + 1 AS INT)) END AS location_country",
    "CASE WHEN o_orderkey % 4 <> 2 THEN concat(100 + o_orderkey % 900, ' Corondale ', "
    "element_at(array('Avenue', 'Street', 'Lane'), CAST(o_custkey % 3 + 1 AS INT))) END AS street_address",
    "o_orderstatus <> 'F' AS is_for_sale",
    "CASE WHEN o_orderkey % 11 <> 0 THEN element_at(array('architect', 'loft', 'hidden_gem', 'adaptive_reuse', "
    "'penthouse'), CAST(o_custkey % 5 + 1 AS INT)) END AS genre",
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('Architect ', o_custkey % 50) END AS architect",
    f"CASE o_orderkey % 5 WHEN 0 THEN concat('built in ', {_YEAR}) WHEN 1 THEN concat('c. ', {_YEAR}, 's') "
    f"WHEN 2 THEN concat({_YEAR}, '–', {_YEAR} + 10) WHEN 4 THEN 'Unit 4501' END AS year_built",
    f"CAST(CASE WHEN o_orderkey % 5 < 3 THEN {_YEAR} END AS INT) AS year_built_value",
    "CASE WHEN o_custkey % 3 = 0 THEN element_at(array('Art Deco', 'Victorian', 'Brutalist', 'Mid-Century'), "
    "CAST(o_custkey % 4 + 1 AS INT)) END AS style_name",
    "CASE WHEN o_custkey % 7 = 0 THEN 'warehouse' END AS usage_type",
    "CAST(NULL AS STRING) AS structure",
    f"CASE o_orderkey % 4 WHEN 0 THEN concat({_AMOUNT} % 5000 + 100, ' sq ft') WHEN 1 THEN '1.5 acres' "
    "WHEN 2 THEN '120 sqm' END AS building_area",
    f"{_SCORE} AS score",
    f"{_detail()} AS score_detail",
    f"{_STYLE_FLAG} AS style_identified",
    f"{_UNIQUE_FLAG} AS one_of_a_kind",
    "o_totalprice < 100000 AS provenance_visible",
    f"{_STATUS} AS status",
    "CAST(o_orderkey % 4 AS INT) AS signal_score",
    "CASE WHEN o_orderkey % 6 = 0 THEN 'island' END AS series",
    f"{_TRIES} AS delivery_attempts",
    f"CASE WHEN {_TRIES} > 0 THEN CASE o_orderkey % 4 WHEN 1 THEN 'no images: all were too small' "
    "WHEN 2 THEN 'page gone: 404' WHEN 3 THEN 'upload: timeout' END END AS delivery_error",
    f"CASE WHEN {_TRIES} > 0 THEN o_orderdate + make_interval(0, 0, 0, 0, CAST(o_orderkey % 48 AS INT), 0, 0) END "
    "AS delivery_attempted_at",
    "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'active' WHEN 2 THEN 'pending' WHEN 3 THEN 'sold' "
    "WHEN 4 THEN 'off_market' ELSE 'unknown' END AS listing_status",
    "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 5 DAYS END AS listing_status_at",
    "CASE WHEN o_orderkey % 4 = 0 THEN concat('A', 10000000 + o_orderkey) END AS mls_number",
    f"CASE WHEN {_STATUS} = 'rejected' THEN concat('not for us: ', o_orderpriority) END AS reject_reason",
    "CASE WHEN o_orderkey % 10 = 3 THEN concat('https://pages.example.com/', o_orderkey) END AS image_page_url",
    "CASE WHEN o_orderkey % 7 <> 0 THEN concat('seen as ', o_orderpriority) END AS listing_status_note",
    "o_orderdate AS collected_at",
    f"CASE WHEN ({_SCORE}) IS NOT NULL THEN o_orderdate + INTERVAL 1 DAY END AS scored_at",
    "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 2 DAYS END AS reviewed_at",
]

_POST_STATE = ("element_at(array('published', 'published', 'published', 'published', 'published', 'published', "
               "'planned', 'failed', 'skipped', 'publishing'), CAST(event_id % 10 + 1 AS INT))")
_POST_COLUMNS = [
    "event_id AS id",
    "CASE WHEN event_id % 17 <> 0 THEN user_id * 50 + event_id % 50 END AS property_id",
    "CASE event_type WHEN 'signup' THEN 'story' WHEN 'purchase' THEN 'reel' ELSE 'feed' END AS kind",
    f"{_POST_STATE} AS state",
    "date_trunc('HOUR', ts) AS scheduled_at",
    "CASE WHEN event_id % 10 < 6 THEN ts END AS published_at",
    "CASE WHEN event_type = 'signup' THEN event_id - 1 END AS parent_post_id",
    "CASE WHEN event_id % 10 < 6 THEN concat('m', event_id) END AS media_id",
    "CASE WHEN event_id % 10 < 6 AND event_id % 7 <> 3 THEN CAST(floor(value * 10) AS BIGINT) END AS reach",
    "CAST(event_id % 4 AS INT) AS attempts",
    "CASE WHEN event_id % 10 = 7 THEN 'upload: timeout' END AS error",
    "CASE WHEN event_id % 3 = 0 THEN concat('lead\\n【 Villa ', event_id, ' 】') ELSE concat('・\\nplain line ', "
    "event_id) END AS caption",
    "CASE WHEN event_id % 6 = 0 THEN ts END AS caption_edited_at",
    "CASE WHEN event_id % 5 = 0 THEN '3,1,9' END AS image_order",
    "CASE WHEN event_id % 4 = 1 THEN concat('remember ', event_id) END AS note",
]

_ARTICLE_TAIL = (
    "CASE doc_id % 7 WHEN 0 THEN concat(text, ' It is on the market for $', format_number(100000 + doc_id * 37, 0), '.') "
    "WHEN 1 THEN concat('The works cost €', 10 + doc_id % 90, ' million then. ', text, ' The house is now for sale.') "
    "WHEN 2 THEN concat(text, ' This home is for sale.') WHEN 3 THEN concat(text, ' It once cost £', doc_id, 'k.') "
    "WHEN 4 THEN concat(text, ' Now asking price on request, listing at $', 1 + doc_id % 9, '.5 million or ', "
    "100 + doc_id, '万円.') WHEN 5 THEN concat(text, ' Currently listed, price upon application.') ELSE text END")


class Views:
    """Lazily built domain tables over one folder of supplied tables."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name)

    @cached_property
    def properties(self) -> DataFrame:
        return self.table("orders").selectExpr(*_PROPERTY_COLUMNS)

    @cached_property
    def deliveries(self) -> DataFrame:
        return self.properties.filter("status = 'delivered'").selectExpr(
            "id AS property_id", "concat('lot', lpad(id, 9, '0')) AS folder_name",
            "CAST(id % 10 + 1 AS INT) AS image_count", "collected_at + INTERVAL 3 DAYS AS delivered_at")

    @cached_property
    def images(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS property_id",
            "concat('https://img', l_suppkey % 10, '.example.com/', l_partkey, '-', l_linenumber, '-', "
            "CAST(l_quantity AS INT), '.jpg') AS source_url",
            "CASE WHEN l_returnflag <> 'N' THEN concat('https://pages', l_suppkey % 7, '.example.org/', "
            "l_orderkey % 50) END AS origin_url",
            "CAST(400 + l_partkey % 1600 AS INT) AS width", "CAST(300 + l_suppkey * 7 % 1500 AS INT) AS height",
            "element_at(array('image/jpeg', 'image/png', 'image/webp', 'image/gif'), "
            "CAST(l_partkey % 4 + 1 AS INT)) AS mime",
            "CAST(l_suppkey % 9 AS DOUBLE) AS stddev", "l_linenumber AS position", "l_shipdate AS fetched_at")

    @cached_property
    def image_skips(self) -> DataFrame:
        return self.table("lineitem").filter("l_discount >= 0.08").selectExpr(
            "l_orderkey AS property_id",
            "concat('https://img', l_suppkey % 10, '.example.com/', l_partkey, '-', l_linenumber, '-', "
            "CAST(l_quantity AS INT), '.jpg') AS source_url",
            "element_at(array('too_small', 'wrong_type', 'failed', 'robots', 'broken'), "
            "CAST(l_linenumber % 5 + 1 AS INT)) AS reason", "l_shipdate AS created_at")

    @cached_property
    def posts(self) -> DataFrame:
        return self.table("events").selectExpr(*_POST_COLUMNS)

    @cached_property
    def reach_readings(self) -> DataFrame:
        """Five readings per post: an event is a reading of the first id of its block of five."""
        return self.table("events").selectExpr("concat('m', event_id - event_id % 5) AS media_id", "ts AS read_at",
                                               "CAST(floor(value * 10) AS BIGINT) AS reach", "event_id AS seq")

    @cached_property
    def media_checks(self) -> DataFrame:
        return self.table("events").filter("event_type <> 'signup'").selectExpr(
            "concat('m', event_id) AS media_id",
            "CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS present")

    @cached_property
    def feedback(self) -> DataFrame:
        tags = ", ".join(f"'{t}'" for t in config.FEEDBACK_TAGS)
        return self.table("orders").filter(f"{_STATUS} = 'rejected'").selectExpr(
            "o_orderkey * 10 AS id", "o_orderkey AS property_id",
            "concat('not convincing: ', o_orderpriority, ' ', o_custkey) AS reason",
            f"CASE WHEN o_custkey % 10 < 8 THEN element_at(array({tags}), CAST(o_custkey % 10 + 1 AS INT)) END "
            "AS reason_tag", "o_orderdate + INTERVAL 2 DAYS AS created_at")

    @cached_property
    def rules(self) -> DataFrame:
        """Rules on file: one per tag that already has more than one early hit."""
        return (self.feedback.filter("created_at < TIMESTAMP '1996-01-01' AND reason_tag IS NOT NULL")
                .groupBy("reason_tag").agg(F.count("*").alias("hit_count"))
                .selectExpr("reason_tag", "hit_count", "concat('avoid ', reason_tag) AS proposal",
                            "CASE WHEN reason_tag LIKE '%t%e' THEN 'dismissed' WHEN reason_tag LIKE 'n%' THEN 'approved' "
                            "ELSE 'proposed' END AS state"))

    @cached_property
    def weekly_notes(self) -> DataFrame:
        """Assistant turns as notes; the turn before each is its source text."""
        c = self.table("conversations")
        before = c.selectExpr("conv_id", "turn + 1 AS turn", "text AS source_text", "length(text) AS source_len")
        return (c.filter("role = 'assistant'").join(before, ["conv_id", "turn"])
                .selectExpr("conv_id * 1000 + turn AS id",
                            "date_add(DATE '2023-11-06', CAST(7 * (conv_id % 12) AS INT)) AS week_start",
                            "concat(text, ' ', length(text), '本 / ', turn, '〜', turn + 2, '枚') AS body",
                            "concat(source_text, ' ', source_len, ' and ', turn + 2) AS source",
                            "timestamp_seconds(1704067200 + conv_id * 60 + turn) AS created_at"))

    @cached_property
    def fx_readings(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "element_at(array('USD', 'EUR', 'GBP', 'TWD', 'JPY', 'HKD'), CAST(o_custkey % 6 + 1 AS INT)) AS currency",
            "o_totalprice / 1000 AS jpy_per", "o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o_orderkey) AS fetched_at")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "page_id", "url", "html",
            "CAST(CASE page_id % 20 WHEN 7 THEN 404 WHEN 13 THEN 410 ELSE 200 END AS INT) AS status")

    @cached_property
    def listing_pages(self) -> DataFrame:
        """Pages with a price, an address, a status and images written into the article."""
        return self.table("pages").selectExpr(
            "page_id", "concat('src', page_id % 5) AS source", "url",
            "replace(html, '</article>', concat("
            "CASE WHEN page_id % 4 <> 3 THEN concat('<p>Offered at $', format_number(250000 + page_id * 1000, 0), "
            "'</p>') ELSE '' END, "
            "CASE WHEN page_id % 5 <> 4 THEN concat('<p>', 100 + page_id, ' Highland Way, City', chr(CAST(97 + page_id % 26 "
            "AS INT)), ', CA 94937</p>') ELSE '' END, "
            "CASE page_id % 6 WHEN 0 THEN '<p>Listing status: Active</p>' WHEN 1 THEN '<p>just sold</p>' "
            "WHEN 2 THEN '<script>{\"availability\":\"https://schema.org/SoldOut\"}</script>' "
            "WHEN 3 THEN '<p>This listing was removed</p>' ELSE '' END, "
            "CASE WHEN page_id % 3 = 0 THEN concat('<p>MLS# ab', 1000000 + page_id, '</p>') ELSE '' END, "
            "CASE WHEN page_id % 7 <> 6 THEN concat('<img src=\"/photos/', page_id, '-800x600.jpg\">"
            "<img src=\"/photos/', page_id, '.jpg\"><img srcset=\"/p/', page_id, '-s.jpg 300w, /p/', page_id, "
            "'-l.jpg 1200w\"><img src=\"/assets/logo.png\">') ELSE '' END, "
            "'<a href=\"https://www.compass.com/homedetails/', page_id, '/unit\">see</a>', '</article>')) AS html")

    @cached_property
    def entries(self) -> DataFrame:
        """Feed entries with sale phrases and prices worked into the text."""
        return self.table("documents").selectExpr(
            "doc_id AS id", "IF(doc_id % 3 = 0, 'src0', source) AS source", "lang",
            "CASE WHEN doc_id % 41 = 0 THEN NULL ELSE concat('https://www.', source, '.example.com/', lang, '/', "
            "IF(doc_id % 9 = 0, 'agents/', 'homes/'), doc_id % 800, element_at(array('', '/', '#top', '?page=2'), "
            "CAST(doc_id % 4 + 1 AS INT))) END AS link",
            "substring(text, 1, 60) AS title", f"{_ARTICLE_TAIL} AS text", "n_chars",
            "CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, "
            "CAST(doc_id % 960 AS INT), 0, 0) END AS published_at", "doc_id AS position")

    @cached_property
    def article_links(self) -> DataFrame:
        """Outgoing links of each entry, in order."""
        return self.table("documents").selectExpr(
            "doc_id AS id",
            "filter(array("
            "IF(doc_id % 3 = 0, concat('https://www.zillow.com/homedetails/', doc_id, '_zpid/'), NULL), "
            "IF(doc_id % 4 = 0, 'https://www.compass.com/agents/jane', NULL), "
            "IF(doc_id % 5 = 0, concat('https://homes.savills.com/list/', doc_id, '/a/b'), NULL), "
            "IF(doc_id % 6 = 0, 'https://inhabit.corcoran.com/market-report-2026', NULL), "
            "concat('https://notcompass.com/x/', doc_id)), x -> x IS NOT NULL) AS links")

    @cached_property
    def known_entry_urls(self) -> DataFrame:
        """URLs collected before: those of the long articles."""
        return self.table("documents").filter("n_chars > 2500").selectExpr(
            "concat('https://www.', source, '.example.com/', lang, '/homes/', doc_id % 800) AS source_url")

    @cached_property
    def sources(self) -> DataFrame:
        """Source settings (configuration, one row per source)."""
        rows = [(f"src{i}", f"Source {i}", "listing" if i % 4 == 0 else "editorial", "SAB"[i % 3],
                 "manual_only" if i % 8 == 0 else "crawl", i % 5 != 0, i % 6 == 0, [r"/homes/"] if i % 2 else [],
                 [r"/agents/"], f"https://www.src{i}.example.com", i) for i in range(20)]
        return config_frame(self.spark, rows, SOURCES)

    @cached_property
    def fx_rates(self) -> DataFrame:
        """Configured rates (one row per currency)."""
        return config_frame(self.spark, list(config.FALLBACK_JPY_PER.items()), struct("currency string, jpy_per double"))

    @cached_property
    def page_hits(self) -> DataFrame:
        """Pages that may show a listing: every image origin and photo host seen for it."""
        return self.table("lineitem").selectExpr(
            "l_orderkey AS property_id",
            "concat(element_at(array('https://www.zillow.com/', 'https://blog.homes.example.net/', "
            "'https://img.example.org/', 'https://press.example.com/'), CAST(l_suppkey % 4 + 1 AS INT)), "
            "IF(l_partkey % 3 = 0, concat(100 + l_orderkey % 900, '-corondale-'), 'the-north-avenue-'), "
            "l_partkey % 40, IF(l_linenumber % 2 = 0, '#photos', '')) AS url",
            "CASE WHEN l_partkey % 5 = 0 THEN 'Maison by the sea' WHEN l_partkey % 5 = 1 THEN 'Customer House' END "
            "AS title",
            "l_partkey * 1000 + l_suppkey * 7 + l_linenumber AS position")

    @cached_property
    def fetch_log(self) -> DataFrame:
        """Article fetches in order; a run of failures stops a source."""
        return self.table("events").selectExpr(
            "concat('src', user_id % 20) AS source", "event_id AS seq", "event_type IN ('error', 'click') AS failed",
            "CASE event_type WHEN 'error' THEN element_at(array(404, 403, 429, 500), CAST(event_id % 4 + 1 AS INT)) "
            "WHEN 'click' THEN NULL ELSE 200 END AS status",
            "CASE WHEN event_type = 'click' THEN IF(event_id % 2 = 0, 'connect', 'timeout') END AS problem")

    @cached_property
    def robots(self) -> DataFrame:
        """Robots files per site: rules follow from the supplier number."""
        return self.table("supplier").selectExpr(
            "concat('site', s_suppkey % 400, '.example.com') AS domain",
            "concat('https://site', s_suppkey % 400, '.example.com/start') AS url", "s_suppkey AS position",
            "s_suppkey % 9 <> 4 AS fetched", "s_suppkey % 9 = 5 AS missing",
            "concat('User-agent: *\\nDisallow: ', CASE s_suppkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '/search' "
            "WHEN 2 THEN '' ELSE '/private' END, '\\nAllow: /\\n\\nUser-agent: OtherBot\\nDisallow: /\\n') AS robots_txt")

    @cached_property
    def post_events(self) -> DataFrame:
        """State changes of posts, in time order: about 67 per post."""
        return self.table("events").selectExpr(
            "user_id AS post_id", "ts AS at", "event_id AS seq",
            "element_at(array('claim', 'fail', 'finish', 'skip', 'retry', 'fail', 'claim'), "
            "CAST(event_id % 7 + 1 AS INT)) AS action")

    @cached_property
    def calendar(self) -> DataFrame:
        """Posts on the calendar, about three a day: one per user of the event stream."""
        users = self.table("events").groupBy("user_id").agg(F.min("ts").alias("ts"), F.count("*").alias("n"))
        return users.selectExpr(
            "user_id AS id", "user_id * 50 AS property_id",
            "CASE user_id % 5 WHEN 3 THEN 'story' WHEN 4 THEN 'reel' ELSE 'feed' END AS kind",
            "element_at(array('published', 'planned', 'planned', 'skipped', 'publishing', 'failed', 'skipped'), "
            "CAST(user_id % 7 + 1 AS INT)) AS state",
            "date_trunc('HOUR', ts) + make_interval(0, 0, 0, 0, CAST(user_id * 7 AS INT), 0, 0) AS scheduled_at", "n")

    @cached_property
    def review_events(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS property_id", "l_shipdate AS at", "l_partkey * 100 + l_linenumber AS seq",
            "CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'reset' END AS action",
            "CASE WHEN l_partkey % 5 <> 0 THEN concat('reason ', l_partkey) END AS reason")

    @cached_property
    def assessments(self) -> DataFrame:
        """Judgements that arrived from outside for listings still without a score."""
        return self.table("orders").selectExpr(
            "o_orderkey AS property_id", "CAST((o_orderkey * 13) % 131 - 15 AS INT) AS story_score",
            "concat('because ', o_custkey) AS story_reason",
            "CASE o_custkey % 7 WHEN 0 THEN 'castle' WHEN 1 THEN NULL ELSE element_at(array('architect', "
            "'adaptive_reuse', 'hidden_gem', 'penthouse', 'loft'), CAST(o_custkey % 5 + 1 AS INT)) END AS genre",
            "o_custkey % 3 = 0 AS style_identified", "o_orderkey % 4 = 1 AS one_of_a_kind",
            "o_totalprice < 100000 AS provenance_visible", "o_orderkey % 2 = 0 AS is_for_sale",
            f"CASE WHEN o_orderkey % 3 <> 0 THEN concat('built in ', {_YEAR}) ELSE '' END AS year_built",
            "IF(o_orderkey % 4 = 0, '', concat('Town', o_custkey % 30)) AS city",
            "IF(o_orderkey % 6 = 0, '', element_at(array('Spain', 'Japan', 'Taiwan'), CAST(o_custkey % 3 + 1 AS INT))) "
            "AS country", "IF(o_orderkey % 5 = 0, '', concat('$', o_orderkey)) AS price",
            "concat('summary ', repeat('x', CAST(o_orderkey % 100 AS INT))) AS summary",
            "IF(o_orderkey % 9 = 0, concat('Villa ', o_custkey), '') AS display_name",
            "'' AS architect", "CASE o_orderkey % 8 WHEN 0 THEN concat('deed of ', o_custkey) WHEN 1 THEN NULL ELSE '' END AS provenance_note")


