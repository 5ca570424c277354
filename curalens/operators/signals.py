"""Signs that an article is about something on sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curalens.config import SignalConfig
from curalens.functions.spans import bound, match_spans, no_spans, squeeze, window_text
from curalens.functions.stages import settle
from curalens.functions.urls import authority, on_any_domain, path_of

SNIPPET = 60
PIECE = 1024                          # characters
CONTEXT = 70
# Paths that are no listing, and paths that are reading matter.
NOT_A_LISTING = (r"(?i)/(?:agents?|team|about|contact|offices?|careers?|blog|search|privacy|terms|login|signup)(?:/|$)")
READING = r"(?i)(?:market-?report|report|news|press|guide|insights?|journal|stories|magazine|article)"


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def listing_links(links: Column, cfg: SignalConfig = SignalConfig()) -> Column:
    """Links to listing sites, each once, in order."""
    return F.array_distinct(F.filter(links, lambda u: on_any_domain(authority(u), cfg.listing_domains)))


def detect_signals(rows: DataFrame, cfg: SignalConfig = SignalConfig(), text: str = "text",
                   links: str = "links") -> DataFrame:
    """Add keywords, prices, listing links and the score. Native expressions only.

    A price counts when a keyword lies within ``window`` characters. Instead
    of comparing spans in pairs, the text around each price, widened by the
    keyword's own length, is searched for the keyword.
    """
    # Lower-casing once: the column also passes through, so it is not inlined into every comparison.
    out = rows.withColumn("_low", F.lower(F.col(text)))
    out = out.withColumn("keywords", F.filter(_texts(cfg.keywords), lambda k: F.contains("_low", F.lower(k))))
    # Most texts lack most patterns: a search that stops early saves cutting them up.
    spans = F.concat(*[F.when(F.col(text).rlike(f"(?iU){p}"), match_spans(F.col(text), f"(?iU){p}")).otherwise(no_spans())
                       for p in cfg.price_patterns])

    def near(span: Column, pieces: Column) -> Column:
        if cfg.window <= 0:
            return F.lit(True)

        def hit(keyword: Column) -> Column:
            begin = F.greatest(span["start"] - cfg.window - F.length(keyword), F.lit(0))
            end = span["stop"] + cfg.window + F.length(keyword)
            first = F.floor(begin / PIECE).cast("int")
            around = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.contains(F.substring(around, begin - first * PIECE + 1, end - begin), F.lower(keyword))

        return F.exists("keywords", hit)

    # The text is cut into pieces once, so that a price looks at the few around it and not at the text from its beginning.
    pieces = F.regexp_extract_all("_low", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    marked = bound(spans, lambda every: F.when(F.size(every) > 0, bound(pieces, lambda cut: F.transform(every, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), F.trim(s["found"]).alias("found"), near(s, cut).alias("near"))))))
    out = out.withColumn("_spans", F.coalesce(marked, F.array().cast("array<struct<start:int,stop:int,found:string,near:boolean>>")))

    def found(is_near: bool) -> Column:
        kept = F.filter("_spans", lambda s: (s["found"] != "") & (s["near"] if is_near else ~s["near"]))
        return F.array_distinct(F.transform(kept, lambda s: s["found"]))

    out = out.withColumn("prices", found(True)).withColumn("ignored_prices", found(False))
    out = out.withColumn("listing_links", listing_links(F.col(links), cfg))

    def point(column: str, points: int) -> Column:
        return F.when(F.size(column) > 0, points).otherwise(0)

    out = out.withColumn("score", point("keywords", cfg.keyword_score) + point("prices", cfg.price_score)
                         + point("listing_links", cfg.link_score))
    return settle(out, ["_low", "keywords", "_spans", "prices", "ignored_prices", "listing_links", "score"])


def with_contexts(found: DataFrame, text: str = "text") -> DataFrame:
    """Readable surroundings of the first keyword and the first price, and the evidence line."""
    keyword = F.get("keywords", F.lit(0))
    # The part before the first occurrence gives its place; the column is used often, so it is kept as one.
    staged = found.withColumns({
        "_kw": keyword, "_at": F.length(F.call_function("substring_index", F.col("_low"), F.lower(keyword), F.lit(1))), "_len": F.length(text),
        "_price": F.get(F.filter("_spans", lambda s: s["found"] != ""), F.lit(0))})
    body, keyword, at, price = F.col(text), F.col("_kw"), F.col("_at"), F.col("_price")
    begin = F.greatest(at - SNIPPET, F.lit(0))
    end = F.least(at + F.length(keyword) + SNIPPET, F.col("_len"))
    snippet = squeeze(F.substring(body, begin + 1, end - begin))
    hosts = F.array_distinct(F.transform(F.slice("listing_links", 1, 3), lambda u: F.regexp_extract(
        u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    # Labels of the evidence line.
    said = F.when(keyword.isNotNull(), F.concat(F.lit('記載: "'), snippet, F.lit('"')))
    priced = F.when(F.size("prices") > 0, F.concat(F.lit("価格表記: "), F.array_join(F.slice("prices", 1, 3), ", ")))
    linked = F.when(F.size("listing_links") > 0, F.concat(F.lit("不動産サイトへのリンク: "), F.array_join(hosts, ", ")))
    return staged.withColumns({
        "keyword_context": F.when(keyword.isNotNull(), window_text(body, at, at + F.length(keyword), CONTEXT, F.col("_len"))),
        "price_context": F.when(price.isNotNull(), window_text(body, price["start"], price["stop"], CONTEXT, F.col("_len"))),
        "evidence": F.concat_ws(" / ", said, priced, linked)}).drop("_kw", "_at", "_len", "_price")


def near_miss(found: DataFrame) -> DataFrame:
    """What was missing when an entry fell short."""
    kw, priced, far = F.size("keywords") > 0, F.size("prices") > 0, F.size("ignored_prices") > 0
    return found.withColumn("near_miss", F.when(kw & priced, "").when(kw & far, "price too far")
                            .when(kw, "keyword without price").when(priced | far, "price without keyword").otherwise(""))


def is_candidate(cfg: SignalConfig = SignalConfig()) -> Column:
    return (F.col("score") >= cfg.min_score) | F.coalesce(F.col("assume_for_sale"), F.lit(False))


def pick_listing_url(links: Column) -> Column:
    """The link that is a listing: with digits first, then the deepest, then the first."""
    def depth(path: Column) -> Column:
        return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))

    usable = F.filter(links, lambda u: ~path_of(u).isin("", "/") & ~path_of(u).rlike(NOT_A_LISTING)
                      & ~path_of(u).rlike(READING))
    ranked = F.transform(usable, lambda u, i: F.struct(
        path_of(u).rlike(r"\d").alias("digit"), depth(path_of(u)).alias("depth"), (-i).alias("order"), u.alias("url")))
    return F.array_max(ranked)["url"]
