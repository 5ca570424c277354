"""From landed feeds, indexes and pages to candidates, with counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.config import SignalConfig
from curalens.functions.places import pick_address, pick_tw_address
from curalens.functions.ranks import grouped_place, histogram_median
from curalens.functions.stages import settle
from curalens.functions.patterns import wide
from curalens.functions.urls import authority, normalize_url, path_of, url_allowed
from curalens.operators.extract import extract_pages, image_urls
from curalens.operators.matching import source_by_domain
from curalens.operators.merging import first_per_key
from curalens.operators.signals import detect_signals, is_candidate, listing_links, pick_listing_url, with_contexts

EXCERPT_CHARS = 800


def first_price(text: Column, patterns: list[str]) -> Column:
    """First pattern of the list that occurs."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, wide(p), 0)), F.lit("")) for p in patterns])


def failure_class(status: Column, problem: Column) -> Column:
    """What a failed fetch means for what to do next."""
    return (F.when(status == 404, "no feed here").when(status.isin(401, 403), "refused")
            .when(status == 429, "rate limited").when(status >= 400, F.concat(F.lit("HTTP "), status))
            .when(problem == "connect", "no connection").when(problem == "timeout", "timeout")
            .when(problem.isNotNull(), problem))


def feed_fallback(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of the fetched page, or else of the feed; says which one it was."""
    fetched = pages.filter(F.trim("text") != "").select(F.col("url"), F.col("text").alias("_page"))
    return (entries.join(fetched, "url", "left")
            .withColumn("from_feed_only", F.col("_page").isNull())
            .withColumn("text", F.coalesce("_page", "text")).drop("_page"))


def with_rules(entries: DataFrame, sources: DataFrame) -> DataFrame:
    rules = sources.select(F.col("key").alias("source"), F.col("rank").alias("source_rank"), F.col("name").alias("source_name"),
                           F.col("kind").alias("source_kind"), "assume_for_sale", "url_include", "url_exclude")
    return entries.join(rules, "source", "left").withColumn("assume_for_sale", F.coalesce("assume_for_sale", F.lit(False)))


def entry_filter(entries: DataFrame, sources: DataFrame, known: DataFrame, cutoff: str) -> DataFrame:
    """Fate of every feed entry: the first rule it fails, or ``kept``.

    Rules in order: link present, URL rules, age, known, text. ``known`` has the
    stored URLs; each entry meets at most one of them.
    """
    rows = with_rules(entries, sources).withColumn("url", normalize_url(F.col("link")))
    stored = known.select(F.col("source_url").alias("url")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(stored, "url", "left")
    allowed = url_allowed(F.col("url"), F.col("url_include"), F.col("url_exclude"))
    outcome = (F.when(F.coalesce(F.col("link"), F.lit("")) == "", "no link").when(~allowed, "url rule")
               .when(F.col("published_at") < F.lit(cutoff).cast("timestamp"), "old").when(F.col("_known"), "known")
               .when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").otherwise("kept"))
    return rows.withColumn("outcome", outcome).drop("_known")


def kept_entries(entries: DataFrame, sources: DataFrame, known: DataFrame, cutoff: str) -> DataFrame:
    """Only the entries that pass every rule of ``entry_filter``.

    The cheap rules run before the join with the stored URLs, so texts that are
    out anyway are never shuffled.
    """
    rows = with_rules(entries.filter(F.coalesce(F.col("link"), F.lit("")) != ""), sources).withColumn(
        "url", normalize_url(F.col("link")))
    late = F.coalesce(F.col("published_at") < F.lit(cutoff).cast("timestamp"), F.lit(False))
    passed = rows.filter(url_allowed(F.col("url"), F.col("url_include"), F.col("url_exclude")) & ~late
                         & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return passed.join(known.select(F.col("source_url").alias("url")), "url", "left_anti")


def build_candidates(kept: DataFrame, links: DataFrame | None, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Candidate rows: enough signals or a source that lists only things on sale; one per URL.

    ``links`` may be none if the rows bring their own column ``links``, as extracted pages do. The winner of each URL is chosen over
    narrow rows; texts come back for the winners only. Ids are unique.
    """
    rows = kept if links is None else kept.join(links, "id")
    found = with_contexts(detect_signals(rows, cfg), "text").filter(is_candidate(cfg))
    # Fixed value: wording of the evidence for sources that list only things on sale.
    prefix = F.concat("source_name", F.lit(" は販売中の物件のみを掲載"))
    evidence = F.when(F.col("assume_for_sale"), F.concat_ws(" / ", prefix, F.nullif("evidence", F.lit("")))).otherwise(
        F.col("evidence"))
    rows = found.select("id", "source", "source_rank", F.col("url").alias("source_url"), "title", "position",
                        evidence.alias("for_sale_evidence"), F.col("score").alias("signal_score"),
                        pick_listing_url(F.col("listing_links")).alias("listing_url"), *[c for c in ("thumbnail",) if c in kept.columns])
    won = first_per_key(rows, ["source_url"], ["position", "id"])
    return won.join(kept.select("id", F.col("text").alias("content_text")), "id")


def collect_stats(outcomes: DataFrame, names: list[str]) -> DataFrame:
    """One row per source, one counter per outcome. The outcomes are named, so no extra pass looks for them."""
    return outcomes.groupBy("source").agg(
        F.count("*").alias("entries"), *[F.count_if(F.col("outcome") == n).alias(n.replace(" ", "_")) for n in names])


def dedupe_url(rows: DataFrame, url: str = "url") -> DataFrame:
    """First row of every normalised URL."""
    return first_per_key(rows.withColumn(url, normalize_url(F.col(url))), [url], ["position"])


def feed_plus_index(feed: DataFrame, index: DataFrame) -> DataFrame:
    """Feed entries and index links together; the feed wins where both have a URL."""
    both = feed.withColumn("from_index", F.lit(False)).unionByName(index.withColumn("from_index", F.lit(True)),
                                                                   allowMissingColumns=True)
    return first_per_key(both, ["source", "url"], ["from_index", "position"])


def index_backfill(index: DataFrame, feed: DataFrame, known: DataFrame, max_backfill: int | None = None) -> DataFrame:
    """Index links that neither the source's feed nor the store has, each once, with their rank in the source.

    ``max_backfill`` cuts per source, only after that: cutting first would show the same head of a
    long index for ever. Without it every link stays.
    """
    once = index.groupBy("source", "url").agg(F.min("position").alias("position"))
    fresh = (once.join(feed.select("source", "url"), ["source", "url"], "left_anti")
             .join(known.select(F.col("source_url").alias("url")), "url", "left_anti"))
    ranked = grouped_place(fresh, ["source"], ["position", "url"], "rn")
    return ranked if max_backfill is None else ranked.filter(F.col("rn") <= max_backfill)


def take_backfill(fresh: DataFrame, budgets: DataFrame, max_items: int | None = None) -> DataFrame:
    """What a run does with each index link: ``inserted``, ``passed over`` or ``over budget``.

    ``fresh`` has source, url, position and ``inserts``, whether the page would give a candidate. ``budgets`` has, per
    source, ``max_backfill`` (null: no limit) and ``used``, what the feed inserted in this run, which counts against
    ``max_items`` a source. Links are opened in order until as many are inserted as the smaller
    of the two leaves; pages that give no candidate use up nothing. A source without a budget row has both limits whole.
    """
    own = budgets.select("source", F.col("max_backfill").alias("_own"), F.coalesce("used", F.lit(0)).alias("_used"))
    rows = fresh.join(own, "source", "left")
    left = F.lit(None).cast("long") if max_items is None else F.greatest(F.lit(max_items) - F.coalesce("_used", F.lit(0)), F.lit(0)).cast("long")
    rows = rows.withColumn("budget", F.least(F.col("_own").cast("long"), left)).drop("_own", "_used")
    rows = grouped_place(rows, ["source"], ["position", "url"], "rn", F.col("inserts"), "inserted_before")
    over = F.coalesce(F.col("inserted_before") >= F.col("budget"), F.lit(False))
    return rows.withColumn("outcome", F.when(over, "over budget").when(F.col("inserts"), "inserted").otherwise("passed over"))


def index_links(pages: DataFrame, sources: DataFrame, links: Column) -> DataFrame:
    """Allowed links of index pages, normalised, each once per source, first place kept."""
    page_url = normalize_url(F.col("url"))
    rows = with_rules(pages, sources).select("source", "page_id", page_url.alias("_page"), "url_include", "url_exclude",
                                             F.posexplode(links).alias("at", "link"))
    rows = rows.withColumn("url", normalize_url(F.col("link"))).filter(
        (F.col("url") != F.col("_page")) & url_allowed(F.col("url"), F.col("url_include"), F.col("url_exclude")))
    return first_per_key(rows.select("source", "url", F.struct("page_id", "at").alias("position")), ["source", "url"],
                         ["position"])


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """Every ``<loc>`` of a landed sitemap text, in order."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return sitemaps.select("source", F.col("url").alias("parent"), F.posexplode(locs).alias("at", "loc"))


def sitemap_walk(roots: DataFrame, sitemaps: DataFrame, detail: str, depth: int = 2) -> DataFrame:
    """Detail URLs below the root sitemaps, from the first level of each source that has any.

    ``depth`` is a setting, so the loop is a fixed number of joins.
    """
    locs = sitemap_locs(sitemaps).withColumn("is_detail", F.col("loc").rlike(detail))
    frontier = roots.select("source", F.col("url").alias("parent")).distinct()
    levels = None
    for level in range(max(depth, 1)):
        here = frontier.join(locs, ["source", "parent"]).withColumn("level", F.lit(level))
        levels = here if levels is None else levels.unionByName(here)
        frontier = here.filter(~F.col("is_detail") & F.contains("loc", F.lit(".xml"))).select(
            "source", F.col("loc").alias("parent")).distinct()
    details = levels.filter("is_detail")
    stop = details.groupBy("source").agg(F.min("level").alias("level"))
    return details.join(stop, ["source", "level"]).select("source", "level", "loc").distinct()


def manual_entries(rows: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """Hand-entered listings as candidates; the source follows from the URL."""
    named = source_by_domain(rows.withColumn("url", normalize_url(F.col("url"))), sources)
    # Fixed value: wording of the evidence of hand-entered rows.
    evidence = F.concat_ws(" / ", F.lit("手動入力（人がページを確認して登録）"),
                           F.when(F.coalesce(F.col("price"), F.lit("")) != "", F.concat(F.lit("価格: "), "price")),
                           F.nullif("note", F.lit("")))
    picked = first_per_key(named.withColumn("for_sale_evidence", evidence), ["url"], ["id"])
    return (picked.join(known.select(F.col("source_url").alias("url")), "url", "left_anti")
            .withColumn("is_for_sale", F.lit(True)))


def sources_union(editorial: DataFrame, listing: DataFrame) -> DataFrame:
    """All sources that may be collected: editorial ones and listing sites that may be crawled."""
    return editorial.unionByName(listing.filter(F.col("mode") == "crawl"), allowMissingColumns=True)


# --- pace of a feed ---------------------------------------------------------

def feed_pace(entries: DataFrame, now: str, lookback_days: int = 30) -> DataFrame:
    """Per source: window of the feed in days, entries a day, age of the newest, candidates a week."""
    day = 86400.0
    got = entries.groupBy("source").agg(
        F.count("*").alias("entries"), F.count("published_at").alias("dated"), F.min("published_at").alias("oldest"),
        F.max("published_at").alias("newest"), F.count_if("is_candidate").alias("candidates"))
    span = (F.unix_timestamp("newest") - F.unix_timestamp("oldest")) / day
    got = got.withColumn("window_days", F.when((F.col("dated") >= 2) & (span > 0), span))
    got = got.withColumn("per_day", (F.col("dated") - 1) / F.col("window_days"))
    got = got.withColumn("newest_age", (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("newest")) / day)
    got = got.withColumn("stale", F.coalesce(F.col("newest_age") > lookback_days, F.lit(False)))
    return got.withColumn("per_week", F.when(F.col("stale"), F.lit(0.0)).otherwise(
        F.col("per_day") * (F.col("candidates") / F.col("entries")) * 7))


def excerpt_only(entries: DataFrame) -> DataFrame:
    """Whether a feed gives excerpts only: upper median of the text length below the limit.

    Lengths are counted per source first, so a source with very many entries
    becomes a short histogram before anything is ordered.
    """
    hist = entries.groupBy("source", F.length("text").alias("chars")).agg(F.count("*").alias("n"))
    return histogram_median(hist, ["source"], "chars", "n", upper=True).select(
        "source", F.col("median").alias("upper_median"), (F.col("median") < EXCERPT_CHARS).alias("excerpt_only"))


def feed_survey(entries: DataFrame, failures: DataFrame, now: str, lookback_days: int = 30) -> DataFrame:
    """One row per feed: readable or why not, how much it brings, and whether that number holds."""
    why = failures.groupBy("source").agg(F.min_by("reason", "seq").alias("reason"))
    both = feed_pace(entries, now, lookback_days).join(excerpt_only(entries), "source", "left").join(why, "source", "full_outer")
    reliable = F.col("stale") | ~(F.coalesce("excerpt_only", F.lit(False)) & (F.col("candidates") == 0))
    return both.select("source", F.col("entries").isNotNull().alias("readable"),
                       F.when(F.col("entries").isNull(), F.col("reason")).alias("reason"), "entries", "upper_median", "per_day",
                       "per_week", "stale", reliable.alias("reliable"))


def running_failures(log: DataFrame, limit: int = 3, width: int = 4096) -> DataFrame:
    """Fetches of each source up to the point where ``limit`` failures in a row stop it.

    A long log is cut into pieces of ``width`` sequence numbers. Inside a piece
    failures are counted since the last success; across pieces only the run at
    the end of each piece is carried on. No source is ever ordered as a whole.
    """
    rows = log.withColumn("piece", F.floor(F.col("seq") / width))
    inside = Window.partitionBy("source", "piece").orderBy("seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("wins", F.count_if(~F.col("failed")).over(upto))
    run = Window.partitionBy("source", "piece", "wins").orderBy("seq")
    rows = rows.withColumn("fails", F.count_if("failed").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy("source", "piece").agg(
        F.max("wins").alias("total_wins"), F.max_by("fails", "seq").alias("open_fails"))
    # One row per piece: carry the open run over pieces without any success.
    order = Window.partitionBy("source").orderBy("piece")
    pieces = pieces.withColumn("island", F.sum((F.col("total_wins") > 0).cast("int")).over(order))
    before = Window.partitionBy("source", "island").orderBy("piece")
    pieces = pieces.withColumn("chain", F.sum("open_fails").over(before)).withColumn(
        "carried", F.coalesce(F.lag("chain").over(order), F.lit(0)))
    joined = rows.join(pieces.select("source", "piece", "carried"), ["source", "piece"])
    joined = joined.withColumn("in_row", F.when(F.col("failed"), F.col("fails") + F.when(F.col("wins") == 0, F.col("carried"))
                                                .otherwise(0)).otherwise(0))
    stop = joined.filter(F.col("in_row") >= limit).groupBy("source").agg(F.min("seq").alias("stop_seq"))
    return joined.join(stop, "source", "left").withColumn(
        "fetched", F.col("stop_seq").isNull() | (F.col("seq") <= F.col("stop_seq"))).drop("piece", "wins", "fails", "carried")


# --- listing sites ----------------------------------------------------------

def listing_fates(pages: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """Every allowed listing page with its normalised address and its fate before it is opened: duplicate, known or none."""
    keyed = with_rules(pages.drop("html"), sources).withColumn("url", normalize_url(F.col("url"))).filter(
        url_allowed(F.col("url"), F.col("url_include"), F.col("url_exclude"))).select("page_id", "source", "source_name", "source_rank", "url")
    first = keyed.groupBy("source", "url").agg(F.min("page_id").alias("_first"))
    seen = known.select(F.col("source_url").alias("url")).distinct().withColumn("_known", F.lit(True))
    return keyed.join(first, ["source", "url"]).join(seen, "url", "left").withColumn(
        "_fate", F.when(F.col("page_id") != F.col("_first"), "duplicate").when(F.col("_known"), "known")).drop("_first", "_known")


def _read_listings(fresh: DataFrame, pages: DataFrame, keep: list[str]) -> DataFrame:
    """Chosen pages with their texts and the first photo of each."""
    read = extract_pages(fresh.select(*keep).join(pages.select("page_id", "html"), "page_id"), keep)
    return read.withColumn("thumbnail", F.get(image_urls(F.col("image_refs"), F.col("url"), 2), F.lit(0)))


def _real_photo(rows: DataFrame, flat: DataFrame | None) -> tuple[DataFrame, Column]:
    """Whether there is a photo that isn't known to be a flat colour."""
    real = F.col("thumbnail").isNotNull()
    if flat is None:
        return rows, real
    marked = rows.join(flat.select(F.col("url").alias("thumbnail"), F.lit(True).alias("_flat")), "thumbnail", "left")
    return marked, real & F.col("_flat").isNull()


def listing_candidates(pages: DataFrame, sources: DataFrame, known: DataFrame, price_patterns: list[str], *,
                       max_details: int | None = None, flat: DataFrame | None = None) -> DataFrame:
    """Fate of every listing page: duplicate, known, over limit, no price, no location, no photo, or candidate.

    One set of rules for all sources; ``listing_intake`` takes the rules of each. Pages are chosen by
    id, source and address; only the chosen ones fetch their HTML and are parsed.
    ``max_details`` limits the pages read per source; what lies beyond is reported, not dropped.
    """
    settings = sources.select("key").withColumns({
        "location_from": F.lit("address"), "require_location": F.lit(True), "country": F.lit(None).cast("string"),
        "price_patterns": F.array(*[F.lit(p) for p in price_patterns]), "max_details": F.lit(max_details).cast("int")})
    return listing_intake(pages, sources, known, settings, most_details=max_details, flat=flat).select(
        "page_id", "source", "source_rank", "url", "title", "price", "location_city", "thumbnail", "outcome")


def price_by(text: Column, patterns: Column) -> Column:
    """First pattern of the row's own list that occurs; later ones aren't tried."""
    none = F.lit(None).cast("string")
    return F.aggregate(patterns, none, lambda acc, p: F.coalesce(
        acc, F.nullif(F.trim(F.call_function("regexp_extract", text, F.concat(F.lit("(?U)"), p), F.lit(0))), F.lit(""))))


def listing_intake(pages: DataFrame, sources: DataFrame, known: DataFrame, settings: DataFrame, *, most_details: int | None = None,
                   require_photo: bool = True, flat: DataFrame | None = None) -> DataFrame:
    """Fate of every listing page by the settings of its source, and the candidate row it gives.

    ``settings`` has, per source ``key``: ``location_from`` (``address``: a US address, ``tw_address``: a Taiwanese one,
    ``none``), ``require_location``, ``country``, ``price_patterns`` in order, and ``max_details`` (null: no limit). A row carries
    its rules, so all sources are judged in one pass by one expression. ``most_details`` is the largest
    of the limits, if each source has one: then the choice is cut inside map tasks.

    Outcomes: duplicate, known, over limit (none of these is opened), no price, no location (only where it is
    required), no photo, candidate. A source without settings opens nothing: ``no settings``.
    """
    rules = settings.select(F.col("key").alias("source"), "location_from", "require_location", "country", "price_patterns", "max_details",
                            F.lit(True).alias("_set"))
    fated = listing_fates(pages, sources, known).join(rules, "source", "left")
    fated = fated.withColumn("_fate", F.when(F.col("_set").isNull(), "no settings").otherwise(F.col("_fate"))).drop("_set")
    waiting = fated.filter(F.col("_fate").isNull())
    if most_details is None:
        over = grouped_place(waiting.filter("max_details IS NOT NULL").select("source", "page_id", "max_details"), ["source"], ["page_id"], "_at").filter(
            F.col("_at") > F.col("max_details")).select("page_id", F.lit(True).alias("_over"))
        opened = waiting.join(over, "page_id", "left_anti")
    else:
        order = Window.partitionBy("source").orderBy("page_id")
        opened = waiting.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most_details).filter(
            F.col("max_details").isNull() | (F.col("_at") <= F.col("max_details"))).drop("_at")
        over = waiting.select("page_id").join(opened.select("page_id"), "page_id", "left_anti").withColumn("_over", F.lit(True))
    fated = fated.join(over, "page_id", "left").withColumn("_fate", F.when(F.col("_over"), "over limit").otherwise(F.col("_fate"))).drop("_over")

    keep = ["page_id", "source", "source_name", "source_rank", "url", "location_from", "require_location", "country", "price_patterns"]
    rows = _read_listings(opened, pages, keep)
    address = (F.when(F.col("location_from") == "address", pick_address(F.col("url"), F.col("title"), F.col("whole_text")))
               .when(F.col("location_from") == "tw_address", pick_tw_address(F.col("title"), F.col("whole_text"))))
    price = F.coalesce(price_by(F.col("text"), F.col("price_patterns")), price_by(F.col("whole_text"), F.col("price_patterns")))
    rows, real = _real_photo(settle(rows.withColumns({"price": price, "address": address}), ["price", "address"]), flat)
    outcome = (F.when(F.col("price").isNull(), "no price").when(F.col("require_location") & F.col("address").isNull(), "no location")
               .when(F.lit(require_photo) & ~real, "no photo").otherwise("candidate"))
    # Fixed value: wording of the evidence that a page of a listing site is an offer.
    evidence = F.concat("source_name", F.lit(" の物件ページ"))
    judged = rows.select(
        "page_id", "source", "source_rank", "url", F.coalesce("title", F.col("address.address"), "url").alias("title"),
        F.col("text").alias("content_text"), "price", F.col("address.city").alias("location_city"), F.col("country").alias("location_country"),
        "thumbnail", evidence.alias("for_sale_evidence"), F.lit(True).alias("is_for_sale"), outcome.alias("outcome"))
    return judged.unionByName(fated.filter(F.col("_fate").isNotNull()).select(
        "page_id", "source", "source_rank", "url", F.col("_fate").alias("outcome")), allowMissingColumns=True)


LISTING_OUTCOMES = ["candidate", "known", "duplicate", "over limit", "no price", "no location", "no photo", "no settings"]


def listing_stats(seen: DataFrame, judged: DataFrame, samples: int = 10) -> DataFrame:
    """Per source: addresses seen and matched, pages fetched, one counter per outcome, and the first addresses of each miss.

    ``seen`` has the source of every address found; ``judged`` comes from ``listing_intake``. Counters and samples (by page
    id) combine inside map tasks.
    """
    totals = seen.groupBy("source").agg(F.count("*").alias("seen_urls"))
    counted = judged.groupBy("source").agg(
        F.count_if(F.col("outcome") != "duplicate").alias("matched_urls"),
        F.count_if(F.col("outcome").isin("candidate", "no price", "no location", "no photo")).alias("fetched"),
        *[F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in LISTING_OUTCOMES])
    order = Window.partitionBy("source", "outcome").orderBy("page_id")
    misses = (judged.filter(F.col("outcome").isin("no price", "no location", "no photo")).select("source", "outcome", "page_id", "url")
              .withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= samples))
    some = misses.groupBy("source").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.struct("page_id", "url")))), lambda x: x["url"]).alias(
            o.replace(" ", "_") + "_samples") for o in ("no price", "no location", "no photo")])
    empty = F.array().cast("array<string>")
    names = [f"{o}_samples" for o in ("no_price", "no_location", "no_photo")]
    return (totals.join(counted, "source", "left").join(some, "source", "left")
            .fillna(0).withColumns({n: F.coalesce(n, empty) for n in names}))


def relink(props: DataFrame, sources: DataFrame, pages: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Listing URLs for rows without one: listing sites point to themselves, articles to what they link."""
    kind = sources.select(F.col("key").alias("source"), F.col("kind").alias("source_kind"))
    empty = props.filter(F.coalesce(F.col("listing_url"), F.lit("")) == "").select("id", "source", "source_url").join(
        kind, "source", "left")
    # Links decide alone: no text is read.
    picked = settle(pages.select(F.col("url").alias("source_url"), pick_listing_url(listing_links(F.col("links"), cfg)).alias("_picked")), ["_picked"])
    got = empty.join(picked, "source_url", "left")
    own = F.coalesce(F.col("source_kind") == "listing", F.lit(False))
    return got.select("id", F.when(own, F.col("source_url")).otherwise(F.col("_picked")).alias("listing_url"),
                      F.when(own, "copied").when(F.col("_picked").isNotNull(), "found").otherwise("not found").alias("how"))


# --- robots verdicts --------------------------------------------------------

# Paths that a survey asks about.
PROBE_PATHS = ["/search", "/listing", "/property", "/properties", "/homes"]


def survey_verdict(robots: DataFrame, agent: str = "collector") -> DataFrame:
    """Per site: may the start page and the probe paths be read?

    Rule lines become rows; a rule belongs to the agents named above it, and
    the first rule of the group whose path is a prefix decides. A robots file
    that could not be read means no.
    """
    sites = robots.withColumn("domain", authority(F.col("url")))
    sites = first_per_key(sites, ["domain"], ["position"])
    lines = sites.filter(F.col("fetched") & ~F.col("missing")).select(
        "domain", "url", F.posexplode(F.split("robots_txt", r"\r?\n")).alias("line_no", "line"))
    part = F.split(F.regexp_replace("line", r"\s*#.*$", ""), ":", 2)
    lines = lines.select("domain", "url", "line_no", F.lower(F.trim(part[0])).alias("name"),
                         F.trim(F.coalesce(F.get(part, F.lit(1)), F.lit(""))).alias("value"))
    # A robots file is one small text: its lines fit one window group.
    of_site = Window.partitionBy("domain").orderBy("line_no")
    is_agent = F.col("name") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("name").over(of_site), F.lit("")) != "user-agent")
    lines = lines.withColumn("block", F.sum(starts.cast("int")).over(of_site))
    named = lines.filter(is_agent).groupBy("domain", "block").agg(
        F.max(F.contains(F.lit(agent.lower()), F.lower("value")).cast("int")).alias("own"),
        F.max((F.col("value") == "*").cast("int")).alias("any"))
    chosen = named.groupBy("domain").agg(F.coalesce(F.min(F.when(F.col("own") == 1, F.col("block"))),
                                                    F.min(F.when(F.col("any") == 1, F.col("block")))).alias("block"))
    rules = lines.filter(F.col("name").isin("allow", "disallow")).join(chosen, ["domain", "block"]).select(
        "domain", "line_no", ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"), "value")
    probes = sites.select("domain", F.explode(F.concat(
        F.array(F.coalesce(F.nullif(path_of(F.col("url")), F.lit("")), F.lit("/"))),
        F.array(*[F.lit(p) for p in PROBE_PATHS]))).alias("path"))
    first = (probes.join(rules, "domain").filter(
        (F.col("value") == "*") | F.startswith("path", F.col("value")))
             .groupBy("domain", "path").agg(F.min_by("allow", "line_no").alias("allow")))
    verdicts = probes.join(first, ["domain", "path"], "left").groupBy("domain").agg(
        F.min(F.when(~F.col("path").isin(PROBE_PATHS), F.coalesce("allow", F.lit(True)).cast("int"))).alias("top_ok"),
        F.array_sort(F.collect_set(F.when(F.col("path").isin(PROBE_PATHS) & (F.col("allow") == F.lit(False)),
                                          F.col("path")))).alias("blocked"))
    rows = sites.join(verdicts, "domain", "left")
    return rows.select(
        "domain", F.when(~F.col("fetched"), "not readable").when(F.col("missing"), "allowed")
        .when(F.col("top_ok") == 0, "refused").when(F.size("blocked") > 0, "partly").otherwise("allowed").alias("verdict"),
        F.when(F.col("fetched") & ~F.col("missing"), F.array_join("blocked", ",")).otherwise("").alias("blocked"))


