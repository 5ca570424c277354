"""Ranked lists, work queues, and the joins they need."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.functions.ranks import sorted_place

NAME_MAX = 40
SLOT_HOLDING = ["planned", "publishing", "published", "failed"]


def sort_keys(name: str, price: str = "price_value") -> list[Column]:
    """Sort columns by name; rows without the value come last in either direction."""
    ident = F.col("id").desc()
    known = {
        "score": [F.col("score").desc_nulls_last(), ident],
        "newest": [F.col("collected_at").desc(), ident],
        "oldest": [F.col("collected_at").asc(), F.col("id").asc()],
        "price_desc": [F.col(price).desc_nulls_last(), ident],
        "price_asc": [F.col(price).asc_nulls_last(), ident],
        "built_oldest": [F.col("year_built_value").asc_nulls_last(), ident],
    }
    return known.get(name, known["score"])


def fx_to_jpy(props: DataFrame, rates: DataFrame | None) -> DataFrame:
    """Add ``price_jpy``: NULL without a rate, the plain value without any rates."""
    if rates is None:
        return props.withColumn("price_jpy", F.col("price_value"))
    per = rates.select(F.col("currency").alias("_cur"), F.col("jpy_per").alias("_per"))
    return (props.join(per, props.price_currency == per._cur, "left")
            .withColumn("price_jpy", F.col("price_value") * F.col("_per")).drop("_cur", "_per"))


def join_delivery(props: DataFrame, deliveries: DataFrame) -> DataFrame:
    have = deliveries.select(F.col("property_id").alias("id"), "folder_name", "delivered_at")
    return props.join(have, "id", "left")


def ranked_listings(props: DataFrame, deliveries: DataFrame, rates: DataFrame | None = None, *,
                    status: str = "pending", sort: str = "score", min_score: float | None = None,
                    series: str | None = None, limit: int | None = None, offset: int = 0,
                    placed: bool = False) -> DataFrame:
    """The review list, or one page of it. Filters first, then the join, then the order.

    ``placed`` returns the whole list with each row's place instead of a page.
    """
    rows = props.filter(F.col("status") == status)
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    if series is not None:
        rows = rows.filter(F.col("series") == series)
    rows = fx_to_jpy(join_delivery(rows, deliveries), rates)
    if placed:
        # Only the id and what is sorted by are sorted; the columns a query wants are joined afterwards.
        needed = [c for c in ("id", "score", "collected_at", "price_jpy") if c in rows.columns]
        return rows.join(sorted_place(rows.select(*needed), sort_keys(sort, "price_jpy")).select("id", "place"), "id")
    rows = rows.orderBy(*sort_keys(sort, "price_jpy"))
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit is not None else rows


def known_rows(entries: DataFrame, props: DataFrame, keep_known: bool = False) -> DataFrame:
    """Entries whose URL is not stored yet (or is, with ``keep_known``)."""
    urls = props.select(F.col("source_url").alias("url"))
    return entries.join(urls, "url", "left_semi" if keep_known else "left_anti")


def without_feed_post(props: DataFrame, posts: DataFrame) -> DataFrame:
    posted = posts.filter((F.col("kind") == "feed") & F.col("property_id").isNotNull()).select(
        F.col("property_id").alias("id"))
    return props.join(posted, "id", "left_anti")


def postable(props: DataFrame, posts: DataFrame, limit: int | None, sources: list[str] | None = None) -> DataFrame:
    """Delivered, not posted, with name and text; best score first."""
    rows = props.filter((F.col("status") == "delivered") & F.col("display_name").isNotNull()
                        & F.col("caption_body").isNotNull())
    if sources:
        rows = rows.filter(F.col("source").isin(sources))
    rows = without_feed_post(rows, posts).orderBy(*sort_keys("score"))
    return rows.limit(limit) if limit is not None else rows


def posts_with_property(posts: DataFrame, props: DataFrame, how: str = "left") -> DataFrame:
    named = props.withColumnsRenamed({c: f"p_{c}" for c in props.columns if c in posts.columns and c != "id"})
    return posts.join(named.withColumnRenamed("id", "property_id"), "property_id", how)


def replan_rows(posts: DataFrame, props: DataFrame) -> DataFrame:
    open_posts = posts.filter((F.col("kind") == "feed") & F.col("state").isin("planned", "failed")
                              & F.col("caption_edited_at").isNull())
    return posts_with_property(open_posts, props, "inner").orderBy("scheduled_at", "id")


def scheduled_posts(posts: DataFrame, props: DataFrame, until: str, states: list[str] | None = None) -> DataFrame:
    rows = posts.filter(F.col("scheduled_at") <= F.lit(until).cast("timestamp"))
    if states:
        rows = rows.filter(F.col("state").isin(states))
    return posts_with_property(rows, props).orderBy("scheduled_at", "id")


def image_counts(images: DataFrame) -> DataFrame:
    """Per property: images, images from other pages, first image."""
    return images.groupBy("property_id").agg(
        F.count("*").alias("image_count"), F.count("origin_url").alias("foreign_images"),
        F.min(F.struct("position", "source_url"))["source_url"].alias("cover"))


def with_image_counts(props: DataFrame, images: DataFrame, key: str = "id") -> DataFrame:
    counts = image_counts(images).withColumnRenamed("property_id", key)
    return (props.join(counts, key, "left")
            .withColumn("image_count", F.coalesce("image_count", F.lit(0)))
            .withColumn("foreign_images", F.coalesce("foreign_images", F.lit(0))))


def under_quota(props: DataFrame, images: DataFrame, quota: int = 10, source: str | None = None) -> DataFrame:
    """Approved or delivered rows with fewer than ``quota`` images, nearest to posting first."""
    rows = props.filter(F.col("source_url").startswith("http") & F.col("status").isin("approved", "delivered"))
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    return (with_image_counts(rows, images).filter(F.col("image_count") < quota)
            .orderBy((F.col("status") == "delivered").desc(), F.col("score").desc_nulls_last(), F.col("id").desc()))


def thin_stock(props: DataFrame, images: DataFrame, at_most: int = 7) -> DataFrame:
    """Pending scored rows that have at least one and at most ``at_most`` images."""
    few = (images.groupBy("property_id").agg(F.count("*").alias("n")).filter(F.col("n") <= at_most)
           .select(F.col("property_id").alias("id")))
    return props.filter((F.col("status") == "pending") & F.col("score").isNotNull()).join(few, "id", "left_semi")


def delivery_queue(props: DataFrame, now: str, *, limit: int | None = None, max_attempts: int = 3,
                   wait_seconds: int = 600) -> DataFrame:
    """What delivery takes next: untried first, then the oldest attempt."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {max(wait_seconds, 0)})")
    tried = F.col("delivery_attempted_at")
    rows = props.filter((F.col("status") == "approved") & (F.col("delivery_attempts") < max_attempts)
                        & (tried.isNull() | (tried <= cutoff)))
    rows = rows.orderBy("delivery_attempts", tried.asc_nulls_first(), F.col("score").desc_nulls_last(), "id")
    return rows.limit(limit) if limit is not None else rows


def due_posts(posts: DataFrame, now: str, *, max_attempts: int = 3, kinds: list[str] | None = None,
              not_before: str | None = None, limit: int | None = None) -> DataFrame:
    at = F.col("scheduled_at")
    rows = posts.filter((F.col("state") == "planned") & (at <= F.lit(now).cast("timestamp"))
                        & (F.col("attempts") < max_attempts))
    if not_before is not None:
        rows = rows.filter(at >= F.lit(not_before).cast("timestamp"))
    if kinds:
        rows = rows.filter(F.col("kind").isin(kinds))
    rows = rows.orderBy("scheduled_at", "id")
    return rows.limit(limit) if limit is not None else rows


def next_due(posts: DataFrame, *, max_attempts: int = 3, kinds: list[str] | None = None,
             not_before: str | None = None) -> DataFrame:
    rows = posts.filter((F.col("state") == "planned") & (F.col("attempts") < max_attempts))
    if not_before is not None:
        rows = rows.filter(F.col("scheduled_at") >= F.lit(not_before).cast("timestamp"))
    if kinds:
        rows = rows.filter(F.col("kind").isin(kinds))
    return rows.agg(F.min("scheduled_at").alias("next_at"))


def stale_posts(posts: DataFrame, now: str) -> DataFrame:
    return (posts.filter((F.col("state") == "planned") & (F.col("scheduled_at") < F.lit(now).cast("timestamp")))
            .orderBy("scheduled_at", "id"))


def status_targets(props: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose sale status is worth checking: never checked first, then the oldest check."""
    rows = props.filter(F.col("status").isin("approved", "delivered")
                        & (F.col("source_url").startswith("http")
                           | F.coalesce(F.col("listing_url").startswith("http"), F.lit(False))))
    rows = rows.orderBy(F.col("listing_status_at").asc_nulls_first(), F.col("id").desc())
    return rows.limit(limit) if limit is not None else rows


def _near_posting() -> list[Column]:
    return [(F.col("status") == "delivered").desc(), (F.col("status") == "approved").desc(),
            F.col("score").desc_nulls_last(), F.col("id").desc()]


def relink_targets(props: DataFrame, limit: int | None = None) -> DataFrame:
    rows = props.filter((F.coalesce(F.col("listing_url"), F.lit("")) == "") & F.col("source_url").isNotNull())
    rows = rows.orderBy(*_near_posting())
    return rows.limit(limit) if limit is not None else rows


def backfill_targets(props: DataFrame, fields: list[str], limit: int | None = None) -> DataFrame:
    """Scored rows with an empty field, or a name too long to be a name."""
    open_field = F.lit(False)
    for name in fields:
        open_field = open_field | F.col(name).isNull()
    rows = props.filter((open_field | (F.length("display_name") > NAME_MAX)) & F.col("scored_at").isNotNull())
    rows = rows.orderBy((F.col("status") == "delivered").desc(), F.col("score").desc_nulls_last(), F.col("id").desc())
    return rows.limit(limit) if limit is not None else rows


def rescore_targets(props: DataFrame, statuses: list[str] | None = None, before: str | None = None,
                    limit: int | None = None) -> DataFrame:
    rows = props.filter((F.col("status") != "delivered") & F.col("scored_at").isNotNull())
    if statuses:
        rows = rows.filter(F.col("status").isin(statuses))
    if before is not None:
        rows = rows.filter(F.col("scored_at") < F.lit(before).cast("timestamp"))
    rows = rows.orderBy("scored_at", "id")
    return rows.limit(limit) if limit is not None else rows


def unscored(props: DataFrame, limit: int | None = None) -> DataFrame:
    rows = props.filter(F.col("score").isNull() & (F.col("status") == "pending")).orderBy("id")
    return rows.limit(limit) if limit is not None else rows


def untagged(feedback: DataFrame, limit: int | None = None) -> DataFrame:
    rows = feedback.filter(F.col("reason_tag").isNull()).orderBy("id")
    return rows.limit(limit) if limit is not None else rows


def published_between(posts: DataFrame, since: str, until: str, kind: str | None = "feed") -> DataFrame:
    at = F.col("published_at")
    rows = posts.filter((F.col("state") == "published") & (at >= F.lit(since).cast("timestamp"))
                        & (at < F.lit(until).cast("timestamp")))
    return rows.filter(F.col("kind") == kind) if kind else rows


def reach_targets(posts: DataFrame, since: str) -> DataFrame:
    return (posts.filter((F.col("state") == "published") & F.col("media_id").isNotNull()
                         & (F.col("published_at") >= F.lit(since).cast("timestamp")))
            .orderBy(F.col("published_at").desc(), F.col("id").desc()))


def reviewed_rows(props: DataFrame) -> DataFrame:
    return props.filter(F.col("score").isNotNull())


def deletable(props: DataFrame, *, source: str | None = None, ident: int | None = None,
              ids: DataFrame | None = None) -> DataFrame:
    """Rows that may be deleted: never delivered ones, chosen by one of three ways."""
    rows = props.filter(F.col("status") != "delivered")
    if ident is not None:
        return rows.filter(F.col("id") == ident)
    if ids is not None:
        return rows.join(ids.select("id"), "id", "left_semi")
    if source is not None:
        return rows.filter(F.col("source") == source)
    raise ValueError("name a source, an id or a table of ids")


def recent_reasons(feedback: DataFrame, per_tag: int = 10) -> DataFrame:
    """The newest reasons of every tag. The rank filter limits each task before the shuffle."""
    newest = Window.partitionBy("reason_tag").orderBy(F.col("id").desc())
    return (feedback.filter(F.col("reason_tag").isNotNull()).withColumn("rn", F.row_number().over(newest))
            .filter(F.col("rn") <= per_tag))


def latest_reasons(feedback: DataFrame, limit: int) -> DataFrame:
    return feedback.orderBy(F.col("id").desc()).limit(limit)


def slot_clashes(posts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted posts whose time another feed post already holds.

    Posts are reduced to the lowest and highest id per time first, so a time
    that many posts share never multiplies rows.
    """
    taken = (posts.filter((F.col("kind") == "feed") & F.col("state").isin("planned", "publishing", "published"))
             .groupBy("scheduled_at").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")))
    return (wanted.join(taken, "scheduled_at").filter((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id")))
            .select(*wanted.columns))


def occupied_slots(posts: DataFrame, until: str) -> DataFrame:
    return posts.filter((F.col("kind") == "feed") & F.col("state").isin(SLOT_HOLDING)
                        & (F.col("scheduled_at") <= F.lit(until).cast("timestamp")))


def stories_due(posts: DataFrame, now: str) -> DataFrame:
    """Planned stories whose parent post is out."""
    out = posts.filter(F.col("state") == "published").select(F.col("id").alias("parent_post_id"))
    return (posts.filter((F.col("kind") == "story") & (F.col("state") == "planned")
                         & (F.col("scheduled_at") <= F.lit(now).cast("timestamp")))
            .join(out, "parent_post_id", "left_semi"))


def reconcile_media(posts: DataFrame, checks: DataFrame) -> DataFrame:
    """Published posts: still there, gone, or not known. Unknown is never gone."""
    out = posts.filter((F.col("state") == "published") & F.col("media_id").isNotNull())
    return out.join(checks, "media_id", "left").withColumn(
        "media_state", F.when(F.col("present"), "present").when(~F.col("present"), "gone").otherwise("unknown"))


def newest_reach(readings: DataFrame) -> Column:
    """Reach of the newest reading. Of readings at one instant the first to arrive counts, the one of the least ``seq``;
    without such a column the one of the greatest reach."""
    tie = -F.col("seq") if "seq" in readings.columns else F.coalesce("reach", F.lit(-1))
    # Instant and tie in one number: a struct would have every task sort its readings.
    return F.max_by("reach", F.unix_micros("read_at").cast("decimal(38,0)") * F.lit(Decimal(10 ** 19)) + tie).alias("reach")


def latest_readings(readings: DataFrame) -> DataFrame:
    return readings.groupBy("media_id").agg(newest_reach(readings), F.max("read_at").alias("read_at"))


def reach_by_media(posts: DataFrame, readings: DataFrame) -> DataFrame:
    """Posts with the newest reading of their media; readings without a post are ignored."""
    newest = latest_readings(readings).withColumnsRenamed({"reach": "_reach", "read_at": "_at"})
    return (posts.join(newest, "media_id", "left")
            .withColumn("reach", F.when(F.col("_at").isNotNull(), F.col("_reach")).otherwise(F.col("reach")))
            .withColumn("reach_checked_at", F.col("_at")).drop("_reach", "_at"))


def pick_names(media: DataFrame, posts: DataFrame, props: DataFrame, skip: list[str]) -> DataFrame:
    """Name of a media item: listing name, bracketed name, or the first useful caption line."""
    named = (posts.filter(F.col("media_id").isNotNull()).select("media_id", "property_id")
             .join(props.select(F.col("id").alias("property_id"), "display_name", "title"), "property_id", "left")
             .groupBy("media_id").agg(F.max(F.coalesce(F.nullif(F.col("display_name"), F.lit("")), "title"))
                                      .alias("listing")))
    text = F.coalesce(F.col("caption"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(skip))
    bracket = F.nullif(F.trim(F.regexp_extract(text, r"(?U)【\s*(.+?)\s*】", 1)), F.lit(""))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return media.join(named, "media_id", "left").withColumn(
        "name", F.coalesce(F.nullif(F.trim("listing"), F.lit("")), bracket, first)).drop("listing")


def asof_notes(weeks: DataFrame, notes: DataFrame) -> DataFrame:
    """For each week, the newest note that is not from a later week.

    One row per week on both sides, so the union and the running window stay
    as small as the calendar.
    """
    newest = notes.groupBy("week_start").agg(F.max_by("body", F.struct("created_at", "id")).alias("body"))
    both = (weeks.select(F.col("week_start"), F.lit(None).cast("string").alias("body"),
                         F.lit(None).cast("date").alias("note_week"), F.lit(1).alias("asked"))
            .unionByName(newest.select("week_start", "body", F.col("week_start").alias("note_week"),
                                       F.lit(0).alias("asked"))))
    upto = Window.orderBy("week_start", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("body", F.last("body", True).over(upto))
            .withColumn("note_week", F.last("note_week", True).over(upto))
            .filter(F.col("asked") == 1).drop("asked"))


def note_weeks(posts: DataFrame, notes: DataFrame, now: str, zone: str) -> DataFrame:
    """Weeks that are over, had posts, and have no note."""
    from curalens.functions.clock import local_week
    weeks = (posts.filter(F.col("state") == "published")
             .select(local_week(F.col("published_at"), zone).alias("week_start")).distinct())
    done = weeks.filter(F.date_add("week_start", 7) <= F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), zone)))
    return done.join(notes.select("week_start").distinct(), "week_start", "left_anti")


# --- counts -----------------------------------------------------------------

def source_outcomes(props: DataFrame) -> DataFrame:
    """Per source: how many came in and how far they got. One pass, map-side combined."""
    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    return props.groupBy("source").agg(
        F.count("*").alias("collected"), F.count("score").alias("scored"), having("approved"), having("rejected"),
        having("delivered"), having("pending"), F.max("score").alias("best_score"))


def sources_report(props: DataFrame, sources: DataFrame) -> DataFrame:
    label = (F.when(F.col("mode").isNull(), "none").when(F.col("mode") != "crawl", "manual only")
             .when(F.col("enabled"), "on").otherwise("off"))
    return (source_outcomes(props).join(sources.select(F.col("key").alias("source"), "mode", "enabled"), "source", "left")
            .withColumn("crawl", label).drop("mode", "enabled"))


def tag_counts(feedback: DataFrame) -> DataFrame:
    return (feedback.filter(F.col("reason_tag").isNotNull() & (F.col("reason_tag") != "other"))
            .groupBy("reason_tag").agg(F.count("*").alias("hits")))


def rule_candidates(feedback: DataFrame, rules: DataFrame, min_hits: int = 3) -> DataFrame:
    """Rule table after learning: new frequent tags proposed, known ones recounted only."""
    hits = tag_counts(feedback).filter(F.col("hits") >= min_hits)
    return (rules.join(hits, "reason_tag", "full_outer")
            .select("reason_tag", F.coalesce("hits", "hit_count").alias("hit_count"),
                    F.coalesce("state", F.lit("proposed")).alias("state"),
                    F.coalesce("proposal", F.concat(F.lit("avoid "), "reason_tag")).alias("proposal")))


def approved_rules(rules: DataFrame) -> DataFrame:
    return rules.filter((F.col("state") == "approved") & (F.coalesce(F.col("proposal"), F.lit("")) != "")).orderBy(
        F.col("hit_count").desc(), "reason_tag")


def skip_reasons(skips: DataFrame, props: DataFrame) -> DataFrame:
    approved = props.filter(F.col("status") == "approved").select(F.col("id").alias("property_id"))
    return (skips.groupBy("property_id", "reason").agg(F.count("*").alias("n"), F.min("source_url").alias("sample"))
            .join(approved, "property_id", "left_semi"))


def delivery_errors(props: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Approved rows per source and kind of error, and how many are stuck."""
    head = F.trim(F.substring_index(F.coalesce("delivery_error", F.lit("untried")), ":", 1))
    return (props.filter(F.col("status") == "approved").groupBy("source", head.alias("error_head"))
            .agg(F.count("*").alias("n"), F.count_if(F.col("delivery_attempts") >= max_attempts).alias("stuck")))


def image_report(images: DataFrame, skips: DataFrame) -> DataFrame:
    """Per property: images kept and images left out by reason."""
    kept = images.select("property_id", F.lit("kept").alias("reason"))
    out = skips.select("property_id", "reason")
    return kept.unionByName(out).groupBy("property_id", "reason").agg(F.count("*").alias("n"))


# Dollars per million tokens in and out, characters per token, prompt tokens per row.
PRICE_IN, PRICE_OUT, CHARS_PER_TOKEN, PROMPT_TOKENS = 1.0, 5.0, 2.5, 1200


def reading_cost(rows: DataFrame, out_tokens: int, by: list[str] | None = None) -> DataFrame:
    """Estimated tokens and dollars of reading the rows once."""
    got = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.sum(F.length(F.coalesce("content_text", F.lit("")))).alias("chars"))
    got = (got.withColumn("tokens_in", F.floor(F.coalesce("chars", F.lit(0)) / CHARS_PER_TOKEN
                                               + F.col("n") * PROMPT_TOKENS))
           .withColumn("tokens_out", F.col("n") * out_tokens))
    dollars = F.col("tokens_in") / 1e6 * PRICE_IN + F.col("tokens_out") / 1e6 * PRICE_OUT
    return got.withColumn("dollars", F.round(dollars, 4))


def lookup_cost(props: DataFrame, images: DataFrame, quota: int = 10, probe: int = 2,
                unit: float = 0.0035) -> DataFrame:
    rows = under_quota(props, images, quota)
    return rows.agg(F.count("*").alias("n"), F.sum(F.least("image_count", F.lit(probe))).alias("lookups")).withColumn(
        "dollars", F.round(F.col("lookups") * unit, 4))


def status_summary(props: DataFrame) -> DataFrame:
    """Sale status of the rows that go out; unchecked ones counted apart."""
    seen = F.coalesce("listing_status", F.lit("unchecked"))
    return (props.filter(F.col("status").isin("approved", "delivered")).groupBy(seen.alias("listing_status"))
            .agg(F.count("*").alias("n"))
            .withColumn("gone", F.col("listing_status").isin("sold", "off_market")))


# --- rates ------------------------------------------------------------------

def newest_rates(readings: DataFrame) -> DataFrame:
    """Newest reading per currency."""
    return readings.groupBy("currency").agg(F.max_by("jpy_per", "fetched_at").alias("jpy_per"),
                                            F.max("fetched_at").alias("fetched_at"))


def effective_rates(stored: DataFrame, fallback: DataFrame, now: str, max_age_days: int = 7) -> DataFrame:
    """Stored rates, or the configured ones when nothing is stored.

    Both inputs have one row per currency. ``stale`` says the newest stored
    rate is too old.
    """
    newest = stored.agg(F.max("fetched_at").alias("at"), F.count("*").alias("n"))
    as_of, n = newest.select("at").scalar(), newest.select("n").scalar()
    used = stored.select("currency", "jpy_per", F.lit("stored").alias("origin")).unionByName(
        fallback.select("currency", "jpy_per", F.lit("configured").alias("origin")).filter(n == 0))
    limit = F.lit(now).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, {max_age_days})")
    return used.withColumn("as_of", as_of).withColumn("stale", F.coalesce(F.col("as_of") <= limit, F.lit(True)))
