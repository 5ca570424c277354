"""State changes as set operations: snapshot + changes -> new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curalens.operators.lists import NAME_MAX, deletable
from curalens.operators.post_fold import MOVING, PIECE_ROWS, fold_posts

THRESHOLD_REASONS = ["too_small", "wrong_type"]


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key by ``order``; rows with a NULL key all stay.

    An aggregate, not a window: one key that repeats in a third of all rows is
    reduced inside every map task before anything is shuffled. Rows with a
    NULL key are told apart by ``order``, which must be unique among them.
    """
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    apart = F.when(has_null, F.struct(*order))
    picked = rows.groupBy(*keys, apart.alias("_apart")).agg(
        F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def insert_once(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows that get in: new keys only, first arrival wins, NULL keys never clash."""
    fresh = first_per_key(incoming, keys, order)
    return fresh.join(current.select(*keys), keys, "left_anti")


def _blank(col: Column | str) -> Column:
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Judged fields: a scored row replaces them, an empty text clears them.
JUDGED_FLAGS = ["style_identified", "one_of_a_kind", "provenance_visible"]
JUDGED_TEXTS = ["score_reason", "score_detail", "score_model", "summary", "genre", "architect", "year_built", "usage_type", "structure",
                "building_area", "site_area", "style_name", "summary_en", "photo_credit", "display_name", "caption_body", "location_region"]


def merge_scores(props: DataFrame, scored: DataFrame) -> DataFrame:
    """Write scores back: judged fields overwrite, place, street and price only fill gaps.

    Only fields that both sides have are written; a listing without a score stays as it is. Numbers
    are made anew from the merged price and year of the scored rows.
    """
    from curalens.functions.values import parse_year, price_parts
    new = scored.withColumnsRenamed({c: f"_{c}" for c in scored.columns})
    hit = F.col("_property_id").isNotNull()
    rows = props.join(new, props.id == new._property_id, "left")
    both = [c for c in props.columns if c in scored.columns]
    done = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("score", "scored_at", *JUDGED_FLAGS) if c in both}
    done |= {c: F.when(hit, _blank(f"_{c}")).otherwise(F.col(c)) for c in JUDGED_TEXTS if c in both}
    done |= {old: F.coalesce(old, _blank(f"_{new_name}")) for old, new_name in
             (("location_city", "city"), ("location_country", "country"), ("price", "price"), ("street_address", "street_address"))
             if old in props.columns and new_name in scored.columns}
    rows = rows.withColumns(done)
    numbers = {}
    if {"price_value", "price_currency"} <= set(props.columns):
        rows = rows.withColumn("_parts", price_parts(F.col("price")))
        numbers |= {f"price_{k}": F.when(hit, F.col(f"_parts.{k}")).otherwise(F.col(f"price_{k}")) for k in ("value", "currency")}
    if "year_built_value" in props.columns:
        numbers["year_built_value"] = F.when(hit, parse_year(F.col("year_built"))).otherwise(F.col("year_built_value"))
    return rows.withColumns(numbers).drop("_parts", *new.columns)


def fill_blanks(props: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """Fill empty fields only; a name that is too long may be replaced by a short one."""
    new = values.select(F.col("property_id").alias("_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = props.join(new, props.id == new._id, "left")
    filled = {f: F.coalesce(f, _blank(f"_{f}")) for f in fields}
    if "display_name" in fields:
        fresh = F.trim("_display_name")
        rename = (F.length(F.trim("display_name")) > NAME_MAX) & (fresh != "") & (F.length(fresh) <= NAME_MAX)
        filled["display_name"] = F.when(rename, fresh).otherwise(filled["display_name"])
    return rows.withColumns(filled).drop("_id", *[f"_{f}" for f in fields])


def apply_reviews(props: DataFrame, events: DataFrame) -> DataFrame:
    """Approve, reject (needs a reason) or reset; the newest valid decision stands.

    An approval or a reset clears the delivery tries even if a rejection follows it. Delivered
    listings and listings without an event stay as they are.
    """
    valid = events.filter((F.col("action") != "reject") | (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    last = (valid.groupBy("property_id")
            .agg(F.max_by(F.struct("action", "reason", "at"), F.struct("at", "seq")).alias("_ev"),
                 F.bool_or(F.col("action").isin("approve", "reset")).alias("_clears"))
            .select(F.col("property_id").alias("id"), "_ev", "_clears"))
    open_row = F.col("status") != "delivered"
    act = F.when(open_row, F.col("_ev.action"))
    clear = open_row & F.coalesce("_clears", F.lit(False))
    rows = props.join(last, "id", "left")
    known = set(props.columns)
    unless_cleared = {c: F.when(clear, None).otherwise(F.col(c)) for c in ("delivery_error", "delivery_attempted_at") if c in known}
    why = {"reject_reason": F.when(act == "reject", F.trim("_ev.reason")).when(
        act.isNull(), F.col("reject_reason") if "reject_reason" in known else F.lit(None))}
    return rows.withColumns(unless_cleared | why | {
        "delivery_attempts": F.when(clear, 0).otherwise(F.col("delivery_attempts")),
        "reviewed_at": F.when(act == "reset", None).when(act.isNotNull(), F.col("_ev.at")).otherwise(F.col("reviewed_at")),
        "status": F.when(act == "approve", "approved").when(act == "reject", "rejected")
        .when(act == "reset", "pending").otherwise(F.col("status")),
    }).drop("_ev", "_clears")


def feedback_from_reviews(props: DataFrame, events: DataFrame) -> DataFrame:
    """Feedback rows the rejections add; delivered listings give none."""
    said = events.filter((F.col("action") == "reject") & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    open_ids = props.filter(F.col("status") != "delivered").select(F.col("id").alias("property_id"))
    return (said.join(open_ids, "property_id", "left_semi")
            .select("property_id", F.trim("reason").alias("reason"), F.col("at").alias("created_at"), "seq"))


def apply_post_events(events: DataFrame, max_attempts: int = 3, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """State and attempts of every post after its ordered events, from planned and no attempts."""
    moves = events.filter(F.col("action").isin(MOVING))
    posts = moves.select(F.col("post_id").alias("id")).distinct().withColumns({"state": F.lit("planned"), "attempts": F.lit(0)})
    return fold_posts(posts, moves, max_attempts, piece_rows).withColumnRenamed("id", "post_id")


def edit_posts(posts: DataFrame, edits: DataFrame) -> DataFrame:
    """Newest edit of each field per post, where the state allows it.

    Caption, image order and slot (field ``scheduled_at``, its time in ``value_at``) only where a post can still change; the
    mark that a story was shared (``story_shared``, an empty value takes it away) only on published posts; note and permalink anywhere.
    A caption edited by hand keeps its mark (the time of the newest such edit) when a machine edit
    follows. Fields without an edit stay.
    """
    by_hand = (F.col("field") == "caption") & F.col("by_hand")
    when = F.col("value_at") if "value_at" in edits.columns else F.lit(None).cast("timestamp")
    fields = ["caption", "image_order", "note", "scheduled_at", "story_shared", "permalink"]
    last = edits.groupBy("post_id").agg(
        F.max(F.when(by_hand, F.col("at"))).alias("_hand_at"),
        *[F.max_by(F.when(F.col("field") == f, F.struct("value", "by_hand", "at", when.alias("when"))),
                   F.when(F.col("field") == f, F.struct("at", "seq"))).alias(f"_{f}") for f in fields])
    rows = posts.join(last, posts.id == last.post_id, "left")
    may = F.col("state").isin("planned", "failed", "skipped")
    shared = F.when(F.coalesce(F.trim("_story_shared.value"), F.lit("")) != "", F.col("_story_shared.at"))
    new = {
        "caption": (may & F.col("_caption").isNotNull(), F.col("_caption.value")),
        "caption_edited_at": (may & F.col("_hand_at").isNotNull(), F.col("_hand_at")),
        "image_order": (may & F.col("_image_order").isNotNull(), F.col("_image_order.value")),
        "note": (F.col("_note").isNotNull(), F.nullif(F.trim("_note.value"), F.lit(""))),
        "scheduled_at": (may & F.col("_scheduled_at.when").isNotNull(), F.col("_scheduled_at.when")),
        "story_shared_at": ((F.col("state") == "published") & F.col("_story_shared").isNotNull(), shared),
        "permalink": (F.col("_permalink").isNotNull(), F.col("_permalink.value")),
    }
    return rows.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, (hit, value) in new.items() if c in posts.columns}).drop(
        "post_id", "_hand_at", *[f"_{f}" for f in fields])


def delivery_failures(props: DataFrame, failures: DataFrame) -> DataFrame:
    """Count failed tries up, keep the newest message and time."""
    got = failures.groupBy("property_id").agg(
        F.count("*").alias("_n"), F.max_by("message", F.struct("at", "seq")).alias("_message"), F.max("at").alias("_at"))
    rows = props.join(got, props.id == got.property_id, "left")
    hit = F.col("_n").isNotNull()
    return rows.withColumns({
        "delivery_attempts": F.col("delivery_attempts") + F.coalesce("_n", F.lit(0)),
        "delivery_error": F.when(hit, F.col("_message")).otherwise(F.col("delivery_error")),
        "delivery_attempted_at": F.when(hit, F.col("_at")).otherwise(F.col("delivery_attempted_at")),
    }).drop("property_id", "_n", "_message", "_at")


def _touch(props: DataFrame, ids: DataFrame, when: Column, changes: dict[str, Column]) -> DataFrame:
    """Change columns of the listed rows where ``when`` holds."""
    marked = props.join(ids.select(F.col("id"), F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & when
    return marked.withColumns({c: F.when(hit, new).otherwise(F.col(c)) for c, new in changes.items()}).drop("_hit")


def retry_delivery(props: DataFrame, ids: DataFrame) -> DataFrame:
    return _touch(props, ids, F.col("status") == "approved",
                  {"delivery_attempts": F.lit(0), "delivery_error": F.lit(None), "delivery_attempted_at": F.lit(None)})


def undo_delivery(props: DataFrame, deliveries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop delivery rows and put their listings back to approved."""
    real = deliveries.join(ids.select(F.col("id").alias("property_id")), "property_id", "left_semi")
    left = deliveries.join(ids.select(F.col("id").alias("property_id")), "property_id", "left_anti")
    back = _touch(props, real.select(F.col("property_id").alias("id")), F.lit(True),
                  {"status": F.lit("approved"), "delivery_attempts": F.lit(0), "delivery_error": F.lit(None)})
    return back, left


def purge_dropped(media: DataFrame, posts: DataFrame) -> DataFrame:
    """Media that stay: those of posts neither skipped nor deleted."""
    dropped = posts.filter(F.col("state").isin("skipped", "deleted")).select(F.col("id").alias("post_id"))
    return media.join(dropped, "post_id", "left_anti")


def clear_stale_skips(skips: DataFrame, props: DataFrame) -> DataFrame:
    """Skips that stay once thresholds have changed; delivered listings keep theirs."""
    open_ids = props.filter(F.col("status") != "delivered").select(F.col("id").alias("property_id"))
    doubtful = skips.filter(F.col("reason").isin(THRESHOLD_REASONS))
    firm = skips.filter(~F.col("reason").isin(THRESHOLD_REASONS))
    return firm.unionByName(doubtful.join(open_ids, "property_id", "left_anti"))


def clear_scores(props: DataFrame, ids: DataFrame) -> DataFrame:
    return _touch(props, ids, F.col("status") != "delivered", {"score": F.lit(None), "scored_at": F.lit(None)})


def set_series(props: DataFrame, labels: DataFrame) -> DataFrame:
    """One label per listing, unless delivered; an empty label removes it."""
    new = labels.select(F.col("property_id").alias("id"), F.col("series").alias("_series"), F.lit(True).alias("_hit"))
    rows = props.join(new, "id", "left")
    return rows.withColumn("series", F.when(F.col("_hit") & (F.col("status") != "delivered"), _blank("_series"))
                           .otherwise(F.col("series"))).drop("_series", "_hit")


def set_listing(props: DataFrame, checks: DataFrame) -> DataFrame:
    """Save sale statuses; listings that could not be checked stay untouched."""
    new = (checks.filter(F.col("value").isNotNull())
           .groupBy(F.col("property_id").alias("id")).agg(F.max_by(F.struct(*[c for c in checks.columns if c != "property_id"]), "at").alias("_c")))
    rows = props.join(new, "id", "left")
    hit = F.col("_c").isNotNull()
    note = {"listing_status_note": F.when(hit, _blank("_c.note")).otherwise(F.col("listing_status_note"))} if (
        "note" in checks.columns and "listing_status_note" in props.columns) else {}
    return rows.withColumns(note | {
        "listing_status": F.when(hit, F.col("_c.value")).otherwise(F.col("listing_status")),
        "listing_status_at": F.when(hit, F.col("_c.at")).otherwise(F.col("listing_status_at")),
        "mls_number": F.coalesce("_c.mls", "mls_number"),
    }).drop("_c")


def set_feedback_tag(feedback: DataFrame, tags: DataFrame) -> DataFrame:
    """Attach tags to feedback rows by id."""
    new = tags.select("id", F.col("reason_tag").alias("_tag"))
    return (feedback.join(new, "id", "left").withColumn("reason_tag", F.coalesce("_tag", "reason_tag")).drop("_tag"))


def decide_rules(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve or dismiss rules; anything else is refused."""
    new = decisions.filter(F.col("decision").isin("approved", "dismissed"))
    return (rules.join(new.select("reason_tag", "decision"), "reason_tag", "left")
            .withColumn("state", F.coalesce("decision", "state")).drop("decision"))


def set_image_page(props: DataFrame, pages: DataFrame) -> DataFrame:
    """Page to take photos from; puts the listing back in the delivery queue. Approved rows only."""
    new = pages.select(F.col("property_id").alias("id"), F.col("url").alias("_url"), F.lit(True).alias("_hit"))
    rows = props.join(new, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") == "approved")
    return rows.withColumns({
        "image_page_url": F.when(hit, F.col("_url")).otherwise(F.col("image_page_url")),
        "delivery_attempts": F.when(hit, 0).otherwise(F.col("delivery_attempts")),
        "delivery_error": F.when(~hit, F.col("delivery_error")),
        "delivery_attempted_at": F.when(~hit, F.col("delivery_attempted_at")),
    }).drop("_url", "_hit")


def delete_candidates(props: DataFrame, **choice) -> DataFrame:
    """Candidates that remain after a delete by source, id or table of ids."""
    gone = deletable(props, **choice).select("id")
    return props.join(gone, "id", "left_anti")


def replace_note(notes: DataFrame, now_week: str) -> DataFrame:
    """One note per finished week: the newest, with all its columns."""
    done = notes.filter(F.col("week_start") < F.lit(now_week).cast("date"))
    rest = [c for c in notes.columns if c != "week_start"]
    return (done.groupBy("week_start").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_row"))
            .select("week_start", "_row.*"))


def clear_images(images: DataFrame, skips: DataFrame, props: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and skips that remain after clearing the listed, undelivered listings."""
    open_ids = (props.filter(F.col("status") != "delivered").join(ids.select("id"), "id", "left_semi")
                .select(F.col("id").alias("property_id")))
    return (images.join(open_ids, "property_id", "left_anti"), skips.join(open_ids, "property_id", "left_anti"))


def refresh_values(props: DataFrame) -> DataFrame:
    """Numeric columns recomputed from their texts, whole table at once."""
    from curalens.functions.values import parse_year, price_parts
    return (props.withColumn("_p", price_parts(F.col("price")))
            .withColumns({"price_value": F.col("_p.value"), "price_currency": F.col("_p.currency"),
                          "year_built_value": parse_year(F.col("year_built"))}).drop("_p"))
