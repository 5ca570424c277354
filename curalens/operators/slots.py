"""Posting slots: the grid, what is free, and who gets it.

A grid has ``plan_days x post_times`` slots per anchor, a number the settings
fix. Only as many posts or listings as there are slots are ever ranked; they
come out of a top-k, so no ranking sees the whole table.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.config import PostConfig
from curalens.functions.clock import local_day
from curalens.operators.lists import SLOT_HOLDING, postable


def slot_grid(anchor: DataFrame, cfg: PostConfig) -> DataFrame:
    """Slots of the next days as UTC instants, future ones only. ``anchor`` has the instant ``now``."""
    today = local_day(F.col("now"), cfg.zone)
    days = anchor.select("now", F.explode(F.sequence(today, F.date_add(today, cfg.plan_days - 1))).alias("day"))
    times = days.select("now", "day", F.explode(F.array(*[F.lit(t) for t in cfg.post_times])).alias("hhmm"))
    at = F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("day"), F.col("hhmm")), "yyyy-MM-dd HH:mm"), cfg.zone)
    return times.select("day", at.alias("slot_at"), "now").filter(F.col("slot_at") > F.col("now")).drop("now")


def next_reel(anchor: DataFrame, cfg: PostConfig) -> DataFrame:
    """The next weekly reel time after ``now``."""
    today = local_day(F.col("now"), cfg.zone)
    ahead = F.pmod(F.lit(cfg.reel_weekday) - F.weekday(today), F.lit(7))

    def at(day: Column) -> Column:
        return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day, F.lit(cfg.reel_time)), "yyyy-MM-dd HH:mm"), cfg.zone)

    first = F.date_add(today, ahead)
    return anchor.select(F.when(at(first) > F.col("now"), at(first)).otherwise(at(F.date_add(first, 7))).alias("reel_at"))


def slot_capacity(slots: DataFrame, occupied: DataFrame, cfg: PostConfig) -> DataFrame:
    """Places left per local day. A post moved by hand still uses its day."""
    used = occupied.groupBy(local_day(F.col("scheduled_at"), cfg.zone).alias("day")).agg(F.count("*").alias("used"))
    return (slots.select("day").distinct().join(used, "day", "left")
            .select("day", F.coalesce("used", F.lit(0)).alias("used"))
            .withColumn("places", F.greatest(F.lit(len(cfg.post_times)) - F.col("used"), F.lit(0))))


def open_slots(slots: DataFrame, occupied: DataFrame, cfg: PostConfig) -> DataFrame:
    """Free slots in order, numbered from 1."""
    taken = occupied.select(F.col("scheduled_at").alias("slot_at")).distinct()
    of_day = Window.partitionBy("day").orderBy("slot_at")  # at most len(post_times) rows
    free = (slots.join(taken, "slot_at", "left_anti").join(slot_capacity(slots, occupied, cfg), "day")
            .withColumn("rn", F.row_number().over(of_day)).filter(F.col("rn") <= F.col("places")))
    return free.select("day", "slot_at", F.row_number().over(Window.orderBy("slot_at")).alias("slot_no"))


def _size(cfg: PostConfig) -> int:
    return cfg.plan_days * len(cfg.post_times)


def first_ranked(rows: DataFrame, order: list, n: int, out: str = "place") -> DataFrame:
    """The first ``n`` rows by ``order``, numbered. Top-k first, so the window has n rows."""
    return rows.orderBy(*order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def zip_slots(free: DataFrame, candidates: DataFrame, cfg: PostConfig) -> DataFrame:
    """n-th free slot with the n-th best candidate; a slot without one is short of stock."""
    ranked = first_ranked(candidates, [F.col("score").desc_nulls_last(), F.col("id").desc()], _size(cfg)).select(
        F.col("place").alias("slot_no"), F.col("id").alias("property_id"))
    return free.join(ranked, "slot_no", "left").withColumn("short_of_stock", F.col("property_id").isNull())


def occupied_by(posts: DataFrame, states: list[str] = SLOT_HOLDING) -> DataFrame:
    return posts.filter((F.col("kind") == "feed") & F.col("state").isin(states))


def plan_posts(anchor: DataFrame, posts: DataFrame, props: DataFrame, cfg: PostConfig,
               sources: list[str] | None = None) -> DataFrame:
    """New planned posts: feed posts for free slots, their stories, and the weekly reel unless it stands already.

    Ids go on from the highest one: each feed post, its story with the post as parent, and the reel last. The rows are no more
    than twice the slots and one. Posts hold slots up to the last slot; without a free slot nothing is planned.
    """
    grid = slot_grid(anchor, cfg)
    ends = grid.agg(F.min("day").alias("a"), F.max("slot_at").alias("b"))
    held = occupied_by(posts).filter((local_day(F.col("scheduled_at"), cfg.zone) >= ends.select("a").scalar())
                                     & (F.col("scheduled_at") <= ends.select("b").scalar() + F.expr("INTERVAL 1 MINUTE")))
    free = open_slots(grid, held, cfg)
    pairs = zip_slots(free, postable(props, posts, _size(cfg), sources), cfg).filter(~F.col("short_of_stock"))
    told = posts.filter((F.col("kind") == "story") & F.col("property_id").isNotNull()).select("property_id", F.lit(True).alias("_told")).distinct()
    delay = F.expr(f"INTERVAL {cfg.story_delay_minutes} MINUTES")
    both = F.array(F.struct(F.lit("feed").alias("kind"), F.col("slot_at").alias("scheduled_at")),
                   F.struct(F.lit("story").alias("kind"), (F.col("slot_at") + delay).alias("scheduled_at")))
    paired = (pairs.join(told, "property_id", "left").select("slot_no", "property_id", "_told", F.inline(both))
              .filter((F.col("kind") == "feed") | F.col("_told").isNull()).drop("_told"))
    stands = posts.filter((F.col("kind") == "reel") & F.col("state").isin(SLOT_HOLDING)).select(
        F.col("scheduled_at").alias("reel_at"))
    reel = next_reel(anchor, cfg).join(stands, "reel_at", "left_anti").filter(free.agg(F.count("*").alias("n")).select("n").scalar() > 0).select(
        F.lit(2 ** 31 - 1).alias("slot_no"), F.lit(None).cast("long").alias("property_id"), F.lit("reel").alias("kind"),
        F.col("reel_at").alias("scheduled_at"))
    last = posts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).select("n").scalar()
    numbered = paired.unionByName(reel).withColumn("id", last + F.row_number().over(Window.orderBy("slot_no", "kind")))
    feed_id = F.max(F.when(F.col("kind") == "feed", F.col("id"))).over(Window.partitionBy("slot_no"))
    return numbered.withColumn("parent_post_id", F.when(F.col("kind") == "story", feed_id)).select(
        F.col("id").cast("long").alias("id"), "property_id", "kind", F.lit("planned").alias("state"), "scheduled_at",
        F.col("parent_post_id").cast("long").alias("parent_post_id"))


def compact(anchor: DataFrame, posts: DataFrame, cfg: PostConfig) -> DataFrame:
    """Move planned feed posts to the earliest free slots in order; skipped ones go behind them.

    Planned posts beyond the last free slot stay where they are, without a slot and with a reason.
    """
    grid = slot_grid(anchor, cfg)
    now = anchor.select("now").scalar()
    last = grid.agg(F.max("slot_at").alias("x")).select("x").scalar()
    coming = posts.filter((F.col("kind") == "feed") & (F.col("scheduled_at") > now)
                          & (F.col("scheduled_at") <= last + F.expr("INTERVAL 1 MINUTE")))
    free = open_slots(grid, coming.filter(F.col("state").isin("published", "publishing")), cfg)
    n = _size(cfg)
    waiting = coming.filter(F.col("state") == "planned")
    planned = first_ranked(waiting, ["scheduled_at", "id"], n, "slot_no")
    placed = planned.join(free, "slot_no").select("id", "slot_at")
    moved = waiting.select("id", "scheduled_at").join(placed, "id", "left")
    # Behind the planned ones: as many tail slots as remain, the last one for everybody after that.
    used = planned.agg(F.count("*").alias("n")).select("n").scalar()
    tail = free.filter(F.col("slot_no") > used).withColumn("place", F.row_number().over(Window.orderBy("slot_no")))
    end = tail.agg(F.max("slot_at").alias("x")).select("x").scalar()
    skipped = coming.filter(F.col("state") == "skipped")
    head = first_ranked(skipped, ["scheduled_at", "id"], n).select("id", "place")
    parked = (skipped.join(head, "id", "left").join(tail.select("place", "slot_at"), "place", "left")
              .select("id", "scheduled_at", F.coalesce("slot_at", end, last).alias("slot_at")))
    return moved.unionByName(parked).filter(F.col("slot_at").isNull() | (F.col("scheduled_at") != F.col("slot_at"))).withColumn(
        "reason", F.when(F.col("slot_at").isNull(), "no slot"))


def reschedule(anchor: DataFrame, posts: DataFrame, cfg: PostConfig) -> DataFrame:
    """Overdue or off-grid planned posts to free slots in order; reels to the next reel time.

    A post beyond the last free slot stays in the result without a slot and with a reason.
    """
    grid = slot_grid(anchor, cfg)
    now = anchor.select("now").scalar()
    last = grid.agg(F.max("slot_at").alias("x")).select("x").scalar()
    coming = (F.col("scheduled_at") >= now) & (F.col("scheduled_at") <= last + F.expr("INTERVAL 1 MINUTE"))
    planned = posts.filter(F.col("state") == "planned").select("id", "kind", "scheduled_at")
    overdue = planned.filter(F.col("scheduled_at") < now)
    off_grid = planned.filter(coming & (F.col("kind") == "feed")).join(
        grid.select(F.col("slot_at").alias("scheduled_at")), "scheduled_at", "left_anti").select("id", "kind", "scheduled_at")
    targets = overdue.unionByName(off_grid)
    reels = targets.filter(F.col("kind") == "reel").withColumn(
        "slot_at", next_reel(anchor, cfg).select("reel_at").scalar())
    on_grid = posts.filter(coming & (F.col("kind") == "feed")).select("id", "scheduled_at").join(
        grid.select(F.col("slot_at").alias("scheduled_at")), "scheduled_at", "left_semi")
    stay = on_grid.select(F.col("scheduled_at").alias("slot_at")).distinct()
    free = grid.join(stay, "slot_at", "left_anti").select(
        "slot_at", F.row_number().over(Window.orderBy("slot_at")).alias("place"))
    waiting = targets.filter(F.col("kind") != "reel")
    placed = first_ranked(waiting, ["scheduled_at", "id"], _size(cfg)).join(free, "place").select("id", "slot_at")
    others = waiting.join(placed, "id", "left")
    return reels.select("id", "kind", "scheduled_at", "slot_at").unionByName(
        others.select("id", "kind", "scheduled_at", "slot_at")).withColumn("reason", F.when(F.col("slot_at").isNull(), "no slot"))


def requeue(anchor: DataFrame, posts: DataFrame, ids: DataFrame, cfg: PostConfig, horizon_days: int = 31) -> DataFrame:
    """Published posts of any kind back to planned, the n-th of a kind in the n-th slot that its kind leaves free.

    Slots of ``horizon_days`` days count. ``ids`` may have a boolean ``now``: such a post is due at once and takes no slot.
    What pointed to the old post (media, container, permalink, times, error) is cleared. A post beyond the last
    free slot stays published and carries a reason.
    """
    wide = replace(cfg, plan_days=horizon_days)
    kinds = F.array(*[F.lit(k) for k in ("feed", "reel", "story")])
    taken = posts.filter(F.col("state").isin("planned", "publishing")).select("kind", F.col("scheduled_at").alias("slot_at"))
    of_kind = Window.partitionBy("kind").orderBy("slot_at")                      # a horizon of slots
    free = (slot_grid(anchor, wide).select(F.explode(kinds).alias("kind"), "slot_at").join(taken, ["kind", "slot_at"], "left_anti")
            .withColumn("place", F.row_number().over(of_kind)))
    at_once = F.col("now") if "now" in ids.columns else F.lit(False)
    asked = ids.select("id", F.coalesce(at_once, F.lit(False)).alias("_now")).groupBy("id").agg(F.bool_or("_now").alias("_now"))
    back = posts.filter(F.col("state") == "published").join(asked, "id")
    by_id = Window.partitionBy("kind").orderBy("id")
    placed = (back.filter(~F.col("_now")).select("id", "kind").withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= _size(wide))
              .join(free, ["kind", "place"]).select("id", F.col("slot_at").alias("_slot")))
    rows = back.join(placed, "id", "left").withColumn("_slot", F.when(F.col("_now"), anchor.select("now").scalar()).otherwise(F.col("_slot")))
    moved = F.col("_slot").isNotNull()
    cleared = [c for c in ("media_id", "container_id", "permalink", "error", "published_at") if c in posts.columns]
    return rows.withColumns({
        "state": F.when(moved, "planned").otherwise(F.col("state")), "scheduled_at": F.coalesce("_slot", "scheduled_at"),
        "attempts": F.when(moved, 0).otherwise(F.col("attempts")), **{c: F.when(~moved, F.col(c)) for c in cleared},
        "reason": F.when(~moved, "no slot")}).drop("_slot", "_now")
