"""Weekly report: every week at once, from pre-aggregated frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.config import (LIFT_HINT, LIFT_TREND, MIN_GROUP, MIN_PAIR, MIN_TOTAL, TOP_INSIGHTS, TREND_WEEKS)
from curalens.functions.clock import local_day, local_week
from curalens.functions.ranks import histogram_median
from curalens.operators.lists import image_counts
from curalens.sources.landing import land

FLAGS = ["style_identified", "one_of_a_kind", "provenance_visible"]
US_NAMES = ["USA", "United States"]
AXES = ["genre", "photos", *FLAGS, "united_states", "built_before", "architect_known", "score_at_least"]


def published(posts: DataFrame, zone: str) -> DataFrame:
    return posts.filter(F.col("state") == "published").withColumn("week", local_week(F.col("published_at"), zone))


def weekly_totals(posts: DataFrame, zone: str) -> DataFrame:
    """Posts and reach per local week, next to the week before.

    Unmeasured posts stay out of the average. The week before counts only when
    it is exactly seven days earlier.
    """
    weeks = published(posts, zone).groupBy("week").agg(
        F.count("*").alias("posts"), F.count("reach").alias("measured"),
        F.coalesce(F.sum("reach"), F.lit(0)).alias("reach_total"), F.coalesce(F.avg("reach"), F.lit(0.0)).alias("reach_avg"))
    # One row per week from here on.
    by_week = Window.orderBy("week")
    follows = F.lag("week").over(by_week) == F.date_sub("week", 7)

    def before(name: str) -> Column:
        return F.when(follows, F.lag(name).over(by_week)).otherwise(F.lit(0))

    return weeks.withColumns({"prev_posts": before("posts"), "prev_total": before("reach_total"),
                              "prev_avg": before("reach_avg")})


def week_over_week(totals: DataFrame) -> DataFrame:
    return totals.select("week", (F.col("reach_total") - F.col("prev_total")).alias("total_delta"),
                         (F.col("reach_avg") - F.col("prev_avg")).alias("avg_delta"))


def weekly_mix(posts: DataFrame, props: DataFrame, zone: str) -> DataFrame:
    """Posts per country and per genre of a week, both groupings in one pass."""
    facts = props.select(F.col("id").alias("property_id"), "genre", "location_country")
    rows = published(posts, zone).select("week", "property_id").join(facts, "property_id", "left").select(
        "week", F.coalesce(F.nullif("genre", F.lit("")), F.lit("unknown")).alias("genre"),
        F.coalesce(F.trim("location_country"), F.lit("unknown")).alias("country"))
    got = rows.groupingSets([["week", "genre"], ["week", "country"]], "week", "genre", "country").agg(
        F.count("*").alias("n"))
    return got.select("week", F.when(F.col("genre").isNotNull(), "genre").otherwise("country").alias("dimension"),
                      F.coalesce("genre", "country").alias("value"), "n")


def weekly_stock(props: DataFrame, zone: str) -> DataFrame:
    """Listings collected per week, next to what waits overall."""
    weeks = props.groupBy(local_week(F.col("collected_at"), zone).alias("week")).agg(
        F.count("*").alias("collected"), F.count_if(F.col("status") == "pending").alias("_p"),
        F.count_if(F.col("status").isin("approved", "delivered")).alias("_a"))
    whole = Window.partitionBy()  # one row per week
    return weeks.select("week", "collected", F.sum("_p").over(whole).alias("pending"),
                        F.sum("_a").over(whole).alias("approved_waiting"))


def _trailing(per_week: DataFrame, weeks: DataFrame) -> DataFrame:
    """Copy each weekly aggregate to the report weeks whose window holds it."""
    spread = per_week.withColumn("report_week", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(TREND_WEEKS - 1)), lambda i: F.date_add(F.col("week"), i * 7)))).drop("week")
    return spread.join(weeks.select(F.col("week").alias("report_week")), "report_week", "left_semi")


def report_weeks(posts: DataFrame, zone: str) -> DataFrame:
    return published(posts, zone).select("week").distinct()


def genre_trend(posts: DataFrame, props: DataFrame, zone: str) -> DataFrame:
    """Average reach per genre over the eight weeks that end with each week.

    Posts are summed per week and genre before the windows overlap, so the
    eight-fold copy touches aggregates only.
    """
    measured = published(posts, zone).filter(F.col("reach").isNotNull()).select("week", "property_id", "reach")
    genre = props.select(F.col("id").alias("property_id"),
                         F.coalesce(F.nullif("genre", F.lit("")), F.lit("unknown")).alias("genre"))
    per_week = measured.join(genre, "property_id").groupBy("week", "genre").agg(
        F.count("*").alias("n"), F.sum("reach").alias("reach"))
    return _trailing(per_week, report_weeks(posts, zone)).groupBy("report_week", "genre").agg(
        F.sum("n").alias("posts"), (F.sum("reach") / F.sum("n")).alias("reach_avg"))


def cube_rows(posts: DataFrame, props: DataFrame, images: DataFrame, zone: str) -> DataFrame:
    """(week, axis, label, num, n, reach): sums of feed posts by week and value of each axis, and under the axis ``week``
    all published posts of the week. One pass over posts; medians, the best genre, both sides of every split
    and the report weeks follow from it.
    """
    facts = props.select(
        F.col("id").alias("property_id"), F.coalesce(F.nullif("genre", F.lit("")), F.lit("unknown")).alias("genre"),
        *FLAGS, "location_country", "architect", "year_built_value", "score", F.lit(True).alias("_known"))
    counts = image_counts(images).select("property_id", "image_count")
    rows = (published(posts, zone).select("week", "property_id", "reach", (F.col("kind") == "feed").alias("_feed"))
            .join(facts, "property_id", "left").join(counts, "property_id", "left"))

    def entry(axis: str, label: Column | None = None, num: Column | None = None) -> Column:
        return F.struct(F.lit(axis).alias("axis"), (F.lit(None) if label is None else label).cast("string").alias("label"),
                        (F.lit(None) if num is None else num).cast("double").alias("num"))

    def yes(cond: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), "yes").otherwise("no")

    entries = F.array(
        entry("week"), entry("genre", F.col("genre")), entry("photos", yes(F.col("image_count") >= 8)),
        *[entry(f, yes(F.col(f))) for f in FLAGS],
        entry("united_states", yes(F.col("location_country") == "United States")),
        entry("built_before", num=F.nullif("year_built_value", F.lit(0))),
        entry("architect_known", yes(F.trim("architect") != "")), entry("score_at_least", num=F.col("score")))
    measured = F.coalesce(F.col("_feed") & F.col("_known") & F.col("reach").isNotNull(), F.lit(False))
    kept = F.when(measured, entries).otherwise(F.array(entry("week")))
    return (rows.select("week", "reach", F.explode(kept).alias("e")).select("week", "reach", "e.*")
            .groupBy("week", "axis", "label", "num").agg(F.count("*").alias("n"), F.sum("reach").alias("reach")))


def report_cube(posts: DataFrame, props: DataFrame, images: DataFrame, zone: str) -> DataFrame:
    """The rows of ``cube_rows``, landed: all reports of the weeks read them, the posts are read once."""
    return land(cube_rows(posts, props, images, zone), "report-cube")


def cube_weeks(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("axis") == "week").select("week").distinct()


def trend_histogram(cube: DataFrame) -> DataFrame:
    """Reach sums by report week, axis and value of the axis, over the eight weeks that end with it."""
    return (_trailing(cube.filter(F.col("axis") != "week"), cube_weeks(cube)).groupBy("report_week", "axis", "label", "num")
            .agg(F.sum("n").alias("n"), F.sum("reach").alias("reach")))


def decision_lines(hist: DataFrame) -> DataFrame:
    """Where each week's year and score splits run: the medians of the window."""
    nums = hist.filter(F.col("axis").isin("built_before", "score_at_least") & F.col("num").isNotNull())
    size = nums.groupBy("report_week", "axis").agg(F.sum("n").alias("have"))
    line = histogram_median(nums, ["report_week", "axis"], "num", "n").join(size, ["report_week", "axis"])
    return (line.filter(F.col("have") >= MIN_PAIR * 2)
            .select("report_week", "axis", F.when(F.col("axis") == "built_before", F.floor("median").cast("double"))
                    .otherwise(F.col("median")).alias("line")))


def top_genres(hist: DataFrame) -> DataFrame:
    """Genre with the best average in each window, among those with enough posts."""
    usable = hist.filter((F.col("axis") == "genre") & (F.col("n") >= MIN_PAIR))
    return usable.groupBy("report_week").agg(
        F.min_by("label", F.struct(-(F.col("reach") / F.col("n")), "label")).alias("top_genre"))


def split_lift(hist: DataFrame) -> DataFrame:
    """Both sides of every split, the higher one first, and how far they are apart."""
    sides = (hist.join(decision_lines(hist), ["report_week", "axis"], "left").join(top_genres(hist), "report_week", "left"))
    axis = F.col("axis")
    is_yes = (F.when(axis == "genre", F.col("label") == F.col("top_genre"))
              .when(axis == "built_before", F.when(F.col("line").isNotNull(),
                                                   F.coalesce(F.col("num") < F.col("line"), F.lit(False))))
              .when(axis == "score_at_least", F.when(F.col("line").isNotNull(),
                                                     F.coalesce(F.col("num") >= F.col("line"), F.lit(False))))
              .otherwise(F.col("label") == "yes"))
    mark = F.when(axis == "genre", F.col("top_genre")).otherwise(F.col("line").cast("string"))
    both = (sides.withColumn("yes", is_yes).filter(F.col("yes").isNotNull())
            .groupBy("report_week", "axis", mark.alias("mark"))
            .agg(*[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(f"{c}_{side}")
                   for side, cond in (("y", F.col("yes")), ("n", ~F.col("yes"))) for c in ("n", "reach")]))
    two = both.filter((F.col("n_y") >= MIN_PAIR) & (F.col("n_n") >= MIN_PAIR)).withColumns(
        {"avg_y": F.col("reach_y") / F.col("n_y"), "avg_n": F.col("reach_n") / F.col("n_n")})
    up = F.col("avg_y") >= F.col("avg_n")
    named = two.select(
        "report_week", "axis", "mark", F.when(up, "yes").otherwise("no").alias("winner"),
        F.greatest("avg_y", "avg_n").alias("left_avg"), F.least("avg_y", "avg_n").alias("right_avg"),
        F.when(up, F.col("n_y")).otherwise(F.col("n_n")).alias("n_left"),
        F.when(up, F.col("n_n")).otherwise(F.col("n_y")).alias("n_right"))
    lift = F.when(F.col("right_avg") == 0, F.lit(1.0)).otherwise(F.col("left_avg") / F.col("right_avg"))
    return with_strength(named.withColumn("lift", lift))


def with_strength(splits: DataFrame) -> DataFrame:
    """How much a split may be trusted."""
    smaller = F.least("n_left", "n_right")
    return splits.withColumn("strength", F.when((smaller >= MIN_GROUP) & (F.col("lift") >= LIFT_TREND), "trend")
                             .when(F.col("lift") >= LIFT_HINT, "hint").otherwise("info"))


def insights_top(hist: DataFrame, weeks: DataFrame) -> DataFrame:
    """The best findings of each week, or one row that says why there are none."""
    order = F.when(F.col("strength") == "trend", 0).when(F.col("strength") == "hint", 1).otherwise(2)
    place = F.array_position(F.array(*[F.lit(a) for a in AXES]), F.col("axis"))
    best = Window.partitionBy("report_week").orderBy(order, F.col("lift").desc(), place)  # at most nine rows a week
    size = hist.filter(F.col("axis") == "photos").groupBy("report_week").agg(F.sum("n").alias("rows"))
    enough = size.filter(F.col("rows") >= MIN_TOTAL).select("report_week")
    top = (split_lift(hist).join(enough, "report_week", "left_semi").withColumn("place", F.row_number().over(best))
           .filter(F.col("place") <= TOP_INSIGHTS))
    shown = top.select("report_week", "place", F.col("axis").alias("finding"), "strength", "lift")
    per_week = top.groupBy("report_week").agg(F.count_if(F.col("strength") != "info").alias("firm"),
                                              F.count("*").alias("shown"))
    lead = (weeks.select(F.col("week").alias("report_week")).join(size, "report_week", "left")
            .join(per_week, "report_week", "left")
            .withColumn("finding", F.when(F.coalesce("rows", F.lit(0)) < MIN_TOTAL, "nothing yet")
                        .when(F.col("shown").isNull(), "nothing to compare").when(F.col("firm") == 0, "all alike"))
            .filter(F.col("finding").isNotNull())
            .select("report_week", F.lit(0).alias("place"), "finding", F.lit("info").alias("strength"),
                    F.lit(None).cast("double").alias("lift")))
    return shown.unionByName(lead)


def split_stock(hist: DataFrame, props: DataFrame) -> DataFrame:
    """Pending scored listings of each week's best genre."""
    stock = (props.filter((F.col("status") == "pending") & F.col("score").isNotNull())
             .groupBy(F.col("genre").alias("top_genre")).agg(F.count("*").alias("stock")))
    return top_genres(hist).join(stock, "top_genre", "left").withColumn("stock", F.coalesce("stock", F.lit(0)))


def weekly_checks(totals: DataFrame, mix: DataFrame) -> DataFrame:
    """All measured? Not mostly one country? Not mostly one genre?"""
    shape = mix.groupBy("week").agg(
        F.coalesce(F.sum(F.when((F.col("dimension") == "country") & F.col("value").isin(US_NAMES), F.col("n"))),
                   F.lit(0)).alias("us"),
        F.max(F.when(F.col("dimension") == "genre", F.col("n"))).alias("top_genre"))
    posts = F.col("posts")
    return totals.join(shape, "week").select(
        "week", (posts == F.col("measured")).alias("all_measured"), (F.col("us") * 2 <= posts).alias("countries_mixed"),
        ((posts <= 2) | (F.col("top_genre") * 2 <= posts)).alias("genres_mixed"))


def post_baseline(posts: DataFrame, now: str) -> DataFrame:
    """Average reach of posts of the same kind in the last eight weeks, next to each post."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {TREND_WEEKS * 7} DAYS")
    base = (posts.filter((F.col("state") == "published") & F.col("reach").isNotNull() & (F.col("published_at") >= since))
            .groupBy("kind").agg(F.avg("reach").alias("baseline_avg"), F.count("*").alias("baseline_n")))
    return posts.filter(F.col("state") == "published").join(base, "kind", "left")


def best_of_week(posts: DataFrame, zone: str) -> DataFrame:
    """Most seen measured post of each week, the earlier one on ties."""
    rows = published(posts, zone).filter(F.col("reach").isNotNull())
    return rows.groupBy("week").agg(F.min_by(F.struct("id", "reach"), F.struct(
        -F.col("reach"), "published_at", "id")).alias("b")).select("week", "b.*")


def daily_winners(posts: DataFrame, zone: str, use_reach: bool = True) -> DataFrame:
    """One post per local day: most seen (no reading counts as 0), or the first one.

    A week in which no day had a choice is labelled as picked by time. Reels
    are left out: they are made from the others.
    """
    rows = (published(posts, zone).filter(F.col("kind") != "reel")
            .withColumn("day", local_day(F.col("published_at"), zone)))
    key = ([-F.coalesce("reach", F.lit(0))] if use_reach else []) + [F.col("published_at"), F.col("id")]
    days = rows.groupBy("week", "day").agg(F.count("*").alias("_n"),
                                           F.min_by(F.struct("id", "reach"), F.struct(*key)).alias("_b"))
    chosen = F.max("_n").over(Window.partitionBy("week")) > 1  # seven rows a week
    label = F.when(chosen, "reach").otherwise("recent") if use_reach else F.lit("recent")
    return days.select("week", "day", F.col("_b.id").alias("id"), F.col("_b.reach").alias("reach"), label.alias("picked_by"))


def publish_delays(posts: DataFrame) -> DataFrame:
    """Minutes from slot to publication, and the class of the delay."""
    seconds = F.unix_micros("published_at") - F.unix_micros("scheduled_at")
    late = F.bround(seconds / 60e6).cast("long")
    out = posts.withColumn("minutes", F.when(F.col("state") == "published", late))
    return out.withColumns({
        "shown": F.when(F.col("minutes") > 0, F.concat(F.lit("+"), F.col("minutes"))).when(
            F.col("minutes").isNotNull(), F.lit("on time")),
        "delay": F.when(F.col("state") == "published", F.when(F.col("minutes") <= 10, "normal").otherwise("late"))
        .when(F.col("state").isin("planned", "failed"), "not out")})


# A number in a note, and the unit that makes a single digit a figure.
NOTE_NUMBER = r"(?U)\d+(?:[.,]\d+)?"
NOTE_UNIT = r"[〜～~\-–—ー、,.／/や0-9]*[本枚点件％%倍割]"


def numbers_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NOTE_NUMBER), F.lit(0)),
                                        lambda n: F.replace(n, F.lit(","), F.lit(""))))


def checked_numbers(text: Column) -> Column:
    """Numbers worth checking: two digits or more, or one digit in front of a unit."""
    pattern = F.lit(f"({NOTE_NUMBER})(?=((?:{NOTE_UNIT})?))")
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(text, pattern, F.lit(1)),
                                     lambda n: F.replace(n, F.lit(","), F.lit(""))).alias("n"),
                         F.regexp_extract_all(text, pattern, F.lit(2)).alias("unit"))
    kept = F.filter(pairs, lambda p: (F.length(F.substring_index(p["n"], ".", 1)) >= 2) | (p["unit"] != ""))
    return F.array_distinct(F.transform(kept, lambda p: p["n"]))


def number_audit(notes: DataFrame) -> DataFrame:
    """Numbers a note names that its source does not; such a note is refused."""
    extra = F.array_sort(F.array_except(checked_numbers(F.col("body")), numbers_in(F.col("source"))))
    return notes.withColumn("unsupported", extra).withColumn("refused", F.size("unsupported") > 0)


def note_plain(text: Column) -> Column:
    """Take emphasis and heading marks off; words and numbers stay."""
    bare = F.regexp_replace(text, r"\*\*|__", "")
    lines = F.regexp_replace(F.regexp_replace(bare, r"(?m)^#+[^\S\n]*", ""), r"(?m)^[^\S\n]+(?=#)", "")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")
