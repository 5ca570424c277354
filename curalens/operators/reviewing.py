"""What past decisions say about the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.functions.places import display_title
from curalens.functions.ranks import global_row_number
from curalens.functions.stages import settle
from curalens.functions.values import parse_year
from curalens.schemas import SCORE_DETAIL

APPROVED = ["approved", "delivered"]
WORKS, NO_DIFFERENCE = 15, 5
STEP, FLOOR = 20, 0.05  # weights move in steps of 1/20 and keep at least this


def is_approved() -> Column:
    return F.col("status").isin(APPROVED)


def decided(props: DataFrame) -> DataFrame:
    """Scored rows somebody approved or rejected."""
    return props.filter(F.col("score").isNotNull() & F.col("status").isin(*APPROVED, "rejected"))


def parse_detail(props: DataFrame) -> DataFrame:
    """Add the parsed score detail; broken JSON gives NULL, never an error."""
    parsed = F.from_json("score_detail", SCORE_DETAIL, {"mode": "PERMISSIVE"})
    # Settled, so that reading several fields does not parse the text several times.
    whole = settle(props.withColumn("detail", parsed), ["detail"])
    return whole.withColumn("detail", F.when(F.col("detail.axes").isNotNull() | F.col("detail.gate").isNotNull(),
                                             F.col("detail")))


def axis_gap(props: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean raw value of every axis over approved and over rejected rows."""
    yes = is_approved()
    axes = parse_detail(decided(props)).select("status", F.explode("detail.axes").alias("axis")).filter(
        F.coalesce(F.col("axis.key"), F.lit("")) != "")
    raw = F.coalesce(F.col("axis.raw"), F.lit(0.0))
    got = axes.groupBy(F.col("axis.key").alias("key")).agg(
        F.count_if(yes).alias("n_approved"), F.count_if(~yes).alias("n_rejected"),
        F.coalesce(F.avg(F.when(yes, raw)), F.lit(0.0)).alias("approved_mean"),
        F.coalesce(F.avg(F.when(~yes, raw)), F.lit(0.0)).alias("rejected_mean"))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    gap = F.col("gap")
    note = (F.when((F.col("n_approved") == 0) | (F.col("n_rejected") == 0), "too little to compare")
            .when(gap >= WORKS, "works").when(gap <= -WORKS, "works the wrong way")
            .when(F.abs(gap) < NO_DIFFERENCE, "no difference").otherwise("weak"))
    return (got.withColumn("gap", F.col("approved_mean") - F.col("rejected_mean"))
            .withColumn("weight", F.coalesce(F.try_element_at(table, F.col("key")), F.lit(0.0)))
            .withColumn("note", note))


def flag_rate(props: DataFrame) -> DataFrame:
    """Percent of approved and of rejected rows with each flag, and the difference in points."""
    yes = is_approved()
    flags = parse_detail(decided(props)).select("status", F.explode("detail.flags").alias("flag", "value"))
    hit = F.coalesce(F.col("value"), F.lit(False))

    def rate(side: Column) -> Column:
        return F.try_divide(F.count_if(side & hit) * 100.0, F.count_if(side))

    return flags.groupBy("flag").agg(rate(yes).alias("approved_rate"), rate(~yes).alias("rejected_rate")).withColumn(
        "points", F.col("approved_rate") - F.col("rejected_rate"))


def score_spread(props: DataFrame) -> DataFrame:
    """Lowest, middle and highest score by outcome. Scores have one decimal, so the median counts few values."""
    outcome = F.when(is_approved(), "approved").otherwise("rejected")
    return decided(props).groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.median("score").alias("middle"),
        F.max("score").alias("high"))


def precision_at_k(props: DataFrame) -> DataFrame:
    """Percent approved among the K best scores, K being the number of approvals.

    Scores are counted first; only the rows that tie at the cut are ranked by id.
    """
    rows = decided(props).select("id", "score", is_approved().alias("yes"))
    counts = rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if("yes").alias("hits"))
    down = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # One row per distinct score.
    ladder = counts.withColumns({"upto": F.sum("n").over(down), "hits_upto": F.sum("hits").over(down),
                                 "k": F.sum("hits").over(Window.partitionBy())})
    cut = ladder.filter((F.col("upto") - F.col("n") < F.col("k")) & (F.col("upto") >= F.col("k"))).select(
        "score", "k", (F.col("k") - F.col("upto") + F.col("n")).alias("open_places"),
        (F.col("hits_upto") - F.col("hits")).alias("sure_hits"))
    tied = global_row_number(rows.filter(F.col("score") == cut.select("score").scalar()), "score", "id")
    inside = tied.filter(F.col("rn") <= cut.select("open_places").scalar()).agg(F.count_if("yes").alias("more"))
    return (inside.withColumn("k", cut.select("k").scalar())
            .withColumn("hits", F.col("more") + cut.select("sure_hits").scalar())
            .select("k", "hits", (F.try_divide(F.col("hits") * 100.0, F.col("k"))).alias("precision_at_k")))


def missed_high(props: DataFrame) -> DataFrame:
    """Rejected rows that score above the median of the approved."""
    rows = decided(props)
    middle = rows.filter(is_approved()).agg(F.median("score").alias("m")).select("m").scalar()
    return rows.filter(~is_approved()).agg(F.count_if(F.col("score") > middle).alias("missed_high"))


def gate_kinds(props: DataFrame) -> DataFrame:
    """Approved rows that a gate had put to zero, by kind of gate and story value."""
    gate = F.col("detail.gate")
    kind = F.when(gate.startswith("story="), "story_min").when(gate.startswith("築年"), "built_before").otherwise(gate)
    story = F.when(gate.startswith("story="), F.regexp_extract(gate, r"^story=(\S*)", 1)).try_cast("double")
    return (parse_detail(decided(props).filter(is_approved())).filter(F.coalesce(gate, F.lit("")) != "")
            .groupBy(kind.alias("kind"), story.alias("story")).agg(F.count("*").alias("n")))


def approved_mix(props: DataFrame) -> DataFrame:
    """Approved rows by genre, source, rank, decade and country, in one pass."""
    year = parse_year(F.col("year_built"))
    dims = decided(props).filter(is_approved()).select(
        F.coalesce(F.nullif("genre", F.lit("")), F.lit("unknown")).alias("genre"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("source_rank", F.lit("unknown")).alias("rank"),
        F.coalesce((F.floor(year / 10) * 10).cast("string"), F.lit("unknown")).alias("decade"),
        F.coalesce(F.nullif(F.trim("location_country"), F.lit("")), F.lit("unknown")).alias("country"))
    names = dims.columns
    got = dims.groupingSets([[c] for c in names], *names).agg(F.count("*").alias("n"))
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])
    return got.select(which.alias("dimension"), F.coalesce(*names).alias("value"), "n")


def columns_filled(props: DataFrame, columns: list[str]) -> DataFrame:
    """How many decided rows have each judgement stored in its column."""
    return decided(props).agg(F.count("*").alias("reviewed"), *[F.count(c).alias(c) for c in columns])


def weight_proposal(gaps: DataFrame) -> DataFrame:
    """Half way from today's weights to weights in proportion to the gaps.

    Works on the axis table (one row per axis): axes without comparison keep
    their weight, the rest share what they have together, in steps, and the
    rounding rest goes to the axis that separates best.
    """
    whole = Window.partitionBy()
    ranked = Window.orderBy(F.col("gap").desc(), "key")
    usable = gaps.filter((F.col("n_approved") > 0) & (F.col("n_rejected") > 0)).select("key", "gap", "weight")
    base = usable.withColumns({"budget": F.sum("weight").over(whole), "good": F.greatest("gap", F.lit(0.0))})
    base = base.withColumn("total", F.sum("good").over(whole)).filter((F.col("total") > 0) & (F.col("budget") > 0))

    def stepped(x: Column) -> Column:
        return F.bround(x * STEP) / STEP

    half = base.withColumn("fresh", F.greatest(
        stepped((F.col("weight") + F.col("good") / F.col("total") * F.col("budget")) / 2), F.lit(FLOOR)))
    scaled = half.withColumn("fresh", stepped(F.col("fresh") / F.sum("fresh").over(whole) * F.col("budget")))
    rest = F.col("budget") - F.sum("fresh").over(whole)
    return (scaled.withColumn("rest", rest).withColumn("place", F.row_number().over(ranked))
            .select("key", "gap", "weight", F.when(F.col("place") == 1, F.bround(F.col("fresh") + F.col("rest"), 2))
                    .otherwise(F.col("fresh")).alias("proposed")))


def review_examples(props: DataFrame, limit: int = 12) -> DataFrame:
    """The best approved rows, with what makes them readable."""
    return (decided(props).filter(is_approved()).orderBy(F.col("score").desc(), "id").limit(limit)
            .select("id", "score", display_title(F.col("display_name"), F.col("title")).alias("name"),
                    F.coalesce("genre", F.lit("unknown")).alias("genre"), "style_name", "location_city"))


def review_totals(props: DataFrame) -> DataFrame:
    """Approved, rejected, pending, without detail, and approved in spite of a gate."""
    rows = parse_detail(props.filter(F.col("score").isNotNull()))
    known = F.col("status").isin(*APPROVED, "rejected")
    return rows.agg(
        F.count_if(is_approved()).alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(~known).alias("pending"), F.count_if(known & F.col("detail").isNull()).alias("no_detail"),
        F.count_if(is_approved() & (F.coalesce(F.col("detail.gate"), F.lit("")) != "")).alias("approved_gated"))
