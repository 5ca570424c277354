"""Score of a listing: weighted axes behind a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curalens.config import ScoreConfig
from curalens.functions.values import parse_year
from curalens.operators.reviewing import parse_detail


def clean_assessment(assessed: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Clamp the story value, replace an unknown genre, fill what is missing."""
    known = [*cfg.genres, "unknown"]
    genre = F.when(F.col("genre").isin(known), F.col("genre")).otherwise("unknown")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("style_identified", "one_of_a_kind", "provenance_visible",
                                                       "is_for_sale") if c in assessed.columns}
    texts = {c: F.coalesce(c, F.lit("")) for c in ("city", "country", "price", "year_built", "summary", "story_reason",
                                                    "display_name", "architect", "provenance_note") if c in assessed.columns}
    story = F.greatest(F.least(F.coalesce("story_score", F.lit(0)), F.lit(100)), F.lit(0))
    return assessed.withColumns({"story_score": story, "genre": genre} | flags | texts)


def assess_listings(props: DataFrame, assessed: DataFrame, sources: DataFrame,
                    cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Listings with their judgement and whether their source is a listing site."""
    facts = props.select("id", "source", "source_rank", F.col("is_for_sale").alias("signal_for_sale"),
                         "location_city", "location_country", F.col("price").alias("stored_price"))
    listing = sources.filter(F.col("kind") == "listing").select(F.col("key").alias("source"),
                                                                F.lit(True).alias("from_listing_site"))
    return (clean_assessment(assessed, cfg).withColumnRenamed("property_id", "id").join(facts, "id")
            .join(listing, "source", "left"))


def _axis(key: str, raw: Column, cfg: ScoreConfig, reason: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), raw.cast("double").alias("raw"),
                    F.lit(float(cfg.weights[key])).alias("weight"), reason.alias("reason"))


def _either(first: str, second: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(F.col(first), F.lit("")), F.col(second), F.lit(""))))


def score_axes(rows: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Add ``axes``: eight raw values from 0 to 100 with weight and reason."""
    span = max(len(cfg.genres) - 1, 1)
    genre = F.lit(20.0)
    for rank, name in enumerate(cfg.genres):
        genre = F.when(F.col("genre") == name, F.lit(100.0 - 50.0 * rank / span)).otherwise(genre)
    rank_raw = F.lit(0.0)
    for name, ratio in cfg.rank_score.items():
        rank_raw = F.when(F.col("source_rank") == name, F.lit(ratio * 100.0)).otherwise(rank_raw)
    both = F.coalesce(F.col("signal_for_sale"), F.lit(False)).cast("int") + F.col("is_for_sale").cast("int")
    site = F.coalesce(F.col("from_listing_site"), F.lit(False))
    for_sale = F.when(site, 0).when(both == 2, 100).when(both == 1, 50).otherwise(0)
    city, country = _either("city", "location_city"), _either("country", "location_country")
    wanted = (country.isin([c.lower() for c in cfg.focus_countries])
              | city.isin([c.lower() for c in cfg.focus_cities] or ["\u0000"]))
    area = F.when((city == "") & (country == ""), 50).when(wanted, 100).otherwise(20)
    price = F.trim(F.coalesce(F.nullif(F.col("price"), F.lit("")), F.col("stored_price"), F.lit("")))
    return rows.withColumn("axes", F.array(
        _axis("story", F.col("story_score"), cfg, F.col("story_reason")),
        _axis("style", F.when(F.col("style_identified"), 100).otherwise(0), cfg,
              F.when(F.col("style_identified"), "style known").otherwise("style unknown")),
        _axis("one_of_a_kind", F.when(F.col("one_of_a_kind"), 100).otherwise(0), cfg,
              F.when(F.col("one_of_a_kind"), "single piece").otherwise("may exist more than once")),
        _axis("source", rank_raw, cfg, F.concat("source", F.lit("("), F.coalesce("source_rank", F.lit("?")), F.lit(")"))),
        _axis("for_sale", for_sale, cfg, F.when(site, "listing site").when(both == 2, "signal and judgement")
              .when(both == 1, "one of two").otherwise("nothing")),
        _axis("genre", genre, cfg, F.col("genre")),
        _axis("area", area, cfg, F.when((city == "") & (country == ""), "place unknown")
              .when(wanted, "in focus").otherwise("out of focus")),
        _axis("price", F.when(price == "", 0).otherwise(100), cfg,
              F.when(price == "", "no price").otherwise(F.substring(price, 1, 20)))))


def gate_text(cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Reason for a zero, or an empty text."""
    year = parse_year(F.col("year_built"))
    low = ((F.col("story_score") < cfg.story_floor) & ~F.col("style_identified") & ~F.col("one_of_a_kind"))
    text = F.when(low, F.concat(F.lit("story="), F.col("story_score"), F.lit(f" < {cfg.story_floor}")))
    if cfg.built_before is not None:
        text = text.when(year >= cfg.built_before, F.concat(F.lit("築年 "), year, F.lit(f" ≧ {cfg.built_before}")))
    return text.otherwise("")


def total_of(axes: Column, gate: Column) -> Column:
    summed = F.aggregate(axes, F.lit(0.0), lambda acc, a: acc + a["raw"] * a["weight"])
    return F.when(gate != "", F.lit(0.0)).otherwise(F.round(summed, 1))


def score_listings(props: DataFrame, assessed: DataFrame, sources: DataFrame,
                   cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Axes, gate, total and the detail to store, for every assessed listing."""
    rows = score_axes(assess_listings(props, assessed, sources, cfg), cfg).withColumn("gate", gate_text(cfg))
    flags = F.struct("provenance_visible", "style_identified", "one_of_a_kind", F.col("is_for_sale").alias("llm_is_for_sale"))
    note = F.col("provenance_note") if "provenance_note" in rows.columns else F.lit("")
    return (rows.withColumn("score", total_of(F.col("axes"), F.col("gate")))
            .withColumn("score_detail", F.to_json(F.struct("gate", "axes", flags.alias("flags"), note.alias("provenance_note")))))


def rescore(props: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Totals from the stored axes under new weights. Row-local: no shuffle."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    summed = F.aggregate("detail.axes", F.lit(0.0), lambda acc, a: acc + a["raw"] * F.coalesce(
        F.try_element_at(table, a["key"]), F.lit(0.0)))
    rows = parse_detail(props).filter(F.col("detail.axes").isNotNull())
    return rows.withColumn("new_score", F.when(F.coalesce(F.col("detail.gate"), F.lit("")) != "", F.lit(0.0))
                           .otherwise(F.round(summed, 1)))


def judgement(props: DataFrame) -> DataFrame:
    """Why a listing was chosen: the story reason, else the first reason there is; and its marks."""
    axes = F.col("detail.axes")

    def first_reason(kept: Column) -> Column:
        return F.get(F.transform(kept, lambda a: a["reason"]), F.lit(0))

    story = first_reason(F.filter(axes, lambda a: (a["key"] == "story") & (a["reason"] != "")))
    other = first_reason(F.filter(axes, lambda a: F.coalesce(a["reason"], F.lit("")) != ""))
    marks = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in (
        "style_identified", "one_of_a_kind", "provenance_visible")]))
    return parse_detail(props).withColumns({"judgement": F.coalesce(story, other, F.lit("")), "marks": marks})


def score_run_stats(scored: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    return scored.agg(
        F.count("*").alias("scored"), F.count_if(F.col("score") < cfg.low_below).alias("below"),
        F.count_if(F.col("score") >= cfg.high_from).alias("highlighted"),
        F.count_if(F.length("summary") > cfg.summary_max_chars).alias("long_summaries"))
