"""Images as metadata: what is kept, in which order, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from curalens.config import ImageConfig
from curalens.functions.ranks import grouped_place, sorted_place
from curalens.operators.lists import under_quota
from curalens.operators.matching import page_match, usable_pages


def image_accept(meta: DataFrame, cfg: ImageConfig = ImageConfig()) -> DataFrame:
    """Reason why an image is left out, or NULL. Flat images matter on foreign pages only."""
    reason = (F.when(F.col("mime").isNull() | F.col("width").isNull(), "broken")
              .when(~F.col("mime").isin(cfg.allowed_mime), "wrong_type")
              .when(F.least("width", "height") < cfg.min_short_edge, "too_small")
              .when(F.col("origin_url").isNotNull() & (F.col("stddev") < cfg.flat_stddev_max), "flat"))
    return meta.withColumn("skip_reason", reason)


def image_positions(current: DataFrame, fresh: DataFrame, cap: int = 10) -> DataFrame:
    """Give new images the next positions of their listing, up to the cap; the others stay without one, with a reason."""
    have = current.groupBy("property_id").agg(F.max("position").alias("_max"), F.count("*").alias("_n"))
    ranked = grouped_place(fresh, ["property_id"], ["arrival", "source_url"], "_rn")
    fits = F.col("_rn") <= cap - F.coalesce("_n", F.lit(0))
    return (ranked.join(have, "property_id", "left")
            .withColumns({"position": F.when(fits, (F.coalesce("_max", F.lit(0)) + F.col("_rn")).cast("int")),
                          "reason": F.when(~fits, "over limit")}).drop("_max", "_n", "_rn"))


def image_order(posts: DataFrame, images: DataFrame, cap: int = 10) -> DataFrame:
    """Order of the images of a post: the chosen ones first, then the rest by position.

    A post meets the ``cap`` first positions of its listing and those it chose, not all of them.
    """
    chosen = F.transform(F.split("image_order", ","), lambda x: F.trim(x).try_cast("int"))
    have = images.select("property_id", "position").distinct()
    by_position = Window.partitionBy("property_id").orderBy("position")
    low = have.withColumn("_rn", F.row_number().over(by_position)).filter(F.col("_rn") <= cap).drop("_rn")
    wanted = posts.select("id", "property_id", chosen.alias("_chosen"))
    picked = wanted.withColumn("position", F.explode(F.array_distinct("_chosen"))).join(have, ["property_id", "position"], "left_semi")
    rest = wanted.join(low, "property_id").filter(~F.coalesce(F.array_contains("_chosen", F.col("position")), F.lit(False)))
    pairs = rest.unionByName(picked)
    place = F.coalesce(F.nullif(F.array_position("_chosen", F.col("position")), F.lit(0)), F.lit(2 ** 31))
    order = Window.partitionBy("id").orderBy(place, "position")
    return (pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)
            .select("id", "property_id", "position", "place"))


def folder_sequence(deliveries: DataFrame, fresh: DataFrame, prefix: str = "lot", digits: int = 9) -> DataFrame:
    """Number new folders on from the highest number ever used."""
    number = F.regexp_replace("folder_name", r"\D", "").try_cast("long")
    last = deliveries.agg(F.coalesce(F.max(number), F.lit(0)).alias("n")).select("n").scalar()
    ranked = sorted_place(fresh, ["property_id"], "_rn")
    return ranked.withColumn("folder_name", F.concat(
        F.lit(prefix), F.lpad((last + F.col("_rn")).cast("string"), digits, "0"))).drop("_rn")


def photoless(props: DataFrame, images: DataFrame, cfg: ImageConfig = ImageConfig()) -> DataFrame:
    """Undelivered listings whose lead image is missing or flat."""
    lead = images.groupBy("property_id").agg(F.min(F.struct("position", "source_url", "stddev")).alias("_l")).select(
        F.col("property_id").alias("id"), F.col("_l.stddev").alias("lead_stddev"), F.lit(True).alias("_has"))
    return (props.filter(F.col("status") != "delivered").join(lead, "id", "left")
            .filter(F.col("_has").isNull() | (F.col("lead_stddev") < cfg.flat_stddev_max))
            .withColumn("why", F.when(F.col("_has").isNull(), "no image").otherwise("flat")).drop("_has"))


def probe_urls(images: DataFrame, limit: int = 2) -> DataFrame:
    """First public image URLs of every listing."""
    order = Window.partitionBy("property_id").orderBy("position", "source_url")
    return (images.filter(F.col("source_url").startswith("http")).withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= limit))


def undo_fill(images: DataFrame) -> DataFrame:
    """Images that stay when those from other pages are taken back."""
    return images.filter(F.col("origin_url").isNull())


def visited_origins(images: DataFrame) -> DataFrame:
    return images.filter(F.col("origin_url").isNotNull()).select("property_id", F.col("origin_url").alias("url")).distinct()


def already_have(candidates: DataFrame, images: DataFrame, skips: DataFrame) -> DataFrame:
    """Per candidate URL of a listing: taken already, skipped before, or new."""
    key = ["property_id", "source_url"]
    got = images.select(*key).distinct().withColumn("_got", F.lit(True))
    out = skips.select(*key).distinct().withColumn("_out", F.lit(True))
    state = F.when(F.col("_got"), "taken").when(F.col("_out"), "skipped before").otherwise("new")
    return (candidates.join(got, key, "left").join(out, key, "left").withColumn("state", state).drop("_got", "_out"))


def fill_plan(props: DataFrame, images: DataFrame, hits: DataFrame, blocked: DataFrame,
              cfg: ImageConfig = ImageConfig()) -> DataFrame:
    """Pages to open for listings that lack images, and how many images each needs."""
    short = under_quota(props, images, cfg.max_per_property).select(
        F.col("id").alias("property_id"), (F.lit(cfg.max_per_property) - F.col("image_count")).alias("need"))
    known = props.select(F.col("id").alias("property_id"), F.explode(F.array("source_url", "listing_url")).alias("url"))
    known = known.unionByName(visited_origins(images))
    wanted = props.join(short.select(F.col("property_id").alias("id")), "id", "left_semi")
    pages = usable_pages(page_match(wanted, hits), known, blocked, per_domain=cfg.pages_per_domain,
                         per_property=cfg.pages_per_property)
    return pages.join(short, "property_id")

