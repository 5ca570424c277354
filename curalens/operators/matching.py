"""Which page belongs to which listing, source or domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.config import GENERIC_WORDS
from curalens.functions.stages import settle
from curalens.functions.urls import authority, host_of, host_suffixes, no_fragment

MATCH_MIN = 2
LONG_WORD = 6


def url_domain_join(urls: DataFrame, domains: DataFrame, url: str, keep: bool = True) -> DataFrame:
    """Rows whose host is a listed domain or below one (or the rows that are not).

    Sub-domain matching is an equality join on host suffixes, made for distinct
    hosts only: however many rows a host has, it is looked up once.
    """
    rows = urls.withColumn("_host", host_of(F.col(url)))
    parts = rows.select("_host").distinct().select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
    hit = parts.join(domains.select("domain"), "domain", "left_semi").select("_host").distinct()
    return rows.join(hit, "_host", "left_semi" if keep else "left_anti").drop("_host")


def listed_hosts(rows: DataFrame, domains: DataFrame, urls: list[str]) -> DataFrame:
    """Distinct hosts (``host``) of the URL columns that are one of the domains or below one."""
    hosts = rows.select(F.explode(F.array(*[host_of(F.col(u)) for u in urls])).alias("host")).filter("host IS NOT NULL").distinct()
    parts = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    return parts.join(domains.select("domain"), "domain", "left_semi").select("host").distinct()


def blocked_domains(configured: DataFrame, sources: DataFrame) -> DataFrame:
    """Domains that are never opened: the configured ones and the manual-only sources."""
    manual = sources.filter((F.col("mode") == "manual_only") & (host_of(F.col("base_url")) != "")).select(
        host_of(F.col("base_url")).alias("domain"))
    return configured.select(F.lower("domain").alias("domain")).union(manual).distinct()


def source_by_domain(urls: DataFrame, sources: DataFrame, ident: str = "id", url: str = "url") -> DataFrame:
    """First source, listing sites before editorial ones, whose domain covers the URL; else ``manual``."""
    order = F.struct((F.col("kind") != "listing"), "ordinal")
    base = sources.filter(F.col("base_url").isNotNull()).select(
        F.regexp_replace(authority(F.col("base_url")), r"^www\.", "").alias("domain"), F.col("key").alias("source"),
        F.col("rank").alias("source_rank"), order.alias("_order")).filter(F.col("domain") != "")
    rows = urls.withColumn("_host", F.regexp_replace(authority(F.col(url)), r"^www\.", ""))
    parts = rows.select("_host").distinct().select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
    best = parts.join(base, "domain").groupBy("_host").agg(F.min_by(F.struct("source", "source_rank"), "_order").alias("_s"))
    return (rows.join(best, "_host", "left").withColumns({
        "source": F.coalesce("_s.source", F.lit("manual")), "source_rank": F.col("_s.source_rank")}).drop("_s", "_host"))


def lookup_source(props: DataFrame, sources: DataFrame) -> DataFrame:
    names = sources.select(F.col("key").alias("source"), F.col("name").alias("source_name"), "mode")
    return props.join(names, "source", "left").withColumn("source_name", F.coalesce("source_name", "source"))


def status_urls(props: DataFrame, blocked: DataFrame) -> DataFrame:
    """Page to check for the sale status: listing page if allowed, else article, else none."""
    names = ["listing_url", "source_url"]
    closed = listed_hosts(props, blocked, names)
    rows, free = props, []
    for name in names:
        mark = closed.select(F.col("host").alias(f"_{name}_host"), F.lit(True).alias(f"_{name}_closed"))
        rows = rows.withColumn(f"_{name}_host", host_of(F.col(name))).join(mark, f"_{name}_host", "left")
        free.append(F.when(F.col(name).startswith("http") & F.col(f"_{name}_closed").isNull(), F.col(name)))
    return rows.withColumn("check_url", F.coalesce(*free)).drop(*[f"_{n}_{x}" for n in names for x in ("host", "closed")])


def words(text: Column) -> Column:
    """Distinct runs of letters a-z and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def identity_terms(props: DataFrame) -> DataFrame:
    """What names this listing and no other: a street number and distinctive words of three characters or more, each text read once."""
    said = F.lower(F.concat_ws(" ", "display_name", "title", "street_address"))
    kept = F.array_distinct(F.regexp_extract_all(said, F.lit(r"(?<![a-z0-9])(?=[a-z0-9]{3})[0-9]*[a-z][a-z0-9]*"), F.lit(0)))
    number = F.regexp_extract(F.lower(F.col("street_address")), r"(?<![a-z0-9])([0-9]{3,})(?![a-z0-9])", 1)
    return props.withColumns({"street_number": F.nullif(number, F.lit("")),
                              "terms": F.array_except(kept, F.array(*[F.lit(w) for w in GENERIC_WORDS]))})


def page_match(props: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that really name their listing, with their points.

    A hit already knows its listing, so this is one equality join. A listing brings its terms with their points,
    a hit its words in one text with a space around each; points are one pass over the terms.
    """
    def spaced(word: Column) -> Column:
        return F.concat(F.lit(" "), word, F.lit(" "))

    own = identity_terms(props)
    number = F.filter(F.array(F.struct(spaced(F.col("street_number")).alias("term"), F.lit(2).alias("points"))), lambda t: t["term"].isNotNull())
    named = F.transform("terms", lambda w: F.struct(spaced(w).alias("term"), F.when(F.length(w) >= LONG_WORD, 2).otherwise(1).alias("points")))
    own = settle(own.select(F.col("id").alias("property_id"), F.concat(number, named).alias("_terms")), ["_terms"])
    # Words are cut after the join, once per hit that has a listing, so they don't move beside the texts they come from.
    said = spaced(F.regexp_replace(F.lower(F.concat_ws(" ", "url", "title")), "[^a-z0-9]+", " "))
    cut = settle(hits.join(own, "property_id").withColumn("_said", said), ["_said"])
    points = F.aggregate("_terms", F.lit(0), lambda acc, t: acc + F.when(F.contains(F.col("_said"), t["term"]), t["points"]).otherwise(0))
    # Points are settled: the filter above must not have them computed a second time.
    return (settle(cut.withColumn("points", points), ["points"])
            .filter(F.col("points") >= MATCH_MIN).drop("_said", "_terms"))


def usable_pages(hits: DataFrame, known: DataFrame, blocked: DataFrame, *, per_domain: int = 2,
                 per_property: int = 6) -> DataFrame:
    """Pages to open, in order: new, not blocked, a few per site, a few per listing.

    The per-site limit applies before the per-listing limit. Hits and known pages move once, by listing; what
    follows stays in that order. ``blocked`` is a setting, so it comes as one array: few hosts hold most
    pages, and rows dealt by host would meet in a few tasks.
    """
    clean = hits.filter(F.ltrim("url").startswith("http")).select(
        "property_id", no_fragment(F.col("url")).alias("url"), "position", F.lit(False).alias("_seen"))
    seen = known.filter(F.col("url").isNotNull() & F.col("property_id").isNotNull()).select(
        "property_id", no_fragment(F.col("url")).alias("url"), F.lit(None).cast(hits.schema["position"].dataType).alias("position"),
        F.lit(True).alias("_seen"))
    first = (clean.unionByName(seen).repartition("property_id").groupBy("property_id", "url")
             .agg(F.min("position").alias("position"), F.bool_or("_seen").alias("_seen")).filter(~F.col("_seen")).drop("_seen"))
    closed = blocked.agg(F.collect_set("domain").alias("x")).select("x").scalar()
    allowed = settle(first.withColumn("host", host_of(F.col("url"))), ["host"]).filter(
        ~F.arrays_overlap(host_suffixes(F.col("host")), closed))
    by_site = Window.partitionBy("property_id", "host").orderBy("position", "url")
    by_listing = Window.partitionBy("property_id").orderBy("position", "url")
    return (allowed.withColumn("_s", F.row_number().over(by_site)).filter(F.col("_s") <= per_domain).drop("_s")
            .withColumn("place", F.row_number().over(by_listing)).filter(F.col("place") <= per_property))


def search_query(props: DataFrame) -> DataFrame:
    """Text to search a listing by: name, street, city."""
    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))
    name = F.coalesce(filled(F.col("display_name")), filled(F.col("title")))
    return props.withColumn("query", F.trim(F.concat_ws(" ", name, filled(F.col("street_address")),
                                                        filled(F.col("location_city")))))
