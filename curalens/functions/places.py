"""Places: addresses, countries, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from curalens.config import COUNTRY_ALPHA2, COUNTRY_SHORT
from curalens.functions.spans import match_spans

# How addresses are written.
US_ADDRESS = (r"(?U)([0-9][^,\n]{2,60}?),\s*([A-Za-z][A-Za-z .'\-]{1,38}?),?\s+([A-Z]{2})\s+(\d{5})(?:-\d{4})?")
TW_ADDRESS = r"([一-鿿]{1,3}[縣市])([一-鿿]{1,4}[區鄉鎮市])"
TW_LABEL = r"(?U)地址[：:\s]*"
TW_LABEL_REACH = 40


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def us_addresses(text: Column) -> Column:
    """All US addresses in order: ``struct(address, city)``."""
    parts = F.arrays_zip(*[
        F.regexp_extract_all(text, F.lit(US_ADDRESS), F.lit(i)).alias(n)
        for i, n in ((1, "street"), (2, "city"), (3, "state"), (4, "postal"))])
    return F.transform(parts, lambda p: F.struct(
        F.concat(F.trim(p["street"]), F.lit(", "), F.trim(p["city"]), F.lit(", "), p["state"], F.lit(" "),
                 p["postal"]).alias("address"),
        F.trim(p["city"]).alias("city")))


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _only_city(found: Column) -> Column:
    """The first address, provided all of them name one city."""
    cities = F.array_distinct(F.transform(found, lambda a: a["city"]))
    return F.when(F.size(cities) == 1, _first(found))


def pick_address(url: Column, title: Column, text: Column) -> Column:
    """The address of the page itself, not that of the company behind it."""
    found = us_addresses(text)
    slug = F.lower(url)
    in_url = F.filter(found, lambda a: F.contains(slug, F.replace(F.lower(a["city"]), F.lit(" "), F.lit("-"))))
    return F.coalesce(_first(us_addresses(title)), _first(in_url), _only_city(found))


def tw_addresses(text: Column) -> Column:
    """All Taiwanese county + district pairs in order."""
    parts = F.arrays_zip(*[
        F.regexp_extract_all(text, F.lit(TW_ADDRESS), F.lit(i)).alias(n) for i, n in ((1, "city"), (2, "area"))])
    return F.transform(parts, lambda p: F.struct(
        F.translate(F.concat(p["city"], p["area"]), "臺", "台").alias("address"),
        F.translate(p["city"], "臺", "台").alias("city")))


def pick_tw_address(title: Column, text: Column) -> Column:
    """Title, then right after the address label, then the only city of the page."""
    labelled = F.transform(match_spans(text, TW_LABEL), lambda m: _first(
        tw_addresses(F.substring(text, m["stop"] + 1, F.lit(TW_LABEL_REACH)))))
    near = _first(F.filter(labelled, lambda a: a.isNotNull()))
    return F.coalesce(_first(tw_addresses(title)), near, _only_city(tw_addresses(text)))


def country_code(name: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.trim(name), r"^[.,]+|[.,]+$", ""))
    return F.try_element_at(_literal_map(COUNTRY_ALPHA2), clean)


def flag(name: Column) -> Column:
    """The two regional-indicator letters of the code, empty when unknown."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    signs = F.lit("".join(chr(0x1F1E6 + i) for i in range(26)))
    code = country_code(name)
    at = [F.substring(signs, F.instr(letters, F.substring(code, i, 1)), F.lit(1)) for i in (1, 2)]
    return F.coalesce(F.concat(*at), F.lit(""))


def place_label(city: Column, region: Column, country: Column) -> Column:
    """City, region, short country; neighbours that repeat appear once."""
    land = F.trim(country)
    short = F.coalesce(F.try_element_at(_literal_map(COUNTRY_SHORT), F.lower(land)), land)
    parts = F.filter(F.array(F.trim(city), F.trim(region), short), lambda p: p.isNotNull() & (p != ""))
    kept = F.filter(parts, lambda p, i: (i == 0) | (F.lower(F.get(parts, i - 1)) != F.lower(p)))
    return F.array_join(kept, ", ")


def search_address(street: Column, city: Column, region: Column, country: Column, title: Column) -> Column:
    """Address to look up: the parts, or a title that is itself an address."""
    joined = F.array_join(
        F.filter(F.array(street, city, region, country), lambda p: p.isNotNull() & (p != "")), ", ")
    head = F.trim(F.substring_index(title, " - MLS", 1))
    numbered = F.contains(head, F.lit(",")) & F.regexp_extract(head, r"^\S*", 0).rlike(r"^\d+-*$")
    return F.when(F.coalesce(street, F.lit("")) != "", joined).otherwise(
        F.when(numbered, head).otherwise(F.lit("")))


def display_title(display_name: Column, title: Column) -> Column:
    """The short name, else the title up to the listing-number marker."""
    text = F.coalesce(title, F.lit(""))
    cut = (F.when(F.contains(text, F.lit(" - MLS")), F.substring_index(text, " - MLS", 1))
           .when(F.contains(text, F.lit(" – MLS")), F.substring_index(text, " – MLS", 1))
           .when(F.contains(text, F.lit(" | MLS")), F.substring_index(text, " | MLS", 1)).otherwise(text))
    return F.when(F.coalesce(display_name, F.lit("")) != "", display_name).otherwise(cut)
