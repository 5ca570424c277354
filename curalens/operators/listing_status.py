"""Sale status and listing number as a page states them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How a page says whether a listing is still for sale.
AVAILABILITY = r'(?iU)"availability"\s*:\s*"(?:https?://schema\.org/)?([A-Za-z]+)"'
AVAILABILITY_STATUS = {
    "instock": "active", "onlineonly": "active", "limitedavailability": "active", "preorder": "pending",
    "backorder": "pending", "soldout": "sold", "outofstock": "off_market", "discontinued": "off_market",
}
LABEL = (r"(?iU)(?:listing[_\s-]*)?status\W{0,12}?(active|for\s+sale|pending|contingent|under\s+contract|sold|closed|"
         r"withdrawn|expired|off[\s-]?market|coming\s+soon)\b")
LABEL_STATUS = {
    "active": "active", "for sale": "active", "coming soon": "pending", "pending": "pending", "contingent": "pending",
    "under contract": "pending", "sold": "sold", "closed": "sold", "withdrawn": "off_market", "expired": "off_market",
    "off market": "off_market", "off-market": "off_market",
}
PHRASES = [
    (r"(?iU)no longer (?:available|on the market|for sale)", "off_market"),
    (r"(?iU)this (?:listing|property) (?:has been|was) removed", "off_market"),
    (r"(?iU)listing (?:has )?expired", "off_market"),
    (r"(?iU)(?:sale|sold)\s+pending", "pending"),
    (r"(?iU)under\s+contract", "pending"),
    (r"(?iU)(?:just|recently)\s+sold", "sold"),
    (r"(?iU)\bsold\s+(?:on|for)\b", "sold"),
]
MLS = r"(?iU)MLS\s*(?:®|\(r\))?\s*(?:#|no\.?|number|id)?\s*[:#]?\s*([A-Z]{0,3}[0-9]{5,12}[A-Z]?)"
GONE = [404, 410]


def _found(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 0), F.lit(""))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def listing_status(html: Column, http_status: Column) -> Column:
    """``struct(value, evidence)``: structured data, labelled status, phrases, in that order."""
    def answer(value: Column, label: str, pattern: str) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("value"), F.concat(
            F.lit(label), _found(html, pattern)).alias("evidence")))

    gone = F.when(http_status.isin(GONE), F.struct(F.lit("off_market").alias("value"), F.concat(
        F.lit("gone: "), http_status).alias("evidence")))
    stated = F.try_element_at(_map(AVAILABILITY_STATUS), F.lower(F.regexp_extract(html, AVAILABILITY, 1)))
    word = F.lower(F.regexp_replace(F.regexp_extract(html, LABEL, 1), r"(?U)\s+", " "))
    labelled = F.try_element_at(_map(LABEL_STATUS), word)
    spoken = [answer(F.when(_found(html, p).isNotNull(), F.lit(v)), "text: ", p) for p, v in PHRASES]
    unknown = F.struct(F.lit("unknown").alias("value"), F.lit("").alias("evidence"))
    return F.coalesce(gone, answer(stated, "data: ", AVAILABILITY), answer(labelled, "label: ", LABEL), *spoken, unknown)


def mls_number(html: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(html, MLS, 1)), F.lit(""))
