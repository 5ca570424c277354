"""Settings of the curation workflow.

Fixed values: the lists and numbers below are data the results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Currency marks, most specific first.
CURRENCY_MARKS = [
    ("NT$", "TWD"), ("US$", "USD"), ("A$", "AUD"), ("C$", "CAD"), ("HK$", "HKD"), ("€", "EUR"),
    ("£", "GBP"), ("¥", "JPY"), ("￥", "JPY"), ("$", "USD"), ("USD", "USD"), ("EUR", "EUR"),
    ("GBP", "GBP"), ("JPY", "JPY"), ("TWD", "TWD"),
]

# Yen per unit of currency when no stored rate exists.
FALLBACK_JPY_PER = {
    "JPY": 1.0, "USD": 150.0, "EUR": 165.0, "GBP": 195.0, "AUD": 100.0, "CAD": 110.0, "HKD": 19.0, "TWD": 4.7,
}

# Phrases that say a thing is on sale, and how prices are written.
SALE_KEYWORDS = [
    "for sale", "on the market", "listed for", "listing at", "hits the market", "comes to market",
    "is asking", "now asking", "asking price", "now available", "currently listed", "販売中", "売出中",
]
PRICE_PATTERNS = [
    r"[$€£]\s?\d[\d,.]*\s?(million|M|k)?\b",
    r"\d[\d,.]*\s?(万円|億円)",
    r"price\s+(on|upon)\s+(application|request)",
]
LISTING_DOMAINS = [
    "sothebysrealty.com", "christiesrealestate.com", "architectureforsale.com", "zillow.com", "redfin.com",
    "compass.com", "idealista.com", "idealista.pt", "rightmove.co.uk", "themodernhouse.com", "inigo.com",
    "knightfrank.co.uk", "knightfrank.com", "savills.com", "savills.co.uk", "struttandparker.com",
    "onthemarket.com", "zoopla.co.uk", "douglaselliman.com", "elliman.com", "corcoran.com", "realtor.com",
    "trulia.com", "coldwellbankerhomes.com", "christiesinternationalrealestate.com", "circaoldhouses.com",
    "landvest.com", "engelvoelkers.com", "jamesedition.com",
]
BLOCKED_DOMAINS = [
    "zillow.com", "redfin.com", "compass.com", "realtor.com", "trulia.com", "sothebysrealty.com",
    "christiesrealestate.com",
]

# Genres, best first, and axis weights of the score.
GENRE_PRIORITY = ["architect", "adaptive_reuse", "hidden_gem", "penthouse", "loft"]
AXIS_WEIGHTS = {
    "story": 0.25, "style": 0.15, "one_of_a_kind": 0.15, "genre": 0.15, "source": 0.10, "for_sale": 0.10,
    "area": 0.05, "price": 0.05,
}
RANK_SCORE = {"S": 1.0, "A": 0.7, "B": 0.4}
FOCUS_COUNTRIES = ["United States", "Portugal", "Spain", "Taiwan"]
FEEDBACK_TAGS = [
    "no_visible_provenance", "style_unclear", "not_one_of_a_kind", "not_for_sale", "image_quality", "duplicate",
    "area_mismatch", "other",
]

# Words that name no single property.
GENERIC_WORDS = [
    "home", "homes", "house", "residence", "property", "properties", "estate", "real", "listing", "listings",
    "for", "sale", "sold", "photo", "photos", "the", "and", "with", "this", "that", "from", "your", "new", "old",
    "street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "lane", "ln", "court", "ct", "place", "pl",
    "boulevard", "blvd", "way", "circle", "north", "south", "east", "west", "n", "s", "e", "w", "unit", "apt",
    "modern", "midcentury", "century", "mid", "design", "architecture", "tour", "video", "watch", "trailer",
    "movie", "film",
]

# Country name to ISO 3166-1 alpha-2.
COUNTRY_ALPHA2 = {
    "united states": "US", "united states of america": "US", "usa": "US", "us": "US", "america": "US",
    "portugal": "PT", "spain": "ES", "españa": "ES", "taiwan": "TW", "france": "FR", "mexico": "MX",
    "united kingdom": "GB", "uk": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "northern ireland": "GB", "italy": "IT", "germany": "DE", "netherlands": "NL", "the netherlands": "NL",
    "belgium": "BE", "switzerland": "CH", "austria": "AT", "denmark": "DK", "sweden": "SE", "norway": "NO",
    "finland": "FI", "iceland": "IS", "ireland": "IE", "greece": "GR", "poland": "PL", "czechia": "CZ",
    "czech republic": "CZ", "hungary": "HU", "croatia": "HR", "slovenia": "SI", "romania": "RO",
    "bulgaria": "BG", "estonia": "EE", "latvia": "LV", "lithuania": "LT", "luxembourg": "LU", "malta": "MT",
    "cyprus": "CY", "turkey": "TR", "türkiye": "TR", "russia": "RU", "ukraine": "UA", "canada": "CA",
    "brazil": "BR", "argentina": "AR", "chile": "CL", "colombia": "CO", "peru": "PE", "uruguay": "UY",
    "costa rica": "CR", "japan": "JP", "日本": "JP", "china": "CN", "hong kong": "HK", "south korea": "KR",
    "korea": "KR", "singapore": "SG", "thailand": "TH", "vietnam": "VN", "indonesia": "ID", "malaysia": "MY",
    "philippines": "PH", "india": "IN", "australia": "AU", "new zealand": "NZ", "south africa": "ZA",
    "morocco": "MA", "egypt": "EG", "israel": "IL", "united arab emirates": "AE", "uae": "AE", "lebanon": "LB",
    "sri lanka": "LK",
}
COUNTRY_SHORT = {"united states": "USA", "united states of america": "USA", "united kingdom": "UK"}


@dataclass(frozen=True)
class SignalConfig:
    keywords: list[str] = field(default_factory=lambda: list(SALE_KEYWORDS))
    price_patterns: list[str] = field(default_factory=lambda: list(PRICE_PATTERNS))
    listing_domains: list[str] = field(default_factory=lambda: list(LISTING_DOMAINS))
    keyword_score: int = 1
    price_score: int = 1
    link_score: int = 1
    min_score: int = 2
    window: int = 200


@dataclass(frozen=True)
class ScoreConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(AXIS_WEIGHTS))
    rank_score: dict[str, float] = field(default_factory=lambda: dict(RANK_SCORE))
    genres: list[str] = field(default_factory=lambda: list(GENRE_PRIORITY))
    focus_countries: list[str] = field(default_factory=lambda: list(FOCUS_COUNTRIES))
    focus_cities: list[str] = field(default_factory=list)
    story_floor: int = 40
    built_before: int | None = 2000
    low_below: float = 30.0
    high_from: float = 80.0
    summary_max_chars: int = 80


@dataclass(frozen=True)
class PostConfig:
    zone: str = "Asia/Tokyo"
    post_times: list[str] = field(default_factory=lambda: ["09:00", "13:00", "20:00"])
    plan_days: int = 3
    story_delay_minutes: int = 5
    reel_weekday: int = 0
    reel_time: str = "19:00"
    max_attempts: int = 3
    carousel_max: int = 10


@dataclass(frozen=True)
class ImageConfig:
    max_per_property: int = 10
    min_short_edge: int = 640
    flat_stddev_max: float = 3.0
    allowed_mime: list[str] = field(default_factory=lambda: ["image/jpeg", "image/png", "image/webp"])
    pages_per_property: int = 6
    pages_per_domain: int = 2
    probe_images: int = 2
    lookup_price_usd: float = 0.0035


# Weekly report.
TREND_WEEKS = 8
MIN_PAIR = 2
MIN_GROUP = 3
MIN_TOTAL = 6
LIFT_TREND = 1.15
LIFT_HINT = 1.05
TOP_INSIGHTS = 4
