"""Numbers hidden in text: prices, years, areas, rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from curalens.config import CURRENCY_MARKS
from curalens.functions.patterns import plain_digits

NUMBER = r"(?U)\d[\d,]*(?:\.\d+)?"
YEAR = r"(?U)\b(1[0-9]{3}|20[0-9]{2})(?=s?\b)"


def price_parts(text: Column) -> Column:
    """``struct(value, currency)`` of the first number in a price text.

    Only the characters right after that number can be a unit, so a unit
    somewhere else in the sentence does not count.
    """
    raw = F.trim(text)
    mark = F.lit(None).cast("string")
    for sign, code in reversed(CURRENCY_MARKS):
        mark = F.when(F.contains(raw, F.lit(sign)), F.lit(code)).otherwise(mark)
    digits = plain_digits(F.replace(F.regexp_extract(raw, NUMBER, 0), F.lit(","), F.lit("")))
    number = F.nullif(digits, F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(raw, r"(?s)" + NUMBER + r"[\s　]*(.?)", 1))
    factor = (F.when(unit == "億", 1e8).when(unit.isin("萬", "万"), 1e4)
              .when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0))
    implied = F.when(unit.isin("億", "萬"), F.lit("TWD")).when(unit == "万", F.lit("JPY"))
    currency = F.when(number.isNotNull(), F.coalesce(mark, implied)).otherwise(mark)
    return F.struct((number * factor).alias("value"), currency.alias("currency"))


def parse_price(text: Column) -> Column:
    return price_parts(text)["value"]


def parse_currency(text: Column) -> Column:
    return price_parts(text)["currency"]


def parse_year(text: Column) -> Column:
    """First four-digit year from 1000 to 2099; ``1920s`` counts as 1920."""
    return F.nullif(F.regexp_extract(text, YEAR, 1), F.lit("")).try_cast("int")


def area_with_metric(text: Column) -> Column:
    """Append square metres to an area in square feet or acres."""
    low = F.lower(text)
    metric = (F.contains(text, F.lit("㎡")) | F.contains(low, F.lit("m²"))
              | F.contains(low, F.lit("sq m")) | F.contains(low, F.lit("sqm")))
    number = plain_digits(F.replace(F.regexp_extract(text, NUMBER, 0), F.lit(","), F.lit(""))).try_cast("double")
    # Square metres per acre and per square foot.
    rate = (F.when(F.contains(low, F.lit("acre")), 4046.8564224)
            .when(F.contains(low, F.lit("sq")) & F.contains(low, F.lit("ft")), 0.09290304))
    done = F.concat(text, F.lit(" (Approx. "), F.format_number(number * rate, 0), F.lit("㎡)"))
    return F.when(metric | number.isNull() | rate.isNull(), text).otherwise(done)


def rate_from_quote(per_jpy: Column) -> Column:
    """Yen per unit from a quote in units per yen; unusable quotes give NULL."""
    return F.when(per_jpy > 0, F.bround(1 / per_jpy, 4))
