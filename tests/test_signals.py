"""Sale signals: the proximity rule, scores, picks, and agreement with a brute-force count."""

import random
import re
import time

from pyspark.sql import functions as F

from curalens.config import SignalConfig
from curalens.operators import signals


def detect(spark, text, links=(), **kw):
    df = spark.createDataFrame([(text, list(links))], "text string, links array<string>")
    return signals.with_contexts(signals.near_miss(signals.detect_signals(df, SignalConfig(**kw)))).first()


def test_keyword_and_price(spark):
    row = detect(spark, "The house is for sale at $1,250,000 today.")
    assert (row.score, row.prices, row.keywords) == (2, ["$1,250,000"], ["for sale"])
    assert "for sale" in row.evidence and "$1,250,000" in row.evidence


def test_one_sign_is_not_enough(spark):
    assert detect(spark, "It is for sale.").score == 1
    row = detect(spark, "plain text", ["https://www.compass.com/x", "https://notcompass.com/y"])
    assert (row.score, row.listing_links) == (1, ["https://www.compass.com/x"])


def test_far_price_is_ignored(spark):
    text = "It cost €240 million to build. " + "word " * 100 + "Now for sale."
    row = detect(spark, text)
    assert (row.prices, row.ignored_prices, row.near_miss) == ([], ["€240 million"], "price too far")
    assert detect(spark, text, window=0).prices == ["€240 million"]


def test_near_miss(spark):
    assert detect(spark, "for sale").near_miss == "keyword without price"
    assert detect(spark, "costs £5").near_miss == "price without keyword"


def test_unstated_price_counts(spark):
    assert detect(spark, "is on the market, price on application").score == 2


def test_pick_listing_url(spark):
    def pick(*links):
        df = spark.createDataFrame([(list(links),)], "l array<string>")
        return df.select(signals.pick_listing_url(df.l).alias("x")).first().x

    assert pick("https://c.com/agents/joe", "https://c.com/homes/12", "https://c.com/a/b/c") == "https://c.com/homes/12"
    assert pick("https://c.com/", "https://c.com/about") is None
    assert pick("https://c.com/a/b", "https://c.com/a/c") == "https://c.com/a/b"
    assert pick("https://x.c.com/market-report-2026", "https://c.com/a") == "https://c.com/a"


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = ["for sale", "asking price", "now asking", "$1,200,000", "€5 million", "100万円", "price on request", "aaaa", "café", "x"]
    texts = [" ".join(rng.choice(words if rng.random() < 0.15 else ["lorem", "été", "住宅"]) for _ in range(rng.randint(1, 300)))
             for _ in range(60)]
    cfg = SignalConfig(window=40)
    df = spark.createDataFrame([(i, t, []) for i, t in enumerate(texts)], "id int, text string, links array<string>")
    got = {r.id: r for r in signals.detect_signals(df, cfg).collect()}
    for i, text in enumerate(texts):
        low, near, far = text.lower(), [], []
        spans = [(m, m + len(k)) for k in cfg.keywords for m in range(len(low)) if low.startswith(k.lower(), m)]
        for pattern in cfg.price_patterns:
            for m in re.finditer(pattern, text, re.IGNORECASE):
                hit = any(m.start() - 40 <= e and s <= m.end() + 40 for s, e in spans)
                side = near if hit else far
                if m.group(0).strip() not in side:
                    side.append(m.group(0).strip())
        assert (got[i].prices, got[i].ignored_prices) == (near, far), text


def test_a_hundred_thousand_prices_in_one_text(spark):
    n = 100_000
    body = F.concat(F.lit("This home is for sale, é. "), F.repeat(F.lit("cost $1,234 or é "), n), F.lit("the end $9,999"))
    start = time.monotonic()
    got = signals.detect_signals(spark.range(1).select(body.alias("text"), F.array().cast("array<string>").alias("links"))).select(
        F.size("_spans").alias("n"), F.element_at("_spans", -1).alias("last"), "prices", "ignored_prices").first()
    text_length = len("This home is for sale, é. ") + 17 * n + len("the end $9,999")
    assert got.n >= n + 1 and (got.last.stop, got.last.found) == (text_length, "$9,999")
    assert got.prices == ["$1,234"] and set(got.ignored_prices) == {"$1,234", "$9,999"}
    assert time.monotonic() - start < 120
