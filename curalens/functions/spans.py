"""Positions of regex matches inside a text, without a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_EMPTY = "array<struct<start:int,stop:int,found:string>>"
_PARTS = "array<array<struct<gap:int,size:int,hit:string>>>"
#: Matches whose offsets are summed one after the other.
BLOCK = 256


def no_spans() -> Column:
    return F.array().cast(_EMPTY)


def match_spans(text: Column, pattern: str) -> Column:
    """Every match as ``struct(start, stop, found)``, offsets from 0.

    The pieces between matches give the gaps: a match starts after all gaps and
    matches before it. Offsets are prefix sums over blocks of 256 matches: sums of whole blocks come first, so no
    array grows match by match and the work follows the matches. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))
    parts = F.filter(parts, lambda p: p["hit"].isNotNull())          # one gap more than matches

    def cut(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")),
                                                     lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast(_PARTS))

    return F.flatten(bound(bound(parts, cut), _placed))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + p["gap"] + p["size"])


def _placed(blocks: Column) -> Column:
    """Spans of each block: what the blocks before it add up to, then the parts before it in the block."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.transform(blocks, _total), start, lambda acc, n: F.struct(
        (acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])

    def spans(block: Column, base: Column) -> Column:
        begun = F.struct(base.alias("at"), F.array().cast(_EMPTY).alias("spans"))

        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["gap"]
            stop = begin + p["size"]
            return F.struct(stop.alias("at"), F.array_append(acc["spans"], F.struct(
                begin.alias("start"), stop.alias("stop"), p["hit"].alias("found"))).alias("spans"))

        return F.aggregate(block, begun, step, lambda acc: acc["spans"])

    return F.zip_with(blocks, starts, spans)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def window_text(text: Column, start: Column, stop: Column, width: int, length: Column) -> Column:
    """The text around a span, white space squeezed, dots where it is cut."""
    begin = F.greatest(start - width, F.lit(0))
    end = F.least(stop + width, length)
    body = squeeze(F.substring(text, begin + 1, end - begin))
    cut = (begin > 0) | (end < length)
    return F.when(cut, F.concat(F.lit("…"), body, F.lit("…"))).otherwise(body)
