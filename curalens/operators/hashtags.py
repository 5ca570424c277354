"""Rule tags of a listing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_TAGS = 30


def hashtags(columns: list[str], head: list[str], rules: list[tuple[str, list[str]]], tail: list[str],
             limit: int = MAX_TAGS) -> Column:
    """Fixed tags, tags of every rule whose word occurs, closing tags; each once, in order."""
    text = F.lower(F.concat_ws(" ", *columns))

    def tags(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")

    hits = [F.when(F.contains(text, F.lit(word.lower())), tags(values)).otherwise(tags([])) for word, values in rules]
    return F.slice(F.array_distinct(F.concat(tags(head), *hits, tags(tail))), 1, limit)
