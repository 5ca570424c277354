"""Image URL columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from curalens.functions.urls import absolute_url, authority, path_of

# Words in a path that is no photo, endings that are images, size marks in file names.
NOISE = (r"(?i)(logo|icon|avatar|sprite|badge|banner|advert|placeholder|favicon|share|social|"
         r"thumb(nail)?[-_/]?(small|xs)|1x1|spacer|pixel)")
IMAGE_ENDING = r"(?i)\.(jpg|jpeg|png|webp)$"
SIZE_MARK = r"-\d{2,5}x\d{2,5}(?=\.[a-z]{3,4}$)"
SCALE_MARK = r"[@_-][23]x(?=\.[a-z]{3,4}$)"
SCALED_MARK = r"-scaled(?=\.[a-z]{3,4}$)"
RESIZE_KEYS = ["w", "h", "crop", "resize", "fit", "quality", "strip", "ssl"]
UPGRADE_MIN_WIDTH = 250


def is_photo(url: Column) -> Column:
    return ~url.rlike(NOISE) & F.regexp_replace(path_of(url), r"^.*/", "").rlike(IMAGE_ENDING)


def photo_identity(url: Column) -> Column:
    """Same photo, same key: host and path without size, scale and query."""
    path = F.lower(path_of(url))
    for mark in (SIZE_MARK, SCALE_MARK, SCALED_MARK):
        path = F.regexp_replace(path, mark, "")
    return F.concat(authority(url), path)


def original_upload_url(url: Column) -> Column:
    """Resized upload to its original, unless it is small or carries other parameters."""
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)#.*$", 0)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keys = F.transform(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)))
    foreign = F.exists(keys, lambda k: ~k.isin(RESIZE_KEYS))
    width_at = F.filter(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)) == "w")
    width = F.regexp_extract(F.get(width_at, F.lit(0)), r"=(.*)$", 1).try_cast("double")
    narrow = (F.size(width_at) > 0) & F.coalesce(width < UPGRADE_MIN_WIDTH, F.lit(True))
    marked = F.regexp_extract(bare, r"(?i)-(\d{2,5})x\d{2,5}(?=\.[a-z]{3,4}$)", 1).try_cast("int")
    path = F.when(marked >= UPGRADE_MIN_WIDTH, F.regexp_replace(bare, r"(?i)" + SIZE_MARK, "")).otherwise(bare)
    stays = ~F.contains(path_of(url), F.lit("/wp-content/uploads/")) | (
        (query != "") & (foreign | (F.size(pairs) == 0) | narrow))
    return F.when(stays, url).otherwise(F.concat(path, fragment))


def srcset_largest(srcset: Column, base: Column) -> Column:
    """Widest candidate of a srcset, the earlier one on ties."""
    chunks = F.filter(F.transform(F.split(srcset, ","), lambda c: F.trim(c)), lambda c: c != "")
    sized = F.transform(chunks, lambda c, i: F.struct(
        F.coalesce(F.regexp_extract(c, r"^\S+\s+(\S+)w(?:\s|$)", 1).try_cast("double"), F.lit(0.0)).alias("width"),
        (-i).alias("order"), F.regexp_extract(c, r"^\S+", 0).alias("url")))
    return absolute_url(F.array_max(sized)["url"], base)
