"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def no_fragment(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"(?s)#.*$", "")


def normalize_url(url: Column) -> Column:
    """Drop the fragment; drop trailing slashes of a path longer than one.

    The query string is kept as it is (an empty one disappears).
    """
    whole = no_fragment(url)
    head = F.regexp_extract(whole, r"(?s)^[^?]*", 0)
    query = F.regexp_replace(F.regexp_replace(whole, r"(?s)^[^?]*", ""), r"^\?$", "")
    path = F.regexp_replace(F.regexp_replace(head, r"(://[^/]+)/{2,}$", "$1"), r"(://[^/]+/.*[^/])/+$", "$1")
    return F.concat(path, query)


def authority(url: Column) -> Column:
    """Lower-case network location, port included; empty when there is none."""
    return F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host without user, port and a leading ``www.``."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(no_fragment(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``[c, b.c, a.b.c]``: a sub-domain test becomes an equality test.

    Built as a fold over the labels, so the host is worked out once.
    """
    return F.aggregate(
        F.reverse(F.split(host, r"\.")), F.array().cast("array<string>"),
        lambda done, label: F.array_append(done, F.concat_ws(".", label, F.get(done, F.size(done) - 1))))


def on_any_domain(host: Column, domains: list[str]) -> Column:
    """Host equals one of a short fixed list, or is below one."""
    if not domains:
        return F.lit(False)
    return F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d.lower()) for d in domains]))


def first_segment(url: Column) -> Column:
    """``/blog/`` when the path has more than one part, else the marker of the root."""
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.concat(F.lit("/"), parts[0], F.lit("/"))).otherwise(F.lit("/"))


def url_allowed(url: Column, include: Column, exclude: Column) -> Column:
    """Exclude wins; an empty include list lets everything pass. Regex search."""
    none = F.array().cast("array<string>")
    hit_out = F.exists(F.coalesce(exclude, none), lambda p: F.regexp_like(url, p))
    hit_in = F.exists(F.coalesce(include, none), lambda p: F.regexp_like(url, p))
    return ~hit_out & ((F.coalesce(F.size(include), F.lit(0)) <= 0) | hit_in)


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a link against the page it stands on."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    no_query = F.regexp_replace(base, r"(?s)[?#].*$", "")
    path = F.regexp_replace(no_query, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    tail = F.regexp_extract(href, r"(?s)[?#].*$", 0)
    own = F.regexp_replace(href, r"(?s)[?#].*$", "")
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin, _dots(own), tail))
            .when(href.startswith("?"), F.concat(no_query, href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), href))
            .otherwise(F.concat(origin, _dots(F.concat(folder, own)), tail)))


def _dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` parts; paths without them pass untouched."""
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.array_append(done, part)))
    ends_in_dots = path.rlike(r"/\.{1,2}$")
    whole = F.concat(F.array_join(folded, "/"), F.when(ends_in_dots, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), whole).otherwise(path)
