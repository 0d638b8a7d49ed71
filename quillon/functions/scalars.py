"""Scalar expressions: ids, slugs, numbers, dates and tests, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(props: Column, name: str) -> Column:
    """First value of a property, null for none."""
    return F.get(props[name], F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def indicator_id(value: Column) -> Column:
    return F.concat(F.lit("ioc-"), F.sha1(F.lower(F.trim(value))))


def safe_segment(value: Column) -> Column:
    """A path segment: other characters become ``_``, leading dots go, nothing left gives ``_``."""
    s = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]", "_"), r"^\.+", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("_"))


def url_slug(url: Column) -> Column:
    """Last path segment of a url."""
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def canonical_id(members: Column) -> Column:
    """Id of a merged set: the member itself if it is alone, else a digest of the sorted members."""
    one = F.get(members, F.lit(0))
    many = F.concat(F.lit("wmc-"), F.substring(F.sha2(F.concat_ws("\0", F.array_sort(members)), 256), 1, 40))
    return F.when(F.size(members) == 1, one).when(F.size(members) > 1, many)


def anchor_id(kind: Column, value: Column) -> Column:
    """Legible id of an external id; a digest is appended where the plain form would not be unique."""
    safe = F.regexp_replace(value, "[^A-Za-z0-9.-]", "-")
    plain = F.concat(F.lit("wm-anchor-"), kind, F.lit("-"), safe)
    lossy = (safe != value) | (value == "") | value.rlike("[.-]$") | plain.rlike("-[0-9a-f]{12}$")
    return F.when(lossy, F.concat(plain, F.lit("-"), F.substring(F.sha2(value, 256), 1, 12))).otherwise(plain)


def short_hash(*parts: Column, sep: str = "\n") -> Column:
    return F.substring(F.sha1(F.concat_ws(sep, *parts)), 1, 16)


def group_slug(name: Column) -> Column:
    """Letters and digits of a name; a digest of it where none is left."""
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    return F.when(slug == "", F.concat(F.lit("--"), F.substring(F.sha1(name), 1, 16))).otherwise(slug)


def to_float(value: Column) -> Column:
    return value.try_cast("double")


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed rectangle ``(west, south, east, north)``."""
    west, south, east, north = box
    return lat.between(south, north) & lon.between(west, east)


def parse_box(text: str) -> tuple[float, float, float, float]:
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    return parts[0], parts[1], parts[2], parts[3]


def harmonic_mean(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def phi4(overlap: Column, a: Column, b: Column) -> Column:
    """Likeness of two clusters by their shared and own sizes."""
    return F.try_divide(2.0 * overlap, a + b)


def qid(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"Q\d+", 0), F.lit(""))


def backoff_seconds(failures: Column, base: float = 60.0, cap: float = 3600.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(failures, F.lit(1)) - 1), F.lit(cap))


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def valid_entity_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9:._-]+\z"), F.lit(False))


def valid_target(c: Column) -> Column:
    """Host names and addresses that a tool may be pointed at."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9.:-]+\z") & (F.length(c) <= 253) & ~c.startswith("-") & ~c.contains(".."), F.lit(False))


def target_allowed(c: Column, allowed: list[str]) -> Column:
    """Exact or ``*.domain`` match of a list; an empty list allows all."""
    out = F.lit(not allowed)
    for e in allowed:
        out = out | (c.endswith(e[1:]) if e.startswith("*.") else c == e)
    return out


def placeholder_text(c: Column) -> Column:
    """Descriptions that describe nothing."""
    bare = F.trim(F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"^\[ai generated\]", ""))
    return bare.isin("", "n/a")


def utc_stamp(c: Column) -> Column:
    """A stamp without its trailing zone name."""
    return F.regexp_replace(c, r"(?i)\s*UTC\s*$", "")


def seed_from(seed: int, ids: Column) -> Column:
    """A number from a seed and the sorted ids of a set."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws(",", F.array_sort(ids))), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10)
