"""Scalar functions that queries share, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_embedding(item: Column, dim: int) -> Column:
    """SHA-256 byte pairs of ``item`` as numbers in [-1, 1], padded with 0 to ``dim``."""
    digest = F.sha2(item.cast("binary"), 256)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535.0 * 2 - 1)
    padded = F.concat(pairs, F.array_repeat(F.lit(0.0), max(0, dim - 16)))
    return F.slice(padded, 1, dim)


def clean_xml(text: Column) -> Column:
    """Control characters that XML does not allow become blanks."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").otherwise("neutral")


def direction(change: Column) -> Column:
    return F.when(change >= 0, "Up").otherwise("Down")


def error_bucket(pct: Column, low: float, high: float) -> Column:
    return F.when(F.abs(pct) < low, "good").when(F.abs(pct) < high, "fair").otherwise("poor")


def merged(old: Column, new: Column) -> Column:
    """Two maps in one; new values win."""
    return F.map_from_entries(
        F.concat(F.map_entries(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))), F.map_entries(new))
    )


def file_name(text: Column) -> Column:
    """Letters, digits, blank, - and _ kept, blanks to _, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, "[^0-9A-Za-z _-]", "")), " ", "_"))
