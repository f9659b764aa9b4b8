"""Incrementally maintained aggregate views.

A view is kept as counts and sums by group.  A change is a set of rows with a
sign (+1 inserted, -1 deleted); its aggregate is added to the view by a full
outer merge on the group, and groups whose count falls to zero leave it.  So the
work follows the change, not the table; averages are sums over counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed(inserted: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    out = inserted.withColumn("sign", F.lit(1))
    return out if deleted is None else out.unionByName(deleted.withColumn("sign", F.lit(-1)))


def view_of(changes: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, n, sums): the aggregate of signed rows."""
    return changes.groupBy(*keys).agg(F.sum("sign").alias("n"), *[F.sum(c * F.col("sign")).alias(name) for name, c in sums.items()])


def merge(view: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The view after the change."""
    values = [c for c in view.columns if c not in keys]
    renamed = delta.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    joined = view.join(renamed, keys, "full_outer")
    out = joined.select(*keys, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in values])
    return out.filter(F.col("n") != 0)


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``target`` with the rows whose key it lacks; of equal new keys one comes in."""
    fresh = rows.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh)


def replace_rows(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Delete and insert by key."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)
