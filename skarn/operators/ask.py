"""Property queries over (page, property, value) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RESULTS = 500


def ask(triples: DataFrame, *, category: str | None = None, where: dict[str, str] | None = None, printouts: list[str], sort: str | None = None, descending: bool = False, limit: int = MAX_RESULTS) -> DataFrame:
    """Pages that meet every condition, with their printouts; at most ``limit``, in order.

    One aggregation by page: conditions and printouts are read off together.
    """
    conditions = dict(where or {}) | ({"Category": category} if category else {})
    prop, value = F.col("property"), F.col("value")
    wanted = triples.filter(prop.isin([*conditions, *printouts, *([sort] if sort else [])]))
    tests = [F.bool_or((prop == p) & (value == v)).alias(f"__c{i}") for i, (p, v) in enumerate(conditions.items())]
    shown = list(dict.fromkeys([*printouts, *([sort] if sort else [])]))
    found = wanted.groupBy("page").agg(*tests, *[F.min(F.when(prop == p, value)).alias(p) for p in shown])
    for i in range(len(conditions)):
        found = found.filter(F.col(f"__c{i}"))
    key = F.col(sort) if sort else F.col("page")
    return found.orderBy(key.desc() if descending else key.asc(), "page").limit(limit).select("page", *printouts)
