"""Count-Min and HyperLogLog sketches in relational form.

A sketch is a small table of counters or registers, built with map-side partial
aggregation, merged by sum or max, and bit-exact: hashes are SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
WIDTH, DEPTH = 2719, 5
#: Hash coefficients (a, b) of the default seed, by row.  Fixed values.
COEFFICIENTS = [
    (1373158607, 239081663),
    (53710185, 1592467581),
    (590620972, 525901256),
    (479341424, 299655412),
    (1581559893, 220106707),
]


def low31(item: Column) -> Column:
    """The low 31 bits of SHA-256."""
    return F.conv(F.right(F.sha2(item.cast("binary"), 256), F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit(PRIME))


def _cells(item: Column, width: int, coefficients: list[tuple[int, int]]) -> Column:
    h = low31(item)
    return F.array(
        *[F.struct(F.lit(i).alias("row"), ((F.lit(a) * h + F.lit(b)) % F.lit(PRIME) % F.lit(width)).alias("col")) for i, (a, b) in enumerate(coefficients)]
    )


def cms(items: DataFrame, item: Column, count: Column | None = None, *, width: int = WIDTH, coefficients=None) -> DataFrame:
    """(row, col, cnt).  Items are counted before they are hashed: a hot item is one row."""
    counted = items.groupBy(item.alias("item")).agg(F.sum(count if count is not None else F.lit(1)).alias("c"))
    cells = counted.select("c", F.explode(_cells(F.col("item"), width, coefficients or COEFFICIENTS)).alias("x"))
    return cells.groupBy("x.row", "x.col").agg(F.sum("c").alias("cnt"))


def cms_merge(*sketches: DataFrame) -> DataFrame:
    """Sketches of equal width and coefficients add up."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def cms_query(sketch: DataFrame, candidates: DataFrame, item: str, *, width: int = WIDTH, coefficients=None) -> DataFrame:
    """(item, estimate): the least counter of each candidate, 0 for one never seen."""
    rows = coefficients or COEFFICIENTS
    cells = candidates.select(item, F.explode(_cells(F.col(item), width, rows)).alias("x")).select(item, "x.row", "x.col")
    # The sketch has width * depth rows at most.
    found = cells.join(F.broadcast(sketch), ["row", "col"], "left")
    return found.groupBy(item).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def cms_bounds(width: int = WIDTH, depth: int = DEPTH) -> dict[str, float]:
    return {"epsilon": math.e / width, "delta": math.exp(-depth), "bytes": width * depth * 8}


def hll_registers(items: DataFrame, item: Column, p: int = 12, extra: list[str] | None = None) -> DataFrame:
    """(bucket, rho) of 2^p registers, 4 <= p <= 16; empty ones are left out."""
    if not 4 <= p <= 16:
        raise ValueError("p must be between 4 and 16")
    extra = extra or []
    h = F.conv(F.substring(F.sha2(item.cast("binary"), 256), 1, 16), 16, -10).cast("long")
    hashed = items.select(*extra, h.alias("h"))
    rest = F.col("h").bitwiseAND(F.lit((1 << (64 - p)) - 1))
    rho = F.lit(64 - p + 1) - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    return hashed.select(*extra, F.shiftrightunsigned("h", 64 - p).cast("int").alias("bucket"), rho.cast("int").alias("rho")).groupBy(*extra, "bucket").agg(F.max("rho").alias("rho"))


def hll_merge(*registers: DataFrame) -> DataFrame:
    out = registers[0]
    for r in registers[1:]:
        out = out.unionByName(r)
    return out.groupBy("bucket").agg(F.max("rho").alias("rho"))


def hll_estimate(registers: DataFrame, p: int = 12, by: list[str] | None = None) -> DataFrame:
    """The estimate: harmonic mean, or linear counting while it is small; half-even rounding."""
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("z"))
    empty = F.lit(m) - F.col("used")
    raw = F.lit(alpha * m * m) / (F.col("z") + empty)
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / empty)
    estimate = F.when((raw <= 2.5 * m) & (empty > 0), linear).otherwise(raw)
    return sums.select(*(by or []), F.bround(estimate, 0).cast("long").alias("estimate"))
