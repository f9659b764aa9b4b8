"""Deterministic stream generators: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zipf_items(rows: DataFrame, u: Column, n_items: int, exponent: float) -> DataFrame:
    """``rows`` with item: the inverse of the Zipf distribution at ``u`` in [0, 1)."""
    spark = rows.sparkSession
    weight = 1 / F.pow(F.col("i"), F.lit(exponent))
    items = spark.range(1, n_items + 1).select(F.col("id").alias("i")).select("i", weight.alias("w"))
    # The distribution is a parameter: n_items rows, ordered once.
    cum = items.select("i", (F.sum("w").over(Window.orderBy("i")) / F.sum("w").over(Window.partitionBy())).alias("c"))
    steps = F.array_sort(F.collect_list(F.struct("c", "i")))
    table = cum.agg(steps.alias("steps"))
    # Halving: the first step at or above u, in as many looks as n_items has bits.
    middle = lambda b: F.floor((b["lo"] + b["hi"]) / 2).cast("int")
    high_enough = lambda b: F.element_at("steps", middle(b))["c"] + 1e-12 >= F.col("__u")
    halved = lambda b, _: F.struct(F.when(high_enough(b), b["lo"]).otherwise(F.least(middle(b) + 1, b["hi"])).alias("lo"), F.when(high_enough(b), middle(b)).otherwise(b["hi"]).alias("hi"))
    whole = F.struct(F.lit(1).alias("lo"), F.lit(n_items).alias("hi"))
    found = F.element_at("steps", F.aggregate(F.sequence(F.lit(1), F.lit(n_items.bit_length())), whole, halved)["lo"])
    placed = rows.withColumn("__u", u).crossJoin(F.broadcast(table))  # one row
    return placed.withColumn("item", F.format_string("item-%05d", found["i"])).drop("__u", "steps")


def _hashed(seed: int, *columns: str) -> Column:
    """Uniform in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def in_order_stream(spark: SparkSession, n: int, keys: list[str], *, start_s: float = 0.0, interval_s: float = 1.0, seed: int = 42) -> DataFrame:
    """event_id, event_time (s), key, value ~ N(100, 15)."""
    names = F.array(*[F.lit(k) for k in keys])
    normal = F.sqrt(-2 * F.ln(1 - _hashed(seed, "id"))) * F.cos(2 * 3.141592653589793 * _hashed(seed + 1, "id"))
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        (F.lit(start_s) + F.col("id") * interval_s).alias("event_time"),
        F.get(names, F.floor(_hashed(seed + 2, "id") * len(keys)).cast("int")).alias("key"),
        (100 + 15 * normal).alias("value"),
    )


def out_of_order_stream(spark: SparkSession, n: int, keys: list[str], *, max_delay_s: float = 8.0, late_share: float = 0.1, late_s: float = 20.0, seed: int = 42, **options) -> DataFrame:
    """The stream with an arrival time: delays up to ``max_delay_s``, some events much later."""
    delay = _hashed(seed + 3, "event_id") * max_delay_s + F.when(_hashed(seed + 4, "event_id") < late_share, late_s).otherwise(0.0)
    return in_order_stream(spark, n, keys, seed=seed, **options).withColumn("arrival", F.col("event_time") + delay)


def clickstream(spark: SparkSession, users: int, bursts: int, clicks: int, pages: list[str], *, goal: str, seed: int = 42) -> DataFrame:
    """Bursts of clicks per user; a burst converts when its last click is the goal page."""
    names = F.array(*[F.lit(p) for p in pages])
    rows = spark.range(users * bursts * clicks).select(
        F.col("id").alias("event_id"), F.floor(F.col("id") / (bursts * clicks)).alias("u"), (F.floor(F.col("id") / clicks) % bursts).alias("b"), (F.col("id") % clicks).alias("c")
    )
    page = F.get(names, F.floor(_hashed(seed, "event_id") * len(pages)).cast("int"))
    gap = 60 + 240 * _hashed(seed + 1, "u", "b")
    return rows.select(
        "event_id",
        F.concat(F.lit("user-"), "u").alias("user_id"),
        (F.col("b") * (clicks * 5.0 + 300) + gap + F.col("c") * (1 + 4 * _hashed(seed + 2, "event_id"))).alias("event_time"),
        page.alias("page"),
        ((F.col("c") == clicks - 1) & (page == goal)).alias("is_conversion"),
    )


def order_stream(spark: SparkSession, n: int, products: int, *, first_id: int = 1, seed: int = 42) -> DataFrame:
    """Orders with low product numbers drawn more often, quantity 1 to 3."""
    return spark.range(first_id, first_id + n).select(
        F.col("id").alias("order_id"),
        (1 + F.floor(F.pow(_hashed(seed, "id"), F.lit(2.0)) * products)).cast("int").alias("product_id"),
        (1 + F.floor(_hashed(seed + 1, "id") * 50)).cast("int").alias("user_id"),
        (1 + F.floor(_hashed(seed + 2, "id") * 3)).cast("int").alias("quantity"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("order_time"),
    )


def sensor_stream(spark: SparkSession, sensors: int, seconds: int, step_s: int, *, spike_share: float = 0.02, seed: int = 42) -> DataFrame:
    """Readings and threshold updates in one stream, told apart by ``kind``."""
    times = spark.range(0, seconds, step_s).select(F.col("id").alias("t"))
    grid = times.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sensors - 1))))
    name = F.format_string("sensor-%02d", F.col("s"))
    spike = F.when(_hashed(seed, "t", "s") < spike_share, 60.0).otherwise(0.0)
    value = 50 + 10 * F.sin(F.col("t") / 300.0) + 5 * (_hashed(seed + 1, "t", "s") - 0.5) + spike
    readings = grid.select(F.lit("reading").alias("kind"), name.alias("sensor_id"), F.col("t").cast("double").alias("event_time"), value.alias("value"))
    starts = grid.filter("t = 0").select(F.lit("threshold").alias("kind"), name.alias("sensor_id"), F.lit(0.0).alias("event_time"), F.lit(90.0).alias("value"))
    half = grid.filter((F.col("t") == 0) & (F.col("s") < sensors // 2))
    later = half.select(F.lit("threshold").alias("kind"), name.alias("sensor_id"), F.lit(seconds / 2.0).alias("event_time"), F.lit(75.0).alias("value"))
    return readings.unionByName(starts).unionByName(later)


def sample_actuals(predicted: DataFrame, dates: list[str], *, key: str = "ticker", spread: float = 0.04, seed: int = 42) -> DataFrame:
    """Wide actual prices for wide predictions: each within half of ``spread`` of its prediction, by a hash."""
    columns = [F.round(F.col(f"`{d}`") * (1 + (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.lit(d)), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5) * spread), 2).alias(d) for d in dates]
    out = predicted.select(key, *columns)
    change = F.col(f"`{dates[-1]}`") - F.col(f"`{dates[0]}`")
    return out.select("*", F.round(change, 2).alias("change"), F.round(change / F.col(f"`{dates[0]}`") * 100, 2).alias("change_pct"))
