"""Keys of any size in many ranges: the same rows as in one range, and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import temporal as X
from skarn.operators import windows as W


def plain_ewma(rows, half_life):
    state, out = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if v is None:
            out[i] = (None, None, None)
            continue
        if k not in state:
            state[k] = (t, v, 0.0, 1)
        else:
            t0, m, s, n = state[k]
            w = 2 ** (-max(0.0, t - t0) / half_life)
            state[k] = (t, (1 - w) * v + w * m, (1 - w) * (v - m) ** 2 + w * s, n + 1)
        out[i] = (state[k][3], state[k][1], math.sqrt(state[k][2]))
    return out


def test_ewma_of_one_key_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else f"k{i % 7}", float(rng.randrange(4000)), i, None if i % 17 == 0 else rng.uniform(-5, 5)) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, t double, i long, v double").withColumn("ts", F.timestamp_seconds("t"))
    want = plain_ewma(rows, 90.0)
    for part_rows in (40, 10_000):
        got = X.ewma(df, key="key", ts="ts", tie="i", value="v", half_life_s=90.0, part_rows=part_rows).collect()
        assert len(got) == 1500
        for r in got:
            n, mean, std = want[r["event_id"]]
            assert r["n"] == n and (n is None or (r["ema"] == pytest.approx(mean, abs=1e-9) and r["ema_std"] == pytest.approx(std, abs=1e-6)))


def test_neighbours_over_many_ranges(spark):
    rng = random.Random(2)
    left = [("a" if i % 5 else "b", rng.randrange(3000), i) for i in range(300)]
    right = [("a", rng.randrange(3000), 1000 + i, float(i)) for i in range(40)]
    l = spark.createDataFrame(left, "key string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    r = spark.createDataFrame(right, "key string, s long, i long, v double").withColumn("ts", F.timestamp_seconds("s"))
    for part_rows in (7, 10_000):
        got = X.asof_join(l, r.drop("s"), key="key", ts="ts", tie="i", value="v", within="100 SECONDS", part_rows=part_rows).collect()
        assert len(got) == 300
        for row in got:
            fits = [(s, i, v) for k, s, i, v in right if k == row["key"] and row["s"] - 100 <= s <= row["s"]]
            assert row["v"] == (max(fits)[2] if fits else None)
        days = lambda df, name: df.select("key", F.date_add(F.lit("2020-01-01"), F.col("s").cast("int")).alias(name), *[c for c in ("i", "v") if c in df.columns])
        near = X.nearest_join(days(l, "asked"), days(r, "date").drop("i"), key="key", left_ts="asked", right_ts="date", value="v", part_rows=part_rows)
        for row in near.withColumn("d", F.abs(F.datediff("asked", "matched_at"))).join(l.select("i", "s"), "i").collect():
            every = [abs(s - row["s"]) for k, s, _, _ in right if k == row["key"]]
            assert row["d"] == (min(every) if every else None)


def plain_sessions(rows, gap, lag):
    """rows (user, t, v) in the order of arrival."""
    live, counter, high, out = {}, {}, -math.inf, []
    for seq, (u, t, v) in enumerate(rows, 1):
        high = max(high, t)
        mine = live.setdefault(u, [])
        met = [x for x in mine if x["s"] <= t <= x["e"] + gap]
        if not met:
            counter[u] = counter.get(u, 0) + 1
            met = [{"id": counter[u], "s": t, "e": t, "n": 0, "v": 0.0, "m": 0}]
            mine.append(met[0])
        first = min(met, key=lambda x: x["s"])
        for x in met:
            if x is not first:
                first["e"], first["n"], first["v"], first["m"] = max(first["e"], x["e"]), first["n"] + x["n"], first["v"] + x["v"], first["m"] + x["m"] + 1
                mine.remove(x)
        first["e"], first["n"], first["v"] = max(first["e"], t), first["n"] + 1, first["v"] + v
        out += [(u, x["id"], x["s"], x["e"], x["n"], round(x["v"], 6), x["m"], seq) for x in mine if x["e"] + gap < high - lag]
        live[u] = [x for x in mine if x["e"] + gap >= high - lag]
    return out + [(u, x["id"], x["s"], x["e"], x["n"], round(x["v"], 6), x["m"], None) for u, mine in live.items() for x in mine]


def strict(spark, rows, gap, lag, **options):
    df = spark.createDataFrame([(i, u, t, v) for i, (u, t, v) in enumerate(rows)], "i long, u long, t double, v double")
    got = W.strict_sessions(df, "u", "t", [F.col("i")], gap_s=gap, lag_s=lag, value="v", converted=F.col("v") > 9, **options).collect()
    return [(r["user_id"], r["session_id"], r["session_start"], r["session_end"], r["n_events"], round(r["total_value"], 6), r["merged"], r["closed_at"]) for r in got]


def test_strict_sessions_golden_trace(spark):
    rows = [(1, t, 1.0) for t in (100.0, 120.0, 140.0, 170.0, 155.0, 190.0)]
    got = sorted((x[7] is None, x[2], x[3], x[4], x[6]) for x in strict(spark, rows, 20.0, 0.0))
    assert got == [(False, 100.0, 140.0, 3, 0), (False, 155.0, 155.0, 1, 0), (True, 170.0, 190.0, 2, 0)]
    assert len(strict(spark, rows, 20.0, 0.0, min_events=2)) == 2


def test_strict_sessions_against_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5), float(i * 4 - rng.randrange(0, 160)), rng.uniform(0, 10)) for i in range(800)]
    for gap, lag in ((20.0, 0.0), (20.0, 100.0)):
        want = plain_sessions(rows, gap, lag)
        for part_rows in (50, 10_000):
            assert sorted(strict(spark, rows, gap, lag, part_rows=part_rows), key=repr) == sorted(want, key=repr)
        assert lag == 0.0 or any(x[6] for x in want)  # some were merged


def test_order_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(500), i, rng.randrange(1000)) for i in range(900)]
    df = spark.createDataFrame(rows, "a long, i long, t long")
    for part_rows in (30, 10_000):
        got = W.in_order(df, [F.col("a"), F.col("i")], F.col("t"), part_rows).collect()
        high = -1
        for n, r in enumerate(sorted(got, key=lambda r: (r["a"], r["i"])), 1):
            high = max(high, r["t"])
            assert (r["seq"], r["high"]) == (n, high)
