"""Structured Streaming forms of the windows, sessions, EWMA, replay and views.

Spark moves its watermark between micro-batches; where the exact per-event rules
matter (late side output, re-firing, EWMA), a stateful operator keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import cut
from ..operators import ivm


def as_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP, not TIMESTAMP_NTZ; the session's zone should be UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(stream: DataFrame, *, ts: str, key: str, value: str, size: str, slide: str | None = None, delay: str) -> DataFrame:
    frame = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, delay).groupBy(frame.alias("w"), F.col(key).alias("key"))
    out = out.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("window_start"), "key", "n", "total", "mean", "low", "high")


def sessions(stream: DataFrame, *, ts: str, user: str, value: str, gap: str, delay: str, min_events: int = 1) -> DataFrame:
    out = stream.withWatermark(ts, delay).groupBy(F.col(user).alias("user_id"), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value"))
    return out.filter(F.col("n_events") >= min_events).select("user_id", F.col("w.start").alias("session_start"), "n_events", "total_value")


def threshold_join(readings: DataFrame, thresholds: DataFrame, *, key: str, within: str, delay: str) -> DataFrame:
    """Readings with every threshold of their key in the lookback; state is evicted by watermark."""
    r = readings.withWatermark("reading_ts", delay)
    t = thresholds.withWatermark("threshold_ts", delay).withColumnRenamed(key, "__k")
    on = (F.col(key) == F.col("__k")) & (F.col("threshold_ts") <= F.col("reading_ts")) & (F.col("threshold_ts") >= F.col("reading_ts") - F.expr(f"INTERVAL {within}"))
    return r.join(t, on, "leftOuter").drop("__k")


def ewma(stream: DataFrame, *, key: str, ts: str, value: str, half_life_s: float) -> DataFrame:
    """The EWMA of every event; four numbers of state for each key."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import math

        last, ema, var, n = state.get if state.exists else (None, 0.0, 0.0, 0)
        out = []
        for pdf in batches:
            out.append(pdf)
        pdf = pd.concat(out).sort_values("t", kind="stable")  # the events of one micro-batch
        rows = []
        for t, v in zip(pdf["t"], pdf["v"], strict=True):
            if n == 0:
                ema, var = v, 0.0
            else:
                w = math.exp(-math.log(2) / half_life_s * max(0.0, t - last))
                ema, var = (1 - w) * v + w * ema, (1 - w) * (v - ema) ** 2 + w * var
            last, n = t, n + 1
            std = math.sqrt(var)
            rows.append((name[0], t, v, n, ema, std, 0.0 if std < 1e-9 else (v - ema) / std))
        state.update((float(last), float(ema), float(var), int(n)))
        yield pd.DataFrame(rows, columns=["key", "t", "v", "n", "ema", "ema_std", "z"])

    events = stream.select(F.col(key).cast("string").alias("key"), (F.unix_micros(ts) / 1e6).alias("t"), F.col(value).cast("double").alias("v"))
    return events.groupBy("key").applyInPandasWithState(
        update, "key string, t double, v double, n long, ema double, ema_std double, z double", "last double, ema double, var double, n long", "append", GroupStateTimeout.NoTimeout
    )


def replay(stream: DataFrame, *, partition: str, key: str, size_s: float, lag_s: float, lateness_s: float) -> DataFrame:
    """The per-event watermark engine, exact within each value of ``partition``.

    Columns seq, t, value are expected.  Emits (window_start, key, n, total, late):
    a window once its end is reached by the watermark, again as a partial result
    for events that come after that, and one row for each late event.
    """
    schema = "part string, window_start double, key string, n long, total double, late boolean"
    state_schema = "high double, starts array<double>, keys array<string>, counts array<bigint>, totals array<double>"

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, pending = float("-inf"), {}
        if state.exists:
            high, starts, keys, counts, totals = state.get
            pending = {(s, k): [c, x] for s, k, c, x in zip(starts, keys, counts, totals, strict=True)}
        out = []
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")  # one micro-batch
        for t, k, v in zip(pdf["t"], pdf["key"], pdf["value"], strict=True):
            if t > high:
                high = t
                for w in sorted(x for x in pending if x[0] + size_s <= high - lag_s):
                    n, total = pending.pop(w)
                    out.append((name[0], w[0], w[1], n, total, False))
            start = t // size_s * size_s
            if t < high - lag_s - lateness_s:
                out.append((name[0], start, k, 1, v, True))
            else:
                cell = pending.setdefault((start, k), [0, 0.0])
                cell[0] += 1
                cell[1] += v
        flat = sorted(pending.items())
        state.update((high, [w[0] for w, _ in flat], [w[1] for w, _ in flat], [c[0] for _, c in flat], [c[1] for _, c in flat]))
        yield pd.DataFrame(out, columns=["part", "window_start", "key", "n", "total", "late"])

    rows = stream.select(F.col(partition).cast("string").alias("part"), "seq", "t", F.col(key).cast("string").alias("key"), "value")
    return rows.groupBy("part").applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


class MaintainedView:
    """A view kept up by ``foreachBatch``; the batch's signed rows are its change.

    A batch that is delivered again (its number was seen) changes nothing.
    """

    def __init__(self, view: DataFrame, keys: list[str], sums: dict):
        self.view, self.keys, self.sums, self.last = cut(view), keys, sums, -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number > self.last:
            self.view = cut(ivm.merge(self.view, ivm.view_of(batch, self.keys, self.sums), self.keys))
            self.last = number


def latencies(stream_query) -> dict[str, float]:
    """Seconds of the micro-batches: mean, least, most."""
    took = [p["durationMs"].get("triggerExecution", 0) / 1000 for p in stream_query.recentProgress]
    return {"mean": sum(took) / len(took), "low": min(took), "high": max(took)} if took else {}
