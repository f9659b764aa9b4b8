"""Event-time windows: tumbling, sliding, sessions, and an exact replay of an
event-at-a-time watermark engine over a finished stream.

Nothing here orders a whole table in one task: a global order is taken in two
levels, a sort within ranges whose splitters Spark samples, and a prefix over the
summaries of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..lineage import cut

#: Rows of a range of ``in_parts``, at most by the sample; and at least, while cores are idle.
PART_ROWS, SMALL_PART = 1_000_000, 10_000


def in_parts(df: DataFrame, order: list[Column], rows: int = PART_ROWS) -> DataFrame:
    """``df`` dealt by ranges of ``order``, with __b, the number of the range.

    A range has about ``rows`` rows, whatever the keys; it is written once, so
    that every reader sees the same ranges.
    """
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, ceil(n / rows), min(cores, n // SMALL_PART))
    return cut(df.repartitionByRange(parts, *order).withColumn("__b", F.spark_partition_id()))


def stats(value: str) -> list[Column]:
    v = F.col(value)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    ]


def windowed_aggregate(df: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Count, sum, mean, min and max of each window [start, end) and key."""
    frame = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(frame.alias("w"), F.col(key).alias("key")).agg(*stats(value))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "n", "total", "mean", "low", "high")


def sessions(df: DataFrame, user: str, ts: str, gap: str, *, value: str, converted: Column, page: str) -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart, equality included."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col("event_id").alias("i"), F.col(page).alias("p")))), lambda e: e["p"])
    out = df.groupBy(F.col(user).alias("user_id"), F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum(value).alias("total_value"),
        F.bool_or(converted).alias("converted"),
        ordered.alias("pages"),
    )
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("session_start"))
    seconds = F.unix_micros(F.col("session_end").cast("timestamp")) - F.unix_micros(F.col("session_start").cast("timestamp"))
    return out.select(
        "user_id", number.cast("long").alias("session_id"), "session_start", "session_end", (seconds / 1e6).alias("duration_s"), "n_events", "total_value", "converted", "pages"
    )


def strict_sessions(df: DataFrame, user: str, ts: str, order: list[Column], *, gap_s: float, lag_s: float, value: str, converted: Column, min_events: int = 1, part_rows: int = PART_ROWS) -> DataFrame:
    """Sessions as an event-at-a-time engine makes them, late events included.

    ``ts`` is in seconds.  An event joins each open session of its user with
    start <= t <= end + gap; several become one, under the number of the earliest;
    with none it opens the next session.  Then the sessions of this user, and only
    of this one, close whose end + gap lies before the watermark (the largest time
    of all events so far less ``lag_s``), late ones at once.  closed_at is the seq
    of that event, null for those left open at the end; merged counts the sessions
    taken in.  Sessions of fewer than ``min_events`` events are not given.

    Users are dealt by hash and sorted with their events, so a task streams through
    the open sessions of one user; an event sees what the one before it left, so
    the events of one user are one task.
    """
    placed = in_order(df, order, F.col(ts).cast("double"), part_rows)
    kind = df.schema[user].dataType
    rows = placed.select(F.col(user).alias("user_id"), F.col(ts).cast("double").alias("t"), "seq", (F.col("high") - F.lit(float(lag_s))).alias("wm"), F.col(value).cast("double").alias("v"), converted.alias("c"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "seq")
    schema = T.StructType([T.StructField("user_id", kind)])
    for name, of in (("session_id", T.LongType()), ("session_start", T.DoubleType()), ("session_end", T.DoubleType()), ("n_events", T.LongType()), ("total_value", T.DoubleType()), ("converted", T.BooleanType()), ("merged", T.LongType()), ("closed_at", T.LongType())):
        schema = schema.add(name, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live, counter = object(), [], 0
        for batch in batches:
            out: list[tuple] = []
            for u, t, seq, wm, v, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if u != now:
                    out += [(now, *x, None) for x in live]
                    now, live, counter = u, [], 0
                if t is None:
                    continue
                joined = [x for x in live if x[1] <= t <= x[2] + gap_s]
                if joined:
                    first = min(joined, key=lambda x: x[1])
                    rest = [x for x in joined if x is not first]
                    live = [x for x in live if not any(x is y for y in rest)]
                else:
                    counter += 1
                    first, rest = [counter, t, t, 0, 0.0, False, 0], []
                    live.append(first)
                first[2] = max(first[2], t, *(x[2] for x in rest))
                first[3] += 1 + sum(x[3] for x in rest)
                first[4] += (v or 0.0) + sum(x[4] for x in rest)
                first[5] = bool(first[5] or c or any(x[5] for x in rest))
                first[6] += len(rest) + sum(x[6] for x in rest)
                out += [(u, *x, seq) for x in live if x[2] + gap_s < wm]
                live = [x for x in live if x[2] + gap_s >= wm]
            yield rows_of(out)
        yield rows_of([(now, *x, None) for x in live])

    names = schema.names

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out if x[4] >= min_events], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(run, schema)


def in_order(df: DataFrame, order: list[Column], running: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with seq (from 1, over all rows) and high (running max of ``running``)."""
    rows = in_parts(df, order, part_rows)
    summary = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"), F.max(running).alias("__h"))  # a row a range
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.max("__h").over(before).alias("__h0"))
    inside = Window.partitionBy("__b").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("__r", F.row_number().over(inside)).withColumn("__m", F.max(running).over(upto))
    out = ranked.join(prefix, "__b")
    return out.withColumn("seq", (F.col("__n0") + F.col("__r")).cast("long")).withColumn("high", F.greatest("__m", "__h0")).drop("__b", "__n0", "__h0", "__r", "__m")


def replay(df: DataFrame, *, arrival: str, ts: str, tie: str, lag: str, lateness: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Each event with seq, wm (the watermark after it) and is_late.

    The watermark is the largest event time so far less ``lag``; an event is late
    when it lies before the watermark, which it may have moved itself, by more
    than ``lateness``.
    """
    placed = in_order(df, [F.col(arrival), F.col(tie)], F.col(ts), part_rows)
    wm = F.col("high") - F.expr(f"INTERVAL {lag}")
    # Written: what fires, what is late and the counts all read it.
    return cut(placed.withColumn("wm", wm).withColumn("is_late", F.col(ts) < wm - F.expr(f"INTERVAL {lateness}")).drop("high"))


def fired_windows(replayed: DataFrame, *, ts: str, key: str, value: str, size: str, part_rows: int = PART_ROWS) -> DataFrame:
    """What the engine emits: partial results by window, key and fire_seq.

    A window fires at the first event whose watermark reaches its end; an event
    that comes after that, but is not late, opens it again and fires at the next
    advance of the watermark.  fire_seq null: at the final flush.
    """
    advances = replayed.groupBy("wm").agg(F.min("seq").alias("adv"))
    on_time = replayed.filter(~F.col("is_late")).withColumn("w", F.window(ts, size))
    on_time = on_time.withColumn("ws", F.col("w.start")).withColumn("we", F.col("w.end")).drop("w")
    again = F.col("wm") >= F.col("we")
    when = [F.when(again, F.col("wm")).otherwise(F.col("we")).alias("x"), F.when(again, 2).otherwise(0).alias("o")]
    parts = on_time.select("ws", "we", F.col(key).alias("key"), F.col(value).alias("v"), *when)
    marks = advances.select(F.col("wm").alias("x"), F.lit(1).alias("o"), "adv")
    # The first mark at or after a probe: in its own range, else the first one of a later range.
    probes = parts.select("x", "o").distinct().withColumn("adv", F.lit(None).cast("long"))
    merged = in_parts(probes.unionByName(marks), [F.col("x"), F.col("o")], part_rows)
    later = Window.orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    firsts = merged.groupBy("__b").agg(F.min("adv").alias("first_here"))  # a row a range; marks advance with their seq
    nexts = firsts.select("__b", F.first("first_here", ignorenulls=True).over(later).alias("later_first"))
    ahead = Window.partitionBy("__b").orderBy("x", "o").rowsBetween(0, Window.unboundedFollowing)
    found = merged.withColumn("here", F.first("adv", ignorenulls=True).over(ahead)).filter(F.col("o") != 1)
    fire = found.join(nexts, "__b").select("x", "o", F.coalesce("here", "later_first").alias("fire_seq"))
    out = parts.join(fire, ["x", "o"]).groupBy("ws", "we", "key", "fire_seq").agg(*stats("v"))
    return out.select(F.col("ws").alias("window_start"), F.col("we").alias("window_end"), "key", "fire_seq", "n", "total", "mean", "low", "high")


def late_rows(replayed: DataFrame, *, ts: str, key: str, value: str, size: str) -> DataFrame:
    """The side output: one row for each late event and window."""
    late = replayed.filter("is_late").withColumn("w", F.window(ts, size))
    return late.select("seq", F.col("w.start").alias("window_start"), F.col(key).alias("key"), F.col(value).alias("value"))


def replay_stats(replayed: DataFrame, fired: DataFrame) -> DataFrame:
    """processed, late, closed (window and key rows) and the last watermark."""
    events = replayed.agg(F.count(F.lit(1)).alias("processed"), F.count_if("is_late").alias("late"), F.max("wm").alias("watermark"))
    return events.crossJoin(fired.agg(F.count(F.lit(1)).alias("closed")))
