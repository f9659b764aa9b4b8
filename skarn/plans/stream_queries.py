"""Queries over the event stream: windows, replay, sessions, sketches, EWMA, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sketches as S
from ..operators import temporal as X
from ..operators import windows as W
from ..registry import query, r4, table

LAG, LATENESS = "4 HOURS", "2 HOURS"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r4(c) for c in ("total", "mean", "low", "high") if c in df.columns})


_STATS = "count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high"


@query(f"""
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, event_type AS key, {_STATS}
FROM events GROUP BY 1, 2, 3""")
def tumbling_window_agg(spark, sf_dir):
    return _rounded(W.windowed_aggregate(_events(spark, sf_dir), "ts", "event_type", "value", "1 day"))


@query(f"""
WITH placed AS (
    SELECT *, make_timestamp((epoch_us(ts) // 21600000000 - k) * 21600000000) AS window_start FROM events, range(4) r(k)
)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type AS key, {_STATS}
FROM placed GROUP BY 1, 2, 3""")
def sliding_window_agg(spark, sf_dir):
    return _rounded(W.windowed_aggregate(_events(spark, sf_dir), "ts", "event_type", "value", "1 day", "6 hours"))


@query("""
SELECT event_type AS key, CASE WHEN grouping(event_type) = 1 THEN 1 ELSE 0 END AS is_total, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ROLLUP (event_type)""")
def event_rollup(spark, sf_dir):
    out = _events(spark, sf_dir).rollup("event_type").agg(F.grouping("event_type").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), r4(F.sum("value")).alias("total"))
    return out.withColumnRenamed("event_type", "key")


# --- watermark replay ---------------------------------------------------------


def _arrivals(spark, sf_dir) -> DataFrame:
    """Events with a deterministic jitter of their arrival."""
    delay = F.make_dt_interval(mins=((F.col("event_id") * 7919) % 97 * 10).cast("int"))
    return _events(spark, sf_dir).withColumn("arrival", F.col("ts") + delay)


def _replayed(spark, sf_dir) -> DataFrame:
    return W.replay(_arrivals(spark, sf_dir), arrival="arrival", ts="ts", tie="event_id", lag=LAG, lateness=LATENESS)


_REPLAY = """
WITH s AS (
    SELECT *, row_number() OVER o AS seq, max(ts) OVER o - INTERVAL 4 HOUR AS wm
    FROM (SELECT *, ts + to_minutes((event_id * 7919) % 97 * 10) AS arrival FROM events)
    WINDOW o AS (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)
), adv AS (SELECT wm, min(seq) AS seq FROM s GROUP BY wm),
on_time AS (
    SELECT *, date_trunc('day', ts)::TIMESTAMP AS ws, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS we
    FROM s WHERE ts >= wm - INTERVAL 2 HOUR
), closing AS (SELECT we, (SELECT min(seq) FROM adv WHERE adv.wm >= e.we) AS f FROM (SELECT DISTINCT we FROM on_time) e),
reopening AS (SELECT wm, lead(seq) OVER (ORDER BY wm) AS f FROM adv),
fired AS (
    SELECT o.ws AS window_start, o.we AS window_end, o.event_type AS key, o.value,
           CASE WHEN o.wm < o.we THEN c.f ELSE r.f END AS fire_seq
    FROM on_time o JOIN closing c ON o.we = c.we JOIN reopening r ON o.wm = r.wm
)"""


@query(f"{_REPLAY} SELECT window_start, window_end, key, fire_seq, {_STATS} FROM fired GROUP BY ALL")
def watermark_replay_windows(spark, sf_dir):
    return _rounded(W.fired_windows(_replayed(spark, sf_dir), ts="ts", key="event_type", value="value", size="1 day"))


@query(f"""{_REPLAY} SELECT seq, date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS key, value
FROM s WHERE ts < wm - INTERVAL 2 HOUR""")
def late_side_output(spark, sf_dir):
    return W.late_rows(_replayed(spark, sf_dir), ts="ts", key="event_type", value="value", size="1 day")


@query(f"""{_REPLAY} SELECT (SELECT count(*) FROM s) AS processed, (SELECT count(*) FROM s WHERE ts < wm - INTERVAL 2 HOUR) AS late,
(SELECT max(wm) FROM s) AS watermark, (SELECT count(*) FROM (SELECT DISTINCT window_start, key, fire_seq FROM fired)) AS closed""")
def watermark_stats(spark, sf_dir):
    replayed = _replayed(spark, sf_dir)
    return W.replay_stats(replayed, W.fired_windows(replayed, ts="ts", key="event_type", value="value", size="1 day"))


# --- sessions -----------------------------------------------------------------


def _sessions(spark, sf_dir) -> DataFrame:
    return W.sessions(_events(spark, sf_dir), "user_id", "ts", "6 hours", value="value", converted=F.col("event_type") == "purchase", page="event_type")


_SESSIONS = """
WITH gaps AS (
    SELECT *, CASE WHEN ts <= lag(ts) OVER u + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events
    WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (
    SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM gaps
), sessions AS (
    SELECT user_id, session_id, min(ts)::TIMESTAMP AS session_start, max(ts)::TIMESTAMP AS session_end,
           (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS duration_s, count(*) AS n_events, sum(value) AS total_value,
           bool_or(event_type = 'purchase') AS converted, string_agg(event_type, ',' ORDER BY ts, event_id) AS pages
    FROM numbered GROUP BY user_id, session_id
)"""


@query(f"""{_SESSIONS} SELECT user_id, session_id, session_start, session_end, round(duration_s, 6) AS duration_s, n_events,
round(total_value, 4) AS total_value, converted FROM sessions""")
def session_windows(spark, sf_dir):
    return _sessions(spark, sf_dir).drop("pages").withColumns({"duration_s": F.round("duration_s", 6), "total_value": r4("total_value")})


@query(f"{_SESSIONS} SELECT user_id, session_id, n_events, round(total_value, 4) AS total_value FROM sessions WHERE n_events >= 2")
def session_min_events(spark, sf_dir):
    return _sessions(spark, sf_dir).filter("n_events >= 2").select("user_id", "session_id", "n_events", r4("total_value").alias("total_value"))


_OPEN = "STRUCT(id BIGINT, s DOUBLE, e DOUBLE, n BIGINT, v DOUBLE, c BOOLEAN, m BIGINT)[]"


@query(f"""WITH RECURSIVE arrived AS (
    SELECT *, row_number() OVER o AS seq, epoch_us(max(ts) OVER o) / 1e6 - 14400 AS wm
    FROM (SELECT *, ts + to_minutes((event_id * 7919) % 97 * 10) AS arrival FROM events)
    WINDOW o AS (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)
), o AS (
    SELECT user_id, epoch_us(ts) / 1e6 AS t, seq, wm, value AS v, event_type = 'purchase' AS c, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM arrived
), walk AS (
    SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS counter, []::{_OPEN} AS live, []::{_OPEN} AS closed, 0::BIGINT AS seq FROM o
    UNION ALL
    SELECT user_id, k, counter, list_filter(live, lambda x: x.e + 21600 >= wm), list_filter(live, lambda x: x.e + 21600 < wm), seq FROM (
        SELECT user_id, k, seq, wm, counter + CASE WHEN len(met) = 0 THEN 1 ELSE 0 END AS counter, list_append(rest, CASE WHEN len(met) = 0
            THEN struct_pack(id := counter + 1, s := t, e := t, n := 1::BIGINT, v := v, c := c, m := 0::BIGINT)
            ELSE struct_pack(id := list_min(list_transform(met, lambda x: struct_pack(s := x.s, id := x.id))).id,
                s := least(t, list_min(list_transform(met, lambda x: x.s))), e := greatest(t, list_max(list_transform(met, lambda x: x.e))),
                n := (1 + list_sum(list_transform(met, lambda x: x.n)))::BIGINT, v := v + list_sum(list_transform(met, lambda x: x.v)),
                c := c OR list_bool_or(list_transform(met, lambda x: x.c)), m := (len(met) - 1 + list_sum(list_transform(met, lambda x: x.m)))::BIGINT) END) AS live
        FROM (
            SELECT o.*, w.counter, list_filter(w.live, lambda x: x.s <= o.t AND o.t <= x.e + 21600) AS met, list_filter(w.live, lambda x: NOT (x.s <= o.t AND o.t <= x.e + 21600)) AS rest
            FROM walk w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1
        )
    )
), given AS (
    SELECT user_id, unnest(closed) AS x, seq AS closed_at FROM walk
    UNION ALL SELECT user_id, unnest(live), NULL FROM walk WHERE (user_id, k) IN (SELECT (user_id, max(k)) FROM walk GROUP BY user_id)
)
SELECT user_id, x.id AS session_id, round(x.s, 6) AS session_start, round(x.e, 6) AS session_end, x.n AS n_events, round(x.v, 4) AS total_value, x.c AS converted, x.m AS merged, closed_at FROM given""")
def session_windows_strict(spark, sf_dir):
    """Sessions of events that arrive late, as an event-at-a-time engine closes and merges them."""
    e = _arrivals(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = W.strict_sessions(e, "user_id", "t", [F.col("arrival"), F.col("event_id")], gap_s=21600.0, lag_s=14400.0, value="value", converted=F.col("event_type") == "purchase")
    return out.withColumns({"session_start": F.round("session_start", 6), "session_end": F.round("session_end", 6), "total_value": r4("total_value")})


@query(f"""{_SESSIONS} SELECT count(*) AS n_sessions, round(avg(duration_s), 4) AS avg_duration_s, round(avg(n_events), 4) AS avg_events,
round(sum(CASE WHEN converted THEN total_value ELSE 0 END), 4) AS revenue, round(100.0 * avg(CASE WHEN converted THEN 1 ELSE 0 END), 4) AS conversion_pct FROM sessions""")
def session_rollup(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    return s.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        r4(F.avg("duration_s")).alias("avg_duration_s"),
        r4(F.avg("n_events")).alias("avg_events"),
        r4(F.sum(F.when(F.col("converted"), F.col("total_value")).otherwise(0.0))).alias("revenue"),
        r4(100.0 * F.avg(F.col("converted").cast("int"))).alias("conversion_pct"),
    )


@query(f"{_SESSIONS} SELECT user_id, session_id, pages FROM sessions")
def session_pages(spark, sf_dir):
    return _sessions(spark, sf_dir).select("user_id", "session_id", F.array_join("pages", ",").alias("pages"))


# --- sketches -------------------------------------------------------------------

_AB = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(S.COEFFICIENTS))
_CMS = f"""
WITH ab(row, a, b) AS (VALUES {_AB}),
items AS (SELECT 'user-' || user_id AS item, event_id FROM events),
hashed AS (SELECT item, event_id, ('0x' || right(sha256(item), 8))::BIGINT & 2147483647 AS h FROM items),
cells AS (SELECT item, event_id, row, ((a * h + b) % 2147483647) % 2719 AS col FROM hashed, ab),
sketch AS (SELECT row, col, count(*) AS cnt FROM cells GROUP BY row, col),
estimates AS (
    SELECT item, min(cnt) AS estimate FROM (SELECT DISTINCT item, row, col FROM cells) JOIN sketch USING (row, col) GROUP BY item
)"""


def _users(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(F.concat(F.lit("user-"), "user_id").alias("item"), "event_id", "ts")


@query(f"{_CMS} SELECT item, estimate, (SELECT count(*) FROM items i WHERE i.item = e.item) AS exact FROM estimates e")
def cms_estimate(spark, sf_dir):
    users = _users(spark, sf_dir)
    exact = users.groupBy("item").agg(F.count(F.lit(1)).alias("exact"))
    return S.cms_query(S.cms(users, F.col("item")), exact.select("item"), "item").join(exact, "item")


@query(f"""{_CMS} SELECT 'full' AS sketch, count(*) AS cells, sum(cnt)::BIGINT AS total FROM sketch
UNION ALL SELECT 'merged', count(*), sum(cnt)::BIGINT FROM sketch UNION ALL SELECT 'different', 0, 0""")
def cms_merge_equals_full(spark, sf_dir):
    users = _users(spark, sf_dir)
    full = S.cms(users, F.col("item"))
    halves = [S.cms(users.filter(F.col("event_id") % 2 == i), F.col("item")) for i in (0, 1)]
    merged = S.cms_merge(*halves)
    different = full.join(merged.withColumnRenamed("cnt", "other"), ["row", "col"], "full_outer").filter(~F.col("cnt").eqNullSafe(F.col("other")))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total")).select(F.lit(name).alias("sketch"), "cells", "total")
    return count(full, "full").unionByName(count(merged, "merged")).unionByName(count(different.select("cnt"), "different"))


@query(f"{_CMS} SELECT item, estimate FROM estimates ORDER BY estimate DESC, item LIMIT 10")
def cms_heavy_hitters(spark, sf_dir):
    users = _users(spark, sf_dir)
    estimates = S.cms_query(S.cms(users, F.col("item")), users.select("item").distinct(), "item")
    return estimates.orderBy(F.desc("estimate"), "item").limit(10)


@query("""SELECT 2719 AS width, 5 AS depth, round(exp(1) / 2719, 10) AS epsilon, round(exp(-5), 10) AS delta, 2719 * 5 * 8 AS bytes,
round(1.04 / sqrt(4096), 10) AS hll_error, 4096 AS hll_bytes""")
def sketch_diagnostics(spark, sf_dir):
    b = S.cms_bounds()
    return spark.range(1).select(
        F.lit(S.WIDTH).alias("width"), F.lit(S.DEPTH).alias("depth"), F.round(F.lit(b["epsilon"]), 10).alias("epsilon"), F.round(F.lit(b["delta"]), 10).alias("delta"),
        F.lit(int(b["bytes"])).alias("bytes"), F.round(F.lit(1.04) / F.sqrt(F.lit(4096.0)), 10).alias("hll_error"), F.lit(4096).alias("hll_bytes"),
    )


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def exact_top_k(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("""SELECT count(DISTINCT user_id) AS users, (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'error')) AS either FROM events""")
def exact_distinct(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(F.col("event_type").isin("purchase", "error"), F.col("user_id"))).alias("either"))


def _hll_sql(p: int, where: str = "TRUE", by: str = "") -> str:
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    comma = f"{by}, " if by else ""
    return f"""
    SELECT {comma}CAST(round_even(CASE WHEN raw <= {2.5 * m} AND v > 0 THEN {float(m)} * ln({float(m)} / v) ELSE raw END, 0) AS BIGINT) AS estimate
    FROM (SELECT {comma}{m} - count(*) AS v, {alpha * m * m!r} / (sum(pow(2.0::DOUBLE, -rho)) + {m} - count(*)) AS raw
          FROM (SELECT {comma}bucket, max(rho) AS rho FROM (
                SELECT {comma}h >> {64 - p} AS bucket,
                       {64 - p + 1} - length(ltrim(bin(h & {(1 << (64 - p)) - 1}::UBIGINT), '0')) AS rho
                FROM (SELECT {comma}('0x' || substr(sha256('user-' || user_id), 1, 16))::UBIGINT AS h FROM hll_source WHERE {where}))
                GROUP BY ALL) GROUP BY ALL)"""


@query("WITH hll_source AS (SELECT * FROM events)" + " UNION ALL ".join(f" SELECT {p} AS p, estimate FROM ({_hll_sql(p)})" for p in (6, 8, 10, 12, 14)))
def hll_count(spark, sf_dir):
    users = _users(spark, sf_dir).select("item").distinct()
    out = None
    for p in (6, 8, 10, 12, 14):
        one = S.hll_estimate(S.hll_registers(users, F.col("item"), p), p).select(F.lit(p).alias("p"), "estimate")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH hll_source AS (SELECT * FROM events) SELECT estimate, (SELECT count(DISTINCT user_id) FROM events) AS exact FROM ({_hll_sql(12)})")
def hll_merge(spark, sf_dir):
    users = _users(spark, sf_dir)
    parts = [S.hll_registers(users.filter(F.col("event_id") % 2 == i), F.col("item")) for i in (0, 1)]
    exact = users.agg(F.countDistinct("item").alias("exact"))
    return S.hll_estimate(S.hll_merge(*parts)).crossJoin(exact)  # one row each


@query(f"""WITH stream AS (SELECT max(event_id) + 1 AS n FROM events), marks AS (
    SELECT c FROM (VALUES (100), (500), (1000), (5000), (10000)) v(c) UNION SELECT greatest(n, 10000) FROM stream
    UNION SELECT m * power(10, k)::BIGINT FROM (VALUES (1), (5)) v(m), range(4, 18) r(k), stream WHERE m * power(10, k) < n
), hll_source AS (SELECT c AS upto, user_id FROM events JOIN marks ON event_id < c)
SELECT e.upto, e.estimate, x.exact FROM ({_hll_sql(12, by='upto')}) e JOIN (SELECT upto, count(DISTINCT user_id) AS exact FROM hll_source GROUP BY upto) x ON e.upto = x.upto""")
def hll_checkpoints(spark, sf_dir):
    """Marks at 100 to 10000, then 50000, 100000, 500000 and so on, and one after the last event."""
    users = _users(spark, sf_dir)
    end = (users.agg(F.max("event_id")).first()[0] or 0) + 1
    more = {m * 10**k for k in range(4, len(str(end))) for m in (1, 5) if m * 10**k < end} | {max(end, 10000)}
    upto = sorted({100, 500, 1000, 5000, 10000} | more)
    marks = F.filter(F.array(*[F.lit(c).cast("long") for c in upto]), lambda c: F.col("event_id") < c)
    users = users.select("item", F.explode(marks).alias("upto"))
    exact = users.groupBy("upto").agg(F.countDistinct("item").alias("exact"))
    return S.hll_estimate(S.hll_registers(users, F.col("item"), 12, ["upto"]), 12, ["upto"]).join(exact, "upto")


@query()
def native_sketches(spark, sf_dir):
    """Spark's own sketches beside the exact relational ones; approximate, so rows only."""
    users = _users(spark, sf_dir)
    return users.agg(
        F.approx_count_distinct("item").alias("approx_distinct"),
        F.hll_sketch_estimate(F.hll_sketch_agg("item", 12)).alias("hll"),
        F.length(F.expr("count_min_sketch(item, 0.001D, 0.99D, 42)")).alias("cms_bytes"),
        F.to_json(F.expr("approx_top_k(item, 10)")).alias("top"),
    )


@query("""WITH weights AS (SELECT i, 1 / pow(i, 1.2) AS w FROM range(1, 101) r(i)), cum AS (SELECT i, sum(w) OVER (ORDER BY i) / sum(w) OVER () AS c FROM weights),
draws AS (SELECT event_id, ((event_id * 7919) % 10007 + 0.5) / 10007 AS u FROM events)
SELECT 'item-' || lpad(CAST(i AS VARCHAR), 5, '0') AS item, count(*) AS n FROM (SELECT event_id, min(i) AS i FROM draws JOIN cum ON u <= c + 1e-12 GROUP BY event_id) GROUP BY 1""")
def zipf_stream(spark, sf_dir):
    from ..sources.generators import zipf_items

    u = ((F.col("event_id") * 7919) % 10007 + 0.5) / 10007
    return zipf_items(_events(spark, sf_dir).select("event_id"), u, 100, 1.2).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


# --- EWMA, as-of join, anomalies ---------------------------------------------------


def _ewma_sql(half_life: float, name: str = "scored") -> str:
    return f"""
    ordered AS (
        SELECT event_type AS key, event_id, ts, value, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events
    ), {name} AS (
        SELECT key, n, t, event_id, value, value AS ema, CAST(0 AS DOUBLE) AS var FROM ordered WHERE n = 1
        UNION ALL
        SELECT o.key, o.n, o.t, o.event_id, o.value,
               (1 - exp(-ln(2.0::DOUBLE) / {half_life} * greatest(0, o.t - s.t))) * o.value + exp(-ln(2.0::DOUBLE) / {half_life} * greatest(0, o.t - s.t)) * s.ema,
               (1 - exp(-ln(2.0::DOUBLE) / {half_life} * greatest(0, o.t - s.t))) * (o.value - s.ema) * (o.value - s.ema) + exp(-ln(2.0::DOUBLE) / {half_life} * greatest(0, o.t - s.t)) * s.var
        FROM {name} s JOIN ordered o ON o.key = s.key AND o.n = s.n + 1
    )"""


def _scored(spark, sf_dir, half_life: float) -> DataFrame:
    return X.ewma(_events(spark, sf_dir), key="event_type", ts="ts", tie="event_id", value="value", half_life_s=half_life)


DAY = 86400.0


@query(f"""WITH RECURSIVE {_ewma_sql(DAY)} SELECT key, event_id, n, round(ema, 4) AS ema, round(sqrt(var), 4) AS ema_std FROM scored""")
def ewma_state(spark, sf_dir):
    return _scored(spark, sf_dir, DAY).select("key", "event_id", "n", r4("ema").alias("ema"), r4("ema_std").alias("ema_std"))


@query("WITH RECURSIVE " + _ewma_sql(DAY / 4, "a") + ", " + _ewma_sql(DAY, "b").replace("ordered AS", "ordered_b AS").replace("FROM ordered WHERE", "FROM ordered_b WHERE").replace("JOIN ordered o", "JOIN ordered_b o")
       + ", " + _ewma_sql(7 * DAY, "c").replace("ordered AS", "ordered_c AS").replace("FROM ordered WHERE", "FROM ordered_c WHERE").replace("JOIN ordered o", "JOIN ordered_c o")
       + """, everything AS (SELECT 6 AS half_life_h, * FROM a UNION ALL SELECT 24, * FROM b UNION ALL SELECT 168, * FROM c)
SELECT half_life_h, key, count(*) AS n, round(avg(abs(value - ema)), 4) AS mean_distance, round(arg_max(ema, n), 4) AS last_ema FROM everything GROUP BY 1, 2""")
def ewma_half_life_compare(spark, sf_dir):
    out = None
    for hours in (6, 24, 168):
        one = _scored(spark, sf_dir, hours * 3600.0).groupBy(F.lit(hours).alias("half_life_h"), "key").agg(
            F.count(F.lit(1)).alias("count"), r4(F.avg(F.abs(F.col("value") - F.col("ema")))).alias("mean_distance"), r4(F.max_by("ema", "n")).alias("last_ema")
        )
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("count", "n")


def _thresholds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value")
    return e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'").withColumnRenamed("value", "threshold")


def _with_threshold(spark, sf_dir) -> DataFrame:
    readings, thresholds = _thresholds(spark, sf_dir)
    return X.asof_join(readings, thresholds, key="user_id", ts="ts", tie="event_id", value="threshold", within="1 DAY")


_ASOF = """
readings AS (SELECT event_id, user_id, event_type, ts, value FROM events WHERE event_type <> 'purchase'),
thresholds AS (SELECT event_id AS tid, user_id, ts AS tts, value AS threshold FROM events WHERE event_type = 'purchase'),
matched AS (
    SELECT r.*, (SELECT arg_max(threshold, (tts, tid)) FROM thresholds t WHERE t.user_id = r.user_id AND t.tts <= r.ts AND t.tts >= r.ts - INTERVAL 1 DAY) AS threshold
    FROM readings r
)"""


@query(f"WITH {_ASOF} SELECT event_id, user_id, value, threshold FROM matched")
def asof_threshold_join(spark, sf_dir):
    return _with_threshold(spark, sf_dir).select("event_id", "user_id", "value", "threshold")


def _strict(spark, sf_dir) -> DataFrame:
    arrivals = _arrivals(spark, sf_dir)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = arrivals.select("event_id", "user_id", "event_type", "value", seconds("ts").alias("t"), (seconds("arrival") + F.col("event_id") * 1e-5).alias("at"))
    readings, thresholds = e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'").withColumnRenamed("value", "threshold")
    return X.asof_join_evicting(readings, thresholds, key="user_id", ts="t", arrival="at", value="threshold", within_s=DAY, lag_s=4 * 3600.0)


@query("""WITH s AS (
    SELECT *, epoch_us(ts) / 1e6 AS t, row_number() OVER o AS seq, max(epoch_us(ts) / 1e6) OVER o AS high
    FROM (SELECT *, epoch_us(ts + to_minutes((event_id * 7919) % 97 * 10)) / 1e6 + event_id * 1e-5 AS arrival FROM events)
    WINDOW o AS (ORDER BY arrival ROWS UNBOUNDED PRECEDING)
)
SELECT event_id, user_id, (SELECT arg_max(v.value, v.seq) FROM s v WHERE v.event_type = 'purchase' AND v.user_id = r.user_id AND v.seq < r.seq
    AND v.t <= r.t AND v.t >= r.t - 86400 AND v.t >= r.high - 14400 - 86400) AS threshold
FROM s r WHERE event_type <> 'purchase'""")
def asof_threshold_join_strict(spark, sf_dir):
    return _strict(spark, sf_dir).select("event_id", "user_id", "threshold")


def _alerts(spark, sf_dir) -> DataFrame:
    """Readings of a type scored by the EWMA of that type, against the user's threshold."""
    readings, _ = _thresholds(spark, sf_dir)
    scored = X.ewma(readings, key="event_type", ts="ts", tie="event_id", value="value", half_life_s=7 * DAY)
    joined = scored.join(_with_threshold(spark, sf_dir).select("event_id", "user_id", "threshold"), "event_id")
    return X.alerts(joined, threshold="threshold", warmup=5, z_limit=2.0)


_ALERTS = f"""WITH RECURSIVE {_ASOF}, {_ewma_sql(7 * DAY).replace("FROM events", "FROM readings")},
alerts AS (
    SELECT s.event_id, s.key, m.user_id, s.value, m.threshold,
           CASE WHEN sqrt(s.var) < 1e-9 OR s.n = 1 THEN 0 ELSE (s.value - s.ema) / sqrt(s.var) END AS z, s.n
    FROM scored s JOIN matched m ON s.event_id = m.event_id
), judged AS (
    SELECT *, CASE WHEN abs(z) > 2.0 AND coalesce(value > threshold, FALSE) THEN 'both' WHEN abs(z) > 2.0 THEN 'z_score'
                   WHEN coalesce(value > threshold, FALSE) THEN 'threshold' END AS triggered_by
    FROM alerts WHERE n >= 5
)"""


@query(f"{_ALERTS} SELECT event_id, key, user_id, value, threshold, round(z, 4) AS z, triggered_by FROM judged WHERE triggered_by IS NOT NULL")
def anomaly_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).select("event_id", "key", "user_id", "value", "threshold", r4("z").alias("z"), "triggered_by")


@query(f"{_ALERTS} SELECT key, triggered_by, count(*) AS n FROM judged WHERE triggered_by IS NOT NULL GROUP BY 1, 2")
def anomaly_breakdown(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("key", "triggered_by").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) > 2 AS a, sum(value) > 100 AS b, bool_or(event_type = 'error') AS c FROM events GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, a::INT + b::INT + c::INT AS votes FROM d WHERE a::INT + b::INT + c::INT >= 2""")
def vote_2_of_3(spark, sf_dir):
    e = _events(spark, sf_dir)
    votes = [(F.count(F.lit(1)) > 2), (F.sum("value") > 100), F.bool_or(F.col("event_type") == "error")]
    out = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(sum((v.cast("int") for v in votes), F.lit(0)).alias("votes"))
    return out.filter("votes >= 2")


@query("""WITH mid AS (SELECT DATE '2024-01-10' AS d), seen AS (SELECT DISTINCT user_id, event_type FROM events, mid WHERE ts < d),
fresh AS (SELECT DISTINCT user_id, event_type FROM events, mid WHERE ts >= d)
SELECT f.user_id, f.event_type FROM fresh f LEFT JOIN seen s ON f.user_id = s.user_id AND f.event_type = s.event_type WHERE s.user_id IS NULL""")
def new_device_diff(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", "ts")
    mid = F.lit("2024-01-10").cast("timestamp_ntz")
    pair = ["user_id", "event_type"]
    return e.filter(F.col("ts") >= mid).select(*pair).distinct().join(e.filter(F.col("ts") < mid).select(*pair), pair, "left_anti")


@query("SELECT event_id, event_type, ts::TIMESTAMP AS ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE (k - 1) % 4 = 0 OR event_type = 'error'")
def step_sampling(spark, sf_dir):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).withColumn("k", k).filter(((F.col("k") - 1) % 4 == 0) | (F.col("event_type") == "error")).select("event_id", "event_type", "ts")
