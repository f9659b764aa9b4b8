"""Queries of the daily series, forecasts, sentiment, reports and documents."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import direction, error_bucket, file_name, sentiment_label
from ..operators import ask as A
from ..operators import market as M
from ..registry import query, r4, table
from ..sources import parsers as P

TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _r(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals by priority, as daily closes of five tickers."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))


_S = "s AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS close FROM orders GROUP BY 1, 2)"
_RET = f"{_S}, r AS (SELECT *, (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS change_pct FROM s)"
_D = "CAST(date AS VARCHAR) AS date"


# --- constituents ---------------------------------------------------------------------


def _listed(spark, sf_dir) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.format_string("S.%d", "s_suppkey").alias(" Ticker "), F.col("s_name").alias("Company Name"), F.col("r_name").alias("GICS Sector"), F.col("n_name").alias("GICS Sub–Industry"))


_L = """listed AS (SELECT 'S-' || s_suppkey AS "Symbol", s_name AS "Security", r_name AS "Sector", n_name AS "Industry"
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {_L} SELECT * FROM listed")
def constituents_normalize(spark, sf_dir):
    return M.normalize_constituents(_listed(spark, sf_dir))


@query(f"""WITH {_L} SELECT * FROM listed WHERE regexp_matches(lower("Sector"), 'asia') OR regexp_matches(lower("Industry"), 'asia')""")
def industry_filter(spark, sf_dir):
    return M.filter_by_industry(M.normalize_constituents(_listed(spark, sf_dir)), "Asia")


@query(f"""WITH {_L} SELECT * FROM listed WHERE regexp_matches(lower("Security"), 'supplier')""")
def industry_fallback(spark, sf_dir):
    return M.filter_by_industry(M.normalize_constituents(_listed(spark, sf_dir)), "supplier")


@query(f"""WITH {_L} SELECT "Symbol" FROM listed ORDER BY "Symbol" LIMIT 5""")
def limit_n(spark, sf_dir):
    return M.normalize_constituents(_listed(spark, sf_dir)).select("Symbol").orderBy("Symbol").limit(5)


@query(f"""WITH {_L} SELECT "Symbol", regexp_replace(trim(regexp_replace(lower("Security" || ' & ' || "Industry"), '[^0-9a-z _-]', '', 'g')), ' ', '_', 'g') AS file FROM listed""")
def report_file_names(spark, sf_dir):
    c = M.normalize_constituents(_listed(spark, sf_dir))
    return c.select("Symbol", file_name(F.concat_ws(" & ", "Security", "Industry")).alias("file"))


# --- sentiment ----------------------------------------------------------------------------


#: The given texts are of made-up words, so the queries have a lexicon of frequent ones.
_LEXICON, _NEGATIONS, _BOOSTERS = {"the": 1.9, "and": 3.1, "of": -1.9, "in": -3.1}, ["to", "not"], {"is": 0.293, "a": -0.293}


def _scored(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    date = F.date_add(F.lit(datetime.date(1992, 1, 1)), (F.col("doc_id") % 60).cast("int"))
    return d.select("doc_id", date.alias("date"), M.lexicon_score(F.col("text"), _LEXICON, _NEGATIONS, _BOOSTERS).alias("score"))


def _case(word: str, values: dict[str, float]) -> str:
    return f"CASE {word} {' '.join(f"WHEN '{w}' THEN {v}" for w, v in values.items())} ELSE 0.0 END"


_NOT = ", ".join(f"'{w}'" for w in _NEGATIONS)
_SENT = f"""valued AS (
    SELECT doc_id, list_transform(w, lambda x, i: CAST({_case("x", _LEXICON)} AS DOUBLE)) AS v,
           list_transform(w, lambda x, i: CAST({_case("x", _BOOSTERS)} AS DOUBLE)) AS b, list_transform(w, lambda x, i: x IN ({_NOT})) AS neg
    FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z'']+') AS w FROM documents WHERE text IS NOT NULL)
), scored AS (
    SELECT doc_id, DATE '1992-01-01' + CAST(doc_id % 60 AS INTEGER) AS date, n / sqrt(n * n + 15.0) AS score FROM (
        SELECT doc_id, list_sum(list_transform(v, lambda x, i: (x + sign(x) * coalesce(b[greatest(i - 1, 0)], 0))
            * CASE WHEN coalesce(neg[greatest(i - 1, 0)], false) OR coalesce(neg[greatest(i - 2, 0)], false) OR coalesce(neg[greatest(i - 3, 0)], false)
                   THEN {M.NEGATED} ELSE 1 END)) AS n FROM valued)
), daily AS (
    SELECT date, count(*) FILTER (WHERE score >= 0.05) AS pos, count(*) FILTER (WHERE score <= -0.05) AS neg,
           count(*) FILTER (WHERE score < 0.05 AND score > -0.05) AS neu, count(*) AS total, avg(score) AS sentiment_score FROM scored GROUP BY date
)"""


@query(f"WITH {_SENT} SELECT {_D}, pos, neg, neu, total, round(sentiment_score, 4) AS sentiment_score FROM daily")
def daily_sentiment(spark, sf_dir):
    return _day(_r(M.daily_sentiment(_scored(spark, sf_dir), "date", "score"), "sentiment_score"))


@query(f"WITH {_SENT} SELECT doc_id, round(score, 4) AS score, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM scored")
def sentiment_labels(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", r4("score").alias("score"), sentiment_label(F.col("score")).alias("label"))


def _joined(spark, sf_dir) -> DataFrame:
    return M.with_sentiment(_series(spark, sf_dir), M.daily_sentiment(_scored(spark, sf_dir), "date", "score"))


@query(f"""WITH {_S}, {_SENT} SELECT ticker, CAST(s.date AS VARCHAR) AS date, close, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(neu, 0) AS neu,
coalesce(total, 0) AS total, round(coalesce(sentiment_score, 0), 4) AS sentiment_score FROM s LEFT JOIN daily ON s.date = daily.date""")
def price_sentiment_left_join(spark, sf_dir):
    return _day(_r(_joined(spark, sf_dir), "sentiment_score"))


@query(f"""WITH {_SENT} SELECT round(avg(sentiment_score), 4) AS tail_mean FROM (SELECT * FROM daily ORDER BY date DESC LIMIT 5)""")
def tail_mean(spark, sf_dir):
    return M.daily_sentiment(_scored(spark, sf_dir), "date", "score").orderBy(F.desc("date")).limit(5).agg(r4(F.avg("sentiment_score")).alias("tail_mean"))


@query(f"""WITH RECURSIVE {_SENT}, o AS (SELECT date, sentiment_score AS v, row_number() OVER (ORDER BY date) AS n FROM daily),
e AS (SELECT date, n, v, v AS m FROM o WHERE n = 1 UNION ALL SELECT o.date, o.n, o.v, o.v * 0.5 + e.m * 0.5 FROM e JOIN o ON o.n = e.n + 1)
SELECT {_D}, round(v, 4) AS sentiment_score, round(m, 4) AS smoothed FROM e""")
def sentiment_ewma(spark, sf_dir):
    daily = M.daily_sentiment(_scored(spark, sf_dir), "date", "score")
    return _day(_r(M.smoothed(daily, "sentiment_score", 3), "sentiment_score", "smoothed"))


# --- series -----------------------------------------------------------------------------------


@query(f"""WITH {_S} SELECT {_D}, """ + ", ".join(f"max(close) FILTER (WHERE ticker = '{t}') AS \"{t}\"" for t in TICKERS) + " FROM s GROUP BY s.date")
def closes_wide_outer(spark, sf_dir):
    return _day(M.closes_wide(_series(spark, sf_dir), TICKERS))


@query(f"""WITH {_S} SELECT ticker, count(close) AS n, round(avg(close), 3) AS mean, round(stddev_samp(close), 3) AS std, min(close) AS low,
round(quantile_cont(close, 0.25), 3) AS q1, round(quantile_cont(close, 0.5), 3) AS median, round(quantile_cont(close, 0.75), 3) AS q3, max(close) AS high FROM s GROUP BY ticker""")
def describe(spark, sf_dir):
    return _r(M.describe(_series(spark, sf_dir), "close"), "mean", "std", "q1", "median", "q3", places=3)


@query(f"WITH {_RET} SELECT ticker, {_D}, round(change_pct, 4) AS change_pct FROM r")
def daily_returns(spark, sf_dir):
    return _day(_r(M.returns(_series(spark, sf_dir)).select("ticker", "date", "change_pct"), "change_pct"))


@query(f"WITH {_S} SELECT ticker, round((arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100, 4) AS total_return_pct FROM s GROUP BY ticker")
def total_return(spark, sf_dir):
    return _r(M.total_return(_series(spark, sf_dir)), "total_return_pct")


@query(f"WITH {_RET} SELECT ticker, round(stddev_samp(change_pct), 4) AS volatility FROM r GROUP BY ticker")
def volatility(spark, sf_dir):
    return M.returns(_series(spark, sf_dir)).groupBy("ticker").agg(r4(F.stddev_samp("change_pct")).alias("volatility"))


@query(f"WITH {_S} SELECT ticker, {_D}, round(close / first_value(close) OVER (PARTITION BY ticker ORDER BY s.date) * 100, 4) AS normalized FROM s")
def normalized_prices(spark, sf_dir):
    return _day(_r(M.normalized(_series(spark, sf_dir)).select("ticker", "date", "normalized"), "normalized"))


@query(f"""WITH {_RET} SELECT a.ticker, b.ticker AS other, round(corr(a.change_pct, b.change_pct), 4) AS corr FROM r a JOIN r b ON a.date = b.date
WHERE a.change_pct IS NOT NULL AND b.change_pct IS NOT NULL GROUP BY 1, 2""")
def correlation(spark, sf_dir):
    return _r(M.correlations(_series(spark, sf_dir)), "corr")


@query(f"""WITH {_RET} SELECT least(floor((change_pct + 100) / 20), 20)::INT AS bin, count(*) AS n FROM r WHERE change_pct IS NOT NULL GROUP BY 1""")
def returns_histogram(spark, sf_dir):
    r = M.returns(_series(spark, sf_dir)).filter("change_pct IS NOT NULL")
    return r.groupBy(F.least(F.floor((F.col("change_pct") + 100) / 20), F.lit(20)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_S}, days AS (SELECT ticker, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM s GROUP BY ticker)
SELECT d.ticker, CAST(d.date AS VARCHAR) AS date, last_value(s.close IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS close
FROM days d LEFT JOIN s ON d.ticker = s.ticker AND d.date = s.date""")
def forward_fill(spark, sf_dir):
    return _day(M.forward_filled(_series(spark, sf_dir)))


@query("""WITH d AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, count(*) AS volume FROM orders GROUP BY 1, 2)
SELECT ticker, CAST(date AS VARCHAR) AS date, round((volume / lag(volume) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100, 4) AS change_pct FROM d""")
def volume_change(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    volume = o.groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("close"))
    return _day(_r(M.returns(volume).select("ticker", "date", "change_pct"), "change_pct"))


_W = "PARTITION BY ticker ORDER BY s.date"


@query(f"""WITH {_S} SELECT ticker, {_D}, {', '.join(f"round(CASE WHEN row_number() OVER ({_W}) >= {n} THEN avg(close) OVER ({_W} ROWS {n - 1} PRECEDING) END, 6) AS sma_{n}" for n in (5, 20, 50))},
round(CASE WHEN row_number() OVER ({_W}) >= 20 THEN avg(close) OVER ({_W} ROWS 19 PRECEDING) + 2 * stddev_samp(close) OVER ({_W} ROWS 19 PRECEDING) END, 3) AS boll_high,
round(CASE WHEN row_number() OVER ({_W}) >= 20 THEN avg(close) OVER ({_W} ROWS 19 PRECEDING) - 2 * stddev_samp(close) OVER ({_W} ROWS 19 PRECEDING) END, 3) AS boll_low,
round(ln(close / lag(close) OVER ({_W})), 4) AS log_return FROM s""")
def ind_sma_boll(spark, sf_dir):
    i = M.indicators(_series(spark, sf_dir)).drop("close", "rsi_14")
    return _day(_r(_r(_r(i, "sma_5", "sma_20", "sma_50", places=6), "boll_high", "boll_low", places=3), "log_return"))


@query(f"""WITH {_S}, c AS (SELECT *, close - lag(close) OVER ({_W}) AS d, row_number() OVER ({_W}) AS n FROM s),
g AS (SELECT ticker, date, n, avg(greatest(d, 0)) OVER w AS up, avg(greatest(-d, 0)) OVER w AS down FROM (SELECT * REPLACE (CASE WHEN d IS NULL THEN NULL ELSE d END AS d) FROM c)
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING))
SELECT ticker, {_D}, round(CASE WHEN n >= 15 THEN CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END END, 4) AS rsi_14 FROM g""")
def ind_rsi(spark, sf_dir):
    return _day(_r(M.indicators(_series(spark, sf_dir)).select("ticker", "date", "rsi_14"), "rsi_14"))


@query(f"""WITH RECURSIVE {_S}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM s),
e AS (
    SELECT ticker, date, n, close AS f, close AS g, CAST(0 AS DOUBLE) AS signal FROM o WHERE n = 1
    UNION ALL
    SELECT o.ticker, o.date, o.n, o.close * (2.0::DOUBLE / 13) + e.f * (1 - 2.0::DOUBLE / 13), o.close * (2.0::DOUBLE / 27) + e.g * (1 - 2.0::DOUBLE / 27),
           ((o.close * (2.0::DOUBLE / 13) + e.f * (1 - 2.0::DOUBLE / 13)) - (o.close * (2.0::DOUBLE / 27) + e.g * (1 - 2.0::DOUBLE / 27))) * 0.2 + e.signal * 0.8
    FROM e JOIN o ON o.ticker = e.ticker AND o.n = e.n + 1
)
SELECT ticker, {_D}, round(f - g, 3) AS macd, round(signal, 3) AS macd_signal FROM e""")
def ind_macd(spark, sf_dir):
    return _day(_r(M.macd(_series(spark, sf_dir)), "macd", "macd_signal", places=3))


@query(f"""WITH {_S} SELECT ticker, part, count(*) AS n FROM (SELECT ticker, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'validation' ELSE 'test' END AS part
FROM (SELECT ticker, percent_rank() OVER ({_W}) AS p FROM s)) GROUP BY 1, 2""")
def walk_forward(spark, sf_dir):
    return M.splits(_series(spark, sf_dir)).groupBy("ticker", "part").agg(F.count(F.lit(1)).alias("n"))


# --- forecasts -----------------------------------------------------------------------------------

HORIZON = 7


@query()
def forecast_arimax(spark, sf_dir):
    """A fitted model of our own: rows only."""
    return _day(_r(M.arimax_forecast(_joined(spark, sf_dir), HORIZON), "pred", "ci_lower", "ci_upper", places=2))


_F = f"""{_S}, c AS (SELECT *, close - lag(close) OVER ({_W}) AS d FROM s),
p AS (SELECT ticker, max(date) AS last_date, arg_max(close, date) AS last, avg(d) AS drift, stddev_samp(d) AS sd FROM c GROUP BY ticker),
f AS (
    SELECT ticker, k, CAST(days[k] AS DATE) AS date, last + drift * k AS pred, 1.96 * sd * sqrt(k) AS band FROM (
        SELECT *, unnest(range(1, {HORIZON + 1})) AS k FROM (
            SELECT *, list_filter(list_transform(range(1, 22), lambda i: last_date + CAST(i AS INTEGER)), lambda x: dayofweek(x) NOT IN (0, 6)) AS days FROM p)))"""


@query(f"WITH {_F} SELECT ticker, {_D}, round(pred, 3) AS pred, round(pred - band, 3) AS ci_lower, round(pred + band, 3) AS ci_upper FROM f")
def forecast_naive(spark, sf_dir):
    return _day(_r(M.naive_forecast(_series(spark, sf_dir), HORIZON), "pred", "ci_lower", "ci_upper", places=3))


@query(f"""WITH {_F} SELECT ticker, CAST(last_date AS VARCHAR) AS last_date, array_to_string(list_transform(days[1:{HORIZON}], lambda x: CAST(CAST(x AS DATE) AS VARCHAR)), ',') AS days
FROM (SELECT ticker, last_date, list_filter(list_transform(range(1, 22), lambda i: last_date + CAST(i AS INTEGER)), lambda x: dayofweek(x) NOT IN (0, 6)) AS days FROM p)""")
def horizon_calendar(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    last = _series(spark, sf_dir).groupBy("ticker").agg(F.max("date").alias("d"))
    days = F.transform(M.business_days(F.col("d"), HORIZON), iso)
    return last.select("ticker", iso(F.col("d")).alias("last_date"), F.array_join(days, ",").alias("days"))


def _wide(spark, sf_dir) -> DataFrame:
    """The horizon's columns are numbered, so that no job is needed to name them."""
    f = M.naive_forecast(_series(spark, sf_dir), HORIZON)
    day = F.row_number().over(M.by_ticker()).cast("string")
    return M.forecast_wide(f.withColumn("date", F.concat(F.lit("day_"), day)), [f"day_{i}" for i in range(1, HORIZON + 1)])


_WIDE = f"""{_F}, wide AS (SELECT ticker, {', '.join(f"round_even(max(pred) FILTER (WHERE k = {i}), 2) AS day_{i}" for i in range(1, HORIZON + 1))},
round_even(max(pred) FILTER (WHERE k = {HORIZON}) - max(pred) FILTER (WHERE k = 1), 2) AS "{HORIZON}_Day_Change",
round_even((max(pred) FILTER (WHERE k = {HORIZON}) - max(pred) FILTER (WHERE k = 1)) / max(pred) FILTER (WHERE k = 1) * 100, 2) AS "{HORIZON}_Day_Change_Pct" FROM f GROUP BY ticker)"""


@query(f"WITH {_WIDE} SELECT * FROM wide")
def forecast_report_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(f"""WITH {_WIDE} SELECT count(*) AS tickers, round_even(avg("{HORIZON}_Day_Change_Pct"), 2) AS mean_change_pct,
(SELECT ticker FROM wide ORDER BY "{HORIZON}_Day_Change_Pct" DESC, ticker LIMIT 1) AS best, (SELECT ticker FROM wide ORDER BY "{HORIZON}_Day_Change_Pct", ticker LIMIT 1) AS worst FROM wide""")
def report_summary(spark, sf_dir):
    return M.report_summary(_wide(spark, sf_dir), f"{HORIZON}_Day_Change_Pct")


# --- accuracy ----------------------------------------------------------------------------------------


def _asked(spark, sf_dir) -> DataFrame:
    """Customers' last order dates, each asked of the series of one priority."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("d"))
    ticker = F.get(F.array(*[F.lit(t) for t in TICKERS]), (F.col("o_custkey") % 5).cast("int"))
    return last.select("o_custkey", F.date_add("d", 3).alias("asked"), ticker.alias("ticker"))


@query(f"""WITH {_S}, asked AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) + 3 AS asked,
    [{', '.join(f"'{t}'" for t in TICKERS)}][CAST(o_custkey % 5 AS INTEGER) + 1] AS ticker FROM orders GROUP BY o_custkey),
ranked AS (SELECT a.*, s.date AS matched, s.close, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(s.date - a.asked), s.date DESC) AS k FROM asked a JOIN s ON a.ticker = s.ticker)
SELECT o_custkey, ticker, CAST(asked AS VARCHAR) AS asked, CAST(matched AS VARCHAR) AS matched_at, close FROM ranked WHERE k = 1""")
def nearest_price_join(spark, sf_dir):
    from ..operators.temporal import nearest_join

    out = nearest_join(_asked(spark, sf_dir), _series(spark, sf_dir), key="ticker", left_ts="asked", right_ts="date", value="close")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("o_custkey", "ticker", iso("asked"), iso("matched_at"), "close")


@query(f"""WITH {_S}, n AS (SELECT ticker, CAST(year(date) AS INTEGER) AS y, close, CAST(row_number() OVER (PARTITION BY ticker, year(date) ORDER BY date) AS INTEGER) AS position FROM s)
SELECT a.y, a.position, a.close AS predicted, b.close AS actual FROM n a JOIN n b ON a.y = b.y AND a.position = b.position WHERE a.ticker = '{TICKERS[0]}' AND b.ticker = '{TICKERS[1]}'""")
def positional_join(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("y", F.year("date"))
    side = lambda ticker, name: s.filter(F.col("ticker") == ticker).select("y", "date", F.col("close").alias(name))
    return M.positional_join(side(TICKERS[0], "predicted"), side(TICKERS[1], "actual"), "y", "date")


@query("""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) o
ON c_custkey = o_custkey WHERE k = 1""")
def first_match_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return M.first_match(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def _compared(spark, sf_dir) -> DataFrame:
    """Customers as tickers: the mean of all orders but the last predicts the last."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("d"))
    order = Window.partitionBy("o_custkey").orderBy("d", "o_orderkey")
    rows = o.select("o_custkey", F.lag("p", 2).over(order).alias("pred_start"), F.lag("p", 1).over(order).alias("pred_end"), F.lag("p", 1).over(order).alias("actual_start"), F.col("p").alias("actual_end"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("d"), F.desc("o_orderkey"))).alias("k"))
    return M.compare(rows.filter("k = 1 AND pred_start IS NOT NULL").drop("k").withColumnRenamed("o_custkey", "ticker"))


_C = """ranked AS (
    SELECT o_custkey AS ticker, lag(o_totalprice, 2) OVER w AS pred_start, lag(o_totalprice, 1) OVER w AS pred_end, lag(o_totalprice, 1) OVER w AS actual_start, o_totalprice AS actual_end,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), c AS (
    SELECT ticker, (pred_end - pred_start) / pred_start * 100 AS pred_pct, (actual_end - actual_start) / actual_start * 100 AS actual_pct,
           (actual_start - pred_start) / pred_start * 100 AS start_error_pct, (actual_end - pred_end) / pred_end * 100 AS end_error_pct FROM ranked WHERE k = 1 AND pred_start IS NOT NULL
), e AS (SELECT *, actual_pct - pred_pct AS change_error, (pred_pct >= 0) = (actual_pct >= 0) AS direction_correct FROM c)"""


@query(f"""WITH {_C} SELECT round(avg(abs(change_error)), 4) AS mae, round(sqrt(avg(change_error * change_error)), 4) AS rmse, round(100 * avg(direction_correct::INT), 4) AS direction_pct,
round(avg(abs(start_error_pct)), 4) AS start_error, round(avg(abs(end_error_pct)), 4) AS end_error, round(avg(abs(end_error_pct)), 4) AS mape,
round(1 - sum(change_error * change_error) / (var_pop(actual_pct) * count(actual_pct)), 4) AS r2 FROM e""")
def prediction_accuracy(spark, sf_dir):
    return _r(M.accuracy(_compared(spark, sf_dir)), "mae", "rmse", "direction_pct", "start_error", "end_error", "mape", "r2")


@query(f"""WITH {_C} (SELECT 'best' AS side, ticker, round(abs(change_error), 4) AS error FROM e ORDER BY abs(change_error), ticker LIMIT 10)
UNION ALL (SELECT 'worst', ticker, round(abs(change_error), 4) FROM e ORDER BY abs(change_error) DESC, ticker LIMIT 10)""")
def best_worst_10(spark, sf_dir):
    e = _compared(spark, sf_dir).select("ticker", F.abs("change_error").alias("error"))
    side = lambda name, *order: e.orderBy(*order).limit(10).select(F.lit(name).alias("side"), "ticker", r4("error").alias("error"))
    return side("best", "error", "ticker").unionByName(side("worst", F.desc("error"), "ticker"))


@query(f"""WITH {_C} SELECT CASE WHEN abs(end_error_pct) < 2 THEN 'good' WHEN abs(end_error_pct) < 5 THEN 'fair' ELSE 'poor' END AS chart,
CASE WHEN abs(end_error_pct) < 1 THEN 'good' WHEN abs(end_error_pct) < 3 THEN 'fair' ELSE 'poor' END AS page,
CASE WHEN actual_pct >= 0 THEN 'Up' ELSE 'Down' END AS direction, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def error_buckets(spark, sf_dir):
    e = _compared(spark, sf_dir)
    error = F.col("end_error_pct")
    return e.groupBy(error_bucket(error, 2, 5).alias("chart"), error_bucket(error, 1, 3).alias("page"), direction(F.col("actual_pct")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_C} SELECT direction_correct, count(*) AS n FROM e GROUP BY 1")
def direction_counts(spark, sf_dir):
    return _compared(spark, sf_dir).groupBy("direction_correct").agg(F.count(F.lit(1)).alias("n"))


# --- documents ------------------------------------------------------------------------------------------


@query("""SELECT n_name AS page, CAST(n_nationkey AS VARCHAR) AS "Key", r_name AS "Region" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def wiki_ask(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    properties = F.map_from_arrays(F.array(F.lit("Category"), F.lit("Key"), F.lit("Region")), F.array(F.lit("Nation"), F.col("n_nationkey").cast("string"), F.col("r_name")))
    triples = rows.select(F.col("n_name").alias("page"), F.explode(properties).alias("property", "value"))
    return A.ask(triples, category="Nation", where={"Region": "ASIA"}, printouts=["Key", "Region"], sort="Key")


@query("""SELECT lang AS category, 'Doc ' || doc_id AS title, 'https://example.org/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'About ' || source END AS summary, lang || ', ' || source AS tags
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def news_parse(spark, sf_dir):
    """Editions written from the documents, one for each source, and parsed again."""
    d = table(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    summary = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Summary: About "), "source", F.lit("\n"))).otherwise("")
    entry = F.concat(F.lit("## "), "lang", F.lit("\n### Doc "), "doc_id", F.lit("\nURL: https://example.org/"), "doc_id", F.lit("\n"), summary, F.lit("Tags: "), "lang", F.lit(", "), "source", F.lit("\n\n"))
    editions = d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("markdown"))
    return P.parse_news(editions, "markdown").select("category", "title", "url", "summary", "tags")


@query("""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS links FROM pages""")
def html_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.html_title(F.col("html")).alias("title"), F.size(P.html_links(F.col("html"))).cast("long").alias("links"))


@query("""WITH s AS (SELECT o_orderpriority AS ticker, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
SELECT ticker, CAST(y AS VARCHAR) || '-01-01' AS date, v AS value FROM s WHERE y IS NOT NULL""")
def date_columns_to_long(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.date_format(F.date_trunc("year", "o_orderdate"), "yyyy-MM-dd"))
    o = o.filter("y IS NOT NULL")  # one column a year: Spark looks up which there are
    wide = o.groupBy(F.col("o_orderpriority").alias("ticker")).pivot("y").agg(F.round(F.sum("o_totalprice"), 2))
    return P.unpivot_dates(wide, "ticker")
