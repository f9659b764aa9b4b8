"""Daily series and forecasts: normalising, filtering, joining, pivoting, measuring."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- constituents -------------------------------------------------------------------

REQUIRED = ["Symbol", "Security", "Sector", "Industry"]


def normalize_constituents(df: DataFrame) -> DataFrame:
    """Any table of listed companies as Symbol, Security, Sector, Industry.

    Columns are recognised by their names, each target once, the first that fits;
    a missing industry is the sector; a table without one of the others is an
    error, so that ``first_source`` goes on.  Symbols have ``-`` for ``.``; rows
    without a symbol are dropped.
    """
    clean = df.toDF(*[re.sub("[‐-―]", "-", c).strip() for c in df.columns])
    target: dict[str, str] = {}
    for c in clean.columns:
        low = c.lower()
        if "symbol" in low or "ticker" in low:
            target.setdefault("Symbol", c)
        elif ("security" in low or "company" in low or "name" in low) and "sub" not in low:
            target.setdefault("Security", c)
        elif "sector" in low and "sub" not in low:
            target.setdefault("Sector", c)
        elif "industry" in low:
            target.setdefault("Industry", c)
    if missing := [c for c in REQUIRED[:3] if c not in target]:
        raise ValueError(f"no column of {', '.join(missing)}")
    col = {name: F.col(f"`{c}`").cast("string") for name, c in target.items()}
    out = clean.select(
        F.regexp_replace(col["Symbol"], r"\.", "-").alias("Symbol"),
        col["Security"].alias("Security"),
        col["Sector"].alias("Sector"),
        col.get("Industry", col["Sector"]).alias("Industry"),
    )
    return out.na.drop(subset=["Symbol"])


def filter_by_industry(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose sector or industry matches; only if none does, those whose name does."""
    wanted = pattern.strip().lower()
    if not wanted:
        raise ValueError("an industry is needed")
    hit = lambda c: F.coalesce(F.lower(c).rlike(wanted), F.lit(False))
    first, second = hit(F.col("Sector")) | hit(F.col("Industry")), hit(F.col("Security"))
    tiered = df.withColumn("__tier", F.when(first, 2).when(second, 1)).filter(F.col("__tier").isNotNull())
    best = tiered.agg(F.max("__tier").alias("__best"))  # one row
    return tiered.join(F.broadcast(best), F.col("__tier") == F.col("__best")).drop("__tier", "__best")


# --- sentiment ------------------------------------------------------------------------

#: A small lexicon of financial news, by valence; a parameter.
_VALENCES = {
    1.9: "good gain gains growth strong up beat beats rise rises rising profit profits positive improve improves improved benefit win wins confident higher upgrade upgraded",
    3.1: "great excellent best outstanding surge surges surged soar soars soared rally breakthrough boom bullish triumph",
    -1.9: "bad loss losses down weak weaker drop drops dropped miss misses missed fall falls fell decline declines lower negative concern concerns risk risks downgrade downgraded",
    -3.1: "terrible worst crash crashes crashed plunge plunges plunged collapse collapsed fear fears fraud bankrupt bankruptcy scandal bearish crisis",
}
LEXICON = {w: v for v, words in _VALENCES.items() for w in words.split()}
#: Words that turn what follows within three words, and by how much.
NEGATIONS = "not no never none nor neither without cannot can't don't doesn't didn't isn't aren't wasn't weren't won't wouldn't couldn't shouldn't".split()
NEGATED = -0.74
#: Words that make the next one stronger or weaker.
BOOSTERS = {
    **dict.fromkeys("very extremely highly sharply strongly hugely really significantly".split(), 0.293),
    **dict.fromkeys("slightly somewhat barely marginally partly".split(), -0.293),
}


def lexicon_score(text: Column, lexicon: dict[str, float] | None = None, negations: list[str] | None = None, boosters: dict[str, float] | None = None) -> Column:
    """s / sqrt(s^2 + 15) of the sum of the words' valences, in -1 to 1.

    The word before may boost a valence, a negation among the three words before
    turns it.  Words are runs of a-z and '; null texts have no score.
    """
    lexicon, boosters = LEXICON if lexicon is None else lexicon, BOOSTERS if boosters is None else boosters
    negations = NEGATIONS if negations is None else negations
    valences, boosts = (F.create_map(*[F.lit(x) for w, v in m.items() for x in (w, float(v))]) for m in (lexicon, boosters))

    def value(words: Column, w: Column, i: Column) -> Column:
        v = F.try_element_at(valences, w)
        boost = F.coalesce(F.try_element_at(boosts, F.get(words, i - 1)), F.lit(0.0))
        negated = F.coalesce(F.exists(F.array(*[F.get(words, i - n) for n in (1, 2, 3)]), lambda x: x.isin(list(negations))), F.lit(False))
        return F.when(w.isin(list(lexicon)), (v + F.signum(v) * boost) * F.when(negated, NEGATED).otherwise(1.0)).otherwise(0.0)

    # The words are bound once, in an array of one, for the neighbours are asked for.
    one = F.array(F.split(F.lower(text), "[^a-z']+"))
    s = F.get(F.transform(one, lambda words: F.aggregate(F.transform(words, lambda w, i: value(words, w, i)), F.lit(0.0), lambda x, y: x + y)), F.lit(0))
    return F.get(F.transform(F.array(s), lambda x: x / F.sqrt(x * x + 15.0)), F.lit(0))


def daily_sentiment(scored: DataFrame, date: str, score: str) -> DataFrame:
    c = F.col(score)
    return scored.groupBy(F.col(date).alias("date")).agg(
        F.count_if(c >= 0.05).alias("pos"),
        F.count_if(c <= -0.05).alias("neg"),
        F.count_if((c < 0.05) & (c > -0.05)).alias("neu"),
        F.count(F.lit(1)).alias("total"),
        F.avg(c).alias("sentiment_score"),
    )


SENTIMENT = ["pos", "neg", "neu", "total", "sentiment_score"]


def with_sentiment(prices: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Every price row, with its day's sentiment or zeros."""
    for df in (prices, sentiment):
        if "date" not in df.columns:
            raise KeyError("date")
    clash = {c: f"{c}_sent" for c in SENTIMENT if c in prices.columns}
    right = sentiment.withColumnsRenamed(clash)
    return prices.join(right, "date", "left").fillna(0, subset=[clash.get(c, c) for c in SENTIMENT])


# --- series -----------------------------------------------------------------------------


def closes_wide(long: DataFrame, tickers: list[str]) -> DataFrame:
    """One column per ticker; every date that any of them has."""
    return long.groupBy("date").pivot("ticker", tickers).agg(F.first("close"))


def by_ticker(order: str = "date") -> Window:
    return Window.partitionBy("ticker").orderBy(order)


def returns(long: DataFrame) -> DataFrame:
    """change_pct against the previous known close of the ticker."""
    known = F.last("close", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    filled = long.withColumn("__c", known)
    return filled.withColumn("change_pct", (F.col("__c") / F.lag("__c").over(by_ticker()) - 1) * 100).drop("__c")


def normalized(long: DataFrame) -> DataFrame:
    return long.withColumn("normalized", F.col("close") / F.first("close", ignorenulls=True).over(by_ticker()) * 100)


def total_return(long: DataFrame) -> DataFrame:
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    return long.filter(F.col("close").isNotNull()).groupBy("ticker").agg(((last - first) / first * 100).alias("total_return_pct"))


def describe(long: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    quartile = lambda q, name: F.percentile(v, q).alias(name)
    return long.groupBy("ticker").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), quartile(0.25, "q1"), quartile(0.5, "median"), quartile(0.75, "q3"), F.max(v).alias("high")
    )


def correlations(long: DataFrame) -> DataFrame:
    """Pearson correlation of the returns of every pair of tickers, pairwise complete."""
    r = returns(long).select("date", "ticker", "change_pct").filter(F.col("change_pct").isNotNull())
    other = r.select("date", F.col("ticker").alias("other"), F.col("change_pct").alias("other_pct"))
    return r.join(other, "date").groupBy("ticker", "other").agg(F.corr("change_pct", "other_pct").alias("corr"))


def forward_filled(long: DataFrame) -> DataFrame:
    """A row for every day between a ticker's first and last, with the last known close."""
    span = long.groupBy("ticker").agg(F.min("date").alias("__from"), F.max("date").alias("__to"))
    days = span.select("ticker", F.explode(F.sequence("__from", "__to")).alias("date"))
    known = F.last("close", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return days.join(long.select("ticker", "date", "close"), ["ticker", "date"], "left").withColumn("close", known)


def positional_join(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """The n-th row of the one with the n-th of the other, within each ``by``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    other = right.withColumn("position", n).drop(order)
    return left.withColumn("position", n).drop(order).join(other, [by, "position"])


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left rows with the first right row of their key; rows without one are skipped."""
    rest = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return left.join(first, key).select(*left.columns, "__r.*")


# --- indicators ---------------------------------------------------------------------------


def indicators(long: DataFrame) -> DataFrame:
    """SMA 5/20/50, Bollinger(20, 2), log return and RSI 14 of each ticker."""
    last = lambda n: by_ticker().rowsBetween(-(n - 1), 0)
    c = F.col("close")
    change = c - F.lag("close").over(by_ticker())
    out = long.withColumn("__n", F.row_number().over(by_ticker())).withColumn("__up", F.greatest(change, F.lit(0.0))).withColumn("__down", F.greatest(-change, F.lit(0.0)))
    full = lambda n, x: F.when(F.col("__n") >= n, x)
    gain, loss = F.avg("__up").over(last(14)), F.avg("__down").over(last(14))
    return out.select(
        "ticker", "date", "close",
        *[full(n, F.avg("close").over(last(n))).alias(f"sma_{n}") for n in (5, 20, 50)],
        full(20, F.avg("close").over(last(20)) + 2 * F.stddev_samp("close").over(last(20))).alias("boll_high"),
        full(20, F.avg("close").over(last(20)) - 2 * F.stddev_samp("close").over(last(20))).alias("boll_low"),
        F.ln(c / F.lag("close").over(by_ticker())).alias("log_return"),
        full(15, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))).alias("rsi_14"),
    )


def ema(values: Column, span: int) -> Column:
    """The exponential averages of an ordered array, first value as start."""
    a = 2.0 / (span + 1)
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    step = lambda acc, v: F.concat(acc, F.array(v * a + F.element_at(acc, -1) * (1 - a)))
    return F.aggregate(rest, F.slice(values, 1, 1), step)


def macd(long: DataFrame) -> DataFrame:
    """MACD(12, 26) and its signal(9); a ticker's daily closes are one short array."""
    series = long.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("s"))
    closes = F.transform("s", lambda e: e["close"])
    lines = series.withColumn("m", F.zip_with(ema(closes, 12), ema(closes, 26), lambda x, y: x - y)).withColumn("signal", ema(F.col("m"), 9))
    rows = lines.select("ticker", F.explode(F.arrays_zip("s", "m", "signal")).alias("r"))
    return rows.select("ticker", F.col("r.s.date").alias("date"), F.col("r.m").alias("macd"), F.col("r.signal").alias("macd_signal"))


def smoothed(daily: DataFrame, value: str, span: int) -> DataFrame:
    """(date, value, smoothed) of one series with a row a day, which is one short array."""
    one = daily.agg(F.array_sort(F.collect_list(F.struct("date", value))).alias("s"))
    lines = one.withColumn("m", ema(F.transform("s", lambda e: e[value]), span))
    rows = lines.select(F.explode(F.arrays_zip("s", "m")).alias("r"))
    return rows.select(F.col("r.s.date").alias("date"), F.col(f"r.s.{value}").alias(value), F.col("r.m").alias("smoothed"))


def splits(long: DataFrame) -> DataFrame:
    """train, validation, test: the first 80, next 10 and last 10 percent of each ticker."""
    share = F.percent_rank().over(by_ticker())
    return long.withColumn("part", F.when(share < 0.8, "train").when(share < 0.9, "validation").otherwise("test"))


# --- forecasts -------------------------------------------------------------------------------


def business_days(start: Column, n: int) -> Column:
    """The first n days after ``start`` that are no weekend."""
    days = F.sequence(F.date_add(start, 1), F.date_add(start, 2 * n + 7))
    return F.slice(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)), 1, n)


def naive_forecast(long: DataFrame, horizon: int) -> DataFrame:
    """The last close plus the mean daily change, by business day; a 95 % band of the changes."""
    change = F.col("close") - F.lag("close").over(by_ticker())
    drift = long.withColumn("d", change).groupBy("ticker").agg(
        F.max("date").alias("last_date"), F.max_by("close", "date").alias("last"), F.avg("d").alias("drift"), F.stddev_samp("d").alias("sd")
    )
    days = drift.select("*", F.posexplode(business_days(F.col("last_date"), horizon)).alias("i", "date"))
    step = F.col("i") + 1
    price = F.col("last") + F.col("drift") * step
    band = 1.96 * F.col("sd") * F.sqrt(step)
    return days.select("ticker", "date", price.alias("pred"), (price - band).alias("ci_lower"), (price + band).alias("ci_upper"))


def arimax_forecast(long: DataFrame, horizon: int, min_history: int = 30) -> DataFrame:
    """ARIMA(1,1,1) with the sentiment as regressor, fitted for each ticker.

    Conditional least squares over a grid of (phi, theta) that is refined twice;
    intervals from the psi weights.  Too short a series gives one row with the
    reason, never a failure of the job.
    """
    import pandas as pd

    schema = "ticker string, date date, pred double, ci_lower double, ci_upper double, success boolean, error string"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ticker = pdf["ticker"].iloc[0]
        pdf = pdf.sort_values("date").dropna(subset=["close"])

        def failed(why: str) -> pd.DataFrame:
            return pd.DataFrame([{"ticker": ticker, "date": None, "pred": None, "ci_lower": None, "ci_upper": None, "success": False, "error": why}])

        if len(pdf) < min_history:
            return failed(f"{len(pdf)} rows, {min_history} needed")
        try:
            y = pdf["close"].to_numpy(float)
            x = pdf["sentiment_score"].fillna(0).to_numpy(float) if "sentiment_score" in pdf else np.zeros(len(y))
            dy, dx = np.diff(y), np.diff(x)
            beta = float(dx @ dy / (dx @ dx)) if dx @ dx > 0 else 0.0
            u = dy - beta * dx

            def residuals(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
                """A row a day, a column a candidate."""
                e = np.zeros((len(u), len(phi)))
                for t in range(1, len(u)):
                    e[t] = u[t] - phi * u[t - 1] - theta * e[t - 1]
                return e

            best, width = np.zeros(2), 0.9
            for _ in range(3):
                grid = np.stack(np.meshgrid(*[np.linspace(-1, 1, 7)] * 2, indexing="ij"), -1).reshape(-1, 2) * width + best
                grid = grid[np.abs(grid).max(axis=1) < 0.99]
                best = grid[(residuals(*grid.T) ** 2).sum(axis=0).argmin()]
                width /= 4
            phi, theta = map(float, best)
            e = residuals(best[:1], best[1:])[:, 0]
            sigma = float(np.sqrt(np.mean(e[1:] ** 2)))
            future = float(np.mean(x[-5:]))
            days = pd.bdate_range(pd.Timestamp(pdf["date"].iloc[-1]) + pd.Timedelta(days=1), periods=horizon)
            level, step, psi, var, out = y[-1], u[-1], 1.0, 0.0, []
            cumulative = 0.0
            for h, day in enumerate(days):
                step = phi * step + (theta * e[-1] if h == 0 else 0.0)
                level += step + (beta * (future - x[-1]) if h == 0 else 0.0)
                psi = 1.0 if h == 0 else (phi + theta) if h == 1 else psi * phi
                cumulative += psi
                var += cumulative**2
                band = 1.96 * sigma * np.sqrt(var)
                out.append({"ticker": ticker, "date": day.date(), "pred": level, "ci_lower": level - band, "ci_upper": level + band, "success": True, "error": None})
            return pd.DataFrame(out)
        except Exception as problem:
            return failed(str(problem))

    return long.groupBy("ticker").applyInPandas(fit, schema)


def forecast_wide(forecast: DataFrame, dates: list) -> DataFrame:
    """One row a ticker, a column a date, and N_Day_Change with its percentage."""
    wide = forecast.groupBy("ticker").pivot("date", dates).agg(F.first("pred"))
    names = [str(d) for d in dates]
    wide = wide.toDF("ticker", *names)
    first, last, n = F.col(f"`{names[0]}`"), F.col(f"`{names[-1]}`"), len(names)
    change, pct = (last - first, F.try_divide(last - first, first) * 100) if n > 1 else (F.lit(0.0), F.lit(0.0))
    half_even = [F.bround(F.col(f"`{c}`"), 2).alias(c) for c in names]
    return wide.select("ticker", *half_even, F.bround(change, 2).alias(f"{n}_Day_Change"), F.bround(pct, 2).alias(f"{n}_Day_Change_Pct"))


def report_summary(wide: DataFrame, pct: str) -> DataFrame:
    """Tickers, mean change, best and worst ticker (ties: the first by name)."""
    return wide.agg(
        F.count(F.lit(1)).alias("tickers"),
        F.bround(F.avg(pct), 2).alias("mean_change_pct"),
        F.min_by("ticker", F.struct(-F.col(pct), F.col("ticker"))).alias("best"),
        F.min_by("ticker", F.struct(F.col(pct), F.col("ticker"))).alias("worst"),
    )


# --- accuracy ------------------------------------------------------------------------------------


def compare(pred: DataFrame) -> DataFrame:
    """ticker, start and end prices predicted and actual, to errors and directions."""
    d = lambda c: F.when(c >= 0, "Up").otherwise("Down")
    predicted, actual = F.col("pred_end") - F.col("pred_start"), F.col("actual_end") - F.col("actual_start")
    pct = lambda c, base: F.try_divide(c, F.col(base)) * 100
    out = pred.withColumn("pred_pct", pct(predicted, "pred_start")).withColumn("actual_pct", pct(actual, "actual_start"))
    out = out.withColumn("start_error_pct", pct(F.col("actual_start") - F.col("pred_start"), "pred_start")).withColumn("end_error_pct", pct(F.col("actual_end") - F.col("pred_end"), "pred_end"))
    out = out.withColumn("change_error", F.col("actual_pct") - F.col("pred_pct"))
    return out.withColumn("direction_correct", d(F.col("pred_pct")) == d(F.col("actual_pct")))


def accuracy(compared: DataFrame) -> DataFrame:
    e = F.col("change_error")
    ss_tot = F.var_pop("actual_pct") * F.count("actual_pct")
    return compared.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.col("direction_correct").cast("int"))).alias("direction_pct"),
        F.avg(F.abs("start_error_pct")).alias("start_error"),
        F.avg(F.abs("end_error_pct")).alias("end_error"),
        F.avg(F.abs("end_error_pct")).alias("mape"),
        (1 - F.try_divide(F.sum(e * e), ss_tot)).alias("r2"),
    )
