"""The stock analysis pipeline: constituents to report, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market as M
from ..sources import io


@dataclass(frozen=True)
class Config:
    forecast_days: int = 7
    min_history: int = 30
    max_tickers: int = 20
    cache_hours: float = 24
    lexicon: dict[str, float] = field(default_factory=lambda: dict(M.LEXICON))


class Pipeline:
    """Stages with one method each; ``run`` puts them together."""

    def __init__(self, spark: SparkSession, constituents: DataFrame, prices: DataFrame, news: DataFrame | None = None, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.constituents, self.prices, self.news = M.normalize_constituents(constituents), prices, news

    def tickers(self, industry: str) -> DataFrame:
        found = M.filter_by_industry(self.constituents, industry)
        return found.select(F.col("Symbol").alias("ticker")).orderBy("ticker").limit(self.config.max_tickers)

    def sentiment(self) -> DataFrame:
        if self.news is None:
            return self.spark.createDataFrame([], "date date, pos long, neg long, neu long, total long, sentiment_score double")
        score = M.lexicon_score(F.col("text"), self.config.lexicon)
        return M.daily_sentiment(self.news.withColumn("score", score), "publishedAt", "score")

    def run(self, industry: str, lookback_months: int = 6) -> dict[str, Any]:
        chosen = self.tickers(industry)
        last = self.prices.agg(F.max("date").alias("last"))
        recent = self.prices.join(F.broadcast(last), F.col("date") >= F.add_months("last", -lookback_months)).drop("last")
        history = recent.join(F.broadcast(chosen), "ticker")  # at most max_tickers rows
        joined = M.with_sentiment(io.existing(history, io.PRICE_COLUMNS), self.sentiment())
        forecast = M.arimax_forecast(joined, self.config.forecast_days, self.config.min_history)
        good = forecast.filter("success")
        dates = [r[0] for r in good.select("date").distinct().orderBy("date").limit(2 * self.config.forecast_days + 7).collect()]
        out: dict[str, Any] = {"industry": industry, "tickers": chosen, "forecast": forecast, "failed": forecast.filter(~F.col("success")), "wide": None, "summary": None}
        if dates:
            wide = M.forecast_wide(good, dates)
            out |= {"wide": wide, "summary": M.report_summary(wide, f"{len(dates)}_Day_Change_Pct")}
        return out
