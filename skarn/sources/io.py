"""Scans: files, fallback chains, a TTL cache, and a partitioned price source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NEWS_SCHEMA = "publishedAt date, title string, description string, content string, url string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; give a schema for large files, or it takes a second scan."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """News JSON with text: the content, else the description, else the title."""
    rows = spark.read.schema(NEWS_SCHEMA).json(path)
    return rows.withColumn("text", F.coalesce("content", "description", "title"))


def first_source(spark: SparkSession, sources: list[Callable[[], DataFrame]], fallback: list[tuple], schema: str) -> DataFrame:
    """The first source that has rows; a failing one passes to the next, at last the fallback."""
    for source in sources:
        try:
            df = source()
            if df is not None and not df.isEmpty():
                return df
        except Exception:  # noqa: S112  a source that fails is one that has nothing
            continue
    return spark.createDataFrame(fallback, schema)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], ttl_hours: float = 24) -> DataFrame:
    """The Parquet at ``path`` if it is younger than the TTL, else made and written anew.

    Ages are read through Spark's file metadata, so any store will do.
    """
    try:
        held = spark.read.parquet(path)
        age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.col("_metadata.file_modification_time"))
        oldest = held.select(age.alias("age")).agg(F.max("age")).first()[0]
        if oldest is not None and oldest < ttl_hours * 3600:
            return held
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _Ticker(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PriceReader(DataSourceReader):
    """One partition a ticker; prices are a deterministic walk, as there is no network."""

    def __init__(self, options: dict):
        self.tickers = [t for t in options.get("tickers", "").split(",") if t]
        self.start, self.days = options.get("start", "2024-01-01"), int(options.get("days", "60"))

    def partitions(self):
        return [_Ticker(t) for t in self.tickers]

    def read(self, partition) -> Iterator[tuple]:
        import datetime
        import hashlib

        day, close = datetime.date.fromisoformat(self.start), 100.0
        for _ in range(self.days):
            if day.weekday() < 5:
                draw = int(hashlib.sha256(f"{partition.name}{day}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
                before, close = close, close * (1 + (draw - 0.5) * 0.04)
                yield partition.name, day, before, max(before, close), min(before, close), close, close, int(draw * 1_000_000)
            day += datetime.timedelta(days=1)


class PriceSource(DataSource):
    """``spark.read.format("skarn_prices").option("tickers", "A,B")``."""

    @classmethod
    def name(cls) -> str:
        return "skarn_prices"

    def schema(self) -> str:
        return "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint"

    def reader(self, schema) -> PriceReader:
        return PriceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PriceSource)


PRICE_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "adj_close", "volume"]


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are."""
    return df.select(*[c for c in columns if c in df.columns])
