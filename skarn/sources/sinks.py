"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A report, small by nature, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_lines(summary: DataFrame, wide: DataFrame) -> DataFrame:
    """The text report: one line of figures, then the tickers in order."""
    head = summary.select(F.lit(0).alias("k"), F.concat_ws(" ", F.lit("tickers:"), "tickers", F.lit("mean change %:"), F.col("mean_change_pct").cast("string"), F.lit("best:"), "best", F.lit("worst:"), "worst").alias("line"))
    tickers = wide.select("ticker").agg(F.lit(1).alias("k"), F.array_join(F.array_sort(F.collect_list("ticker")), ", ").alias("line"))
    return head.unionByName(tickers).orderBy("k").select("line")


def write_text(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)


def split_late(df: DataFrame, on_time_path: str, late_path: str) -> None:
    """A batch with a flag ``late``, written to two sinks."""
    for late, path in ((False, on_time_path), (True, late_path)):
        df.filter(F.col("late") == late).drop("late").write.mode("append").parquet(path)


def console_table(df: DataFrame, rows: int = 20, width: int = 20) -> str:
    """The first rows as a table of text, for a terminal."""
    return df._show_string(rows, width)


def html_rows(df: DataFrame, columns: list[str], css_class: str) -> DataFrame:
    """One ``<tr>`` a row, of the class that a column names; cells are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns]
    return df.select("*", F.concat(F.lit('<tr class="'), F.col(css_class), F.lit('">'), *cells, F.lit("</tr>")).alias("html"))


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of a report, such as 25 sessions or 20 alerts."""
    return df.orderBy(*order).limit(n)
