"""SQL databases by DB-API: reads in parts, writes that can be repeated, DDL, and views of the session.

``connect`` is a function without arguments that opens a connection; tasks call it
on their own, so it must be picklable and reach the same database from anywhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 5000
RETRIES, DELAY_S = 20, 3.0
#: What an insert does with a row whose key is there.
CONFLICT = {"error": "INSERT", "ignore": "INSERT OR IGNORE", "replace": "INSERT OR REPLACE"}


def connected(connect: Callable, retries: int = RETRIES, delay_s: float = DELAY_S):
    """A connection, after up to ``retries`` attempts; the last failure is raised."""
    for left in range(retries - 1, -1, -1):
        try:
            return connect()
        except Exception:
            if not left:
                raise
            time.sleep(delay_s)
    raise ValueError("retries must be 1 or more")


def execute_ddl(connect: Callable, statements: list[str], **retry) -> None:
    """CREATE, DROP and other statements, in order, in one transaction."""
    link = connected(connect, **retry)
    try:
        for statement in statements:
            link.cursor().execute(statement)
        link.commit()
    finally:
        link.close()


def read_sql(spark: SparkSession, connect: Callable, query: str, schema: str, parts: list[str] | None = None, **retry) -> DataFrame:
    """The rows of a query; ``parts`` are conditions that divide them, one task each."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    asked = [f"SELECT * FROM ({query}) t WHERE {p}" for p in parts] if parts else [query]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in (t for b in batches for t in b.column(0).to_pylist()):
            link = connected(connect, **retry)
            try:
                cursor = link.cursor()
                cursor.execute(text)
                while rows := cursor.fetchmany(BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            finally:
                link.close()

    return spark.createDataFrame([(t,) for t in asked], "q string").repartition(len(asked)).mapInArrow(read, fields)


def write_sql(df: DataFrame, connect: Callable, table: str, *, on_conflict: str = "ignore", mark: str = "?", **retry) -> int:
    """Rows sent.  A task that runs again repeats its rows: with ``ignore`` and ``replace`` the table is the same."""
    names = df.columns
    insert = f"{CONFLICT[on_conflict]} INTO {table} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))})"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, link = 0, connected(connect, **retry)
        try:
            for batch in batches:
                link.cursor().executemany(insert, list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
                sent += batch.num_rows
            link.commit()
        finally:
            link.close()
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], ["n"])

    return sum(r[0] for r in df.mapInArrow(write, "n long").collect())  # a row a task


def create_views(spark: SparkSession, views: dict[str, str]) -> None:
    """Views of the session, in order, each by its SQL."""
    for name, query in views.items():
        spark.sql(query).createOrReplaceTempView(name)


def drop_views(spark: SparkSession, names: list[str]) -> list[str]:
    """Those of the views that there were."""
    return [n for n in names if spark.catalog.dropTempView(n)]
