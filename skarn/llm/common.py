"""Helpers that the corpus operators share.

Nothing outside this subpackage imports it.  Internal columns carry the prefix
``__sk_`` so that they cannot clash with columns of the caller's tables.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PREFIX = "__sk_"


def own(name: str) -> str:
    return PREFIX + name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    One of our own is made only where it is unset and Spark runs in one process
    (tests); on a cluster a folder of this machine would be lost to the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="skarn-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is what the cluster names.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the executors drop the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which an iterative
    plan, whose rounds leave little garbage in the driver, may not see for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts: a task holds one batch and a part of it in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_batches(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], dict[str, list | pa.Array]],
    added: list[T.StructField],
    drop: tuple[str, ...] = (),
    at_end: Callable[[], None] | None = None,
) -> DataFrame:
    """``df`` with columns that ``compute`` makes for each Arrow batch.

    Columns named as an added one, and those in ``drop``, are replaced.
    ``at_end`` is called after a task's last batch, as workers outlive tasks.
    """
    gone = {f.name for f in added} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in gone]
    names = [f.name for f in kept]
    arrow = {f.name: to_arrow_type(f.dataType) for f in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = compute(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for name, kind in arrow.items():
                value = made[name]
                columns.append(value if isinstance(value, pa.Array) else pa.array(value, kind))
            yield pa.RecordBatch.from_arrays(columns, [*names, *arrow])
        if at_end is not None:
            at_end()

    return df.mapInArrow(run, T.StructType([*kept, *added]))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that stand for the values of ``columns``, nulls included."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (11, 23)]
