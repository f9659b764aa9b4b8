"""Cutting the lineage of iterative plans in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where every executor can read it.

    ``spark.checkpoint.dir`` is what the cluster names; a folder of our own is
    made only where it is unset and Spark runs in one process (tests).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skarn-checkpoint-"))
    return df.checkpoint(eager=True)
