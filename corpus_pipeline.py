"""A training corpus from raw documents: five stages over the corpus operators.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import shared_folder, table
from skarn.llm.decontaminate import remove_contaminated
from skarn.llm.linededup import drop_frequent_lines
from skarn.llm.neardup import remove_near_duplicates
from skarn.llm.packing import pack, token_pieces
from skarn.llm.toxicity import remove_toxic, train

#: The near-dedup stage links documents of Jaccard 0.80 or more on word shingles.
#: (op3's contract, 85, binds its own query only.)  With 39 bands of 5 rows a pair
#: of similarity 0.80 shares no band with probability 2e-7.
NEAR_PERCENT, NEAR_BANDS = 80, 39


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts stay, and repeated rows stay or go alike.

    An empty table stays empty; columns named score or predicted are kept.
    """
    return remove_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; n_chars follows a text that changed.

    All documents stay, null texts null and repeated rows repeated (rows of one id
    count as one document); an empty table stays empty; columns named n_lines or
    n_dropped are kept.
    """
    return drop_frequent_lines(docs, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of Jaccard 0.80 or more, stays.

    Null texts, texts without a word and rows without an id stay; of repeated rows
    one stays, of rows of one id with other texts each that is no copy; an empty
    table stays empty; extra columns are kept.
    """
    return remove_near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; null and empty texts stay, repeated rows stay or go alike.

    An empty table or benchmark removes nothing; extra columns are kept.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 ids; one row a piece.

    A null or empty text is the end id alone; repeated rows are packed each; an
    empty table gives no rows.
    """
    return pack(token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier, the first stage, cannot be expressed in SQL;
#: tests/llm/test_pipeline.py has brute-force versions of the stages.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems have it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is a table in the shared folder.

    A stage's input is removed once its output is written; the last table is the
    result and stays.
    """
    folder = shared_folder(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            _remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
