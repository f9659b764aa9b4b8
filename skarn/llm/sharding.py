"""Sharding by sampled splitters.

Records have a key (the hash of the text, then the id, so that equal texts lie
together but a large group of them can still be divided).  A bounded sample of
keys, drawn with a chance in proportion to the size, gives quantile boundaries
that range-partition the records; ranges that turn out overfull are subdivided
by drawing again within them.  The exact sizes of the ranges then place every
range on the shards: a range that lies within one shard goes there whole, and one
that crosses a boundary is dealt, largest records first, to the shard that still
lacks most bytes.  So the law is ``bytes``: sizes near equal.

Defined cases: a null text has size 8 and a null checksum; rows without an id are
placed too; repeated rows have equal keys and may lie on both sides of a
boundary; an empty table gives no rows; extra columns are ignored (the records
with their shard: ``write_shards``); a record larger than a shard's share makes
its shard larger than the others.
"""

from __future__ import annotations

from bisect import bisect_right
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, own, table, with_batches

SHARDS = 24
#: Records of a range, about; an overfull one has more than twice as many.
RANGE_ROWS = 100_000
#: Samples drawn for each range.
OVERSAMPLE = 64
#: Samples in all, while there are 4 for a range; fewer samples mean less even ranges,
#: which are subdivided, and shards just as even.
MAX_SAMPLES = 2_000_000
#: Times that overfull ranges are subdivided.
ROUNDS = 3

_KEY = [own("k"), own("id")]


def _mark(docs: DataFrame) -> list[str]:
    """The unique mark of a row, where ``write_shards`` has set one."""
    return [own("mark")] if own("mark") in docs.columns else []


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.encode(F.col(text_col).cast("string"), "UTF-8")
    return docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(text_col).cast("string")).alias(_KEY[0]),
        F.xxhash64(F.col(id_col).cast("string")).alias(_KEY[1]),
        *_mark(docs),
    )


def _drawn(rows: DataFrame, chance: Column) -> list[tuple[int, int]]:
    """Keys, each drawn with its chance; the same rows give the same sample."""
    uniform = (F.xxhash64(*_KEY, F.lit(41)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    return sorted((r[0], r[1]) for r in rows.filter(uniform < chance).select(*_KEY).collect())


def _in_ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.array([k for k, _ in splitters], np.int64), np.array([i for _, i in splitters], np.int64))
    )

    def compute(batch: pa.RecordBatch) -> dict:
        ks, ids = shared.value
        k, i = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in _KEY)
        low, high = np.searchsorted(ks, k, "left"), np.searchsorted(ks, k, "right")
        out = low.copy()
        for at in np.flatnonzero(high > low).tolist():  # the key itself is a splitter
            out[at] = low[at] + np.searchsorted(ids[low[at] : high[at]], i[at], "right")
        return {own("range"): pa.array(out.astype(np.int32), pa.int32())}

    return with_batches(rows, compute, [T.StructField(own("range"), T.IntegerType())])


def _sizes(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range; there are rows / RANGE_ROWS ranges or some more."""
    grouped = ranged.groupBy(own("range")).agg(F.sum("size"), F.count(F.lit(1)))
    return {r[0]: (r[1], r[2]) for r in grouped.collect()}


def choose_splitters(rows: DataFrame, total: int, n_rows: int, shards: int, range_rows: int, oversample: int) -> list[tuple[int, int]]:
    n = max(shards, ceil(n_rows / range_rows))
    oversample = max(4, min(oversample, MAX_SAMPLES // n))
    wanted = n * oversample
    sample = _drawn(rows, F.col("size") * F.lit(wanted / max(1, total)))
    splitters = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    for _ in range(ROUNDS):
        ranged = _in_ranges(rows, splitters)
        sizes = _sizes(ranged)
        overfull = {r: b for r, (b, c) in sizes.items() if b > 2 * total / n or c > 2 * range_rows}
        if not overfull:
            break
        share = F.lit(oversample * n / max(1, total)) * F.col("size") * 4
        again = _drawn(ranged.filter(F.col(own("range")).isin(list(overfull))), share)
        more: dict[int, list] = {}
        for key in again:
            more.setdefault(bisect_right(splitters, key), []).append(key)
        added = set()
        for r, keys in more.items():
            parts = max(2, ceil(overfull.get(r, 0) * n / max(1, total)), ceil(sizes[r][1] / range_rows) if r in sizes else 2)
            added |= {keys[i * len(keys) // parts] for i in range(1, parts)}
        if added <= set(splitters):
            break  # one record, or rows of one key, cannot be divided
        splitters = sorted(added | set(splitters))
    return splitters


def assign_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shards: int = SHARDS,
    range_rows: int = RANGE_ROWS,
    oversample: int = OVERSAMPLE,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    rows = cut(measure(docs, id_col, text_col))  # a few numbers a record; texts are read once
    whole = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, n_rows = whole[0] or 0, whole[1]
    splitters = choose_splitters(rows, total, n_rows, shards, range_rows, oversample)
    ranged = cut(_in_ranges(rows, splitters))
    sizes = _sizes(ranged)
    quotas: dict[int, list[tuple[int, float]]] = {}
    at = 0
    for r in sorted(sizes):
        low, high = at, at + sizes[r][0]
        at = high
        first, last = min(shards - 1, low * shards // total), min(shards - 1, (high - 1) * shards // total)
        quotas[r] = [(s, min(high, (s + 1) * total / shards) - max(low, s * total / shards)) for s in range(first, last + 1)]
    within = {r: q[0][0] for r, q in quotas.items() if len(q) == 1}
    shared = docs.sparkSession.sparkContext.broadcast((within, quotas))  # numbers of the ranges
    schema = T.StructType([*ranged.schema.fields, T.StructField("shard", T.IntegerType())])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        lacking = [(-q, s) for s, q in shared.value[1][int(pdf[own("range")].iloc[0])]]
        heapq.heapify(lacking)
        pdf = pdf.sort_values(["size", *_KEY], ascending=[False, True, True], kind="stable")
        shard = []
        for size in pdf["size"].tolist():
            lack, s = lacking[0]
            heapq.heapreplace(lacking, (lack + size, s))
            shard.append(s)
        return pdf.assign(shard=np.array(shard, np.int32))

    def whole_ranges(batch: pa.RecordBatch) -> dict:
        ranges = batch.column(batch.schema.get_field_index(own("range"))).to_pylist()
        return {"shard": [shared.value[0][r] for r in ranges]}

    crossing = [r for r in quotas if r not in within]  # fewer than two for each shard
    some = ranged.filter(F.col(own("range")).isin(crossing)) if crossing else ranged.limit(0)
    others = ranged.filter(~F.col(own("range")).isin(crossing)) if crossing else ranged
    dealt = some.groupBy(own("range")).applyInPandas(deal, schema)
    placed = cut(dealt.unionByName(with_batches(others, whole_ranges, [T.StructField("shard", T.IntegerType())])))
    # Slots: a running number in each range and shard, after all that lie before.
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy("shard", own("range")).count().collect()}
    before, starts = {}, {}
    for s, r in sorted(counts):
        starts[s, r] = before.get(s, 0)
        before[s] = starts[s, r] + counts[s, r]
    first = docs.sparkSession.createDataFrame([(s, r, n) for (s, r), n in starts.items()], f"shard int, {own('range')} int, {own('first')} long")
    part = Window.partitionBy("shard", own("range")).orderBy(*_KEY, *_mark(docs))
    out = placed.join(F.broadcast(first), ["shard", own("range")])  # a row for each range and shard
    slot = F.col(own("first")) + F.row_number().over(part) - 1
    return out.select(id_col, "size", "text_crc32", "shard", slot.cast("long").alias("slot"), *_mark(docs))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """All rows and columns of ``docs`` as Parquet, one folder a shard, in order of slot.

    Rows get a unique mark, fixed in the checkpoint folder, and each goes to its own shard and slot.
    """
    marked = cut(docs.withColumn(own("mark"), F.monotonically_increasing_id()))
    placed = assign_shards(marked, id_col, text_col, **options).select(own("mark"), "shard", "slot")
    out = marked.join(placed, own("mark")).drop(own("mark"))
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


