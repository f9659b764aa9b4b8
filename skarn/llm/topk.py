"""Exact top-k inner products by norm order and rotated partial sums.

Components are integers (``floor(scale * x)``), so scores are exact.  The vectors
are rotated by the singular vectors of a sample, which moves most of their length
into the first coordinates, and dealt into groups of descending length.

1. The group of the longest vectors gives every query k scores, the least of
   which no member of the result can be under.
2. The other groups follow in waves, each four times the last.  Before a wave,
   pairs of a query block and a group are dropped where no query's length times
   the group's longest length reaches its k-th score so far (Cauchy-Schwarz).
3. Within a pair, the partial sum over the first rotated coordinates plus the
   product of the residual lengths bounds a score; more coordinates follow level
   by level while many vectors are open, and only those whose bound reaches the
   k-th score are scored.  Better k-th scores go on to the next wave.

Queries and vectors meet in blocks: packed matrices, one row a block.  Queries
travel to the groups; a group is copied once for every ``QUERIES_A_COPY`` query
blocks that ask it.  Pruning is with a margin for rounding; what decides is the
exact integer score.  How much is pruned depends on the data: where lengths hardly
differ and the rotation gathers little length, nearly all pairs are scored.

Defined cases: null vectors, vectors with a null or non-finite component, or with
one that is non-finite once scaled, and rows without an id take no part; scores
beyond the range of long are given as its ends; shorter vectors count as padded
with zeros; a query's own id is never among its results, repeated rows of other
ids are results as often as they occur; with fewer than k vectors all are given;
ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, own, table

K = 20
SCALE = 64
#: Vectors of a group and queries of a block.
GROUP_ROWS = 8192
QUERY_ROWS = 1024
#: Query blocks that one copy of a group answers.
QUERIES_A_COPY = 8
#: Ranges of length that groups are cut from; a range of more vectors has several groups.
MAX_BANDS = 256
#: Rotated coordinates of each level of the partial sums.
HEAD = 16
#: Vectors that the rotation is learned from; it changes the speed, not the result.
ROTATION_SAMPLE = 5000


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, norm2) of the vectors that take part; v are whole numbers as doubles."""
    x = F.col(vector_col)
    scaled = lambda c: c.cast("double") * scale
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(scaled(c)) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(~bad)
    # floor gives longs; from 2^53 on doubles are whole numbers.
    v = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < 2.0**53, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))


def learn_rotation(rows: DataFrame, dim: int, sample: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, by hash of the id."""
    got = rows.orderBy(F.xxhash64("id")).limit(sample).select("v").collect()
    m = _matrix([r[0] for r in got], dim)
    return np.linalg.svd(m, full_matrices=True)[2].T if len(m) <= dim else np.linalg.eigh(m.T @ m)[1][:, ::-1].copy()


def _matrix(vectors: list, dim: int) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, dim))
    if all(len(v) == dim for v in vectors):
        return np.array(vectors, np.float64).reshape(-1, dim)
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(rows: DataFrame, group: str, dim: int) -> DataFrame:
    """One row a group: its ids and vectors, longest first, as bytes, and the longest length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["norm2", "id"], ascending=[False, True], kind="stable")
        ids = pdf["id"].to_numpy(np.int64)
        return pd.DataFrame({group: [int(pdf[group].iloc[0])], "ids": [ids.tobytes()], "m": [_matrix(list(pdf["v"]), dim).tobytes()], "top": [float(np.sqrt(pdf["norm2"].iloc[0]))]})

    return rows.select(group, "id", "v", "norm2").groupBy(group).applyInPandas(run, f"{group} int, ids binary, m binary, top double")


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact below 2^53, beyond 2^63 scores are its ends."""
    largest = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q @ x.T).astype(np.int64)
    if largest < 2**63 and np.abs(q).max(initial=0) < 2**63 and np.abs(x).max(initial=0) < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [np.array([[int(c) for c in row] for row in m], object).reshape(m.shape) for m in (q, x)]
    return np.clip(whole[0].dot(whole[1].T), -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, ~scores))[:k]  # ~s is -s - 1, which a long can hold


def search_block(
    q_ids: np.ndarray,
    q: np.ndarray,
    least: np.ndarray,
    ids: np.ndarray,
    x: np.ndarray,
    rotation: np.ndarray,
    k: int,
    head: int,
    step: int = 1024,
    scored: list[int] | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) with every vector of the block that may be in the result.

    ``scored``: gets the number of pairs that were scored for each part.
    """
    dim = q.shape[1]
    levels = [slice(i, min(i + head, dim)) for i in range(0, dim, head)][: max(1, -(-dim // head) - 1)]
    with np.errstate(invalid="ignore", over="ignore"):
        q_rot, x_rot = q @ rotation, x @ rotation
        q_len, x_len = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
        q_rest, x_rest = ([np.sqrt((m[:, level.stop :] ** 2).sum(1)) for level in levels] for m in (q_rot, x_rot))
        held: list[tuple[list, list]] = [([], []) for _ in q_ids]
        least = least.astype(np.float64).copy()
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            margin = 1e-9 * q_len * x_len[at] + 1e-6
            alive = np.flatnonzero(~(q_len * x_len[at] + margin < least))  # x is in order of length
            if not len(alive):
                break
            partial = margin[alive, None]
            for n, level in enumerate(levels):
                partial = partial + q_rot[alive, level] @ x_rot[part, level].T
                open_ = ~(partial + q_rest[n][alive, None] * x_rest[n][None, part] < least[alive, None])  # what is no number stays
                if open_.mean() <= 0.05:
                    break
            many = open_.mean() > 0.05
            if scored is not None:
                scored.append(open_.size if many else int(open_.sum()))
            if many:
                scores = _exact(q[alive], x[part])
                for r, a in enumerate(alive.tolist()):
                    found = np.flatnonzero(open_[r] & (scores[r] >= least[a]))
                    _keep(held[a], ids[part][found], scores[r][found], q_ids[a], k, least, a)
            else:
                for r in np.flatnonzero(open_.any(axis=1)).tolist():
                    a, found = int(alive[r]), np.flatnonzero(open_[r])
                    _keep(held[a], ids[part][found], _exact(q[a : a + 1], x[part][found])[0], q_ids[a], k, least, a)
    for a, (some, scores) in enumerate(held):
        if some:
            yield a, np.concatenate(some), np.concatenate(scores)


def _keep(held: tuple[list, list], ids: np.ndarray, scores: np.ndarray, own_id: int, k: int, least: np.ndarray, a: int) -> None:
    other = ids != own_id
    ids, scores = ids[other], scores[other]
    if not len(ids):
        return
    every, values = np.concatenate([*held[0], ids]), np.concatenate([*held[1], scores])
    best = _best(every, values, k)
    held[0][:], held[1][:] = [every[best]], [values[best]]
    if len(best) == k:
        least[a] = max(least[a], float(values[best[-1]]))


def _search(asked: DataFrame, groups: DataFrame, rotation, dim: int, k: int, head: int) -> DataFrame:
    """(query_id, vec_id, score): query blocks meet the copy of the group that is theirs, by g and copy."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors):
            ids, x = np.frombuffer(vectors["ids"].iloc[0], np.int64), np.frombuffer(vectors["m"].iloc[0]).reshape(-1, dim)
            for q_ids, q_m, least in zip(queries["q_ids"], queries["q_m"], queries["least"], strict=True):
                q_ids, q, least = np.frombuffer(q_ids, np.int64), np.frombuffer(q_m).reshape(-1, dim), np.frombuffer(least)
                out += [(np.full(len(s), q_ids[a]), i, s) for a, i, s in search_block(q_ids, q, least, ids, x, rotation.value, k, head)]
        columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in (zip(*out, strict=True) if out else [[], [], []])]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))

    return asked.groupBy("g", "copy").cogroup(groups.groupBy("g", "copy")).applyInPandas(run, "query_id long, vec_id long, score long")


def _thresholds(asked: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """(qb, least, reach): the k-th score so far of each query, in the order of its block, and
    the length that a vector must have to be in the result of any of them."""
    rows = asked.select("qb", "norm2", "id")
    if found is None:
        rows = rows.withColumn("s", F.lit(None).cast("long"))
    else:
        kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("s")).dropDuplicates(["id"])
        rows = rows.join(kth, "id", "left")
    listed = rows.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct((-F.col("norm2")).alias("n"), "id", "s"))).alias("l"))  # QUERY_ROWS or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, reach = [], []
            for entries in batch.column(1).to_pylist():
                s = np.array([-np.inf if e["s"] is None else e["s"] for e in entries], np.float64)
                lengths = np.sqrt(np.array([-e["n"] for e in entries], np.float64))
                with np.errstate(divide="ignore", invalid="ignore"):
                    needed = np.where(s <= 0, 0.0, s / lengths)
                least.append(s.tobytes())
                reach.append(float(np.nan_to_num(needed, nan=0.0).min()) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.binary()), pa.array(reach, pa.float64())], ["qb", "least", "reach"])

    return listed.mapInArrow(run, "qb int, least binary, reach double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = K,
    scale: int = SCALE,
    group_rows: int = GROUP_ROWS,
    query_rows: int = QUERY_ROWS,
    head: int = HEAD,
    sample: int = ROTATION_SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows = cut(integer_vectors(vectors, id_col, vector_col, scale))
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(is_query)).first()
    n, dim, n_queries = facts[0], max(1, facts[1] or 1), facts[2]
    rotation = spark.sparkContext.broadcast(learn_rotation(rows, dim, sample))  # dim x dim
    groups, q_blocks = max(1, ceil(n / group_rows)), max(1, ceil(n_queries / query_rows))
    bands = min(groups, MAX_BANDS)
    bounds = rows.approxQuantile("norm2", [i / bands for i in range(1, bands)], 0.1 / bands) if bands > 1 else []
    bounds = sorted(set(bounds))
    # Ranges of many vectors are dealt on in parts of group_rows.
    band = sum([F.when(F.col("norm2") <= b, 1).otherwise(0) for b in bounds], F.lit(0))
    banded = rows.withColumn("band", band.cast("int"))
    sizes = {r[0]: r[1] for r in banded.groupBy("band").count().collect()}  # a row a band
    first, at = {}, 0
    for b in sorted(sizes):
        first[b], at = (at, ceil(sizes[b] / group_rows)), at + ceil(sizes[b] / group_rows)
    starts = spark.createDataFrame([(b, s, p) for b, (s, p) in first.items()], "band int, start int, parts int")
    dealt = banded.join(F.broadcast(starts), "band").withColumn("g", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    packed = cut(_packed(dealt, "g", dim))
    asked = rows.filter(is_query).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(q_blocks)).cast("int"))
    queries = cut(_packed(asked, "qb", dim).select("qb", F.col("ids").alias("q_ids"), F.col("m").alias("q_m")))
    found, low, high = None, 0, 1
    while low < at:
        wave = packed.filter((F.col("g") >= low) & (F.col("g") < high))
        known = _thresholds(asked, found, k)
        # Numbers only: which blocks have to meet.
        pairs = known.select("qb", "reach").withColumn("g", F.explode(F.sequence(F.lit(low), F.lit(min(high, at) - 1))))
        pairs = cut(pairs.join(wave.select("g", "top"), "g").filter(~(F.col("top") < F.col("reach"))).select("g", "qb"))
        copies = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_COPY).cast("int").alias("copies"))
        to = pairs.join(copies, "g").withColumn("copy", F.pmod(F.xxhash64("qb"), F.col("copies")).cast("int")).select("g", "qb", "copy")
        sent = to.join(queries.join(known.select("qb", "least"), "qb"), "qb").select("g", "copy", "q_ids", "q_m", "least")
        copied = wave.join(copies, "g").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("g", "copy", "ids", "m")
        new = _search(sent, copied, rotation, dim, k, head)
        if found is not None:
            new = found.select("query_id", "vec_id", "score").unionByName(new)
        found = cut(_ranked(new, k))
        low, high = high, 4 * high
    return found.select("query_id", "rank", "vec_id", "score") if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


OP7_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
