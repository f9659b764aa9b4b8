"""Exact top-k: against brute force with spread lengths, waves, huge components, and what is pruned."""

import numpy as np

from skarn.llm import topk


def brute(rows, k, scale=64):
    dim = max(len(v) for _, v in rows)
    whole = [(i, [int(np.floor(float(x) * scale)) for x in v] + [0] * (dim - len(v))) for i, v in rows]
    out = []
    for i, q in whole:
        if i % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), j) for j, x in whole if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def spread(n, dim=24, seed=2):
    """Lengths that fall by a power law, most length in few directions."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.geomspace(4, 0.05, dim)
    return v * (1 + np.arange(n))[:, None] ** -0.7


def test_waves_against_brute_force(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(spread(600))]
    rows += [(600 + i, rows[3][1]) for i in range(30)] + [(700, []), (720, [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for rows_a_group, rows_a_block in ((40, 9), (10_000, 10_000)):
        got = topk.top_k(df, topk.F.col("id") % 20 == 0, group_rows=rows_a_group, query_rows=rows_a_block, head=4)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_huge_and_unusable_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -5.0]), (2, [3e9, 3e9]), (3, [-1e300, 0.0]), (20, [3e9, 2e9]), (4, [0.5, 0.25])]
    odd = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.7e308, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = topk.top_k(df, topk.F.col("id") % 20 == 0, k=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4)


def test_blocks_and_vectors_are_pruned(spark):
    """Of vectors of spread lengths few are scored, and late groups are never asked."""
    v = np.floor(64 * spread(4096))
    order = np.argsort(-(v * v).sum(1), kind="stable")
    x, rotation = v[order], np.linalg.svd(v, full_matrices=True)[2].T
    q, ids = x[100:160], np.arange(len(x))
    scored: list[int] = []
    least = np.full(len(q), -np.inf)
    found = {a: s for a, _, s in topk.search_block(ids[100:160], q, least, ids, x, rotation, 20, 4, step=64, scored=scored)}
    assert sum(scored) < 0.1 * len(q) * len(x)
    every = q @ x.T
    for a in range(len(q)):
        other = np.delete(every[a], 100 + a)
        assert sorted(found[a])[-20:] == sorted(other)[-20:]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>").withColumn("norm2", topk.F.aggregate("v", topk.F.lit(0.0), lambda s, c: s + c * c))
    asked = df.filter("id IN (100, 500)").withColumn("qb", topk.F.lit(0))
    near = asked.select(topk.F.col("id").alias("query_id"), topk.F.lit(20).alias("rank"), (topk.F.col("norm2") / 2).cast("long").alias("score"))
    reach = topk._thresholds(asked, near, 20).first()["reach"]
    lengths = np.sqrt((v * v).sum(1))
    assert reach > 0 and (lengths < reach).any()  # groups of such vectors are not sent


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 5, "x"), (1, [2.0, 1.0], 6, "y")], "vec_id long, embedding array<double>, id int, g string")
    assert [tuple(r) for r in topk.top_k(df, topk.F.col("id") == 0).collect()] == [(0, 1, 1, 4 * 64 * 64)]
    assert topk.top_k(df.limit(0), topk.F.col("id") == 0).collect() == []
