"""Near-dedup: repeated ids, hot centres and sets, signatures, clashing columns."""

import random

from skarn.llm import neardup


def text(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b, c, d = (text(i) for i in range(4))
    rows = [(1, a, "x"), (1, b, "y"), (2, c, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    assert sorted(tuple(r) for r in neardup.remove_near_duplicates(docs).collect()) == sorted(rows)
    # One row of id 5 copies row 3, another one is unique; row 6 copies that one.
    rows = [(3, a, "a"), (5, a.upper(), "b"), (5, b, "c"), (6, b + " end", "d"), (7, d, "e"), (7, d, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)
    left = sorted(tuple(r)[:2] for r in neardup.remove_near_duplicates(docs).collect())
    assert left == [(3, a), (5, b), (7, d)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)]


def test_hot_centres_and_sets(spark, monkeypatch):
    """Every key counts as hot: parts of a centre's set and broadcast rows give the same classes."""
    base = text(9, 80).split()
    rows = [(i, " ".join(w if k != i else "edit" for k, w in enumerate(base))) for i in range(60)]
    rows += [(100 + i, " ".join(base)) for i in range(20)] + [(200 + i, text(200 + i)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(tuple(r) for r in neardup.near_duplicates(docs).collect())
    monkeypatch.setattr(neardup, "HOT_ROWS", 2)
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == plain
    assert len({r[2] for r in plain}) == 11
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 100)  # blocks by shingles, not by nodes
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == plain


def test_signatures_come_before_sets(spark):
    """A pair far below the similarity goes by its signature, one above it by its set."""
    a, b = text(1, 200).split(), text(2, 200).split()
    nodes = [(1, " ".join(a)), (2, " ".join(a[:195] + ["x"] * 5)), (3, " ".join(a[:100] + b[:100]))]
    docs = spark.createDataFrame(nodes, "doc_id long, text string")
    wanted = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "node long, first long")
    sets = neardup._sets_of(docs, wanted, False, "doc_id", "text", 5, 130).cache()
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "u long, v long")
    assert [tuple(r) for r in neardup._confirmed(pairs, sets, 85).collect()] == [(1, 2)]
    sigs = {r["node"]: r["sig"] for r in sets.collect()}
    share = lambda x, y: sum(p == q for p, q in zip(sigs[x], sigs[y], strict=True)) / 130
    assert share(1, 2) > 0.8 and share(1, 3) < 0.6


def test_clashing_columns_and_empty_table(spark):
    schema = "doc_id long, text string, n_shingles string, node int, component_id string, kept string, t string"
    docs = spark.createDataFrame([(1, text(1), "a", 1, "b", "c", "d"), (2, text(1), "a", 1, "b", "c", "d"), (3, None, None, None, None, None, None)], schema)
    out = neardup.remove_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    assert neardup.remove_near_duplicates(docs.limit(0)).collect() == []
