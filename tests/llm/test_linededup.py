"""Line dedup: against brute force, parts of a hot shard, repeated ids, clashing columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from skarn.llm import linededup
from skarn.llm.common import own


def brute(rows, min_docs):
    """rows: (id, text); (n_lines, n_dropped, text) by row."""
    holders = {}
    for n, (i, t) in enumerate(rows):
        for line in (t or "").encode().split(b"\n"):
            key = linededup.line_key(line)
            if key:
                holders.setdefault(key, set()).add(("row", n) if i is None else i)
    gone = {k for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if linededup.line_key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=repr)


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [f"Line {rng.randrange(60)} " for _ in range(rng.randrange(6))] + ["\tEverywhere"] * (i % 2)
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rows = made(300) + [(None, "everywhere\nnobody"), (None, "Line 3"), (5000, None), (5001, ""), (5002, "\n\n")]
    for options in ({}, {"shard_keys": 7, "part_rows": 10}):
        out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=20, **options)
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=repr) == brute(rows, 20)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "often\nown")] * 12 + [(1, "often\nother"), (2, "often")] + [(10 + i, f"rare {i}\nshared") for i in range(10)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=repr) == brute(rows, 10)


def test_every_frequent_line_comes_from_the_arrays(spark):
    """A line of half of all rows is probed in many parts, each with the arrays."""
    rows = made(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = linededup.row_key("doc_id", "text")
    lines = linededup._line_hashes(docs.withColumn(own("a"), a).withColumn(own("b"), b), "doc_id", "text", 1).cache()
    counts = linededup.count_lines(lines).cache()
    hot = np.frombuffer(linededup.line_hash(b"everywhere"), "<i8")
    assert counts.filter((F.col(own("x")) == int(hot[0])) & (F.col(own("y")) == int(hot[1]))).first()[own("n")] == 200
    split = linededup.split_shards(counts, 8, 50)
    parts = {r[own("shard")]: r[own("parts")] for r in split.collect()}
    owner = docs.select(F.pmod(F.xxhash64(F.lit(int(hot[0]))), F.lit(8))).first()[0]
    assert parts[owner] >= 4
    probes = linededup._unpacked(lines, own("a"), own("b")).withColumn(own("m"), F.monotonically_increasing_id())
    found = linededup.probe_shards(probes, linededup.build_shards(counts, 8), split, 8, 10)
    want = counts.filter(F.col(own("n")) >= 10).agg(F.sum(own("n"))).first()[0]
    assert found.count() == want  # all occurrences of all frequent lines, none from elsewhere


def test_slots_of_hashes_that_share_a_half(spark):
    x, y = np.array([5, 5, 6], np.int64), np.array([1, 2, 1], np.int64)
    assert len(set(linededup.slot_keys(x, y, 0).tolist())) == 3
    rows = [(5, 1, 30), (5, 2, 3), (6, 1, 40)]
    counts = spark.createDataFrame(rows, f"{own('x')} long, {own('y')} long, {own('n')} long")
    probes = spark.createDataFrame([(n, n, r[0], r[1], n) for n, r in enumerate(rows)], ", ".join(f"{own(c)} long" for c in "abxym"))
    shards, split = linededup.build_shards(counts, 1), linededup.split_shards(counts, 1, 1000)
    assert sorted(r[own("a")] for r in linededup.probe_shards(probes, shards, split, 1, 10).collect()) == [0, 2]


def test_clashing_columns_and_empty_table(spark):
    schema = "n_lines string, doc_id long, text string, n_dropped double, `a.b` string, n_chars int"
    rows = [("x", i, f"head\nbody {i}", 0.5, "z", 99) for i in range(12)] + [(None, 50, None, None, None, None), ("y", 51, "alone", 1.5, "z", 7)]
    docs = spark.createDataFrame(rows, schema)
    out = linededup.drop_frequent_lines(docs, length_col="n_chars")
    assert out.schema == docs.schema
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert got[3] == ("x", 3, "body 3", 0.5, "z", 6) and got[50] == (None, 50, None, None, None, None) and got[51] == ("y", 51, "alone", 1.5, "z", 7)
    assert linededup.drop_frequent_lines(docs.limit(0)).collect() == []
    replaced = linededup.dedup_lines(docs.drop("a.b"))
    assert {r["n_dropped"] for r in replaced.collect()} == {0, 1}
