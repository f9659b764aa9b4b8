"""Queries that work on all rows of their tables, on small tables whose results are plain."""

import datetime

import __spark_entry__ as entry


def write_events(spark, folder, rows):
    """rows: (event_id, user_id, event_type, hours since 2024-01-14)."""
    start = datetime.datetime(2024, 1, 14)
    rows = [(i, u, kind, start + datetime.timedelta(hours=h), 1.0) for i, u, kind, h in rows]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_graph_has_all_events_and_days(spark, tmp_path):
    d = write_events(spark, tmp_path, [(0, 1, "signup", 0), (1, 1, "error", 1), (2, 1, "view", 2), (3, 1, "error", 25), (4, 2, "click", 3)])
    queries = entry.queries()
    nodes = {(r["id"], r["node_type"], r["last_event"]) for r in queries["graph_nodes_upsert"](spark, d).collect()}
    events = {("e0", "signup", None), ("e1", "error", None), ("e2", "view", None), ("e3", "error", None), ("e4", "click", None)}
    assert nodes == events | {("u1", "user", "error"), ("u2", "user", "click"), ("d2024-01-14", "day", None), ("d2024-01-15", "day", None)}
    edges = {r["edge_id"].split("@")[0] for r in queries["graph_edges"](spark, d).collect()}
    assert edges == {"u1→enables→e0", "u1→enables→e1", "u1→enables→e2", "u1→enables→e3", "u2→enables→e4", "e0→before→e1", "e1→before→e2", "e2→before→e3", "e1→causes→e3"}


def test_chains_start_from_every_user(spark, tmp_path):
    d = write_events(spark, tmp_path, [(i, 100 + i, "view", i) for i in range(5)])
    assert {r["path"] for r in entry.queries()["causal_chain"](spark, d).collect()} == {f"u{100 + i}>e{i}" for i in range(5)}


def test_ancestors_of_all_parts(spark, tmp_path):
    spark.range(300).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for k in range(1, 300):
        a = k
        while a:
            a //= 2
            want.add((str(a), str(k)))
    assert {(r["X"], r["Z"]) for r in entry.queries()["fol_ancestor_fixpoint"](spark, str(tmp_path)).collect()} == want


def test_years_of_all_orders(spark, tmp_path):
    rows = [("HIGH", datetime.date(y, 5, 1), float(y)) for y in range(1990, 1999)] + [("LOW", None, 1.0)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["ticker"], r["date"], r["value"]) for r in entry.queries()["date_columns_to_long"](spark, str(tmp_path)).collect()}
    assert got == {("HIGH", f"{y}-01-01", float(y)) for y in range(1990, 1999)}


def test_types_of_all_individuals(spark, tmp_path):
    for name, row, schema in (
        ("customer", (7, 1), "c_custkey long, c_nationkey long"),
        ("nation", (1, "FRANCE", 2), "n_nationkey long, n_name string, n_regionkey long"),
        ("region", (2, "EUROPE"), "r_regionkey long, r_name string"),
        ("part", (9, 2), "p_partkey long, p_size int"),
    ):
        spark.createDataFrame([row], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["ind"], r["coll"]) for r in entry.queries()["onto_is_isa"](spark, str(tmp_path)).collect()}
    assert got == {("customer-7", c) for c in ("FRANCE", "EUROPE", "World")} | {("part-9", c) for c in ("size-2", "size-1", "World")}


def test_checkpoints_reach_the_last_event(spark, tmp_path):
    rows = spark.range(12_000).selectExpr("id AS event_id", "id % 3000 + IF(id >= 11000, 5000, 0) AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["upto"]: (r["exact"], r["estimate"]) for r in entry.queries()["hll_checkpoints"](spark, str(tmp_path)).collect()}
    assert {u: x for u, (x, _) in got.items()} == {100: 100, 500: 500, 1000: 1000, 5000: 3000, 10000: 3000, 12000: 4000}
    assert all(abs(n - x) <= 0.05 * x for x, n in got.values())
