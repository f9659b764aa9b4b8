"""Hand-made traces of the stream, graph, logic and market operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from skarn.operators import graph as G
from skarn.operators import ivm, temporal
from skarn.operators import market as M
from skarn.operators import sketches as S
from skarn.operators import windows as W
from skarn.plans import logic as L


def ts(seconds):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)


def test_watermark_trace(spark):
    trace = [(1001, "A", 1), (1003, "B", 2), (1007, "A", 3), (1012, "B", 4), (1016, "A", 5), (1002, "A", 99), (1009, "C", 7), (1025, "A", 8)]
    rows = [(i, ts(t), ts(86400 * 0 + i), k, float(v)) for i, (t, k, v) in enumerate(trace)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, arrival timestamp_ntz, key string, value double")
    replayed = W.replay(df, arrival="arrival", ts="ts", tie="event_id", lag="5 SECONDS", lateness="3 SECONDS")
    fired = W.fired_windows(replayed, ts="ts", key="key", value="value", size="10 seconds").collect()
    got = {(int((r["window_start"] - datetime.datetime(1970, 1, 1)).total_seconds()), r["key"], r["n"], r["total"], r["fire_seq"]) for r in fired}
    assert got == {(1000, "A", 2, 4.0, 5), (1000, "B", 1, 2.0, 5), (1000, "C", 1, 7.0, 8), (1010, "A", 1, 5.0, 8), (1010, "B", 1, 4.0, 8), (1020, "A", 1, 8.0, None)}
    late = W.late_rows(replayed, ts="ts", key="key", value="value", size="10 seconds").collect()
    assert [(r["key"], r["value"]) for r in late] == [("A", 99.0)]
    stats = W.replay_stats(replayed, W.fired_windows(replayed, ts="ts", key="key", value="value", size="10 seconds")).first()
    assert (stats["processed"], stats["late"], stats["closed"]) == (8, 1, 6)


def test_sliding_starts(spark):
    df = spark.createDataFrame([(ts(0), "k", 1.0)], "ts timestamp_ntz, key string, value double")
    got = W.windowed_aggregate(df, "ts", "key", "value", "20 seconds", "5 seconds").collect()
    assert sorted(int((r["window_start"] - ts(0)).total_seconds()) for r in got) == [-15, -10, -5, 0]


def test_sessions_inclusive_gap(spark):
    rows = [(i, "u", ts(t), "/a", 0.0 if t != 190 else 99.99) for i, t in enumerate([100, 120, 140, 170, 190, 155])]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz, page string, value double")
    got = W.sessions(df, "user_id", "ts", "20 seconds", value="value", converted=F.col("value") > 0, page="page").collect()
    assert [(r["n_events"], r["total_value"], r["converted"], r["duration_s"]) for r in got] == [(6, 99.99, True, 90.0)]


def test_asof_canonical(spark):
    read = spark.createDataFrame([(i, "s", t) for i, t in enumerate([50, 150, 220, 300, 400, 600])], "i long, key string, t long").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    thr = spark.createDataFrame([(i, "s", t, v) for i, (t, v) in enumerate([(100, 75), (250, 65), (500, 55)])], "i long, key string, t long, threshold int").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = temporal.asof_join(read, thr.drop("t"), key="key", ts="ts", tie="i", value="threshold", within="120 SECONDS").orderBy("ts").collect()
    assert [r["threshold"] for r in got] == [None, 75, 75, 65, None, 55]


def test_asof_strict(spark):
    rows = [(t, "s", float(t), None) for t in [50, 150, 220, 300, 400, 600]]
    read = spark.createDataFrame(rows, "at int, key string, t double, threshold int").drop("threshold")
    thr = spark.createDataFrame([(t, "s", float(t), v) for t, v in [(100, 75), (250, 65), (500, 55)]], "at int, key string, t double, threshold int")
    read = read.withColumn("at", F.col("at").cast("double")).withColumn("threshold", F.lit(None).cast("int"))
    got = temporal.asof_join_evicting(read, thr.withColumn("at", F.col("at").cast("double")), key="key", ts="t", arrival="at", value="threshold", within_s=120.0, lag_s=10.0)
    assert [r["threshold"] for r in got.orderBy("t").collect()] == [None, 75, 75, 65, None, 55]


def test_ewma_trace(spark):
    df = spark.createDataFrame([("k", i, ts(t), v) for i, (t, v) in enumerate([(0, 50.0), (60, 60.0), (120, 55.0)])], "key string, i long, ts timestamp_ntz, v double")
    got = temporal.ewma(df, key="key", ts="ts", tie="i", value="v", half_life_s=60).orderBy("n").collect()
    assert [round(r["ema"], 9) for r in got] == [50, 55, 55]
    assert [round(r["ema_std"] ** 2, 9) for r in got] == [0, 50, 25]


def test_cms_never_undercounts_and_merges(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("string").alias("item"), "id")
    full = S.cms(df, F.col("item"), width=64)
    exact = df.groupBy("item").count()
    est = S.cms_query(full, exact, "item", width=64).join(exact, "item").collect()
    assert all(r["estimate"] >= r["count"] for r in est)
    merged = S.cms_merge(S.cms(df.filter("id % 2 = 0"), F.col("item"), width=64), S.cms(df.filter("id % 2 = 1"), F.col("item"), width=64))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, full.collect()))


@pytest.mark.parametrize("p", [8, 12])
def test_hll_within_three_sigma(spark, p):
    users = spark.range(5000).select(F.concat(F.lit("user-"), "id").alias("item"))
    got = S.hll_estimate(S.hll_registers(users, F.col("item"), p), p).first()[0]
    assert abs(got - 5000) < 3 * 1.04 / (1 << p) ** 0.5 * 5000
    with pytest.raises(ValueError):
        S.hll_registers(users, F.col("item"), 3)


def test_ivm_equals_recompute(spark):
    base = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 3, 5)], "category string, id int, v int")
    old, new = base.filter("id = 3"), base.filter("id = 1").withColumn("id", F.lit(9))
    sums = lambda df, d=None: ivm.view_of(ivm.signed(df, d), ["category"], {"s": F.col("v")})
    got = ivm.merge(sums(base), sums(new, old), ["category"]).collect()
    assert sorted((r["category"], r["n"], r["s"]) for r in got) == [("a", 3, 7)]


def causal(spark):
    rows = [("rain", "wet", "causes"), ("wet", "skids", "causes"), ("skids", "jam", "causes"), ("driver", "skids", "prevents"), ("jam", "late", "before")]
    edges = spark.createDataFrame([(*r, 1.0, float(i), float(i), float("inf")) for i, r in enumerate(rows)], "source string, target string, edge_type string, weight double, timestamp double, valid_from double, valid_to double")
    seen = spark.createDataFrame([], "id string, node_type string, ts double, embedding array<double>, attributes map<string,string>")
    return G.TemporalGraph(G.upsert_nodes(G.with_endpoints(seen, edges)), edges)


def test_causal_chains(spark):
    g = causal(spark)
    start = spark.createDataFrame([("rain",)], "id string")
    assert [r["path"] for r in g.causal_chains(start).collect()] == [["rain", "wet", "skids", "jam"]]
    back = g.causal_chains(spark.createDataFrame([("jam",)], "id string"), forward=False).collect()
    assert sorted(r["path"] for r in back) == [["jam", "skids", "driver"], ["jam", "skids", "wet", "rain"]]
    hops = {r["id"]: r["hop"] for r in g.neighbors("rain", 0.0, 100.0, 2).collect()}
    assert hops == {"wet": 1, "skids": 2}
    assert {r["id"] for r in g.neighbors("rain", 0.0, 100.0, 2, strict=True).collect()} == {"wet"}


def test_logic(spark):
    kb = L.LogicEngine(spark)
    for text in ["human(socrates)", "human(plato)", "god(zeus)", "greek(socrates)", "mortal(?X) :- human(?X)", "greek_philosopher(?X) :- mortal(?X), greek(?X)"]:
        kb.tell(text)
    assert sorted(r["X"] for r in kb.ask("mortal(?X)").collect()) == ["plato", "socrates"]
    assert not kb.proves("mortal(zeus)")
    assert [r["X"] for r in kb.ask("greek_philosopher(?X)").collect()] == ["socrates"]
    kb.reset()
    for text in ["parent(tom, bob)", "parent(bob, ann)", "ancestor(?X, ?Z) :- parent(?X, ?Z)", "ancestor(?X, ?Z) :- parent(?X, ?Y), ancestor(?Y, ?Z)"]:
        kb.tell(text)
    assert sorted(r["args"] for r in kb.forward().collect()) == ["bob,ann", "tom,ann", "tom,bob"]
    assert kb.stats()["rules"] == 2


def test_parser():
    c = L.parse_clause("ancestor(?X, ?Z) :- parent(?X, ?Y), ancestor(?Y, ?Z)")
    assert len(c.head.args) == 2 and len(c.body) == 2
    assert L.parse_atom("p(f(?X, 2), 'a b', 1.5)").args == (L.Func("f", (L.Var("X"), 2)), "a b", 1.5)
    assert L.parse_formula("p(?x) | q(?x) -> r(?x)").op == "implies"
    assert L.parse_formula("forall ?x (p(?x) -> q(?x))").bound == ("x",)
    assert L.unify(L.Var("X"), L.Func("f", (L.Var("X"),))) is None
    assert L.unify(L.parse_atom("p(?X, b)"), L.parse_atom("p(a, ?Y)")) == {"X": "a", "Y": "b"}


def test_ontology_cycle(spark):
    genls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "sub string, sup string")
    types = spark.createDataFrame([("x", "a")], "ind string, coll string")
    o = L.Ontology(spark.createDataFrame([("p", 2, "l")], "name string, arity int, label string"), genls, types)
    assert {tuple(r) for r in o.closure().collect()} == {(x, y) for x in "abc" for y in "abc" if x != y}
    assert {r["coll"] for r in o.all_types().collect()} == {"a", "b", "c"}


def test_constituents_and_filter(spark):
    raw = spark.createDataFrame([("BRK.B", "Berkshire", "Financials", "Consumer Finance"), (None, "x", "y", "z"), ("MSFT", "Microsoft", "Information Technology", "Software")], "Ticker string, `Company Name` string, Sector string, `Sub–Industry` string")
    c = M.normalize_constituents(raw)
    assert sorted(r["Symbol"] for r in c.collect()) == ["BRK-B", "MSFT"]
    assert [r["Symbol"] for r in M.filter_by_industry(c, " Technology ").collect()] == ["MSFT"]
    assert [r["Symbol"] for r in M.filter_by_industry(c, "berkshire").collect()] == ["BRK-B"]
    assert M.filter_by_industry(c, "zzz").collect() == []
    with pytest.raises(ValueError):
        M.filter_by_industry(c, "  ")


def test_constituents_without_a_required_column(spark):
    for raw in ("Ticker string, Sector string", "Ticker string, Company string", "Company string, Sector string"):
        with pytest.raises(ValueError):
            M.normalize_constituents(spark.createDataFrame([("x", "y")], raw))
    no_industry = M.normalize_constituents(spark.createDataFrame([("x", "y", "z")], "Ticker string, Company string, Sector string"))
    assert no_industry.first()["Industry"] == "z"


def test_lexicon_score(spark):
    texts = {
        "A good year": 1.9, "a VERY good year": 2.193, "not a good year": -0.74 * 1.9, "it wasn't very good": -0.74 * 2.193,
        "no one said that good": 1.9, "slightly bad, great": -1.607 + 3.1, "the and of in": 0.0, "": 0.0, "good": 1.9, "not": 0.0,
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = {r["text"]: r["score"] for r in df.select("text", M.lexicon_score(F.col("text")).alias("score")).collect()}
    assert got.pop(None) is None
    assert got == {t: pytest.approx(s / (s * s + 15) ** 0.5) for t, s in texts.items()}


def test_sentiment_join_and_forecast(spark):
    days = [d for d in (datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(60)) if d.weekday() < 5][:40]
    prices = spark.createDataFrame([("A", d, 100.0 + i) for i, d in enumerate(days)], "ticker string, date date, close double")
    sent = spark.createDataFrame([(d, 1, 0, 0, 1, 0.1) for d in days[:10]], "date date, pos long, neg long, neu long, total long, sentiment_score double")
    joined = M.with_sentiment(prices, sent)
    assert joined.count() == 40 and joined.filter("total = 0").count() == 30
    out = M.arimax_forecast(joined, 5).collect()
    assert len(out) == 5 and all(r["success"] and r["date"].weekday() < 5 and r["ci_lower"] <= r["pred"] <= r["ci_upper"] for r in out)
    assert M.arimax_forecast(joined.limit(10), 5).first()["success"] is False
    wide = M.forecast_wide(spark.createDataFrame([("A", f"d{i}", 100.0 + i) for i in range(5)], "ticker string, date string, pred double"), [f"d{i}" for i in range(5)]).first()
    assert wide["5_Day_Change"] == 4.0 and wide["5_Day_Change_Pct"] == 4.0


def test_sources(spark, tmp_path):
    from skarn.sources import io, parsers

    io.register(spark)
    prices = spark.read.format("skarn_prices").option("tickers", "A,B").option("days", 14).load()
    assert prices.groupBy("ticker").count().count() == 2
    first = io.first_source(spark, [lambda: spark.read.parquet(str(tmp_path / "none"))], [("x",)], "a string")
    assert first.first()["a"] == "x"
    assert io.cached(spark, str(tmp_path / "c"), lambda: prices).count() == io.cached(spark, str(tmp_path / "c"), lambda: prices.limit(1)).count()
    page = spark.createDataFrame([("<table><tr><th>A</th></tr><tr><td><b>1</b></td></tr></table>",)], "html string")
    assert [r["cells"] for r in parsers.html_table(page, "html").orderBy("row").collect()] == [["A"], ["1"]]
    with pytest.raises(ValueError):
        parsers.date_columns(["a"])


def test_streaming_replay_and_ewma(spark, tmp_path):
    from skarn.streaming import jobs

    rows = [(i, float(t), k, float(v), "p") for i, (t, k, v) in enumerate([(1001, "A", 1), (1003, "B", 2), (1007, "A", 3), (1012, "B", 4), (1016, "A", 5), (1002, "A", 99), (1009, "C", 7), (1025, "A", 8)])]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "seq long, t double, key string, value double, part string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("seq long, t double, key string, value double, part string").parquet(path)
    out = jobs.replay(stream, partition="part", key="key", size_s=10, lag_s=5, lateness_s=3)
    q = out.writeStream.format("memory").queryName("replayed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["window_start"], r["key"], r["n"], r["total"], r["late"]) for r in spark.table("replayed").collect()}
    assert got == {(1000.0, "A", 2, 4.0, False), (1000.0, "B", 1, 2.0, False), (1000.0, "A", 1, 99.0, True), (1000.0, "C", 1, 7.0, False), (1010.0, "A", 1, 5.0, False), (1010.0, "B", 1, 4.0, False)}
