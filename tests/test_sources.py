"""Sources, sinks, generators, routes and the graph's simulator, on small inputs."""

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from skarn.operators import graph as G
from skarn.operators import temporal as X
from skarn.plans.logic import LogicEngine, Ontology
from skarn.plans.routes import LogicService
from skarn.sources import generators, parsers, sinks, sql


def test_sql_connector(spark, tmp_path):
    class Connect:
        """A connection to a file, failing as often as asked."""

        def __init__(self, path, failures=0):
            self.path, self.failures = path, failures

        def __call__(self):
            if self.failures:
                self.failures -= 1
                raise OSError("not yet")
            return sqlite3.connect(self.path, timeout=60)

    connect = Connect(str(tmp_path / "store.db"), failures=2)
    sql.execute_ddl(connect, ["CREATE TABLE item (id INTEGER PRIMARY KEY, name TEXT)", "CREATE TABLE gone (x INT)", "DROP TABLE gone"], retries=3, delay_s=0.0)
    with pytest.raises(OSError):
        sql.connected(Connect("", failures=5), retries=2, delay_s=0.0)
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, name string")
    assert sql.write_sql(rows, connect, "item") == 3
    again = spark.createDataFrame([(3, "other"), (4, "d")], "id int, name string")
    sql.write_sql(again, connect, "item")  # keys that are there stay as they are
    read = lambda: sorted(tuple(r) for r in sql.read_sql(spark, connect, "SELECT id, name FROM item", "id int, name string", ["id < 3", "id >= 3"]).collect())
    assert read() == [(1, "a"), (2, None), (3, "c"), (4, "d")]
    sql.write_sql(again, connect, "item", on_conflict="replace")
    assert read()[2] == (3, "other")
    rows.createOrReplaceTempView("item_rows")
    sql.create_views(spark, {"named": "SELECT * FROM item_rows WHERE name IS NOT NULL", "counted": "SELECT count(*) AS n FROM named"})
    assert spark.table("counted").first()["n"] == 2
    assert sql.drop_views(spark, ["counted", "named", "none"]) == ["counted", "named"]


def test_rdf_in_zip_with_limit(spark, tmp_path):
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="http://example.org/c#">'
    body = "".join(f'<rdf:Description rdf:about="http://example.org/c#T{i}"><rdf:type rdf:resource="http://example.org/c#Kind"/><c:genls rdf:resource="http://example.org/c#T{i // 2}"/><c:arity>{i}</c:arity><c:label>t {i}</c:label></rdf:Description>' for i in range(5))
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("o.owl", head + body + "</rdf:RDF>")
    rows = [tuple(r) for r in parsers.read_rdf_zip(spark, str(tmp_path / "o.zip")).collect()]
    assert rows[3] == ("T3", ["Kind"], 3, "t 3", ["T1"]) and len(rows) == 5
    assert parsers.read_rdf_zip(spark, str(tmp_path / "o.zip"), limit=2).count() == 2


def test_missing_ontology_is_empty(spark, tmp_path):
    index = parsers.read_ontology(spark, str(tmp_path / "none.json"))
    assert {r["name"]: r["n"] for r in index.stats().collect()} == {"predicates": 0, "concepts": 0, "individuals": 0}


def test_csv_text(spark):
    texts = spark.createDataFrame([(1, "ticker, a ,b\nX,1, 2\r\nY,3\n"), (2, "ticker"), (3, None)], "id int, text string")
    got = [(r["id"], r["line"], r["row"]) for r in parsers.csv_text_rows(texts, "text").collect()]
    assert got == [(1, 0, {"ticker": "X", "a": "1", "b": "2"}), (1, 1, {"ticker": "Y", "a": "3", "b": ""})]


def test_news_keeps_every_entry(spark):
    text = "## A\n" + "".join(f"### t{i}\nURL: u{i}\n" for i in range(50)) + "## B\nno entry\n"
    assert parsers.parse_news(spark.createDataFrame([(text,)], "m string"), "m").count() == 50


def test_tables_of_text(spark):
    df = spark.createDataFrame([("A<B", 1.0, "good"), (None, 2.0, "poor")], "name string, error double, class string")
    assert "A<B" in sinks.console_table(df)
    assert [r["html"] for r in sinks.html_rows(df, ["name", "error"], "class").collect()] == ['<tr class="good"><td>A&lt;B</td><td>1.0</td></tr>', '<tr class="poor"><td></td><td>2.0</td></tr>']
    assert [r["error"] for r in sinks.first_rows(df, [F.desc("error")], 1).collect()] == [2.0]


def test_sample_actuals_stay_near(spark):
    wide = spark.createDataFrame([(f"T{i}", 100.0, 110.0) for i in range(50)], "ticker string, `2024-01-01` double, `2024-01-02` double")
    got = generators.sample_actuals(wide, ["2024-01-01", "2024-01-02"], spread=0.1)
    assert got.columns == ["ticker", "2024-01-01", "2024-01-02", "change", "change_pct"]
    rows = got.collect()
    assert all(95 <= r[1] <= 105 and 104.5 <= r[2] <= 115.5 and abs(r[3] - (r[2] - r[1])) < 0.011 for r in rows) and len({r[1] for r in rows}) > 20
    assert [tuple(r) for r in generators.sample_actuals(wide, ["2024-01-01", "2024-01-02"], spread=0.1).collect()] == [tuple(r) for r in rows]


def test_zipf_halving_finds_the_first_step(spark):
    rows = spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u"))
    got = {r["u"]: int(r["item"][-5:]) for r in generators.zipf_items(rows, F.col("u"), 37, 1.1).collect()}
    weights = [1 / i**1.1 for i in range(1, 38)]
    for u, item in got.items():
        steps = [sum(weights[:i]) / sum(weights) for i in range(1, 38)]
        assert item == next(i for i, c in enumerate(steps, 1) if c + 1e-12 >= u)


def test_building(spark):
    g = G.building(spark, n_events=40)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    edges = [tuple(r)[:5] for r in g.edges.orderBy("timestamp").collect()]
    assert {n for n, r in nodes.items() if r["node_type"] == "room"} == set(G.ROOMS) and nodes["motion_lobby"]["attributes"]["room"] == "lobby"
    assert sum(r["node_type"] == "event" and i.startswith("evt_motion") for i, r in nodes.items()) == 40
    assert all(s in nodes and t in nodes for s, t, *_ in edges) and nodes["motion_kitchen"]["node_type"] == "unknown"
    kinds = {k: sum(e[2] == k for e in edges) for k in ("before", "isa", "spatial:near", "enables")}
    moves = sum(G.ROUND[(i - 1) % 7] != G.ROUND[i % 7] for i in range(1, 40))
    assert kinds == {"before": 39, "isa": 7, "spatial:near": 7, "enables": 40 + 2 * moves}
    times = sorted(r["first_seen"] for i, r in nodes.items() if i.startswith("evt_motion"))
    assert all(30 <= b - a <= 180 for a, b in zip(times, times[1:], strict=False))
    again = G.building(spark, n_events=40).edges.orderBy("timestamp")
    assert sorted(tuple(r)[:5] for r in again.collect()) == sorted(edges)
    assert tuple(g.time_range().first()) == (1_000_000.0, max(r["last_seen"] for r in nodes.values()))


def test_trajectory_contract(spark):
    g = G.building(spark, n_events=3)
    steps = G.steps_of(spark, ["lobby", "kitchen"], [1.0, 31.0])
    assert [r["node_type"] for r in g.trajectory(steps).orderBy("position").collect()] == ["room", "room"]
    assert tuple(G.trajectory_size(steps).first()) == (2, 30.0) and tuple(G.trajectory_size(steps.limit(0)).first()) == (0, 0.0)
    with pytest.raises(ValueError):
        G.steps_of(spark, ["lobby"], [])
    with pytest.raises(Exception, match="no node attic"):
        g.trajectory(G.steps_of(spark, ["attic"], [1.0])).collect()


def test_z_peek_leaves_the_state(spark):
    state = spark.createDataFrame([(10.0, 2.0, 14.0), (10.0, 0.0, 14.0), (None, None, 14.0)], "ema double, ema_std double, v double")
    assert [r[0] for r in state.select(X.z_peek(F.col("v"))).collect()] == [2.0, 0.0, 0.0]


def test_fixpoint_is_whole_or_an_error(spark):
    kb = LogicEngine(spark)
    kb.load("parent", spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)]))
    kb.tell("over(?X, ?Y) :- parent(?X, ?Y)")
    kb.tell("over(?X, ?Z) :- parent(?X, ?Y), over(?Y, ?Z)")
    assert kb.ask("over(?X, ?Z)", limit=None).count() == 210  # 20 rounds, written together after 16
    with pytest.raises(RuntimeError):
        kb.saturate("over", max_rounds=2)


def test_facts_without_arguments(spark):
    kb = LogicEngine(spark)
    kb.tell("raining")
    kb.tell("wet(?X) :- street(?X), raining")
    kb.tell("dry(?X) :- street(?X), not raining")
    kb.tell("street(main)")
    kb.tell("alarm :- wet(main)")
    assert kb.proves("raining") and kb.proves("alarm") and not kb.proves("snowing")
    assert [r["X"] for r in kb.ask("wet(?X)").collect()] == ["main"] and kb.ask("dry(?X)").count() == 0


def test_routes(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    index = Ontology(rows([("human", 1, "is human"), ("parent", 2, None)], "name string, arity int, label string"), rows([("Dog", "Mammal"), ("Mammal", "Animal")], "sub string, sup string"), rows([("rex", "Dog")], "ind string, coll string"))
    service = LogicService(spark, index)
    call = lambda m, p, v=None: service.handle(m, p, v)
    assert call("POST", "/fact", {"fact": "human(socrates)"}) == (200, {"status": "fact added", "fact": "human(socrates)"})
    assert call("POST", "/rule", {"rule": "mortal(?X) :- human(?X)"})[1]["status"] == "rule added"
    assert call("POST", "/clause", {"clause": "human(plato)"})[1]["status"] == "fact added"
    status, answer = call("POST", "/query", {"query": "mortal(?X)"})
    assert status == 200 and answer["proved"] and sorted(a["X"] for a in answer["answers"]) == ["plato", "socrates"] and answer["answer_count"] == 2 and "warnings" not in answer
    assert call("POST", "/query", {"query": "mortal(?X)", "max_solutions": 1})[1]["answer_count"] == 1
    assert call("POST", "/query", {"query": "human(a, b)"})[1]["warnings"] and not call("POST", "/query", {"query": "mortal(zeus)"})[1]["proved"]
    assert call("POST", "/forward")[1]["new_facts_derived"] == 2
    assert call("GET", "/facts", {"predicate": "human"})[1] == {"facts": ["human(socrates)", "human(plato)"], "count": 2}
    assert call("GET", "/rules")[1]["rules"] == ["mortal(?X) :- human(?X)"] and call("GET", "/stats")[1]["total"] == 3
    assert call("GET", "/ontology/stats")[1] == {"predicates": 2, "concepts": 2, "individuals": 1}
    assert call("GET", "/ontology/predicate/human")[1]["arity"] == 1 and call("GET", "/ontology/predicate/none")[0] == 404
    assert call("GET", "/ontology/search", {"q": "HUM"})[1]["count"] == 1
    assert call("POST", "/ontology/genls", {"concept": "Dog"})[1]["superclasses"] == ["Animal", "Mammal"]
    assert call("POST", "/ontology/genls", {"concept": "Dog", "depth": 1})[1]["superclasses"] == ["Mammal"]
    assert call("POST", "/ontology/genls", {"superclass": "Animal"})[1]["subclasses"] == ["Dog", "Mammal"]
    assert call("POST", "/ontology/isa", {"individual": "rex"})[1] == {"individual": "rex", "direct_types": ["Dog"], "all_types": ["Animal", "Dog", "Mammal"]}
    assert call("POST", "/ontology/isa", {"individual": "rex", "collection": "Animal"})[1]["result"] and call("POST", "/ontology/isa", {"collection": "Mammal"})[1]["instances"] == ["rex"]
    assert call("GET", "/health")[1]["status"] == "ok" and call("GET", "/nowhere")[0] == 404
    for path, values in (("/fact", {}), ("/fact", {"fact": "a(?X) :- b(?X)"}), ("/fact", {"fact": "a(?X)"}), ("/rule", {"rule": "a(b)"}), ("/query", {"query": "broken(("}), ("/query", {"query": "a(?X)", "max_solutions": "x"}), ("/ontology/genls", {}), ("/ontology/isa", {})):
        assert call("POST", path, values)[0] == 400, (path, values)
    assert call("GET", "/ontology/search", {})[0] == 400
    assert call("POST", "/reset")[1] == {"status": "kb reset"} and call("GET", "/stats")[1]["total"] == 0
    sent = []
    body = json.dumps({"fact": "human(zeno)"}).encode()
    answer = service.wsgi({"REQUEST_METHOD": "POST", "PATH_INFO": "/fact", "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda s, h: sent.append(s))
    assert sent == ["200 OK"] and json.loads(answer[0])["fact"] == "human(zeno)"
    assert json.loads(service.wsgi({"REQUEST_METHOD": "GET", "PATH_INFO": "/facts", "QUERY_STRING": "predicate=human"}, lambda s, h: None)[0])["count"] == 1
