"""Queries of the maintained views and of the temporal graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as G
from ..operators import ivm
from ..registry import query, r4, table

# --- incrementally maintained views ---------------------------------------------


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their product, as (order, product, category, quantity, price)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.split("p_type", " ")[0].alias("category"), F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price")
    )
    return lines.join(parts, "l_partkey")


_SALES = """sales AS (
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS quantity, split_part(p_type, ' ', 1) AS category,
           CAST(p_retailprice AS DECIMAL(10, 2)) AS unit_price
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
_REVENUE = "quantity * unit_price"


def _report(view: DataFrame) -> DataFrame:
    revenue = F.col("revenue").cast("double")
    return view.select("category", F.col("n").alias("order_count"), r4(revenue).alias("revenue"), r4(revenue / F.col("n")).alias("avg_order"))


_BY_CATEGORY = """SELECT category, count(*) AS order_count, round(CAST(sum(quantity * unit_price) AS DOUBLE), 4) AS revenue,
round(CAST(sum(quantity * unit_price) AS DOUBLE) / count(*), 4) AS avg_order FROM {} GROUP BY category"""


def _view(rows: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    return ivm.view_of(ivm.signed(rows, deleted), ["category"], {"revenue": F.expr(_REVENUE)})


@query(f"WITH {_SALES} {_BY_CATEGORY.format('sales')}")
def ivm_revenue_by_category(spark, sf_dir):
    return _report(_view(_sales(spark, sf_dir)))


@query(f"""WITH {_SALES} SELECT l_partkey AS product, category, count(*) AS order_count, sum(quantity)::BIGINT AS units FROM sales
GROUP BY 1, 2 ORDER BY units DESC, product LIMIT 5""")
def ivm_top_products(spark, sf_dir):
    out = _sales(spark, sf_dir).groupBy(F.col("l_partkey").alias("product"), "category").agg(F.count(F.lit(1)).alias("order_count"), F.sum("quantity").alias("units"))
    return out.orderBy(F.desc("units"), "product").limit(5)


@query(f"WITH {_SALES} {_BY_CATEGORY.format('sales')}")
def ivm_delta_merge(spark, sf_dir):
    """The view of the even orders, then the odd ones as a change."""
    sales = _sales(spark, sf_dir)
    view = _view(sales.filter(F.col("l_orderkey") % 2 == 0))
    return _report(ivm.merge(view, _view(sales.filter(F.col("l_orderkey") % 2 == 1)), ["category"]))


@query(f"""WITH {_SALES}, repriced AS (SELECT * REPLACE (CASE WHEN l_partkey = 1 THEN CAST(unit_price * 2 AS DECIMAL(10, 2)) ELSE unit_price END AS unit_price) FROM sales)
{_BY_CATEGORY.format('repriced')}""")
def ivm_price_retraction(spark, sf_dir):
    """One product repriced: its old lines are retracted, the new ones inserted."""
    sales = _sales(spark, sf_dir)
    old = sales.filter("l_partkey = 1")
    new = old.withColumn("unit_price", (F.col("unit_price") * 2).cast("decimal(10,2)"))
    return _report(ivm.merge(_view(sales), _view(new, old), ["category"]))


@query(f"WITH {_SALES} SELECT sum(c)::BIGINT AS orders FROM (SELECT category, count(*) AS c FROM sales GROUP BY 1)")
def ivm_total_orders(spark, sf_dir):
    return _view(_sales(spark, sf_dir)).agg(F.sum("n").alias("orders"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def upsert_on_conflict(spark, sf_dir):
    """Half of the parts, then all of them twice: known keys are ignored."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    again = parts.unionByName(parts)
    return ivm.insert_ignore(parts.filter("p_partkey % 2 = 0"), again, "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'changed' ELSE p_brand END AS p_brand FROM part")
def delete_insert_update(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return ivm.replace_rows(parts, parts.filter("p_partkey % 10 = 0").withColumn("p_brand", F.lit("changed")), "p_partkey")


# --- graph -------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> G.TemporalGraph:
    """Users, events and days of all events."""
    e = table(spark, sf_dir, "events")
    t = (F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0).alias("t")
    day = F.concat(F.lit("d"), F.date_format("ts", "yyyy-MM-dd")).alias("day")
    e = e.select("event_id", "user_id", "event_type", t, day)
    after = Window.partitionBy("user_id").orderBy("t", "event_id")
    same = Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")
    e = e.withColumn("next_id", F.lead("event_id").over(after)).withColumn("next_same", F.lead("event_id").over(same))
    event = lambda c: F.concat(F.lit("e"), F.col(c))
    user = F.concat(F.lit("u"), "user_id")
    inf = F.lit(float("inf"))

    def edge(source, target, kind, when):
        return e.filter(when).select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"), F.col("t").alias("timestamp"), F.col("t").alias("valid_from"), inf.alias("valid_to"))

    edges = edge(user, event("event_id"), "enables", F.lit(True))
    edges = edges.unionByName(edge(event("event_id"), event("next_id"), "before", F.col("next_id").isNotNull()))
    edges = edges.unionByName(edge(event("event_id"), event("next_same"), "causes", (F.col("event_type") == "error") & F.col("next_same").isNotNull()))
    no_vector, no_map = F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("map<string,string>").alias("attributes")
    seen = e.select(user.alias("id"), F.lit("user").alias("node_type"), F.col("t").alias("ts"), no_vector, F.create_map(F.lit("last_event"), F.col("event_type")).alias("attributes"))
    seen = seen.unionByName(e.select(event("event_id").alias("id"), F.col("event_type").alias("node_type"), F.col("t").alias("ts"), no_vector, no_map))
    seen = seen.unionByName(e.select(F.col("day").alias("id"), F.lit("day").alias("node_type"), F.col("t").alias("ts"), no_vector, no_map))
    return G.TemporalGraph(G.upsert_nodes(G.with_endpoints(seen, edges)), edges)


_GRAPH = """
e AS (
    SELECT event_id, user_id, event_type, strftime(ts, 'd%Y-%m-%d') AS day, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS t, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id,
           lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_same
    FROM events
), edges AS (
    SELECT 'u' || user_id AS source, 'e' || event_id AS target, 'enables' AS edge_type, t FROM e
    UNION ALL SELECT 'e' || event_id, 'e' || next_id, 'before', t FROM e WHERE next_id IS NOT NULL
    UNION ALL SELECT 'e' || event_id, 'e' || next_same, 'causes', t FROM e WHERE event_type = 'error' AND next_same IS NOT NULL
), seen AS (
    SELECT 'u' || user_id AS id, 'user' AS node_type, t FROM e UNION ALL SELECT 'e' || event_id, event_type, t FROM e UNION ALL SELECT day, 'day', t FROM e
), types AS (SELECT id, any_value(node_type) AS node_type FROM seen GROUP BY id),
touches AS (SELECT id, t FROM seen UNION ALL SELECT source, t FROM edges UNION ALL SELECT target, t FROM edges),
nodes AS (SELECT t.id, any_value(y.node_type) AS node_type, min(t) AS first_seen, max(t) AS last_seen FROM touches t JOIN types y ON t.id = y.id GROUP BY t.id)"""
MID = 1705276800.0  # 2024-01-15


@query(f"""WITH {_GRAPH} SELECT n.id, n.node_type, round(first_seen, 3) AS first_seen, round(last_seen, 3) AS last_seen,
(SELECT arg_max(event_type, t) FROM e WHERE n.id = 'u' || e.user_id) AS last_event FROM nodes n""")
def graph_nodes_upsert(spark, sf_dir):
    nodes = _graph(spark, sf_dir).nodes
    return nodes.select("id", "node_type", F.round("first_seen", 3).alias("first_seen"), F.round("last_seen", 3).alias("last_seen"), F.try_element_at("attributes", F.lit("last_event")).alias("last_event"))


@query(f"""WITH {_GRAPH} SELECT format('{{}}→{{}}→{{}}@{{:.3f}}', source, edge_type, target, t) AS edge_id,
CASE WHEN edge_type = 'before' THEN 'temporal' ELSE 'causal' END AS family FROM edges""")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges.select(G.edge_id().alias("edge_id"), G.family().alias("family"))


@query(f"""WITH {_GRAPH} SELECT 'node' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY 2
UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'nodes', 'with_embedding', 0""")
def graph_stats(spark, sf_dir):
    return _graph(spark, sf_dir).stats()


@query(f"""WITH {_GRAPH}, active AS (SELECT id FROM nodes WHERE first_seen <= {MID} AND last_seen >= {MID})
SELECT 'node' AS kind, id AS a, '' AS b, '' AS edge_type FROM active
UNION ALL SELECT 'edge', source, target, edge_type FROM edges WHERE t <= {MID} AND source IN (FROM active) AND target IN (FROM active)""")
def graph_snapshot(spark, sf_dir):
    s = _graph(spark, sf_dir).snapshot(MID)
    none = F.lit("")
    nodes = s.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), none.alias("b"), none.alias("edge_type"))
    return nodes.unionByName(s.edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "edge_type"))


@query(f"WITH {_GRAPH} SELECT source, target, round(t, 3) AS t FROM edges WHERE edge_type = 'causes' AND t <= {MID}")
def graph_get_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges_where(edge_type="causes", at=MID).select("source", "target", F.round("timestamp", 3).alias("t"))


@query(f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes WHERE id <> 'u1') AS nodes, (SELECT count(*) FROM edges WHERE source <> 'u1' AND target <> 'u1') AS edges""")
def graph_remove_node(spark, sf_dir):
    g = _graph(spark, sf_dir).remove_node("u1")
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query(f"""WITH {_GRAPH} SELECT id, round(first_seen, 3) AS first_seen FROM nodes WHERE node_type = 'error' AND contains(id, 'e1') ORDER BY nodes.first_seen, id LIMIT 6""")
def graph_first_seen(spark, sf_dir):
    named = _graph(spark, sf_dir).nodes.filter((F.col("node_type") == "error") & F.col("id").contains("e1"))
    return named.orderBy("first_seen", "id").limit(6).select("id", F.round("first_seen", 3).alias("first_seen"))


def _hops_sql(hops: int) -> str:
    return f"""WITH RECURSIVE {_GRAPH}, near AS (SELECT DISTINCT source, target FROM edges WHERE abs(t - {MID}) <= 864000),
walk AS (SELECT id, 0 AS hop FROM nodes WHERE id = 'u1' UNION SELECT near.target, hop + 1 FROM walk JOIN near ON near.source = walk.id WHERE hop < {hops})
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY id HAVING min(hop) > 0"""


@query(_hops_sql(3))
def graph_k_hop(spark, sf_dir):
    return _graph(spark, sf_dir).neighbors("u1", MID, 864000.0, 3)


@query(_hops_sql(1))
def graph_k_hop_strict(spark, sf_dir):
    return _graph(spark, sf_dir).neighbors("u1", MID, 864000.0, 3, strict=True)


@query(f"""WITH RECURSIVE {_GRAPH}, step AS (SELECT source AS a, target AS b FROM edges WHERE edge_type IN ('causes', 'enables', 'prevents')),
walk AS (
    SELECT [id] AS path, id AS last FROM nodes WHERE node_type = 'user'
    UNION ALL
    SELECT list_append(path, b), b FROM walk JOIN step ON a = last WHERE len(path) <= 4 AND NOT list_contains(path, b)
)
SELECT array_to_string(path, '>') AS path FROM walk WHERE len(path) > 1 AND (len(path) = 5 OR last NOT IN (SELECT a FROM step))""")
def causal_chain(spark, sf_dir):
    g = _graph(spark, sf_dir)
    starts = g.nodes.filter("node_type = 'user'")
    return g.causal_chains(starts, max_depth=4).select(F.array_join("path", ">").alias("path"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT CAST(vec_id AS VARCHAR) AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q WHERE label = 1 ORDER BY score DESC, id LIMIT 10""")
def semantic_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("node_type"), "embedding", F.lit(0.0).alias("first_seen"), F.lit(0.0).alias("last_seen"))
    # The query vector is one row, read once: a parameter of the search.
    vector = vectors.filter("id = '0'").select("embedding").first()[0]
    found = G.TemporalGraph(vectors, None).semantic_search(F.array(*[F.lit(float(x)) for x in vector]), 10, node_type="1")
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_GRAPH}, steps AS (SELECT row_number() OVER (ORDER BY t, event_id) AS position, 'e' || event_id AS id, t FROM e WHERE user_id = 1 QUALIFY position <= 10)
SELECT CAST(s.position AS INTEGER) AS position, s.id, n.node_type, coalesce((SELECT string_agg(x.edge_type || ':' || x.target, ',' ORDER BY x.edge_type || ':' || x.target) FROM edges x WHERE x.source = s.id AND x.t <= s.t), '') AS out_edges
FROM steps s JOIN nodes n ON s.id = n.id""")
def trajectory(spark, sf_dir):
    g = _graph(spark, sf_dir)
    mine = g.edges.filter("source = 'u1' AND edge_type = 'enables'")
    order = Window.orderBy("timestamp", F.substring("target", 2, 20).cast("long"))
    steps = mine.orderBy("timestamp", F.substring("target", 2, 20).cast("long")).limit(10)  # the first ten of one user
    steps = steps.select(F.row_number().over(order).alias("position"), F.col("target").alias("id"), F.col("timestamp").alias("ts"))
    return g.trajectory(steps).select("position", "id", "node_type", F.array_join("out_edges", ",").alias("out_edges"))


@query("SELECT CAST(x AS VARCHAR) AS item, round((('0x' || sha256(CAST(x AS VARCHAR))[1:4])::INT / 65535.0) * 2 - 1, 6) AS first_value FROM (SELECT DISTINCT user_id AS x FROM events)")
def hash_embedding(spark, sf_dir):
    from ..functions.scalars import hash_embedding as embed

    items = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item")).distinct()
    return items.select("item", F.round(embed(F.col("item"), 16)[0], 6).alias("first_value"))
