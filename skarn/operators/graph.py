"""A temporal graph over two DataFrames: nodes and edges with validity intervals.

Nodes: id, node_type, embedding, first_seen, last_seen, attributes.  Edges:
source, target, edge_type, weight, timestamp, valid_from, valid_to (closed).
Traversals expand a frontier by joins, one a hop, and depth is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash_embedding
from ..lineage import cut
from .windows import in_parts

#: Edge types by family.  Fixed values.
TEMPORAL = ["before", "after", "during", "overlaps"]
CAUSAL = ["causes", "enables", "prevents"]
SEMANTIC = ["is_a", "part_of", "related_to", "similar_to"]


def family(edge_type: str = "edge_type") -> Column:
    c = F.col(edge_type)
    return F.when(c.isin(CAUSAL), "causal").when(c.isin(TEMPORAL), "temporal").when(c.isin(SEMANTIC), "semantic").otherwise("unknown")


def edge_id() -> Column:
    return F.format_string("%s→%s→%s@%.3f", "source", "edge_type", "target", "timestamp")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(total(a, b) / norm)


def upsert_nodes(observed: DataFrame) -> DataFrame:
    """Observations (id, node_type, ts, embedding, attributes) folded into nodes.

    The seen range widens, the first type stays, the last embedding given and the
    last value of each attribute win; of two at one time the larger value counts as
    the later one.
    """
    base = observed.groupBy("id").agg(
        F.min_by("node_type", F.struct("ts", "node_type")).alias("node_type"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.struct("ts", "embedding"))).alias("embedding"),
    )
    pairs = observed.filter(F.col("attributes").isNotNull()).select("id", "ts", F.explode("attributes").alias("k", "v"))
    last = pairs.groupBy("id", "k").agg(F.max_by("v", F.struct("ts", "v")).alias("v"))
    attributes = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    return base.join(attributes, "id", "left")


def with_endpoints(observed: DataFrame, edges: DataFrame) -> DataFrame:
    """Observations and the touches of both ends of every edge, unknown ends included."""
    ends = F.explode(F.array("source", "target")).alias("id")
    touched = edges.select(ends, F.lit("unknown").alias("node_type"), F.col("timestamp").alias("ts"))
    known = observed.groupBy("id").agg(F.min_by("node_type", F.struct("ts", "node_type")).alias("__type"))
    typed = touched.join(known, "id", "left").withColumn("node_type", F.coalesce("__type", "node_type")).drop("__type")
    return observed.unionByName(typed, allowMissingColumns=True)


@dataclass
class TemporalGraph:
    nodes: DataFrame
    edges: DataFrame

    def edges_where(self, *, source=None, target=None, edge_type=None, at=None) -> DataFrame:
        out = self.edges
        for name, value in (("source", source), ("target", target), ("edge_type", edge_type)):
            if value is not None:
                out = out.filter(F.col(name) == value)
        return out if at is None else out.filter((F.col("valid_from") <= at) & (F.col("valid_to") >= at))

    def remove_node(self, node: str) -> TemporalGraph:
        return TemporalGraph(self.nodes.filter(F.col("id") != node), self.edges.filter((F.col("source") != node) & (F.col("target") != node)))

    def snapshot(self, at) -> TemporalGraph:
        """Active nodes, and valid edges with both ends active."""
        nodes = self.nodes.filter((F.col("first_seen") <= at) & (F.col("last_seen") >= at))
        ids = nodes.select("id")
        edges = self.edges_where(at=at).join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        return TemporalGraph(nodes, edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))

    def neighbors(self, start: str, at, radius, hops: int, edge_types: list[str] | None = None, *, strict: bool = False) -> DataFrame:
        """(id, hop) within ``hops`` of edges whose time is at most ``radius`` off.

        ``strict``: one hop, whatever ``hops`` is.
        """
        near = self.edges.filter(F.abs(F.col("timestamp") - at) <= radius)
        near = near.filter(F.col("edge_type").isin(edge_types)) if edge_types else near
        near = cut(near.select("source", "target").distinct())
        visited = self.nodes.filter(F.col("id") == start).select("id", F.lit(0).alias("hop"))
        for hop in range(1, (1 if strict else hops) + 1):
            frontier = visited.filter(F.col("hop") == hop - 1).select(F.col("id").alias("source"))
            found = near.join(frontier, "source", "left_semi").select(F.col("target").alias("id")).distinct()
            visited = cut(visited.unionByName(found.join(visited.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))))
        return visited.filter("hop > 0")

    def causal_chains(self, starts: DataFrame, *, forward: bool = True, max_depth: int = 6) -> DataFrame:
        """path (array): simple paths over causal edges, cut at a leaf or at ``max_depth``."""
        a, b = ("source", "target") if forward else ("target", "source")
        step = self.edges.filter(F.col("edge_type").isin(CAUSAL)).select(F.col(a).alias("__from"), F.col(b).alias("__to"))
        leaves = step.select(F.col("__from").alias("end")).distinct()
        paths = starts.select(F.array("id").alias("path"), F.col("id").alias("end"))
        done = None
        for depth in range(1, max_depth + 1):
            grown = paths.join(step, paths["end"] == step["__from"]).filter(~F.array_contains("path", F.col("__to")))
            paths = grown.select(F.concat("path", F.array("__to")).alias("path"), F.col("__to").alias("end"))
            ended = paths if depth == max_depth else paths.join(leaves, "end", "left_anti")
            done = ended.select("path") if done is None else done.unionByName(ended.select("path"))
        return done

    def semantic_search(self, vector: Column, k: int, *, at=None, node_type: str | None = None) -> DataFrame:
        """The k nodes of the highest cosine, ties by id; nodes without embedding are left out."""
        rows = self.nodes.filter(F.col("embedding").isNotNull())
        rows = rows if at is None else rows.filter((F.col("first_seen") <= at) & (F.col("last_seen") >= at))
        rows = rows if node_type is None else rows.filter(F.col("node_type") == node_type)
        return rows.select("id", cosine(F.col("embedding"), vector).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def trajectory(self, steps: DataFrame) -> DataFrame:
        """Steps (position, id, ts) with node_type and the out-edges valid at ts, in order.

        A step at a node that is not in the graph is an error.
        """
        nodes = self.nodes.select("id", "node_type", F.col("embedding").isNotNull().alias("has_embedding"), F.lit(True).alias("__known"))
        placed = steps.join(nodes, "id", "left")
        unknown = F.raise_error(F.concat(F.lit("no node "), F.col("id").cast("string")))
        placed = placed.withColumn("node_type", F.when(F.col("__known"), F.col("node_type")).otherwise(unknown.cast("string"))).drop("__known")
        out = F.col("source") == F.col("id")
        valid = (F.col("valid_from") <= F.col("ts")) & (F.col("valid_to") >= F.col("ts"))
        joined = placed.join(self.edges, out & valid, "left")
        targets = F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.concat_ws(":", "edge_type", "target"))))
        return joined.groupBy("position", "id", "ts", "node_type", "has_embedding").agg(targets.alias("out_edges"))

    def time_range(self) -> DataFrame:
        """One row: the first and the last time that a node was seen."""
        return self.nodes.agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    def stats(self) -> DataFrame:
        """(kind, name, n): nodes and edges by type, and nodes with an embedding."""
        n = F.count(F.lit(1)).alias("n")
        out = self.nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("name")).agg(n)
        out = out.unionByName(self.edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("name")).agg(n))
        embedded = self.nodes.agg(F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False))).alias("n"))
        return out.unionByName(embedded.select(F.lit("nodes").alias("kind"), F.lit("with_embedding").alias("name"), "n"))


def steps_of(spark, ids: list, times: list) -> DataFrame:
    """The steps (position, id, ts) of a trajectory; as many times as nodes are needed."""
    if len(ids) != len(times):
        raise ValueError(f"{len(ids)} nodes and {len(times)} times")
    return spark.createDataFrame([(n, i, float(t)) for n, (i, t) in enumerate(zip(ids, times, strict=True), 1)], "position int, id string, ts double")


def trajectory_size(steps: DataFrame) -> DataFrame:
    """One row: length (steps) and duration, 0 with fewer than two."""
    duration = F.coalesce(F.max("ts") - F.min("ts"), F.lit(0.0))
    return steps.agg(F.count(F.lit(1)).alias("length"), duration.alias("duration"))


#: A smart building: its rooms, its sensors (kind, room) and the round of one person.  Fixed values.
ROOMS = ["lobby", "corridor_A", "office_101", "kitchen", "server_room"]
SENSORS = {
    "motion_lobby": ("motion", "lobby"),
    "motion_corr_A": ("motion", "corridor_A"),
    "motion_office": ("motion", "office_101"),
    "door_lobby": ("contact", "lobby"),
    "door_office": ("contact", "office_101"),
    "hvac_zone_A": ("hvac", "corridor_A"),
    "hvac_zone_B": ("hvac", "office_101"),
}
ROUND = ["lobby", "corridor_A", "office_101", "kitchen", "office_101", "corridor_A", "lobby"]


def building(spark, n_events: int = 40, start: float = 1_000_000.0, seed: int = 42) -> TemporalGraph:
    """The graph of a person's walk through the building, made of one range of steps.

    Steps are 30 to 180 s apart and heating answers four in ten of them where it is,
    both by a hash of seed and step, so any number of tasks gives the same graph.
    """
    u = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    route = F.array(*[F.lit(r) for r in ROUND])
    at = lambda i: F.get(route, F.pmod(i, F.lit(len(ROUND))).cast("int"))
    steps = spark.range(n_events).select("id", at(F.col("id")).alias("room"), F.when(F.col("id") > 0, at(F.col("id") - 1)).alias("before"), (30 + 150 * u(1)).alias("gap"), u(2).alias("heat"))
    placed = in_order_sum(steps, "id", "gap").withColumn("t", F.lit(start) + F.col("total"))
    of = lambda kind: F.create_map(*[F.lit(x) for s, (k, r) in SENSORS.items() if k == kind for x in (r, s)])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    step, room, before = F.col("id").cast("string"), F.col("room"), F.col("before")
    placed = placed.select("*", text("evt_motion_", room, "_", step).alias("motion"), F.coalesce(F.try_element_at(of("motion"), room), text("motion_", room)).alias("sensor"), F.try_element_at(of("hvac"), room).alias("hvac"))
    moved, heated = F.col("before").isNotNull() & (before != room), F.col("hvac").isNotNull() & (F.col("heat") > 0.6)
    door, warm = text("evt_door_open_", before, "_to_", room, "_", step), text("evt_hvac_", room, "_", step)
    t = F.col("t")

    def edge(source, target, kind: str, weight: float, when, time=t):
        return placed.filter(when).select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"), time.alias("timestamp"))

    always, motion = F.lit(True), F.col("motion")
    earlier = text("evt_motion_", before, "_", (F.col("id") - 1).cast("string"))
    made = [
        edge(F.col("sensor"), motion, "causes", 0.95, always),
        edge(F.lit("person_001"), motion, "enables", 0.8, always),
        edge(earlier, motion, "before", 1.0, before.isNotNull()),
        edge(motion, door, "enables", 0.85, moved),
        edge(door, room, "enables", 0.9, moved, t + 1),
        edge(motion, warm, "causes", 0.7, heated, t + 5),
        edge(F.col("hvac"), warm, "causes", 0.9, heated, t + 5),
    ]
    fixed = [(s, x, k, w, start) for s, (_, r) in SENSORS.items() for x, k, w in (("physical_device", "isa", 1.0), (r, "spatial:near", 0.9))]
    edges = reduce(DataFrame.unionByName, made, spark.createDataFrame(fixed, "source string, target string, edge_type string, weight double, timestamp double"))
    edges = edges.select("*", F.col("timestamp").alias("valid_from"), F.lit(float("inf")).alias("valid_to"))

    def event(name, action, when, time=t):
        facts = F.create_map(F.lit("room"), room, F.lit("action"), F.lit(action))
        return placed.filter(when).select(name.alias("id"), F.lit("event").alias("node_type"), time.alias("ts"), text("event:", action, ":", name).alias("__of"), facts.alias("attributes"))

    things = [(r, "room", f"room:{r}", {"building": "HQ", "floor": "1"}) for r in ROOMS] + [(s, "sensor", f"sensor:{s}:{k}", {"sensor_type": k, "room": r}) for s, (k, r) in SENSORS.items()]
    things += [("physical_device", "concept", "concept:physical_device", None), ("person_001", "agent", "agent:person_001", {"role": "employee", "badge": "P001"})]
    seen = spark.createDataFrame([(i, k, start, o, a) for i, k, o, a in things], "id string, node_type string, ts double, __of string, attributes map<string,string>")
    for rows in (event(motion, "motion", always), event(door, "open", moved), event(warm, "activate", heated, t + 5)):
        seen = seen.unionByName(rows)
    seen = seen.withColumn("embedding", hash_embedding(F.col("__of"), 16)).drop("__of")
    return TemporalGraph(upsert_nodes(with_endpoints(seen, edges)), edges)


def in_order_sum(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``rows`` with total, the sum of ``value`` up to the row; ranges, then a prefix over them."""
    parts = in_parts(rows, [F.col(order)])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__b").agg(F.sum(value).alias("__s"))  # a row a range
    sums = sums.select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s"))
    upto = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("__in", F.sum(value).over(upto)).join(sums, "__b")
    return out.withColumn("total", F.col("__in") + F.col("__s")).drop("__b", "__in", "__s")
