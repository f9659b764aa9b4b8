"""Queries of the logic layer and of the ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from .logic import LogicEngine, Ontology


def _engine(spark: SparkSession, sf_dir: str) -> LogicEngine:
    kb = LogicEngine(spark)
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    kb.load("customer_of", c.select("c_custkey", "c_nationkey")).load("segment", c.select("c_custkey", "c_mktsegment"))
    kb.load("nation_in", n.select("n_nationkey", "n_regionkey")).load("region_name", r.select("r_regionkey", "r_name"))
    return kb


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS \"X\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def fol_mortal_rule(spark, sf_dir):
    kb = _engine(spark, sf_dir)
    kb.tell("in_region(?X, ?R) :- customer_of(?X, ?N), nation_in(?N, ?R)")
    return kb.ask("in_region(?X, 1)", limit=None)


@query("""SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS "X", r_name AS "R" FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'""")
def fol_conjunction(spark, sf_dir):
    kb = _engine(spark, sf_dir)
    kb.tell("in_region(?X, ?R) :- customer_of(?X, ?N), nation_in(?N, ?R)")
    kb.tell("builder(?X, ?R) :- segment(?X, BUILDING), in_region(?X, ?K), region_name(?K, ?R)")
    return kb.ask("builder(?X, ?R)", limit=None)


@query("""WITH RECURSIVE parent AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey >= 1),
ancestor AS (SELECT a, b FROM parent UNION SELECT p.a, t.b FROM parent p JOIN ancestor t ON p.b = t.a)
SELECT CAST(a AS VARCHAR) AS "X", CAST(b AS VARCHAR) AS "Z" FROM ancestor""")
def fol_ancestor_fixpoint(spark, sf_dir):
    kb = LogicEngine(spark)
    parts = table(spark, sf_dir, "part").filter("p_partkey >= 1")  # key 0 would be its own parent
    kb.load("parent", parts.select(F.floor(F.col("p_partkey") / 2).alias("a"), "p_partkey"))
    kb.tell("ancestor(?X, ?Z) :- parent(?X, ?Z)")
    kb.tell("ancestor(?X, ?Z) :- parent(?X, ?Y), ancestor(?Y, ?Z)")
    return kb.ask("ancestor(?X, ?Z)", limit=None)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "X" FROM customer WHERE c_mktsegment = 'BUILDING'
AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def fol_negation(spark, sf_dir):
    kb = _engine(spark, sf_dir)
    kb.load("ordered", table(spark, sf_dir, "orders").select("o_custkey").distinct())
    kb.tell("idle(?X) :- segment(?X, BUILDING), not ordered(?X)")
    return kb.ask("idle(?X)", limit=None)


@query("SELECT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1 AND n_regionkey = 99) AS proved_far, "
       "EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1) AS proved_known")
def fol_yes_no(spark, sf_dir):
    kb = _engine(spark, sf_dir)
    kb.tell("in_region(?X, ?R) :- customer_of(?X, ?N), nation_in(?N, ?R)")
    return spark.createDataFrame([(kb.proves("in_region(1, 99)"), kb.proves("in_region(1, ?R)"))], "proved_far boolean, proved_known boolean")


@query("""SELECT 'in_region' AS predicate, CAST(c_custkey AS VARCHAR) || ',' || CAST(n_regionkey AS VARCHAR) AS args
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def fol_forward_chain(spark, sf_dir):
    kb = _engine(spark, sf_dir)
    kb.tell("customer_of(?X, ?N) & nation_in(?N, ?R) -> in_region(?X, ?R)")
    return kb.forward()


def _ontology(spark: SparkSession, sf_dir: str) -> Ontology:
    """Nations lie in regions, sizes generalise to half the size; customers and parts are the individuals."""
    c, n, r, p = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "part"))
    size = lambda k: F.concat(F.lit("size-"), k.cast("string"))
    sizes = p.select(F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("k")).distinct()
    above = F.when(F.col("k") == 1, F.lit("World")).otherwise(size(F.floor(F.col("k") / 2)))
    genls = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("sub"), F.col("r_name").alias("sup"))
    genls = genls.unionByName(r.select(F.col("r_name").alias("sub"), F.lit("World").alias("sup"))).unionByName(sizes.select(size(F.col("k")).alias("sub"), above.alias("sup")))
    types = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("customer-"), "c_custkey").alias("ind"), F.col("n_name").alias("coll"))
    types = types.unionByName(p.select(F.concat(F.lit("part-"), "p_partkey").alias("ind"), size(F.col("p_size")).alias("coll")))
    predicates = spark.createDataFrame([("genls", 2, "generalises"), ("isa", 2, "is an instance of"), ("arity", 2, "arity of"), ("comment", 2, None)], "name string, arity int, label string")
    return Ontology(predicates, genls, types)


_ONTO = """genls AS (
    SELECT n_name AS sub, r_name AS sup FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT r_name, 'World' FROM region
    UNION SELECT 'size-' || k, CASE WHEN k = 1 THEN 'World' ELSE 'size-' || (k // 2) END FROM (SELECT unnest(range(1, (SELECT max(p_size) + 1 FROM part))) AS k)
), up AS (SELECT sub, sup FROM genls UNION SELECT u.sub, g.sup FROM up u JOIN genls g ON u.sup = g.sub),
types AS (
    SELECT 'customer-' || c_custkey AS ind, n_name AS coll FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'part-' || p_partkey, 'size-' || p_size FROM part
), isa AS (SELECT ind, coll FROM types UNION SELECT ind, sup FROM types JOIN up ON coll = sub)"""


@query(f"WITH RECURSIVE {_ONTO} SELECT sub, sup FROM up WHERE sub <> sup")
def onto_all_genls(spark, sf_dir):
    return _ontology(spark, sf_dir).closure()


@query(f"WITH RECURSIVE {_ONTO} SELECT ind, coll FROM isa")
def onto_is_isa(spark, sf_dir):
    return _ontology(spark, sf_dir).isa_goal()


@query(f"WITH RECURSIVE {_ONTO} SELECT coll, count(*) AS n FROM isa GROUP BY coll")
def onto_instances(spark, sf_dir):
    return _ontology(spark, sf_dir).all_types().groupBy("coll").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_ONTO} SELECT sub, sup FROM up WHERE sup = 'size-2' UNION SELECT 'size-2', 'size-2'")
def onto_subclasses(spark, sf_dir):
    return _ontology(spark, sf_dir).genls_goal(sup="size-2")


@query("SELECT * FROM (VALUES ('genls', 2, NULL), ('isa', 3, 'isa expects 2 arguments, got 3'), ('unknown', 1, NULL)) v(name, n_args, error)")
def onto_arity(spark, sf_dir):
    atoms = spark.createDataFrame([("genls", 2), ("isa", 3), ("unknown", 1)], "name string, n_args int")
    return _ontology(spark, sf_dir).check_arity(atoms)


@query("SELECT * FROM (VALUES ('arity', 2)) v(name, arity)")
def onto_search(spark, sf_dir):
    return _ontology(spark, sf_dir).search("ARI", 10).select("name", "arity")


@query(f"""WITH RECURSIVE {_ONTO} SELECT 'predicates' AS name, 4 AS n UNION ALL SELECT 'concepts', count(DISTINCT sub) FROM genls
UNION ALL SELECT 'individuals', count(DISTINCT ind) FROM types""")
def onto_stats(spark, sf_dir):
    return _ontology(spark, sf_dir).stats()
