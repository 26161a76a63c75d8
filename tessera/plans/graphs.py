"""Graph queries on region, nation, customer, supplier and orders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import quality
from tessera.plans.registry import Tables, query


def _edges(t: Tables) -> DataFrame:
    return G.union([
        G.edges(t.nation, F.concat(F.lit("region:"), F.col("n_regionkey")), F.concat(F.lit("nation:"), F.col("n_nationkey")), "CONTAINS_NATION"),
        G.edges(t.supplier, F.concat(F.lit("nation:"), F.col("s_nationkey")), F.concat(F.lit("supplier:"), F.col("s_suppkey")), "CONTAINS_SUPPLIER"),
        G.edges(t.customer, F.concat(F.lit("nation:"), F.col("c_nationkey")), F.concat(F.lit("customer:"), F.col("c_custkey")), "CONTAINS_CUSTOMER"),
        G.edges(t.orders, F.concat(F.lit("customer:"), F.col("o_custkey")), F.concat(F.lit("order:"), F.col("o_orderkey")), "PLACED"),
    ])


_EDGES = """e AS (SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'CONTAINS_NATION' AS type FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS_SUPPLIER' FROM supplier
 UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS_CUSTOMER' FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'PLACED' FROM orders)"""
_BOTH = _EDGES + ", u AS (SELECT source AS node, target AS neighbor, type FROM e UNION SELECT target, source, type FROM e)"


@query("""SELECT 'region:' || r_regionkey AS node_id, 'region' AS rank, r_name AS name FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier""")
def hierarchy_nodes(t: Tables) -> DataFrame:
    return G.hierarchy([("region", t.region, "r_regionkey", "r_name", None, None), ("nation", t.nation, "n_nationkey", "n_name", "region", "n_regionkey"), ("supplier", t.supplier, "s_suppkey", "s_name", "nation", "s_nationkey")])[0]


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN c_custkey IS NULL THEN 'no customer' END, CASE WHEN n_nationkey IS NULL THEN 'no nation' END, CASE WHEN r_regionkey IS NULL OR r_regionkey = 3 THEN 'no region' END], lambda x: x IS NOT NULL), ';') AS messages
 FROM orders LEFT JOIN (FROM customer WHERE c_acctbal > -500) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def hierarchy_chain_check(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.where("c_acctbal > -500"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    out = G.chain_messages(rows, [("no customer", F.col("c_custkey").isNotNull()), ("no nation", F.col("n_nationkey").isNotNull()), ("no region", F.col("r_regionkey").isNotNull() & (F.col("r_regionkey") != 3))])
    return out.select("o_orderkey", F.array_join("messages", ";").alias("messages"))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT 'region:2' AS node_id, 0 AS depth UNION ALL SELECT target, depth + 1 FROM b JOIN e ON source = node_id WHERE depth < 3) SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY 1""")
def bfs_subtree(t: Tables) -> DataFrame:
    return G.subtree(_edges(t), t.region.where("r_regionkey = 2").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("node_id")), 3)


@query("""SELECT 'customer:' || c_custkey AS node_id, 'Customer' AS label, to_json(map_from_entries(list_filter([('c_acctbal', CAST(c_acctbal AS VARCHAR)), ('c_mktsegment', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END), ('c_name', c_name)], lambda x: x[2] <> ''))) AS properties FROM customer
 UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', to_json(map_from_entries([('n_name', n_name)])) FROM nation""")
def graph_nodes_properties(t: Tables) -> DataFrame:
    c = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment")))
    rows = G.nodes(c, F.concat(F.lit("customer:"), F.col("c_custkey")), "Customer", "c_acctbal", "c_mktsegment", "c_name").unionByName(G.nodes(t.nation, F.concat(F.lit("nation:"), F.col("n_nationkey")), "Nation", "n_name"))
    return rows.select("node_id", F.col("labels")[0].alias("label"), F.to_json("properties").alias("properties"))


@query(f"""WITH {_BOTH}, n AS (SELECT 'customer:' || c_custkey AS node_id, 'Customer' AS name FROM customer UNION ALL SELECT 'part:' || p_partkey, 'Part' FROM part)
 SELECT 'node' AS kind, name, count(*) AS n, CAST(round(avg(CASE WHEN d.node IS NULL THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS orphan_ratio FROM n LEFT JOIN (SELECT DISTINCT node FROM u) d ON node = node_id GROUP BY name UNION ALL SELECT 'edge', type, count(*), NULL FROM e GROUP BY type""")
def graph_type_counts(t: Tables) -> DataFrame:
    n = G.nodes(t.customer, F.concat(F.lit("customer:"), F.col("c_custkey")), "Customer", "c_name").unionByName(G.nodes(t.part, F.concat(F.lit("part:"), F.col("p_partkey")), "Part", "p_name"))
    return G.type_counts(n, _edges(t))


@query(f"""WITH {_BOTH} SELECT u.* FROM u WHERE node IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1)""")
def one_hop_neighbors(t: Tables) -> DataFrame:
    return G.neighbors(_edges(t), t.nation.where("n_regionkey = 1").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("node")))


@query(f"""WITH {_BOTH} SELECT DISTINCT a.node, a.neighbor AS first, b.neighbor AS second FROM u a LEFT JOIN u b ON b.node = a.neighbor WHERE a.node IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey < 20) AND (b.neighbor IS NULL OR b.neighbor <> a.node)""")
def two_hop_neighbors(t: Tables) -> DataFrame:
    return G.two_hops(_edges(t), t.supplier.where("s_suppkey < 20").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("node")))


@query(f"WITH {_BOTH} SELECT node, count(*) AS degree FROM u GROUP BY 1")
def neighbor_degrees(t: Tables) -> DataFrame:
    return G.degrees(_edges(t))


@query("""WITH b AS (SELECT c_custkey, count(DISTINCT o_orderkey) AS facts, count(l_orderkey) AS links, count(*) FILTER (l_returnflag = 'R') AS returned FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
 SELECT *, CASE WHEN facts > 18 OR links > 80 THEN 'fail' WHEN facts > 14 OR links > 60 THEN 'warn' ELSE 'ok' END AS level FROM b""")
def graph_budget(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("links"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    per_order = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey").agg(F.count("o_orderkey").alias("facts"), F.sum("links").alias("links"), F.sum("returned").alias("returned"))
    rows = t.customer.join(per_order, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("facts", "links", "returned")))
    return G.budget(rows, {"facts": (14, 18), "links": (60, 80)})


@query(f"""WITH {_EDGES} SELECT source, target, type FROM e QUALIFY row_number() OVER (PARTITION BY source, type ORDER BY target) <= 5""")
def subtree_limits(t: Tables) -> DataFrame:
    return G.limited_children(_edges(t), 5, F.col("target"))


@query("""SELECT '"region:' || n_regionkey || '" -> "nation:' || n_nationkey || '" [label="CONTAINS_NATION"];' AS value FROM nation""")
def dot_export(t: Tables) -> DataFrame:
    return G.dot(G.edges(t.nation, F.concat(F.lit("region:"), F.col("n_regionkey")), F.concat(F.lit("nation:"), F.col("n_nationkey")), "CONTAINS_NATION"))


@query("""SELECT 'c_custkey' AS "check", CAST(0 AS BIGINT) AS failures UNION ALL SELECT 'positive', count(*) FILTER (c_acctbal <= 0) FROM customer UNION ALL SELECT 'segment', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer""")
def rule_checks(t: Tables) -> DataFrame:
    return quality.counts(t.customer, {"c_custkey": F.col("c_custkey").isNotNull(), "positive": F.col("c_acctbal") > 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})


@query("""SELECT false AS ready, 'positive,segment' AS blocking""")
def readiness(t: Tables) -> DataFrame:
    return quality.readiness(rule_checks(t)).withColumn("blocking", F.array_join("blocking", ","))


@query("""SELECT s AS shard, coalesce(rows, 0) AS rows, coalesce(done, 0) AS done, CASE WHEN rows IS NULL THEN 'missing' WHEN done = 0 THEN 'empty' WHEN done < rows THEN 'partial' ELSE 'completed' END AS status FROM range(30) r(s) LEFT JOIN
 (SELECT c_nationkey, count(*) AS rows, count(*) FILTER (c_acctbal > -900) AS done FROM customer GROUP BY 1) ON c_nationkey = s""")
def shard_coverage(t: Tables) -> DataFrame:
    return quality.shard_coverage(t.customer, "c_nationkey", 30, F.col("c_acctbal") > -900)


@query("""SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1""")
def duplicate_key_groups(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.supplier, ["s_nationkey"])
