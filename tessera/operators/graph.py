"""Property graphs: nodes and edges, hierarchies, neighbours, budgets."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import shared_folder


def properties(*columns: str) -> Column:
    """Map of the non-empty columns as texts."""
    all_ = F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c).cast("string") for c in columns)))
    return F.map_filter(all_, lambda k, v: v.isNotNull() & (v != ""))


def nodes(df: DataFrame, id_: Column, label: str, *columns: str) -> DataFrame:
    return df.select(id_.alias("node_id"), F.array(F.lit(label)).alias("labels"), properties(*columns).alias("properties"))


def edges(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def hierarchy(parts: Sequence[tuple[str, DataFrame, str, str | None, str | None, str | None]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and CONTAINS edges of ranked tables: (rank, table, id, name, parent rank, parent id)."""
    ns, es = [], []
    for rank, df, id_, name, parent, parent_id in parts:
        own = F.concat_ws(":", F.lit(rank), F.col(id_).cast("string"))
        ns.append(df.select(own.alias("node_id"), F.lit(rank).alias("rank"), F.col(name or id_).cast("string").alias("name")))
        if parent:
            es.append(edges(df.where(F.col(parent_id).isNotNull()), F.concat_ws(":", F.lit(parent), F.col(parent_id).cast("string")), own, f"CONTAINS_{rank.upper()}"))
    return union(ns).distinct(), union(es).distinct()


def subtree(edge: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """node_id, depth (least) of everything reachable from the roots in so many steps.

    Each level is written, and holds only nodes that no earlier level has; the walk ends with an empty one.  root:
    column node_id.
    """
    spark, folder = edge.sparkSession, shared_folder(edge.sparkSession, "levels")
    steps = edge.select(F.col("source").alias("node_id"), F.col("target").alias("_next"))
    root.select("node_id").distinct().write.parquet(f"{folder}/depth=0")
    read = lambda d: spark.read.schema(root.select("node_id").schema).parquet(f"{folder}/depth={d}")
    levels = [read(0)]
    for d in range(1, depth + 1):
        new = levels[-1].join(steps, "node_id").select(F.col("_next").alias("node_id")).distinct()
        new.join(union(levels), "node_id", "left_anti").write.parquet(f"{folder}/depth={d}")
        if read(d).isEmpty():
            break
        levels.append(read(d))
    return union([level.withColumn("depth", F.lit(d)) for d, level in enumerate(levels)])


def undirected(edge: DataFrame) -> DataFrame:
    """Every edge in both directions; columns node, neighbor, type."""
    return edge.select(F.col("source").alias("node"), F.col("target").alias("neighbor"), "type").unionByName(edge.select(F.col("target").alias("node"), F.col("source").alias("neighbor"), "type")).distinct()


def neighbors(edge: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors: column node."""
    return undirected(edge).join(anchors.select("node").distinct(), "node", "left_semi")


def two_hops(edge: DataFrame, anchors: DataFrame) -> DataFrame:
    """First neighbours, with second ones (not the anchor itself) where there are any."""
    one = neighbors(edge, anchors).select("node", F.col("neighbor").alias("first"))
    two = undirected(edge).select(F.col("node").alias("first"), F.col("neighbor").alias("second"))
    return one.join(two, "first", "left").where("second is null or second <> node").select("node", "first", "second").distinct()


def degrees(edge: DataFrame) -> DataFrame:
    return undirected(edge).groupBy("node").agg(F.count("*").alias("degree"))


def type_counts(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes by label and edges by type, with the share of nodes without any edge."""
    touched = undirected(edge).select(F.col("node").alias("node_id")).distinct().withColumn("_t", F.lit(1))
    n = node.join(touched, "node_id", "left").select(F.explode("labels").alias("name"), "_t").groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg(F.col("_t").isNull().cast("int")), 6).alias("orphan_ratio"))
    e = edge.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("orphan_ratio", F.lit(None).cast("double"))
    return n.withColumn("kind", F.lit("node")).unionByName(e.withColumn("kind", F.lit("edge"))).select("kind", "name", "n", "orphan_ratio")


def limited_children(edge: DataFrame, most: int, order: Column) -> DataFrame:
    return edge.withColumn("_n", F.row_number().over(Window.partitionBy("source", "type").orderBy(order))).where(F.col("_n") <= most).drop("_n")


def budget(checks: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """checks with level: fail if any column exceeds its second limit, warn if any exceeds its first, else ok."""
    over = lambda k: reduce(lambda a, b: a | b, [F.col(c) > v[k] for c, v in limits.items()])
    return checks.withColumn("level", F.when(over(1), "fail").when(over(0), "warn").otherwise("ok"))


def chain_messages(child: DataFrame, links: Sequence[tuple[str, Column]]) -> DataFrame:
    """child with the array messages of the links (name, condition that holds) that are broken."""
    return child.withColumn("messages", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in links))))


def dot(edge: DataFrame) -> DataFrame:
    """Lines of a DOT graph, one for each edge."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), '"', "'"), F.lit('"'))
    return edge.select(F.concat(q("source"), F.lit(" -> "), q("target"), F.lit(' [label="'), F.col("type"), F.lit('"];')).alias("value"))
