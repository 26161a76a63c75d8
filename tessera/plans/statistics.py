"""Counts, histograms, shares, coverage by group, and deltas between groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.measure import safe_div
from tessera.operators import routing
from tessera.plans.registry import Tables, query


@query("""SELECT least(n, 8) AS bucket, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1""")
def capped_histogram(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(F.least("n", F.lit(8)).alias("bucket")).agg(F.count("*").alias("orders"))


_CAP = "n AS (SELECT o_orderpriority, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(f"""WITH {_CAP} SELECT o_orderpriority, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS claims, round(sum(n) / count(*), 6) AS mean, count(*) FILTER (n >= 4) AS at_cap, count(*) FILTER (n = 4) AS exact, count(*) FILTER (n > 4) AS over, round(count(*) FILTER (n >= 4) / count(*), 6) AS share FROM n GROUP BY 1""")
def chapter_cap_stats(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = t.orders.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.groupBy("o_orderpriority").agg(F.count("*").alias("chunks"), F.sum("n").alias("claims"), *(F.count_if(c).alias(k) for k, c in (("at_cap", F.col("n") >= 4), ("exact", F.col("n") == 4), ("over", F.col("n") > 4))))
    return out.withColumn("mean", safe_div(F.col("claims"), F.col("chunks"))).withColumn("share", safe_div(F.col("at_cap"), F.col("chunks")))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def two_level_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("bigint").alias("level"), F.count("*").alias("n"))


@query("""SELECT user_id, to_json(map_from_entries(list((event_type, n) ORDER BY event_type))) AS distribution FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def distribution_as_json(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("distribution"))


@query("""SELECT event_type, count(*) AS rows, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY 1""")
def pass_rates(t: Tables) -> DataFrame:
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("rows"), F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("pass_rate"))
    return rows.withColumn("share", safe_div(F.col("rows"), F.sum("rows").over(Window.partitionBy()))).withColumn("place", F.rank().over(Window.orderBy(F.desc("rows"), "event_type")))


@query("""WITH d AS (SELECT user_id % 10 AS shard, count(*) AS done, count(DISTINCT user_id) AS subjects FROM events GROUP BY 1) SELECT shard, done, subjects, round(done / subjects, 6) AS density, CAST(round(done / subjects * 200) AS BIGINT) AS projected FROM d""")
def shard_density(t: Tables) -> DataFrame:
    rows = t.events.groupBy((F.col("user_id") % 10).alias("shard")).agg(F.count("*").alias("done"), F.countDistinct("user_id").alias("subjects"))
    return rows.withColumn("density", safe_div(F.col("done"), F.col("subjects"))).withColumn("projected", F.round(F.col("done") / F.col("subjects") * 200).cast("bigint"))


@query("""WITH c AS (SELECT lang, count(*) AS raw, count(*) FILTER (n_chars > 500) AS candidate, count(*) FILTER (n_chars > 500 AND doc_id % 2 = 0) AS selected FROM documents GROUP BY 1) SELECT *, raw - candidate AS dropped FROM c""")
def quota_breakdown(t: Tables) -> DataFrame:
    big = F.col("n_chars") > 500
    rows = t.documents.groupBy("lang").agg(F.count("*").alias("raw"), F.count_if(big).alias("candidate"), F.count_if(big & (F.col("doc_id") % 2 == 0)).alias("selected"))
    return rows.withColumn("dropped", F.col("raw") - F.col("candidate"))


@query("""WITH g AS (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS old, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, CAST(coalesce(sum(n) FILTER (old), 0) AS BIGINT) AS before, CAST(coalesce(sum(n) FILTER (NOT old), 0) AS BIGINT) AS after, CAST(coalesce(sum(n) FILTER (NOT old), 0) - coalesce(sum(n) FILTER (old), 0) AS BIGINT) AS delta FROM g GROUP BY 1""")
def group_deltas(t: Tables) -> DataFrame:
    old = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t.lineitem.groupBy("l_returnflag").agg(F.count_if(old).alias("before"), F.count_if(~old).alias("after"))
    return rows.withColumn("delta", F.col("after") - F.col("before"))


@query("""SELECT l_suppkey, CAST(coalesce(sum(least(n, 2)), 0) AS BIGINT) AS kept, CAST(sum(n) AS BIGINT) AS links FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def evidence_cap_impact(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return per.groupBy("l_suppkey").agg(F.sum(F.least("n", F.lit(2))).alias("kept"), F.sum("n").alias("links"))


@query("""SELECT l_partkey, count(*) AS claims, count(DISTINCT l_orderkey) AS chunks, min(l_orderkey) AS first_row, max(l_orderkey) AS last_row FROM lineitem GROUP BY 1""")
def claim_index(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("claims"), F.countDistinct("l_orderkey").alias("chunks"), F.min("l_orderkey").alias("first_row"), F.max("l_orderkey").alias("last_row"))


_CHAPTERS = ["Introduction", "Diet_and  Foraging", "DietAndForaging", "MovementAndMigration", "Movement_and_Migration", "Acknowledgments", " habitat ", "DEMOGRAPHY", "Behavior", "No such chapter"]


@query("""WITH r(i, skip, domains, predicates, max_claims) AS (VALUES (0, false, 6, 48, 2), (1, false, 1, 5, 4), (2, false, 1, 5, 4), (3, false, 1, 8, 4), (4, true, 0, 0, 0), (5, true, 0, 0, 0), (6, false, 2, 7, 4), (7, false, 2, 20, 4), (8, false, 2, 28, 4), (9, true, 0, 0, 0))
 SELECT doc_id, skip, domains, predicates, max_claims FROM documents JOIN r ON i = doc_id % 10""")
def chapter_routing(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(n) for n in _CHAPTERS))
    rows = routing.routed(t.documents.select("doc_id", F.element_at(names, (F.col("doc_id") % 10 + 1).cast("int")).alias("chapter")), "chapter")
    return rows.select("doc_id", "skip", F.size("domains").alias("domains"), F.size("predicates").alias("predicates"), "max_claims")


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n <= 3""")
def examples_per_tag(t: Tables) -> DataFrame:
    from tessera.operators.windows import top_per_group

    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_per_group(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey")
