"""Ordered operators, samples and incremental steps on events, orders and documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.measure import safe_div
from tessera.operators import sampling, windows
from tessera.operators import sets
from tessera.plans.registry import Tables, query
from tessera.streaming import incremental


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events""")
def fill_down(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return windows.fill_down(rows, ["value"], ["user_id"], ["ts", "event_id"]).select("event_id", "value")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3""")
def topk_per_group_cap(t: Tables) -> DataFrame:
    return windows.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("""SELECT doc_id, lang, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, lang, sum(n_chars + 2) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 100000""")
def context_budget_prefix(t: Tables) -> DataFrame:
    return windows.within_budget(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], [F.col("doc_id")], F.col("n_chars") + 2, 100000).drop("n_chars")


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, CAST(i * 800 + 1 AS BIGINT), 1000)) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 200) / 800.0), 1) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def rolling_chunks(t: Tables) -> DataFrame:
    rows = windows.rolling_chunks(t.documents.select("doc_id", "text"), "text", 1000, 200)
    return rows.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("""SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 7 AS INTEGER) AS shard FROM documents""")
def round_robin_shards(t: Tables) -> DataFrame:
    return windows.round_robin(t.documents.select("doc_id"), ["doc_id"], 7)


@query("""SELECT r AS user_id FROM range(200) x(r) WHERE r NOT IN (SELECT user_id FROM events)""")
def missing_indexes(t: Tables) -> DataFrame:
    return sets.missing_indexes(t.events, "user_id", 200)


@query("""SELECT o_orderstatus, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1""")
def share_of_total(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    rows = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return rows.withColumn("share", safe_div(F.col("n"), F.sum("n").over(Window.partitionBy())))


@query("""SELECT doc_id FROM documents ORDER BY sha1(doc_id || '|42'), doc_id LIMIT 100""")
def uniform_sample_hash(t: Tables) -> DataFrame:
    return sampling.uniform(t.documents.select("doc_id"), "doc_id", 100, 42)


_ALLOCATION = """z AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), f AS (SELECT *, size * 150 / (SELECT sum(size) FROM z) AS share, greatest(1, least(floor(size * 150 / (SELECT sum(size) FROM z)), size)) AS fl FROM z),
 q AS (SELECT source, size, CAST(fl + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, source) <= 150 - sum(fl) OVER () AND fl < size THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


@query(f"WITH {_ALLOCATION} SELECT * FROM q")
def stratified_allocation(t: Tables) -> DataFrame:
    return sampling.allocation(t.documents, "source", 150)


@query(f"""WITH {_ALLOCATION} SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1(doc_id || '|7'), doc_id) AS n FROM documents) JOIN q USING (source) WHERE n <= quota""")
def stratified_sample_hash(t: Tables) -> DataFrame:
    return sampling.stratified(t.documents.select("doc_id", "source"), "doc_id", "source", 150, 7)


@query("""WITH k AS (SELECT doc_id, (CAST('0x' || left(sha1(doc_id || '|3'), 8) AS BIGINT) + 1) / 4294967296.0 AS u, CASE lang WHEN 'en' THEN 1.0 ELSE 4.0 END AS w FROM documents) SELECT doc_id FROM k ORDER BY pow(u, 1 / w) DESC, doc_id LIMIT 100""")
def weighted_sample_hash(t: Tables) -> DataFrame:
    return sampling.weighted(t.documents.select("doc_id", "lang"), "doc_id", F.when(F.col("lang") == "en", 1.0).otherwise(4.0), 100, 3).select("doc_id")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT event_id, event_type FROM r ORDER BY CASE WHEN n <= CASE event_type WHEN 'click' THEN 30 WHEN 'error' THEN 10 ELSE 0 END THEN 0 ELSE 1 END, event_id LIMIT 60""")
def quota_sample(t: Tables) -> DataFrame:
    return sampling.quotas(t.events.select("event_id", "event_type"), "event_type", {"click": 30, "error": 10}, [F.col("event_id")], 60)


@query("""SELECT user_id, event_type, 'task_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS task_id FROM (SELECT user_id, event_type, row_number() OVER (ORDER BY user_id, event_type) AS n FROM (SELECT DISTINCT user_id, event_type FROM events))""")
def task_queue(t: Tables) -> DataFrame:
    return sampling.task_queue(t.events, ["user_id", "event_type"], ["user_id", "event_type"], "task")


@query("""SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')""")
def resume_left_anti(t: Tables) -> DataFrame:
    return incremental.pending(t.events.select("event_id", "user_id"), [t.events.where("event_id % 3 = 0"), t.events.where("event_type = 'click'")], "event_id")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'error'""")
def retry_only_failures(t: Tables) -> DataFrame:
    return incremental.to_retry(t.events.select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"), F.col("event_type") == "error").select("user_id", "event_id")


@query("""SELECT c_custkey, CAST(coalesce(event_id, -1) AS BIGINT) AS event_id FROM (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) JOIN (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) ON user_id = c_custkey""")
def latest_in_manifest_order(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("c_custkey"), "event_id")
    manifest = t.customer.select("c_custkey", F.col("c_nationkey").alias("place"))
    return incremental.compacted(log, manifest, "c_custkey", F.col("event_id"), "place").where("place < 2147483647").select("c_custkey", "event_id")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0, 2) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def windowed_counts(t: Tables) -> DataFrame:
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return incremental.windowed_counts(rows, "ts", "1 day", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round(F.col("total") / 100, 2))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events""")
def json_payload_parse(t: Tables) -> DataFrame:
    from tessera.functions.parse import json_value

    return t.events.select("event_id", json_value(F.col("props"), "$.k").try_cast("bigint").alias("k"))


@query("""SELECT c_custkey, chapter, text FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer) UNPIVOT (text FOR chapter IN (c_name, c_mktsegment)) WHERE text <> 'BUILDING'""")
def unpivot_sections(t: Tables) -> DataFrame:
    from tessera.sources.files import wide_to_long

    return wide_to_long(t.customer, ["c_custkey"], ["c_name", "c_mktsegment"]).where("text <> 'BUILDING'")
