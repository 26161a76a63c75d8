"""Round trips through sources, sinks, streams and vector indexes, compared with SQL over the final state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import Tables, query
from tessera.sources import files, sinks
from tessera.sources.shared import shared_folder
from tessera.streaming import incremental


@query("""SELECT event_id, user_id, event_type, round(value * 2, 4) AS doubled FROM events WHERE event_type <> 'error'""")
def stream_available_now(t: Tables) -> DataFrame:
    """A stream over the events, twice started: the second run finds nothing new."""
    root = shared_folder(t.spark, "stream")
    work = lambda df: df.where("event_type <> 'error'").select("event_id", "user_id", "event_type", F.round(F.col("value") * 2, 4).alias("doubled"))
    for _ in range(2):
        incremental.ingest(t.spark, f"{t.folder}/events.parquet*", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", ["event_id"], None, "", work, f"{root}/out", f"{root}/ledger", f"{root}/checkpoint")
    incremental.no_repeats(t.spark.read.parquet(f"{root}/ledger"), ["event_id"])
    return t.spark.read.parquet(f"{root}/out").drop("batch")


@query("""SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part""")
def jsonl_round_trip(t: Tables) -> DataFrame:
    root = shared_folder(t.spark, "jsonl")
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    sinks.append(rows.where("p_partkey % 2 = 0"), f"{root}/rows")
    sinks.append(rows.where("p_partkey % 2 = 1"), f"{root}/rows")
    return files.jsonl_strict(t.spark, f"{root}/rows", rows.schema)


@query("""SELECT conv_id, turn, role, regexp_replace(text, '[\\x00-\\x1F]', ' ', 'g') AS text FROM conversations""")
def csv_round_trip(t: Tables) -> DataFrame:
    root = shared_folder(t.spark, "csv")
    sinks.csv(t.conversations, f"{root}/rows", ["conv_id", "turn", "role", "text"])
    return files.csv(t.spark, f"{root}/rows", "conv_id long, turn long, role string, text string")


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey >= 100 UNION ALL SELECT c_custkey, 'MOVED', c_acctbal + 1 FROM customer WHERE c_custkey < 100""")
def upsert_rewrite(t: Tables) -> DataFrame:
    """An upsert, written through a staging folder over the old table."""
    path = f"{shared_folder(t.spark, 'upsert')}/rows"
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    sinks.rewrite(rows, path)
    new = rows.where("c_custkey < 100").select("c_custkey", F.lit("MOVED").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    sinks.rewrite(sinks.upsert(t.spark.read.parquet(path), new, ["c_custkey"]), path)
    return t.spark.read.parquet(path)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY ALL""")
def routed_sink(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark, 'routed')}/rows"
    sinks.routed(t.lineitem.where("l_quantity > 40").select("l_returnflag", "l_linestatus", "l_orderkey"), path, "l_returnflag", "l_linestatus")
    return t.spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT vec_id, label FROM embeddings""")
def vector_index_round_trip(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "index")
    sinks.write_index(t.embeddings, path, "local", "given", 64)
    return sinks.read_index(t.spark, path, "local", "given", 64).select("vec_id", "label")


@query("""SELECT count(*) AS good, CAST(3 AS BIGINT) AS bad FROM region""")
def lenient_jsonl(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark, 'lenient')}/rows"
    lines = t.region.select(F.to_json(F.struct("*")).alias("value")).unionByName(t.spark.createDataFrame([("{broken",), ("[1, 2]",), ("",), ('{"r_regionkey": "x"}',)], "value string"))
    lines.write.text(path)
    good, bad = files.jsonl_lenient(t.spark, path, "r_regionkey int, r_name string")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))
