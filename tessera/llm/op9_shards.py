"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source, ranked there, and put in order of their fractional
rank (rank - 1/2) / rows of the source; equal parts of that order are the shards, so that each has the same
mixture of sources and the shards' row counts differ by one at most (law ``rows``).

Both orders are total (source and hash, then fraction and source; a row's own number breaks ties), and rows are
ranked in ranges of the whole order: a source with a third of all rows, a million sources of one row, or one row
repeated a million times fill as many tasks as their rows need.  Only ids, sizes and sums are shuffled, no texts.

A null source is a source of its own, a null text has no bytes, rows without an id are ranked by their hashes like
others, repeated rows get a place each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_counted, numbered, table

SHARDS = 24

def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row."""
    scratch = Scratch(docs.sparkSession, "op9")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(source_col).isNull(), F.col(source_col)).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.table(rows, "rows")
    total = rows.count()
    rows = numbered(rows, total, ["stratum", "key", "row"], scratch, "by_source", "place")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("count"), F.min("place").alias("lowest"))
    rows = join_counted(rows, scratch.table(sizes.withColumn("n", F.col("count")), "sizes"), "stratum", total=total)
    rows = rows.withColumn("fraction", (F.col("place") - F.col("lowest") + 0.5) / F.col("n")).drop("place", "lowest", "n", "key")
    rows = numbered(rows, total, ["fraction", "stratum", "row"], scratch, "by_fraction", "at")
    # shard s takes the places floor(s * total / shards) and on
    own = F.floor(((F.col("at") + 1) * shards - 1) / F.lit(total)).cast("int")
    first = F.floor(F.col("shard").cast("long") * total / F.lit(shards))
    return rows.withColumn("shard", own).select("doc_id", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
