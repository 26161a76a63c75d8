"""A training corpus from documents: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; run() writes each stage's
result as Parquet in the shared folder and rereads it for the next.  Further columns stay as they are, whatever their
names; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import op1_packing, op4_ngram_join, op6_substring_dedup, op7_decontamination, op8_quality
from tessera.llm.common import Scratch, by_ids, join_counted, table, unused
from tessera.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones.

    A null text is scored as an empty one; without labels of both classes the share of good labels decides (one half,
    which keeps all, without any).  Repeated rows are judged each.
    """
    scored = op8_quality.score(docs, op8_quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the row of least id; rows without an id come last.

    Rows of one id are told apart by a hash of all their columns (but maps), the least of which decides; only rows
    alike in every column fall together.  Null and empty texts are similar to nothing, so all of them stay.
    """
    scratch = Scratch(spark, "pipeline")
    name = unused(docs.columns, "row_hash")
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    rows = docs.withColumn(name, F.xxhash64(*(x for c in plain for x in (docs[c].isNull(), docs[c]))))
    linked = op4_ngram_join.linked(rows, carry=(name,)).where("component is not null")
    linked = scratch.table(linked.select("component", F.col(name).alias("row_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", name).alias("place")), "linked")
    least = scratch.table(linked.groupBy("component").agg(F.min("place").alias("least"), F.count("*").alias("count")), "least")
    gone = scratch.table(join_counted(linked, least, "component").where("place <> least").select(F.col("row_hash").alias(name)).distinct(), "gone")
    n_gone = gone.count()
    alike = linked.groupBy(F.col("row_hash").alias(name)).count().where("count > 1").select(name)
    alike = scratch.table(by_ids(alike, gone, n_gone, "left_anti", [name]), "alike")
    n_alike = alike.count()
    stay = by_ids(rows, gone, n_gone, "left_anti", [name])
    once = by_ids(stay, alike, n_alike, "left_anti", [name])
    return once.unionByName(by_ids(stay, alike, n_alike, "left_semi", [name]).dropDuplicates([name])).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; a column n_chars, if there, is counted again.

    Null and empty texts stay as they are; documents of which nothing stays go.  Rows of one id are documents of
    their own, rows alike in id and text get the same result each.
    """
    rows = op6_substring_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return rows.select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them; null and empty texts and items leak nothing, repeated rows go or stay alike."""
    marked = op7_decontamination.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size(marked.columns[-1]) == 0).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences; a null text is one piece, its end; repeated rows are packed each."""
    return op1_packing.pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("leaks", leaks), ("packing", packing)]

#: Compression, alignment and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
