"""Phrases that stand for codes: learnt from rows that have both, resolved with a policy for ambiguous ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse


def phrase_key(c: Column) -> Column:
    """Lower case, without an article in front and marks at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(collapse(c)), "^(?:the|a|an) ", ""), "[.,;:!?]+$", ""))


def mined(rows: DataFrame, phrases: Column, code: Column) -> DataFrame:
    """phrase, codes (distinct, sorted): of the phrases of each row and its code.

    A phrase's codes are few, however often it occurs: pairs are made distinct before they are collected.
    """
    pairs = rows.select(F.explode(phrases).alias("phrase"), F.upper(F.trim(code)).alias("code")).select(phrase_key(F.col("phrase")).alias("phrase"), "code")
    return pairs.where("phrase <> '' and code <> ''").distinct().groupBy("phrase").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def resolved(asked: DataFrame, dictionary: DataFrame, values: DataFrame, policy: str = "skip") -> DataFrame:
    """query_id, codes, unresolved, ambiguous of the phrases of each query (query_id, phrase).

    dictionary: phrase, codes; values: code, the ones that occur in the table.  A phrase with one occurring code gives
    it; with several it is skipped (unresolved, with its codes) or gives all of them, by the policy ``skip`` or
    ``union``; without any it is unresolved.
    """
    if policy not in ("skip", "union"):
        raise ValueError(f"unknown policy {policy}")
    known = dictionary.select("phrase", F.explode("codes").alias("code")).join(values.select("code").distinct(), "code", "left_semi").groupBy("phrase").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    rows = asked.select("query_id", "phrase", phrase_key(F.col("phrase")).alias("_k")).join(known.withColumnRenamed("phrase", "_k"), "_k", "left")
    several, none = F.size("codes") > 1, F.col("codes").isNull()
    union = F.lit(policy == "union")
    nothing = F.array().cast("array<string>")
    row = rows.select(
        "query_id", F.when(none | (several & ~union), nothing).otherwise(F.col("codes")).alias("c"), F.when(several & union, F.col("codes")).otherwise(nothing).alias("a"),
        F.when(none, F.col("phrase")).when(several & ~union, F.concat(F.col("phrase"), F.lit("=>"), F.array_join("codes", ","))).alias("u"),
    )
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return row.groupBy("query_id").agg(flat("c").alias("codes"), F.array_sort(F.collect_set("u")).alias("unresolved"), flat("a").alias("ambiguous"))


def phrases_before(c: Column, word: str) -> Column:
    """Up to three words before a word, with hyphens, as they stand."""
    return F.regexp_extract_all(collapse(c), F.lit(rf"(?i)((?:[\w-]+ ){{1,3}}){word}\b"), F.lit(1))
