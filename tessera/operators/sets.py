"""Set operations: repair plans, additive merges, overlays."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import joined


def compared(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key with where it is: old_only, new_only or both."""
    x, y = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    return x.join(y, key, "full").select(key, F.when(F.col("_n").isNull(), "old_only").when(F.col("_o").isNull(), "new_only").otherwise("both").alias("side"))


def signature(columns: Sequence[str]) -> Column:
    return F.sha2(joined(*columns), 256)


def additive(old: DataFrame, new: DataFrame, columns: Sequence[str], id_: str, valid: Column, order: Sequence[str]) -> DataFrame:
    """new with outcome: invalid, known (its signature is in old), repeated (in new before), id_taken, or accepted."""
    from pyspark.sql.window import Window

    known = old.select(signature(columns).alias("_s")).distinct().withColumn("_known", F.lit(True))
    ids = old.select(id_).distinct().withColumn("_taken", F.lit(True))
    rows = new.withColumn("_s", signature(columns)).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_s", "_valid").orderBy(*order)))
    rows = rows.join(known, "_s", "left").join(ids, id_, "left")
    outcome = F.when(~F.col("_valid"), "invalid").when(F.col("_known"), "known").when(F.col("_nth") > 1, "repeated").when(F.col("_taken"), "id_taken").otherwise("accepted")
    return rows.withColumn("outcome", outcome).select(*new.columns, "outcome")


def overlay(nodes: Sequence[DataFrame], id_: str, order: str, values: Sequence[str]) -> DataFrame:
    """One row for each id; each property takes its last non-empty value in order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), nodes)
    return rows.groupBy(id_).agg(*(F.max_by(F.nullif(F.col(c).cast("string"), F.lit("")), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in values))


def missing_indexes(df: DataFrame, column: str, n: int) -> DataFrame:
    """Of 0 .. n - 1, those that do not occur."""
    return df.sparkSession.range(n).select(F.col("id").alias(column)).join(df.select(F.col(column).cast("long").alias(column)).distinct(), column, "left_anti")


def distinct_edges(*edges: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, edges).dropDuplicates(["source", "target", "type"])
