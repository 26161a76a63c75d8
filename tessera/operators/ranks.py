"""Global places without a single task: range partitioning, places within it, counts before it."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import shared_folder


#: Rows of a range on average.
RANGE_ROWS = 50_000


def with_place(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with place, from 0, in a global order whose columns identify a row.

    Rows are dealt by ranges of the whole order, of whatever type, and written with their range; a range's offset is
    the count of those before.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "ranges")
    ranged = df.repartitionByRange(max(1, df.count() // RANGE_ROWS), *order).withColumn("_b", F.spark_partition_id())
    ranged.write.parquet(folder)
    rows = spark.read.schema(ranged.schema).parquet(folder)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_p", F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1)
    return placed.join(before, "_b").withColumn("place", F.col("_before") + F.col("_p")).drop("_b", "_p", "_before")
