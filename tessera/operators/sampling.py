"""Deterministic samples by hashed order, stratified allocation, quotas."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hashed(id_: str, seed: int | str) -> Column:
    return F.sha1(F.concat_ws("|", F.col(id_).cast("string"), F.lit(str(seed))).cast("binary"))


def uniform(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """n rows of lowest hash, ties by id; a distributed top-n."""
    return df.orderBy(hashed(id_, seed), id_).limit(n)


def unit(id_: str, seed: int) -> Column:
    """A number in (0, 1] from the first 8 hexadecimal digits of the hash."""
    return (F.conv(F.substring(hashed(id_, seed), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)


def weighted(df: DataFrame, id_: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by the keys u ** (1 / weight)."""
    return df.where(weight > 0).orderBy(F.pow(unit(id_, seed), 1 / weight).desc(), id_).limit(n)


def allocation(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum, size, quota: one each at least, proportional floors, then largest remainders, never above the size."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = Window.partitionBy()
    share = F.col("size") * n / F.sum("size").over(total)
    rows = sizes.withColumn("_share", share).withColumn("_floor", F.greatest(F.lit(1), F.least(F.floor("_share"), F.col("size"))))
    rows = rows.withColumn("_left", F.lit(n) - F.sum("_floor").over(total))
    rows = rows.withColumn("_place", F.row_number().over(Window.orderBy((F.col("_share") - F.floor("_share")).desc(), F.col(stratum))))
    extra = ((F.col("_place") <= F.col("_left")) & (F.col("_floor") < F.col("size"))).cast("int")
    return rows.select(stratum, "size", (F.col("_floor") + extra).alias("quota"))


def stratified(df: DataFrame, id_: str, stratum: str, n: int, seed: int) -> DataFrame:
    """Each stratum's quota of rows of lowest hash.

    No quota exceeds n, a constant, so every task keeps its n first rows of a stratum before any is shuffled.
    """
    quota = allocation(df, stratum, n).select(stratum, "quota")
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(hashed(id_, seed), id_))).where(F.col("_n") <= n)
    return ranked.join(quota, stratum).where("_n <= quota").drop("_n", "quota")


def quotas(df: DataFrame, kind: str, wanted: dict[str, int], order: Sequence[Column], n: int) -> DataFrame:
    """Each kind's quota in order, then the rest in order, n rows together."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    own = F.lit(0)
    for name, q in wanted.items():
        own = F.when(F.col(kind) == name, q).otherwise(own)
    return ranked.withColumn("_late", (F.col("_n") > own).cast("int")).orderBy("_late", *order).limit(n).drop("_n", "_late")


def task_queue(df: DataFrame, keys: Sequence[str], order: Sequence[str], prefix: str) -> DataFrame:
    """Distinct tasks with sequential ids prefix_0001 and on."""
    from tessera.operators.ranks import with_place

    return with_place(df.select(*keys).distinct(), order).withColumn("task_id", F.format_string(f"{prefix}_%04d", F.col("place") + 1)).drop("place")
