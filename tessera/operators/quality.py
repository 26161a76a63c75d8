"""Data-quality checks: keys, links, coverage, readiness."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, failures of each check; all in one pass."""
    wide = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    return wide.unpivot([], wide.columns, "check", "failures")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def link_integrity(links: DataFrame, sides: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """side, missing, null_keys of each side: (column of links, table, its key)."""
    out = []
    for column, target, key in sides:
        keys = target.select(F.col(key).alias(column)).distinct().withColumn("_hit", F.lit(1))
        joined = links.select(column).join(keys, column, "left")
        out.append(joined.agg(F.count_if(F.col(column).isNotNull() & F.col("_hit").isNull()).alias("missing"), F.count_if(F.col(column).isNull()).alias("null_keys")).select(F.lit(column).alias("side"), "missing", "null_keys"))
    return reduce(DataFrame.unionByName, out)


def shard_coverage(df: DataFrame, shard: str, expected: int, done: Column) -> DataFrame:
    """Every expected shard with its rows and state: missing, empty, partial or completed."""
    seen = df.groupBy(F.col(shard).cast("long").alias("shard")).agg(F.count("*").alias("rows"), F.count_if(done).alias("done"))
    all_ = df.sparkSession.range(expected).select(F.col("id").alias("shard"))
    out = all_.join(seen, "shard", "left")
    state = F.when(F.col("rows").isNull(), "missing").when(F.col("done") == 0, "empty").when(F.col("done") < F.col("rows"), "partial").otherwise("completed")
    return out.select("shard", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("done", F.lit(0)).alias("done"), state.alias("status"))


def readiness(checks: DataFrame) -> DataFrame:
    """ready, and the names of the checks that block."""
    return checks.agg(F.every(F.col("failures") == 0).alias("ready"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("failures") > 0, F.col("check"))))).alias("blocking"))


def corrupt_rows(lines: DataFrame, column: str, required: Sequence[str]) -> DataFrame:
    """Physical, non-empty, unparsable, non-object and incomplete lines of a JSON-lines table."""
    v = F.col(column)
    full = F.trim(v) != ""
    parsed = F.try_parse_json(v)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    complete = reduce(lambda a, b: a & b, [F.get_json_object(v, f"$.{k}").isNotNull() for k in required])
    return lines.agg(F.count("*").alias("physical"), F.count_if(full).alias("nonempty"), F.count_if(full & parsed.isNull()).alias("bad_json"), F.count_if(full & parsed.isNotNull() & ~is_object).alias("non_object"), F.count_if(is_object & ~complete).alias("missing_key"))


def guard(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df as it is; a row that fails the condition stops the run."""
    c = df.columns[0]
    return df.withColumn(c, F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[c].dataType)))
