"""Ordered operators: fill-down, first and last, caps, budgets, chunks, shards."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def fill_down(df: DataFrame, columns: Sequence[str], within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Missing values take the last one above, within each group."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def first_row(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The first row of each key; an aggregate, so hot keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def last_row(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def top_per_group(df: DataFrame, within: Sequence[str], order: Sequence[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """The first n of each group; Spark keeps a group's first rows before the shuffle already."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return out.where(F.col(rank) <= n)


def within_budget(df: DataFrame, within: Sequence[str], order: Sequence[Column], cost: Column, budget: int) -> DataFrame:
    """The rows before the first one that would exceed the budget."""
    w = Window.partitionBy(*within).orderBy(*order)
    out = df.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("used") <= budget)


def rolling_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Chunks of size characters, each overlapping the one before; chunk_index from 0."""
    step = size - overlap
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / F.lit(step)).cast("int") - 1, F.lit(0)))
    return df.select("*", F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))).alias("chunk_index", "chunk")).where(n > 0)


def round_robin(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """shard by place in a global order: (row number - 1) modulo shards.

    Places come from a range partitioning and its partitions' counts, so no task sees all rows.
    """
    from tessera.operators.ranks import with_place

    return with_place(df, order).withColumn("shard", (F.col("place") % shards).cast("int")).drop("place")


def longest_first(sizes: dict[str, int], shards: int) -> dict[str, int]:
    """Whole groups to shards, largest first to the least filled; for the few groups of a manifest."""
    load, out = [0] * shards, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = min(range(shards), key=lambda i: (load[i], i))
        out[name], load[k] = k, load[k] + n
    return out


def diverse(df: DataFrame, query: str, rank: str, source: str, unique: str, n: int, per_source: int) -> DataFrame:
    """Greedy selection of n candidates of each query: per_source of a source at most, unique keys, then backfill.

    Candidates of a query are a top-k list already, so a group is small.
    """
    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([rank, unique], kind="stable")
        taken, seen, used = [], set(), {}
        for limited, once in ((True, True), (False, True), (False, False)):
            for i, s, u in zip(g.index, g[source], g[unique]):
                if len(taken) == n:
                    break
                if i in taken or (once and u in seen) or (limited and used.get(s, 0) >= per_source):
                    continue
                taken.append(i)
                seen.add(u)
                used[s] = used.get(s, 0) + 1
        return g.loc[taken].assign(place=range(1, len(taken) + 1))

    return df.groupBy(query).applyInPandas(pick, T.StructType([*df.schema.fields, T.StructField("place", T.IntegerType())]))


def quota_rerank(df: DataFrame, query: str, score: str, category: str, quotas: dict[str, int]) -> DataFrame:
    """Candidates of each query in order of score, a category's rows beyond its quota after all others."""
    order = [F.col(score).desc(), F.col(category)]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(query, category).orderBy(*order)))
    quota = F.lit(1 << 30)
    for name, n in quotas.items():
        quota = F.when(F.col(category) == name, n).otherwise(quota)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy((F.col("_n") > quota).cast("int"), *order))).drop("_n")
