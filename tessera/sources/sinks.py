"""Sinks: rewrites through a staging folder, appends, routed and multiple outputs, small documents."""

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def rewrite(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes beside the old table and renames at the end, so readers see the old or the new one whole.

    A run that was lost between the two renames is mended first: its old table takes its place again.  On stores
    without atomic renames a reader may find the table absent in between.
    """
    spark = df.sparkSession
    staging, fs = _fs(spark, f"{path}.staging")
    target, old = _fs(spark, path)[0], _fs(spark, f"{path}.old")[0]
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    df.write.mode("overwrite").format(form).save(staging.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(staging, target):
        raise OSError(f"could not rename {staging.toString()}")
    fs.delete(old, True)


def append(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("append").format(form).save(path)


def write_all(outputs: Sequence[tuple[DataFrame, str, str]]) -> None:
    """(table, path, append or rewrite) for each of several outputs."""
    for df, path, mode in outputs:
        append(df, path, "parquet") if mode == "append" else rewrite(df, path)


def sanitized(df: DataFrame, separator: str = "; ") -> DataFrame:
    """For CSV: control characters removed from texts, lists joined, other nested values as JSON."""
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(c, separator)
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        elif kind != "string":
            return c
        return F.regexp_replace(c, r"[\x00-\x1F]", " ")

    return df.select(*(one(n, k).alias(n) for n, k in df.dtypes))


def csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    sanitized(df.select(*columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def routed(df: DataFrame, path: str, *by: str) -> None:
    """A folder for each value of the columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def document(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document, written whole."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.close()


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; a report, so its rows have a limit, and a last line says so where there are more."""
    rows = df.limit(most + 1).collect()
    line = lambda xs: "| " + " | ".join(str("" if x is None else x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    more = [f"\nOnly the first {most} rows are shown."] if len(rows) > most else []
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows[:most]), *more])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new, and rows of old whose key it lacks."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def write_index(vectors: DataFrame, path: str, provider: str, model: str, dimension: int) -> None:
    """Vectors with their columns, and a manifest that a reader checks."""
    rewrite(vectors, f"{path}/vectors")
    document(vectors.sparkSession, {"embedding_provider": provider, "embedding_model": model, "embedding_dim": dimension}, f"{path}/manifest.json")


def read_index(spark: SparkSession, path: str, provider: str, model: str, dimension: int) -> DataFrame:
    """The vectors of an index that was written with the same provider, model and dimension."""
    found = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect()))
    wanted = {"embedding_provider": provider, "embedding_model": model, "embedding_dim": dimension}
    wrong = sorted(k for k, v in wanted.items() if found.get(k) != v)
    if wrong:
        raise ValueError(f"the index was built otherwise: {', '.join(wrong)}; rebuild it")
    return spark.read.parquet(f"{path}/vectors")
