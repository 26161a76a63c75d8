"""Sources: JSON lines (strict, lenient, keyed, sharded), CSV, text lines, spreadsheets, fallbacks between paths."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches a path of any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines; a missing path gives none."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A missing path, or a line that is no object of the schema, stops the run."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines with their file."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.input_file_name().alias("file"))
    parsed = rows.withColumn("_r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return parsed.where(~bad).select(*(f"_r.{f.name}" for f in schema.fields)), parsed.where(bad).select("file", F.col("value").alias("line"))


def keyed(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, the last in order."""
    from tessera.operators.windows import last_row

    return last_row(df, [key], order)


def shards(spark: SparkSession, root: str, name: str, schema: str | T.StructType) -> DataFrame:
    """All shard_<n>/name files under root, with the shard's number."""
    rows = spark.read.schema(schema).json(f"{root}/shard_*/{name}")
    return rows.withColumn("shard", F.regexp_extract(F.input_file_name(), r"/shard_(\d+)/", 1).cast("int"))


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file with header; a byte-order mark is no part of the first name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """By suffix: .csv, .parquet, else JSON lines."""
    if path.endswith(".csv"):
        return csv(spark, path, schema)
    return spark.read.parquet(path) if path.endswith(".parquet") else jsonl(spark, path, schema)


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "chapter", value: str = "text") -> DataFrame:
    """A column for each chapter becomes a row for each, empty ones left out."""
    return df.unpivot(list(ids), list(values), name, value).where(F.trim(F.coalesce(value, F.lit(""))) != "")


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def parse_workbook(raw: bytes, sheet: str | None = None) -> list[list[str]]:
    """Rows of texts of a sheet (the first by default) of an Office Open XML workbook, by the standard library alone."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheets = [(s.get("name"), s.get(rel)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        chosen = next((r for n, r in sheets if sheet is None or n == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet}")
        out = []
        for row in ElementTree.fromstring(z.read("xl/" + targets[chosen].removeprefix("/xl/"))).iter(f"{ns}row"):
            cells: list[str] = []
            for c in row.iter(f"{ns}c"):
                place = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    place = place * 26 + ord(letter) - 64
                cells += [""] * (place - len(cells))
                v, kind = c.find(f"{ns}v"), c.get("t")
                if kind == "inlineStr":
                    cells[place - 1] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                elif v is not None:
                    cells[place - 1] = strings[int(v.text)] if kind == "s" else v.text or ""
            out.append(cells)
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out if any(x.strip() for x in r)]


def workbook(spark: SparkSession, path: str, sheet: str | None = None, header_rows: int = 1) -> DataFrame:
    """A sheet as a table of texts.  Workbooks are single files of bounded size; each is parsed in one task, by its own bytes."""
    from tessera.operators.tables import merged_header, unique_names

    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                rows = parse_workbook(content, sheet)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["place", "cells"])

    rows = files.mapInArrow(run, "place long, cells array<string>").where("size(cells) > 0").persist()
    head = [r.cells for r in rows.where(F.col("place") < header_rows).orderBy("place").collect()]
    names = merged_header(head[0], head[1]) if header_rows == 2 else unique_names(head[0] if head else [])
    return rows.where(F.col("place") >= header_rows).select(F.col("place").alias("_ord"), *(F.coalesce(F.col("cells")[i], F.lit("")).alias(n) for i, n in enumerate(names)))
