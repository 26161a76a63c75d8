"""Measures: ratios, overlaps, similarities, embeddings, extraction of quantities."""

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b.isNull() | (b == 0), F.lit(0.0)).otherwise(F.round(a / b, digits))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(c.try_cast("double"), F.lit(high)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def normalized(v: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def set_f1(found: Column, gold: Column) -> Column:
    """F1 of two sets; both empty count 1, one empty 0."""
    a, b = F.array_distinct(found), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def token_f1(found: Column, gold: Column) -> Column:
    """F1 of two bags of tokens."""
    both = F.aggregate(
        F.array_distinct(found), F.lit(0),
        lambda s, t: s + F.least(F.size(F.filter(found, lambda x: x == t)), F.size(F.filter(gold, lambda x: x == t))),
    )
    return F.when((F.size(found) == 0) & (F.size(gold) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(found) + F.size(gold)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the geometric mean of the sets' sizes."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    n = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts by longest matching blocks."""
    return F.pandas_udf(_ratio, T.DoubleType())(a, b)


def close_matches(c: Column, names: list[str], n: int = 3, cutoff: float = 0.72) -> Column:
    """The most similar of a fixed list of names."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([difflib.get_close_matches(v or "", names, n, cutoff) for v in values])

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(c)


def hash_entries(tokens: Column, width: int) -> Column:
    """Bucket and sign of each token: the first 32 bits of its hash, the remainder and the highest bit."""
    h = F.transform(tokens, lambda t: F.conv(F.substring(F.sha1(t.cast("binary")), 1, 8), 16, 10).cast("long"))
    return F.transform(h, lambda x: F.struct((x % width).cast("int").alias("bucket"), F.when(F.shiftright(x, 31) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))


def hash_vectors(df: DataFrame, id_: str, tokens: Column, width: int = 384) -> DataFrame:
    """id, bucket, value of each non-zero entry of a unit vector by signed feature hashing."""
    sums = df.select(id_, F.explode(hash_entries(tokens, width)).alias("e")).groupBy(id_, "e.bucket").agg(F.sum("e.sign").alias("s"))
    norms = sums.groupBy(id_).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    return sums.where("s <> 0").join(norms, id_).select(id_, "bucket", (F.col("s") / F.col("n")).alias("value"))


def dense(entries: DataFrame, id_: str, width: int) -> DataFrame:
    """id, vector from entries; missing ones are 0."""
    m = entries.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    return m.select(id_, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("vector"))


_NUMBER = r"(\d+(?:[.,]\d+)?)"
#: Kind and unit of a quantity.
QUANTITIES = {
    "length": r"(mm|cm|km|m)\b",
    "mass": r"(kg|mg|g)\b",
    "duration": r"(days?|weeks?|months?|years?|h|min)\b",
    "share": r"(%|percent)",
    "count": r"(eggs?|broods?|pairs?|individuals?)\b",
}


def _quantities(values: pd.Series) -> pd.Series:
    def one(text: str) -> list[dict]:
        found, taken = [], []
        for kind, unit in QUANTITIES.items():
            for low, pattern in ((True, rf"{_NUMBER}\s*(?:-|–|to)\s*{_NUMBER}\s*{unit}"), (False, rf"{_NUMBER}\s*{unit}")):
                for m in re.finditer(pattern, text):
                    if any(a <= m.start() and m.end() <= z for a, z in taken):
                        continue  # within a range that has been taken
                    taken.append(m.span())
                    first = float(m[1].replace(",", "."))
                    found.append({"kind": kind, "value_min": first, "value_max": float(m[2].replace(",", ".")) if low else first, "unit": m[m.lastindex], "start": m.start()})
        distinct = {(f["kind"], f["value_min"], f["value_max"], f["unit"]): f for f in reversed(found)}
        return sorted(distinct.values(), key=lambda f: f["start"])

    return pd.Series([one(v or "") for v in values])


def quantities(c: Column) -> Column:
    """Quantities of a text: ranges before single values, none inside another, distinct, in order of place."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value_min", T.DoubleType()), T.StructField("value_max", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("start", T.IntegerType())]))
    return F.pandas_udf(_quantities, kind)(c)


def object_type(value: Column, known_ids: Column) -> Column:
    """number, concept (an id of the known ones), boolean or text."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v.try_cast("double").isNotNull(), "number").when(F.array_contains(known_ids, v), "concept").when(F.lower(v).isin("true", "false", "yes", "no"), "boolean").otherwise("text")
