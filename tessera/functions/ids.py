"""Stable identifiers: hashes over joined parts, with missing parts kept as empty ones."""

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits kept of each kind of id.
WIDTHS = {"default": 16, "node": 12, "claim": 24, "fact": 32}


def joined(*parts: Column | str) -> Column:
    """Parts joined by ||; a null part keeps its separator."""
    return F.concat_ws("||", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def stable_id(prefix: str, *parts: Column | str, width: int = WIDTHS["default"], algorithm: str = "sha1") -> Column:
    raw = joined(*parts)
    digest = F.sha1(raw.cast("binary")) if algorithm == "sha1" else F.sha2(raw, 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, width))


def node_id(label: str, value: Column) -> Column:
    """label:slug:hash of a graph node."""
    from tessera.functions.text import slug

    return F.concat_ws(":", F.lit(label.lower()), slug(value), F.substring(F.sha1(F.coalesce(value, F.lit("")).cast("binary")), 1, WIDTHS["node"]))


def signature(*parts: Column | str, width: int = 16) -> Column:
    return F.substring(F.sha2(joined(*parts), 256), 1, width)


def _typed(value: object) -> object:
    if isinstance(value, bool):
        return {"type": "bool", "value": value}
    if value is None:
        return {"type": "NoneType", "value": None}
    if isinstance(value, str):
        return {"type": "str", "value": value}
    x = float(value)
    if math.isfinite(x):
        shown = str(int(x)) if x == int(x) else f"{x:.17g}"
    else:
        shown = "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    return {"type": "number", "value": shown}


def typed_key(parts: list) -> str:
    """The typed JSON of a tuple of scalars: equal numbers of any type agree, booleans and texts stay apart."""
    return json.dumps({"type": "tuple", "value": [_typed(p) for p in parts]}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _fact_ids(strings: pd.DataFrame, numbers: pd.DataFrame) -> pd.Series:
    def one(s: tuple, n: tuple) -> str:
        n = [None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in n]
        return "fact_" + hashlib.sha1(typed_key([*s[:6], *n, *s[6:]]).encode()).hexdigest()[: WIDTHS["fact"]]

    return pd.Series([one(s, n) for s, n in zip(strings.itertuples(index=False), numbers.itertuples(index=False))])


def typed_fact_id(strings: Column, numbers: Column) -> Column:
    """fact_ id over a struct of eight texts (unit and qualifiers last) and a struct of two numbers, byte for byte."""
    return F.pandas_udf(_fact_ids, T.StringType())(strings, numbers)
