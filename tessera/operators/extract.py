"""Extraction of claims from texts: a pluggable extractor, rules as the default, sections, reviews."""

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Extractor(Protocol):
    """Claims of one text: dicts with predicate, object_text, quote, confidence."""

    def extract(self, text: str, routing: dict) -> list[dict]: ...


class RuleExtractor:
    """Claims by patterns: (predicate, pattern whose first group is the object, confidence)."""

    def __init__(self, rules: list[tuple[str, str, float]], most: int = 4):
        self.rules, self.most = [(p, re.compile(x, re.I), c) for p, x, c in rules], most

    def extract(self, text: str, routing: dict) -> list[dict]:
        allowed = routing.get("predicates")
        out = [{"predicate": p, "object_text": m[1].strip().lower(), "quote": m[0], "confidence": c} for p, x, c in self.rules if not allowed or p in allowed for m in x.finditer(text)]
        return out[: self.most]


class NoExtractor:
    def extract(self, text: str, routing: dict) -> list[dict]:
        return []


CLAIM = "predicate string, object_text string, quote string, confidence double"


def claims(chunks: DataFrame, make: Callable[[], Extractor], id_: str, text: str, predicates: str | None = None, retries: int = 1) -> DataFrame:
    """id, position and claim of each claim; error where the extractor failed after its retries (position null).

    make builds the extractor once in each task, so a model or a client is loaded there.
    """
    columns = [id_, text] + ([predicates] if predicates else [])
    kind = chunks.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()
        for b in batches:
            rows = []
            for values in b.itertuples(index=False):
                routing = {"predicates": list(values[2])} if predicates and values[2] is not None else {}
                for attempt in range(retries + 1):
                    try:
                        found = extractor.extract(values[1] or "", routing)
                        rows += [(values[0], i, c["predicate"], c["object_text"], c["quote"], float(c["confidence"]), None) for i, c in enumerate(found)]
                        break
                    except Exception as e:  # a failed row is recorded, not lost
                        if attempt == retries:
                            rows.append((values[0], None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=[id_, "position", "predicate", "object_text", "quote", "confidence", "error"]).astype({"position": "Int32"})

    return chunks.select(*columns).mapInPandas(run, f"{id_} {kind}, position int, {CLAIM}, error string")


def sections(df: DataFrame, id_: str, text: str, heading: str) -> DataFrame:
    """id, section, heading, body: lines that match the pattern open a section; before the first, the heading is ''."""
    pattern = re.compile(heading)
    kind = T._parse_datatype_string("array<struct<section:int,heading:string,body:string>>")

    def split(values: pd.Series) -> pd.Series:
        def one(t: str) -> list[dict]:
            out: list[list] = [["", []]]
            for line in t.split("\n"):
                if pattern.search(line):
                    out.append([line.strip(), []])
                else:
                    out[-1][1].append(line)
            parts = [(h, "\n".join(b).strip()) for h, b in out]
            return [{"section": i, "heading": h, "body": b} for i, (h, b) in enumerate(p for p in parts if p[0] or p[1])]

        return pd.Series([one(v or "") for v in values])

    return df.select(id_, F.explode(F.pandas_udf(split, kind)(F.col(text))).alias("s")).select(id_, "s.*")


def probable_heading(line: Column) -> Column:
    """Short, no end punctuation, each long word capitalised."""
    words = F.split(F.trim(line), r"\s+")
    return (F.size(words).between(1, 8)) & ~F.trim(line).rlike(r"[.!?,;:]$") & F.forall(words, lambda w: (F.length(w) <= 3) | w.rlike("^[A-Z0-9]"))


def omission_signal(text: Column) -> Column:
    """How much a text may hold beyond its claims: sentences, numbers, semicolons."""
    return F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) + F.regexp_count(text, F.lit(r"\d+")) + F.regexp_count(text, F.lit(";"))


#: Scores a judge gives, each from 0 to 1, that an item must reach.
ACCEPT = {"faithfulness": 0.8, "novelty": 0.5, "atomicity": 0.7, "usefulness": 0.5}


def accepted(scores: Column, quote_found: Column) -> Column:
    out = quote_found
    for name, least in ACCEPT.items():
        out = out & (F.coalesce(scores[name], F.lit(0.0)) >= least)
    return out


def judged(rows: DataFrame, make: Callable[[], Callable[[dict], dict]], id_: str, columns: list[str], invalid: Column) -> DataFrame:
    """id, verdict (JSON) of each row; invalid rows are settled without a call."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        for b in batches:
            out = [json.dumps({"score": 0, "reason": "invalid"}) if bad else json.dumps(judge(dict(zip(columns, v)))) for bad, *v in b[["_invalid", *columns]].itertuples(index=False)]
            yield pd.DataFrame({id_: b[id_], "verdict": out})

    kind = rows.schema[id_].dataType.simpleString()
    return rows.withColumn("_invalid", F.coalesce(invalid, F.lit(True))).select(id_, "_invalid", *columns).mapInPandas(run, f"{id_} {kind}, verdict string")
