"""Every registered query against its SQL, by DuckDB on the same tables."""

import hashlib
import re
import unicodedata
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.functions.text import STOPWORDS
from tessera.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (np.isscalar(v) and pd.isna(v)) else v.item() if isinstance(v, np.generic) else v
    rows = [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ordered(got), ordered(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or (isinstance(p, float) and abs(p - q) < 1e-9) or str(p) == str(q) for p, q in zip(x, y)), (x, y)


@pytest.fixture(scope="module")
def odd_texts(spark, folder, tmp_path_factory):
    """Documents and turns with their own and further texts: null, empty, other scripts, blanks and marks."""
    out = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "Ça va: été_2024 — ÑANDÚ", "a\u00a0b\u2003 c\t", "中文 mixed 12 words", "e\u0301a STRASSE straße", "naïve café", "naive cafe", "naïve cafés"]
    docs, turns = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "role", "turn", "text")
    docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], docs.schema)).write.parquet(f"{out}/documents.parquet")
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "turn long, text string").selectExpr("-1 as conv_id", "'user' as role", "turn", "text")
    turns.unionByName(odd.select(*(odd[f.name].cast(f.dataType) for f in turns.schema))).write.parquet(f"{out}/conversations.parquet")
    return out


def test_normalized_text_of_all_rows(spark, odd_texts):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    blank = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    in_word = lambda c: c.isalnum() or unicodedata.category(c)[0] == "M"
    want = []
    for r in spark.read.parquet(f"{odd_texts}/documents.parquet").collect():
        t = r.text or ""
        slug = re.sub("-+", "-", "".join(c if in_word(c) else "-" for c in t.lower())).strip("-")
        want.append((r.doc_id, md5(re.sub(blank, " ", t).strip(" ")), md5(slug), re.sub("[^a-z0-9]", "", t.lower())))
    got = QUERIES["normalized_text"](spark, odd_texts).select("doc_id", "collapsed", "slug", "plain_key").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts_and_terms_of_all_rows(spark, odd_texts):
    want = []
    for r in spark.read.parquet(f"{odd_texts}/documents.parquet").collect():
        t = r.text or ""
        terms = sorted({w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 3 and w not in STOPWORDS})[:16]
        want.append((r.doc_id, len(re.findall("[\u4e00-\u9fff]|[A-Za-z0-9]+", t)), " ".join(terms)))
    got = QUERIES["token_counts_and_terms"](spark, odd_texts).select("doc_id", "n", "terms").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_duplicate_turns_of_all_rows(spark, odd_texts):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    blocks = {}
    for r in spark.read.parquet(f"{odd_texts}/conversations.parquet").where("conv_id % 20 = 0 or conv_id < 0").collect():
        blocks.setdefault((r.conv_id, r.role), []).append((r.turn, r.text))
    want = {}
    for (c, role), rows in blocks.items():
        for (i, a), (j, b) in combinations(sorted(rows, key=lambda x: x[0]), 2):
            if i < j and a is not None and b is not None and a + b and (s := 1 - edits(a, b) / max(len(a), len(b))) >= 0.25:
                want[c, role, i, j] = s
    got = {(r.conv_id, r.role, r.turn_a, r.turn_b): r.similarity for r in QUERIES["near_duplicate_turns_by_edits"](spark, odd_texts).where("conv_id % 20 = 0 or conv_id < 0").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and any(k[0] == -1 for k in got)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
