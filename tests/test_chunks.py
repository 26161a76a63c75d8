"""Names, evidence, further claims and chunks on literal rows, and key sentences against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions import text as X
from tessera.operators import audits, chunks, evidence, supplements
from tessera.plans import QUERIES


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (X.without_marks, "Seen (Smith et al., 1999) here [12, 13]  and photo (Fig. 2) Plate 7.", "Seen here and ."),
        (X.without_marks, None, ""),
        (names.rank, " SSP  ", "subspecies"),
        (names.rank, None, ""),
        (names.record_name, "Parus  major Scientific name definitions", "Parus major"),
        (names.table_name, " Great-Tit's (m) ", "great-tit s  m"),
        (names.status, "cr", "Critically Endangered"),
        (names.status, None, "Not Evaluated"),
        (names.status, " Extinct ", "Extinct"),
        (lambda c: names.lookup_key(c, "family_name"), "Paridae (Tits)", "paridae"),
        (lambda c: names.lookup_key(c, "species_code"), " GreTit1 ", "gretit1"),
        (lambda c: names.lookup_key(c, "other"), " A  b ", "a b"),
        (lambda c: F.array_join(names.bracketed_codes(c), ","), "x (AF, NA) y (no) (NA,OZ)", "AF,NA,OZ"),
        (lambda c: F.array_join(names.bracketed_codes(c), ","), None, ""),
        (lambda c: F.array_join(X.retrieval_tokens(c), " "), "The great-tit’s Nest, a 2nd | x photo", "great-tit's nest 2nd"),
        (chunks.preview, " a\nb ", "a b"),
        (chunks.preview, None, ""),
    ],
)
def test_functions(spark, function, value, expected):
    rows = spark.createDataFrame([(value,)], "c string")
    assert rows.select(function(F.col("c")).alias("x")).first().x == expected


def brute_sentences(text, words, most):
    text, kept, total = (text or "").strip(" "), [], 0
    for s in (s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text)):
        if s and any(w in s.lower() for w in words):
            if total + len(s) + 1 > most:
                break
            kept.append(s)
            total += len(s) + 1
    return " ".join(kept) or text[:most]


def test_key_sentences(spark, folder):
    want = {r.doc_id: brute_sentences(r.text, ["tion", "hab", "nest"], 300) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.evidence for r in QUERIES["key_sentences"](spark, folder).collect()}
    assert got == want
    odd = [None, "", "nest. " * 80, "No. Nest here! nest", "short"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", chunks.key_sentences(F.col("t"), ["nest"], 20).alias("e")).collect()
    assert [r.e for r in rows] == [brute_sentences(t, ["nest"], 20) for t in odd]


def test_facts_and_links_without_columns_or_rows(spark):
    bare = spark.createDataFrame([(None,), (" 7 ",)], "id string")
    assert [(r.fact_id, r.fact_domain, r.predicate, r.confidence) for r in evidence.facts_of(bare).collect()] == [("", "GeneralFacts", "", 0.0), ("7", "GeneralFacts", "", 0.0)]
    odd = spark.createDataFrame([("x", "none")], "fact_id string, confidence string")
    assert evidence.facts_of(odd).first().confidence == 0.0
    edges = spark.createDataFrame([(None, "fact:a", "evidence:b"), ("HAS_EVIDENCE", "c", "evidence_d"), ("OTHER", "e", "f"), (None, None, "g"), (None, "h", "")], "type string, source string, target string")
    assert sorted(map(tuple, evidence.links_of(edges).collect())) == [("a", "b"), ("c", "evidence_d")]
    assert evidence.links_of(edges.limit(0)).count() == 0


def test_completion_of_any_status(spark):
    rows = spark.createDataFrame([("ok", 3), ("ok", 2), ("ok", None), ("dry_run", 9), (None, 9), ("error", None)], "status string, n int")
    got = rows.select(supplements.completion(F.col("status"), F.col("n"), 3).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [
        (1, 3, True, "completed_round_1_hit_soft_cap"), (1, 2, False, "completed_round_1_not_hit_cap"), (1, 0, False, "completed_round_1_not_hit_cap"),
        (0, 0, False, "dry_run"), (0, 0, False, "failed_round_1"), (0, 0, False, "failed_round_1"),
    ]


def test_examples_fall_back_to_the_first_of_all(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "item int, kind string")
    pool = spark.createDataFrame([(10, "a"), (11, "a"), (12, "a"), (13, "c")], "example int, kind string")
    got = sorted(map(tuple, chunks.examples(items, pool, "item", "kind", "example").collect()))
    assert got == [(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 11, 2), (3, 10, 1), (3, 11, 2)]
    assert chunks.examples(items, pool.limit(0), "item", "kind", "example").count() == 0


def test_context_of_few_sections_is_the_whole_text(spark):
    whole = spark.createDataFrame([(1, "long text"), (2, None)], "k int, body string")
    sections = spark.createDataFrame([(1, 0, 1.0, "x"), (1, 1, 2.0, "y")], "k int, id int, score double, body string")
    assert sorted(map(tuple, chunks.source_context(sections, whole, "k", "id", "body", least=4).collect())) == [(1, "y\n\nx"), (2, "")]
    assert sorted(map(tuple, chunks.source_context(sections, whole, "k", "id", "body", least=5).collect())) == [(1, "long text"), (2, "")]


def test_group_caps_without_caps(spark):
    rows = spark.createDataFrame([("g", 3, 0), ("", 1, 1), (None, 1, 1)], "g string, v int, c int")
    assert [tuple(r) for r in audits.group_caps(rows, "g", "v", "c").collect()] == [("g", 1, 3, 0, 0, 0, 3.0, 0.0)]
