"""Checklists, scopes, kinds and representatives on literal rows: missing columns, nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import records


def test_checklist_needs_its_columns(spark):
    with pytest.raises(ValueError, match="AvibaseID, BOW, Order"):
        records.checklist(spark.createDataFrame([("x",)], "Family string"), [("f", "Family", "family"), ("o", "Order", "name"), ("a", "AvibaseID", "id"), ("b", "BOW", "text")], "A", "v")


def test_first_checklist(spark):
    names = [c for _, c, _ in records.CHECKLIST_A]
    cells = {"Taxon_rank": "Species", "Order": "Passeriformes ", "Family": "Paridae (Tits)", "Scientific_name": "Parus  major", "Species_code_Cornell_Lab": "GreTit1", "AvibaseID": "avibase-ab12"}
    sheet = spark.createDataFrame([tuple(cells.get(n) for n in names), (None,) * len(names)], ", ".join(f"`{n}` string" for n in names))
    first, blank = records.checklist(sheet, records.CHECKLIST_A, "A", "v").collect()
    assert (first["rank"], first.order_name, first.family_name, first.scientific_name, first.cornell_species_code, first.avibase_id, first.genus_name) == ("species", "Passeriformes", "Paridae", "Parus major", "gretit1", "AB12", "Parus")
    assert blank.scientific_name == "" and blank.genus_name == ""


def test_scope(spark):
    rows = spark.createDataFrame([(1, "f", "o"), (2, "", "o"), (3, None, "o"), (4, "g", "o"), (5, None, None)], "id int, family string, order string")
    families, orders = spark.createDataFrame([("f",), ("f",), (None,)], "family string"), spark.createDataFrame([("o",), ("o",)], "order string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(records.in_scope(rows, families, orders, "family", "order")) == [1, 2, 3]
    assert ids(records.in_scope(rows, families, orders, "family", "order", full=True)) == [1, 2, 3, 4, 5]
    assert ids(records.in_scope(rows, families.limit(0), orders.limit(0), "family", "order")) == []


def test_chapters(spark):
    rows = spark.createDataFrame([("Overview",), ("  Conservation   Status ",), ("x",), ("",), (None,)], "c string")
    assert [r.f for r in rows.select(records.family_chapter("c").alias("f")).collect()] == ["Introduction", "Conservation", "Unknown", "Unknown", "Unknown"]
    got = rows.select(records.subchapter("c", records.family_chapter("c"), F.lit("Habitat")).alias("s")).collect()
    assert [r.s for r in got] == ["Introduction", "Conservation", "x", "Unknown", "Unknown"]


def test_representatives(spark):
    rows = [(1, "exact", "a", 1), (2, "exact", "a", 0), (3, "exact", "b", 5), (4, "conflict", "a", 9), (5, "conflict", "b", 9), (6, "conflict", "c", 9), (7, "other", "z", 0), (8, "other", "z", 0)]
    made = spark.createDataFrame(rows, "id int, kind string, unit string, place int")
    pick = lambda df, least: sorted(r.id for r in records.representatives(df, "id", "kind", "unit", ["place"], least=least).collect())
    assert pick(made, 0) == [2, 3, 4, 5]
    assert pick(made, 6) == [2, 3, 4, 5, 7, 8]
    assert pick(made, 20) == [r[0] for r in rows]
    assert pick(made.limit(0), 5) == []


def test_answers_without_scores(spark):
    answers, scores = spark.createDataFrame([(1, "m"), (2, "m"), (3, "n")], "q int, model string"), spark.createDataFrame([(1, 7.126, 1), (9, 1.0, 0)], "q int, score double, invalid int")
    assert sorted(map(tuple, records.answer_summary(answers, scores, "q", ["model"], "score", "invalid").collect())) == [("m", 2, 1, 1, 7.13), ("n", 1, 0, 0, 0.0)]


def test_markdown_says_what_it_leaves_out(spark):
    from tessera.sources import sinks

    rows = spark.range(3)
    assert sinks.markdown(rows, 3) == "| id |\n| --- |\n| 0 |\n| 1 |\n| 2 |"
    assert sinks.markdown(rows.orderBy("id"), 2) == "| id |\n| --- |\n| 0 |\n| 1 |\n\nOnly the first 2 rows are shown."
