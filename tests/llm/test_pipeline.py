"""The pipeline's stages on a small table: each one's decisions take effect and clean documents stay."""

import re

import corpus_pipeline
from tessera.llm import op4_ngram_join
from tessera.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.table(stage(spark, before, SF), name)
        if name != "packing":
            assert after.columns == columns and after.dtypes == docs.dtypes
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            assert op4_ngram_join.classes(after).where("doc_id <> component_id").count() == 0
            assert after.count() == op4_ngram_join.classes(before).where("doc_id = component_id").count()
        if name == "repeats":
            seen = set()
            for r in sorted(after.collect(), key=lambda r: r.doc_id):
                w = r.text.split()
                windows = {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
                assert not windows & seen or r.text in {x.text for x in before.where(f"doc_id = {r.doc_id}").collect()}
                seen |= windows
        if name == "leaks":
            norm = lambda t: " ".join(re.sub(r"[^a-z0-9 ]", " ", t.lower()).split())
            items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i and i in norm(r.text) for r in after.collect() for i in items)
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()


def test_stages_on_odd_rows(spark, docs, empty):
    """Nulls, empty and long texts, copies, rows of one id, and columns named like what the stages add."""
    assert {"score", "leaks", "kept"} <= set(docs.columns)
    rows = docs.unionByName(spark.createDataFrame([(9, "quite another text under an id that others have", "en", "s0", 3, 1, 1, 0.25, "t", 1, 1, 1, "x", "y")], docs.schema))
    for table in (rows, empty):
        before = table
        for name, stage in corpus_pipeline.STAGES[1:]:
            after = Scratch(spark, "test_odd").table(stage(spark, before, SF), name)
            if name != "packing":
                assert after.dtypes == table.dtypes
            before = after
        if table is empty:
            assert after.count() == 0
    kept = corpus_pipeline.near_duplicates(spark, rows, SF)
    got = [(r.doc_id, r.text, r.score, r.leaks, r.kept) for r in kept.collect()]
    assert sum(i == 9 and t == "one" for i, t, *_ in got) == 1 and sum(i == 9 and (t or "").startswith("quite") for i, t, *_ in got) == 1
    assert sorted(i for i, t, *_ in got if not (t or "").strip() and i is not None) == [0, 3, 6]
    assert {r[2:] for r in got} == {(0.5, "l", "k"), (0.25, "x", "y")}
    base = [r.doc_id for r in rows.collect() if r.text and len(r.text.split()) == 200]
    assert sum(i in base for i, *_ in got) < len(base)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    import pytest

    from tessera.llm.common import shared_dir

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
