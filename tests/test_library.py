"""Operators, sources, sinks and streams that the registered queries do not reach."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import consolidate, extract, graph, match, quality, ranks, retrieve, scoring, tables, windows
from tessera.sources import files, sinks
from tessera.streaming import incremental


def test_qualifiers(spark):
    df = spark.createDataFrame([({"sex": " Adult  Male", "life_stage": "immature", "breeding_status": "nonbreeding", "season": None},)], "q map<string,string>")
    got = df.select(consolidate.qualifiers(F.col("q")).alias("q")).first().q.asDict()
    assert got == {"sex": "male", "life_stage": "juvenile", "season": "", "breeding_status": "non-breeding", "subspecies": "", "region_scope": "", "frequency": ""}


def test_evidence(spark):
    df = spark.createDataFrame([("d", "c", "ch", " a  quote ")], "source_doc_id string, source_chunk_id string, source_chapter string, evidence_quote string")
    r = consolidate.evidence_of(df).first()
    assert r.evidence_quote == "a quote" and r.evidence_id.startswith("evidence_") and len(r.evidence_id) == 25


def test_exclusive_cascade_stops_at_ambiguity(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    direct = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id int, target string")
    alias = spark.createDataFrame([(2, "c"), (3, "c"), (3, "c")], "id int, target string")
    got = {r.id: (r.target, r.method, r.status) for r in match.exclusive_cascade(left, "id", [("direct", direct), ("alias", alias)]).collect()}
    assert got == {1: ("a", "direct", "resolved"), 2: (None, "direct", "ambiguous"), 3: ("c", "alias", "resolved")}


def test_contained_tokens(spark):
    t = spark.createDataFrame([("tit",), ("owl",)], "token string")
    d = spark.createDataFrame([("Great Tit",), ("Titmouse",), ("Crow",)], "name string")
    assert {(r.token, r.name) for r in match.contained_tokens(t, "token", d, "name", 1).collect()} == {("tit", "Great Tit")}


def test_places_over_many_buckets(spark, monkeypatch):
    df = spark.range(0, 150_000, 3).selectExpr("(id * 7919) % 150000 as id")
    rows = ranks.with_place(df, ["id"]).orderBy("id").collect()
    assert [r.place for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_nearest_vectors_by_blocks_of_queries(spark, most):
    value = lambda i, j: ((i * 31 + j * 17) % 13) / 13 - 0.4
    vectors = {i: [value(i, j) for j in range(4)] for i in range(60)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    asked = df.where("id % 3 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    got = {(r.q_id, r.id): (r["rank"], r.score) for r in retrieve.vector_top_k(asked, "q_id", "q", df, "id", "v", 5, most).collect()}
    want = {}
    for q in range(0, 60, 3):
        scores = sorted((-round(sum(a * b for a, b in zip(vectors[q], v)), 6), i) for i, v in vectors.items())
        want |= {(q, i): (n + 1, -s) for n, (s, i) in enumerate(scores[:5])}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
    assert retrieve.vector_top_k(asked.limit(0), "q_id", "q", df, "id", "v", 5, most).count() == 0


def test_longest_first():
    got = windows.longest_first({"a": 5, "b": 4, "c": 3, "d": 3}, 2)
    assert sorted(sum(n for g, n in {"a": 5, "b": 4, "c": 3, "d": 3}.items() if got[g] == k) for k in (0, 1)) == [7, 8]


def test_diverse_backfills(spark):
    df = spark.createDataFrame([("q", 1, "s", "a"), ("q", 2, "s", "b"), ("q", 3, "t", "a"), ("q", 4, "u", "c")], "q string, rank int, source string, key string")
    got = [(r.place, r["rank"]) for r in windows.diverse(df, "q", "rank", "source", "key", 3, 1).orderBy("place").collect()]
    assert got == [(1, 1), (2, 4), (3, 2)]


def test_quota_rerank(spark):
    df = spark.createDataFrame([("q", 9.0, "x"), ("q", 8.0, "x"), ("q", 7.0, "y")], "q string, score double, kind string")
    got = {r.score: r.place for r in windows.quota_rerank(df, "q", "score", "kind", {"x": 1}).collect()}
    assert got == {9.0: 1, 7.0: 2, 8.0: 3}


def test_context_stops_at_the_budget(spark):
    df = spark.createDataFrame([("q", 1, "aaaa"), ("q", 2, "bbbb"), ("q", 3, "c")], "q string, r int, t string")
    r = retrieve.context(df, "q", [F.col("r")], F.col("t"), 12).first()
    assert (r.context, r.blocks) == ("aaaa\n\nbbbb", 2)


def test_headers():
    assert tables.unique_names(["a", "a", None, "a"]) == ["a", "a__1", "column", "a__2"]
    assert tables.merged_header(["Mass", "", "Name"], ["min", "max", "Name"]) == ["Mass min", "Mass max", "Name"]
    assert tables.looks_like_header(["x", "Unnamed: 1", "Unnamed: 2", ""], ["Order", "Family", "Genus", "Species"], ["order", "family", "genus", "species"])
    assert tables.resolve(["Latin Name", "IUCN (2023)"], ["latin_name"]) == "Latin Name" and tables.resolve(["Latin Name", "IUCN (2023)"], ["iucn"]) == "IUCN (2023)" and tables.resolve(["a"], ["zz"]) is None


def test_questions_become_constraints():
    ask = tables.parse("Which non-migratory heavy birds live in the Eastern Palearctic or Nearctic?", {"realm": ["Palearctic", "Eastern Palearctic", "Nearctic", "Oriental"]}, {"migratory": "mig"}, {"heavy": ("mass", ">=", 0.8)})
    assert ask.values == {"realm": ["Eastern Palearctic", "Nearctic"]} and ask.flags == {"mig": False} and ask.quantiles == {"mass": (">=", 0.8)}
    assert not tables.Constraints().effective()


def test_flags_and_groups(spark):
    df = spark.createDataFrame([("1", "a", "b"), ("0.0", "b", "a"), ("yes", "c", "c"), (None, "a", "a")], "f string, x string, y string")
    assert tables.answer(df, tables.Constraints(flags={"f": True})).count() == 2
    assert tables.answer(df, tables.Constraints(flags={"f": False}, any_of=[(["x", "y"], ["A"])])).count() == 2
    assert tables.answer(df, tables.Constraints()).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([("Monotypic", "it is monotypic"), ("about 12 eggs", "12"), ("yes", "no"), ("blue head", "blue tail"), ("A, C", "c a")], "a string, b string")
    got = [r[0].f1 for r in df.select(scoring.short_answer_score(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [1.0, 1.0, 0.0, 0.5]
    ranks = spark.createDataFrame([(["x", "2. Parus Major", "y"], "Great tit (Parus major)"), (["x"], "y")], "g array<string>, b string")
    assert [r[0] for r in ranks.select(scoring.gold_rank(F.col("g"), F.col("b"))).collect()] == [2, None]
    em, f1 = scoring.multiple_choice(F.col("a"), F.col("b"))
    assert df.where("a = 'A, C'").select(em, f1).first()[:] == (1, 1.0)
    hits = spark.createDataFrame([(1,), (3,), (None,)], "rank int")
    r = scoring.recall_at(hits, "rank", [1, 5]).first()
    assert r.recall_1 == pytest.approx(1 / 3, abs=1e-6) and r.recall_5 == pytest.approx(2 / 3, abs=1e-6) and r.median_rank == 2


def test_corrupt_rows(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1}',), ("[1]",), ("{",), (" ",)], "value string")
    assert quality.corrupt_rows(df, "value", ["a", "b"]).first()[:] == (5, 4, 1, 1, 1)


def test_guard(spark):
    df = spark.createDataFrame([(1, "x"), (2, "gold")], "id int, prompt string")
    assert quality.guard(df.where("id = 1"), ~F.contains("prompt", F.lit("gold")), "leak").count() == 1
    with pytest.raises(Exception, match="leak"):
        quality.guard(df, ~F.contains("prompt", F.lit("gold")), "leak").collect()


def test_sections_and_headings(spark):
    df = spark.createDataFrame([(1, "intro\n# A\none\ntwo\n# B\n")], "id int, t string")
    assert [(r.section, r.heading, r.body) for r in extract.sections(df, "id", "t", "^# ").orderBy("section").collect()] == [(0, "", "intro"), (1, "# A", "one\ntwo"), (2, "# B", "")]
    lines = spark.createDataFrame([("Diet and Foraging",), ("it eats seeds.",)], "l string")
    assert [r[0] for r in lines.select(extract.probable_heading(F.col("l"))).collect()] == [True, False]


def test_extractors(spark):
    df = spark.createDataFrame([(1, "eats seeds and eats ants", ["EATS"]), (2, None, ["EATS"]), (3, "eats x", ["OTHER"])], "id int, t string, p array<string>")
    rules = [("EATS", r"eats (\w+)", 0.8)]
    rows = extract.claims(df, lambda: extract.RuleExtractor(rules), "id", "t", "p").collect()
    assert [(r.id, r.position, r.object_text) for r in rows] == [(1, 0, "seeds"), (1, 1, "ants")]
    assert extract.claims(df, extract.NoExtractor, "id", "t").count() == 0

    class Failing:
        def extract(self, text, routing):
            raise RuntimeError("no service")

    failed = extract.claims(df, Failing, "id", "t").collect()
    assert len(failed) == 3 and all("no service" in r.error and r.position is None for r in failed)


def test_judge(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "id int, t string")
    rows = extract.judged(df, lambda: lambda r: {"score": len(r["t"])}, "id", ["t"], F.col("t") == "").collect()
    assert {r.id: r.verdict for r in rows} == {1: '{"score": 1}', 2: '{"score": 0, "reason": "invalid"}'}


def test_neighbours_without_second_hop(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x")], "source string, target string, type string")
    anchors = spark.createDataFrame([("a",)], "node string")
    assert [tuple(r) for r in graph.two_hops(e, anchors).collect()] == [("a", "b", "c")]


def workbook_bytes():
    raw = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Mass</t></si><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>1.5</v></c><c r="B2"><v>2</v></c><c r="C2" t="inlineStr"><is><t>tit</t></is></c></row><row/></sheetData></worksheet>')
    return raw.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes())
    rows = files.workbook(spark, f"file://{tmp_path}/w.xlsx", "One").collect()
    assert [r.asDict() for r in rows] == [{"_ord": 1, "Mass": "1.5", "column": "2", "Name": "tit"}]
    with pytest.raises(ValueError, match="no sheet"):
        files.parse_workbook(workbook_bytes(), "Two")


def test_sources(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert files.jsonl(spark, f"{root}/none", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.jsonl_strict(spark, f"{root}/none", "a int")
    for k in (0, 2):
        (tmp_path / f"shard_{k}").mkdir()
        (tmp_path / f"shard_{k}" / "x.jsonl").write_text('{"a": %d}\n' % k)
    rows = files.shards(spark, root, "x.jsonl", "a int")
    assert sorted((r.a, r.shard) for r in rows.collect()) == [(0, 0), (2, 2)]
    assert files.first_existing(spark, [f"{root}/none", f"{root}/shard_0"]) == f"{root}/shard_0"
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception):
        files.jsonl_strict(spark, f"{root}/bad.jsonl", "a int").collect()
    with pytest.raises(ValueError, match="missing columns: b"):
        files.required(rows, ["a", "b"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", ["x", "y"])], "id int, t string, l array<string>")
    assert sinks.markdown(df.select("id", "t")) == "| id | t |\n| --- | --- |\n| 1 | a\\|b |"
    assert sinks.sanitized(df).first().l == "x; y"
    sinks.document(spark, {"k": 1}, f"file://{tmp_path}/d.json")
    assert '"k": 1' in (tmp_path / "d.json").read_text()
    sinks.write_index(df, f"file://{tmp_path}/i", "p", "m", 3)
    with pytest.raises(ValueError, match="embedding_dim"):
        sinks.read_index(spark, f"file://{tmp_path}/i", "p", "m", 4)


def test_ledgers(spark):
    ledger = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(ValueError, match="repeated keys"):
        incremental.no_repeats(ledger, ["id"])


def test_routing(spark):
    from tessera.operators import routing

    df = spark.createDataFrame([("Diet_and  Foraging",), ("Acknowledgements",), ("nothing",), ("INTRODUCTION",), (None,)], "chapter string")
    rows = routing.routed(df, "chapter").collect()
    assert [(r.skip, len(r.domains), r.max_claims) for r in rows] == [(False, 1, 4), (True, 0, 0), (True, 0, 0), (False, 6, 2), (True, 0, 0)]
    assert rows[0].predicates == ["EATS_CATEGORY", "EATS_ITEM", "FORAGES_BY", "FORAGES_IN_STRATUM", "HAS_ECOLOGICAL_ROLE"]
    claims = spark.createDataFrame([("Habitat", "INHABITS_BIOME"), ("Habitat", "EATS_ITEM")], "domain string, predicate string")
    assert routing.allowed(claims, "predicate", "domain").count() == 1
    assert sum(len(p) for p in routing.PREDICATES.values()) == 74
    assert routing.route_table(spark).count() == len(routing.ROUTES)
