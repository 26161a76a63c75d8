"""Context, planning, candidates, claims and checks beyond what their queries' SQL reaches."""

import difflib

from pyspark.sql import functions as F

from tessera.operators import candidates, checks, claims, context, planning


def test_notes_say_something_else_once(spark):
    edges = [
        (1, "a", "b", "Great tit", "oak", "lives in oaks", "tree", 2.0, "s2"), (2, "a", "c", "Great tit", "Moth", "eats moths", "", 1.0, "s1"), (3, "a", "b", "Great tit", "oak", "nests in oaks", "", 0.5, "s1"), (4, "a", "d", "Great tit", "", "", "", 9.0, "s1"), (5, "z", "c", "x", "y", "q", "", 9.0, "s1"),
    ]
    edges = spark.createDataFrame(edges, "edge_id int, source string, target string, subject string, object string, description string, keywords string, weight double, source_id string")
    own = F.when(F.col("object") == "oak", "old tree<SEP>dry oak").when(F.col("object") == "Moth", "eats moths").otherwise("")
    edges = edges.withColumns({"object_description": own, "object_source_id": F.lit("s1<SEP>s2")})
    nodes = spark.createDataFrame([("a", "Great  Tit", ["Species"], "creature", "d"), ("b", "great tit x", [], "", "")], "node_id string, entity_id string, labels array<string>, entity_type string, description string")
    asked = spark.createDataFrame([(1, "great tit", "where does it eat and nest", ["tree"]), (2, "it x", "", [])], "query_id int, target string, question string, domain_keywords array<string>")
    found = {r.query_id: (r.node_id, r.score) for r in context.anchors(asked, nodes, ("Species", "creature"), "creature").collect()}
    assert found == {1: ("a", 111.0), 2: ("b", 10.0)}
    got = {r.query_id: r.context for r in context.one_hop(asked, nodes, edges, ("Species",), "creature", notes=6).collect()}
    assert got[1] == "[Graph relation facts]\n- lives in oaks\n- eats moths\n- nests in oaks\n\n[Brief related-node notes]\n- oak: dry oak"
    assert got[2].endswith("- nests in oaks\n\n[Brief related-node notes]\n- oak: dry oak")


def test_fuzzy_targets(spark):
    names = [("Great tit", 1), ("Parus major", 1), ("Blue tit", 2), ("Blue tip", 3), ("Ox", 4)]
    asked = [(1, "", "Grat tit"), (2, "", "blue tit"), (3, "", "blue tib"), (4, "zzz", ""), (5, "tell of the great  TIT, please", ""), (6, "great tit or ox", ""), (7, "", "")]
    rows = planning.resolve(spark.createDataFrame(asked, "query_id int, question string, explicit string"), spark.createDataFrame(names, "name string, target_id int")).collect()
    assert {r.query_id: (r.method, r.target_id, r.candidates) for r in rows} == {1: ("fuzzy", 1, None), 2: ("exact", 2, None), 3: ("ambiguous", None, [2, 3]), 4: ("unresolved", None, None), 5: ("mention", 1, None), 6: ("ambiguous", None, [1, 4]), 7: ("unresolved", None, None)}
    assert difflib.SequenceMatcher(None, "blue tib", "blue tip").ratio() >= planning.FUZZY


def test_plans_and_their_problems(spark):
    have = {"domains": ["b", "a"], "predicates": ["P", "Q"], "chapters": ["Diet and Foraging", "Habitat", "Diet"]}
    resolved = spark.createDataFrame([(1, 5), (2, None)], "query_id int, target_id int")
    asked = spark.createDataFrame([(1, "what do great tits eat in the woods"), (2, "")], "query_id int, question string")
    routes = spark.createDataFrame([(q, "diet", ["b", "x", "a"], ["Q", "Z", "P"], ["none"], ["diet", "foraging"]) for q in (1, 2)], "query_id int, intent string, domains array<string>, predicates array<string>, chapters array<string>, hints array<string>")
    plan = planning.planned(resolved, asked, routes, have)
    r = plan.collect()
    assert len(r) == 1 and (r[0].domains, r[0].predicates, r[0].chapters) == (["a", "b"], ["Q", "P"], ["Diet and Foraging", "Diet"]) and "eat" in r[0].terms
    bad = spark.createDataFrame([(1, None, ["a", "u"], ["P"], ["v"])], "query_id int, target_id int, domains array<string>, predicates array<string>, chapters array<string>")
    assert planning.problems(bad, have).first().problems == ["no target", "unknown domains: u", "unknown chapters: v"]
    assert planning.problems(plan, have).first().problems == []


def test_evidence_sentences(spark):
    rows = [(1, 0, "Short."), (1, 1, "The adult male has a bright crown and a long pale bill in spring."), (1, 2, "As said by Smith et al. 1999 (p. 1) (p. 2), the adult male has a crown and bill."), (2, 0, "introduction to the birds of the northern woods and hills")]
    df = spark.createDataFrame(rows, "id int, place int, s string")
    score = candidates.sentence_score(F.col("s"), F.lit("Field marks"), ["crown"], ["marks"], [(r"\b(male|female)\b", 2.5)], F.array(F.lit("bright"), F.lit("bill"), F.lit("of")), ["bill"], [r"\b[A-Z][a-z]+ et al\.", r"\b\d{4}\b"], ["introduction"])
    got = {(r.id, r.place): r.score for r in df.select("id", "place", score.alias("score")).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 2 + 5 + 2 + 2.5 + 1.4, (1, 2): 2 + 5 + 2 + 2.5 - 24 - 3, (2, 0): 2 + 2 - 4}
    best = candidates.best_sentence(df.withColumn("score", score), ["id"], "score", "place", "s", 20)
    assert {r.id: r.snippet for r in best.collect()} == {1: "The adult male has a", 2: "introduction to the "}


def test_claim_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(claims.snippet(F.lit("A photo by Smith, J. and Jones in 1999 of  a nest"))) == "A by in of a nest"
    assert one(claims.value_text(F.lit(" "), F.lit(None).cast("string"), F.lit(3), F.lit(5), F.lit("g"))) == "3-5 g"
    assert one(claims.value_text(F.lit(None).cast("string"), F.lit(" red  one"), F.lit(3), F.lit(5), F.lit("g"))) == "red one"
    assert one(claims.first_sentence(F.lit("It eats moths.  And more."))) == "It eats moths."
    empty = spark.createDataFrame([], "fact_id int, evidence_id int")
    assert {(r.id, r.error) for r in checks.fact_links(spark.createDataFrame([(1,)], "fact_id int"), empty, empty).collect()} == {("1", "no evidence")}
