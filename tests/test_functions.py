"""Column functions on literal rows."""

import difflib
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, measure, parse
from tessera.functions import text as X


def value(spark, column, **columns):
    """The value of a column expression over one row of literals."""
    df = spark.range(1).select(*(v if hasattr(v, "alias") and not isinstance(v, str) else F.lit(v) for v in columns.values()))
    df = df.toDF(*columns) if columns else spark.range(1)
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (X.collapse, "  a  b\n\tc ", "a b c"),
        (X.collapse, None, ""),
        (X.scientific_name, "Parus  major , 1758", "Parus major, 1758"),
        (X.family_name, "Paridae (Tits and Chickadees)", "Paridae"),
        (X.genus, " Parus  major minor", "Parus"),
        (X.binomial, "Parus major minor", "Parus major"),
        (X.key, "Great-Tit's 2", "greattits2"),
        (X.slug, "Great Tit / Blue_x", "great-tit-blue_x"),
        (X.fold_punctuation, "“a”—b’s", "\"a\"-b's"),
        (X.clean, "Seen (Smith et al. 1999) here [12, 13] , ok (see Figure 2).", "Seen here, ok."),
        (X.keep_paragraphs, "a  b\n \n\n c", "a b\n\nc"),
        (X.strip_html, "<p>a&amp;b</p><script>x<y</script><!-- c -->", "a&b"),
        (X.no_control, "a\x07b\nc", "ab\nc"),
        (X.without_fence, "```json\n{}\n```", "{}"),
        (parse.choice, "the answer is c", "C"),
        (parse.choice, "bird", "B"),
        (parse.boolean, "Not true.", False),
        (parse.boolean, "They are conspecific", True),
        (parse.boolean, "unclear", None),
        (parse.short_answer, "The answer is 1,200 to 1,300 meters.", "1200-1300 m"),
        (parse.short_answer, "It was 5 days", "5"),
        (parse.answer, ' {"answer": " B "} ', "B"),
        (parse.answer, 'so "answer" : "x y" then', "x y"),
        (parse.answer, "thus\nAnswer = \"42\"\nend", "42"),
        (parse.answer, " plain ", "plain"),
        (parse.answer, "  ", None),
        (parse.name, "2) “Great-Tit” (Parus)", "great-tit parus"),
        (parse.label, " Great_Tit: x ", "great tit x"),
        (parse.balanced_object, 'so {"a": {"b": "}"}} x', '{"a": {"b": "}"}}'),
        (parse.balanced_object, "none {", None),
    ],
)
def test_scalar(spark, function, given, wanted):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(function(F.col("x")).alias("out")).first().out == wanted


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (X.tokens, "The Great-tit of 12 x", ["great", "tit", "12"]),
        (X.sentences, "One. Two! three; four", ["One.", "Two!", "three;", "four"]),
        (X.multi_value, "a <SEP>b<SEP> ", ["a", "b"]),
        (X.name_variants, "great-tit (x)", ["great-tit (x)", "Great-tit (x)", "great tit (x)", "great-tit"]),
        (parse.choices, "b, D and b", ["B", "D"]),
        (parse.numbers, "1.5 to 20 x, 7", ["1.5-20", "7"]),
        (parse.names, "alba and nigra; its rosea/", ["alba", "nigra", "rosea"]),
        (parse.scientific_names, "A Great tit (Parus major) and Parus major.", ["great tit", "parus major"]),
        (parse.answer_list, '["a", " b", "a"]', ["a", "b"]),
        (parse.answer_list, "1. a\n- b; c", ["a", "b", "c"]),
        (parse.ranked_guesses, "1) x, y\n2. z", ["x", "y", "z"]),
    ],
)
def test_lists(spark, function, given, wanted):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(function(F.col("x")).alias("out")).first().out == wanted


def test_ordered_distinct_keeps_the_first_spelling(spark):
    df = spark.createDataFrame([(["B", "a", "b", "A", "c"],)], "x array<string>")
    assert df.select(X.ordered_distinct(F.col("x"))).first()[0] == ["B", "a", "c"]


def test_masking_is_longest_first_and_literal(spark):
    df = spark.createDataFrame([("the Great Tit (a.b) and tit", ["tit", "great tit", "a.b"])], "t string, n array<string>")
    assert df.select(X.mask("t", F.col("n"))).first()[0] == "the [MASK] ([MASK]) and [MASK]"


def test_field_and_support(spark):
    df = spark.createDataFrame([("Realm: Nearctic; Diet: seeds", "“Eats  Seeds”", 'It "eats seeds" daily')], "a string, q string, c string")
    assert df.select(X.field("a", "diet"), X.supports(F.col("q"), F.col("c")), X.nearly_same(F.lit("abcdefghij"), F.lit("ABCDEFGHI"))).first()[:] == ("seeds", True, True)


def test_stable_ids_keep_missing_parts(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(ids.stable_id("p_", "x", "y", "z")).first()[0] == "p_" + hashlib.sha1(b"a||||c").hexdigest()[:16]
    assert df.select(ids.signature("x", "y")).first()[0] == hashlib.sha256(b"a||").hexdigest()[:16]


def test_typed_fact_ids(spark):
    assert ids.typed_key([1]) == ids.typed_key([1.0]) != ids.typed_key([True])
    assert json.loads(ids.typed_key([0.1, math.nan, math.inf, "x", None]))["value"][0] == {"type": "number", "value": "0.10000000000000001"}
    df = spark.createDataFrame([tuple("abcdef") + ("g", "{}", 3.0, None)], "a string, b string, c string, d string, e string, f string, u string, q string, lo double, hi double")
    got = df.select(ids.typed_fact_id(F.struct("a", "b", "c", "d", "e", "f", "u", "q"), F.struct("lo", "hi"))).first()[0]
    assert got == "fact_" + hashlib.sha1(ids.typed_key([*"abcdef", 3, None, "g", "{}"]).encode()).hexdigest()[:32]


def test_measures(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "b", "c"], [], [3.0, 4.0], "kitten", "sitting")], "x array<string>, y array<string>, e array<string>, v array<double>, s string, t string")
    got = df.select(
        measure.token_f1(F.col("x"), F.col("y")), measure.set_f1(F.col("x"), F.col("y")), measure.set_f1(F.col("e"), F.col("e")), measure.set_f1(F.col("e"), F.col("x")),
        measure.normalized(F.col("v")), measure.ratio(F.col("s"), F.col("t")), measure.safe_div(F.lit(1), F.lit(0)), measure.clamp(F.lit("1.7")), measure.overlap(F.col("x"), F.col("y")),
    ).first()
    assert got[0] == pytest.approx(4 / 6) and got[1] == 0.5 and got[2:4] == (1.0, 0.0) and got[4] == [0.6, 0.8] and got[5] == pytest.approx(8 / 13) and got[6:8] == (0.0, 1.0) and got[8] == 0.5


def test_close_matches(spark):
    df = spark.createDataFrame([("aple",), ("zzz",)], "x string")
    assert [r[0] for r in df.select(measure.close_matches(F.col("x"), ["apple", "maple", "pear"])).collect()] == [difflib.get_close_matches("aple", ["apple", "maple", "pear"], 3, 0.72), []]


def test_quantities(spark):
    df = spark.createDataFrame([("Length 14-16 cm, mass 20 g; 14-16 cm again, 3 eggs",)], "x string")
    got = [(q.kind, q.value_min, q.value_max, q.unit) for q in df.select(measure.quantities(F.col("x"))).first()[0]]
    assert got == [("length", 14.0, 16.0, "cm"), ("mass", 20.0, 20.0, "g"), ("count", 3.0, 3.0, "eggs")]


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "id int, t array<string>")
    rows = measure.dense(measure.hash_vectors(df, "id", F.col("t"), 16), "id", 16).collect()
    for r in rows:
        want = [0.0] * 16
        for token in {1: "aba", 2: "c"}[r.id]:
            h = int(hashlib.sha1(token.encode()).hexdigest()[:8], 16)
            want[h % 16] += 1.0 if (h >> 31) % 2 == 0 else -1.0
        norm = math.sqrt(sum(x * x for x in want))
        assert r.vector == pytest.approx([x / norm for x in want])


def test_json_values(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('```json\n{"a": 2}\n```',), ('text {"a": 3} more',), ("none",)], "x string")
    assert [r[0] for r in df.select(parse.json_value(F.col("x"), "$.a")).collect()] == ["1", "2", "3", None]
    assert df.select(parse.order_and_family(F.lit("Order: Passeriformes, family = Paridae"))).first()[0].asDict() == {"order": "Passeriformes", "family": "Paridae"}


def test_object_types(spark):
    df = spark.createDataFrame([("3.5",), ("taxon_1",), ("Yes",), ("blue",)], "x string")
    assert [r[0] for r in df.select(measure.object_type(F.col("x"), F.array(F.lit("taxon_1")))).collect()] == ["number", "concept", "boolean", "text"]
