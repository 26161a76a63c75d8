"""Text functions, labels, extraction and scores on documents, pages, conversations and benchmark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids, measure, parse
from tessera.functions import text as X
from tessera.operators import extract, match, scoring
from tessera.plans.registry import Tables, query

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _tokens(c: str, least: int = 2) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: length(t) >= {least} AND t NOT IN ({_STOP}))"


#: Blanks, and characters of words, as RE2 classes.
_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NO_WORD = r"[^\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]+"


@query(f"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g'))) AS collapsed, md5(trim(regexp_replace(lower(replace(coalesce(text, ''), '_', '-')), '{_NO_WORD}', '-', 'g'), '-')) AS slug, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g') AS plain_key FROM documents""")
def normalized_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.collapse("text").cast("binary")).alias("collapsed"), F.md5(X.slug(F.regexp_replace("text", "_", "-")).cast("binary")).alias("slug"), X.key("text").alias("plain_key"))


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS plain FROM pages""")
def strip_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.strip_html("html").cast("binary")).alias("plain"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN rtrim(substr(text, 1, 97)) || '...' ELSE text END AS short FROM documents""")
def truncated_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate("text", 100).alias("short"))


_RULES = {"address": "[a-z0-9.]+@[a-z0-9.]+", "number": "[0-9]{3}-[0-9]{4}", "secret": "(?i)password=|AKIA", "table": "[|]", "shout": "[A-Z]{3,}!!", "license": "CC BY|Apache|MIT"}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _RULES.items()) + "], lambda x: x IS NOT NULL)[1:3], ',') AS labels FROM documents")
def rule_labels(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.labels("text", _RULES, 3), ",").alias("labels"))


@query("SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _RULES.items()) + " ELSE 'other' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def first_rule_buckets(t: Tables) -> DataFrame:
    return t.documents.groupBy(X.first_rule("text", _RULES, "other").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\x{{4E00}}-\\x{{9FFF}}]|[A-Za-z0-9]+')) AS BIGINT) AS n, array_to_string(list_sort(list_distinct({_tokens('text', 3)}))[1:16], ' ') AS terms FROM documents""")
def token_counts_and_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_count("text").cast("bigint").alias("n"), F.array_join(X.query_terms("text"), " ").alias("terms"))


@query("""SELECT doc_id, place, md5(line) AS line FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS place, unnest(l) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents))""")
def multi_value_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.multi_value("text", "\n")).alias("place", "line")).select("doc_id", (F.col("place") + 1).cast("bigint").alias("place"), F.md5(F.col("line").cast("binary")).alias("line"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN regexp_replace(text, '(?i)ERTION|TION|THE', '[MASK]', 'g') ELSE regexp_replace(text, '(?i)TION|THE', '[MASK]', 'g') END AS masked FROM conversations""")
def mask_entities(t: Tables) -> DataFrame:
    names = F.when(F.char_length("text") > 60, F.array(F.lit("the"), F.lit("tion"), F.lit("ertion"))).otherwise(F.array(F.lit("the"), F.lit("tion")))
    return t.conversations.select("conv_id", "turn", X.mask("text", names).alias("masked"))


@query("""SELECT p_partkey, upper(regexp_replace(p_brand, '(?i)^brand#', '')) AS ext, split_part(p_name, ' ', 1) AS genus, lower(p_name) AS code, CASE WHEN length(p_name) > 0 THEN 'part:' || trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', '-', 'g'), '-') || ':' || left(sha1(p_name), 12) END AS node FROM part""")
def name_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_replace(X.external_id("p_brand", "brand"), "^#", "").alias("ext"), X.genus("p_name").alias("genus"), X.code("p_name").alias("code"), ids.node_id("part", F.col("p_name")).alias("node"))


_PAIRS = "p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')"


def _pairs(t: Tables) -> DataFrame:
    u, a = t.conversations.where("role = 'user'"), t.conversations
    return u.alias("u").join(a.alias("a"), (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)).select("u.conv_id", "u.turn", F.col("u.text").alias("q"), F.col("a.text").alias("a"))


@query(f"""WITH {_PAIRS}, k AS (SELECT conv_id, turn, {_tokens('q')} AS x, {_tokens('a')} AS y FROM p),
 s AS (SELECT *, list_distinct(x) AS dx, list_distinct(y) AS dy, coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda v: v = t)), len(list_filter(y, lambda v: v = t))))), 0) AS m FROM k)
 SELECT conv_id, turn, CAST(round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN m = 0 THEN 0 ELSE 2.0 * m / (len(x) + len(y)) END, 6) AS DOUBLE) AS token_f1,
 CAST(round(CASE WHEN len(dx) = 0 AND len(dy) = 0 THEN 1 ELSE 2.0 * len(list_intersect(dx, dy)) / (len(dx) + len(dy)) END, 6) AS DOUBLE) AS set_f1,
 CAST(round(CASE WHEN len(dx) * len(dy) > 0 THEN len(list_intersect(dx, dy)) / sqrt(len(dx) * len(dy)) ELSE 0 END, 6) AS DOUBLE) AS overlap FROM s""")
def answer_overlap(t: Tables) -> DataFrame:
    x, y = X.tokens("q"), X.tokens("a")
    rows = _pairs(t).select("conv_id", "turn", x.alias("x"), y.alias("y"))
    return rows.select("conv_id", "turn", F.round(measure.token_f1(F.col("x"), F.col("y")), 6).alias("token_f1"), F.round(measure.set_f1(F.col("x"), F.col("y")), 6).alias("set_f1"), F.round(measure.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(o_orderstatus || ' ' || o_orderpriority), '\\b([A-E])\\b', 1))), '') AS letters, CASE WHEN regexp_extract(upper(o_orderstatus || ' ' || o_orderpriority), '\\b([A-E])\\b', 1) <> '' THEN regexp_extract(upper(o_orderstatus || ' ' || o_orderpriority), '\\b([A-E])\\b', 1) ELSE upper(left(o_orderstatus, 1)) END AS letter,
 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'false' ELSE '' END AS flag FROM orders""")
def parsed_choices(t: Tables) -> DataFrame:
    both = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    return t.orders.select("o_orderkey", F.array_join(parse.choices(both), "").alias("letters"), parse.choice(both).alias("letter"), F.coalesce(parse.boolean(F.col("o_orderpriority")).cast("string"), F.lit("")).alias("flag"))


@query(None)
def quantity_extraction(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.concat_ws(" ", F.lit("about"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit("cm and"), F.col("p_retailprice").cast("string"), F.lit("g")).alias("s"))
    return rows.select("p_partkey", F.explode(measure.quantities(F.col("s"))).alias("q")).select("p_partkey", "q.*")


@query(None)
def near_duplicate_turns(t: Tables) -> DataFrame:
    return match.near_pairs(t.conversations, ["conv_id", "role"], "turn", F.round(measure.ratio(F.col("a.text"), F.col("b.text")), 6), 0.1)


@query(None)
def near_duplicate_turns_by_edits(t: Tables) -> DataFrame:
    a, b = F.col("a.text"), F.col("b.text")
    similarity = F.when(F.length(a) + F.length(b) > 0, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    return match.near_pairs(t.conversations, ["conv_id", "role"], "turn", similarity, 0.25)


@query(None)
def rule_claims(t: Tables) -> DataFrame:
    rules = [("HAS_ADDRESS", r"([a-z0-9.]+@[a-z0-9.]+)", 0.9), ("HAS_NUMBER", r"(\d{3}-\d{4})", 0.7), ("HAS_LICENSE", r"(CC BY[-A-Z]*|Apache|MIT)", 0.6)]
    return extract.claims(t.documents, lambda: extract.RuleExtractor(rules), "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+[.]$') THEN 1 ELSE 0 END AS h FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
 g AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l),
 b AS (SELECT doc_id, s, coalesce(max(CASE WHEN h = 1 THEN trim(line) END), '') AS heading, trim(coalesce(string_agg(CASE WHEN h = 0 THEN line END, chr(10) ORDER BY i), ''), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM g GROUP BY 1, 2)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS section, heading, md5(body) AS body FROM b WHERE heading <> '' OR body <> ''""")
def section_split(t: Tables) -> DataFrame:
    return extract.sections(t.documents, "doc_id", "text", r"^[A-Z][a-z]+[.]$").withColumn("body", F.md5(F.col("body").cast("binary")))


@query("""SELECT l.doc_id, CAST(l.quality = (CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END) AS INTEGER) AS hit, CASE WHEN d.lang = 'en' THEN 1.0 WHEN d.lang IN ('fr', 'es') THEN 0.5 ELSE 0.0 END AS hierarchy FROM labels l JOIN documents d USING (doc_id)""")
def hierarchical_scores(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id")
    group = F.when(F.col("lang").isin("en", "fr", "es"), "west").otherwise("east")
    score = scoring.hierarchical_score(group, F.col("lang"), F.lit("west"), F.lit("en"))
    return rows.select("doc_id", (F.col("quality") == (F.col("n_chars") > 500).cast("int")).cast("int").alias("hit"), score.alias("hierarchy"))


_SCORES = "s AS (SELECT lang, source, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id))"


def _scores(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select("lang", "source", "quality", "toxic", "n_chars")


@query(f"WITH {_SCORES} SELECT lang, count(*) AS rows, count(*) FILTER (n_chars > 300) AS valid, round(100.0 * avg(quality) FILTER (n_chars > 300), 2) AS quality, round(100.0 * avg(toxic) FILTER (n_chars > 300), 2) AS toxic FROM s GROUP BY 1")
def score_summary(t: Tables) -> DataFrame:
    return scoring.summary(_scores(t), ["lang"], ["quality", "toxic"], F.col("n_chars") > 300)


@query(f"""WITH {_SCORES}, w AS (SELECT source, round(avg(quality) FILTER (lang = 'en'), 4) AS en, round(avg(quality) FILTER (lang = 'de'), 4) AS de, round(avg(quality) FILTER (lang = 'fr'), 4) AS fr, round(avg(quality) FILTER (lang = 'es'), 4) AS es FROM s GROUP BY 1)
 SELECT *, round(list_sum(list_filter([en, de, fr, es], lambda x: x IS NOT NULL)) / len(list_filter([en, de, fr, es], lambda x: x IS NOT NULL)), 4) AS macro_average FROM w""")
def macro_average_pivot(t: Tables) -> DataFrame:
    return scoring.pivoted(_scores(t), ["source"], "lang", ["en", "de", "fr", "es"], "quality")


_SHORT = [("The answer is 5 days.", "5"), ("monotypic species", "No recognized subspecies exist"), ("between 3 to 5 eggs", "clutch 3-5"), ("red bill", "bright red bill"), ("a", "zebra"), ("blue wing patch", "green wing patch"), ("", "x"), ("", ""), ("10 meters tall", "tall 10 m"), ("2 or 3", "3 or 2"), ("3 – 4", "3-4"), (None, "none")]


@query("""WITH c(i, exact, f1, correct) AS (VALUES (0, 1.0, 1.0, 1), (1, 0.0, 1.0, 1), (2, 0.0, 1.0, 1), (3, 0.0, 0.85, 1), (4, 0.0, 0.85, 1), (5, 0.0, 0.666667, 0), (6, 0.0, 0.0, 0), (7, 1.0, 1.0, 1), (8, 0.0, 1.0, 1), (9, 0.0, 1.0, 1), (10, 1.0, 1.0, 1), (11, 0.0, 0.0, 0))
 SELECT conv_id, turn, CAST(exact AS DOUBLE) AS exact, CAST(f1 AS DOUBLE) AS f1, correct FROM conversations JOIN c ON i = conv_id % 12""")
def short_answer_cascade(t: Tables) -> DataFrame:
    """Answers of literal cases, dealt over all turns; the expected scores are written out."""
    cases = F.element_at(F.array(*(F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).alias("b")) for a, b in _SHORT)), (F.col("conv_id") % len(_SHORT) + 1).cast("int"))
    score = scoring.short_answer_score(F.col("c.a"), F.col("c.b"))
    return t.conversations.select("conv_id", "turn", cases.alias("c")).select("conv_id", "turn", score.alias("s")).select("conv_id", "turn", "s.exact", F.round("s.f1", 6).alias("f1"), "s.correct")


_FORMS = [
    ("taxonomy", "Taxonomic Trap", "No, distinct species", "false"), ("taxonomy", "taxonomic trap", "yes", "not"), ("taxonomy", "monotypic verification", "it is monotypic", "no subspecies"), ("taxonomy", "subspecies check", "alba and nigra; rosea", "alba, nigra"),
    ("taxonomy", "nomenclature & etymology", "named in 1758", "1758"), ("taxonomy", "sister/similar taxa", "currently conspecific", "true"), ("taxonomy", None, "red and blue", "blue and red"), ("choice", None, "the answer is c", "C"), ("choice", None, "b", "D"),
    ("choices", None, "A, C", "C A"), ("choices", None, "A, B", "A"), ("short", None, "6 to 8", "6-8"), ("text", None, "Great  Tit!", "great tit"), ("text", None, "tit", "great tit"),
]


@query("""WITH c(i, exact, f1, correct) AS (VALUES (0, 0.0, 1.0, 1), (1, 0.0, 0.0, 0), (2, 0.0, 1.0, 1), (3, 0.0, 0.8, 1), (4, 0.0, 1.0, 1), (5, 0.0, 1.0, 1), (6, 0.0, 1.0, 1), (7, 1.0, 1.0, 1), (8, 0.0, 0.0, 0), (9, 1.0, 1.0, 1), (10, 0.0, 0.666667, 0), (11, 1.0, 1.0, 1), (12, 1.0, 1.0, 1), (13, 0.0, 0.0, 0))
 SELECT doc_id, CAST(exact AS DOUBLE) AS exact, CAST(f1 AS DOUBLE) AS f1, correct FROM documents JOIN c ON i = doc_id % 14""")
def answer_dispatch(t: Tables) -> DataFrame:
    """Answers of literal cases of every form, dealt over all documents; the expected scores are written out."""
    cases = F.element_at(F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(case, ("form", "kind", "a", "b")))) for case in _FORMS)), (F.col("doc_id") % len(_FORMS) + 1).cast("int"))
    score = scoring.answer_score(F.col("c.form"), F.col("c.kind"), F.col("c.a"), F.col("c.b"))
    return t.documents.select("doc_id", cases.alias("c")).select("doc_id", score.alias("s")).select("doc_id", "s.exact", F.round("s.f1", 6).alias("f1"), "s.correct")


@query("""WITH s AS (SELECT source, lang, CAST(quality = 1 AS INTEGER) AS o, CAST(quality = 1 AND toxic = 0 AS INTEGER) AS f FROM labels JOIN documents USING (doc_id))
 SELECT source, count(*) AS n_total, printf('%.2f', avg(o) * 100) AS order_accuracy, printf('%.2f', avg(f) * 100) AS family_accuracy, printf('%.2f', avg(CASE WHEN f = 1 THEN 1.0 WHEN o = 1 THEN 0.5 ELSE 0.0 END) * 100) AS hierarchical_accuracy FROM s GROUP BY 1""")
def hierarchy_summary(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").withColumns({"order_correct": (F.col("quality") == 1).cast("int"), "family_correct": ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")})
    rows = rows.withColumn("hierarchical_score", F.when(F.col("family_correct") == 1, 1.0).when(F.col("order_correct") == 1, 0.5).otherwise(0.0))
    return scoring.hierarchy_summary(rows, ["source"])


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS gold FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), f AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS found FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
 b AS (SELECT o_orderkey, coalesce(found, []) AS a, coalesce(gold, []) AS b, len(list_intersect(coalesce(found, []), coalesce(gold, []))) AS n FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN g ON g.l_orderkey = o_orderkey),
 p AS (SELECT *, CASE WHEN len(a) > 0 THEN n / len(a) ELSE 0 END AS p, CASE WHEN len(b) > 0 THEN n / len(b) ELSE 0 END AS r FROM b)
 SELECT o_orderkey, CAST(round(p, 6) AS DOUBLE) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS DOUBLE) AS f1, CAST(len(b) > 0 AND n = len(b) AND n = len(a) AS INTEGER) AS exact_set_match FROM p""")
def list_scores(t: Tables) -> DataFrame:
    side = lambda where, name: t.lineitem.where(where).groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias(name))
    empty = F.array().cast("array<string>")
    rows = t.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(side("l_quantity > 25", "a"), "l_orderkey", "left").join(side("l_returnflag = 'R'", "b"), "l_orderkey", "left")
    scores = scoring.list_score(F.coalesce("a", empty), F.coalesce("b", empty))
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), *(c.alias(n) for n, c in scores.items()))
