"""Fields, screens, phrases and reports on the driver's tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import audits, fields, phrases, screens
from tessera.plans.registry import Tables, query


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'direct' WHEN event_id % 3 = 1 THEN 'nested ' || event_type ELSE '' END AS target, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'b c' END AS flat, CASE WHEN event_id % 5 = 0 THEN 'Order' ELSE '' END AS "order", CASE WHEN event_id % 5 = 0 THEN 'Fam' ELSE event_type END AS family, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS listed FROM events""")
def row_fields(t: Tables) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    own = F.to_json(F.struct(F.when(i % 3 == 0, " direct ").when(i % 3 == 1, " ").alias("species"), F.struct(F.when(i % 3 == 1, F.concat(F.lit("nested "), kind)).alias("species")).alias("meta")))
    flat = F.when(i % 2 == 0, kind).otherwise('{"x": "z", "name": "b", "common": "c", "text": " B "}')
    pair = fields.split_pair(F.when(i % 5 == 0, "Order | Fam").otherwise(kind))
    rows = t.events.select("event_id", fields.first_of(own, fields.nested(["target", "species"], ["metadata", "meta"])).alias("target"), fields.flattened(flat, ["name", "common", "text"]).alias("flat"), pair.alias("p"), F.size(fields.listed(F.when(i % 4 == 0, '["a", "b"]').otherwise("a"))).alias("listed"))
    return rows.select("event_id", "target", "flat", "p.order", "p.family", "listed")


@query("""SELECT p_partkey, concat_ws(' | ', 'name: ' || p_name, 'brand: ' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'size: ' || p_size END) AS search, concat_ws(';', CASE WHEN contains(lower(p_name), 'cold') OR contains(lower(p_name), 'econ') THEN 'Name: ' || p_name END, CASE WHEN contains(lower(p_type), 'cold') OR contains(lower(p_type), 'econ') THEN 'Type: ' || p_type END) AS matched FROM part""")
def table_rows_as_text(t: Tables) -> DataFrame:
    search = fields.search_text({"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(" ")})
    matched = fields.matched_fields({"Name": F.col("p_name"), "Type": F.col("p_type")}, F.array(F.lit("cold"), F.lit("econ")))
    return t.part.select("p_partkey", search.alias("search"), F.array_join(matched, ";").alias("matched"))


@query("""WITH n AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1), p AS (SELECT p_partkey, uses, CASE p_partkey % 6 WHEN 0 THEN 'Large' WHEN 1 THEN 'ab' WHEN 2 THEN 'LC' WHEN 3 THEN 'seen 1999' WHEN 4 THEN 'Smith et al.' ELSE p_name END AS name FROM part LEFT JOIN n ON l_partkey = p_partkey)
 SELECT p_partkey, concat_ws(',', CASE p_partkey % 6 WHEN 0 THEN 'adjective_or_ui_junk' WHEN 1 THEN 'too_short' WHEN 3 THEN 'citation_like_year' WHEN 4 THEN 'author_reference' END, CASE WHEN uses > 12 THEN 'evidence_reused_too_many_times' END) AS issues FROM p""")
def name_noise(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Large").when(k == 1, "ab").when(k == 2, "LC").when(k == 3, "seen 1999").when(k == 4, "Smith et al.").otherwise(F.col("p_name"))
    uses = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"))
    return t.part.join(uses, "p_partkey", "left").select("p_partkey", F.array_join(screens.noise(name, F.col("uses")), ",").alias("issues"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'empty_or_placeholder_answer' WHEN 1 THEN 'too_short_under_5_tokens' ELSE '' END AS invalid, CASE WHEN o_orderkey % 3 = 0 THEN 'In May?' || chr(10) || chr(10) || 'Constraint: by boat' WHEN o_orderkey % 3 = 1 THEN 'Go  BY Boat in May?' ELSE 'In May?' END AS question, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS sensitive FROM orders""")
def question_screens(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    answer = F.when(k % 4 == 0, " N/A ").when(k % 4 == 1, "only four tokens here").when(k % 4 == 2, "this one has five tokens").otherwise("鸟鸟 in the old oak")
    question = F.when(k % 3 == 1, "Go  BY Boat in May?").otherwise("In May?")
    constraint = F.when(k % 3 == 0, "by boat").when(k % 3 == 1, " by  boat")
    return t.orders.select("o_orderkey", screens.invalid_answer(answer, ["n/a", "none"], 5).alias("invalid"), screens.with_constraint(question, constraint, "Constraint").alias("question"), screens.sensitive(F.col("o_orderstatus"), F.col("o_orderpriority"), ["F"], {"O": ["1-URGENT", "2-HIGH"]}).alias("sensitive"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n_claims FROM lineitem GROUP BY 1) SELECT o_orderkey, n_claims FROM orders JOIN n ON l_orderkey = o_orderkey WHERE n_claims >= CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 4 END AND o_orderpriority <> '5-LOW'""")
def capped_chunks(t: Tables) -> DataFrame:
    cap = F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(4)
    chunks = screens.of_kinds(t.orders, "o_orderpriority", exclude=["5-low"]).withColumn("cap", cap)
    return screens.at_cap(chunks, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "cap").select("o_orderkey", "n_claims")


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'selected' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def exclusion_histogram(t: Tables) -> DataFrame:
    return screens.exclusions(t.orders, {"partial": F.col("o_orderstatus") == "P", "cheap": F.col("o_totalprice") < 50000, "low": F.col("o_orderpriority") == "5-LOW"})


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders), s AS (SELECT *, list_filter(['F', 'O', 'P', 'any'], lambda k: k = 'any' OR contains(o_orderstatus, k)) AS can, [['F', 'O', 'P', 'any'], ['O', 'P', 'any', 'F'], ['P', 'any', 'F', 'O'], ['any', 'F', 'O', 'P']][p % 4 + 1] AS turn FROM o)
 SELECT o_orderkey, list_filter(turn, lambda k: list_contains(can, k))[1] AS kind FROM s""")
def round_robin_kinds(t: Tables) -> DataFrame:
    can = screens.supported_kinds(F.col("o_orderstatus"), {"F": ["f"], "O": ["o"], "P": ["p"], "any": []})
    return screens.round_robin(t.orders.withColumn("can", can), ["o_custkey"], ["o_orderkey"], ["F", "O", "P", "any"], F.col("can")).select("o_orderkey", "kind")


_DICTIONARY = """d AS (SELECT phrase, list_sort(list(DISTINCT code)) AS codes FROM (SELECT lower(p_name) AS phrase, p_type AS code FROM part) GROUP BY 1)"""


@query(f"""WITH {_DICTIONARY} SELECT phrase, array_to_string(codes, ',') AS codes FROM d""")
def mined_phrases(t: Tables) -> DataFrame:
    rows = phrases.mined(t.part, F.array(F.concat(F.lit("The "), F.upper("p_name"), F.lit("."))), F.col("p_type"))
    return rows.withColumn("codes", F.array_join("codes", ","))


@query(f"""WITH {_DICTIONARY}, k AS (SELECT phrase, list_filter(codes, lambda c: c IN ('ECONOMY', 'STANDARD')) AS codes FROM d), q AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'nothing' ELSE p_name END AS phrase FROM part), r AS (SELECT p_partkey, q.phrase, coalesce(codes, []) AS codes FROM q LEFT JOIN k ON k.phrase = lower(q.phrase))
 SELECT p_partkey AS query_id, CASE WHEN len(codes) = 1 THEN codes[1] ELSE '' END AS codes, CASE WHEN len(codes) = 0 THEN phrase WHEN len(codes) > 1 THEN phrase || '=>' || array_to_string(codes, ',') ELSE '' END AS unresolved, array_to_string(codes, ',') AS all_codes, CASE WHEN len(codes) > 1 THEN array_to_string(codes, ',') ELSE '' END AS ambiguous FROM r""")
def phrase_resolution(t: Tables) -> DataFrame:
    dictionary = phrases.mined(t.part, F.array("p_name"), F.col("p_type"))
    asked = t.part.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 5 == 0, "nothing").otherwise(F.col("p_name")).alias("phrase"))
    values = t.part.where("p_type in ('ECONOMY', 'STANDARD')").select(F.col("p_type").alias("code"))
    skip, union = (phrases.resolved(asked, dictionary, values, p) for p in ("skip", "union"))
    rows = skip.select("query_id", "codes", "unresolved").join(union.select("query_id", F.col("codes").alias("all_codes"), "ambiguous"), "query_id")
    return rows.select("query_id", *(F.array_join(c, ",").alias(c) for c in ("codes", "unresolved", "all_codes", "ambiguous")))


_CHUNKS = "c AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 4 END AS cap, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)"


def _chunks(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.join(n, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(4).alias("cap"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_CHUNKS} SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (n > 0) AS positive, CAST(sum(n) AS BIGINT) AS total, round(sum(n) / count(*), 6) AS mean_all, CASE WHEN count(*) FILTER (n > 0) = 0 THEN 0.0 ELSE round(sum(n) / count(*) FILTER (n > 0), 6) END AS mean_positive FROM c GROUP BY 1""")
def domain_means(t: Tables) -> DataFrame:
    return audits.means_by(_chunks(t), ["o_orderpriority"], "n")


@query(f"""WITH {_CHUNKS} SELECT cap, count(*) AS rows, count(*) FILTER (n < cap) AS below, count(*) FILTER (n = cap) AS at, count(*) FILTER (n > cap) AS above, round(count(*) FILTER (n = cap) / count(*), 6) AS share_at FROM c GROUP BY 1""")
def cap_phenomenon(t: Tables) -> DataFrame:
    return audits.cap_phenomenon(_chunks(t), "cap", "n")


@query("""SELECT coalesce(event_type, 'all') AS chapter, count(*) FILTER (user_id % 4 <> 0) AS ok, count(*) FILTER (user_id % 4 = 0) AS errors, count(*) FILTER (user_id % 4 <> 0 AND value > 10) AS positive FROM events GROUP BY ROLLUP (event_type)""")
def review_summary(t: Tables) -> DataFrame:
    rows = t.events.withColumn("status", F.when(F.col("user_id") % 4 != 0, "ok").otherwise("error"))
    return audits.review_summary(rows, "status", F.col("value") > 10, "event_type").withColumnRenamed("event_type", "chapter").withColumn("chapter", F.coalesce("chapter", F.lit("all")))


@query(f"""WITH {_CHUNKS}, g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS chunks, count(*) FILTER (n >= cap) AS capped FROM c GROUP BY 1, 2), p AS (SELECT *, round(chunks * 0.25 + capped * 2.0, 6) AS priority FROM g)
 SELECT o_orderpriority, o_orderstatus, chunks, capped, CAST(priority AS DOUBLE) AS priority, CAST(row_number() OVER (ORDER BY priority DESC, o_orderpriority, o_orderstatus) AS INTEGER) AS rank FROM p""")
def ranked_strata(t: Tables) -> DataFrame:
    return audits.ranked_strata(_chunks(t), ["o_orderpriority", "o_orderstatus"], {"chunks": F.count("*"), "capped": F.count_if(F.col("n") >= F.col("cap"))}, {"chunks": 0.25, "capped": 2.0})


@query("""WITH a AS (SELECT l_orderkey, count(*) AS claims FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS claims FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_orderkey, a.claims AS left_claims, b.claims AS right_claims FROM a JOIN b USING (l_orderkey)""")
def paired_units(t: Tables) -> DataFrame:
    side = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.count("*").alias("claims"))
    return audits.paired(side("A"), side("R"), ["l_orderkey"])


@query("""SELECT DISTINCT o_orderkey, c_name FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)""")
def pending_answers(t: Tables) -> DataFrame:
    answers = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    questions = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return audits.pending(answers, questions, t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""WITH p AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_returnflag) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'single' WHEN s = 1 THEN 'same_source' ELSE 'cross_source' END AS class, count(*) AS ids, CAST(sum(n - 1) AS BIGINT) AS extra FROM p GROUP BY 1""")
def duplicate_sources(t: Tables) -> DataFrame:
    return audits.duplicate_sources(t.lineitem.where("l_quantity > 45"), "l_partkey", "l_returnflag")


@query("""SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'words', w, count(*) FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS w FROM orders) GROUP BY 2""")
def plan_histograms(t: Tables) -> DataFrame:
    return audits.histograms(t.orders.withColumn("words", F.split("o_orderpriority", "-")), ["o_orderstatus", "o_orderpriority"], ["words"])


@query("""WITH s AS (SELECT source, lang, round(avg(quality), 4) AS score, count(*) FILTER (toxic = 1) AS disputed, count(*) FILTER (n_chars < 100) AS invalid FROM labels JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') GROUP BY 1, 2),
 w AS (SELECT source, max(score) FILTER (lang = 'en') AS en, coalesce(max(disputed) FILTER (lang = 'en'), 0) AS en_disputed, coalesce(max(invalid) FILTER (lang = 'en'), 0) AS en_invalid, max(score) FILTER (lang = 'de') AS de, coalesce(max(disputed) FILTER (lang = 'de'), 0) AS de_disputed, coalesce(max(invalid) FILTER (lang = 'de'), 0) AS de_invalid FROM s GROUP BY 1)
 SELECT *, round(list_avg(list_filter([en, de], lambda x: x IS NOT NULL)), 6) AS macro_avg, en_disputed + de_disputed AS total_disputed FROM w""")
def full_score_table(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").where("lang in ('en', 'de')").groupBy("source", "lang").agg(F.round(F.avg("quality"), 4).alias("score"), F.count_if(F.col("toxic") == 1).alias("disputed"), F.count_if(F.col("n_chars") < 100).alias("invalid"))
    return audits.full_table(rows, ["source"], "lang", ["en", "de"], "score", "disputed", "invalid")


@query("""SELECT count(*) AS claims, count(DISTINCT l_partkey) AS subjects, round(count(*) / count(DISTINCT l_orderkey), 6) AS per_chunk, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem""")
def extraction_summary(t: Tables) -> DataFrame:
    return audits.run_summary(t.lineitem, {"claims": F.count("*"), "subjects": F.countDistinct("l_partkey"), "per_chunk": F.round(F.count("*") / F.countDistinct("l_orderkey"), 6), "returned": F.count_if(F.col("l_returnflag") == "R")})
