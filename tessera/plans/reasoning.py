"""Context, planning, candidates, claims and validators on the driver's tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import candidates, checks, claims, context, planning
from tessera.plans.registry import Tables, query

_TARGETS = [(1, "NATION_1", "which suppliers have credit"), (2, "nation_77", "which"), (3, "ation_2", "debt of suppliers"), (4, " ", "which"), (5, "nation_0", "supplier with debt in nation")]


@query("""WITH t(query_id, asked, target, words) AS (VALUES (1, 'NATION_1', 'NATION_1', ['suppliers', 'have', 'credit']), (3, 'ation_2', 'NATION_2', ['debt', 'suppliers']), (5, 'nation_0', 'NATION_0', ['supplier', 'debt', 'nation'])),
 e AS (SELECT query_id, words, s_suppkey, s_acctbal, s_name || ' is in ' || n_name AS d, lower(s_name || ' is in ' || n_name || ' ' || CASE WHEN s_acctbal > 0 THEN 'credit' ELSE 'debt' END || ' ' || s_name || ' ' || n_name) AS held FROM t JOIN nation ON n_name = target JOIN supplier ON s_nationkey = n_nationkey),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s_acctbal / 1000 + 3.0 * (CASE WHEN contains(held, 'credit') THEN 1 ELSE 0 END) + 0.5 * len(list_filter(words, lambda w: contains(held, w))) + 1.0, 6) DESC, s_suppkey) AS n FROM e),
 c AS (SELECT query_id, '[Graph relation facts]' || chr(10) || string_agg('- ' || d, chr(10) ORDER BY n) AS context FROM p WHERE n <= 40 GROUP BY 1)
 SELECT query_id, coalesce(context, '[NO_KG_CONTEXT: no edges for entity: ' || asked || ']') AS context FROM t LEFT JOIN c USING (query_id)
 UNION ALL SELECT 2, '[NO_KG_CONTEXT: entity not found: nation_77]' UNION ALL SELECT 4, '[NO_KG_CONTEXT: missing target_entity]'""")
def one_hop_context(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame(_TARGETS, "query_id int, target string, question string").withColumn("domain_keywords", F.array(F.lit("credit")))
    nodes = t.nation.select(F.concat_ws(":", F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("entity_id"), F.array(F.lit("Nation")).alias("labels"), F.lit("").alias("entity_type"), F.lit("").alias("description"))
    edges = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("edge_id"), F.concat_ws(":", F.lit("s"), "s_suppkey").alias("source"), F.concat_ws(":", F.lit("n"), "n_nationkey").alias("target"), F.col("s_name").alias("subject"), F.col("n_name").alias("object"),
        F.concat_ws(" is in ", "s_name", "n_name").alias("description"), F.when(F.col("s_acctbal") > 0, "credit").otherwise("debt").alias("keywords"), (F.col("s_acctbal") / 1000).alias("weight"), F.lit("").alias("source_id"),
    )
    return context.one_hop(asked, nodes, edges, ("Nation",), neighbours=1_000_000)


@query("""WITH n AS (SELECT lower(n_name) AS name, 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT lower(r_name), 'region:' || r_regionkey FROM region),
 q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'What about ' || (SELECT n_name FROM nation WHERE n_nationkey = doc_id % 25) || ' then?' WHEN 1 THEN 'Asia and Europe' WHEN 2 THEN 'no name at all' ELSE '' END AS question, CASE WHEN doc_id % 4 = 3 THEN 'ASIA' ELSE '' END AS explicit FROM documents)
 SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN 'nation:' || doc_id % 25 WHEN 3 THEN (SELECT id FROM n WHERE name = 'asia') END AS target_id, CASE doc_id % 4 WHEN 0 THEN 'mention' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'unresolved' ELSE 'exact' END AS method,
 CASE WHEN doc_id % 4 = 1 THEN (SELECT array_to_string(list_sort(list(id)), ',') FROM n WHERE name IN ('asia', 'europe')) END AS candidates FROM q""")
def target_resolution(t: Tables) -> DataFrame:
    names = t.nation.select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"), F.concat_ws(":", F.lit("nation"), "n_nationkey").alias("target_id")).unionByName(t.region.select(F.col("r_name").alias("name"), F.concat_ws(":", F.lit("region"), "r_regionkey").alias("target_id")))
    which = F.col("doc_id") % 4
    question = F.when(which == 0, F.concat(F.lit("What about nation_"), (F.col("doc_id") % 25).cast("string"), F.lit(" then?"))).when(which == 1, "Asia and Europe").when(which == 2, "no name at all").otherwise("")
    asked = t.documents.select(F.col("doc_id").alias("query_id"), F.replace(question, F.lit("_"), F.lit(" ")).alias("question"), F.when(which == 3, "ASIA").otherwise("").alias("explicit"))
    rows = planning.resolve(asked, names)
    return rows.withColumn("candidates", F.array_join("candidates", ","))


_AVAILABLE = {"domains": ["F", "O"], "predicates": ["A", "R"], "chapters": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}


@query("""WITH p(query_id, target_id, domains, predicates, chapters, terms) AS (VALUES (1, 1, ['F'], ['R', 'A'], ['1-URGENT'], ['building', 'furniture']), (2, 2, ['O'], ['R'], ['2-HIGH'], ['machinery']), (3, 3, [], ['A'], ['3-MEDIUM'], ['household'])),
 f AS (SELECT query_id, l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey AS evidence_id, domains, predicates, chapters, terms, l_linestatus AS domain, l_returnflag AS predicate, least(l_quantity / 10, 5.0) AS support, o_orderpriority AS chapter, c_mktsegment AS chunk, o_orderkey IS NOT NULL AS linked
  FROM p JOIN lineitem ON l_suppkey = target_id LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
 l AS (SELECT *, CASE WHEN (len(domains) = 0 OR list_contains(domains, domain)) AND list_contains(predicates, predicate) THEN 2 WHEN len(domains) > 0 AND list_contains(domains, domain) THEN 1 ELSE 0 END AS level FROM f),
 b AS (SELECT *, max(level) OVER (PARTITION BY query_id) AS best FROM l),
 s AS (SELECT query_id, fact_id, evidence_id, max(round(CASE WHEN list_contains(predicates, predicate) THEN 10.0 + len(predicates) - list_position(predicates, predicate) + 1 ELSE 0 END + CASE WHEN list_contains(domains, domain) THEN 5.0 ELSE 0 END + CASE WHEN list_contains(chapters, chapter) THEN 3.0 ELSE 0 END
  + CASE WHEN list_contains(terms, lower(chunk)) THEN 1 ELSE 0 END + 0.2 * support + CASE WHEN linked THEN 0.5 ELSE 0 END + CASE WHEN chunk <> '' THEN 0.25 ELSE 0 END, 6)) AS score FROM b WHERE level >= best GROUP BY 1, 2, 3)
 SELECT query_id, fact_id, evidence_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id, evidence_id) AS rank FROM s) WHERE rank <= 12""")
def planned_facts(t: Tables) -> DataFrame:
    rows = [(1, 1, "sold by building furniture", ["F", "X"], ["R", "A", "Z"], ["1-URGENT"]), (2, 2, "machinery", ["O"], ["R"], ["none", "2-HIGH"]), (3, 3, "household", [], ["A"], ["3-MEDIUM"])]
    asked = t.spark.createDataFrame([(i, q) for i, _, q, *_ in rows], "query_id int, question string")
    routes = t.spark.createDataFrame([(i, "facts", d, p, c, []) for i, _, _, d, p, c in rows], "query_id int, intent string, domains array<string>, predicates array<string>, chapters array<string>, hints array<string>")
    plans = planning.planned(t.spark.createDataFrame([(i, k) for i, k, *_ in rows], "query_id int, target_id long"), asked, routes, _AVAILABLE)
    facts = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_suppkey").alias("target_id"), F.col("l_linestatus").alias("domain"), F.col("l_returnflag").alias("predicate"), F.lit("").alias("object"), (F.col("l_quantity") / 10).alias("support"))
    found = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("chapter"), F.col("o_orderstatus").alias("quote"), F.col("c_mktsegment").alias("chunk"))
    links = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_orderkey").alias("o_orderkey"))
    return planning.planned_facts(plans, facts, links.join(found, "o_orderkey"), 12).select("query_id", "fact_id", "evidence_id", "score", "rank")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\b(hot|warm)\\b') THEN 'heat' WHEN regexp_matches(p_name, '\\b(cold|ice)\\b') THEN 'cold' WHEN regexp_matches(p_name, '\\b(widget|hot)\\b') THEN 'thing' ELSE 'other' END AS category FROM part""")
def ordered_categories(t: Tables) -> DataFrame:
    groups = {"heat": ["hot", "warm"], "cold": ["cold", "ice"], "thing": ["widget", "hot"]}
    return t.part.select("p_partkey", planning.category(planning.words(F.col("p_name")), groups, "other").alias("category"))


@query("""WITH l AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DIRECT' WHEN 'O' THEN 'UNRESOLVED' ELSE 'GUESS' END AS method, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END AS taxon_id, CASE WHEN o_orderkey % 7 = 0 THEN 'other' WHEN o_orderkey % 5 = 0 THEN '' ELSE c_name END AS name, c_mktsegment, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
 SELECT o_orderkey AS link_id, CASE WHEN method = 'GUESS' THEN 'invalid method' WHEN method = 'UNRESOLVED' THEN '' WHEN taxon_id = -1 THEN 'missing node' ELSE concat_ws(';', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'wrong rank' END, CASE WHEN name <> '' AND name <> c_name THEN 'name mismatch' END) END AS errors FROM l""")
def link_target_checks(t: Tables) -> DataFrame:
    method = F.when(F.col("o_orderstatus") == "F", "DIRECT").when(F.col("o_orderstatus") == "O", "UNRESOLVED").otherwise("GUESS")
    key = F.col("o_orderkey")
    links = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(key.alias("link_id"), method.alias("method"), F.when(key % 11 == 0, -1).otherwise(F.col("o_custkey")).alias("taxon_id"), F.when(key % 7 == 0, "other").when(key % 5 == 0, "").otherwise(F.col("c_name")).alias("name"))
    nodes = t.customer.select(F.col("c_custkey").alias("taxon_id"), F.col("c_mktsegment").alias("rank"), F.col("c_name").alias("name"))
    return checks.link_targets(links, nodes, ["DIRECT", "UNRESOLVED"], "BUILDING").withColumn("errors", F.array_join("errors", ";"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS part_id, CASE WHEN o_orderkey IS NULL OR o_orderstatus = 'P' THEN 'no parent' ELSE concat_ws(';', CASE WHEN l_suppkey % 25 <> o_custkey % 25 THEN 'id drift' END, CASE WHEN l_linestatus <> o_orderstatus THEN 'name drift' END) END AS errors FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def inheritance_checks(t: Tables) -> DataFrame:
    parts = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("part_id"), F.col("l_orderkey").alias("key"), (F.col("l_suppkey") % 25).alias("taxon_id"), F.col("l_linestatus").alias("name"))
    parents = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 25).alias("taxon_id"), F.col("o_orderstatus").alias("name"))
    return checks.inheritance(parts, parents, ["key"]).withColumn("errors", F.array_join("errors", ";"))


@query("""SELECT conv_id * 1000 + turn AS row_id, concat_ws(';', CASE WHEN turn % 3 = 0 AND conv_id % 2 = 1 THEN 'subject not found' END, CASE WHEN conv_id % 5 = 0 THEN 'no chunk' WHEN conv_id % 7 = 0 THEN 'chunk not found' WHEN turn % 4 = 0 THEN 'no quote' WHEN turn % 4 = 1 THEN 'quote not in chunk' END,
 CASE WHEN conv_id % 5 <> 0 AND conv_id % 7 <> 0 AND role = 'user' AND turn % 2 = 1 THEN 'predicate not allowed' END) AS errors FROM conversations""")
def claim_back_trace(t: Tables) -> DataFrame:
    row = F.col("conv_id") * 1000 + F.col("turn")
    quote = F.when(F.col("turn") % 4 == 0, " ").when(F.col("turn") % 4 == 1, "\u0001 not there").otherwise(F.substring("text", 1, 30))
    rows = t.conversations.select(row.alias("row_id"), F.when(F.col("conv_id") % 5 != 0, row).alias("chunk_id"), quote.alias("quote"), F.when((F.col("turn") % 3 == 0) & (F.col("conv_id") % 2 == 1), -1).otherwise(F.col("conv_id")).alias("subject_id"), F.col("role").alias("chapter"), (F.col("turn") % 2).cast("string").alias("predicate"))
    chunks = t.conversations.where("conv_id % 7 <> 0 or conv_id % 5 = 0").select(row.alias("chunk_id"), F.col("text").alias("chunk"))
    allowed = t.spark.createDataFrame([("user", "0")], "chapter string, predicate string")
    subjects = t.conversations.select(F.col("conv_id").alias("subject_id"))
    return checks.back_trace(rows, chunks, subjects, allowed).withColumn("errors", F.array_join("errors", ";"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'no evidence' AS error FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'missing fact' FROM lineitem WHERE l_quantity > 25 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT DISTINCT CAST(l_partkey AS VARCHAR), 'missing evidence' FROM lineitem WHERE l_quantity > 25 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def fact_link_checks(t: Tables) -> DataFrame:
    links = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("evidence_id"))
    return checks.fact_links(t.orders.select(F.col("o_orderkey").alias("fact_id")), links, t.part.where("p_size > 10").select(F.col("p_partkey").alias("evidence_id")))


@query("""WITH c AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS attached FROM orders) SELECT 'total' AS key, total AS stated, total AS counted, true AS ok FROM c UNION ALL SELECT 'attached', attached + 1, attached, false FROM c UNION ALL SELECT 'open', -1, total - attached, false FROM c""")
def summary_recount(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    summary = t.orders.agg(F.count("*").alias("total"), (F.count_if(done) + 1).alias("attached"), F.lit(-1).cast("long").alias("open"))
    return checks.recounted(summary.unpivot([], summary.columns, "key", "value"), t.orders, {"total": F.lit(True), "attached": done, "open": ~done})


@query("""SELECT n_name AS name, count(c_custkey) AS n, CAST(3 AS BIGINT) AS expected, count(c_custkey) = 3 AS ok FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (0, 1, 2) GROUP BY 1 UNION ALL SELECT 'none', 0, 0, true""")
def expected_counts(t: Tables) -> DataFrame:
    n = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    return checks.expected_counts(n, {"NATION_0": 3, "NATION_1": 3, "NATION_2": 3, "none": 0})


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'external_id_missing' WHEN p_size % 7 = 0 THEN 'code_missing' WHEN p_type = 'ECONOMY' THEN 'subspecies_or_group_rank' WHEN p_size % 3 = 0 THEN 'checklist_drift_note' WHEN p_size % 3 = 1 THEN 'possible_name_mismatch' ELSE 'unknown' END AS reason FROM part""")
def unresolved_reasons(t: Tables) -> DataFrame:
    id_, code = F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey").cast("string")), F.when(F.col("p_size") % 7 != 0, "c")
    conflict = F.when(F.col("p_size") % 3 == 0, "OTHER").when(F.col("p_size") % 3 == 1, "GENUS_MISMATCH")
    rank = F.when(F.col("p_type") == "ECONOMY", "group (monotypic)").otherwise("species")
    return t.part.select("p_partkey", checks.unresolved_reason(id_, code, rank, conflict, F.when(F.col("p_size") % 3 == 0, "a Drift noted"), F.lit(None).cast("string")).alias("reason"))


@query("""WITH r AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'alias ' || p_name WHEN p_partkey % 4 = 1 THEN p_name || '?' ELSE p_name END AS name FROM part), m AS (SELECT CASE WHEN name IN (SELECT p_name FROM part WHERE p_size > 25) THEN 'direct' WHEN name IN (SELECT 'alias ' || p_name FROM part WHERE p_size > 25) THEN 'alias' ELSE 'unresolved' END AS method FROM r)
 SELECT method, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1""")
def attachability(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    records = t.part.select(F.when(k == 0, F.concat(F.lit("alias "), "p_name")).when(k == 1, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name"))
    nodes = t.part.where("p_size > 25").select(F.col("p_name").alias("name"))
    return checks.attachability(records, nodes, t.part.select(F.concat(F.lit("alias "), "p_name").alias("alias"), F.col("p_name").alias("name")))


@query("""WITH c AS (SELECT l_suppkey, l_partkey, l_orderkey, min(l_linenumber) AS line, arg_min(l_quantity, l_linenumber) AS q FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, line) AS k FROM c)
 SELECT l_suppkey, l_partkey, max(q) FILTER (k = 1) AS l_quantity, array_to_string(list(l_orderkey ORDER BY k) FILTER (k <= 2), ',') AS chunks FROM n GROUP BY 1, 2""")
def merged_claims(t: Tables) -> DataFrame:
    rows = claims.merged(t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey", "l_partkey"], "l_orderkey", ["l_orderkey", "l_linenumber"])
    return rows.select("l_suppkey", "l_partkey", "l_quantity", F.array_join(F.col("supported_chunk_ids").cast("array<string>"), ",").alias("chunks"))


@query("""SELECT l_partkey, l_returnflag, count(DISTINCT l_orderkey) AS votes, round(least(0.99, 0.55 + 0.1 * count(DISTINCT l_orderkey)), 2)::DOUBLE AS confidence FROM lineitem GROUP BY 1, 2""")
def fact_votes(t: Tables) -> DataFrame:
    return claims.voted(t.lineitem, ["l_partkey", "l_returnflag"], "l_orderkey")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
 SELECT o_custkey, o_orderstatus, count(*) AS n_facts, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS chapters, '# ' || o_custkey || ' | ' || o_orderstatus || chr(10) || string_agg('- COST: ' || o_orderkey, chr(10) ORDER BY n) AS content FROM f WHERE n <= 5 GROUP BY 1, 2""")
def fact_documents(t: Tables) -> DataFrame:
    heading = F.concat(F.lit("# "), F.col("o_custkey").cast("string"), F.lit(" | "), "o_orderstatus")
    rows = claims.documents(t.orders, ["o_custkey", "o_orderstatus"], ["o_orderkey"], heading, F.concat(F.lit("- COST: "), F.col("o_orderkey").cast("string")), "o_orderpriority", 5)
    return rows.withColumn("chapters", F.array_join("chapters", ","))


@query("""SELECT conv_id, CAST(count(*) AS INTEGER) AS parts, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY 1""")
def group_texts(t: Tables) -> DataFrame:
    return claims.concatenated(t.conversations, ["conv_id"], ["turn"], "text")


@query("""WITH e AS (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10 AND l_quantity > 20 GROUP BY 1), c AS (SELECT o_orderkey, o_custkey, p FROM orders JOIN e ON l_orderkey = o_orderkey ORDER BY o_orderkey LIMIT 100), k AS (SELECT * FROM c WHERE p IN (SELECT p_partkey FROM part WHERE p_retailprice > 910))
 SELECT 'taxon:' || o_custkey AS source, 'fact:' || o_orderkey AS target, 'HAS_FACT' AS type FROM k UNION SELECT 'fact:' || o_orderkey, 'evidence:' || p, 'SUPPORTED_BY' FROM k UNION SELECT 'evidence:' || p, 'chunk:' || p, 'FROM_CHUNK' FROM k""")
def chain_graph(t: Tables) -> DataFrame:
    evidence = t.part.where("p_size > 10").select(F.col("p_partkey").alias("evidence_id"), F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("quote"))
    links = t.lineitem.where("l_quantity > 20").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("evidence_id"))
    chunks = t.part.where("p_retailprice > 910").select(F.col("p_partkey").alias("chunk_id"))
    return claims.chain_graph(claims.complete_chains(t.orders.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject_id")), links, evidence, chunks, 100))


@query("""SELECT o_orderkey, '- ' || o_orderstatus || ': ' || CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN (CASE WHEN o_custkey % 2 = 0 THEN o_custkey || ' g' ELSE o_custkey || '-' || (o_custkey + 1) || ' g' END) ELSE 'text' END || CASE WHEN o_orderkey % 2 = 0 THEN '. Evidence: seen' ELSE '.' END AS line,
 CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'BreedingAndLifeHistory' WHEN o_orderpriority LIKE '%HIGH' THEN 'Conservation' ELSE 'GeneralFacts' END AS domain FROM orders""")
def claim_lines(t: Tables) -> DataFrame:
    key, low = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 3 == 0, "entity").when(key % 3 == 1, "numeric").otherwise("text")
    line = claims.claim_line(F.col("o_orderstatus"), kind, F.col("o_orderpriority"), F.lit("text"), low, F.when(low % 2 == 0, low).otherwise(low + 1), F.lit("g"), F.when(key % 2 == 0, "seen"))
    chapter = F.when(F.col("o_orderpriority").endswith("URGENT"), "Nest and Eggs").when(F.col("o_orderpriority").endswith("HIGH"), "x")
    return t.orders.select("o_orderkey", line.alias("line"), claims.fact_domain(chapter, F.when(F.col("o_orderpriority").endswith("HIGH"), "HAS_STATUS")).alias("domain"))


@query("""WITH h AS (SELECT user_id % 3 AS query_id, event_type, user_id, event_id, value FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, event_type, user_id ORDER BY value DESC, event_id) AS n FROM h),
 s AS (SELECT query_id, event_type, user_id, round(sum(value) FILTER (n <= 3), 4) AS score FROM r GROUP BY 1, 2, 3), b AS (SELECT query_id, event_type, user_id, round(score + CASE WHEN event_type = 'error' THEN 14.0 WHEN event_type = 'view' THEN 6.0 ELSE 0.0 END, 4) AS score FROM s),
 m AS (SELECT query_id, user_id, max(score) AS score FROM b GROUP BY 1, 2) SELECT query_id, user_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, user_id) AS rank FROM m) WHERE rank <= 10""")
def candidate_ranking(t: Tables) -> DataFrame:
    hits = t.events.where("value is not null").select((F.col("user_id") % 3).alias("query_id"), "event_type", "user_id", "event_id", "value")
    own = candidates.summed(hits, ["event_type", "user_id"], "value", "event_id", 3).withColumn("name", F.col("event_type"))
    bonus = t.spark.createDataFrame([(q, n, b) for q in range(3) for n, b in (("ERROR", 10.0), ("error", 4.0), ("view", 6.0))], "query_id long, name string, bonus double")
    rows = candidates.with_bonus(own.withColumnRenamed("name", "kind").drop("event_type"), bonus, ["kind"])
    return candidates.best_of_each(rows, ["user_id"], ["user_id"], 10)


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority, count(*) FILTER (lower(o_orderpriority) LIKE '%urgent%') OVER () >= 20 AS enough FROM orders) SELECT o_orderkey FROM c WHERE NOT enough OR lower(o_orderpriority) LIKE '%urgent%'""")
def heading_prefilter(t: Tables) -> DataFrame:
    return candidates.prefiltered(t.orders, "o_orderpriority", ["Urgent"], 20).select("o_orderkey")


@query("""SELECT 1 AS query_id, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 2, c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def exact_name_chunks(t: Tables) -> DataFrame:
    first = t.spark.createDataFrame([(1, "building (x)"), (2, "none")], "query_id int, name string")
    second = t.spark.createDataFrame([(1, "FURNITURE"), (2, "Machinery")], "query_id int, name string")
    return candidates.with_fallback(*(candidates.by_any_name(t.customer, n, "c_mktsegment").select("query_id", "c_custkey") for n in (first, second)))
