"""Claims, facts, evidence, matching and integrity on the order tables.

A line item stands for a claim: its part is the subject, return flag and line status the predicate.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import joined, stable_id
from tessera.functions.text import key
from tessera.operators import consolidate as C
from tessera.operators import match, quality, sets, windows
from tessera.plans.registry import Tables, query

_CLAIMS = """claims AS (SELECT *, l_returnflag || l_linestatus AS predicate, CAST(10000 - round(l_discount * 50000) AS BIGINT) AS bp FROM lineitem)"""


def claims(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("predicate", F.concat("l_returnflag", "l_linestatus")).withColumn("confidence", ((10000 - F.round(F.col("l_discount") * 50000)) / 10000).cast("decimal(8,4)"))


def facts(t: Tables) -> DataFrame:
    return C.consolidate(claims(t), ["l_partkey", "predicate"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], carry=["l_suppkey", "l_orderkey"]).withColumn("confidence", F.col("confidence").cast("double"))


_FACTS = _CLAIMS + """, facts AS (SELECT 'fact_' || left(sha1(l_partkey || '||' || predicate), 32) AS fact_id, l_partkey, predicate, count(*) AS support_count,
 ((2 * sum(bp) + count(*)) // (2 * count(*))) / 10000.0 AS confidence,
 CAST(arg_min(l_suppkey, o) AS BIGINT) AS l_suppkey, CAST(arg_min(l_orderkey, o) AS BIGINT) AS l_orderkey
 FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, predicate ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS o FROM claims) GROUP BY l_partkey, predicate)"""


@query(f"""WITH {_FACTS} SELECT fact_id, l_partkey, predicate, support_count, CAST(confidence AS DOUBLE) AS confidence, l_suppkey, l_orderkey,
 CASE WHEN confidence < 0.55 THEN 'low_confidence' ELSE 'active' END AS status FROM facts""")
def fact_consolidation(t: Tables) -> DataFrame:
    return facts(t).withColumn("status", C.status(F.col("confidence"), F.lit("text"), F.lit(True)))


@query(f"""WITH {_CLAIMS} SELECT DISTINCT 'fact_' || left(sha1(l_partkey || '||' || predicate), 32) AS fact_id, 'evidence_' || left(sha1(CAST(l_orderkey AS VARCHAR)), 16) AS evidence_id FROM claims""")
def evidence_links_distinct(t: Tables) -> DataFrame:
    return C.links(claims(t), stable_id("fact_", "l_partkey", "predicate", width=32), stable_id("evidence_", "l_orderkey"))


@query("""SELECT 'evidence_' || left(sha1(CAST(l_orderkey AS VARCHAR)), 16) AS evidence_id, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey""")
def evidence_last_wins(t: Tables) -> DataFrame:
    return C.evidences(t.lineitem, stable_id("evidence_", "l_orderkey"), F.col("l_linenumber"), ["l_linenumber"])


@query(f"""WITH {_FACTS} SELECT c.predicate, c.claims, f.facts, round(f.facts / c.claims, 6) AS ratio FROM (SELECT predicate, count(*) AS claims FROM claims GROUP BY 1) c
 JOIN (SELECT predicate, count(*) AS facts FROM facts GROUP BY 1) f USING (predicate)""")
def compression_by_field(t: Tables) -> DataFrame:
    return C.compression(claims(t), facts(t), "predicate")


@query(f"""WITH {_FACTS} SELECT CASE support_count WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3+' END AS bucket, count(*) AS facts FROM facts GROUP BY 1""")
def support_histogram(t: Tables) -> DataFrame:
    return C.support_histogram(facts(t))


@query("""SELECT md5(coalesce(text, '')) AS id, count(DISTINCT doc_id) AS keys, count(*) AS rows FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def id_collision_audit(t: Tables) -> DataFrame:
    return C.collisions(t.documents, F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.col("doc_id"))


@query(f"""WITH {_FACTS}, top AS (SELECT fact_id, l_partkey, predicate, support_count FROM facts WHERE support_count > 1 ORDER BY support_count DESC, fact_id LIMIT 25)
 SELECT top.*, array_to_string(list_sort(list_distinct(list(c.l_orderkey))), ',') AS orders FROM top JOIN claims c USING (l_partkey, predicate) GROUP BY ALL""")
def multi_support_topn(t: Tables) -> DataFrame:
    top = facts(t).where("support_count > 1").orderBy(F.desc("support_count"), "fact_id").limit(25).select("fact_id", "l_partkey", "predicate", "support_count")
    found = claims(t).join(F.broadcast(top), ["l_partkey", "predicate"])
    return found.groupBy(*top.columns).agg(F.array_join(F.array_sort(F.collect_set("l_orderkey")).cast("array<string>"), ",").alias("orders"))


@query(f"""WITH {_CLAIMS}, r AS (SELECT CASE WHEN o > 4 THEN 'over_cap' WHEN l_quantity <= 0 THEN 'no_value' WHEN l_tax > 0.07 THEN 'high_tax' WHEN bp < 5500 THEN 'low_confidence' END AS drop_reason
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM claims)) SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM r GROUP BY 1""")
def claim_drop_reasons(t: Tables) -> DataFrame:
    rows = C.validate(claims(t), {"no_value": F.col("l_quantity") <= 0, "high_tax": F.col("l_tax") > 0.07, "low_confidence": F.col("confidence") < F.lit("0.55").cast("decimal(8,4)")}, 4, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 1 THEN p.p_name WHEN l_tax = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' pcs' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(l_quantity + l_linenumber AS BIGINT) AS VARCHAR) || ' pcs' END AS label
 FROM lineitem LEFT JOIN part p ON p_partkey = l_partkey""")
def object_labels(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left")
    name = F.when(F.col("l_quantity") == 1, F.col("p_name"))
    high = F.when(F.col("l_tax") == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") + F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", C.object_label(name, F.lit(None).cast("string"), F.col("l_quantity"), high, F.lit("pcs")).alias("label"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')) AS k FROM supplier),
 c AS (SELECT c_custkey, c_nationkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '', 'g')) AS k FROM customer),
 m AS (SELECT c_custkey, (SELECT max(s_suppkey) FROM s WHERE replace(s.k, 'supplier', 'customer') = c.k) AS a,
  (SELECT max(s_suppkey) FROM s WHERE s_suppkey = c_custkey // 3 AND c_custkey % 3 = 0) AS b, (SELECT max(s_suppkey) FROM s WHERE s.s_nationkey = c.c_nationkey AND c_nationkey % 2 = 0) AS d FROM c)
 SELECT c_custkey, coalesce(a, b, d) AS target, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'code' WHEN d IS NOT NULL THEN 'nation' ELSE 'unresolved' END AS match_method,
 CAST(CASE WHEN a IS NOT NULL THEN 1.0 WHEN b IS NOT NULL THEN 0.97 WHEN d IS NOT NULL THEN 0.85 ELSE 0 END AS DOUBLE) AS match_confidence FROM m""")
def crosswalk_cascade(t: Tables) -> DataFrame:
    stages = [
        ("name", 1.0, key("c_name"), F.replace(key("s_name"), F.lit("supplier"), F.lit("customer"))),
        ("code", 0.97, F.when(F.col("c_custkey") % 3 == 0, F.floor(F.col("c_custkey") / 3).cast("string")), F.col("s_suppkey").cast("string")),
        ("nation", 0.85, F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")), F.col("s_nationkey").cast("string")),
    ]
    return match.cascade(t.customer.select("c_custkey", "c_name", "c_nationkey"), t.supplier, stages, "c_custkey", F.col("s_suppkey"), "s_suppkey").select("c_custkey", "target", "match_method", "match_confidence")


@query("""WITH c AS (SELECT 0 AS stage, 'direct' AS method, c_custkey, s_suppkey AS target FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > 8000 AND s_acctbal > 5000
 UNION ALL SELECT 1, 'alias', c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey % 500 = s_suppkey),
 n AS (SELECT c_custkey, stage, method, count(DISTINCT target) AS n, min(target) AS target FROM c GROUP BY ALL),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY stage) AS r FROM n) WHERE r = 1)
 SELECT c_custkey, CASE WHEN n = 1 THEN target END AS target, coalesce(method, 'none') AS method, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM customer LEFT JOIN f USING (c_custkey)""")
def attach_cascade_ambiguity(t: Tables) -> DataFrame:
    direct = t.customer.where("c_acctbal > 8000").join(t.supplier.where("s_acctbal > 5000"), F.col("c_nationkey") == F.col("s_nationkey"))
    alias = t.customer.join(t.supplier, F.col("c_custkey") % 500 == F.col("s_suppkey"))
    return match.exclusive_cascade(t.customer, "c_custkey", [(n, d.select("c_custkey", F.col("s_suppkey").alias("target"))) for n, d in (("direct", direct), ("alias", alias))])


@query("""WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS parent FROM customer WHERE c_acctbal > 5000 GROUP BY ALL), p AS (SELECT c_nationkey, min(c_custkey) AS parent FROM customer WHERE c_acctbal > 5000 GROUP BY ALL)
 SELECT c.c_custkey, coalesce(f.parent, p.parent) AS parent, CASE WHEN f.parent IS NOT NULL THEN 'full' WHEN p.parent IS NOT NULL THEN 'part' ELSE 'none' END AS inherited_by
 FROM customer c LEFT JOIN f USING (c_nationkey, c_mktsegment) LEFT JOIN p ON p.c_nationkey = c.c_nationkey""")
def inherit_parent_links(t: Tables) -> DataFrame:
    parents = t.customer.where("c_acctbal > 5000").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("parent"))
    rows = match.inherit(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), parents, ["c_nationkey", "c_mktsegment"], ["c_nationkey"], ["parent"])
    return rows.select("c_custkey", "parent", "inherited_by")


@query("""WITH j AS (SELECT c_custkey, n_name, r_name, c_mktsegment, s_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_suppkey = c_custkey)
 SELECT c_custkey, 'nation' AS conflict_type, n_name AS canonical_value, 'NATION_' || CAST(c_custkey % 25 AS VARCHAR) AS external_value FROM j WHERE n_name <> 'NATION_' || CAST(c_custkey % 25 AS VARCHAR)
 UNION ALL SELECT c_custkey, 'name', 'Supplier#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0'), s_name FROM j WHERE s_name <> 'Supplier#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0')""")
def conflict_explode(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left")
    pairs = {
        "nation": (F.col("n_name"), F.concat(F.lit("NATION_"), (F.col("c_custkey") % 25).cast("string"))),
        "name": (F.concat(F.lit("Supplier#"), F.lpad(F.floor(F.col("c_custkey") / 2).cast("string"), 9, "0")), F.coalesce("s_name", F.lit(""))),
    }
    return match.conflicts(rows, "c_custkey", pairs)


@query("""SELECT 'l_orderkey' AS side, count(*) FILTER (o_orderkey IS NULL) AS missing, CAST(0 AS BIGINT) AS null_keys FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey
 UNION ALL SELECT 'l_partkey', count(*) FILTER (p_partkey IS NULL), 0 FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 40) ON p_partkey = l_partkey""")
def link_integrity_anti(t: Tables) -> DataFrame:
    return quality.link_integrity(t.lineitem, [("l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey"), ("l_partkey", t.part.where("p_size < 40"), "p_partkey")])


@query("""SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, 'stub' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def dangling_backfill(t: Tables) -> DataFrame:
    nodes = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return match.backfill(nodes, "id", t.orders.select(F.col("o_custkey").alias("id")), kind=F.lit("stub"))


@query("""SELECT o_orderkey, coalesce(array_to_string(list(l_partkey ORDER BY r), ','), '') AS parts FROM orders LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem QUALIFY r <= 3) ON o_orderkey = l_orderkey GROUP BY 1""")
def optional_match_collect3(t: Tables) -> DataFrame:
    rows = match.optional_collect(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.withColumnRenamed("l_orderkey", "k"), "k", F.col("l_partkey"), F.struct("l_linenumber", "l_partkey"), 3, "parts")
    return rows.select(F.col("k").alias("o_orderkey"), F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'old_only' WHEN d.doc_id IS NULL THEN 'new_only' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def set_ops_repair_plan(t: Tables) -> DataFrame:
    return sets.compared(t.documents, t.labels, "doc_id")


@query("""WITH new AS (SELECT doc_id + 1 AS doc_id, text, lang FROM documents), old AS (SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
 s AS (SELECT *, sha256(coalesce(text, '') || '||' || coalesce(lang, '')) AS s, coalesce(length(text) >= 20, false) AS ok FROM new), o AS (SELECT DISTINCT sha256(coalesce(text, '') || '||' || coalesce(lang, '')) AS s FROM old),
 r AS (SELECT s.*, row_number() OVER (PARTITION BY s.s, ok ORDER BY doc_id) AS nth FROM s)
 SELECT doc_id, CASE WHEN NOT ok THEN 'invalid' WHEN s IN (SELECT s FROM o) THEN 'known' WHEN nth > 1 THEN 'repeated' WHEN doc_id IN (SELECT doc_id FROM old) THEN 'id_taken' ELSE 'accepted' END AS outcome FROM r""")
def additive_merge_strict(t: Tables) -> DataFrame:
    """All documents, under the next id, merged into those that have labels."""
    d = t.documents.select("doc_id", "text", "lang")
    old = d.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    new = d.withColumn("doc_id", F.col("doc_id") + 1)
    return sets.additive(old, new, ["text", "lang"], "doc_id", F.char_length("text") >= 20, ["doc_id"]).select("doc_id", "outcome")


@query("""SELECT user_id, arg_max(CASE WHEN event_type <> 'view' THEN event_type END, CASE WHEN event_type <> 'view' THEN event_id END) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY 1""")
def merge_node_overlay(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("event_type"), "props")
    return sets.overlay([rows], "user_id", "event_id", ["event_type", "props"])


@query("""SELECT user_id, CAST(min(event_id) AS BIGINT) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def first_wins(t: Tables) -> DataFrame:
    return windows.first_row(t.events.select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("""SELECT user_id, CAST(max(event_id) AS BIGINT) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def latest_wins(t: Tables) -> DataFrame:
    return windows.last_row(t.events.select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("""SELECT coalesce(a.k, r.k) AS k, coalesce(r.total, a.total) AS total, CASE WHEN a.k IS NULL THEN 'repair' WHEN r.k IS NULL THEN 'old' ELSE 'old,repair' END AS sources
 FROM (SELECT l_orderkey AS k, count(*) AS total FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON a.k = r.k""")
def merged_source_rows(t: Tables) -> DataFrame:
    side = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("total"))
    return match.merged_sources(side("A"), side("R"), "k").withColumn("sources", F.array_join("sources", ","))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, sha1(CAST(l_orderkey AS VARCHAR) || '||' || CAST(l_partkey AS VARCHAR) || '||') AS h FROM lineitem""")
def stable_ids_keep_separators(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.sha1(joined("l_orderkey", "l_partkey", F.lit(None)).cast("binary")).alias("h"))
