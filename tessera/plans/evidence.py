"""Names, facts with their evidence, further claims, scored chunks and sections on orders, parts, events and documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import evidence, supplements
from tessera.plans.registry import Tables, query


@query("""SELECT c_custkey, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS lookup, upper('Avibase-' || c_custkey)[9:] AS ext, CASE WHEN c_custkey % 3 = 0 THEN 'subspecies' WHEN c_custkey % 3 = 1 THEN 'order' ELSE 'clade' END AS rank,
 CASE c_custkey % 5 WHEN 0 THEN 'Least Concern' WHEN 1 THEN 'Critically Endangered' WHEN 2 THEN 'Not Evaluated' WHEN 3 THEN 'Extinct' ELSE 'PE' END AS status, trim(lower(replace(c_name, '#', ' '))) AS plain, c_name AS record, CASE WHEN c_custkey % 2 = 0 THEN 'AF,NA' ELSE '' END AS codes FROM customer""")
def name_lookup_keys(t: Tables) -> DataFrame:
    """Every customer as a taxon: its name under all kinds of keys; expected values are written out."""
    k = F.col("c_custkey")
    rank = F.when(k % 3 == 0, " SSP ").when(k % 3 == 1, "Order").otherwise("Clade")
    status = F.when(k % 5 == 0, "lc").when(k % 5 == 1, "CR").when(k % 5 == 2, " ").when(k % 5 == 3, "Extinct").otherwise("PE")
    codes = F.when(k % 2 == 0, "Africa (AF, NA), again (AF) and (no)").otherwise("none (yet)")
    return t.customer.select(
        "c_custkey", names.lookup_key("c_name", "scientific_name").alias("lookup"), names.lookup_key(F.concat(F.lit("avibase-"), k.cast("string")), "external_id").alias("ext"), names.rank(rank).alias("rank"), names.status(status).alias("status"),
        names.table_name("c_name").alias("plain"), names.record_name(F.concat("c_name", F.lit("  scientific name Definitions "))).alias("record"), F.array_join(names.bracketed_codes(codes), ",").alias("codes"),
    )


@query("""SELECT CAST(event_id AS VARCHAR) AS fact_id, CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE 'taxon ' || user_id END AS subject_taxon_id, CASE WHEN event_type = 'view' THEN '' ELSE 'taxon ' || user_id END AS subject_name, CASE WHEN event_type = 'click' THEN 'GeneralFacts' ELSE event_type END AS fact_domain,
 CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS predicate, CASE WHEN event_type = 'view' THEN 'seen' ELSE CAST(user_id AS VARCHAR) END AS object_text, '' AS object_canonical_name, CAST(user_id AS VARCHAR) AS value_text, coalesce(CAST(value AS DOUBLE), 0.0) AS confidence FROM events""")
def normalized_facts(t: Tables) -> DataFrame:
    """Events as facts of differing fields."""
    kind = F.col("event_type")
    rows = t.events.select(
        F.lit(" ").alias("fact_id"), F.col("event_id").alias("id"), F.when(kind == "view", F.col("user_id")).alias("taxon_id"), F.when(kind != "view", F.concat(F.lit(" taxon  "), F.col("user_id").cast("string"))).alias("species"),
        F.when(kind != "click", kind).alias("fact_type"), F.when(kind == "view", "seen").alias("object_text"), F.col("user_id").alias("value_text"), F.col("value").alias("confidence"),
    )
    return evidence.facts_of(rows)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS fact_id, CAST(l_partkey AS VARCHAR) AS evidence_id FROM lineitem WHERE l_returnflag <> 'N'""")
def evidence_edges(t: Tables) -> DataFrame:
    """Line items as edges of several types, under names and prefixes of either kind."""
    flag, order, part = F.col("l_returnflag"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    edges = t.lineitem.select(
        F.when(flag == "N", "MENTIONS").when(flag == "R", "SUPPORTED_BY").alias("type"), F.when(flag == "A", order).alias("fact_id"), F.when(flag != "A", F.concat(F.lit("fact:"), order)).alias("source"),
        F.when(flag == "A", F.concat(F.lit("evidence:"), part)).alias("evidence_id"), F.when(flag != "A", part).alias("target"),
    )
    return evidence.links_of(edges)


_ASK = "Which red hot widget or ring is big?"


@query("""WITH e AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, list_distinct(regexp_extract_all(lower('URGENT ' || p_name || ' ' || p_type), '[a-z][a-z0-9\\-]{2,}')) AS w FROM part),
 c AS (SELECT o_orderkey, l_linenumber, p_partkey, p_name, p_brand, w, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN e ON p_partkey = l_partkey)
 SELECT o_orderkey, p_partkey AS evidence_id, CAST(coalesce(len(list_intersect(['which', 'red', 'hot', 'widget', 'ring', 'big'], w)), 0) + o_orderkey % 2 AS DOUBLE) AS score, 'Ordered: ' || o_orderkey || coalesce(chr(10) || 'Evidence: ' || trim(regexp_replace(p_name, ' +', ' ', 'g')) || chr(10) || 'Chunk: ' || p_brand, '') AS item FROM c WHERE n = 1""")
def scored_fact_chains(t: Tables) -> DataFrame:
    """Orders as facts, each with its first line's part as evidence, scored against a question."""
    facts = t.orders.select(F.col("o_orderkey").alias("fact_id"))
    links = t.lineitem.select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("evidence_id"), "l_linenumber")
    parts = t.part.select(F.col("p_partkey").alias("evidence_id"), F.col("p_name").alias("quote"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("chunk_id"))
    chunks = t.part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("chunk"))
    rows = evidence.first_evidence(evidence.chains(facts, links, parts, chunks, "chunk_id"), ["fact_id"], [F.col("l_linenumber"), F.col("evidence_id")])
    score = evidence.fact_score(F.lit(_ASK), F.concat_ws(" ", F.when(F.col("quote").isNotNull(), "URGENT"), "quote", "kind"), F.col("fact_id") % 2)
    item = evidence.fact_item(F.lit("Ordered"), F.col("fact_id").cast("string"), F.col("quote"), F.col("chunk"))
    return rows.select(F.col("fact_id").alias("o_orderkey"), "evidence_id", score.alias("score"), item.alias("item"))


@query("""SELECT c_custkey, unnest(['nation', 'segment']) AS key, unnest([CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal <= 0""")
def qualifier_rows(t: Tables) -> DataFrame:
    entries = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(" "))
    return evidence.qualifiers_of(t.customer.select("c_custkey", entries.alias("q")), "c_custkey", "q")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'supclaim_' || left(sha1(l_orderkey || '||' || l_partkey || '||' || l_returnflag || '||claim_cap_supplement'), 16) AS supplement_claim_id, 1 AS supplement_round, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS INTEGER) AS supplement_index_in_round,
 lower(l_returnflag || ' ' || l_partkey) AS signature FROM lineitem""")
def supplement_claims(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag"), F.lit(1).alias("_private"), supplements.claim_signature("l_returnflag", "l_partkey").alias("signature"))
    return supplements.numbered(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"], ["l_orderkey", "l_partkey", "l_returnflag"]).drop("l_returnflag")


_REVIEWS = "r AS (SELECT o_orderkey, o_orderpriority AS bucket, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'dry_run' END AS status, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def _reviews(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "dry_run")
    return t.orders.join(counts, "o_orderkey", "left").select("o_orderkey", F.col("o_orderpriority").alias("bucket"), status.alias("status"), "n")


@query(f"""WITH {_REVIEWS} SELECT o_orderkey, CAST(coalesce(status, '') = 'ok' AS INTEGER) AS rounds, CASE WHEN status = 'ok' THEN coalesce(n, 0) ELSE 0 END AS found, coalesce(status = 'ok' AND n >= 6, false) AS hit_cap,
 CASE WHEN status = 'ok' AND n >= 6 THEN 'completed_round_1_hit_soft_cap' WHEN status = 'ok' THEN 'completed_round_1_not_hit_cap' WHEN status = 'dry_run' THEN 'dry_run' ELSE 'failed_round_1' END AS final_status FROM r""")
def review_completion(t: Tables) -> DataFrame:
    return _reviews(t).select("o_orderkey", supplements.completion(F.col("status"), F.col("n"), 6).alias("c")).select("o_orderkey", "c.*")


@query(f"""WITH {_REVIEWS}, a AS (SELECT bucket, count(*) AS reviews, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'ok' AND n > 0) AS positive, count(*) FILTER (status = 'ok' AND n >= 6) AS hits, CAST(coalesce(sum(n) FILTER (status = 'ok'), 0) AS BIGINT) AS found FROM r GROUP BY ROLLUP (bucket))
 SELECT *, CASE WHEN ok = 0 THEN 0 ELSE round(positive / ok, 6) END AS positive_ratio, CASE WHEN ok = 0 THEN 0 ELSE round(hits / ok, 6) END AS hit_ratio, CASE WHEN ok = 0 THEN 0 ELSE round(found / ok, 6) END AS found_per_ok, CASE WHEN positive = 0 THEN 0 ELSE round(found / positive, 6) END AS found_per_positive FROM a""")
def verification_rounds(t: Tables) -> DataFrame:
    return supplements.verified(_reviews(t), "status", "n", "bucket", 6)


@query("""SELECT key, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(chosen) AS BIGINT) AS chosen FROM (SELECT n_name AS key, count(*) AS raw, count(*) FILTER (c_acctbal > 0) AS chosen FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT n_name, count(*), count(*) FILTER (s_acctbal > 0) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) GROUP BY 1""")
def combined_breakdowns(t: Tables) -> DataFrame:
    """Breakdowns of customers and of suppliers by nation, added up."""
    side = lambda rows, p: rows.join(t.nation, F.col(f"{p}_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("key")).agg(F.count("*").alias("raw"), F.count_if(F.col(f"{p}_acctbal") > 0).alias("chosen"))
    return supplements.combined([side(t.customer, "c"), side(t.supplier, "s")], ["key"], ["raw", "chosen"])


@query("""SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS attached, count(*) FILTER (o_orderstatus <> 'F') AS unresolved, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY 1""")
def attachment_rates(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "attached").otherwise("unresolved").alias("status"))
    return supplements.attachment_summary(rows, "kind", "status")


@query("""WITH c AS (SELECT lang AS kind, source AS reason, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, reason) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""")
def top_unresolved_reasons(t: Tables) -> DataFrame:
    return supplements.top_reasons(t.documents.select(F.col("lang").alias("kind"), F.col("source").alias("reason")), "kind", "reason", 3)
