"""Checklists, chunks, scopes, questions and representative relations on customers, orders, documents, labels and events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import records
from tessera.plans.registry import Tables, query


@query("""SELECT 'B' AS source, 'v1' AS release, CASE WHEN c_custkey % 4 = 0 THEN 'subspecies' WHEN c_custkey % 4 = 1 THEN 'species' ELSE '' END AS rank, 'code' || c_custkey AS species_code, CASE WHEN c_custkey % 2 = 0 THEN 'AB' || c_custkey ELSE '' END AS external_id, '' AS change_note, c_mktsegment AS website_note, c_name AS english_name,
 'Parus minor' || c_nationkey AS scientific_name, '' AS range_text, 'Order, ' || c_nationkey AS order_name, 'Fam' || c_nationkey AS family_name, 'Parus' AS genus_name FROM customer WHERE c_custkey % 5 > 0""")
def checklist_rows(t: Tables) -> DataFrame:
    """Customers as a sheet of the second checklist; every fifth row is blank."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    cells = {
        "category": F.when(k % 4 == 0, " SSP").when(k % 4 == 1, "Species"), "species_code": F.concat(F.lit(" CODE"), k.cast("string")), "taxon concept ID": F.when(k % 2 == 0, F.concat(F.lit("avibase-ab"), k.cast("string"))), "Clements v2025 change": F.lit(None),
        "text for website v2025": F.concat(F.lit(" "), "c_mktsegment"), "English name": F.col("c_name"), "scientific name": F.concat(F.lit("Parus  minor"), nation), "range": F.lit(" "), "order": F.concat(F.lit("Order , "), nation), "family": F.concat(F.lit("Fam"), nation, F.lit(" (Tits)")),
    }
    return records.checklist(t.customer.select(*(F.when(k % 5 > 0, c).alias(n) for n, c in cells.items())), records.CHECKLIST_B, "B", "v1", records.MEANINGFUL_B)


@query("""SELECT 'db' AS source_db, 'r1' AS source_release, doc_id AS source_chunk_id, CASE WHEN quality = 1 THEN 'Diet' ELSE source END AS source_chapter, CASE WHEN toxic = 1 THEN 'Food' ELSE 'Unknown' END AS source_subchapter, 'taxon' || doc_id % 7 AS subject_taxon_id, 'species' AS subject_rank, coalesce(lang, '') AS common_name, CASE WHEN doc_id % 2 = 0 THEN 'linked' ELSE coalesce(lang, '') END AS scientific_name FROM labels LEFT JOIN documents USING (doc_id)""")
def chunk_metadata(t: Tables) -> DataFrame:
    """Labels as links to documents as chunks."""
    k = F.col("doc_id")
    links = t.labels.select(k.alias("chunk_id"), F.when(F.col("quality") == 1, "Diet").otherwise("").alias("source_chapter"), F.when(F.col("toxic") == 1, "Food").alias("source_subchapter"), F.concat(F.lit("taxon"), (k % 7).cast("string")).alias("canonical_taxon_id"), F.when(k % 2 == 0, "linked").alias("species_name"))
    chunks = t.documents.select(k.alias("chunk_id"), F.col("source").alias("source_chapter"), F.col("lang").alias("species_name"), F.col("lang").alias("common_name"))
    return records.chunk_metadata(links, chunks, "species", "db", "r1")


@query("""SELECT 'p' || p_partkey AS chunk_id, p_name AS raw_text, '' AS source_db, '' AS source_file, p_type AS source_chapter, 'Unknown' AS source_subchapter, 'Unknown' AS source_chapter_raw, p_brand AS species_name, CAST(NULL AS VARCHAR) AS family_name, CAST(NULL AS VARCHAR) AS order_name, p_name AS cleaned_text FROM part
 UNION ALL SELECT 'c' || c_custkey, '', 'C', '', 'Unknown', 'Unknown', 'Unknown', NULL, c_mktsegment, NULL, '' FROM customer""")
def evidence_chunk_union(t: Tables) -> DataFrame:
    """Parts as chunks of species, customers as chunks of families, which lack a text."""
    species = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.concat("p_name", F.lit("")).alias("raw_text"), F.col("p_type").alias("source_chapter"), F.col("p_brand").alias("species_name"))
    family = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chunk_id"), F.lit("C").alias("source_db"), F.col("c_mktsegment").alias("family_name"))
    return records.evidence_chunks(species, family)


@query("""SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal > 0 THEN c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey < 3) ELSE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) END""")
def family_scope(t: Tables) -> DataFrame:
    """Customers by the segments of the first ones as families; those without money by the nations of rich suppliers as orders."""
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("family"), F.col("c_nationkey").alias("order"))
    families, orders = t.customer.where("c_custkey < 3").select(F.col("c_mktsegment").alias("family")), t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("order"))
    return records.in_scope(rows, families, orders, "family", "order").select("c_custkey")


_CHAPTERS = [("BOW_family", "x", "Diet & Foraging", "a"), ("x", "Parus", " unknown ", " raw "), (None, "", None, None), ("y", None, "Systematics  history", ""), ("z", "P", "My Heading", "My")]


@query("""WITH c(i, kind, chapter, family, sub) AS (VALUES (0, 'family', 'Diet & Foraging', 'DietAndForaging', 'DietAndForaging'), (1, 'species', 'raw', 'Unknown', 'unknown'), (2, 'family', 'Unknown', 'Unknown', 'Unknown'), (3, 'family', 'Systematics  history', 'Systematics', 'Systematics'), (4, 'species', 'My Heading', 'Unknown', 'My Heading'))
 SELECT event_id, kind, chapter, family, CASE WHEN family = 'Unknown' AND user_id % 2 = 1 THEN 'Unknown' ELSE sub END AS sub FROM events JOIN c ON i = event_id % 5""")
def chunk_kinds(t: Tables) -> DataFrame:
    """Literal chunks, dealt over all events; the expected kinds and chapters are written out."""
    cases = F.element_at(F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(case, "abcd"))) for case in _CHAPTERS)), (F.col("event_id") % len(_CHAPTERS) + 1).cast("int"))
    rows = t.events.select("event_id", "user_id", cases.alias("c"))
    family, parent = records.family_chapter(F.col("c.c")), F.when(F.col("user_id") % 2 == 0, "Habitat")
    return rows.select("event_id", records.chunk_kind(F.col("c.a"), F.col("c.b"), F.lit(None).cast("string"), "family").alias("kind"), records.chunk_chapter(F.col("c.c"), F.col("c.d")).alias("chapter"), family.alias("family"), records.subchapter(F.col("c.c"), family, parent).alias("sub"))


@query("""SELECT lang, count(*) AS n_total, count(quality) AS n_scored, count(*) FILTER (toxic > 0) AS n_invalid, round(coalesce(avg(round(CAST(quality * 80.125 AS DOUBLE), 2)), 0), 6) AS avg_score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def answer_summaries(t: Tables) -> DataFrame:
    scores = t.labels.select("doc_id", (F.col("quality") * F.lit(80.125)).cast("double").alias("score"), F.col("toxic").alias("invalid"))
    return records.answer_summary(t.documents.select("doc_id", "lang"), scores, "doc_id", ["lang"], "score", "invalid")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 'exact' WHEN '2-HIGH' THEN 'alias' ELSE 'none' END AS kind FROM orders),
 u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY kind, o_custkey ORDER BY o_totalprice, o_orderkey) = 1), s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o_totalprice, o_orderkey) AS n FROM u), c AS (SELECT o_orderkey, kind, o_totalprice FROM s WHERE kind <> 'none' AND n <= 3),
 o AS (SELECT o_orderkey, kind, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)) SELECT o_orderkey, kind FROM c UNION ALL SELECT o_orderkey, kind FROM o WHERE n + (SELECT count(*) FROM c) <= 8""")
def representative_relations(t: Tables) -> DataFrame:
    """Orders as relations of three kinds to show eight of, three at most of a kind with a budget."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "exact").when(F.col("o_orderpriority") == "2-HIGH", "alias").otherwise("none")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", kind.alias("kind"))
    return records.representatives(rows, "o_orderkey", "kind", "o_custkey", ["o_totalprice"], {"exact": 3, "alias": 3}, 8).select("o_orderkey", "kind")
