"""Chunks, sections, examples and reports on documents, benchmark, orders and events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import audits, chunks
from tessera.plans.registry import Tables, query
from tessera.plans.retrieval import _LEXICAL, _lexical


@query(f"""WITH {_LEXICAL}, x AS (SELECT item_id, doc_id, 80.0 AS score FROM benchmark JOIN documents ON source = 'src' || item_id % 40), a AS (SELECT item_id, doc_id, round(CAST(sum(score) AS DOUBLE), 4) AS score FROM (SELECT item_id, doc_id, CAST(score AS DOUBLE) AS score FROM s UNION ALL SELECT * FROM x) GROUP BY 1, 2)
 SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM a WHERE score > 0 QUALIFY rank <= 5""")
def target_chunk_scores(t: Tables) -> DataFrame:
    """Benchmark items as questions, each on one source: documents by shared words, and those of the source far ahead."""
    asked = t.benchmark.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 40).cast("string")).alias("name"))
    return chunks.target_scores(_lexical(t), asked, t.documents.select("doc_id", F.col("source").alias("name")), "item_id", "doc_id", "name", 5)


_HEADINGS = [("Conservation and Management", "Status"), ("Introduction", "Threats"), ("Habitat; human threat", "threat level"), ("Distribution history", "Historical decline"), ("Demography", "population status"), ("Systematics History", None), (None, "extinction"), ("Diet and Foraging", "other")]


@query("""WITH c(i, protection, history, features) AS (VALUES (0, 34.0, 0.0, 0.0), (1, 18.0, 18.0, 18.0), (2, 18.0, 0.0, 12.0), (3, 12.0, 28.0, 0.0), (4, 6.0, 0.0, 0.0), (5, 0.0, 28.0, 0.0), (6, 0.0, 0.0, 0.0), (7, 0.0, 0.0, 12.0))
 SELECT event_id, CAST(protection AS DOUBLE) AS protection, CAST(CASE WHEN user_id % 2 = 0 THEN history ELSE features END AS DOUBLE) AS family FROM events JOIN c ON i = event_id % 8""")
def heading_bonuses(t: Tables) -> DataFrame:
    """Literal headings and kinds of question, dealt over all events; the expected bonuses are written out."""
    cases = F.element_at(F.array(*(F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b")) for a, b in _HEADINGS)), (F.col("event_id") % len(_HEADINGS) + 1).cast("int"))
    rows = t.events.select("event_id", "user_id", cases.alias("c"))
    return rows.select("event_id", chunks.protection_bonus(F.col("c.a"), F.col("c.b")).alias("protection"), chunks.family_bonus(F.col("c.a"), F.col("user_id") % 2 == 0).alias("family"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS place FROM documents),
 f AS (SELECT doc_id, place, trim(line) AS line, CAST(len(regexp_extract_all(lower(line), '[a-z]*tion[a-z]*')) AS DOUBLE) AS first FROM l WHERE trim(line) <> '')"""


def _sections(t: Tables) -> DataFrame:
    """Lines of every document as its sections, scored by how many words with 'tion' they hold."""
    rows = t.documents.select("doc_id", F.posexplode(F.split(X.text("text"), "\n")).alias("place", "line")).select("doc_id", "place", F.trim("line").alias("line"))
    return rows.where("line <> ''").withColumn("first", F.size(F.regexp_extract_all(F.lower("line"), F.lit("[a-z]*tion[a-z]*"), F.lit(0))).cast("double"))


_SHORT = _LINES + """, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first DESC, place) AS r FROM f QUALIFY r <= 8), h AS (SELECT doc_id, place, line, round(0.35 * first + 0.65 * CAST(length(line) AS DOUBLE), 6) AS score FROM b)"""


def _shortlisted(t: Tables) -> DataFrame:
    return chunks.shortlisted(_sections(t), "doc_id", "place", "first", F.char_length("line"))


@query(f"WITH {_SHORT} SELECT doc_id, CAST(place AS INTEGER) AS place, score FROM h")
def section_shortlist(t: Tables) -> DataFrame:
    return _shortlisted(t).select("doc_id", "place", "score")


@query(f"""WITH {_SHORT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM h QUALIFY r <= 3), j AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY r) AS c FROM k GROUP BY 1)
 SELECT doc_id, md5(CASE WHEN length(c) >= 120 THEN c ELSE coalesce(text, '') END) AS context FROM documents LEFT JOIN j USING (doc_id)""")
def section_context(t: Tables) -> DataFrame:
    whole = t.documents.select("doc_id", F.col("text").alias("line"))
    return chunks.source_context(_shortlisted(t), whole, "doc_id", "place", "line").select("doc_id", F.md5(F.col("context").cast("binary")).alias("context"))


@query("""WITH p AS (SELECT item_id AS example, 'src' || item_id % 10 AS kind FROM benchmark), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY example) AS rank FROM p QUALIFY rank <= 2), a AS (SELECT example, row_number() OVER (ORDER BY example) AS rank FROM p QUALIFY rank <= 2)
 SELECT doc_id, example, CAST(rank AS INTEGER) AS rank FROM documents JOIN o ON kind = source UNION ALL SELECT doc_id, example, CAST(rank AS INTEGER) FROM documents, a WHERE coalesce(source, '') NOT IN (SELECT kind FROM p)""")
def few_examples(t: Tables) -> DataFrame:
    """For every document two benchmark items of its source, or the first two of all."""
    pool = t.benchmark.select(F.col("item_id").alias("example"), F.concat(F.lit("src"), (F.col("item_id") % 10).cast("string")).alias("kind"))
    return chunks.examples(t.documents.select("doc_id", F.col("source").alias("kind")), pool, "doc_id", "kind", "example")


@query(None)
def key_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", chunks.key_sentences(F.col("text"), ["tion", "hab", "nest"], 300).alias("evidence"))


@query("""WITH c AS (SELECT p_name AS chapter, len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z][a-z0-9\\-]{2,}')), ['red', 'ring', 'widget'])) AS shared FROM (SELECT DISTINCT p_name FROM part)) SELECT chapter, CAST(shared AS INTEGER) AS shared FROM c WHERE shared > 0 ORDER BY shared DESC, chapter LIMIT 6""")
def preferred_chapters(t: Tables) -> DataFrame:
    return chunks.preferred(t.part.select(F.col("p_name").alias("chapter")), "chapter", ["red", "ring", "widget"])


@query("""SELECT item_id, left(trim(replace(coalesce(text, ''), chr(10), ' ')), 120) AS answer_preview, count(*) OVER () AS total_size FROM benchmark""")
def manifest_previews(t: Tables) -> DataFrame:
    size = t.benchmark.agg(F.count("*").alias("total_size"))  # one row
    return t.benchmark.select("item_id", chunks.preview("text").alias("answer_preview")).join(size)


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS grp, coalesce(n, 0) AS v, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 4 END AS cap FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
 SELECT grp, count(*) AS rows, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (cap > 0 AND v >= cap) AS at, count(*) FILTER (cap > 0 AND v = cap) AS exactly, count(*) FILTER (cap > 0 AND v > cap) AS above, round(sum(v) / count(*), 6) AS mean, round(count(*) FILTER (cap > 0 AND v >= cap) / count(*), 6) AS share_at FROM r WHERE grp <> '' GROUP BY 1""")
def high_information_groups(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = t.orders.join(counts, "o_orderkey", "left").select(F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("grp"), F.coalesce("n", F.lit(0)).alias("v"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(4).alias("cap"))
    return audits.group_caps(rows, "grp", "v", "cap")


@query("""WITH e AS (SELECT event_type AS item, CAST(user_id AS VARCHAR) AS model, count(*) AS n, avg(CAST(user_id % 7 AS DOUBLE)) AS m FROM events GROUP BY 1, 2)
 SELECT item, 'counted' AS "group", model, 'n' AS metric, printf('%.2f', CAST(n AS DOUBLE)) AS score FROM e WHERE item = 'view' UNION ALL SELECT item, 'averaged', model, CASE item WHEN 'click' THEN 'm' ELSE 'n' END, printf('%.2f', CASE item WHEN 'click' THEN m ELSE CAST(n AS DOUBLE) END) FROM e WHERE item IN ('click', 'error')""")
def metric_overview(t: Tables) -> DataFrame:
    """Counts of one event type and either counts or means of others, as one table of chosen metrics."""
    rows = t.events.groupBy(F.col("event_type").alias("item"), F.col("user_id").cast("string").alias("model")).agg(F.count("*").alias("n"), F.avg((F.col("user_id") % 7).cast("double")).alias("m"))
    return audits.overview([(rows, "counted", {"view": "n"}), (rows, "averaged", {"click": "m", "error": "n"})], "item", "model")


_TOPIC = ["red", "ring", "hot"]


@query("""SELECT p_partkey, CAST(CAST(contains(lower(p_name), 'red') AS INTEGER) + CAST(contains(lower(p_name), 'ring') AS INTEGER) + CAST(contains(lower(p_name), 'hot') AS INTEGER) + CASE WHEN p_size % 2 = 0 THEN 0.35 ELSE 0 END AS DOUBLE) AS score FROM part""")
def walk_row_scores(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(chunks.step_score(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), _TOPIC), 6).alias("score"))
