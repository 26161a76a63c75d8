"""Retrieval and trait-table queries on documents, benchmark, embeddings, parts and customers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import measure
from tessera.functions import text as X
from tessera.operators import match, scoring
from tessera.operators import retrieve as R
from tessera.operators import tables as T
from tessera.plans.registry import Tables, query
from tessera.plans.texts import _tokens

_LEFT_OUT = ", ".join(f"'{w}'" for w in X.RETRIEVAL_STOPWORDS)


def _words(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(replace(coalesce({c}, ''), '’', '''')), '[a-z0-9''|-]+'), lambda t: length(t) > 1 AND t NOT IN ({_LEFT_OUT}))"


_IDF = f"""k AS (SELECT doc_id, {_words('text')} AS t FROM documents), p AS (SELECT doc_id, token, len(any_value(t)) AS n, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS token FROM k) GROUP BY 1, 2),
 i AS (SELECT token, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1, 6) AS idf FROM p GROUP BY 1)"""
_LEXICAL = _IDF + f""", q AS (SELECT DISTINCT item_id, unnest({_words('text')}) AS token FROM benchmark), s AS (SELECT item_id, doc_id, round(sum(CAST(idf AS DECIMAL(18, 6))) - CASE WHEN max(n) < 12 THEN 3 ELSE 0 END, 4) AS score FROM q JOIN i USING (token) JOIN p USING (token) GROUP BY 1, 2)"""


def _present(t: Tables) -> DataFrame:
    return R.presence(t.documents.select("doc_id", "text"), "doc_id", "text")


def _lexical(t: Tables) -> DataFrame:
    """Scores of benchmark items against documents; weights of their tokens only, summed exactly."""
    asked = R.asked_tokens(t.benchmark, "item_id", "text").select("token").distinct()
    weights = R.idf(_present(t), t.documents.count(), asked)
    return R.lexical_scores(t.benchmark, "item_id", "text", _present(t), weights.withColumn("idf", F.col("idf").cast("decimal(18,6)")), "doc_id")


@query(f"WITH {_IDF} SELECT * FROM i")
def idf(t: Tables) -> DataFrame:
    return R.idf(_present(t), t.documents.count())


@query(f"WITH {_LEXICAL} SELECT item_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def lexical_topk(t: Tables) -> DataFrame:
    return R.top_k(_lexical(t), "item_id", "doc_id", 5).withColumn("score", F.col("score").cast("double"))


_VECTOR = """v AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS own, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0)"""


@query(f"WITH {_VECTOR} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, score FROM v QUALIFY rank <= 10")
def vector_topk(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.vector_top_k(asked, "query_id", "q", t.embeddings, "vec_id", "embedding", 10)


@query(f"""WITH {_VECTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v WHERE vec_id <> query_id QUALIFY rank <= 5), f AS (SELECT query_id, min(rank) FILTER (label = own) AS place FROM r GROUP BY 1)
 SELECT query_id, CAST(coalesce(place, 0) = 1 AS INTEGER) AS top1_hit, CAST(place IS NOT NULL AS INTEGER) AS top5_hit, CAST(coalesce([1.0, 0.8, 0.6, 0.4, 0.2][place], 0) AS DOUBLE) AS weighted_top5_score FROM f""")
def ranked_hit_weights(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = R.vector_top_k(asked, "query_id", "q", t.embeddings, "vec_id", "embedding", 6).where("vec_id <> query_id")
    labels = t.embeddings.select("vec_id", F.col("label").cast("string").alias("label"))
    rows = found.join(labels, "vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 5")
    lists = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("guesses"))
    scored = scoring.ranked_score(F.col("guesses"), F.col("label"))
    return lists.join(labels.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", *(c.alias(n) for n, c in scored.items()))


@query(f"""WITH {_LEXICAL}, l AS (SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 5),
 e AS (SELECT i.item_id, d.vec_id AS doc_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id CROSS JOIN embeddings d QUALIFY row_number() OVER (PARTITION BY i.item_id ORDER BY score DESC, doc_id) <= 5)
 SELECT coalesce(l.item_id, e.item_id) AS item_id, coalesce(l.doc_id, e.doc_id) AS doc_id, round(CAST(coalesce(l.score, 0) AS DOUBLE) + coalesce(e.score, 0), 6) AS score FROM l FULL JOIN e ON l.item_id = e.item_id AND l.doc_id = e.doc_id""")
def hybrid_fusion(t: Tables) -> DataFrame:
    lexical = lexical_topk(t).select("item_id", "doc_id", "score")
    asked = t.benchmark.select("item_id").join(t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")), "item_id")
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    near = R.vector_top_k(asked, "item_id", "q", vectors, "doc_id", "embedding", 5).select("item_id", "doc_id", "score")
    return match.fused(lexical, near, ["item_id", "doc_id"], "score").withColumn("score", F.round("score", 6))


@query(None)
def rerank_and_snippet(t: Tables) -> DataFrame:
    found = lexical_topk(t).join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("question")), "item_id")
    out = R.rerank(found, "item_id", R.lexical_rerank_score(F.col("question"), F.col("text")), "score", "doc_id", 3)
    return out.select("item_id", "doc_id", "rank_before", "rank_after", "rerank_score", R.best_snippet(F.col("text"), X.query_terms("question")).alias("snippet"))


@query(None)
def diverse_context(t: Tables) -> DataFrame:
    from tessera.operators.windows import diverse

    found = lexical_topk(t).join(t.documents.select("doc_id", "source", "lang"), "doc_id").select("item_id", "doc_id", "source", "lang", "rank")
    return diverse(found, "item_id", "rank", "source", "doc_id", 3, 1)


@query(f"""WITH w AS (SELECT doc_id, unnest({_tokens('text', 3)}) AS token, generate_subscripts({_tokens('text', 3)}, 1) AS i FROM documents WHERE lang = 'en'), s AS (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS hay FROM part)
 SELECT p_partkey, CAST(1.0 * CAST(list_contains(regexp_extract_all(hay, '[a-z0-9]+'), 'red') AS INTEGER) + 1.8 * CAST(list_contains(regexp_extract_all(hay, '[a-z0-9]+'), 'ring') AS INTEGER) + 1.2 * CAST(contains(hay, 'red ring') AS INTEGER) AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50""")
def row_score_topk(t: Tables) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    terms = F.array(F.lit("red"), F.lit("ring"))
    weights = F.transform(terms, lambda w: R.token_weight(w, (), ("ring",)))
    scored = t.part.select("p_partkey", R.row_score(terms, F.regexp_extract_all(hay, F.lit("[a-z0-9]+"), F.lit(0)), hay, weights).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(50)


@query(f"""WITH k AS (SELECT item_id, unnest({_tokens('text', 1)}) AS token FROM benchmark), h AS (SELECT item_id, CAST('0x' || left(sha1(token), 8) AS BIGINT) AS h FROM k), b AS (SELECT item_id, h % 64 AS bucket, sum(CASE WHEN (h >> 31) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM h GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(s * s)) AS n FROM b GROUP BY 1)
 SELECT item_id, CAST(bucket AS INTEGER) AS bucket, round(s / n, 6) AS value FROM b JOIN n USING (item_id) WHERE s <> 0""")
def hash_embedding(t: Tables) -> DataFrame:
    return measure.hash_vectors(t.benchmark, "item_id", X.tokens("text", 1), 64).withColumn("value", F.round("value", 6))


@query("""SELECT 'p_size' AS column, q, quantile_cont(CAST(p_size AS DOUBLE), q) AS value FROM part, (SELECT unnest([0.05, 0.1, 0.2, 0.8, 0.9, 0.95]::DOUBLE[]) AS q) GROUP BY q""".replace("quantile_cont(CAST(p_size AS DOUBLE), q)", "CASE q WHEN 0.05 THEN quantile_cont(CAST(p_size AS DOUBLE), 0.05) WHEN 0.1 THEN quantile_cont(CAST(p_size AS DOUBLE), 0.1) WHEN 0.2 THEN quantile_cont(CAST(p_size AS DOUBLE), 0.2) WHEN 0.8 THEN quantile_cont(CAST(p_size AS DOUBLE), 0.8) WHEN 0.9 THEN quantile_cont(CAST(p_size AS DOUBLE), 0.9) ELSE quantile_cont(CAST(p_size AS DOUBLE), 0.95) END"))
def quantile_thresholds(t: Tables) -> DataFrame:
    qs = [0.05, 0.1, 0.2, 0.8, 0.9, 0.95]
    wide = t.part.agg(F.percentile(F.col("p_size").cast("double"), F.array(*(F.lit(q) for q in qs))).alias("v"))
    return wide.select(F.lit("p_size").alias("column"), F.explode(F.arrays_zip(F.array(*(F.lit(q) for q in qs)).alias("q"), F.col("v").alias("value"))).alias("z")).select("column", "z.q", "z.value")


_QUESTION = "Which big parts of type economy or promo are made by Brand#2 or Brand#17?"


def _asked(t: Tables) -> T.Constraints:
    return T.parse(_QUESTION, T.vocabulary(t.part, ["p_type", "p_brand"]), {}, {"big": ("p_size", ">=", 0.8)})


@query("""SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_brand IN ('Brand#2', 'Brand#17') AND p_size >= (SELECT quantile_cont(p_size, 0.8) FROM part)""")
def constraint_filter(t: Tables) -> DataFrame:
    return T.answer(t.part, _asked(t)).select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("""WITH f AS (SELECT p_type IN ('ECONOMY', 'PROMO') AS a, p_brand IN ('Brand#2', 'Brand#17') AS b, p_size >= (SELECT quantile_cont(p_size, 0.8) FROM part) AS c FROM part)
 SELECT 'p_type' AS constraint, count(*) FILTER (a) AS rows FROM f UNION ALL SELECT 'p_brand', count(*) FILTER (b) FROM f UNION ALL SELECT 'p_size', count(*) FILTER (c) FROM f UNION ALL SELECT 'all', count(*) FILTER (a AND b AND c) FROM f""")
def constraint_selectivity(t: Tables) -> DataFrame:
    return T.selectivity(t.part, _asked(t))


@query("""SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) BETWEEN 10 AND 20""")
def pair_cooccurrence(t: Tables) -> DataFrame:
    return T.cooccurrence(t.part, "p_brand", "p_type", 10, 20)


@query("""SELECT p_brand, p_type, count(DISTINCT p_name) AS size, array_to_string(list_sort(list(DISTINCT p_name)), ';') AS names FROM part GROUP BY ALL HAVING count(DISTINCT p_name) BETWEEN 3 AND 8""")
def condition_answer_sets(t: Tables) -> DataFrame:
    return T.answer_sets(t.part, ["p_brand", "p_type"], "p_name", 3, 8).withColumn("names", F.array_join("names", ";"))


@query("""SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size), (p_brand, p_type), (p_brand, p_size), (p_type, p_size))""")
def condition_lattice(t: Tables) -> DataFrame:
    return T.condition_lattice(t.part, ["p_brand", "p_type", "p_size"])


@query("""WITH c AS (SELECT p_brand, l_returnflag, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, l_returnflag ORDER BY n DESC, p_type) AS k FROM c QUALIFY k <= 5)
 SELECT p_brand, string_agg(p_type, ',' ORDER BY k) FILTER (l_returnflag = 'A') AS "A", string_agg(p_type, ',' ORDER BY k) FILTER (l_returnflag = 'N') AS "N", string_agg(p_type, ',' ORDER BY k) FILTER (l_returnflag = 'R') AS "R" FROM r GROUP BY 1""")
def family_top_values_pivot(t: Tables) -> DataFrame:
    from tessera.operators.windows import top_per_group

    counts = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "l_returnflag", "p_type").agg(F.count("*").alias("n"))
    top = top_per_group(counts, ["p_brand", "l_returnflag"], [F.col("n").desc(), F.col("p_type")], 5, "k")
    return top.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_type"))), lambda x: x["p_type"]), ","))


@query(f"""WITH k AS (SELECT doc_id, list_distinct({_tokens('text', 1).replace(f" AND t NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)})", '')}) AS t FROM documents), s AS (SELECT doc_id, len(list_intersect(t, ['the', 'of', 'and'])) AS a, len(list_intersect(t, ['der', 'die', 'und'])) AS b, len(list_intersect(t, ['la', 'que', 'de'])) AS c FROM k)
 SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'english' WHEN b >= c THEN 'german' ELSE 'romance' END AS intent FROM s""")
def intent_by_keywords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.intent(F.col("text"), {"english": ["the", "of", "and"], "german": ["der", "die", "und"], "romance": ["la", "que", "de"]}, "none").alias("intent"))


@query("""SELECT l_returnflag, count(*) AS n, CAST(count(DISTINCT l_partkey) AS BIGINT) AS subjects, round(avg(CAST(l_quantity AS DECIMAL(18, 2))), 4) AS mean_quantity, median(l_quantity) AS median_quantity, count(*) FILTER (l_linenumber = 1) AS at_cap FROM lineitem GROUP BY 1""")
def summary_stats(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("subjects"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.median("l_quantity").alias("median_quantity"), F.count_if(F.col("l_linenumber") == 1).alias("at_cap"))
