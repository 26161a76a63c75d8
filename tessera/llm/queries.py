"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op1_packing, op2_log_bilinear, op3_token_files, op4_ngram_join, op5_winnowing, op6_substring_dedup, op7_decontamination, op8_quality, op9_shards, op10_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_packing.query,
        "op2_log_bilinear": op2_log_bilinear.query,
        "op3_token_files": op3_token_files.query,
        "op4_ngram_jaccard": op4_ngram_join.query,
        "op5_winnowing": op5_winnowing.query,
        "op6_substring_dedup": op6_substring_dedup.query,
        "op7_decontamination": op7_decontamination.query,
        "op8_compression_quality": op8_quality.query,
        "op9_interleaved_shards": op9_shards.query,
        "op10_token_counts": op10_token_counts.query,
    }


#: Words of the whole text; those of op4 in lower case (A-Z only).
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS l FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(l) < 5 THEN l ELSE l[i + 1 : i + 5] END, ' ')) AS h FROM (SELECT doc_id, l, unnest(range(CASE WHEN len(l) = 0 THEN 0 ELSE greatest(len(l) - 4, 1) END)) AS i FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
 u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.other)
 SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY 1, 2"""

REPEATS = f"""WITH w AS (SELECT doc_id, {_WORDS.format(text='text')} AS l FROM documents),
 k AS (SELECT doc_id, s, md5(array_to_string(l[s + 1 : s + 20], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(greatest(len(l) - 19, 0))) AS s FROM w)),
 f AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
 g AS (SELECT DISTINCT doc_id, s + o AS i FROM f, range(20) t(o)),
 x AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS word FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM x ANTI JOIN g USING (doc_id, i) GROUP BY 1)
 SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others need tokenizers, models, alignment or functions (crc32, xxhash64) that the SQL engine lacks."""
    return {"op4_ngram_jaccard": NGRAM_JOIN, "op6_substring_dedup": REPEATS}
