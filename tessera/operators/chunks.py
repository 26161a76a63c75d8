"""Chunks and sections for a question: scores by target, bonuses of headings, shortlists, contexts, examples, key sentences."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import collapse, text
from tessera.operators.retrieve import hinted, top_k

#: For a chunk that names the target; shortlisted sections; weights of first and second score; sections and characters of a context.
NAMED = 80.0
SHORTLIST, FIRST_WEIGHT, SECOND_WEIGHT = 8, 0.35, 0.65
SECTIONS, LEAST_CHARS = 3, 120
#: Bonuses of headings for questions on protection, and of headings that suit a kind of question.
ON_PROTECTION = (("conservation", 28.0), ("introduction", 18.0))
BY_KIND = (
    (("status",), ("population", "demography", "status", "conservation", "trend")),
    (("threat",), ("conservation", "habitat", "management", "human", "threat")),
    (("historical", "extinction"), ("conservation", "introduction", "distribution", "history", "extinct")),
)
KIND_BONUS = 6.0
#: Bonuses of headings for questions on families, either on their history or on their features.
ON_FAMILIES, ON_HISTORY, ON_FEATURES = (("introduction", 18.0),), ("systematic", "history"), ("habitat", "diet", "breeding")
HISTORY_BONUS, FEATURE_BONUS = 28.0, 12.0
#: What a row of two steps gains for its second step.
SECOND_STEP = 0.35


def _holds(c: Column, words: Sequence[str]) -> Column:
    c = F.lower(text(c))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def target_scores(hits: DataFrame, asked: DataFrame, named: DataFrame, query_id: str, id_: str, name: str, k: int) -> DataFrame:
    """The k best chunks of each query: scores of hits, and NAMED once for a chunk that bears one of the query's names.

    asked holds query_id and name, named id_ and name; names meet by equality, so chunks without a shared word count too.
    """
    exact = asked.join(named, name).select(query_id, id_).distinct().withColumn("score", F.lit(NAMED))
    both = hits.select(query_id, id_, F.col("score").cast("double").alias("score")).unionByName(exact).groupBy(query_id, id_).agg(F.round(F.sum("score"), 4).alias("score"))
    return top_k(both.where("score > 0"), query_id, id_, k)


def protection_bonus(labels: Column, kind: Column) -> Column:
    """Bonuses of a chunk's headings for a question on protection; the first kind that fits adds its hints."""
    labels = text(labels)
    extra = F.lit(0.0)
    for marks, words in reversed(BY_KIND):
        extra = F.when(_holds(kind, marks), hinted(labels, [(w, KIND_BONUS) for w in words])).otherwise(extra)
    return hinted(labels, ON_PROTECTION) + extra


def family_bonus(labels: Column, on_history: Column) -> Column:
    """Bonuses of a chunk's headings for a question on a family."""
    labels = text(labels)
    special = F.when(on_history, F.when(_holds(labels, ON_HISTORY), HISTORY_BONUS).otherwise(0.0)).otherwise(F.when(_holds(labels, ON_FEATURES), FEATURE_BONUS).otherwise(0.0))
    return hinted(labels, ON_FAMILIES) + special


def step_score(haystack: Column, second: Column, words: Sequence[str]) -> Column:
    """Topic words that a row of a walk holds, and a little more where it has a second step."""
    held = hinted(text(haystack), [(w, 1.0) for w in words])
    return held + F.when(collapse(second) != "", SECOND_STEP).otherwise(0.0)


def shortlisted(sections: DataFrame, key: str, id_: str, first: str, second: Column, n: int = SHORTLIST) -> DataFrame:
    """The n best sections of each key by their first score, with score, the blend of first and second score.

    The second score, which may be dear, is taken of the shortlist only.
    """
    best = top_k(sections, key, id_, n, first).drop("rank")
    return best.withColumn("score", F.round(FIRST_WEIGHT * F.col(first) + SECOND_WEIGHT * second, 6))


def source_context(sections: DataFrame, whole: DataFrame, key: str, id_: str, body: str, k: int = SECTIONS, least: int = LEAST_CHARS) -> DataFrame:
    """key, context: the k best sections (by score) of each key one after another; the whole text where these are too short."""
    best = top_k(sections, key, id_, k)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", body))), lambda x: x[body])
    joined = best.groupBy(key).agg(F.trim(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")).alias("_c"))
    rows = whole.select(key, F.col(body).alias("_w")).join(joined, key, "left")
    return rows.select(key, F.when(F.char_length("_c") >= least, F.col("_c")).otherwise(text("_w")).alias("context"))


def examples(items: DataFrame, pool: DataFrame, item: str, kind: str, example: str, k: int = 2) -> DataFrame:
    """item, example, rank: the first k examples of the item's kind, or the first k of all where its kind has none."""
    own = pool.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(example))).where(F.col("rank") <= k).select(F.col(kind).alias("_k"), F.col(example), "rank")
    any_ = pool.orderBy(example).limit(k).select(example).agg(F.sort_array(F.collect_list(example)).alias("_e"))  # one row of k ids
    rows = items.select(item, kind)
    kinds = own.select("_k").distinct()
    without = rows.join(kinds, rows[kind] == kinds["_k"], "left_anti").select(item)
    first = without.join(any_).select(item, F.posexplode("_e").alias("_p", example)).select(item, example, (F.col("_p") + 1).alias("rank"))
    return rows.join(own, F.col(kind) == F.col("_k")).select(item, example, "rank").unionByName(first)


def key_sentences(c: Column, words: Sequence[str], most: int) -> Column:
    """Sentences that hold one of the words, before the first that would pass the budget of characters; the text's beginning where none does."""
    parts = F.filter(F.transform(F.split(F.trim(text(c)), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: (s != "") & _holds(s, words))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.lit("").alias("t"))

    def step(a: Column, s: Column) -> Column:
        n = a["n"] + F.char_length(s) + 1
        full = a["full"] | (n > most)
        return F.struct(F.when(full, a["n"]).otherwise(n).alias("n"), full.alias("full"), F.when(full, a["t"]).otherwise(F.concat(a["t"], F.when(a["t"] == "", "").otherwise(" "), s)).alias("t"))

    kept = F.aggregate(parts, start, step)["t"]
    return F.when(kept != "", kept).otherwise(F.substring(F.trim(text(c)), 1, most))


def preferred(chapters: DataFrame, chapter: str, hints: Sequence[str], k: int = 6) -> DataFrame:
    """The k chapters whose words overlap most with the hints (a report on a route), ties by name."""
    from tessera.operators.evidence import words

    shared = F.size(F.array_intersect(words(F.col(chapter)), F.array(*(F.lit(h) for h in hints))))
    return chapters.select(chapter).distinct().withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), chapter).limit(k)


def preview(c: Column | str, most: int = 120) -> Column:
    """The beginning of a text on one line."""
    return F.substring(F.trim(F.regexp_replace(text(c), "\n", " ")), 1, most)
