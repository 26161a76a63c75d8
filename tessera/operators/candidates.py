"""Candidates from scored chunks: prefilters by heading, sums by entity, bonuses of trait rows, evidence sentences."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import name_variants, text
from tessera.operators.context import folded
from tessera.operators.retrieve import hinted

#: Points of a sentence of a fit length, for a telling term, a heading's hint, and for each shared token (so many at most).
FIT, TELLING, HINTED, SHARED, SHARED_MOST = 2.0, 5.0, 2.0, 1.4, 6
#: Lost for each pattern of citations, for two brackets or more, for an opening that tells nothing.
CITATION, BRACKETS, OPENING = 12.0, 3.0, 4.0


def prefiltered(chunks: DataFrame, heading: str, hints: Sequence[str], least: int = 500) -> DataFrame:
    """Chunks whose heading holds a hint, if they are at least so many; else all.  One count decides, no row is collected."""
    hit = hinted(F.col(heading), [(h, 1.0) for h in hints]) > 0
    enough = chunks.agg((F.count_if(hit) >= least).alias("_enough"))
    return chunks.join(F.broadcast(enough), hit | ~F.col("_enough")).drop("_enough") if hints else chunks


def by_any_name(chunks: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """query_id and chunks whose name equals any variant of a wanted one (names: query_id, name); each chunk once a query."""
    variants = names.select("query_id", F.explode(F.array_distinct(F.transform(name_variants(F.col("name")), folded))).alias("_n"))
    return chunks.withColumn("_n", folded(F.col(column))).join(variants.distinct(), "_n").drop("_n")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first; of the second those of queries that the first has none of (column query_id)."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def summed(hits: DataFrame, entity: Sequence[str], score: str, id_: str, top: int | None = None) -> DataFrame:
    """query_id, entity, score (sum of the best hits, or of all), hits, best (their first ids): partial sums where no rank is needed."""
    keys = ["query_id", *entity]
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
    ranked = hits.withColumn("_n", F.row_number().over(w))
    inside = F.lit(True) if top is None else F.col("_n") <= top
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= (top or 3), F.struct("_n", id_)))), lambda x: x[id_])
    return ranked.groupBy(*keys).agg(F.round(F.sum(F.when(inside, F.col(score)).otherwise(0.0)), 4).alias("score"), F.count("*").alias("hits"), best.alias("best"))


def with_bonus(candidates: DataFrame, bonus: DataFrame, names: Sequence[str]) -> DataFrame:
    """candidates with bonus (the greatest that one of its names earns, 0 without) added to the score; bonus: query_id, name, bonus."""
    keyed = candidates.select("query_id", *names, F.explode(F.array_distinct(F.array(*(folded(F.col(n)) for n in names)))).alias("name"))
    earned = keyed.join(bonus.groupBy("query_id", folded(F.col("name")).alias("name")).agg(F.sum("bonus").alias("bonus")), ["query_id", "name"]).groupBy("query_id", *names).agg(F.max("bonus").alias("bonus"))
    out = candidates.join(earned, ["query_id", *names], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    return out.withColumn("score", F.round(F.col("score") + F.col("bonus"), 4))


def best_of_each(candidates: DataFrame, key: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """query_id, key and score of the k best candidates of each query; of rows of one key the best."""
    one = candidates.groupBy("query_id", *key).agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))).where(F.col("rank") <= k)


def sentence_score(sentence: Column, heading: Column, terms: Sequence[str], hints: Sequence[str], patterns: Sequence[tuple[str, float]], asked: Column, generic: Sequence[str], citations: Sequence[str], openings: Sequence[str]) -> Column:
    """Points of a sentence as evidence for a question with tokens asked; terms, hints and patterns come from its type."""
    low, n = F.lower(sentence), F.length(sentence)
    holds = lambda c, words: F.lit(False) if not words else F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(c, w))
    score = F.when(n.between(35, 280), FIT).otherwise(0.0) + F.when(holds(low, terms), TELLING).otherwise(0.0) + F.when(holds(F.lower(heading), hints), HINTED).otherwise(0.0)
    for pattern, points in patterns:
        score = score + F.when(low.rlike(pattern), points).otherwise(0.0)
    shared = F.filter(F.array_distinct(asked), lambda t: ~t.isin(*generic) & (F.length(t) >= 4) & F.contains(low, t)) if generic else F.filter(F.array_distinct(asked), lambda t: (F.length(t) >= 4) & F.contains(low, t))
    score = score + SHARED * F.least(F.size(shared), F.lit(SHARED_MOST))
    for pattern in citations:
        score = score - F.when(sentence.rlike(f"(?i){pattern}"), CITATION).otherwise(0.0)
    score = score - F.when(F.regexp_count(sentence, F.lit(r"\(")) >= 2, BRACKETS).otherwise(0.0)
    return score - F.when(low.rlike(f"^(?:{'|'.join(openings)})") if openings else F.lit(False), OPENING).otherwise(0.0)


def best_sentence(sentences: DataFrame, key: Sequence[str], score: str, place: str, sentence: str, most: int = 260) -> DataFrame:
    """key, snippet: the sentence of most points, the first of equals."""
    best = sentences.groupBy(*key).agg(F.max_by(sentence, F.struct(F.col(score), -F.col(place))).alias("snippet"))
    return best.withColumn("snippet", F.substring(text(F.col("snippet")), 1, most))
