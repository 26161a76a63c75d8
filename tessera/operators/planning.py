"""Questions to plans to facts: target resolution, deterministic plans, their validation, planned retrieval."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.measure import ratio
from tessera.functions.text import query_terms, text, tokens
from tessera.operators.context import grams

#: Words of the longest name that a question is searched for; least likeness of a fuzzy match and its candidates.
MOST_WORDS, FUZZY, FUZZY_MOST = 6, 0.72, 3
#: Points of a planned predicate, domain and chapter, of support (at most five), of a quote, of a chunk.
PREDICATE, DOMAIN, CHAPTER, SUPPORT, QUOTE, CHUNK = 10.0, 5.0, 3.0, 0.2, 0.5, 0.25


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normal_name(c: Column) -> Column:
    return F.array_join(words(c), " ")


def mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, target_id of names (name, target_id) that stand in a question as whole words.

    The question's word sequences meet the names by equality.
    """
    w = words(F.col("question"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(MOST_WORDS)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))
    asked = questions.select("query_id", F.explode(F.array_distinct(spans)).alias("name")).where("name <> ''")
    return asked.join(names.select(normal_name(F.col("name")).alias("name"), "target_id"), "name").select("query_id", "target_id").distinct()


def resolve(questions: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, target_id, method, candidates of each question (query_id, question, explicit).

    An explicit name decides alone: by equality, else by likeness.  Otherwise the names in the question do, then
    likeness to the whole question.  Several targets are an error: method ``ambiguous`` with all of them; none:
    ``unresolved``.
    """
    known = names.select(normal_name(F.col("name")).alias("name"), "target_id").where("name <> ''").distinct()
    asked = questions.select("query_id", "question", normal_name(F.col("explicit")).alias("explicit"))
    exact = asked.where("explicit <> ''").join(known, F.col("explicit") == F.col("name")).select("query_id", "target_id")
    # an explicit name with several targets isn't settled by equality
    exact = exact.groupBy("query_id").agg(F.collect_set("target_id").alias("t")).where("size(t) = 1")
    named = mentions(asked.where("explicit = ''"), names).groupBy("query_id").agg(F.array_sort(F.collect_set("target_id")).alias("t"))
    settled = exact.withColumn("method", F.lit("exact")).unionByName(named.withColumn("method", F.when(F.size("t") == 1, "mention").otherwise("ambiguous")))
    open_ = asked.join(settled.select("query_id"), "query_id", "left_anti").select("query_id", F.when(F.col("explicit") != "", F.col("explicit")).otherwise(normal_name(F.col("question"))).alias("wanted"))
    by_gram = lambda df, c: df.withColumn("gram", F.explode(grams(F.col(c), F.lit(3))))
    pairs = by_gram(open_, "wanted").join(by_gram(known, "name"), "gram").groupBy("query_id", "wanted", "name").agg(F.count("*").alias("shared"))
    # a likeness of FUZZY needs lengths this close
    near = pairs.where(F.least(F.length("wanted"), F.length("name")) * 2 >= FUZZY * (F.length("wanted") + F.length("name"))).withColumn("likeness", ratio(F.col("wanted"), F.col("name"))).where(F.col("likeness") >= FUZZY)
    best = Window.partitionBy("query_id").orderBy(F.desc("likeness"), F.desc("name"))
    near = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= FUZZY_MOST).join(known, "name")
    near = near.groupBy("query_id").agg(F.array_sort(F.collect_set("target_id")).alias("t")).withColumn("method", F.when(F.size("t") == 1, "fuzzy").otherwise("ambiguous"))
    rows = asked.select("query_id").join(settled.unionByName(near), "query_id", "left")
    return rows.select("query_id", F.when(F.size("t") == 1, F.get("t", F.lit(0))).alias("target_id"), F.coalesce("method", F.lit("unresolved")).alias("method"), F.when(F.col("method") == "ambiguous", F.col("t")).alias("candidates"))


def planned(resolved: DataFrame, questions: DataFrame, routes: DataFrame, available: dict[str, Sequence[str]], chapters_most: int = 6) -> DataFrame:
    """A plan for each resolved question: of its route (query_id, intent, domains, predicates, chapters, hints) what is available.

    Domains in order of name, predicates in the route's order; without an available chapter of the route, those that
    share most words with its hints.
    """
    have = {k: F.array(*(F.lit(x) for x in v)).cast("array<string>") for k, v in available.items()}
    rows = resolved.where("target_id is not null").join(questions.select("query_id", "question"), "query_id").join(routes, "query_id")
    own = F.filter("chapters", lambda c: F.array_contains(have["chapters"], c))
    hinted = F.transform(have["chapters"], lambda c: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(c)), F.col("hints")))).alias("o"), c.alias("c")))
    hinted = F.transform(F.slice(F.array_sort(F.filter(hinted, lambda x: x["o"] < 0)), 1, chapters_most), lambda x: x["c"])
    return rows.select(
        "query_id", "target_id", "question", "intent",
        F.array_sort(F.array_intersect("domains", have["domains"])).alias("domains"),
        F.filter("predicates", lambda p: F.array_contains(have["predicates"], p)).alias("predicates"),
        F.when(F.size(own) > 0, own).otherwise(hinted).alias("chapters"),
        query_terms(F.col("question")).alias("terms"),
    )


def problems(plans: DataFrame, available: dict[str, Sequence[str]]) -> DataFrame:
    """query_id, problems: names in a plan that its vocabulary lacks, and an absent target."""
    bad = lambda k: F.transform(F.array_except(F.col(k), F.array(*(F.lit(x) for x in available[k])).cast("array<string>")), lambda x: F.concat(F.lit(f"unknown {k}: "), x))
    none = F.when(F.col("target_id").isNull(), F.array(F.lit("no target"))).otherwise(F.array().cast("array<string>"))
    return plans.select("query_id", F.concat(none, *(bad(k) for k in available)).alias("problems"))


def planned_facts(plans: DataFrame, facts: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """query_id, fact_id, evidence_id, score, rank of the k best facts with evidence for each plan.

    Facts of a planned domain and predicate; where a plan finds none, of a planned domain; else all of its target.
    facts: fact_id, target_id, domain, predicate, object, support; evidence: fact_id, evidence_id, chapter, quote,
    chunk.  A fact without evidence is scored as it is.
    """
    fits = lambda names, c: (F.size(names) == 0) | F.array_contains(names, F.col(c))
    rows = plans.join(facts, "target_id")
    level = F.when(fits("domains", "domain") & fits("predicates", "predicate"), 2).when((F.size("domains") > 0) & fits("domains", "domain"), 1).otherwise(0)
    rows = rows.withColumn("level", level)
    best = rows.groupBy("query_id").agg(F.max("level").alias("best"))
    rows = rows.join(best, "query_id").where("level >= best").join(evidence, "fact_id", "left")
    asked = F.array_distinct(F.concat("terms", tokens(F.col("question"))))
    held = F.array_distinct(tokens(F.concat_ws(" ", "predicate", "object", "quote", "chunk")))
    place = F.array_position("predicates", F.col("predicate"))
    points = (
        F.when(place > 0, PREDICATE + F.size("predicates") - place + 1).otherwise(0.0)
        + F.when(F.array_contains("domains", F.col("domain")), DOMAIN).otherwise(0.0)
        + F.when(F.coalesce(F.array_contains("chapters", F.col("chapter")), F.lit(False)), CHAPTER).otherwise(0.0)
        + F.size(F.array_intersect(asked, held))
        + SUPPORT * F.least(F.coalesce(F.col("support"), F.lit(0.0)), F.lit(5.0))
        + F.when(text(F.col("quote")) != "", QUOTE).otherwise(0.0)
        + F.when(text(F.col("chunk")) != "", CHUNK).otherwise(0.0)
    )
    rows = rows.groupBy("query_id", "fact_id", "evidence_id").agg(F.max(F.round(points, 6)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id", "evidence_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def category(of: Column, groups: dict[str, Sequence[str]], otherwise: str) -> Column:
    """The first group that shares a token: groups are tried in order."""
    out = F.when(F.lit(False), "")
    for name, terms in groups.items():
        out = out.when(F.arrays_overlap(of, F.array(*(F.lit(t) for t in terms))), name)
    return out.otherwise(otherwise)
