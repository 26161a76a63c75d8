"""Reports on extraction runs: caps, strata, reviews, repairs, joins of runs, wide tables of scores."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.measure import safe_div


def means_by(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, rows, positive, total, mean over all and over positive rows."""
    out = rows.groupBy(*group).agg(F.count("*").alias("rows"), F.count_if(F.col(value) > 0).alias("positive"), F.sum(value).alias("total"))
    return out.withColumn("mean_all", safe_div(F.col("total"), F.col("rows"))).withColumn("mean_positive", safe_div(F.col("total"), F.col("positive")))


def cap_phenomenon(rows: DataFrame, cap: str, value: str) -> DataFrame:
    """cap, rows, below, at, above and the share at the cap."""
    out = rows.groupBy(cap).agg(F.count("*").alias("rows"), F.count_if(F.col(value) < F.col(cap)).alias("below"), F.count_if(F.col(value) == F.col(cap)).alias("at"), F.count_if(F.col(value) > F.col(cap)).alias("above"))
    return out.withColumn("share_at", safe_div(F.col("at"), F.col("rows")))


def group_caps(rows: DataFrame, group: str, value: str, cap: str) -> DataFrame:
    """group, rows, total, mean, rows at the cap or above, exactly at it, above it, and the share at it; caps of 0 are none."""
    v, c = F.col(value), F.col(cap)
    counts = {"rows": F.count("*"), "total": F.sum(v), "at": F.count_if((c > 0) & (v >= c)), "exactly": F.count_if((c > 0) & (v == c)), "above": F.count_if((c > 0) & (v > c))}
    out = rows.where(F.col(group) != "").groupBy(group).agg(*(x.alias(k) for k, x in counts.items()))
    return out.select("*", F.round(safe_div(F.col("total"), F.col("rows")), 6).alias("mean"), F.round(safe_div(F.col("at"), F.col("rows")), 6).alias("share_at"))


def overview(parts: Sequence[tuple[DataFrame, str, dict[str, str]]], item: str, model: str) -> DataFrame:
    """item, group, model, metric, score: of each part (rows, group, metric by item) the metric chosen for the item, two decimals as text."""
    out = None
    for rows, group, metrics in parts:
        value, name = F.lit(None).cast("double"), F.lit(None).cast("string")
        for k, m in metrics.items():
            value, name = F.when(F.col(item) == k, F.col(m).cast("double")).otherwise(value), F.when(F.col(item) == k, m).otherwise(name)
        part = rows.where(F.col(item).isin(*metrics)).select(item, F.lit(group).alias("group"), model, name.alias("metric"), F.coalesce(F.format_string("%.2f", value), F.lit("")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def review_summary(reviews: DataFrame, status: str, positive: Column, chapter: str) -> DataFrame:
    """chapter (null: all), ok, errors, positive: both levels in one pass."""
    ok = F.col(status) == "ok"
    return reviews.rollup(chapter).agg(F.count_if(ok).alias("ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"), F.count_if(ok & positive).alias("positive"))


def ranked_strata(rows: DataFrame, group: Sequence[str], measures: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """group, the measures, priority (their weighted sum) and rank by it."""
    from pyspark.sql.window import Window

    out = rows.groupBy(*group).agg(*(c.alias(k) for k, c in measures.items()))
    out = out.withColumn("priority", F.round(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), 6))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), *group)))  # one row for each stratum


def paired(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """key, then every other column as left_ and right_: the units of two runs side by side."""
    side = lambda df, name: df.select(*key, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in key))
    return side(left, "left").join(side(right, "right"), list(key), how)


def pending(answers: DataFrame, questions: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Answers with their questions that have no score yet, one row for each key."""
    return answers.dropDuplicates([key]).join(questions, key).join(scores.select(key), key, "left_anti")


def duplicate_sources(rows: DataFrame, id_: str, source: str) -> DataFrame:
    """class, ids, extra: ids once, several times in one source, or in several sources, and the rows beyond one each."""
    per = rows.groupBy(id_).agg(F.count("*").alias("n"), F.countDistinct(source).alias("s"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("s") == 1, "same_source").otherwise("cross_source")
    return per.groupBy(kind.alias("class")).agg(F.count("*").alias("ids"), F.sum(F.col("n") - 1).alias("extra"))


def histograms(rows: DataFrame, columns: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """column, value, n of several columns in one pass; lists count each of their values."""
    named = lambda values, c: F.transform(values, lambda v: F.struct(F.lit(c).alias("column"), v.alias("value")))
    each = [named(F.array(F.col(c).cast("string")), c) for c in columns] + [named(F.col(c).cast("array<string>"), c) for c in lists]
    return rows.select(F.explode(F.concat(*each)).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def full_table(scores: DataFrame, by: Sequence[str], dataset: str, datasets: Sequence[str], metric: str, disputed: str, invalid: str) -> DataFrame:
    """by, then of each data set its score, disputed and invalid rows; the mean of the scores and all disputed rows."""
    at = lambda d, c: F.max(F.when(F.col(dataset) == d, F.col(c)))
    wide = scores.groupBy(*by).agg(*(x for d in datasets for x in (at(d, metric).alias(d), F.coalesce(at(d, disputed), F.lit(0)).alias(f"{d}_disputed"), F.coalesce(at(d, invalid), F.lit(0)).alias(f"{d}_invalid"))))
    present = F.array_compact(F.array(*(F.col(d) for d in datasets)))
    mean = F.when(F.size(present) > 0, F.round(F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present), 6))
    return wide.withColumn("macro_avg", mean).withColumn("total_disputed", sum((F.col(f"{d}_disputed") for d in datasets), F.lit(0)))


def run_summary(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """One row of named totals."""
    return rows.agg(*(c.alias(k) for k, c in totals.items()))
