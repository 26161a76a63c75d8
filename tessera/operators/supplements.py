"""Rounds of further claims for chunks at their cap: signatures, ids, completion, verification, compaction."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ids import stable_id
from tessera.functions.measure import safe_div
from tessera.functions.text import collapse

#: Fixed value: what tells ids of further claims from those of first ones.
ROUND_MARK = "claim_cap_supplement"


def claim_signature(*parts: Column | str) -> Column:
    """The parts as one text in lower case, single spaces; null parts are empty."""
    return F.lower(collapse(F.concat_ws(" ", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))))


def numbered(claims: DataFrame, chunk: str, order: Sequence[Column | str], id_parts: Sequence[str], round_: int = 1) -> DataFrame:
    """Claims without their private columns (_ at the front), with an id, the round and their place in the chunk (from 0)."""
    place = F.row_number().over(Window.partitionBy(chunk).orderBy(*order)) - 1
    new = {"supplement_claim_id": stable_id("supclaim_", *id_parts, F.lit(ROUND_MARK)), "supplement_round": F.lit(round_), "supplement_index_in_round": place}
    return claims.withColumns(new).drop(*(c for c in claims.columns if c.startswith("_")))


def completion(status: Column, found: Column, most: int) -> Column:
    """rounds, found, hit_cap, final_status of a chunk's review; found counts only where the review went well."""
    ok = F.coalesce(status == "ok", F.lit(False))
    hit = ok & F.coalesce(found >= most, F.lit(False))
    final = F.when(hit, "completed_round_1_hit_soft_cap").when(ok, "completed_round_1_not_hit_cap").when(status == "dry_run", "dry_run").otherwise("failed_round_1")
    return F.struct(ok.cast("int").alias("rounds"), F.when(ok, F.coalesce(found, F.lit(0))).otherwise(0).cast("long").alias("found"), hit.alias("hit_cap"), final.alias("final_status"))


def verified(reviews: DataFrame, status: str, found: str, bucket: str, most: int) -> DataFrame:
    """bucket (null: all), reviews, ok, positive, hits of the cap, claims found, and their ratios: both levels in one pass."""
    ok, n = F.col(status) == "ok", F.coalesce(F.col(found), F.lit(0))
    out = reviews.rollup(bucket).agg(F.count("*").alias("reviews"), F.count_if(ok).alias("ok"), F.count_if(ok & (n > 0)).alias("positive"), F.count_if(ok & (n >= most)).alias("hits"), F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("found"))
    ratios = {"positive_ratio": ("positive", "ok"), "hit_ratio": ("hits", "ok"), "found_per_ok": ("found", "ok"), "found_per_positive": ("found", "positive")}
    return out.select("*", *(F.round(safe_div(F.col(a), F.col(b)), 6).alias(k) for k, (a, b) in ratios.items()))


def combined(parts: Sequence[DataFrame], key: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Counts of several breakdowns added up by key."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.groupBy(*key).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals))


def attachment_summary(rows: DataFrame, kind: str, status: str) -> DataFrame:
    """kind, total, attached, unresolved, rate."""
    held = F.coalesce(F.col(status) == "attached", F.lit(False))
    out = rows.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(held).alias("attached"))
    return out.select("*", (F.col("total") - F.col("attached")).alias("unresolved"), F.round(safe_div(F.col("attached"), F.col("total")), 6).alias("rate"))


def top_reasons(rows: DataFrame, kind: str, reason: str, k: int) -> DataFrame:
    """kind, reason, n, rank of the k most frequent filled reasons of a kind; counts are few, texts are not moved."""
    counts = rows.where((F.col(reason) != "") & F.col(reason).isNotNull()).groupBy(kind, reason).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), reason))).where(F.col("rank") <= k)
