"""Claims to facts: validation, consolidation, evidence, links, audits of ids."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import stable_id
from tessera.functions.measure import safe_div
from tessera.functions.text import collapse, text

#: The qualifiers of a claim, in this order.
QUALIFIERS = ("sex", "life_stage", "season", "breeding_status", "subspecies", "region_scope", "frequency")
#: Spellings of qualifiers and what they become.
SYNONYMS = {
    "sex": {"males": "male", "adult male": "male", "females": "female", "adult female": "female"},
    "life_stage": {"juveniles": "juvenile", "immature": "juvenile", "immatures": "juvenile", "adults": "adult"},
    "breeding_status": {"breeding season": "breeding", "during breeding": "breeding", "nonbreeding": "non-breeding", "outside breeding": "non-breeding"},
}
#: Facts below this mean confidence have low confidence.
LOW_CONFIDENCE = 0.55


def qualifiers(raw: Column) -> Column:
    """The struct of normalised qualifiers of a map or struct."""
    out = []
    for name in QUALIFIERS:
        value = F.lower(collapse(raw[name]))
        for spelling, becomes in SYNONYMS.get(name, {}).items():
            value = F.when(value == spelling, becomes).otherwise(value)
        out.append(value.alias(name))
    return F.struct(*out)


def status(confidence: Column, object_type: Column, resolved: Column) -> Column:
    return F.when(confidence < LOW_CONFIDENCE, "low_confidence").when(object_type.isin("concept", "relation") & ~resolved, "unresolved_object").otherwise("active")


def consolidate(claims: DataFrame, keys: Sequence[str], order: Sequence[str], confidence: str = "confidence", carry: Sequence[str] = (), prefix: str = "fact_") -> DataFrame:
    """One fact for each key: id, key, support, mean confidence (4 digits), and carried columns of the first claim in order.

    Partial aggregation does the work before the shuffle, also for a key with a third of all claims.
    """
    first = [F.min_by(F.struct(*carry), F.struct(*order)).alias("_first")] if carry else []
    facts = claims.groupBy(*keys).agg(F.count("*").alias("support_count"), F.round(F.avg(confidence), 4).alias("confidence"), *first)
    return facts.select(stable_id(prefix, *keys, width=32).alias("fact_id"), *keys, "support_count", "confidence", *(F.col(f"_first.{c}").alias(c) for c in carry))


def links(claims: DataFrame, fact_id: Column, evidence_id: Column) -> DataFrame:
    return claims.select(fact_id.alias("fact_id"), evidence_id.alias("evidence_id")).distinct()


def evidences(claims: DataFrame, evidence_id: Column, order: Column, carry: Sequence[str]) -> DataFrame:
    """One row for each evidence: the last claim in order gives its columns."""
    return claims.groupBy(evidence_id.alias("evidence_id")).agg(F.max_by(F.struct(*carry), order).alias("last")).select("evidence_id", "last.*")


def validate(claims: DataFrame, reasons: dict[str, Column], cap: int | None = None, within: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """claims with drop_reason: over the cap first, then the first reason that holds, else null."""
    from pyspark.sql.window import Window

    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        out = F.when(holds, name).otherwise(out)
    if cap is not None:
        claims = claims.withColumn("_place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
        out = F.when(F.col("_place") > cap, "over_cap").otherwise(out)
    return claims.withColumn("drop_reason", out).drop("_place")


def compression(claims: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """Claims, facts and facts a claim for each value."""
    a = claims.groupBy(by).agg(F.count("*").alias("claims"))
    b = facts.groupBy(by).agg(F.count("*").alias("facts"))
    return a.join(b, by, "left").select(by, "claims", F.coalesce("facts", F.lit(0)).alias("facts"), safe_div(F.coalesce("facts", F.lit(0)), F.col("claims")).alias("ratio"))


def support_histogram(facts: DataFrame) -> DataFrame:
    n = F.col("support_count")
    bucket = F.when(n == 1, "1").when(n == 2, "2").otherwise("3+")
    return facts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("facts"))


def collisions(rows: DataFrame, id_: Column, key: Column) -> DataFrame:
    """Ids that stand for more than one key."""
    return rows.groupBy(id_.alias("id")).agg(F.countDistinct(key).alias("keys"), F.count("*").alias("rows")).where("keys > 1")


def evidence_of(claims: DataFrame) -> DataFrame:
    """Evidence rows of claims; the id covers source, chunk and quote."""
    quote = collapse("evidence_quote")
    return claims.select(stable_id("evidence_", "source_doc_id", "source_chunk_id", quote).alias("evidence_id"), "source_doc_id", "source_chunk_id", "source_chapter", quote.alias("evidence_quote"), F.sha1(quote.cast("binary")).alias("evidence_hash"))


def object_label(name: Column, id_: Column, low: Column, high: Column, unit: Column, free: Column | None = None) -> Column:
    """Name, else id, else the value range with its unit, else the free text."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    span = F.when(low.isNull(), "").when(high.isNull() | (low == high), number(low)).otherwise(F.concat(number(low), F.lit("-"), number(high)))
    span = F.trim(F.concat_ws(" ", span, F.when(span != "", text(unit))))
    options = [F.nullif(text(name), F.lit("")), F.nullif(text(id_), F.lit("")), F.nullif(span, F.lit(""))]
    return F.coalesce(*options, *([F.nullif(text(free), F.lit(""))] if free is not None else []), F.lit(""))
