"""Claims and facts gathered by key: merges, votes, documents of facts, complete chains, lines of text."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import collapse, sentences, text

#: Confidence of a fact without votes, for each vote, and at most.
BASE, VOTE, MOST = 0.55, 0.1, 0.99
#: The domain of a fact by the first of these that its chapter or predicate holds.
DOMAINS = {
    "distribution": "DistributionAndMovement",
    "movement": "DistributionAndMovement",
    "migration": "DistributionAndMovement",
    "habitat": "HabitatAndEcology",
    "diet": "DietAndForaging",
    "foraging": "DietAndForaging",
    "breeding": "BreedingAndLifeHistory",
    "nest": "BreedingAndLifeHistory",
    "egg": "BreedingAndLifeHistory",
    "conservation": "Conservation",
    "status": "Conservation",
    "identification": "Identification",
    "systematics": "Taxonomy",
}
OTHER_DOMAIN = "GeneralFacts"


def merged(rows: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], most: int = 2) -> DataFrame:
    """One claim for each key: the columns of its first row in the order, and its first distinct chunks, at most so many.

    Ranks come before the collection, so a hot key collects no more than it keeps.
    """
    by = Window.partitionBy(*key)
    each = rows.groupBy(*key, chunk).agg(F.min(F.struct(*order)).alias("_at"), F.min_by(F.struct(*(c for c in rows.columns if c not in key)), F.struct(*order)).alias("_row"))
    ranked = each.withColumn("_n", F.row_number().over(by.orderBy("_at"))).where(F.col("_n") <= most)
    out = ranked.groupBy(*key).agg(F.min_by("_row", "_n").alias("_row"), F.array_sort(F.collect_list(F.struct("_n", chunk))).alias("_c"))
    return out.select(*key, "_row.*", F.transform("_c", lambda x: x[chunk]).alias("supported_chunk_ids"))


def voted(rows: DataFrame, key: Sequence[str], chunk: str) -> DataFrame:
    """key, votes (distinct chunks), confidence."""
    votes = rows.groupBy(*key).agg(F.countDistinct(chunk).alias("votes"))
    return votes.withColumn("confidence", F.round(F.least(F.lit(MOST), BASE + VOTE * F.col("votes")), 2))


def fact_domain(chapter: Column, predicate: Column) -> Column:
    held, out = F.lower(F.concat_ws(" ", text(chapter), text(predicate))), F.when(F.lit(False), "")
    for part, domain in DOMAINS.items():
        out = out.when(F.contains(held, F.lit(part)), domain)
    return out.otherwise(OTHER_DOMAIN)


def value_text(name: Column, value: Column, low: Column, high: Column, unit: Column) -> Column:
    """The object's name, else its text, else its range or number with the unit."""
    number = F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low.cast("string"), high.cast("string"))).when(low.isNotNull(), low.cast("string"))
    return F.coalesce(F.nullif(collapse(name), F.lit("")), F.nullif(collapse(value), F.lit("")), F.trim(F.concat_ws(" ", number, text(unit))))


def claim_line(predicate: Column, kind: Column, name: Column, value: Column, low: Column, high: Column, unit: Column, snippet: Column) -> Column:
    """``- predicate: value.``, with the evidence after it where there is some."""
    span = F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
    shown = F.when(kind == "entity", name).when(kind == "numeric", F.trim(F.concat_ws(" ", span, text(unit)))).otherwise(value)
    return F.concat(F.lit("- "), predicate, F.lit(": "), F.coalesce(shown, F.lit("None")), F.when(text(snippet) != "", F.concat(F.lit(". Evidence: "), snippet)).otherwise(F.lit(".")))


def snippet(c: Column, most: int = 180) -> Column:
    """Text for evidence: without marks of media, names with initials and years."""
    out = F.regexp_replace(collapse(c), "(?i)photo|video", " ")
    out = F.regexp_replace(collapse(out), r"\b[A-Z][a-z]+(?:,?\s+[A-Z]\.)+(?:\s+and\s+[A-Z][a-z]+)?", " ")
    return F.substring(collapse(F.regexp_replace(out, r"\b\d{4}\b", " ")), 1, most)


def documents(facts: DataFrame, group: Sequence[str], order: Sequence[str], heading: Column, line: Column, chapter: str, most: int = 40) -> DataFrame:
    """group, n_facts, chapters (sorted), content: a heading and the lines of a group's first facts in order."""
    rows = facts.select(*group, *[c for c in dict.fromkeys([*order, chapter]) if c not in group], heading.alias("_head"), line.alias("_line"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most)
    out = ranked.groupBy(*group).agg(F.min_by("_head", "_n").alias("_head"), F.count("*").alias("n_facts"), F.array_sort(F.collect_set(F.nullif(text(F.col(chapter)), F.lit("")))).alias("chapters"), F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_l"))
    return out.select(*group, "n_facts", "chapters", F.concat_ws("\n", "_head", F.transform("_l", lambda x: x["_line"])).alias("content"))


def concatenated(rows: DataFrame, group: Sequence[str], order: Sequence[str], column: str, separator: str = "\n") -> DataFrame:
    """group, text: the non-empty texts of each group in order, and how many they are."""
    part = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.col(column).alias("_t"))
    out = rows.where(text(F.col(column)) != "").groupBy(*group).agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return out.select(*group, F.size("_p").alias("parts"), F.array_join(F.transform("_p", lambda x: x["_t"]), separator).alias("text"))


def complete_chains(facts: DataFrame, links: DataFrame, evidence: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """The first n facts (by id) with a subject, their first evidence that has a chunk and a quote, and that chunk.

    facts: fact_id, subject_id; links: fact_id, evidence_id; evidence: evidence_id, chunk_id, quote; chunks: chunk_id.
    The chunk is looked up after the choice: a fact whose chunk is absent is left out and not replaced.
    """
    usable = evidence.where((text(F.col("chunk_id").cast("string")) != "") & (text(F.col("quote")) != ""))
    first = links.join(usable, "evidence_id").groupBy("fact_id").agg(F.min_by(F.struct("evidence_id", "chunk_id"), "evidence_id").alias("e"))
    chosen = facts.where(text(F.col("subject_id").cast("string")) != "").select("fact_id", "subject_id").join(first, "fact_id").orderBy("fact_id").limit(n)
    return chosen.select("fact_id", "subject_id", "e.evidence_id", "e.chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def chain_graph(chains: DataFrame, types: tuple[str, str, str] = ("HAS_FACT", "SUPPORTED_BY", "FROM_CHUNK")) -> DataFrame:
    """source, target, type of the edges subject, fact, evidence, chunk; distinct."""
    node = lambda kind, c: F.concat_ws(":", F.lit(kind), F.col(c).cast("string"))
    steps = [("taxon", "subject_id", "fact", "fact_id"), ("fact", "fact_id", "evidence", "evidence_id"), ("evidence", "evidence_id", "chunk", "chunk_id")]
    each = F.explode(F.array(*(F.struct(node(a, x).alias("source"), node(b, y).alias("target"), F.lit(t).alias("type")) for (a, x, b, y), t in zip(steps, types))))
    return chains.select(each.alias("e")).select("e.*").distinct()


def first_sentence(c: Column, most: int = 220) -> Column:
    return F.substring(collapse(F.get(sentences(c), F.lit(0))), 1, most)
