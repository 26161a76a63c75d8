"""Facts and their evidence: rows of differing fields, links, chains from a fact to its chunk, scored fact texts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import collapse, text

#: Fields of a fact, each with the names that rows give it, first filled one first.
FACT_FIELDS = {
    "fact_id": ("fact_id", "id"),
    "subject_taxon_id": ("subject_taxon_id", "taxon_id", "species", "subject_name"),
    "subject_name": ("subject_name", "species"),
    "fact_domain": ("fact_domain", "fact_type", "source_chapter"),
    "predicate": ("predicate", "fact_type"),
    "object_text": ("object_text", "object_name", "object_canonical_name", "value_text"),
    "object_canonical_name": ("object_canonical_name", "object_name"),
    "value_text": ("value_text",),
}
#: The domain of facts without one, types of edges that are evidence links, characters kept of quote and chunk.
NO_DOMAIN = "GeneralFacts"
LINK_TYPES = ("SUPPORTED_BY", "EVIDENCED_BY", "HAS_EVIDENCE")
QUOTE_CHARS, CHUNK_CHARS = 800, 500


def first_filled(rows: DataFrame, names: Sequence[str], otherwise: str = "") -> Column:
    """The first filled one of the columns that rows have, blanks collapsed."""
    have = [F.nullif(collapse(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*have, F.lit(otherwise))


def facts_of(rows: DataFrame) -> DataFrame:
    """Facts with every field, whatever names the rows give them; confidence is 0 where absent or no number."""
    fields = [first_filled(rows, names, NO_DOMAIN if field == "fact_domain" else "").alias(field) for field, names in FACT_FIELDS.items()]
    sure = F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.0)) if "confidence" in rows.columns else F.lit(0.0)
    return rows.select(*fields, sure.alias("confidence"))


def links_of(edges: DataFrame) -> DataFrame:
    """fact_id, evidence_id of evidence edges under any of their names; prefixes of node ids are cut off."""
    kind = first_filled(edges, ["type"])
    fact, proof = first_filled(edges, ["fact_id", "source", "source_id"]), first_filled(edges, ["evidence_id", "target", "target_id"])
    fact = F.when(F.startswith(fact, F.lit("fact:")), F.split_part(fact, F.lit(":"), F.lit(2))).otherwise(fact)
    proof = F.when(F.startswith(proof, F.lit("evidence")) & F.contains(proof, F.lit(":")), F.split_part(proof, F.lit(":"), F.lit(2))).otherwise(proof)
    pairs = edges.where((kind == "") | kind.isin(*LINK_TYPES)).select(fact.alias("fact_id"), proof.alias("evidence_id"))
    return pairs.where("fact_id <> '' and evidence_id <> ''")


def chains(facts: DataFrame, links: DataFrame, evidence: DataFrame, chunks: DataFrame, chunk: str) -> DataFrame:
    """Facts joined to their evidence and its chunks, where they exist; a fact without evidence keeps one row."""
    proven = links.join(evidence, "evidence_id").join(chunks, chunk, "left")
    return facts.join(proven, "fact_id", "left")


def words(c: Column) -> Column:
    """Distinct words of three letters or more that begin with a letter."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0)))


def fact_score(question: Column, fact_text: Column, confidence: Column) -> Column:
    """Words that question and fact share, plus the confidence."""
    return F.size(F.array_intersect(words(question), words(fact_text))) + F.coalesce(confidence.cast("double"), F.lit(0.0))


def fact_item(predicate: Column, value: Column, quote: Column, chunk: Column) -> Column:
    """A fact as lines: predicate and value, the beginnings of its quote and of its chunk where there are any."""
    part = lambda name, c, most: F.when(collapse(c) != "", F.concat(F.lit(f"{name}: "), F.substring(collapse(c), 1, most)))
    return F.concat_ws("\n", F.trim(F.concat(collapse(predicate), F.lit(": "), collapse(value))), part("Evidence", quote, QUOTE_CHARS), part("Chunk", chunk, CHUNK_CHARS))


def first_evidence(chained: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each fact the row of its first evidence; ranked before anything is gathered."""
    return chained.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def qualifiers_of(facts: DataFrame, fact: str, qualifiers: str) -> DataFrame:
    """fact, key, value of each filled entry of a map column."""
    rows = facts.select(fact, F.explode(qualifiers).alias("key", "value"))
    return rows.select(fact, "key", collapse(F.col("value").cast("string")).alias("value")).where("value <> ''")


def canonical_object(id_: Column, name: Column) -> Column:
    """id and name of an object, blanks collapsed; both empty where neither is given."""
    return F.struct(collapse(id_).alias("id"), collapse(name).alias("name"))
