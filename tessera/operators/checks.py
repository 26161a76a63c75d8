"""Validators of attachments, claims, evidence and counts: rows with what is wrong with them."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse, text


def messages(*rules: tuple[Column, str]) -> Column:
    """The messages of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(message)) for holds, message in rules)))


def expected_counts(found: DataFrame, expected: dict[str, int]) -> DataFrame:
    """name, n, expected, ok of counts (name, n); a name without a count has none."""
    wanted = found.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    return wanted.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok"))


def recounted(summary: DataFrame, rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """key, stated, counted, ok: a summary (key, value) against a recount of the rows in one pass."""
    wide = rows.agg(*(F.count_if(c).alias(k) for k, c in measures.items()))
    return wide.unpivot([], wide.columns, "key", "counted").join(summary.select("key", F.col("value").alias("stated")), "key", "left").select("key", "stated", "counted", F.equal_null("stated", "counted").alias("ok"))


def link_targets(links: DataFrame, nodes: DataFrame, methods: Sequence[str], rank: str, unresolved: str = "UNRESOLVED") -> DataFrame:
    """link_id, errors of links (link_id, method, taxon_id, name) to nodes (taxon_id, rank, name).

    An unknown method is all that is said of a link; unresolved ones need no target; the others need one of the rank,
    by its own name if they give one.
    """
    own = nodes.select("taxon_id", F.col("rank").alias("_rank"), F.col("name").alias("_name"), F.lit(True).alias("_hit"))
    rows = links.join(own, "taxon_id", "left")
    known, attached = F.coalesce(F.col("method").isin(*methods), F.lit(False)), F.col("method") != unresolved
    there = known & attached & F.col("_hit").isNotNull()
    errors = messages((~known, "invalid method"), (known & attached & F.col("_hit").isNull(), "missing node"), (there & ~F.equal_null("_rank", F.lit(rank)), "wrong rank"), (there & (text(F.col("name")) != "") & ~F.equal_null("name", "_name"), "name mismatch"))
    return rows.select("link_id", errors.alias("errors"))


def inheritance(parts: DataFrame, parents: DataFrame, key: Sequence[str]) -> DataFrame:
    """part_id, errors of attached parts (part_id, key, taxon_id, name) that their attached parent (key, taxon_id, name) doesn't share."""
    own = parents.select(*key, F.col("taxon_id").alias("_id"), F.col("name").alias("_name"), F.lit(True).alias("_hit"))
    there = F.col("_hit").isNotNull()
    return parts.join(own, list(key), "left").select("part_id", messages((~F.coalesce(there, F.lit(False)), "no parent"), (there & ~F.equal_null("taxon_id", "_id"), "id drift"), (there & ~F.equal_null("name", "_name"), "name drift")).alias("errors"))


def back_trace(rows: DataFrame, chunks: DataFrame, subjects: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """row_id, errors of claims or evidence (row_id, chunk_id, quote; with subjects: subject_id; with allowed: chapter, predicate).

    chunks: chunk_id, chunk; subjects: subject_id; allowed: chapter, predicate.  A chapter that allowed doesn't name
    restricts nothing.  An absent chunk ends the trace of a row.
    """
    rows = rows.join(chunks.select("chunk_id", collapse(F.col("chunk")).alias("_chunk"), F.lit(True).alias("_c")), "chunk_id", "left")
    quote, no_chunk = collapse(F.col("quote")), text(F.col("chunk_id").cast("string")) == ""
    there = F.col("_c").isNotNull()
    rules = [(no_chunk, "no chunk"), (~no_chunk & ~there, "chunk not found"), (there & (quote == ""), "no quote"), (there & (quote != "") & (F.col("_chunk") != "") & ~F.contains(F.col("_chunk"), quote), "quote not in chunk")]
    if subjects is not None:
        rows = rows.join(subjects.select("subject_id").distinct().withColumn("_s", F.lit(True)), "subject_id", "left")
        none = text(F.col("subject_id").cast("string")) == ""
        rules = [(none, "no subject"), (~none & F.col("_s").isNull(), "subject not found"), *rules]
    if allowed is not None:
        rows = rows.join(allowed.select("chapter").distinct().withColumn("_k", F.lit(True)), "chapter", "left")
        rows = rows.join(allowed.select("chapter", "predicate").distinct().withColumn("_p", F.lit(True)), ["chapter", "predicate"], "left")
        rules.append((there & F.col("_k").isNotNull() & F.col("_p").isNull(), "predicate not allowed"))
    return rows.select("row_id", messages(*rules).alias("errors"))


def fact_links(facts: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """id, error: links to absent facts or evidence, and facts without a link."""
    missing = lambda key, side, error: links.select(key).distinct().join(side.select(key), key, "left_anti").select(F.col(key).cast("string").alias("id"), F.lit(error).alias("error"))
    alone = facts.select("fact_id").join(links.select("fact_id"), "fact_id", "left_anti").select(F.col("fact_id").cast("string").alias("id"), F.lit("no evidence").alias("error"))
    return missing("fact_id", facts, "missing fact").unionByName(missing("evidence_id", evidence, "missing evidence")).unionByName(alone)


def unresolved_reason(id_: Column, code: Column, rank: Column, conflict: Column, notes: Column, value: Column) -> Column:
    """Why an external row has no match: the first that applies."""
    drift = (conflict == "SPLIT_LUMP_DRIFT") | F.contains(F.lower(text(notes)), F.lit("drift")) | F.contains(F.lower(text(value)), F.lit("change"))
    return (
        F.when(text(id_) == "", "external_id_missing").when(text(code) == "", "code_missing")
        .when(F.contains(text(rank), F.lit("subspecies")) | F.contains(text(rank), F.lit("group")), "subspecies_or_group_rank")
        .when(conflict.isNotNull() & drift, "checklist_drift_note").when(conflict.isin("NAME_MISMATCH", "GENUS_MISMATCH", "FAMILY_MISMATCH"), "possible_name_mismatch").otherwise("unknown")
    )


def attachability(records: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """method, n, share of records (name) that nodes (name) hold by their name, by an alias (alias, name), or not at all."""
    own = nodes.select("name").distinct()
    direct = own.withColumn("_d", F.lit(True))
    by_alias = aliases.join(own, "name", "left_semi").select(F.col("alias").alias("name")).distinct().withColumn("_a", F.lit(True))
    rows = records.select("name").join(direct, "name", "left").join(by_alias, "name", "left")
    method = F.when(F.col("_d"), "direct").when(F.col("_a"), "alias").otherwise("unresolved")
    counted = rows.groupBy(method.alias("method")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("_all")))).select("method", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))
