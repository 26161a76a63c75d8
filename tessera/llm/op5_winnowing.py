"""Document fingerprints by winnowing, in DataFrame functions only.

Units are words cut into runs of at most four characters.  Each GRAM consecutive units are hashed by doubling
(pairs, then pairs of pairs), and of each WINDOW consecutive hashes the least is kept, the rightmost among
equals, with its position.  Two texts that share WINDOW + GRAM - 1 consecutive units share a fingerprint entry.
The first windows are filled up in front with hashes that never win, so a text's beginning counts too; a text
with fewer units than GRAM is padded, so every text, empty ones too, has a fingerprint.

The guarantee is one on units, not on characters: a shared passage counts from its first whole word on.  Hashes are
combined by doubling, not rolled, as array functions have no running state; each is cut to 32 bits in an entry.

Likeness is the Jaccard similarity of the two sets of kept hashes.  The next document is found on ids alone; then each
row meets its text's plan once, and only a text's needed beginning and its entries go to the row before.

Null text counts as empty; null ids come before all others; rows that repeat an id come in the order of their texts'
hashes, rows alike in id and text follow each other, so each row has one next document.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, by_ids, numbered, row_key, table

GRAM, WINDOW = 4, 8
UNIT = r"[^\x20\x09-\x0D]{1,4}"
KEY = ["id", "tie"]
#: Rows alike in id and text that one task gives out.
ALIKE = 10_000
_LAST = (1 << 31) - 1


def _shifted(a: Column, by: int) -> tuple[Column, Column]:
    n = F.size(a) - by
    return F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n)


def kept(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: the kept entries, hash * 2 ** 31 + (2 ** 31 - 1 - position).

    One projection for each step: an expression that is used twice within one would be computed twice.
    """
    steps = [
        lambda c: F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)),
        lambda c: F.concat(c, F.array_repeat(F.lit(""), F.greatest(F.lit(GRAM) - F.size(c), F.lit(0)))),
        lambda c: F.transform(c, lambda u: F.xxhash64(u)),
        *(lambda c, by=by: F.zip_with(*_shifted(c, by), lambda a, b: F.xxhash64(a, b)) for by in (1, 2)),
        lambda c: F.transform(c, lambda h, i: h.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(1 << 31) + (F.lit(_LAST).cast("long") - i)),
        lambda c: F.concat(F.array_repeat(F.lit((1 << 63) - 1), F.lit(WINDOW - 1)), c),
        *(lambda c, by=by: F.zip_with(*_shifted(c, by), lambda a, b: F.least(a, b)) for by in (1, 2, 4)),
        lambda c: F.array_distinct(c),
    ]
    for step in steps:
        df = df.withColumn(out, step(F.col(out)))
    return df


def hashes(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda v: F.shiftright(v, 31)))


def shown(entries: Column) -> Column:
    """hash@position of each entry."""
    return F.array_join(F.transform(entries, lambda v: F.concat(F.hex(F.shiftright(v, 31)), F.lit("@"), (F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return kept(rows, "text", "entries").select("doc_id", shown(F.col("entries")).alias("fingerprint"))


def next_documents(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each different (id, tie) of rows with its number of rows, its characters, and the (id, tie) after
    it; the first one follows the last.  No texts are shuffled."""
    ids = rows.groupBy(*KEY).agg(F.min("absent").alias("absent"), F.count("*").alias("count"), F.max(F.char_length("text")).cast("long").alias("n_chars"))
    ids = scratch.table(ids, "ids")
    n = ids.count()
    at = scratch.table(numbered(ids, n, KEY, scratch, "by_id", "at"), "at")
    before = at.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), ((F.col("at") + (n - 1)) % F.lit(max(n, 1))).alias("at"))
    return at.join(before, "at").drop("at")


def likened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (the last quarter replaced by the next document's beginning), and the entries of the
    text (own) and of the next document (next), for each row."""
    scratch = Scratch(docs.sparkSession, "op5")
    id_, tie = row_key(F.col(id_col), F.col(text_col))
    kind = docs.schema[id_col].dataType
    rows = docs.select(id_.alias("id"), tie.alias("tie"), F.col(id_col).isNull().alias("absent"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nexts = next_documents(rows, scratch)
    asked = nexts.select(F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), F.col("id").alias("of_id"), F.col("tie").alias("of_tie"), F.floor(F.col("n_chars") / 4).cast("int").alias("of_cut"))
    plan = scratch.table(nexts.drop("next_id", "next_tie").join(asked, KEY).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int")), "plan")
    again = plan.where("count > 1")
    n_again = again.count()
    # every text meets the plan in one shuffle, whose output serves both the document and the one before it
    rows = rows.select(*KEY, "text")
    once = rows.join(plan.where("count = 1").hint("shuffle_hash"), KEY)
    alike = scratch.table(by_ids(rows, again, n_again, "inner", KEY).dropDuplicates(KEY), "alike")
    parts = [once, alike] if n_again else [once]
    heads = [x.select(F.col("of_id").alias("id"), F.col("of_tie").alias("tie"), F.expr("left(text, of_cut)").alias("head"), "text") for x in parts]
    heads = reduce(DataFrame.unionByName, [kept(x, "text", "next").drop("text") for x in heads]).hint("shuffle_hash")
    doc_id = F.when(~F.col("absent"), F.col("id")).cast(kind).alias("doc_id")
    edited = lambda head: F.concat(F.expr("left(text, n_chars - cut)"), head).alias("edited")
    out = [kept(x.join(heads, KEY), "text", "own").select(doc_id, "n_chars", edited(F.col("head")), "own", "next") for x in parts]
    if n_again:  # of rows alike all but one are followed by themselves
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 2) / ALIKE)))
        more = kept(alike.select("*", chunk.alias("k")).repartition("id", "tie", "k"), "text", "own")
        more = more.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(ALIKE).cast("long"), F.col("count") - 1 - F.col("k") * ALIKE))))
        out.append(more.select(doc_id, "n_chars", edited(F.expr("left(text, cut)")), "own", F.col("own").alias("next")))
    return reduce(DataFrame.unionByName, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(likened(table(spark, sf_dir, "documents")), "edited", "other")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"), hashes(F.col("own")).alias("own"), hashes(F.col("other")).alias("other"), hashes(F.col("next")).alias("next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
