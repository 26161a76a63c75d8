"""Removal of repeated word sequences by relative Lempel-Ziv parsing against all earlier text, exact.

Every run of WINDOW words that also starts earlier (in a document of smaller id, or before in the same one) is
removed.  The reference blocks are cut where a GRAM-word hash falls below a fixed value, BLOCK words apart on
average, each with the WINDOW - 1 words that follow; all blocks are indexed by hash with their earliest place.  A
block found there is a duplicate as a whole: none of its windows is looked up.  Only at the boundaries of such
matches, in blocks that are not whole repeats, single windows are looked up; those whose anchor (the least
GRAM-word hash in it) occurs once cannot be repeats and are left out by count.  An earliest window always lies in
a block that is no repeat, so this index is complete.  Each document is then parsed greedily: a factor goes on as
long as blocks and windows continue the same reference, and the factors are the spans that go.

A document whose whole word sequence equals an earlier one is settled at once.  Null text has no words; a null
id comes before all others.  Rows that share an id but differ in text are documents of their own, in the order of
a hash of their texts; rows alike in id and text are one document and get the same result each.  Texts with fewer
words than a window lose nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, Scratch, by_ids, chunks, drop_caches, grams, join_counted, lists, mix, only, powers, row_key, signed, small_batches, table, unused, utf8, worded

WINDOW, GRAM = 20, 5
KEY = ["id", "tie"]
#: Words of a block on average (besides the WINDOW - 1 that it shares with the next).
BLOCK = 32
_CUT = np.uint64((1 << 64) // BLOCK)
_ORDER = 0x2545F4914F6CDD1D
_BACK = pow(_ORDER, -1, 1 << 64)


def least_in_windows(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width (a power of two) consecutive values."""
    k = 1
    while k < width:
        g = np.minimum(g[: len(g) - k], g[k:])
        k *= 2
    return g


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window of one document's word hashes: its least GRAM-word hash."""
    return least_in_windows(grams(hashes, GRAM), WINDOW - GRAM + 1)


def cuts(hashes: np.ndarray) -> np.ndarray:
    """Where the blocks of one document's words start; content alone decides, so equal passages are cut alike."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64)
    return np.union1d([0], np.flatnonzero(grams(hashes, GRAM)[:n] < _CUT))


def _block_lists(docs: DataFrame) -> DataFrame:
    """id, tie, n_words, s1, s2 (equal for equal word sequences), the blocks (start, words, hash) and the anchors;
    an anchor that recurs in its document comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sums, parts, out = [], [], [], []
            for i, j, words in worded(b.column("text"), lower=False):
                at = words.doc.tolist()
                for a, z in zip(at, at[1:]):
                    h = words.hash[a:z]
                    n.append(z - a)
                    p = powers(_ORDER, z - a)
                    weighted = h * p
                    sums.append((weighted.sum(), (mix(h ^ np.uint64(_ORDER)) * p).sum()))
                    if z - a < WINDOW:
                        continue
                    first = cuts(h)
                    size = np.append(first[1:] + WINDOW - 1, z - a) - first
                    total = np.zeros(z - a + 1, np.uint64)
                    np.cumsum(weighted, out=total[1:])
                    own = mix((total[first + size] - total[first]) * powers(_BACK, z - a)[first] + size.astype(np.uint64))
                    parts.append((len(n) - 1, first, size, own))
                    g = grams(h, GRAM)
                    kinds, count = np.unique(g, return_counts=True)
                    own = np.unique(least_in_windows(g, WINDOW - GRAM + 1))
                    out.append((len(n) - 1, np.concatenate([own, own[count[np.searchsorted(kinds, own)] > 1]])))
            n, sums = np.array(n, np.int64), np.array(sums, np.uint64).reshape(-1, 2)

            def column(found: list, k: int, kind: pa.DataType, empty: np.ndarray) -> pa.Array:
                sizes = np.zeros(len(n), np.int64)
                for x in found:
                    sizes[x[0]] = len(x[k])
                return lists(np.concatenate([x[k] for x in found]) if found else empty, sizes, kind)

            none, none32 = np.empty(0, np.int64), np.empty(0, np.int32)
            parts = [(k, first.astype(np.int32), size.astype(np.int32), signed(own)) for k, first, size, own in parts]
            columns = [column(parts, 1, pa.int32(), none32), column(parts, 2, pa.int32(), none32), column(parts, 3, pa.int64(), none), column([(k, signed(x)) for k, x in out], 1, pa.int64(), none)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), pa.array(n), pa.array(signed(sums[:, 0].copy())), pa.array(signed(sums[:, 1].copy())), *columns], ["id", "tie", "n_words", "s1", "s2", "start", "words", "block", "anchors"])

    return docs.mapInArrow(run, "id long, tie long, n_words long, s1 long, s2 long, start array<int>, words array<int>, block array<long>, anchors array<long>")


def _windows(texts: DataFrame) -> DataFrame:
    """hash, id, tie, first start, further starts of each different window whose anchor is in the row's list ``shared``
    and whose start is in no block of the row's list ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, whole = b.column("shared"), b.column("whole")
            flat, at = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            at = at - at[0]
            ids, ties = (b.column(c).to_numpy() for c in ("id", "tie"))
            for i, j, words in worded(b.column("text"), lower=False):
                found = []
                for k in range(i, j):
                    h = words.hash[words.doc[k - i] : words.doc[k - i + 1]]
                    if len(h) < WINDOW:
                        continue
                    wanted = np.isin(anchors(h), flat[at[k] : at[k + 1]])
                    if known := whole[k].as_py():
                        first = cuts(h)
                        wanted &= ~np.isin(first, known)[np.searchsorted(first, np.arange(len(wanted)), "right") - 1]
                    start = np.flatnonzero(wanted).astype(np.int32)
                    if not len(start):
                        continue
                    w = grams(h, WINDOW)[start]
                    order = np.argsort(w, kind="stable")
                    w, start = w[order], start[order]
                    new = np.ones(len(w), bool)
                    new[1:] = w[1:] != w[:-1]
                    sizes = np.diff(np.append(np.flatnonzero(new), len(w))) - 1
                    found.append((signed(w[new]), np.full(len(sizes), ids[k], np.int64), np.full(len(sizes), ties[k], np.int64), start[new], start[~new], sizes))
                if found:
                    w, doc, tie, first, again, sizes = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(doc), pa.array(tie), pa.array(first), lists(again, sizes, pa.int32())], ["hash", "id", "tie", "start", "again"])

    return texts.mapInArrow(run, "hash long, id long, tie long, start int, again array<int>")


def factors(found: list[tuple[int, int, object, int]]) -> list[tuple[int, int, object, int]]:
    """Greedy factors (start, words, reference, its start) from passages found in the index, given likewise: the
    longest at a start begins a factor, which goes on as far as passages continue the same reference."""
    out: list[tuple[int, int, object, int]] = []
    for s, n, d, r in sorted(found, key=lambda x: (x[0], -x[1])):
        if out:
            a, m, d0, r0 = out[-1]
            if s + n <= a + m:
                continue
            if d == d0 and r - s == r0 - a and s <= a + m:
                out[-1] = (a, s + n - a, d0, r0)
                continue
        out.append((s, n, d, r))
    return out


class Repeats:
    """What is repeated in a table, by id and tie of its rows: ``spans`` (passages found) of documents that hold
    repeats, and ``copies`` of those whose words all repeat an earlier document."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch = scratch = Scratch(docs.sparkSession, "op6")
        id_, tie = row_key(docs[id_col], docs[text_col])
        docs = small_batches(docs).select(id_.alias("id"), tie.alias("tie"), docs[text_col].alias("text"))
        lists_ = scratch.table(_block_lists(docs), "blocks")
        long_ = lists_.where(f"n_words >= {WINDOW}")
        whole = long_.select(*KEY, "n_words", F.struct("s1", "s2", "n_words").alias("key"))
        firsts = whole.groupBy("key").agg(F.min(F.struct("id", "tie")).alias("first"), F.count("*").alias("count")).where("count > 1")
        copies = join_counted(whole, scratch.table(firsts, "firsts"), "key").where("struct(id, tie) <> first")
        self.copies = scratch.table(copies.select(*KEY, "n_words").distinct(), "copies")
        self.n_copies = self.copies.count()
        # rows alike in id and text are one document
        long_ = by_ids(long_, self.copies.select(*KEY), self.n_copies, "left_anti", KEY)
        place = F.struct(*KEY, "start")

        # blocks that occur earlier as a whole
        each = long_.select(*KEY, F.explode(F.arrays_zip("start", "words", "block")).alias("b")).select(*KEY, "b.start", "b.words", "b.block")
        first = each.groupBy("block").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("count"))
        first = scratch.table(first.where("first <> last").select("block", "first", "count"), "first_blocks")
        matched = join_counted(each, first, "block").where(place != F.col("first")).select(*KEY, "start", "words", "first")
        matched = scratch.table(matched.distinct(), "matched")
        # windows of the other blocks, where another window has the same anchor
        tokens = long_.select(*KEY, F.explode("anchors").alias("anchor"))
        often = scratch.table(tokens.groupBy("anchor").agg(F.count("*").alias("count")).where("count > 1"), "often")
        shared = join_counted(tokens, often, "anchor").groupBy(*KEY).agg(F.collect_set("anchor").alias("shared"))
        known = matched.groupBy(*KEY).agg(F.collect_set("start").alias("whole"))
        shared = scratch.table(shared.join(known, KEY, "left"), "shared")
        texts = by_ids(docs, shared.select(*KEY), shared.count(), "left_semi", KEY).join(shared, KEY)
        windows = scratch.table(_windows(texts), "windows")
        first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("count"))
        first = scratch.table(first.where("first <> last").select("hash", "first", "count"), "first")
        found = join_counted(windows, first, "hash", "left").where("first is not null or size(again) > 0")
        # the first place of all is no repeat itself; further ones of its own document are
        own = F.col("first").isNull() | (place == F.col("first"))
        starts = F.when(own, F.col("again")).otherwise(F.concat(F.array("start"), F.col("again")))
        found = found.select(*KEY, F.explode(starts).alias("start"), F.lit(WINDOW).alias("words"), F.coalesce("first", place).alias("first"))
        entry = F.struct("start", "words", F.col("first.id").alias("ref"), F.col("first.tie").alias("ref_tie"), F.col("first.start").alias("ref_start"))
        found = found.unionByName(matched).select(*KEY, entry.alias("e"))
        self.spans = scratch.table(found.groupBy(*KEY).agg(F.collect_set("e").alias("entries")), "repeated")
        self.n_spans = self.spans.count()
        scratch.drop("windows", "first", "first_blocks", "matched", "firsts", "shared", "often", "blocks")


#: What parsing adds to a row.
_ADDED = {"n_words": "bigint", "n_removed": "bigint", "kept": "string", "factors": "array<struct<start:int,words:int,ref_doc:bigint,ref_start:int>>"}


def parsed(docs: DataFrame, found: Repeats, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns of docs with n_words, n_removed, kept (the words that stay, joined by one space) and factors, without
    the copies of earlier documents (nothing of them stays); and the names of the four, which differ where docs has
    such columns."""
    from pyspark.sql import types as T

    key, entries_col, tie_col = (unused(docs.columns, c) for c in ("id_key", "entries", "tie"))
    id_, tie = row_key(docs[id_col], docs[text_col])
    rows = small_batches(docs).withColumns({key: id_, tie_col: tie})
    renamed = lambda df: df.withColumnsRenamed({"id": key, "tie": tie_col, "entries": entries_col})
    keys = [key, tie_col]
    rows = by_ids(rows, renamed(found.copies).select(*keys), found.n_copies, "left_anti", keys)
    spans = renamed(found.spans)
    touched = by_ids(rows, spans.select(*keys), found.n_spans, "left_semi", keys).join(spans, keys)
    clean = by_ids(rows, spans.select(*keys), found.n_spans, "left_anti", keys).withColumn(entries_col, F.lit(None).cast(spans.schema[entries_col].dataType))
    rows = clean.unionByName(touched)
    kept_columns = docs.schema.fields
    names = [unused(docs.columns, c) for c in _ADDED]
    schema = T.StructType(kept_columns + T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in zip(names, _ADDED.values()))).fields)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for b in batches:
            data, at = utf8(b.column(text_col))
            column, n, gone, kept, parts = b.column(entries_col), [], [], [], []
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            fields = [column.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "words", "ref", "ref_tie", "ref_start")]
            for i, j in chunks(at):
                raw = data[at[i] : at[j]].tobytes()
                for k in range(i, j):
                    words = raw[at[k] - at[i] : at[k + 1] - at[i]].split()
                    n.append(len(words))
                    s, size, ref, tie, r = (x[ends[k] : ends[k + 1]].tolist() for x in fields)
                    out = factors(list(zip(s, size, zip(ref, tie), r)))
                    if out:
                        mask = np.ones(len(words), bool)
                        for a, m, _, _ in out:
                            mask[a : a + m] = False
                        words = [w for w, stays in zip(words, mask.tolist()) if stays]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                    parts.append([{"start": a, "words": m, "ref_doc": None if d[0] == NO_ID else d[0], "ref_start": r0} for a, m, d, r0 in out])
            own = [b.column(f.name) for f in kept_columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(parts, arrow)], schema.names)

    return rows.mapInArrow(run, schema), names


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept, factors of each row."""
    found = Repeats(docs, id_col, text_col)
    docs = only(docs, doc_id=id_col, text=text_col)
    rows, _ = parsed(docs, found)
    id_, tie = row_key(F.col("doc_id"), F.col("text"))
    copies = by_ids(docs.withColumns({"id": id_, "tie": tie}), found.copies, found.n_copies, "inner", KEY)
    copies = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"), F.array().cast(_ADDED["factors"]).alias("factors"))
    return rows.drop("text").unionByName(copies).withColumn("doc_id", F.col("doc_id").cast("long"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated words removed; where any were, the words that stay are joined by one space.  Rows of which
    nothing stays are left out."""
    rows, (_, gone, kept, _) = parsed(docs, Repeats(docs, id_col, text_col), id_col, text_col)
    rows = rows.where((F.col(gone) == 0) | (F.col(kept) != "")).withColumn(text_col, F.when(F.col(gone) > 0, F.col(kept)).otherwise(F.col(text_col)))
    return rows.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = removed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
