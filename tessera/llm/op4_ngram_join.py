"""N-gram Jaccard join with adaptive multi-match prefixes, exact.

A document's set is its distinct five-word shingles.  Two sets with similarity 0.8 or more share at least l
shingles within the first n - ceil(0.8 n) + l of each, in any fixed order (here: of the shingles' hashes).  Each
document picks its own l by estimated cost: frequent shingles (more than LIGHT documents) in the prefix are not
joined at all but raise l by one each, so that a partner must still share l - heavy light ones; among the l that
allow this, the one of least expected join rows and verifications wins.  The pair's smaller l decides.

Documents whose prefixes are mostly heavy (large groups of near copies) are joined in blocks instead: candidate
pairs and chains of shared heavy shingles are followed to candidate groups, each group is cut into blocks of
BLOCK documents, and each pair of blocks is verified in its own task by a matrix product.  Large groups are
first compared with a few pivots; blocks that these join into one component already are not compared again.
A task returns a spanning forest of its links only, so rows stay in proportion to documents.

Equal sets are one class from the start, so thousands of copies cost one row each; a class is named within by the
number of one of its rows, never by an id.  Null or empty texts have an empty set and link with nothing; fewer than
five words make one shingle.  Rows that share an id are documents of their own; a row without id is joined like
others but gives no component its id (null if no row has one).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, by_ids, grams, join_counted, lists, mix, row_key, signed, small_batches, table, worded
from tessera.llm.graph import components

SHINGLE = 5
#: A shingle is light in up to so many documents; a verification costs as much as so many join rows.
LIGHT, VERIFY = 32, 64
#: Documents and shingles of a block, pivots of a group, and columns of one matrix product.
BLOCK, BLOCK_TOKENS, PIVOTS, COLUMNS = 256, 400_000, 8, 8192
#: Blocks of a component that one task deals to the others'.
DEALT = 64


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with a similar one: ceil(0.8 n)."""
    return -(-4 * n // 5)


def longest(n: np.ndarray) -> np.ndarray:
    """The largest l of a set of n."""
    return np.minimum(n // 10 + 4, np.maximum(needed(n), 1))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    for i, j, words in worded(column, lower=True):
        all_ = words.grams(SHINGLE)
        at = words.doc.tolist()
        for a, b in zip(at, at[1:]):
            if b - a >= SHINGLE:
                yield np.unique(all_[a : b - SHINGLE + 1])
            else:
                yield grams(words.hash[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _sets(docs: DataFrame) -> DataFrame:
    """All columns but the text; row (a number for each, fixed once this is written), n, s1, s2 (equal for equal
    sets) and the longest prefix that may be needed."""
    from pyspark.sql import types as T

    own = [f for f in docs.schema.fields if f.name != "text"]
    added = T._parse_datatype_string("row long, n long, s1 long, s2 long, prefix array<long>").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            n, sums, prefix = [], [], []
            for s in shingle_sets(b.column("text")):
                n.append(len(s))
                sums.append((mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()))
                k = len(s)
                prefix.append(s[: k - int(needed(k)) + int(longest(k))] if k else s)
            n, sums = np.array(n, np.int64), np.array(sums, np.uint64).reshape(-1, 2)
            flat = signed(np.concatenate(prefix)) if prefix else np.empty(0, np.int64)
            new = [pa.array(at + np.arange(len(n))), pa.array(n), pa.array(signed(sums[:, 0].copy())), pa.array(signed(sums[:, 1].copy())), lists(flat, np.array([len(p) for p in prefix], np.int64), pa.int64())]
            at += len(n)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in own), *new], [f.name for f in own + added])

    return docs.mapInArrow(run, T.StructType(own + added))


def _plans(shared: DataFrame) -> DataFrame:
    """Of each node (a set) with shared shingles: its l, how many light ones a partner must share, whether it is
    joined in blocks, its light shingles within the prefix, and its heavy shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, sizes = b.column("entries"), b.column("n").to_numpy()
            at = column.offsets.to_numpy() - column.offsets[0].as_py()
            places, tokens, counts = (column.flatten().field(c).to_numpy() for c in ("pos", "token", "df"))
            picked, least, blocked, light, heavy = [], [], [], [], []
            for n, i, j in zip(sizes.tolist(), at.tolist(), at[1:].tolist()):
                pos, df = places[i:j], counts[i:j]
                top, base = int(longest(n)), n - int(needed(n))
                ls = np.arange(1, top + 1)
                inside = pos[None, :] < (base + ls)[:, None]
                much = (inside & (df > LIGHT)).sum(1)
                rows = (inside * np.where(df > LIGHT, 0, df - 1)).sum(1)
                cost = np.where(ls > much, rows + VERIFY * rows / np.maximum(ls - much, 1), np.inf)
                k = int(cost.argmin()) if np.isfinite(cost).any() else top - 1
                picked.append(k + 1)
                least.append(max(1, k + 1 - int(much[k])))
                blocked.append(bool(much[-1] >= 0.75 * top))
                light.append(tokens[i:j][(df <= LIGHT) & (pos < base + k + 1)])
                heavy.append(tokens[i:j][df > LIGHT] if blocked[-1] else tokens[:0])
            joined = [lists(np.concatenate(x) if x else tokens[:0], np.array([len(y) for y in x], np.int64), pa.int64()) for x in (light, heavy)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(picked, pa.int32()), pa.array(least, pa.int32()), pa.array(blocked, pa.bool_()), *joined], ["node", "n", "l", "least", "blocked", "light", "heavy"])

    return shared.mapInArrow(run, "node long, n long, l int, least int, blocked boolean, light array<long>, heavy array<long>")


def similar(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Pairs (i, j) of similar sets: i < j if left is 0, else i among the first left and j among the rest."""
    n = np.array([len(s) for s in sets], np.float64)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    keep = count[inverse] > 1
    column, doc = (np.cumsum(count > 1) - 1)[inverse[keep]], doc[keep]
    both = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, COLUMNS):
        a, z = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, width - c)), np.float32)
        m[doc[a:z], column[a:z] - c] = 1
        both += m @ m.T
    good = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    if left:
        good[left:] = False
        good[:, :left] = False
        return np.argwhere(good)
    return np.argwhere(np.triu(good, 1))


def _forest(docs: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """The links that join something new, in order."""
    root = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(docs[i]), find(docs[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((docs[i], docs[j]))
    return out


def _verify(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b found by each task; tasks: task, side (0 left, 1 right, 2 alone), node."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("node", "ascending")])
        side = t.column("side").to_numpy()
        column = t.column("tokens").combine_chunks()
        flat, at = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        own = [flat[a - at[0] : b - at[0]] for a, b in zip(at, at[1:])]
        pairs = similar(own, int((side == 0).sum())) if len(own) > 1 else np.empty((0, 2), np.int64)
        links = _forest(t.column("node").to_pylist(), pairs)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return tasks.join(sets, "node").groupBy("task").applyInArrow(run, "a long, b long")


def _links(docs: DataFrame, plans: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs; keys: the row (node, id, tie) that holds each node's text."""
    light = plans.select("node", "n", "l", "least", F.explode("light").alias("token"))
    a, b = (light.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "l", "least"))) for k in "ab")
    pairs = a.join(b, "token").where("node_a < node_b and 5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")
    pairs = pairs.groupBy("node_a", "node_b").agg(F.count("*").alias("shared"), F.min(F.when(F.col("l_a") < F.col("l_b"), F.col("least_a")).when(F.col("l_a") > F.col("l_b"), F.col("least_b")).otherwise(F.least("least_a", "least_b"))).alias("least"))
    near = pairs.where("shared >= least").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    heavy = plans.where("blocked").select("node", F.explode("heavy").alias("token"))
    first = scratch.table(heavy.groupBy("token").agg(F.min("node").alias("b"), F.count("*").alias("count")), "first")
    chained = join_counted(heavy, first, "token").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    groups = components(near.unionByName(chained), scratch, "candidates")
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    groups = scratch.table(groups.unionByName(roots).join(plans.select("node", "n").distinct(), "node"), "groups")
    wanted = scratch.table(by_ids(keys, groups.select("node"), n := groups.count(), "left_semi", ["node"]), "wanted")
    texts = by_ids(docs, wanted, n, "inner", ["id", "tie"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = list(shingle_sets(x.column("text")))
            flat = signed(np.concatenate(own)) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([x.column("node"), lists(flat, np.array([len(s) for s in own], np.int64), pa.int64())], ["node", "tokens"])

    sets = texts.mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node", "tokens"])
    sets = scratch.table(sets, "sets")
    # large groups: every document against the group's pivots
    sized = scratch.table(groups.groupBy("component").agg(F.count("*").alias("count")).where(F.col("count") > BLOCK).withColumn("chunks", F.ceil(F.col("count") / F.lit(BLOCK))), "sized")
    large = scratch.table(join_counted(groups, sized, "component"), "large")
    if large.isEmpty():
        compared = large.select(F.col("node").alias("a"), F.col("node").alias("b"))
    else:
        # the least of PIVOTS hashes each: partial aggregates of fixed size, whatever the group
        least = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"] for k in range(PIVOTS)]
        pivots = large.groupBy("component", "chunks").agg(F.array_distinct(F.array(*least)).alias("p"))
        pivots = scratch.table(pivots.select("component", "chunks", F.explode("p").alias("node")), "pivots")
        rest = large.join(pivots.select("node"), "node", "left_anti")
        rest = rest.select("component", "node", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks")).alias("chunk"), F.lit(1).alias("side"))
        left = pivots.select("component", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"))
        tasks = rest.unionByName(left).select(F.struct("component", "chunk").alias("task"), "side", "node")
        compared = scratch.table(_verify(tasks, sets), "compared")
    joined = components(compared, scratch, "joined")
    groups = scratch.table(groups.join(joined.withColumnRenamed("component", "own"), "node", "left").withColumn("own", F.coalesce("own", "node")), "owned")
    blocks, todo = _blocks(groups, scratch)
    sides = todo.select(F.struct("i", "h_i", "j", "h_j").alias("task"), F.explode(F.when((F.col("i") == F.col("j")) & (F.col("h_i") == F.col("h_j")), F.array(F.struct(F.lit(2).alias("side"), F.col("i").alias("cell"), F.col("h_i").alias("h")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("cell"), F.col("h_i").alias("h")), F.struct(F.lit(1).alias("side"), F.col("j").alias("cell"), F.col("h_j").alias("h"))))).alias("s"))
    tasks = sides.select("task", "s.side", "s.cell", "s.h").join(blocks, ["cell", "h"]).select("task", "side", "node")
    return compared.unionByName(scratch.table(_verify(tasks, sets), "verified"))


def _blocks(groups: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Blocks (cell, h, node), and the pairs of blocks (i, h_i, j, h_j) whose documents are still to be compared.

    A cell holds a group's documents of one size class (sizes within a factor of 1.25), either those that one large
    component joins already, or all others.  Blocks cut a cell by hash.  Similar documents lie in one class or in
    neighbouring ones, and two blocks of the same joined component need no comparison.
    """
    owns = scratch.table(groups.groupBy("own").agg(F.count("*").alias("count")).withColumn("members", F.col("count")), "owns")
    rows = join_counted(groups, owns, "own")
    rows = rows.withColumn("joined", F.when(F.col("members") >= BLOCK, F.col("own"))).withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    rows = scratch.table(rows.select("node", "n", "component", "joined", "class", F.xxhash64("component", F.coalesce("joined", F.lit(-1)), "class").alias("cell")), "celled")
    cells = rows.groupBy("cell", "component", "joined", "class").agg(F.count("*").alias("count"), F.sum("n").alias("tokens"))
    cells = cells.withColumn("k", F.greatest(F.ceil(F.col("count") / F.lit(BLOCK)), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS))))
    cells = scratch.table(cells, "cells")
    placed = join_counted(rows.select("node", "cell"), cells.select("cell", "k", "count"), "cell")
    blocks = scratch.table(placed.select("cell", F.pmod(F.xxhash64(F.lit(6), "node"), F.col("k")).alias("h"), "node"), "blocks")
    # blocks meet the cells of their class and the next; a component of many blocks is dealt to many tasks
    all_ = cells.groupBy("component").agg(F.ceil(F.sum("k") / F.lit(DEALT)).alias("salts"))
    cells = scratch.table(cells.join(all_, "component"), "salted")
    left = cells.select("component", F.col("cell").alias("i"), F.col("joined").alias("joined_i"), "salts", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("h_i"))
    left = left.withColumn("salt", F.pmod(F.xxhash64("i", "h_i"), F.col("salts"))).drop("salts")
    left = left.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).withColumn("class", F.col("class") + F.col("step"))
    right = cells.select("component", F.col("cell").alias("j"), F.col("joined").alias("joined_j"), "class", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    pairs = left.join(right, ["component", "class", "salt"]).where("(step = 1 or i <= j) and not coalesce(joined_i = joined_j, false)")
    pairs = pairs.select("i", "h_i", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("h_j"))
    return blocks, pairs.where("i <> j or h_i <= h_j")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component (a number; null without shingles), component_id and the columns to carry of each row."""
    scratch = Scratch(docs.sparkSession, "op4")
    id_, tie = row_key(docs[id_col], docs[text_col])
    docs = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), id_.alias("id"), tie.alias("tie"), *(docs[c].alias(f"c{k}") for k, c in enumerate(carry)))
    sets = scratch.table(_sets(docs), "sets_of_all")
    carried = [f"c{k}" for k in range(len(carry))]
    some = sets.where("n > 0").select("row", "doc_id", "id", "tie", "n", F.struct("s1", "s2", "n").alias("key"), *carried)
    firsts = scratch.table(some.groupBy("key").agg(F.min("row").alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("count")), "firsts")
    of = scratch.table(join_counted(some, firsts.drop("least"), "key").drop("key"), "classes")
    copies = of.where("row <> first").select("row")
    own = by_ids(sets.where("n > 0"), copies, copies.count(), "left_anti", ["row"])
    tokens = own.select(F.col("row").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    frequent = scratch.table(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumn("count", F.col("df")), "frequent")
    shared = join_counted(tokens, frequent, "token")
    plans = _plans(shared.groupBy("node", "n").agg(F.collect_list(F.struct("pos", "token", F.col("df"))).alias("entries")))
    plans = scratch.table(plans, "plans")
    keys = of.where("row = first").select(F.col("row").alias("node"), "id", "tie")
    found = components(_links(docs.select("id", "tie", "text"), plans, keys, scratch), scratch, "components")
    # each component's least id, then each class's
    members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    members = scratch.table(members.join(firsts.select(F.col("first").alias("node"), "least"), "node"), "members")
    least = scratch.table(members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("count")), "least")
    joined = join_counted(members.drop("least"), least, "component").select(F.col("node").alias("first"), "component", "component_id")
    own = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id"))
    labels = firsts.join(joined, "first", "left").select("first", "count", F.coalesce("component", "first").alias("component"), own.alias("component_id"))
    rows = join_counted(of, scratch.table(labels, "labels"), "first")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "component", "component_id", *carried)
    rows = rows.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), *carried))
    return rows.withColumnsRenamed(dict(zip(carried, carry)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return linked(docs, id_col, text_col).drop("component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
