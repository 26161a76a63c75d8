"""Connected components of links between nodes: local forests, then alternating stars until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_counted

#: Links (16 bytes each) that a task holds at a time.
HELD = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some links and the least id that each reaches."""
    ids, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        while (jumped := new[new]).tolist() != new.tolist():
            new = jumped
        if (new == label).all():
            return ids, ids[label]
        label = new


def forests(links: DataFrame, held: int) -> DataFrame:
    """Links (u, v) that join the same nodes: of each held links of a task, one star for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            ids, label = least_labels(*(np.concatenate(x) for x in zip(*parts)))
            rest = ids != label
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(label[rest])], ["u", "v"])

        for b in batches:
            u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
            for i in range(0, len(u), held):
                if parts and sum(len(x) for x, _ in parts) + len(u[i : i + held]) > held:
                    yield stars()
                parts.append((u[i : i + held], v[i : i + held]))
        if parts:
            yield stars()

    return links.mapInArrow(run, "u long, v long")


def _settled(now: DataFrame) -> bool:
    """Whether every node has one link, to one that has none."""
    if not now.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return now.select(F.col("v").alias("u")).distinct().join(now, "u", "left_semi").isEmpty()


def components(links: DataFrame, scratch: Scratch, name: str, held: int = HELD) -> DataFrame:
    """node, component (the least node reachable) of each node in links (columns a, b) that isn't the least itself.

    Links are replaced by forests of held links each, then stars alternate with such forests until each node has
    one link, to its component's least node.  Each round is written to the shared folder; rounds grow with the
    logarithm of the longest chain.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, k = scratch.table(links.distinct(), f"{name}0"), 0
    while True:
        tasks = -(-now.count() // held)
        done = scratch.table(forests(now.coalesce(max(1, tasks)), held), f"{name}{k}forest")
        if _settled(done):
            return done.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = done.unionByName(done.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        least = scratch.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("count")), f"{name}{k}least")
        large = join_counted(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node belongs to few larger stars: no u is hot here
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), f"{name}{k + 1}")
        scratch.drop(f"{name}{k}", f"{name}{k}least", f"{name}{k}forest")
        k += 1
