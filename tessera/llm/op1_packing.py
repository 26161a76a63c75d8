"""Best-fit packing of documents into training sequences.

One pass encodes each document, ends it with an end id and cuts only what is longer than a sequence.  The
pieces' sizes (no ids), written with a number each, are then dealt by it to tasks of PIECES_A_TASK pieces, and each
task packs its own online: a bitset over free space finds the open bin that a piece fills best; at most OPEN_BINS
stay open, and the fullest closes first.  Pieces come in falling size, equal ones by number, so a repeated attempt
gives the same bins.

Null text counts as empty (one piece that holds the end id).  Null ids and repeated rows are packed like others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import TOKEN_BYTES, Scratch, chunks, drop_caches, lists, only, table, utf8
from tessera.llm.op3_token_files import END_ID, with_ends
from tessera.llm.tokens import crc, encoder, vocabulary

SEQUENCE = 4096
OPEN_BINS = 1 << 15
PIECES_A_TASK = 250_000


class BestFit:
    """Bounded-space online best fit: place(size) gives a bin and the offset in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        own = self.bins[free].pop()
        if not self.bins[free]:
            self.free ^= 1 << free
        self.open -= 1
        return own

    def place(self, size: int) -> tuple[int, int]:
        if fits := self.free >> size:
            free = (fits & -fits).bit_length() - 1 + size
            own = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            free, own, self.made = self.capacity, self.made, self.made + 1
        if left := free - size:
            self.bins[left].append(own)
            self.free |= 1 << left
            self.open += 1
        return own, self.capacity - free


def cut(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (a number for each, fixed once this is written) and, if wanted,
    ids of each piece; one pass over the texts."""
    rows = only(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in chunks(at, TOKEN_BYTES):
                ids, begin = with_ends(*own.ids(data[at[i] : at[j]], at[i : j + 1] - at[i]), end_id)
                size = np.diff(begin)
                n = -(-size // sequence)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * sequence
                length = np.minimum(sequence, size[doc] - start)
                raw, first = memoryview(ids.tobytes()), begin[:-1][doc] + start
                sums = [crc(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist())]
                out = [b.column("doc_id").take(pa.array(doc + i)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(made + np.arange(len(doc)))]
                made += len(doc)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
                yield pa.RecordBatch.from_arrays(out + [lists(ids.view(np.int32), length, pa.int32())] * with_ids, names + ["ids"] * with_ids)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, row long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, n_pieces: int, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset; n_pieces, their number, decides how many tasks pack them."""
    from pyspark.sql import types as T

    tasks = max(1, -(-n_pieces // PIECES_A_TASK))
    dealt = pieces.repartition(tasks, "row").sortWithinPartitions(pieces.length.desc(), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()  # vocabularies are done with
        part, bins = TaskContext.get().partitionId(), BestFit(sequence, open_bins)
        for b in batches:
            placed = [bins.place(n) for n in b.column("length").to_pylist()]
            placed = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(placed[:, 0] + (part << 33)), pa.array(placed[:, 1])], [*b.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "op1")
    pieces = scratch.table(cut(docs, path, sequence), "pieces")
    return pack(pieces, pieces.count(), sequence, open_bins).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
