"""Token-id files with byte planes.

Documents are range-partitioned and sorted by id; each task encodes its documents, ends each with an end id
and writes one file: fixed-size blocks of 32-bit ids, transposed into four byte planes, each plane compressed
by zstandard, then an index of blocks and documents.  The manifest, written by Spark, names the files of the
tasks that ended well, so that files of lost or repeated attempts are never read.

Null text counts as empty (only the end id).  Null document ids come first.  Rows with the same id keep a
document each, next to each other.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import TOKEN_BYTES, Scratch, chunks, only, table, utf8
from tessera.llm.tokens import encoder, vocabulary

MAGIC = b"TSPLANE1"
BLOCK_IDS = 1 << 16
END_ID = 1
LEVEL = 3


def with_ends(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents, each followed by end_id."""
    n = len(at) - 1
    return np.insert(ids, at[1:], end_id), at + np.arange(n + 1)


class Writer:
    """Writes one file of ids to an open stream."""

    def __init__(self, out):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL)
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0
        self.blocks: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.at = out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p.tobytes()) for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()]
        self.blocks.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.at += self.out.write(p)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, at: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes.append(np.diff(at))
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            all_ = np.concatenate(self.rest)
            whole = len(all_) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self._block(all_[i : i + BLOCK_IDS])
            self.rest, self.held = [all_[whole:]], len(all_) - whole

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        sizes = np.concatenate([*self.sizes, np.empty(0, np.int64)])
        null = np.array([x is None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        index = [self.zip.compress(x.tobytes()) for x in (ids, null, sizes.astype("<i8"))]
        head = json.dumps({"blocks": self.blocks, "documents": list(map(len, index))}).encode()
        for part in (*index, head, struct.pack("<q", len(head)), MAGIC):
            self.out.write(part)


class Reader:
    """Reads one file: documents(), and ids(first, end) of any range through the block index."""

    def __init__(self, file):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a whole token file")
        length = struct.unpack("<q", tail[:8])[0]
        head = json.loads(file.read_at(length, size - 16 - length))
        self.blocks = np.array(head["blocks"], np.int64).reshape(-1, 6)
        self.ends = np.cumsum(self.blocks[:, 1])
        at, parts = size - 16 - length - sum(head["documents"]), []
        for n in head["documents"]:
            parts.append(self.unzip.decompress(file.read_at(n, at)))
            at += n
        self.doc_ids, self.null, self.sizes = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<i8")

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.blocks[k])
        raw, planes = self.file.read_at(sum(sizes), at), []
        for s in sizes:
            planes.append(np.frombuffer(self.unzip.decompress(raw[:s]), np.uint8))
            raw = raw[s:]
        return np.stack(planes, 1).reshape(-1).view("<u4")

    def ids(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.empty(0, "<u4")
        a, b = np.searchsorted(self.ends, first, "right"), np.searchsorted(self.ends, end, "left")
        begin = int(self.ends[a] - self.blocks[a, 1])
        return np.concatenate([self.block(k) for k in range(a, b + 1)])[first - begin : end - begin]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in this file, tokens, crc32 of the ids' bytes), block after block."""
        k, have, at = 0, b"", 0
        for doc_id, null, size in zip(self.doc_ids.tolist(), self.null.tolist(), self.sizes.tolist()):
            left, crc = 4 * size, 0
            while left:
                if not have:
                    have, k = memoryview(self.block(k).tobytes()), k + 1
                part, have = have[:left], have[left:]
                crc, left = zlib.crc32(part, crc), left - len(part)
            yield (None if null else doc_id), at, size, crc
            at += size


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into folder (a URI that all executors share); returns part, file, n_docs, n_ids of each, not yet run."""
    rows = only(docs, doc_id=id_col, text=text_col)
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))  # an id may recur

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, writer = encoder(path), TaskContext.get().partitionId(), None
        fs, where = pfs.FileSystem.from_uri(folder)
        name = f"{part:08d}-{uuid.uuid4().hex}.ids"
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                fs.create_dir(where)
                writer = Writer(fs.open_output_stream(f"{where}/{name}"))
            data, at = utf8(b.column("text"))
            doc_ids = b.column("doc_id").to_pylist()
            for i, j in chunks(at, TOKEN_BYTES):
                writer.add(doc_ids[i:j], *with_ends(*own.ids(data[at[i] : at[j]], at[i : j + 1] - at[i]), end_id))
        if writer:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.total]})

    return rows.mapInArrow(run, "part int, file string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, in parallel by file."""
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pfs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with fs.open_input_file(f"{where}/{name}") as f:
                    rows = list(Reader(f).documents())
                doc_id, start, n_tokens, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(np.array(start) + base), pa.array(n_tokens, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select("file", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    folder = scratch.path("ids")
    manifest = scratch.table(write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary()), "manifest")
    return read_token_files(manifest, folder)
