"""What the training-data operators share: the shared folder, Arrow text access, word hashing, tokens.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout.  Hashes are 64 bits wide; two different words, shingles
or windows are taken as equal only when all 64 bits agree.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of text that are hashed at a time; a longer document is hashed alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a new one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder to cut lineage; a lost executor re-reads them.

    Tables that the returned DataFrame still reads stay until the owner of the folder removes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that Spark hands to Python at a time, and bytes of text that are tokenised together.
BATCH_BYTES, TOKEN_BYTES = 8 << 20, 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session hands Python BATCH_BYTES at a time where Spark's larger default would hold."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; further columns, clashing or not, stay out."""
    small_batches(df)
    return df.select(*(df[c].alias(name) for name, c in columns.items()))


#: Largest list of document ids (8 bytes each) that is broadcast; a longer one is shuffled.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, n_ids: int, how: str, keys: list[str]) -> DataFrame:
    """rows joined with n_ids rows of few columns on keys: broadcast up to BROADCAST_IDS, else shuffled."""
    from pyspark.sql import functions as F

    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids.hint("merge"), keys, how)


#: Stands for an absent id in a key; the text's hash beside it tells such rows from those with this very id.
NO_ID = -(1 << 63)


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two long columns without nulls that tell rows of different ids or texts apart, in the order of the ids."""
    from pyspark.sql import functions as F

    return F.coalesce(id_.cast("long"), F.lit(NO_ID)), F.xxhash64(id_.isNull(), F.coalesce(text, F.lit("")))


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores in front as far as columns have it already (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key with more rows than this, and than this share of all rows, is joined by broadcast: HOT_KEYS keys at most.
HOT_ROWS, HOT_KEYS = 2_000, 10_000


def join_counted(rows: DataFrame, keys: DataFrame, key: str | list[str], how: str = "inner", count: str = "count", total: int | None = None) -> DataFrame:
    """rows joined with one row for each key (a written table with the key's number of rows): no task gets all rows of a hot key.

    Keys with more than 1 / HOT_KEYS of all rows, so HOT_KEYS of them at most, are broadcast to where their rows
    are; only the others' rows are shuffled.
    """
    from pyspark.sql import functions as F

    if total is None:
        total = keys.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = keys.where(F.col(count) > least).drop(count), keys.where(F.col(count) <= least).drop(count)
    if hot.isEmpty():
        return rows.join(cold.hint("shuffle_hash"), key, how)
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold.hint("shuffle_hash"), key, how)
    return here.unionByName(rest)


#: Rows of a range of numbered() on average.
RANGE_ROWS = 50_000


def numbered(rows: DataFrame, n_rows: int, order: list[str], scratch: Scratch, name: str, number: str) -> DataFrame:
    """rows with their number (from 0) in an order without ties.

    Rows are dealt by ranges of the whole order, so neither a hot value nor an odd one fills a range; a row's number
    is the count of all lower ranges and its place in its own.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    ranged = rows.repartitionByRange(max(1, n_rows // RANGE_ROWS), *order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.table(ranged, name)
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return placed.join(counts, "_range").withColumn(number, F.col("_below") + F.col("_place")).drop("_range", "_below", "_place")


def strings(column: pa.Array) -> list[str]:
    """Python strings; null as empty."""
    return pc.fill_null(column, "").to_pylist()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and where each row starts (one more entry: the end); null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no linear structure."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some documents: 64-bit hash, first byte and end byte of each, and each document's range of words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool, split: np.ndarray | None = None):
        """split: bytes at which a word is cut in two."""
        self.data, self.at = _LOWER[data] if lower else data, at
        word = ~_SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1] if split is None else ~word[:-1] | split[1:]
        inner = at[:-1][at[:-1] < len(data)]
        begins[inner] = word[inner]  # a word doesn't go on in the next document
        self.start = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:] | begins[1:]
        self.end = np.flatnonzero(ends) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(_BASE, len(data)), out=total[1:])
        back = powers(pow(_BASE, -1, 2**64), len(data) + 1)
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))
        self.doc = np.searchsorted(self.start, at)  # words of document i: doc[i] .. doc[i + 1]

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; entries whose n words leave their document mean nothing."""
        return grams(self.hash, n)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    return mix(out + np.uint64(n))


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


#: Cached functions that hold vocabularies in a Python worker.
CACHES: list = []


def drop_caches() -> None:
    """Frees what other tasks have left in this worker, and gives it back to the machine."""
    for cached in CACHES:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worded(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of successive pieces of a text column."""
    drop_caches()
    data, at = utf8(column)
    for i, j in chunks(at):
        yield i, j, Words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values in a row and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
