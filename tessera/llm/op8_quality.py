"""Quality classifier by compression.

Two zstandard dictionaries are trained, from good and from bad labelled text.  A text's score is a logistic
function of normalised differences of compressed sizes and of nothing else: what each dictionary saves over no
dictionary, as a share of the size without one, of the text's length, and of the length's root (so short and long
texts are calibrated alike).  Calibration weighs both classes by their shares among all labels that may be learnt.

The fit takes a bounded sample: of each class the FIT_ROWS labelled rows of lowest hash that have a document,
whatever their length.  The first FIT_DICTIONARY make the dictionaries, the rest calibrate.  Scoring reads every
whole text.

Null text counts as empty and gets the score of an empty text.  Null labels and labels of absent rows teach
nothing; without labels of both classes every score is the share of good labels (one half without any).
Repeated rows and null ids give a row each.  Labels, languages, sources and ids are no input of a score.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_caches, only, small_batches, strings, table, unused

FIT_ROWS, FIT_DICTIONARY = 2000, 800
DICTIONARY_BYTES, PIECE_BYTES, LEVEL = 1 << 16, 512, 3


def _dictionary(docs: list[bytes], seed: int) -> bytes:
    """From pieces of the documents, without lines that several of them share."""
    lines = Counter(line for d in docs for line in set(d.split(b"\n")))
    own = [b"\n".join(x for x in d.split(b"\n") if lines[x] == 1) for d in docs]
    pieces = [d[i : i + PIECE_BYTES] for d in own for i in range(0, len(d), PIECE_BYTES)]
    random.Random(seed).shuffle(pieces)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train from: its end serves as it is
        return b"".join(pieces)[-DICTIONARY_BYTES:]


class Model:
    """Dictionaries and calibration; score(texts) gives the probability of label 1."""

    def __init__(self, good: list[bytes], bad: list[bytes], share: float | None = None):
        """share: of good ones among all labels, where the samples' sizes don't tell it."""
        self.prior = share if share is not None else len(good) / (len(good) + len(bad)) if good or bad else 0.5
        self.weights = None
        if not good or not bad:
            return
        cut = [min(FIT_DICTIONARY, max(1, len(x) // 2)) for x in (good, bad)]
        self.dictionaries = [_dictionary(x[:k], i) for i, (x, k) in enumerate(zip((good, bad), cut))]
        rest = [x[k:] or x for x, k in zip((good, bad), cut)]
        x = self.features([*rest[0], *rest[1]])
        y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
        weight = np.where(y == 1, self.prior / y.mean(), (1 - self.prior) / (1 - y.mean()))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        ridge = np.array([1e-2] * (len(w) - 1) + [1e-6])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        self.weights = w

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "zips"}

    def features(self, texts: list[bytes]) -> np.ndarray:
        if "zips" not in self.__dict__:
            self.zips = []
            for raw in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.zips.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
            self.zips.append(zstandard.ZstdCompressor(level=1, write_content_size=False))
        sizes = np.array([[len(z.compress(t)) for z in self.zips] for t in texts], float).reshape(-1, 3)
        good, bad, none = sizes.T
        n = np.array([len(t) for t in texts], float) + 16
        return np.stack([(none - own) / by for own in (good, bad) for by in (none, n, np.sqrt(n))], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        z = np.c_[(self.features(texts) - self.mean) / self.scale, np.ones(len(texts))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labels whose crc32(id as text) modulo held_out[0] is not held_out[1]."""
    known = only(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out[0] != held_out[1])
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = only(docs, doc_id=id_col, text=text_col)
    known = known.join(rows.select("doc_id"), "doc_id", "left_semi")
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = (F.xxhash64(F.lit(8), "doc_id"), F.col("doc_id"))
    found = []
    for label in (1, 0):
        ids = known.where(F.col("label") == label).orderBy(*order).limit(FIT_ROWS).select("doc_id")
        sample = rows.join(F.broadcast(ids), "doc_id").orderBy(*order, F.xxhash64("text")).limit(FIT_ROWS)  # ids may recur
        found.append([(r.text or "").encode() for r in sample.select("text").collect()])
    return Model(*found, share=n.get(1, 0) / sum(n.values()) if n else None)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs, then the score under the name (with underscores in front where docs has it); no shuffle."""
    from pyspark.sql import types as T

    docs, name = small_batches(docs), unused(docs.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for b in batches:
            s = model.score([t.encode() for t in strings(b.column(text_col))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
