"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of bytes other than white space and ASCII punctuation, with A-Z in lower case.  Every GRAM-word
sequence of an item is a seed, however frequent, so whole copies of an item take nothing from its edited or partial
ones.  The item is aligned with the passage around each group of seeds, which holds every alignment through one of
them that scores LEAST; a passage with too few of the item's words for that score is left out before.

Items are read in blocks of at most BLOCK_BYTES of text (or one longer item) whose index every task holds;
each block costs one pass over the documents.  Null or empty texts and items leak nothing; items with fewer
than GRAM words are searched for as they are; null ids stay; repeated rows get the same result each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, chunks, drop_caches, grams, only, small_batches, table, unused, utf8

GRAM = 3
BLOCK_BYTES = 4 << 20
#: Pairs of a seed and an item that are grouped at a time; those of one document stay together.
PAIRS = 1 << 20
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: A leak scores at least so much of what a whole copy scores.
LEAST = 0.5
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    return Words(_PLAIN[data], at, lower=False)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, and the passage's words it covers (start, end)."""
    j = np.arange(len(passage) + 1)
    row, begin = np.zeros(len(j)), j.copy()
    best, span = 0.0, (0, 0)
    for w in item:
        diagonal = np.concatenate([[0.0], row[:-1] + np.where(passage == w, MATCH, MISMATCH)])
        up = row + GAP
        from_up = up > diagonal
        now = np.where(from_up, up, diagonal)
        start = np.where(from_up, begin, np.concatenate([[0], begin[:-1]]))
        fresh = now <= 0
        now[fresh], start[fresh] = 0, j[fresh]
        lifted = now - GAP * j  # a gap along the passage costs GAP a word
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, j, 0))
        row, begin = top + GAP * j, start[source]
        k = int(row.argmax())
        if row[k] > best:
            best, span = float(row[k]), (int(begin[k]), k)
    return best, *span


class Index:
    """The word sequences of some items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.words, hashes, item, place = [], [], [], [], []
        for name, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            w = words_of(data, np.array([0, len(data)])).hash
            if not len(w):
                continue
            g = grams(w, GRAM) if len(w) >= GRAM else grams(w, len(w))
            self.ids.append(name)
            self.words.append(w)
            hashes.append(g)
            item.append(np.full(len(g), len(self.ids) - 1))
            place.append(np.arange(len(g)))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        hashes, item, place = join(hashes, np.uint64), join(item, np.int64), join(place, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.kinds = np.unique(self.hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.kinds >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, document, hash) of each known sequence in some documents."""
        at, doc, got = [], [], []
        for n in self.sizes:
            g = words.grams(n)
            if not len(self.kinds):
                break
            k = np.flatnonzero(self.seen[(g >> np.uint64(44)).astype(np.int64)])
            k = k[self.kinds[np.minimum(np.searchsorted(self.kinds, g[k]), len(self.kinds) - 1)] == g[k]]
            d = np.searchsorted(words.doc, k, "right") - 1
            inside = k + n <= words.doc[d + 1] if len(k) else np.empty(0, bool)
            at.append(k[inside])
            doc.append(d[inside])
            got.append(g[k[inside]])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(at), np.concatenate(doc), np.concatenate(got)

    def leaks(self, words: Words, least: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, score, first word, words) of each leak."""
        at, doc, got = self.hits(words)
        order = np.argsort(doc, kind="stable")
        at, doc, got = at[order], doc[order], got[order]
        left = np.searchsorted(self.hashes, got, "left")
        many = np.searchsorted(self.hashes, got, "right") - left
        total, i = np.cumsum(many), 0
        while i < len(doc):
            j = int(np.searchsorted(total, total[i] - many[i] + PAIRS, "right"))
            if j < len(doc):
                j = int(np.searchsorted(doc, doc[j], "left"))
            j = max(j, int(np.searchsorted(doc, doc[i], "right")))
            yield from self._aligned(words, least, at[i:j], doc[i:j], left[i:j], many[i:j])
            i = j

    def _aligned(self, words: Words, least: float, at: np.ndarray, doc: np.ndarray, left: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """leaks() from the seeds of some documents: word, document, first entry of the index, entries."""
        entry = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, doc = np.repeat(at, many), np.repeat(doc, many)
        item, diagonal = self.item[entry], at - self.place[entry]
        order = np.lexsort((diagonal, item, doc))
        item, diagonal, doc = item[order], diagonal[order], doc[order]
        length = np.array([len(w) for w in self.words], np.int64)[item] if len(item) else item
        new = np.ones(len(item), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > length[1:] // 2)
        starts = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(item)]):
            d, i, n = int(doc[a]), int(item[a]), int(length[a])
            lo, hi = int(words.doc[d]), int(words.doc[d + 1])
            shift = max(0, math.ceil((MATCH - least) * n / -GAP))  # the gaps that a leak's score leaves room for
            p = max(lo, int(diagonal[a]) - shift)
            passage = words.hash[p : min(hi, int(diagonal[z - 1]) + n + shift)]
            if np.isin(self.words[i], passage).sum() / n < least:  # no score exceeds the item's words that the passage holds
                continue
            score, s, e = align(self.words[i], passage)
            score /= MATCH * n
            if score >= least and score > best.get((d, i), (0,))[0]:
                best[d, i] = (score, p - lo + s, e - s)
        for (d, i), (score, s, n) in best.items():
            yield d, i, score, s, n


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in items.where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def mark(docs: DataFrame, items: DataFrame, least: float = LEAST, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of docs, then leaks (underscores go in front where docs has such a column): item_id, score, start and
    words (in words of this module) of each leaked item."""
    from pyspark.sql import types as T

    items = only(items, item_id=item_id_col, text=item_text_col)
    kind = f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},score:double,start:int,words:int>>"
    name = unused(docs.columns, "leaks")
    docs = small_batches(docs).withColumn(name, F.array().cast(kind))
    schema = docs.schema
    for block in _item_blocks(items):
        index = Index(block)
        if not index.ids:
            continue

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            drop_caches()
            for b in batches:
                data, at = utf8(b.column(text_col))
                found: dict[int, list[dict]] = {}
                for i, j in chunks(at):
                    for d, k, score, s, n in index.leaks(words_of(data[at[i] : at[j]], at[i : j + 1] - at[i]), least):
                        found.setdefault(i + d, []).append({"item_id": index.ids[k], "score": score, "start": s, "words": n})
                column = b.schema.get_field_index(name)
                old = b.column(column)
                if found:
                    merged = [old[k].as_py() + found[k] if k in found else old[k] for k in range(len(old))] if any(old.value_lengths().to_pylist()) else [found.get(k, []) for k in range(len(old))]
                    b = b.set_column(column, b.schema.field(column), pa.array([x if isinstance(x, list) else x.as_py() for x in merged], old.type))
                yield b

        docs = docs.mapInArrow(run, schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", F.round("leak.score", 6).alias("score"), "leak.start", "leak.words")
