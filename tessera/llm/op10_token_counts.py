"""Token counts by heap-and-linked-list byte-pair merging.

Each piece of text becomes a linked list of symbols; the adjacent pair of lowest rank is popped from a heap
and merged again and again.  The count is the number of initial symbols minus the merges: no ids are made.

Null text counts as empty (0 tokens).  Repeated rows and null ids give a row each; further columns of the
input are left out.  Very long texts are read in pieces, and the counts of pieces are cached in each worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import CACHES, TOKEN_BYTES, chunks, only, table, utf8
from tessera.llm.tokens import CACHE_PIECES, PLAIN, distinct, tokenizer, vocabulary

LIMIT = 2048


def merges(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols allow, always the lowest rank first and the leftmost among equals."""
    n, done = len(symbols), 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] is None or rank.get((symbols[i], symbols[j])) != r:
            continue  # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = None
        done += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return done


class Counter:
    """Counts of pieces under a vocabulary that drops white space (its file's path)."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        apart = [self.tok.encode(x, add_special_tokens=False).ids for x in ("a", "b", "a b", " a\n\tb ")]
        if not apart[0] + apart[1] == apart[2] == apart[3]:
            raise ValueError(f"{path}: tokens of this vocabulary depend on white space")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.known = set(spec["model"]["vocab"])
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        special = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = re.compile(f"({'|'.join(special)})") if special else None
        # each byte as a printable character, by the rule of byte-level vocabularies
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(kept, kept)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        self.byte = {b: chr(c) for b, c in shown.items()}
        self.piece: dict[str, int] = {}

    def symbols(self, shown: str) -> int:
        """Tokens of one word, given as its bytes' characters."""
        parts = [x for x in (*shown[:-1], shown[-1] + self.suffix) if x in self.known]
        return len(parts) - merges(parts, self.rank) if len(parts) > 1 else len(parts)

    def any(self, text: str) -> int:
        """Tokens of any text without white space; the library normalises and splits it, special strings count one."""
        total = 0
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                total += 1
            elif part:
                shown = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))
                total += sum(self.symbols(x) for x, _ in shown)
        return total

    def look_up(self, pieces: list[str]) -> list[int]:
        have = self.piece
        if len(have) > CACHE_PIECES:
            have.clear()
        out = []
        for w in pieces:
            n = have.get(w)
            if n is None:
                n = have[w] = self.symbols("".join(map(self.byte.__getitem__, w.encode()))) if PLAIN.fullmatch(w) else self.any(w)
            out.append(n)
        return out

    def counts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        words, all_, inverse = distinct(data, at)
        sums = np.concatenate([[0], np.cumsum(np.array(self.look_up(words), np.int64)[inverse])])
        return np.diff(sums[all_.doc])


@cache
def counter(path: str) -> Counter:
    return Counter(path)


CACHES.append(counter)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; one pass, no shuffle."""
    rows = only(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            data, at = utf8(b.column("text"))
            n = [own.counts(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at, TOKEN_BYTES)]
            n = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())
