"""Columns of the registered queries against brute force, on a whole table with null, empty and very long texts."""

import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.llm.common import CHUNK_BYTES
from tessera.llm.queries import queries
from tessera.llm.tokens import tokenizer, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("contract"))
    rng = random.Random(3)
    long = " ".join(rng.choice(("river", "Éla", "stone", "wren's", "中文", "x")) + str(rng.randrange(5000)) for _ in range(190_000))
    assert len(long.encode()) > CHUNK_BYTES
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, long), (10_004, "of one kind"), (10_005, "of one kind")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0 AS n_chars")
    docs.unionByName(more.select(*(more[f.name].cast(f.dataType) for f in docs.schema))).repartition(5).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    coder = tokenizer(vocabulary())
    return {d: coder.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def of(spark, folder, name, *columns):
    return queries()[name](spark, folder).select(*columns).collect()


def test_packing(spark, folder, ids):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in of(spark, folder, "op1_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        pieces[r.doc_id].append(r[1:5])
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, got in pieces.items():
        whole = [*ids[d], 1]
        assert sorted(got) == [(i, s, len(whole[s : s + 4096]), crc(whole[s : s + 4096])) for i, s in enumerate(range(0, len(whole), 4096))]
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= math.ceil(1.05 * sum(len(x) + 1 for x in ids.values()) / 4096) + 2


def test_token_files(spark, folder, ids):
    want, start = [], 0
    for d in sorted(ids):
        want.append((d, start, len(ids[d]) + 1, crc([*ids[d], 1])))
        start += len(ids[d]) + 1
    assert sorted(map(tuple, of(spark, folder, "op3_token_files", "doc_id", "start", "n_tokens", "ids_crc32"))) == want


def test_token_counts(spark, folder, texts, ids):
    want = [(d, len(texts[d].encode()), len(ids[d]), len(ids[d]) > 2048) for d in sorted(ids)]
    assert sorted(map(tuple, of(spark, folder, "op10_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit"))) == want


def test_language_model(spark, folder, texts):
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {d: [*WORD.findall(t.translate(lower)), None] for d, t in texts.items()}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = of(spark, folder, "op2_log_bilinear", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_fingerprints(spark, folder, texts):
    order = sorted(texts)
    following = {d: texts[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    rows = {r.doc_id: r for r in of(spark, folder, "op5_winnowing", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    assert sorted(rows) == order
    alike = defaultdict(set)
    for d, t in texts.items():
        r, k = rows[d], len(t) // 4
        edited = t[: len(t) - k] + following[d][:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (edited != t or r.near_edited == 1)
        alike[t].add(r.fingerprint)
        alike[edited].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in alike.values())
    assert rows[10_004].near_next == 1  # the next text is the same


def test_quality(spark, folder, texts):
    rows = of(spark, folder, "op8_compression_quality", "doc_id", "held_out", "score", "predicted")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_shards(spark, folder, texts):
    rows = of(spark, folder, "op9_interleaved_shards", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in sorted(texts.items())]
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_repeats(spark, folder, texts):
    seen, want = set(), []
    for d in sorted(texts):
        words, gone = WORD.findall(texts[d]), set()
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, of(spark, folder, "op6_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256"))) == want


def test_components(spark, folder, texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in texts.items():
        words = WORD.findall(t.translate(lower))
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for x, y in combinations(sorted(sets), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((root(x), root(y)))
            least[b] = a
    want = [(d, len(sets[d]), root(d)) for d in sorted(sets)]
    assert sorted(map(tuple, of(spark, folder, "op4_ngram_jaccard", "doc_id", "n_shingles", "component_id"))) == want
