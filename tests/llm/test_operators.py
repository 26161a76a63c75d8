"""The ten operators against brute force on a fixture of odd rows, and on a small table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, op1_packing, op2_log_bilinear, op3_token_files, op4_ngram_join, op5_winnowing, op6_substring_dedup, op7_decontamination, op8_quality, op9_shards, op10_token_counts
from tessera.llm.tokens import tokenizer, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def ids_of(t):
    return tokenizer(vocabulary()).encode(t, add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def bag(rows):
    return Counter(tuple(r) for r in rows)


# -- shared ---------------------------------------------------------------------------------------------------


def test_words_are_hashed_alike_wherever_they_stand():
    data = np.frombuffer(b"ab  cd\nABcd ab" + b"ab" + b"" + b" x", np.uint8)
    w = common.Words(data, np.array([0, 14, 16, 16, 18]), lower=True)
    assert [bytes(w.data[i:j]) for i, j in zip(w.start, w.end)] == [b"ab", b"cd", b"abcd", b"ab", b"ab", b"x"]
    assert w.doc.tolist() == [0, 4, 5, 5, 6]
    assert w.hash[0] == w.hash[3] == w.hash[4] and len(set(w.hash.tolist())) == 4


# -- 1 --------------------------------------------------------------------------------------------------------


def test_packing_by_many_tasks_without_ids(spark, monkeypatch):
    monkeypatch.setattr(op1_packing, "PIECES_A_TASK", 100)
    rows = op1_packing.pack_documents(spark.range(1000).selectExpr("cast(null as long) as doc_id", "'some words' as text"), vocabulary(), 64).collect()
    tasks = Counter(r.sequence_id >> 33 for r in rows)
    assert len(rows) == 1000 and len(tasks) == 10 and max(tasks.values()) < 200
    assert len({(r.sequence_id, r.offset) for r in rows}) == 1000


def test_best_fit_takes_the_fullest_bin_that_fits_and_closes_the_fullest():
    b = op1_packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = op1_packing.BestFit(10, 2)
    for n in (5, 6, 8):  # the third bin closes the one with 6
        b.place(n)
    assert b.open == 2 and sorted(k for k, v in b.bins.items() if v) == [2, 5]


def test_packing(docs, empty, pairs):
    rows = op1_packing.pack_documents(docs, vocabulary(), 64).collect()
    whole = defaultdict(list)
    for i, t in pairs:
        whole[i].append([*ids_of(t), 1])
    want = Counter()
    for i, all_ in whole.items():
        for ids in all_:
            want.update((i, k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(raw(ids[k * 64 : k * 64 + 64]))) for k in range(-(-len(ids) // 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    total = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= 1.05 * -(-total // 64) + 1
    assert op1_packing.pack_documents(empty, vocabulary()).count() == 0


# -- 2 --------------------------------------------------------------------------------------------------------


def test_language_model(spark, docs, empty, pairs):
    scratch = common.Scratch(spark, "test2")
    train = docs.where("doc_id % 2 = 0")
    model, counts = op2_log_bilinear.fit(train.select("text"), scratch)
    rows = op2_log_bilinear.score(docs, model, counts, scratch).collect()
    c = Counter()
    for i, t in pairs:
        if i is not None and i % 2 == 0:
            c.update([*WORD.findall(low(t)), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in pairs:
        w = [*WORD.findall(low(t)), None]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert op2_log_bilinear.score(empty, model, counts, scratch).count() == 0
    model, counts = op2_log_bilinear.fit(empty.select("text"), common.Scratch(spark, "test2e"))
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in op2_log_bilinear.score(docs, model, counts, scratch).collect())


def test_every_position_is_trained_on_once(spark, docs, pairs, monkeypatch):
    monkeypatch.setattr(op2_log_bilinear, "AVERAGED", 2)
    for rounds in (1, 3):
        monkeypatch.setattr(op2_log_bilinear, "ROUNDS", rounds)
        scratch = common.Scratch(spark, "test2p")
        model, _ = op2_log_bilinear.fit(docs.select("text"), scratch)
        trained = sum(op2_log_bilinear._trained(docs.select("text"), model, turn, scratch)[0] for turn in range(rounds))
        assert trained == model.n == sum(len(WORD.findall(t)) + 1 for _, t in pairs)


def test_model_probabilities_sum_to_one(spark, docs, monkeypatch):
    """Over all symbols, in many contexts; the further words of a class and an unseen one share their slot."""
    monkeypatch.setattr(op2_log_bilinear, "SLOTS", 3)
    model, counts = op2_log_bilinear.fit(docs.select("text"), common.Scratch(spark, "test2s"))
    symbols, rng = np.arange(model.size, dtype=np.int16), np.random.default_rng(1)
    for _ in range(25):
        before = np.repeat(rng.integers(0, model.size + 1, (op2_log_bilinear.ORDER, 1)).astype(np.int16), model.size, 1)
        assert abs((10 ** model.log10(symbols, before).astype(float)).sum() - 1) < 1e-4
    further = np.zeros(op2_log_bilinear.CLASSES)
    for r in counts.collect():
        k = np.flatnonzero(model.hashes == np.uint64(r.hash & (1 << 64) - 1))
        if model.symbol[k[0]] > model.head and (model.symbol[k[0]] - model.head) % 3 == 0:
            further[r["class"]] += (r.n + 0.5) / 10 ** model.class_log[r["class"]]
    assert np.allclose(further + 0.5 / 10**model.class_log, 1) and (further > 0.5).any()


def test_the_model_beats_counts_on_held_out_documents(spark, monkeypatch):
    """At scale 0.01 by 0.1 a token; nothing of it comes from counts alone, as without training the two are alike."""
    scratch = common.Scratch(spark, "test2h")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = op2_log_bilinear._remainder(F.col("doc_id"))
    train, held = table.where(rest != 1).select("text"), table.where(rest == 1)
    by = {}
    for rounds in (0, 1):
        monkeypatch.setattr(op2_log_bilinear, "ROUNDS", rounds)
        model, counts = op2_log_bilinear.fit(train, scratch)
        by[rounds] = op2_log_bilinear.score(held, model, counts, scratch).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert abs(by[0][0] - by[0][1]) < 0.02 and by[1][0] > by[1][1] + 0.1, by


# -- 3 --------------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, empty, pairs):
    scratch = common.Scratch(spark, "test3")
    for n, table in enumerate((docs, empty)):
        folder = scratch.path(f"ids{n}")
        manifest = scratch.table(op3_token_files.write_token_files(table, folder, vocabulary()), f"manifest{n}")
        rows = op3_token_files.read_token_files(manifest, folder).collect()
        if not n:
            rows.sort(key=lambda r: r.start)
            assert [r.doc_id for r in rows] == sorted((i for i, _ in pairs), key=lambda i: -1 if i is None else i)
            at = 0
            for r in rows:
                assert r.start == at
                at += r.n_tokens
            assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == bag((i, len(ids_of(t)) + 1, zlib.crc32(raw([*ids_of(t), 1]))) for i, t in pairs)
        else:
            assert not rows


def test_token_file_reads_any_range(tmp_path):
    import pyarrow.fs as pfs

    ids = np.random.default_rng(0).integers(0, 49408, 300_000).astype("<u4")
    fs = pfs.LocalFileSystem()
    writer = op3_token_files.Writer(fs.open_output_stream(str(tmp_path / "x")))
    writer.add([4, None, 9], ids[:200_000], np.array([0, 0, 70_000, 200_000]))
    writer.add([12], ids[200_000:], np.array([0, 100_000]))
    writer.close()
    writer.out.close()
    with fs.open_input_file(str(tmp_path / "x")) as f:
        reader = op3_token_files.Reader(f)
        assert [d[:3] for d in reader.documents()] == [(4, 0, 0), (None, 0, 70_000), (9, 70_000, 130_000), (12, 200_000, 100_000)]
        for a, b in ((0, 0), (0, 1), (65_535, 65_537), (100, 299_999), (0, 300_000)):
            assert (reader.ids(a, b) == ids[a:b]).all()
    fs.open_output_stream(str(tmp_path / "y")).close()
    with pytest.raises(Exception), fs.open_input_file(str(tmp_path / "y")) as f:
        op3_token_files.Reader(f)


# -- 4 --------------------------------------------------------------------------------------------------------


def shingles(t):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets, ids):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) if sets[i] else ids[i] for i in range(len(ids))]


def test_ngram_join(docs, empty, pairs):
    rows = op4_ngram_join.classes(docs).collect()
    sets = [shingles(t) for _, t in pairs]
    want = components(sets, [i for i, _ in pairs])
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in rows) == bag((i, len(s), c) for (i, _), s, c in zip(pairs, sets, want))
    assert op4_ngram_join.classes(empty).count() == 0


@pytest.mark.parametrize(("light", "hot"), [(1, 2000), (32, 2000), (32, 3)])
def test_ngram_join_of_large_groups(spark, monkeypatch, light, hot):
    """Groups of near copies beyond a block, chains at the threshold, a passage that all share; also with heavy shingles only."""
    monkeypatch.setattr(op4_ngram_join, "LIGHT", light)
    monkeypatch.setattr(op4_ngram_join, "BLOCK", 16)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, texts = say(30), []
    for _ in range(3):
        base = say(120)
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(w + (passage if rng.random() < 0.5 else []))
    texts += [say(60) + passage for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    ids = list(range(100, 100 + len(texts)))
    rows = op4_ngram_join.classes(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    want = dict(zip(ids, components([shingles(t) for t in texts], ids)))
    assert {r.doc_id: r.component_id for r in rows} == want


def test_ngram_join_keeps_ids_of_all_64_bits(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [((1 << 62) + 5, text), ((1 << 62) + 9, text), ((1 << 63) - 1, "other words that stand alone here"), (-(1 << 63), ""), (None, "a b c d e f g"), (None, "a b c d e f g"), (4, "x y"), (4, "p q r")]
    got = bag((r.doc_id, r.component_id) for r in op4_ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == bag([((1 << 62) + 5, (1 << 62) + 5), ((1 << 62) + 9, (1 << 62) + 5), ((1 << 63) - 1,) * 2, (-(1 << 63),) * 2, (None, None), (None, None), (4, 4), (4, 4)])


# -- 5 --------------------------------------------------------------------------------------------------------


def test_winnowing_entries_are_rightmost_minima(spark, docs, pairs):
    rows = op5_winnowing.fingerprints(docs).collect()
    assert len(rows) == len(pairs)
    by = defaultdict(set)
    for r, t in docs.select("doc_id", "text").join(op5_winnowing.fingerprints(docs), "doc_id").select("text", "fingerprint").collect():
        by[r or ""].add(t)
    texts = [t for i, t in pairs if i is not None and [j for j, _ in pairs].count(i) == 1]
    assert all(len(by[t]) == 1 for t in texts)
    # the winnowing rule on the hashes of all grams, taken from the same columns with windows of one
    df = docs.where("doc_id = 24").select("text")
    all_ = df.select(F.regexp_extract_all("text", F.lit(op5_winnowing.UNIT), F.lit(0)).alias("u")).select(F.transform("u", lambda u: F.xxhash64(u)).alias("h"))
    h = all_.first().h
    pair = lambda a, b: spark.createDataFrame(list(zip(a, b)), "a long, b long").coalesce(1).select(F.xxhash64("a", "b")).toPandas().iloc[:, 0].tolist()
    h2 = pair(h[:-1], h[1:])
    h4 = [x & 0xFFFFFFFF for x in pair(h2[:-2], h2[2:])]
    want = []
    for end in range(1, len(h4) + 1):
        window = [(x, -i) for i, x in enumerate(h4)][max(0, end - op5_winnowing.WINDOW) : end]
        x, i = min(window)
        if (x, -i) not in want:
            want.append((x, -i))
    shown = op5_winnowing.fingerprints(docs.where("doc_id = 24")).first().fingerprint
    assert shown == " ".join(f"{x:X}@{i}" for x, i in want)


def sets_of(fingerprint):
    return {e.split("@")[0] for e in fingerprint.split()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("ranges", "alike"), [(4, 10_000), (50_000, 1)])
def test_edited_neighbours(docs, empty, pairs, spark, monkeypatch, ranges, alike):
    monkeypatch.setattr(op5_winnowing, "table", lambda spark, folder, name: folder)
    monkeypatch.setattr(common, "RANGE_ROWS", ranges)
    monkeypatch.setattr(op5_winnowing, "ALIKE", alike)
    rows = op5_winnowing.query(spark, docs).collect()
    ties = {(r.doc_id, r.text or ""): r.tie for r in docs.select("doc_id", "text", common.row_key(F.col("doc_id"), F.col("text"))[1].alias("tie")).collect()}
    ordered = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, ties[p]))
    edited = []
    for k, (i, t) in enumerate(ordered):
        cut, after = len(t) // 4, ordered[(k + 1) % len(ordered)][1]
        edited.append(t[: len(t) - cut] + after[:cut])
    own = dict(enumerate(r.fingerprint for r in sorted(op5_winnowing.fingerprints(spark.createDataFrame(list(enumerate(t for _, t in ordered)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)))
    other = dict(enumerate(r.fingerprint for r in sorted(op5_winnowing.fingerprints(spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)))
    want = bag((i, len(t), hashlib.sha256(edited[k].encode()).hexdigest(), own[k], other[k], round(jaccard(sets_of(own[k]), sets_of(other[k])), 9), round(jaccard(sets_of(own[k]), sets_of(own[(k + 1) % len(ordered)])), 9)) for k, (i, t) in enumerate(ordered))
    assert bag((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == want
    assert op5_winnowing.query(spark, empty).count() == 0


def test_neighbours_of_many_rows_alike_and_an_odd_id(spark, monkeypatch):
    monkeypatch.setattr(op5_winnowing, "table", lambda spark, folder, name: folder)
    monkeypatch.setattr(common, "RANGE_ROWS", 50)
    monkeypatch.setattr(common, "BROADCAST_IDS", 3)
    ids = [*range(200), 1 << 61, *[77] * 300, *[None] * 40]
    rows = spark.createDataFrame([(i, f"text {i} of some words that differ by {n if i is None else i}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = op5_winnowing.query(spark, rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    assert sum(r.near_next == 1 for r in got if r.doc_id == 77) == 300


# -- 6 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1, 2000])
def test_repeats(docs, empty, pairs, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    one = docs.where("doc_id is null or doc_id <> 9").where("doc_id is not null or text is not null")
    rows = op6_substring_dedup.removed(one).collect()
    seen, want = set(), {}
    for i, t in sorted(((i, t) for i, t in pairs if i != 9 and (i is not None or t)), key=lambda p: -1 if p[0] is None else p[0]):
        w = t.encode().split()
        stays = [True] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                stays[s : s + 20] = [False] * 20
            seen.add(k)
        want[i] = (len(w), stays.count(False), b" ".join(x for x, y in zip(w, stays) if y).decode())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == want
    assert sum(r.n_removed > 0 for r in rows) > 10
    assert op6_substring_dedup.removed(docs).count() == len(pairs)
    assert op6_substring_dedup.removed(empty).count() == 0


def test_factors_follow_one_reference():
    found = [(4, 20, 1, 8), (3, 20, 1, 7), (5, 20, 1, 20), (12, 40, 1, 16), (13, 20, 2, 0), (60, 20, 1, 64)]
    assert op6_substring_dedup.factors(found) == [(3, 21, 1, 7), (5, 20, 1, 20), (12, 40, 1, 16), (60, 20, 1, 64)]


def test_passages_longer_than_a_block_are_found_by_blocks(spark, monkeypatch):
    """Windows are looked up at the boundaries of whole blocks only; without factors from blocks the middle would stay."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage = say(900)
    docs = spark.createDataFrame([(k, f"{say(50)} {passage} {say(50)}") for k in range(4)], "doc_id long, text string")
    asked = []
    own = op6_substring_dedup._windows
    monkeypatch.setattr(op6_substring_dedup, "_windows", lambda texts: asked.append(own(texts)) or asked[0])
    rows = {r.doc_id: r for r in op6_substring_dedup.removed(docs).collect()}
    assert [rows[k].n_removed for k in range(4)] == [0, 900, 900, 900]
    assert [[(f.start, f.words, f.ref_doc, f.ref_start) for f in rows[k].factors] for k in (1, 2, 3)] == [[(50, 900, 0, 50)]] * 3


def test_repeats_in_rows_of_one_id(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    a, b = say(40), say(90)
    rows = [(1, a), (5, b), (5, say(30) + " " + a + " " + say(5)), (None, say(25)), (None, say(30) + " " + b), (None, None), (-(1 << 63), say(22)), (7, b), (7, b)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in op6_substring_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 40, 0), (5, 90, 90), (5, 75, 40), (None, 25, 0), (None, 120, 0), (None, 0, 0), (-(1 << 63), 22, 0), (7, 90, 90), (7, 90, 90)])


# -- 7 --------------------------------------------------------------------------------------------------------


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(0, 25))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (op7_decontamination.MATCH if a[i - 1] == b[j - 1] else op7_decontamination.MISMATCH), h[i - 1, j] + op7_decontamination.GAP, h[i, j - 1] + op7_decontamination.GAP)
        score, start, end = op7_decontamination.align(a, b)
        assert score == h.max() and 0 <= start <= end <= len(b)


def test_leaks(spark, docs, empty, pairs):
    rng = random.Random(9)
    passage = pairs[9][1].split()
    edited = [w if rng.random() > 0.15 else "changed" for w in passage]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(f"z{i}" for i in range(30))), (3, None), (4, ""), (5, " ".join(edited)), (6, "one")], "item_id long, text string")
    found = op7_decontamination.mark(docs, items)
    assert found.count() == len(pairs) and "n_chars" in found.columns
    assert found.columns == [*docs.columns, "_leaks"]
    got = {(r.doc_id, x.item_id) for r in found.collect() for x in r._leaks}
    holds = {i for i, t in pairs if " ".join(passage) in t}
    assert {(i, k) for i in holds for k in (1, 5)} <= got
    assert {i for i, k in got if k == 6} == {i for i, t in pairs if re.search(r"(?i)(^|\s)one(\s|$)", t)}
    assert not any(k == 2 for _, k in got) and {i for i, k in got if k in (1, 5)} == holds
    assert op7_decontamination.mark(empty, items).count() == 0
    assert all(not r._leaks and r.leaks == "l" for r in op7_decontamination.mark(docs, items.limit(0)).collect())


@pytest.mark.parametrize("copies", [1, 3, 200])
def test_edited_and_partial_copies_beside_whole_ones(spark, copies):
    item = [f"w{i}" for i in range(45)]
    texts = {
        "edited": [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(item)],
        "first": item[:30], "later": item[15:], "apart": item[:22] + [f"y{i}" for i in range(40)] + item[22:], "less": item[:20],
    }
    rows = [(k, " ".join(["before", *w, "after"])) for k, w in texts.items()] + [(f"whole{i}", " ".join(item)) for i in range(copies)]
    found = op7_decontamination.mark(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    got = {r.doc_id: round(x.score, 6) for r in found.collect() for x in r.leaks}
    edited = op7_decontamination.align(np.arange(45), np.where(np.arange(45) % 5 == 4, -1, np.arange(45)))[0] / 45
    assert got == {"edited": round(edited, 6), "first": round(30 / 45, 6), "later": round(30 / 45, 6), "apart": round(25 / 45, 6)} | {f"whole{i}": 1.0 for i in range(copies)}


def test_recall_against_exhaustive_alignment(spark):
    """Every text against every item by the full alignment: edited copies at many rates, in long texts."""
    rng = random.Random(12)
    say = lambda n: [f"k{rng.randrange(400)}" for _ in range(n)]
    items = [say(rng.randrange(8, 60)) for _ in range(25)]
    texts = []
    for _ in range(150):
        w = list(rng.choice(items))
        for _ in range(rng.randrange(len(w) // 2 + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = say(rng.randrange(3))
        texts.append(say(rng.randrange(60)) + w + say(rng.randrange(60)))
    found = op7_decontamination.mark(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, x.item_id) for r in found.collect() for x in r.leaks}
    code = lambda t: np.array([int(w[1:]) for w in t])
    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if op7_decontamination.align(code(item), code(t))[0] >= op7_decontamination.LEAST * len(item)}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 80


def test_items_in_several_blocks(spark, docs, monkeypatch, pairs):
    monkeypatch.setattr(op7_decontamination, "BLOCK_BYTES", 1)
    items = spark.createDataFrame([(k, " ".join(pairs[k][1].split()[:30])) for k in (8, 9, 14)], "item_id long, text string")
    got = {x.item_id for r in op7_decontamination.mark(docs, items).collect() for x in r._leaks}
    assert got == {8, 9, 14}


# -- 8 --------------------------------------------------------------------------------------------------------


def test_quality(spark, folder, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = op8_quality.fit(table, labels)
    rows = op8_quality.score(table, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).select("score", "quality").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows)
    assert right > 0.9, right
    assert all(0 <= r._score <= 1 and r.score == 0.5 for r in op8_quality.score(docs, model).select("_score", "score").collect())
    assert op8_quality.score(empty, model).count() == 0
    none = op8_quality.fit(docs, labels.limit(0))
    assert {r._score for r in op8_quality.score(docs, none).collect()} == {0.5}
    same = op8_quality.fit(docs, spark.createDataFrame([(15, 1), (24, 1), (None, 0), (18, None)], "doc_id long, quality int"))
    assert {r._score for r in op8_quality.score(docs, same).collect()} == {1.0}


# -- 9 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows_a_bucket", [3, 1000])
def test_shards(spark, docs, empty, pairs, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(common, "RANGE_ROWS", rows_a_bucket)
    rows = op9_shards.shard(docs, 5).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in rows) == bag((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in pairs)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert op9_shards.shard(empty, 5).count() == 0


@pytest.mark.parametrize("source", ["'s' || id", "'one'", "null"])
def test_ranges_are_even(spark, monkeypatch, source):
    """A source a row, one source of all rows, rows alike in all: no range holds more than its share."""
    monkeypatch.setattr(common, "RANGE_ROWS", 100)
    table = spark.range(2000).selectExpr("case when id % 2 = 0 then id end as doc_id", "'t' as text", f"{source} as source")
    most, made = [], common.Scratch.table

    def look(self, df, name):
        df = made(self, df, name)
        if "_range" in df.columns:
            most.append(max(r["count"] for r in df.groupBy("_range").count().collect()))
        return df

    monkeypatch.setattr(common.Scratch, "table", look)
    rows = op9_shards.shard(table, 24).collect()
    assert len(most) == 2 and max(most) <= 400
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 2000 and max(sizes.values()) - min(sizes.values()) <= 1


def test_shards_hold_the_mixture(spark):
    table = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "case when id % 3 = 0 then 'hot' else 's' || id % 7 end as source")
    rows = op9_shards.shard(table, 24).join(table.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count().groupBy("source").agg(F.max("count") - F.min("count")).collect()
    assert max(r[1] for r in rows) <= 2


# -- 10 -------------------------------------------------------------------------------------------------------


def test_token_counts(docs, empty, pairs):
    rows = op10_token_counts.token_counts(docs, vocabulary(), 100).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == bag((i, len(t.encode()), len(ids_of(t)), len(ids_of(t)) > 100) for i, t in pairs)
    assert op10_token_counts.token_counts(empty, vocabulary()).count() == 0


def test_token_counts_of_random_characters():
    own, rng = op10_token_counts.Counter(vocabulary()), random.Random(2)
    chars = "abcXYZ 019.,'!<|>\n\téÉßµªº×÷中文字ΣİĞ̸̱́‍😀½²ﬁ\x1c  "
    for _ in range(400):
        t = "".join(rng.choice(chars) for _ in range(rng.randrange(60)))
        data = np.frombuffer(t.encode(), np.uint8)
        assert own.counts(data, np.array([0, len(data)])).tolist() == [len(ids_of(t))], t


# -- components -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("held", "hot"), [(10**6, 2000), (7, 2000), (7, 3), (1, 2000)])
def test_components(spark, monkeypatch, held, hot):
    from tessera.llm.graph import components as label

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(5, i) for i in range(200, 260)] + [(rng.randrange(300, 700), rng.randrange(300, 700)) for _ in range(250)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent) if find(x) != x}
    rows = label(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark, "graph"), "g", held).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert label(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "graph"), "g", held).count() == 0
