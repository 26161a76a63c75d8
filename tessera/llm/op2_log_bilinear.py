"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are words (A-Z in lower case) and one end for each document.  The HEAD most frequent words, the end and
CLASSES classes of all other words (by their last bytes) are the model's first choice; within each class the
SLOTS - 1 most frequent words and one slot for all its further words are the second.  So some eight thousand
words have vectors of their own, as contexts and as targets.  A context is the sum of the last ORDER symbols'
vectors, each scaled by its distance's diagonal; matrix products with the output vectors of the first choice and of
the token's class, plus biases, give normalised log-probabilities.  A further word of a class has the probability
(c + 0.5) / (their sum of c + 0.5, and 0.5 for unseen words) within its slot, so the whole is normalised.

Counts cover every training token: each task adds up its own, Spark sums them.  Training runs over all
partitions: in each of ROUNDS rounds every task starts from the last round's parameters, takes one position in
ROUNDS of its documents (another one each round, so each position is a target once) and returns its parameters,
whose mean by tokens goes on.  Means are taken in groups of AVERAGED, group upon group, so that no task and not the
driver holds more.

Counts of the words above a threshold that leaves KNOWN_WORDS at most go to each task; all other words' counts
are joined by a shuffle.  A null text counts as empty: its only token is the end.  Null ids count as the text ''
in crc32; repeated rows get a row each.  Without training rows every word is unseen and the model uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import TOKEN_BYTES, Scratch, Words, chunks, mix, only, signed, small_batches, table, utf8

HEAD, CLASSES, SLOTS, ORDER, WIDTH = 31, 64, 128, 3, 16
KNOWN_WORDS = 1 << 18
ROUNDS, RUN, RUNS, NOISE, SLOT_NOISE, RATE = 1, 64, 32, 16, 1, 0.1
#: Places that are trained on in a random order together.
TOGETHER = 1 << 17
#: Counts that a task holds before it passes them on; parameters that one task averages.
HELD, AVERAGED = 1_000_000, 16


def classes_of(words: Words) -> np.ndarray:
    """A class for each word by its last three bytes."""
    end, size = words.end, words.end - words.start
    key = words.data[end - 1].astype(np.uint64)
    for k in (2, 3):
        key = key * np.uint64(257) + np.where(size >= k, words.data[np.maximum(end - k, 0)], 0).astype(np.uint64)
    return (mix(key) % np.uint64(CLASSES)).astype(np.int16)


def _counts(docs: DataFrame) -> DataFrame:
    """hash, class, count of each word; partial sums by task, then one sum for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, first, inverse = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            return h, np.concatenate([x[1] for x in held])[first], np.bincount(inverse, np.concatenate([x[2] for x in held]), len(h)).astype(np.int64)

        def out(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(x[0])), pa.array(x[1]), pa.array(x[2])], ["hash", "class", "n"])

        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in chunks(at, TOKEN_BYTES):
                words = Words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower=True)
                h, first, count = np.unique(words.hash, return_index=True, return_counts=True)
                held.append((h, classes_of(words)[first], count))
            if sum(len(x[0]) for x in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD:
                    yield out(held.pop())
        if held:
            yield out(merged())

    return docs.mapInArrow(run, "hash long, class short, n long").groupBy("hash", "class").agg(F.sum("n").alias("n"))


def _step(p: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """An adaptive step on some rows of a parameter; a row that occurs often gets its sum."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rows, g = sorted_[first], np.add.reduceat(gradient[order], first, axis=0)
    s = squares[rows] + g * g
    squares[rows] = s
    p[rows] -= RATE * g / np.sqrt(s)


class Model:
    """What scoring needs: the known words' counts and symbols, each class's sum, and the parameters.

    Symbols: the frequent words, the end (number head), then SLOTS for each class, the last of them for all further
    words of the class.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, class_sums: np.ndarray, ends: int, n: int, v: int):
        self.n, self.v, self.ends = n, v, ends
        order = np.lexsort((hashes, -counts))
        top, rest = order[:HEAD], order[HEAD:]
        self.head = len(top)
        symbol = np.empty(len(hashes), np.int16)
        symbol[top] = np.arange(len(top))
        by_class = rest[np.argsort(classes[rest], kind="stable")]
        kind = classes[by_class]
        place = np.arange(len(kind)) - np.searchsorted(kind, kind)
        slot = np.minimum(place, SLOTS - 1)
        symbol[by_class] = self.head + 1 + kind * SLOTS + slot
        order = np.argsort(hashes)
        self.hashes, self.counts, self.symbol = hashes[order], counts[order], symbol[order]
        further = class_sums.astype(float)
        np.subtract.at(further, classes[top], counts[top] + 0.5)
        own, slot, kind = by_class[place < SLOTS - 1], slot[place < SLOTS - 1], kind[place < SLOTS - 1]
        np.subtract.at(further, kind, counts[own] + 0.5)
        self.class_log = np.log10(further + 0.5)
        within = np.zeros((CLASSES, SLOTS))
        within[kind, slot] = counts[own] + 0.5
        within[:, -1] = further + 0.5
        self.first, self.size = self.head + 1 + CLASSES, self.head + 1 + CLASSES * SLOTS
        # frequencies, for the biases and as the noise
        unigram = np.concatenate([counts[top] + 0.5, [ends + 0.5], within.sum(1)])
        self.noise = unigram / unigram.sum()
        within = (within / within.sum(1)[:, None]).ravel()
        self.slot_log = np.log(np.maximum(within, 1e-30)).astype(np.float32)
        self.slot_ends = np.cumsum(within.reshape(CLASSES, SLOTS), 1) + np.arange(CLASSES)[:, None]
        self.slot_ends[:, -1] = np.arange(1, CLASSES + 1)
        self.slot_ends = self.slot_ends.ravel()
        rng = np.random.default_rng(2)
        self.parameters = {
            "r": rng.normal(0, 0.1, (self.size + 1, WIDTH)).astype(np.float32),
            "c": np.ones((ORDER, WIDTH), np.float32) / ORDER,
            "q": rng.normal(0, 0.1, (self.first, WIDTH)).astype(np.float32),
            "b": np.log(self.noise).astype(np.float32),
            "slot_q": rng.normal(0, 0.1, (CLASSES * SLOTS, WIDTH)).astype(np.float32),
            "slot_b": self.slot_log.copy(),
        }

    def choices(self, symbols: np.ndarray) -> np.ndarray:
        """The first choice of each symbol."""
        return np.where(symbols > self.head, self.head + 1 + (symbols - self.head - 1) // SLOTS, symbols)

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of some documents' tokens in a row, where each document starts, each word's count (-1: not known), class."""
        n_docs = len(words.doc) - 1
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
            known = self.hashes[k] == words.hash
        else:
            k, known = np.zeros(len(words.hash), np.int64), np.zeros(len(words.hash), bool)
        kind = classes_of(words)
        count = np.full(len(k), -1, np.int64)
        count[known] = self.counts[k[known]]
        own = kind * np.int16(SLOTS) + np.int16(self.head + SLOTS)
        own[known] = self.symbol[k[known]]
        out = np.empty(len(k) + n_docs, np.int16)
        of = np.repeat(np.arange(n_docs), np.diff(words.doc))
        out[np.arange(len(k)) + of] = own
        out[words.doc[1:] + np.arange(n_docs)] = self.head
        return out, words.doc + np.arange(n_docs + 1), count, kind

    def contexts(self, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The ORDER symbols before each, nearest first; self.size where there is none."""
        place = np.arange(len(symbols)) - np.repeat(begin[:-1], np.diff(begin))
        out = np.full((ORDER, len(symbols)), self.size, np.int16)
        for d in range(1, ORDER + 1):
            out[d - 1, d:] = np.where(place[d:] >= d, symbols[:-d], self.size)
        return out

    def log10(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each symbol in its context."""
        p = self.parameters
        scaled = [p["r"] * c for c in p["c"]]
        context = np.ones((len(symbols), WIDTH + 1), np.float32)  # the last column takes the biases
        for i in range(0, len(symbols), 8192):
            context[i : i + 8192, :-1] = sum(s[h] for s, h in zip(scaled, before[:, i : i + 8192]))
        first, out = self.choices(symbols), np.empty(len(symbols), np.float32)

        def logs(context: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
            z = context @ q
            if z.max() > 80:  # beyond what an exponential holds
                z -= z.max(1)[:, None]
            picked = z[np.arange(len(z)), own]
            np.exp(z, out=z)
            return picked - np.log(z @ np.ones(z.shape[1], np.float32))

        q = np.concatenate([p["q"].T, p["b"][None]])
        for i in range(0, len(symbols), 2048):
            out[i : i + 2048] = logs(context[i : i + 2048], q, first[i : i + 2048])
        order = np.argsort(first, kind="stable")
        ends = np.searchsorted(first[order], np.arange(self.head + 1, self.first + 1))
        slots = symbols - np.int16(self.head + 1)
        for c in range(CLASSES):
            mine = slice(c * SLOTS, (c + 1) * SLOTS)
            q = np.concatenate([p["slot_q"][mine].T, p["slot_b"][None, mine]])
            for i in range(ends[c], ends[c + 1], 4096):
                k = order[i : min(i + 4096, ends[c + 1])]
                out[k] += logs(context[k], q, slots[k] - c * SLOTS)
        return out / np.float32(np.log(10))

    def stream(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents' symbols in a row with ORDER times self.size before each, and where each symbol went."""
        at = np.arange(len(symbols)) + ORDER * (1 + np.repeat(np.arange(len(begin) - 1), np.diff(begin)))
        out = np.full(len(symbols) + ORDER * (len(begin) - 1), self.size, np.int16)
        out[at] = symbols
        return out, at

    def train(self, stream: np.ndarray, targets: np.ndarray, rng: np.random.Generator, squares: dict[str, np.ndarray]) -> None:
        """One pass of noise-contrastive steps with adaptive rates over the targets (marked places) of a stream.

        A step takes RUNS runs of RUN places from anywhere, so that a place's vector is read and changed once for all
        contexts that hold it.  The first choice's noise is shared by a step, each target's slot has noise from its
        own class.
        """
        p = self.parameters
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        slot_noise = self.slot_log + np.float32(np.log(SLOT_NOISE))
        runs = -(-(len(stream) - ORDER) // RUN)
        stream = np.concatenate([stream, np.full(ORDER + runs * RUN - len(stream), self.size, np.int16)])
        marked = np.zeros(len(stream), bool)
        marked[: len(targets)] = targets
        first = self.choices(stream)
        order = rng.permutation(runs)
        eye = np.eye(self.first, dtype=np.float32)
        noise = rng.choice(self.first, (runs // RUNS + 1, NOISE), p=self.noise)
        for i in range(0, runs, RUNS):
            places = order[i : i + RUNS, None] * RUN + np.arange(RUN + ORDER)
            held = stream[places]
            vectors = p["r"][held]
            shifts = [vectors[:, ORDER - d : ORDER - d + RUN] for d in range(1, ORDER + 1)]
            k = np.flatnonzero(marked[places[:, ORDER:]])
            if not len(k):
                continue
            context = sum(v * c for v, c in zip(shifts, p["c"])).reshape(-1, WIDTH)[k]
            own_places = places[:, ORDER:].ravel()[k]
            w, share = first[own_places], np.float32(1 / len(k))
            fake = noise[i // RUNS]
            own, other = p["q"][w], p["q"][fake]
            good = (1 / (1 + np.exp(-(np.einsum("kw,kw->k", context, own) + (p["b"] - log_noise)[w]))) - 1) * share
            bad = context @ other.T
            bad += (p["b"] - log_noise)[fake]
            np.exp(-bad, out=bad)
            bad = share / (1 + bad)
            to_context = good[:, None] * own + bad @ other
            # slots of the targets' classes: each one's own and some noise
            at = np.flatnonzero(w > self.head)
            if len(at):
                kind = w[at] - (self.head + 1)
                slot = np.empty((SLOT_NOISE + 1, len(at)), np.int16)
                slot[0] = stream[own_places[at]] - (self.head + 1)
                slot[1:] = np.searchsorted(self.slot_ends, kind + rng.random((SLOT_NOISE, len(at))), "right")
                q, c = p["slot_q"][slot], context[at]
                off = 1 / (1 + np.exp(-(np.einsum("skw,kw->sk", q, c) + (p["slot_b"] - slot_noise)[slot])))
                off[0] -= 1
                off *= share
                to_context[at] += np.einsum("sk,skw->kw", off, q)
                both = np.empty((*slot.shape, WIDTH + 1), np.float32)
                np.multiply(off[:, :, None], c, out=both[:, :, :-1])
                both[:, :, -1] = off
                self._slots(slot.ravel(), both.reshape(-1, WIDTH + 1), squares)
            back = np.zeros((len(places) * RUN, WIDTH), np.float32)
            back[k] = to_context
            back = back.reshape(len(places), RUN, WIDTH)
            to_vectors = np.zeros_like(vectors)
            for d, c in enumerate(p["c"], 1):
                to_vectors[:, ORDER - d : ORDER - d + RUN] += back * c
            ones, fakes = eye[w], eye[fake]
            dense = {"q": ones.T @ (good[:, None] * context) + fakes.T @ (bad.T @ context), "b": ones.T @ good + fakes.T @ bad.sum(0), "c": np.stack([np.einsum("rpw,rpw->w", v, back) for v in shifts])}
            _step(p["r"], squares["r"], held.ravel(), to_vectors.reshape(-1, WIDTH))
            for name, g in dense.items():
                squares[name] += g * g
                p[name] -= RATE * g / np.sqrt(squares[name])

    def _slots(self, rows: np.ndarray, gradient: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """_step on slot_q and slot_b together: their rows are the same."""
        order = np.argsort(rows, kind="stable")
        sorted_ = rows[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        rows, g = sorted_[first], np.add.reduceat(gradient[order], first, axis=0)
        for name, part in (("slot_q", g[:, :-1]), ("slot_b", g[:, -1])):
            s = squares[name][rows] + part * part
            squares[name][rows] = s
            self.parameters[name][rows] -= RATE * part / np.sqrt(s)

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.parameters.values()]).astype("<f4").tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for name, x in self.parameters.items():
            self.parameters[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size


def _trained(docs: DataFrame, model: Model, turn: int, scratch: Scratch) -> tuple[int, np.ndarray | None]:
    """Positions trained on, and the mean of the parameters that the tasks reach, by positions; averaged group upon group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([turn, part := TaskContext.get().partitionId()])
        squares, seen, rest = {k: np.full_like(x, 1e-6) for k, x in model.parameters.items()}, 0, []

        def train() -> int:
            stream, targets = (np.concatenate(x) for x in zip(*rest))
            rest.clear()
            model.train(stream, targets, rng, squares)
            return int(targets.sum())

        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in chunks(at):
                symbols, begin, _, _ = model.read(Words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower=True))
                stream, places = model.stream(symbols, begin)
                targets = np.zeros(len(stream), bool)
                targets[places] = mix(np.arange(len(symbols), dtype=np.uint64) + np.uint64(at[i])) % np.uint64(ROUNDS) == turn
                rest.append((stream, targets))
                if sum(len(x) for x, _ in rest) >= TOGETHER:
                    seen += train()
        if rest:
            seen += train()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([model.pack()], pa.binary())], ["part", "tokens", "parameters"])

    def average(t: pa.Table) -> pa.Table:
        weights = t.column("tokens").to_numpy()
        flat = np.stack([np.frombuffer(x, "<f4") for x in t.column("parameters").to_pylist()])
        mean = np.average(flat.astype(float), axis=0, weights=weights).astype("<f4").tobytes()
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // AVERAGED], pa.int32()), "tokens": pa.array([int(weights.sum())], pa.int64()), "parameters": pa.array([mean], pa.binary())})

    schema = "part int, tokens long, parameters binary"
    means, level = scratch.table(docs.mapInArrow(run, schema), f"trained{turn}"), 0
    while means.count() > AVERAGED:
        level += 1
        means = scratch.table(means.groupBy(F.floor(F.col("part") / AVERAGED)).applyInArrow(average, schema), f"trained{turn}_{level}")
    found = means.collect()
    if not found:
        return 0, None
    return sum(r.tokens for r in found), np.average(np.stack([np.frombuffer(r.parameters, "<f4") for r in found]), axis=0, weights=[r.tokens for r in found])


def fit(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """A model of all rows of docs (column text), and their words' counts (hash, class, n)."""
    counts = scratch.table(_counts(small_batches(docs)), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.count()
    # the least count of a known word, from a histogram of counts in eighths of powers of two
    level = F.floor(F.log2("n") * 8).cast("int")
    threshold, total = 1 << 62, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > KNOWN_WORDS:
            break
        threshold = r["level"]
    known = counts.where(level >= threshold).toArrow()
    sums = np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum(F.col("n") + 0.5).alias("s")).collect():
        sums[r["class"]] = r.s
    arrays = [known.column(c).to_numpy() for c in ("hash", "n", "class")]
    model = Model(arrays[0].astype(np.int64).view(np.uint64), arrays[1].astype(np.int64), arrays[2].astype(np.int64), sums, ends, n + ends, v + (ends > 0))
    for turn in range(ROUNDS):
        _, mean = _trained(docs, model, turn, scratch)
        if mean is not None:
            model.unpack(mean)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row."""
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            data, at = utf8(b.column("text"))
            parts = []
            for i, j in chunks(at):
                words = Words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower=True)
                symbols, begin, count, kinds = model.read(words)
                here = count >= 0
                logs = np.where(here, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                further = (symbols > model.head) & ((symbols - model.head) % SLOTS == 0)
                in_class = np.zeros(len(symbols))
                of = np.repeat(np.arange(j - i), np.diff(words.doc))
                place = np.arange(len(words.hash)) + of
                in_class[place] = np.where(further[place], logs - model.class_log[kinds], 0.0)
                token = model.log10(symbols, model.contexts(symbols, begin)).astype(float) + in_class
                sums = np.concatenate([[0.0], np.cumsum(token)])
                base = np.concatenate([[0.0], np.cumsum(logs)])
                known = np.concatenate([[0], np.cumsum(here)])
                parts.append((np.diff(begin), np.diff(known[words.doc]), np.diff(base[words.doc]) + np.log10(model.ends + 0.5), np.diff(sums[begin]), np.bincount(of[~here], minlength=j - i), signed(words.hash[~here])))
            if not parts:
                continue
            n, known, base, own, sizes, rest = (np.concatenate(x) for x in zip(*parts))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array((known + (model.ends > 0)).astype(np.int64)), pa.array(base), pa.array(own), pa.ListArray.from_arrays(offsets, pa.array(rest))], ["row", "doc_id", "n_tokens", "n_known", "base", "own", "rest"])
            row += len(n)

    scored = scratch.table(rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, own double, rest array<long>"), "scored")
    rest = scored.select("row", F.explode("rest").alias("hash")).join(counts.select("hash", "n"), "hash", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count("n").alias("found"))
    total = float(np.log10(model.n + 0.5 * (model.v + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rest").join(rest, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + logs - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("own") + logs).alias("score"))


def _remainder(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    docs = table(spark, sf_dir, "documents")
    model, counts = fit(docs.where(_remainder(F.col("doc_id")) != 1).select("text"), scratch)
    rows = score(docs, model, counts, scratch)
    return rows.withColumn("held_out", _remainder(F.col("doc_id")) == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
