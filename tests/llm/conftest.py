import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, hash long, score double, token string, label int, shard int, range long, leaks string, kept string"


def rows():
    """Nulls, empty and blank texts, repeats, copies, near copies, shared passages, odd characters, a long text."""
    rng = random.Random(5)
    words = [a + b for a in ("tor", "min", "Éla", "ßen", "que", "red", "lis") for b in ("an", "eth", "ung", "ción", "eau", "ing", "o")]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passage, base = say(60), say(200)
    texts = [None, "", "  \t\n ", "one", "one two three", base, base, base.upper(), say(100) + "\n" + passage + " " + say(80), passage, say(50) + " " + passage, "x" * 300, "the " * 120, "<|endoftext|> a<|startoftext|>b it's 12 á H̱a —, É! 中文", say(3000), "a\x1cb c d", "tail " + say(19), say(20)]
    for k in range(12):
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
        texts.append(" ".join(w))
    out = [(i * 3, t) for i, t in enumerate(texts)]
    out += [(None, "no id here " + passage), (None, None), (9, "one"), (9, "one")]
    return [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", None]), None, 7, 7, 0.5, "t", 1, 3, 4, "l", "k") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs():
    """(doc_id, text) with null texts as empty, as the driver sees them."""
    return [(r[0], r[1] or "") for r in rows()]
