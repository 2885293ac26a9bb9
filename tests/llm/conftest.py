import random

import pytest

LONG = 3000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, window string, anchor long"


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "Ta"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with copies, near copies, shared passages, nulls, blanks, repeated rows and a long text."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(0, 120)) for _ in range(40)]
    passage = words(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i]) for i in range(10)]
    out += [(200 + i, f"{base[i + 10]} extra tail") for i in range(10)]
    out += [(300 + i, f"{words(rng, 15)} {passage} {words(rng, 15)}") for i in range(8)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "ONE two"), (405, "again " * 40), (406, words(rng, LONG)), (406, words(rng, 50)), (5, base[5]), (None, base[3]), (None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
