import random

import pytest

DOCS = "doc_id long, text string, lang string, bucket int, rep long, length string, component string"
WORDS = "the of and ther ing wor dle sta ren qui est lor ipsa vel mun tar ost".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def docs_of(spark):
    """A documents table with further columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, 1, 2, "x", "y") for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture
def corpus():
    """Copies, near copies, shared passages, repeats inside a text, odd texts."""
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(25)]
    rows = list(enumerate(base))
    passage = sentence(rng, 30)
    for k in range(12):
        rows.append((100 + k, f"{sentence(rng, 10)}\n{passage}\n{sentence(rng, 10)}"))
    for k in range(20):
        words = base[k % 5].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + k, " ".join(words)))
    rows += [(300 + k, base[3]) for k in range(6)]
    rows += [(400, None), (401, ""), (402, "   "), (403, "één"), (404, "ab " * 400), (405, "x" * 5000), (406, "日本語" * 80), (407, "日本語" * 80), (None, base[0]), (3, base[3])]
    return rows
