import random
import re
import zlib
from collections import Counter

from fernlode.llm import spelling
from fernlode.llm.spelling import near_pairs, spelling_variants


def words_of(rows, minimum=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= minimum}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(rows, minimum=5):
    counts = words_of(rows, minimum)
    out, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [n, len(others)]
    rows_out = set()
    for w, (n, k) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows_out.add((w, form[w], root, n, k, counts[form[w]] if form[w] else None))
    return rows_out


def variants(rng, word):
    at, c = rng.randrange(len(word)), rng.choice("aeinrstÀéß÷")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :], word[:at] + word[at : at + 2][::-1] + word[at + 2 :]])


def made(seed=3, bases=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinrstÀéß") for _ in range(rng.randrange(5, 12))) for _ in range(bases)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdef", "fedcba", "Straße", "Garçonné"]
    pool = []
    for w in words:
        pool += [w] * rng.choice([5, 30, 200])
        for _ in range(4):
            v = variants(rng, w)
            pool += [v] * rng.choice([1, 5, 6, 25])
            pool += [variants(rng, v)] * rng.choice([4, 5])
    rng.shuffle(pool)
    pool = [w.upper() if w.isascii() and rng.random() < 0.2 else w for w in pool]
    joins = [" ", ", ", "\n", "1", "日", "¿", "_"]
    return [(k, "".join(w + rng.choice(joins) for w in pool[k * 20 : k * 20 + 20])) for k in range(len(pool) // 20 + 1)]


def test_against_brute_force(docs_of):
    rows = made() + [(None, "Straße Straße nullid"), (3, "repeated id Straße"), (3, "repeated id Straße"), (900, None), (901, ""), (902, "x" * 5000 + " short a bb")]
    got = {tuple(r) for r in spelling_variants(docs_of(rows)).collect()}
    assert got == brute(rows) and any(f for _, f, *_ in got) and any(r not in (f, w) for w, f, r, *_ in got if f)


def test_without_broadcast_and_small_flushes(docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(spelling, "FLUSH_WORDS", 10)
    rows = made(8, 20)
    assert {tuple(r) for r in spelling_variants(docs_of(rows)).collect()} == brute(rows)


def test_empty_and_very_long(docs_of):
    assert spelling_variants(docs_of([])).count() == 0
    rows = [(k, "long" * 20_000 + " " + "wordly " * 50_000 + "x" * (k == 3)) for k in range(6)]
    assert {tuple(r) for r in spelling_variants(docs_of(rows)).collect()} == brute(rows)


def test_pairs_are_found_once_and_all(spark):
    """Short alphabets make many words with the same letters; every pair comes once in each direction."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([6, 7, 8]))) for _ in range(500)})
    got = Counter((r.word, r.other) for r in near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long").repartition(3)).collect())
    assert set(got.values()) == {1} and set(got) == {(a, b) for a in words for b in words if near(a, b)}
