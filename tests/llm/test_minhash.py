import random

import numpy as np
import pytest

from fernlode.llm import minhash
from fernlode.llm.components import connected_components
from fernlode.llm.minhash import drop_near_duplicates, near_duplicates, superminhash


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, similarity):
    sets = {i: shingles(text, k) for i, text in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(docs_of, corpus, k):
    got = near_duplicates(docs_of(corpus), k=k).collect()
    assert {tuple(r) for r in got if r.doc_id is not None} == brute(corpus, k, 80)
    assert len(got) == len(corpus) and [r.kept for r in got if r.doc_id is None] == [True]


def test_chains_of_copies(docs_of):
    """Each text is near its neighbours only, so stars around the smallest leave components to join."""
    rng = random.Random(9)
    words, rows = [f"w{rng.randrange(10**6)}" for _ in range(60)], []
    for step in range(40):
        words = words[2:] + [f"w{rng.randrange(10**6)}" for _ in range(2)]
        rows += [(step * 7 % 40 * 10 + t, " ".join(words[: 60 - t])) for t in range(3)]
    assert {tuple(r) for r in near_duplicates(docs_of(rows), k=2).collect()} == brute(rows, 2, 80)


def test_without_broadcasts(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in near_duplicates(docs_of(corpus), k=2).collect() if r.doc_id is not None} == brute(corpus, 2, 80)


def test_empty_and_drop(docs_of, corpus):
    assert near_duplicates(docs_of([])).count() == 0
    kept = {r.doc_id for r in drop_near_duplicates(docs_of(corpus)).collect()}
    assert kept - {None} == {i for i, _, _, keep in brute(corpus, 5, 80) if keep}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    h = superminhash([words[:2000], words[500:2500], words[:40]], 288)
    assert abs((h[0] == h[1]).mean() - 1500 / 2500) < 0.1
    one = superminhash([words[:1]], 288)
    assert len(set((one[0] >> np.uint64(32)).tolist())) == 288  # a single element fills the slots in a permutation


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    links = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(links.limit(0)).count() == 0


def test_very_long_texts(docs_of):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(5, " ".join(words)), (2, " ".join(words[3000:])), (9, " ".join(rng.sample(words, 60_000)))]
    assert {(r.doc_id, r.component_id) for r in near_duplicates(docs_of(rows), k=2).collect()} == {(5, 2), (2, 2), (9, 9)}


def components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def repeated_ids(corpus):
    base = dict(corpus[:25])
    near = base[4].split()
    near[3] = "other"
    return corpus + [(5, base[3]), (5, "a text of its own " + base[20]), (8, base[9]), (8, base[8]), (2, ""), (700, base[11]), (700, " ".join(near)), (700, base[12] + " more"), (701, "alone one two three four"), (701, "alone five six seven eight nine"), (-4, base[14]), (-4, base[15] + " x")]


@pytest.mark.parametrize("bound", [400_000, 0])
def test_ids_with_several_texts(docs_of, corpus, monkeypatch, bound):
    """A document that has several texts is one node of the report; the drop goes by texts."""
    monkeypatch.setattr(minhash, "BROADCAST_IDS", bound)
    rows = repeated_ids(corpus)
    texts = [(n, i, shingles(t, 2)) for n, (i, t) in enumerate(rows) if i is not None]
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    by_id = {}
    for _, i, own in texts:
        by_id.setdefault(i, []).append(own)
    want = components(sorted(by_id), lambda x, y: any(near(a, b) for a in by_id[x] for b in by_id[y]))
    got = [tuple(r) for r in near_duplicates(docs_of(rows), k=2).collect() if r.doc_id is not None]
    assert sorted(got) == sorted((i, len(own), want[i], want[i] == i) for _, i, own in texts)
    numbered = {n: (i, own) for n, i, own in texts}
    groups = components(sorted(numbered), lambda x, y: near(numbered[x][1], numbered[y][1]))
    stay = {}
    for n, g in groups.items():
        stay[g] = min(stay.get(g, numbered[n][0]), numbered[n][0])
    kept = {(i, rows[n][1] or "") for n, (i, own) in numbered.items() if i == stay[groups[n]]}
    drop = {(r.doc_id, r.text or "") for r in drop_near_duplicates(docs_of(rows), k=2).collect() if r.doc_id is not None}
    assert drop <= kept
    # No text is lost: each group keeps a text, all of one document, and everything else of the group goes.
    assert {groups[n] for n, (i, own) in numbered.items() if (i, rows[n][1] or "") in drop} == set(groups.values())


def test_words_of_a_known_collision(docs_of):
    """Thue-Morse words collide under every polynomial hash modulo a power of two."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, other = ("".join("ab"[b] for b in x) for x in (bits, [1 - b for b in bits]))
    rows = [(1, one), (2, other), (3, one[:1024]), (4, other[:1024]), (5, f"x {one} y"), (6, f"x {other} y"), (7, one.upper())]
    assert {tuple(r) for r in near_duplicates(docs_of(rows), k=2).collect()} == brute(rows, 2, 80)


def test_word_hashes_against_plain_words():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abAB\u00e9") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 255, 256, 257, 600]))) for _ in range(rng.randrange(0, 30))) + rng.choice(["", " ", "\n\t"]) for _ in range(60)]
    from fernlode.llm.bytehash import text_chunks, word_hashes
    import pyarrow as pa

    seen = {}
    for row, data, offsets in text_chunks(pa.array(texts), 700):
        hashes, first = word_hashes(data, offsets)
        for k in range(len(offsets) - 1):
            words = texts[row + k].encode().lower().split()
            own = hashes[first[k] : first[k + 1]].tolist()
            assert len(own) == len(words)
            for w, h in zip(words, own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
