import random
import re

from fernlode.llm.licenses import BASE_PHRASES, DIAGONAL_GAP, K, MAX_STRETCH, MIN_COVERAGE, TEMPLATES, license_spans, scan_licenses

ROWS = [
    (1, "Released under the MIT License. And under the mit license"), (2, None), (3, ""), (4, "mit"), (5, "Apache License, Version 2.0; CC-BY-NC"), (6, "under the éмit license"),
    (7, "This program is free software; you can now redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    (8, "All rights reserved"), (9, "cc by nc " * 40), (10, "under the mit under the mit license"), (11, "... plain words here ..."), (12, "İ K under the MIT licenSe"), (None, "cc by nc"),
]


def words(text):
    low = (text or "").translate({65 + k: 97 + k for k in range(26)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_base_places_are_exact(docs_of):
    got = {r.doc_id: r for r in scan_licenses(docs_of(ROWS)).collect()}
    assert len(got) == len(ROWS)
    for i, text in ROWS:
        w = words(text)
        hits = [(a, label) for label, phrase in BASE_PHRASES for a in range(len(w)) if w[a : a + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(a for a, _ in hits), max(a for a, _ in hits)) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "gpl-3" in got[7].labels and got[8].labels == "all-rights-reserved" and got[11].labels == "" and got[11].score == 0


def test_spans_merge_neighbouring_diagonals(docs_of):
    r = license_spans(docs_of([ROWS[6]])).filter("label = 'gpl-3'").orderBy("coverage", ascending=False).first()
    assert r.start == 0 and r.end == len(words(ROWS[6][1]))


def test_empty(docs_of):
    assert scan_licenses(docs_of([])).count() == 0


def test_every_row_is_scanned_by_itself(docs_of):
    text = "Released under the MIT License. And under the mit license"
    rows = [(1, text), (1, text), (1, "cc by nc and more"), (None, text), (None, text), (None, "all of it cc by nc, cc by nc"), (None, "plain words of the same length, ten in all"), (2, None), (2, None)]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(docs_of(rows)).collect()), key=str)
    mit = (10, 2, 1, 6, "mit")
    assert got == sorted([(1, *mit), (1, *mit), (1, 5, 1, 0, 0, "cc-by-nc"), (0, *mit), (0, *mit), (0, 9, 2, 3, 6, "cc-by-nc"), (0, 9, 0, None, None, ""), (2, 0, 0, None, None, ""), (2, 0, 0, None, None, "")], key=str)


def test_repeats_side_by_side_are_kept(docs_of):
    got = {r.doc_id: r for r in scan_licenses(docs_of([(k, "All rights reserved. " * k) for k in range(1, 9)])).collect()}
    assert {(r.labels, r.score) for r in got.values()} == {("all-rights-reserved", 1.0)}
    words_ = [f"w{k}" for k in range(12)]
    text = " ".join([*words_[:11], "x", "x", *words_[9:], "x", *words_[9:], "x", *words_[9:]])
    r = license_spans(docs_of([(1, text)]), [], [("t", " ".join(words_))]).filter("label = 't'").collect()
    assert [(x.start, x.end, x.coverage) for x in r] == [(0, 11, 0.9)]


def by_hand(text, template):
    """Best coverage of one template in a text, by diagonals counted one after the other."""
    w, t = words(text), template.split()
    votes = {}
    for p in range(len(w) - K + 1):
        for q in range(len(t) - K + 1):
            if w[p : p + K] == t[q : q + K]:
                votes.setdefault(p - q, []).append(p)
    grams, runs, before = len(t) - K + 1, [], None
    for diagonal in sorted(votes):
        own = (len(votes[diagonal]), min(votes[diagonal]), max(votes[diagonal]))
        whole = own[0] == grams
        if before is None or whole or before[1] or diagonal - before[0] > DIAGONAL_GAP or own[1] - before[2] > DIAGONAL_GAP + K:
            runs.append([])
        runs[-1].append(own)
        before = (diagonal, whole, own[2])
    best = 0.0
    for run in runs:
        n, lo, hi = sum(r[0] for r in run), min(r[1] for r in run), max(r[2] for r in run)
        if hi - lo + 1 > MAX_STRETCH * grams + DIAGONAL_GAP:
            n = max(run)[0]
        best = max(best, min(n / grams, 1.0))
    return best if best >= MIN_COVERAGE else 0.0


def test_labels_against_counting_by_hand(docs_of):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        w = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["odd"], [w[at], "new", "words"]])
        rows.append((k, " ".join([*rng.choice([[], ["some", "text"]]), *w, *rng.choice([[], rng.choice(TEMPLATES)[1].split()])])))
    rows.append((900, "word " * 200_000 + "all rights reserved"))  # a very long text
    got = {r.doc_id: r for r in scan_licenses(docs_of(rows)).collect()}
    for i, text in rows:
        found = {label: max(by_hand(text, t) for own, t in TEMPLATES if own == label) for label, _ in TEMPLATES} if i < 900 else {"all-rights-reserved": 1.0}
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == {label for label, c in found.items() if c} | base, text
        assert abs(got[i].score - max([*found.values(), 1.0 if base else 0.0])) < 1e-12
