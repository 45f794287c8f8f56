import random
import zlib

import numpy as np

from fernlode.llm.quality import features, fit_bradley_terry, probability, score_quality, train_quality
from fernlode.llm.toxicity import _automaton, drop_toxic, fold, hits, score_toxicity, train_toxicity

from .conftest import sentence

LABELS = "doc_id long, quality int, toxic int, y string"


def corpus():
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(500):
        text, good, toxic = sentence(rng, rng.randint(5, 60)), rng.random() < 0.8, rng.random() < 0.2
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join([text.split()[0]] * 30)])
        if toxic:
            text += " you " + rng.choice(["zorgle", "Z0rgle", "blimpt", "bl1mpt", "zоrglе"])
        docs.append((k, text))
        labels.append((k, int(good), int(toxic), "l"))
    return docs, labels


def held_out_accuracy(got, labels, column):
    own = [(r.predicted, row[column]) for r in got if r.held_out for row in [labels[r.doc_id]]]
    return sum(a == b for a, b in own) / len(own)


def test_held_out_accuracy_and_odd_rows(spark, docs_of):
    docs, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "x " * 40000), (None, "t")]
    frame = docs_of(docs + odd)
    table = spark.createDataFrame([*labels, (None, 1, 1, "l"), (3, None, None, "l"), (1000, 1, 0, "l"), labels[0]], LABELS)
    for train, score, column, least in ((train_quality, score_quality, 1, 0.95), (train_toxicity, score_toxicity, 2, 0.97)):
        got = score(frame, train(frame, table)).collect()
        assert len(got) == len(docs) + 4 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
        assert held_out_accuracy([r for r in got if r.doc_id is not None and r.doc_id < 500], labels, column) >= least
    kept = drop_toxic(frame, train_toxicity(frame, table))
    assert kept.columns == frame.columns and 380 < kept.count() < 430


def test_without_labels(spark, docs_of):
    frame, none = docs_of([(1, "a"), (2, None)]), spark.createDataFrame([], LABELS)
    assert [r.score for r in score_quality(frame, train_quality(frame, none)).collect()] == [0.5, 0.5]
    assert [r.predicted for r in score_toxicity(frame, train_toxicity(frame, none)).collect()] == [0, 0]
    assert score_quality(frame.limit(0), train_quality(frame, none)).count() == 0


def test_fold_and_exceptions():
    assert fold("1D10T, Ídіоt").split() == ["idiot", "idiot"] and fold("a$$hat $5").split()[0] == "asshat" and fold(None) == "  "
    machine = _automaton({" trash ": 2.0, " moro": 1.0}, ["trash can"])
    assert hits(machine, "a trash, CAN")[0] == [] and [h[2] for h in hits(machine, "trash moronic")[0]] == [2.0, 1.0]
    assert hits(_automaton({}, []), "x")[0] == []


def test_bradley_terry_ranks_and_thresholds():
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.75).astype(int)
    x = rng.standard_normal((600, 4)) + y[:, None] * np.array([2.0, 0, 0, 1.0])
    model = fit_bradley_terry(x, y)
    p = probability(model, x)
    assert abs((p < 0.3).mean() - (y == 0).mean()) < 0.01 and ((p >= 0.3) == y).mean() > 0.85
    assert len({len(features(t)) for t in (None, "", "a", "\n", "x | y !!")}) == 1


def test_pairwise_loss_is_at_its_least_and_the_quantile_is_met():
    """Against the loss itself: no gradient is left at the learnt weights, and the threshold is the quantile of the scores."""
    from fernlode.llm import quality

    rng = np.random.default_rng(2)
    y = (rng.random(200) < 0.7).astype(int)
    x = rng.standard_normal((200, 3)) + y[:, None] * np.array([1.0, 0, -0.5])
    pairs = 3000
    model = fit_bradley_terry(x, y, pairs=pairs, seed=4)
    z = np.clip((quality._expand(x) - model["mean"]) / model["scale"], -8, 8)
    again = np.random.default_rng(4)
    d = z[again.choice(np.flatnonzero(y == 1), pairs)] - z[again.choice(np.flatnonzero(y == 0), pairs)]
    w = model["w"]

    def loss(v):
        return np.logaddexp(0, -(d @ v)).sum() + 0.5 * pairs * 1e-4 * (v @ v)

    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-3 * pairs
        assert loss(w) <= loss(w + 100 * step) and loss(w) <= loss(w - 100 * step)
    below = (z @ w < model["t"]).sum()
    assert abs(below - (y == 0).sum()) <= 1


def test_scores_of_the_query_equal_plain_scores(spark, docs_of):
    docs, labels = corpus()
    table = spark.createDataFrame(labels, LABELS)
    frame = docs_of(docs)
    model = train_quality(frame, table)
    got = {r.doc_id: r.score for r in score_quality(frame, model).collect()}
    plain = probability(model, np.array([features(t) for _, t in docs]))
    assert max(abs(got[i] - p) for (i, _), p in zip(docs, plain)) < 1e-12


def test_lexicon_hits_against_a_plain_search(spark, docs_of):
    """A search at every place and a count over all rows stand against the automaton and the learnt weights."""
    import math

    from fernlode.llm import toxicity
    from fernlode.llm.training import labelled_sample

    docs, labels = corpus()
    frame, table = docs_of(docs), spark.createDataFrame(labels, LABELS)
    model = train_toxicity(frame, table)
    lexicon, phrases = model["lexicon"], model["exceptions"]

    def plain(text):
        spaced = f" {' '.join(fold(text).split())} "
        at = lambda term: [k for k in range(len(spaced)) if spaced.startswith(term, k)]
        covers = [(k, k + len(p) + 1) for p in phrases for k in at(f" {p} ")]
        found = [(k, k + len(term) - 1, w) for term, w in lexicon.items() for k in at(term)]
        return sorted(h for h in found if not any(a <= h[0] and h[1] <= b for a, b in covers))

    machine = _automaton(lexicon, phrases)
    for _, text in docs + [(0, "you z0rgle, ZORGLE zorgle"), (0, "x\u0000"), (0, "")]:
        assert sorted(hits(machine, text)[0]) == plain(text)

    rows = labelled_sample(frame, table, "toxic", toxicity.SAMPLE_ROWS).filter(f"fold <> {toxicity.CALIBRATION_FOLD}").collect()
    texts = {}
    for r in rows:
        texts[r.text] = max(texts.get(r.text, 0), r.y)
    n1, n = sum(texts.values()), len(texts)
    share, counts = n1 / n, {}
    for text, y in texts.items():
        for term in toxicity._terms(fold(text)):
            counts.setdefault(term, [0, 0])[y] += 1
    want = {}
    for term, (other, toxic) in counts.items():
        weight = math.log((toxic + toxicity.PRIOR * share) / (other + toxicity.PRIOR * (1 - share))) - math.log(share / (1 - share))
        if toxic >= toxicity.MIN_DOCS and weight >= toxicity.MIN_WEIGHT:
            want[term] = weight
    assert set(lexicon) == set(want) and max(abs(lexicon[t] - w) for t, w in want.items()) < 1e-9
