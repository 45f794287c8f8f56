import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlode.llm import suffix
from fernlode.llm.suffix import earlier_factor, lpf_array, remove_repeats, repeat_report


def brute(rows, n=100):
    texts = sorted({(i, t or "") for i, t in rows if i is not None})
    return {i: row for (i, _), row in zip(texts, brute_in_order([t for _, t in texts], n))}


def brute_in_order(texts, n=100):
    seen, out = {}, []
    for i, text in enumerate(texts):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - n + 1):
            if data[s : s + n] in seen:
                gone[s : s + n] = True
            else:
                seen[data[s : s + n]] = (i, s)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 2, 0])
def test_against_brute_force(docs_of, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_SPANS", hot)
    got = {(r.doc_id, tuple(r)[1:]) for r in repeat_report(docs_of(corpus)).collect() if r.doc_id is not None}
    assert got == set(brute(corpus).items())


def test_small_flushes(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(suffix, "FLUSH_ANCHORS", 20)
    monkeypatch.setattr(suffix, "FLUSH_SPANS", 5)
    monkeypatch.setattr(suffix, "STEP_BYTES", 700)
    monkeypatch.setattr(suffix, "SETTLE_ROWS", 3)
    got = {r.doc_id: tuple(r)[1:] for r in repeat_report(docs_of(corpus)).collect() if r.doc_id is not None}
    assert got == brute(corpus)


def test_different_texts_of_one_id(spark, docs_of, corpus):
    rows = [(i % 7 if i is not None else None, t) for i, t in corpus]
    ordered = spark.createDataFrame([(i, t) for i, t in set(rows) if i is not None and t is not None], "i long, t string").selectExpr("i", "t", "xxhash64(t) h").orderBy("i", "h", F.octet_length("t")).collect()
    want = dict(zip([(r.i, r.t) for r in ordered], brute_in_order([r.t for r in ordered])))
    got = repeat_report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, *tuple(r)[1:]) for r in got if r.doc_id is not None and r.n_bytes} == {(i, *row) for (i, t), row in want.items() if t}
    kept = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in remove_repeats(docs_of(rows)).collect() if r.text and r.text.isascii()}
    assert kept <= {(i, row[3]) for (i, _), row in want.items()} | {(None, hashlib.sha256(corpus[0][1].encode()).hexdigest())}


def test_earlier_factor_is_the_longest_previous_factor():
    rng = np.random.default_rng(3)
    for _ in range(50):
        data = bytes(rng.integers(97, 99, 60).tolist())
        order = sorted(range(60), key=lambda i: data[i:])
        for match in (2, 4, 7):
            new = np.array([k == 0 or data[order[k] :][:match] != data[order[k - 1] :][:match] or len(data) - order[k] < match or len(data) - order[k - 1] < match for k in range(60)])
            assert (earlier_factor(np.array(order), new) == (lpf_array(data)[order] >= match)).all()


def test_lpf_array_is_the_definition():
    data = b"abracadabra abracadabra"
    expect = [max((k for j in range(i) for k in range(len(data) - i + 1) if data[j : j + k] == data[i : i + k]), default=0) for i in range(len(data))]
    assert lpf_array(data).tolist() == expect


def test_windows_with_a_long_previous_factor_are_the_ones_removed(docs_of):
    text = "0123456789" * 15 + "abc" + "0123456789" * 12
    lpf = lpf_array(text.encode())
    gone = np.zeros(len(text), bool)
    for s in np.flatnonzero(lpf >= 100):
        gone[s : s + 100] = True
    assert repeat_report(docs_of([(1, text)])).first().n_removed == gone.sum()


def test_nulls_empties_and_removal(docs_of, corpus):
    assert repeat_report(docs_of([])).count() == 0
    out = {r.doc_id: r for r in remove_repeats(docs_of(corpus)).collect()}
    assert out[400].text is None and out[401].text == "" and out[None].text == corpus[0][1]
    assert out[300].text == "" and out[407].text == "" and out[403].text == "één" and out[300].component == "y"
