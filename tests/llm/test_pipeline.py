import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fernlode.llm.decontaminate import ERROR_WORDS, item_words
from fernlode.llm.packing import MAX_LEN
from fernlode.llm.queries import word_bpe_path

from .conftest import sentence
from .test_decontaminate import distance_in
from .test_minhash import brute as near_duplicates_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component string, rep long, _base long"


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, None, "s", len(t or ""), "c", 1, 2) for i, t in rows], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def kept_by_near_dedup(rows):
    """Rows whose id is the smallest of its group; a null id is kept."""
    kept = {i for i, _, _, own in near_duplicates_by_hand(rows, 5, 80) if own}
    return [(i, t) for i, t in rows if i is None or i in kept]


def without_repeats(rows, n=100):
    seen, done, out = set(), {}, []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if (i, text) not in done:
            data = (text or "").encode()
            gone = np.zeros(len(data), bool)
            for s in range(len(data) - n + 1):
                if data[s : s + n] in seen:
                    gone[s : s + n] = True
                seen.add(data[s : s + n])
            done[i, text] = None if text is None else bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")
        out.append((i, done[i, text]))
    return out + [r for r in rows if r[0] is None]


def without_items(rows, items):
    patterns = [p for p in (item_words(t).tolist() for _, t in items) if p]

    def found(text):
        words = item_words(text).tolist()
        return any(distance_in(p, words) <= len(p) // ERROR_WORDS for p in patterns)

    gone = {i for i, t in rows if i is not None and found(t)}
    return [r for r in rows if r[0] not in gone]


def test_against_brute_force(spark, tmp_path, corpus):
    import corpus_pipeline as pipeline

    rng = random.Random(11)
    items = [(k, sentence(rng, 20)) for k in range(4)] + [(9, None), (10, "two words")]
    rows = [(i, t) for i, t in corpus if i not in (404, 405)]  # texts of one word again and again have no five-word neighbours to compare by hand
    rows += [(600 + k, f"{sentence(rng, 15)} {items[k][1].upper()}, {sentence(rng, 5)}") for k in range(4)] + [(610, "x two, Words y"), (3, corpus[3][1])]
    insults = ["zorgle", "blimpt"]
    extra = [(1000 + k, f"{sentence(rng, 20)}{' you ' + rng.choice(insults) if k % 4 == 0 else ''}") for k in range(160)]
    labels = [(i, 1, int(any(w in t for w in insults))) for i, t in extra]
    folder = tables(spark, tmp_path / "t", rows + extra, labels, items)

    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, folder), name)
        steps[name] = docs
    texts = lambda name: sorted(((r.doc_id, r.text) for r in steps[name].collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    ordered = lambda own: sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    clean = ordered((i, t) for i, t in rows + extra if not any(w in (t or "") for w in insults))
    assert texts("toxicity") == clean
    clean = ordered(kept_by_near_dedup(clean))
    assert texts("near_dedup") == clean
    clean = ordered(without_repeats(clean))
    assert texts("suffix_dedup") == clean
    assert all(r.n_chars == len(r.text or "") and r.component == "c" for r in steps["suffix_dedup"].collect())
    clean = ordered(without_items(clean, items))
    assert texts("decontamination") == clean
    tokenizer, pieces = Tokenizer.from_file(word_bpe_path()), []
    for i, t in clean:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(i, k, at, len(ids[at : at + MAX_LEN]), zlib.crc32(ids[at : at + MAX_LEN].tobytes())) for k, at in enumerate(range(0, len(ids), MAX_LEN))]
    packed = steps["packing"].collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in packed), key=key) == sorted(pieces, key=key)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= MAX_LEN
    assert len(sequences) == -(-sum(p[3] for p in pieces) // MAX_LEN)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, ""), (1, None), (1, "a"), (1, "a"), (1, "b"), (2, "x " * 30_000)]])
def test_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline as pipeline

    folder = tables(spark, tmp_path / "t", rows, [], [])
    out = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows} and all(0 < r.length <= MAX_LEN for r in out)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
