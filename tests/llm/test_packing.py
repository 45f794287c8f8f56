import random
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fernlode.llm import packing
from fernlode.llm.packing import _TextIds, pack, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
IDS = _TextIds(PATH)


def direct(text):
    return array("I", Tokenizer_.encode(text or "", add_special_tokens=False).ids).tobytes()


Tokenizer_ = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_chunk_ids_equal_the_tokenizer(text):
    assert list(IDS.documents(pa.array([text, text]))) == 2 * [direct(text)] and IDS.document(text) == direct(text)


@pytest.mark.parametrize("text", ["It's DON'T we'll", "H̱ello İs ΣΑΣ", "a<|endoftext|>b", "x\x1cy z", "foo!!! Bar?,", "ª µ ß ẞ ﬁ", "naïve Café,"])
def test_chunk_ids_of_odd_texts(text):
    assert list(IDS.documents(pa.array([text, text]))) == 2 * [direct(text)] and IDS.document(text) == direct(text)


def test_plan_covers_every_piece_once_without_overflow():
    rng = random.Random(1)
    for _ in range(20):
        histogram = Counter(rng.randint(1, 50) for _ in range(rng.randint(1, 400)))
        slots, bins = plan_bins(dict(histogram), 50)
        fill, placed = Counter(), Counter()
        for length, first, bin_, repeat, times, offset in slots:
            assert placed[length] == first
            placed[length] += repeat * times
            for b in range(bin_, bin_ + repeat):
                fill[b] += length * times
        assert placed == histogram and len(fill) == bins and max(fill.values()) <= 50
        assert bins <= -(-sum(k * n for k, n in histogram.items()) // 50) * 1.25 + 1


def test_pack_round_trip(spark, docs_of, corpus):
    rows = [(i, t) for i, t in corpus if i is not None] + [(900, "word " * 3000)]
    seen = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    got = pack(docs_of(rows), PATH, max_len=128).toPandas()
    for doc, text in rows:
        ids = direct(text) + bytes(4)
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.piece.tolist() == list(range(-(-len(ids) // 512))) and own.length.sum() == len(ids) // 4
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        ends = (own.offset + own.length).tolist()
        assert own.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 128


def test_pack_empty_table(docs_of):
    assert pack(docs_of([]), PATH).count() == 0


def test_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing._WordIds, "SLOTS", 1 << 8)
    monkeypatch.setattr(packing._WordIds, "POOL", 1 << 12)
    monkeypatch.setattr(packing, "SEGMENT_CHARS", 300)
    ids_of = _TextIds(PATH)
    rng = random.Random(5)
    odd = "aAbßéÉ.,'’<|>_-09 \t\n\x0b\x85\xa0\x1c½²µªÿ日本İſ€\x00\x01\x7f\xad"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeiourstnlAEß. ,") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    texts += [None, "é" * 300 + " a b", "x" * 2000, "a " * 2000 + "b" * 300, "abc " * 1000 + "日本", "<|endoftext|> don't"]
    assert list(ids_of.documents(pa.array(texts))) == [ids_of.encode(t or "") for t in texts]


def test_the_fullest_combination_is_the_fullest():
    rng = random.Random(6)
    for _ in range(200):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), rng.randint(1, 5))}
        capacity = rng.randint(1, 60)
        sums = {0}
        for n, times in counts.items():
            sums = {s + n * k for s in sums for k in range(times + 1)}
        chosen = packing._fullest(sorted(counts, reverse=True), counts, capacity)
        assert all(k <= counts[n] for n, k in chosen) and sum(n * k for n, k in chosen) == max(s for s in sums if s <= capacity)


def test_repeated_rows_are_each_packed(docs_of):
    rows = [(1, "same text"), (1, "same text"), (1, "another one"), (None, "x"), (None, None)]
    got = pack(docs_of(rows), PATH, max_len=8).collect()
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i or 0, zlib.crc32(direct(t) + bytes(4))) for i, t in rows)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len({p[:2] for p in places}) == len(rows) and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
