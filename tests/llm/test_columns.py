from fernlode.llm.decontaminate import contaminated, drop_contaminated
from fernlode.llm.embeddings import embedding_duplicates
from fernlode.llm.exact import drop_exact_duplicates
from fernlode.llm.minhash import drop_near_duplicates
from fernlode.llm.suffix import remove_repeats
from fernlode.llm.toxicity import drop_toxic
from fernlode.llm.warc import round_trip
from fernlode.llm.wrappers import extract_pages

from .conftest import sentence


def test_names_of_any_kind_pass_through(spark, corpus):
    """Dots, back quotes and names that the operators use inside."""
    rows = [(i, t, "a", "b", 1) for i, t in corpus if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `c``d` string, component long")
    items = spark.createDataFrame([(1, corpus[0][1], "x", 7)], "item_id long, text string, distance string, doc_id long")
    for out in (drop_near_duplicates(docs), remove_repeats(docs), drop_contaminated(docs, items), drop_exact_duplicates(docs), drop_toxic(docs, {"constant": 0.0})):
        assert out.columns == docs.columns and {r[2] for r in out.collect()} == {"a"}
    assert 0 in {r.doc_id for r in contaminated(docs, items).collect()}


def test_other_tables_with_clashing_names(spark):
    import random

    rng = random.Random(1)
    pages = [(k, f"http://h/{k}", f"<article>{sentence(rng, 30)}</article>", "x", 1, "y") for k in range(4)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string, wrapper long, record_id string")
    assert {r.page_id for r in extract_pages(frame).collect()} == {0, 1, 2, 3} and round_trip(frame, with_payload=False).count() == 4
    vectors = [(k, "l", [1.0, 0.0, float(k == 3)], "x", 2, 3) for k in range(4)]
    got = embedding_duplicates(spark.createDataFrame(vectors, "vec_id long, label string, embedding array<float>, component string, code long, n_links long")).collect()
    assert {(r.vec_id, r.component_id) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 3)}
