import corpus_pipeline
from tests.oracle import DATA
from shardwright.llm import simhash


def words(name):
    return " ".join(f"{name}{k}" for k in range(30))


def test_null_and_repeated_ids_stand_for_their_own_texts(spark):
    rows = [(None, "a"), (None, "b"), (None, "b"), (1, "c"), (1, "d"), (2, "c"), (0, "e"), (3, "e"), (3, "f"), (None, "f")]
    docs = spark.createDataFrame([(i, words(t), "x") for i, t in rows], "doc_id long, text string, _row string")
    want = {(None, "a"), (None, "b"), (1, "c"), (1, "d"), (0, "e"), (3, "f")}
    for kept in (corpus_pipeline.near_dedup(spark, docs, DATA), simhash.keep_one(docs)):
        got = [(r["doc_id"], r["text"][0]) for r in kept.collect()]
        assert kept.columns == docs.columns and len(got) == len(want) and set(got) == want


def test_mixing_uses_every_row_once(spark):
    """One source: its budget is one whole epoch."""
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "d"), (2, "e")]
    docs = spark.createDataFrame([(i, words(t), "s") for i, t in rows], "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.mixed(spark, docs, DATA).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
