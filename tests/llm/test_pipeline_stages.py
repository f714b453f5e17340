"""The corpus pipeline: stage contracts, effects, and awkward rows."""

import corpus_pipeline
import pytest
from brute import WORD, corpus, frame

import __spark_entry__ as entry
from portentia.llm import queries
from portentia.llm.near_duplicates import near_duplicates

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty):
    docs = frame(spark, [] if empty else corpus(n=60))
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, SF)
        rows = out.collect()
        before = {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in rows} <= before, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(rows, docs.schema)
        if not empty:
            assert rows, name
    if not empty:
        assert all(len(WORD.findall(r.text or "")) >= 1 for r in docs.collect())
        assert all(r.n_tokens * 4 == len(r.ids) for r in rows)


def test_texts_under_shared_ids_stay_exactly_once(spark):
    """Rows with repeated and null ids: of each text one row stays, whatever else bears its id."""
    words = "amber basalt cedar dune ember fjord gully heath islet jetty kettle ledge".split()
    text = {c: " ".join(f"{w}{c}{k}" for k in range(8) for w in words) for c in "ABCD"}
    rows = [(3, "A"), (5, "A"), (5, "B"), (9, "B"), (8, "C"), (8, "C"), (None, "D"), (None, "D"), (4, None), (4, None), (6, "")]
    docs = spark.createDataFrame([(i, text.get(c, c), "en", "s", c) for i, c in rows], "doc_id long, text string, lang string, __d string, row string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.row) for r in out.collect()), key=str)
    assert got == sorted([(3, "A"), (5, "B"), (8, "C"), (None, "D"), (4, None), (4, None), (6, "")], key=str)
    verdicts = near_duplicates(docs.select("doc_id", "text")).collect()
    assert {(r.doc_id, r.component_id) for r in verdicts if r.n_shingles} == {(3, 3), (5, 3), (5, 5), (9, 5), (8, 8), (None, None)}
    lines = corpus_pipeline.line_stage(spark, docs, SF)
    assert lines.columns == docs.columns and {r.row for r in lines.collect()} == {"A", "B", "C", "D", None, ""}
