"""The stages on the smallest tables: what each keeps, and the sequences of the last."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from switchyard.llm import divergence, simhash
from switchyard.llm.catalog import ORACLES, QUERIES
from switchyard.session import materialise

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, docs
    results = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, kept, SF_DIR), name)
        assert out.columns == columns
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in kept.collect()}
        results[name] = kept, out
        kept = out
    before, after = results["quality_rules"]
    verdicts = {r.doc_id: r.kept for r in divergence.assess(before).collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, k in verdicts.items() if k}
    before, after = results["near_duplicates"]
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(before, shingle=4, radius=4).collect()}
    assert {r.doc_id for r in after.collect()} == set(groups.values())
    before, after = results["repeated_passages"]
    assert after.count() == before.count() and after.where(F.length("text") != F.col("n_chars")).count() == 0
    sizes = corpus_pipeline.packed_sequences(spark, kept, SF_DIR).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sizes and all(r.n <= 2048 and r.n & (r.n - 1) == 0 for r in sizes)


def test_stages_on_odd_and_no_rows(spark):
    """Nulls, blanks, a repeated id with another text, names with spaces and clashing ones."""
    words = " ".join(f"the word{i} of and to in a" for i in range(30)) + "."
    rows = [(1, words, "en", "s", 0, 1), (1, "other " + words, None, "s", 0, 2), (None, words, "en", None, 0, 3), (2, None, "en", "s", None, 4)]
    rows += [(3, "", "en", "s", 0, 5), (4, " \n ", "xx", "s", 0, 6), (5, words, "en", "s", 0, 7), (5, words, "en", "s", 0, 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `my col.x` int")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialise(stage(spark, docs, SF_DIR), name)
            assert out.schema.names == odd.schema.names and out.count() <= docs.count()
        assert (corpus_pipeline.packed_sequences(spark, docs, SF_DIR).count() > 0) == (docs is odd)


def test_one_query_per_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(ORACLES) <= set(QUERIES)
