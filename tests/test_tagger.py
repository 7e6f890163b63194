"""The sequence tagger against plain counting and exhaustive decoding."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from switchyard.operators import annotated as A
from switchyard.operators import tagger as G
from switchyard.operators import text_features as TF

SENTENCES = [
    [("the", "DET"), ("run", "NOUN"), ("ends", "VERB")],
    [("they", "PRON"), ("run", "VERB"), ("home", "NOUN")],
    [("the", "DET"), ("walk", "NOUN"), ("ends", "VERB")],
    [("they", "PRON"), ("walk", "VERB"), ("home", "NOUN")],
] * 5


@pytest.fixture(scope="module")
def tagger(spark):
    rows = [(i, p, w, t) for i, s in enumerate(SENTENCES) for p, (w, t) in enumerate(s)]
    return G.fit(spark.createDataFrame(rows, "query_id long, pos int, word string, tag string"))


def tags(tagger, spark, texts, schema="query_id long, words array<string>"):
    return {r["query_id"]: r["tags"] for r in tagger.tag(spark.createDataFrame(texts, schema)).collect()}


def test_context_decides(spark, tagger):
    found = tags(tagger, spark, [(1, ["the", "run", "ends"]), (2, ["they", "run", "home"]), (3, ["they", "unseen"])])
    assert found == {1: ["DET", "NOUN", "VERB"], 2: ["PRON", "VERB", "NOUN"], 3: ["PRON", "VERB"]}


def test_odd_texts(spark, tagger):
    long = ["they", "run", "home"] * 20000
    found = tags(tagger, spark, [(1, []), (2, None), (3, [None, "run"]), (4, long), (5, ["run"]), (6, ["run"])])
    assert found[1] == found[2] == [] and len(found[3]) == 2 and len(found[4]) == 60000 and found[5] == found[6]
    assert tagger.tag(spark.createDataFrame([], "query_id long, words array<string>")).count() == 0


def test_rare_words_are_joined(spark, tagger, monkeypatch):
    """Words beyond the frequent ones have the same scores by the join."""
    texts = [(i, [w for w, _ in s]) for i, s in enumerate(SENTENCES)] + [(99, ["Zebra", "the", "12."])]
    monkeypatch.setattr(G, "FREQUENT", 2)
    rows = [(i, p, w, t) for i, s in enumerate(SENTENCES) for p, (w, t) in enumerate(s)]
    few = G.fit(spark.createDataFrame(rows, "query_id long, pos int, word string, tag string").repartition(7))
    assert few.words.where("rank is not null").count() == 2 and few.words.where("rank is null").count() > 2
    assert tags(few, spark, texts) == tags(tagger, spark, texts)


def test_saved_tagger(spark, tagger, tmp_path):
    tagger.save(str(tmp_path / "tagger"))
    loaded = G.Tagger.load(spark, str(tmp_path / "tagger"))
    texts = [(i, [w for w, _ in s]) for i, s in enumerate(SENTENCES[:4])]
    assert tags(loaded, spark, texts) == tags(tagger, spark, texts)


def test_untagged_rows(spark):
    schema = "query_id long, pos int, word string, tag string"
    with pytest.raises(ValueError):
        G.fit(spark.createDataFrame([(1, 0, "a", None)], schema))
    one = G.fit(spark.createDataFrame([(1, 0, None, "X"), (1, 1, "a", None), (1, 2, "b", "X")], schema))
    assert one.tags == ["X"] and tags(one, spark, [(1, ["b", "c"])]) == {1: ["X", "X"]}
    with pytest.raises(ValueError):
        G.fit(spark.createDataFrame([(1, i, "a", str(i)) for i in range(G.MAX_TAGS + 1)], schema))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=5), st.integers(0, 10**6))
def test_decoding_is_exhaustive_search(lengths, seed):
    random = np.random.default_rng(seed)
    k = 3
    start, steps, scores = random.normal(size=k), random.normal(size=(k, k)), random.normal(size=(sum(lengths), k))
    got, at = G.likeliest(scores, np.array(lengths), start, steps), 0
    for n in lengths:
        def worth(path):
            return sum(scores[at + i, t] for i, t in enumerate(path)) + start[path[0]] + sum(steps[a, b] for a, b in zip(path, path[1:]))

        if n:
            assert tuple(got[at : at + n]) == max(itertools.product(range(k), repeat=n), key=worth)
        at += n


def test_entities_are_runs(spark):
    schema = "query_id long, pos int, tag string"
    given_tags = ["B-NAME", "I-NAME", "B-NAME", "O", "I-PLACE", "I-PLACE", "I-NAME", None, "I-NAME"]
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(given_tags)], schema)
    found = sorted(r["label"] for r in G.entity_rows(tokens).collect())
    assert found == ["NAME"] * 4 + ["PLACE"]


def test_annotations_join_the_map(spark):
    queries = spark.createDataFrame([(1, {"a": "1"}), (2, {"pos_top1": "given"}), (3, None)], "query_id long, features map<string,string>")
    tokens = spark.createDataFrame([(2, 0, "noun"), (2, 1, "")], "query_id long, pos int, tag string")
    entities = spark.createDataFrame([(1, "name")], "query_id long, label string")
    maps = A.annotation_map(queries.where("query_id < 3"), tokens, entities)
    found = {r["query_id"]: r["features"] for r in TF.with_annotations(queries, maps).collect()}
    assert found[1] == {"a": "1", "has_ent_NAME": "1"}
    assert found[2] == {"pos_top1": "NOUN", "pos_top2": "UNK", "has_ent_NONE": "1"}
    assert not found[3]
