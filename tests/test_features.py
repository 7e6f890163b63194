"""Text features against plain Python on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from switchyard.functions import grams
from switchyard.functions import measures as M
from switchyard.functions import text as T
from switchyard.functions.digest import digest_high_mod, digest_mod
from switchyard.operators import annotated as A
from switchyard.operators import encode as E
from switchyard.operators import text_features as TF
from switchyard.session import materialise

TEXTS = [
    "",
    "x",
    " \n\t ",
    "We tested HTTP and I agree.",
    "日本で一番高い山はFujiです。",
    "Which river runs through Prague? SEE https://a.b WWW.c.d!!",
    "def f(x): return x**2 + 3*x - 1 ```code``` class defclass",
    "ÉTÉ Été été ÑÁ ß Aß 12 345 ٣ ½ ² x1 A1 中文 中A",
    "One. Two! Three?? Four... five",
    "a b　c\x1cd\x85e",
    "😀😀 ok 😀",
]


# Worked out by hand: prompt -> features that differ from those of an empty one.
EMPTY = {
    "len_bucket": "0", "token_bucket": "0", "has_number": "0", "number_density_bucket": "0", "has_math_symbol": "0",
    "math_density_bucket": "0", "has_code_pattern": "0", "punct_density_bucket": "0", "contains_url": "0", "upper_density_bucket": "0",
}
WORKED = {
    "": {},
    "x": {},
    " \n\t ": {},
    "Now 1234567890": {"has_number": "1", "number_density_bucket": "4"},
    "see HTTPS://a.b": {"contains_url": "1", "punct_density_bucket": "4", "has_math_symbol": "1", "math_density_bucket": "3"},
    "a class of its own": {"has_code_pattern": "1"},
    "declassified defend": {},
    "a ± b": {"has_math_symbol": "1", "math_density_bucket": "3"},
}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    long_plain = "ab" * 3000 + " the end of it"  # few different grams early on
    words = " ".join("".join(rng.choice("abcdefgé中") for _ in range(rng.randint(1, 9))) for _ in range(1500))
    return spark.createDataFrame(list(enumerate([*TEXTS, long_plain, words])), "query_id long, prompt string")


def test_bucket_edges(spark):
    found = spark.createDataFrame([(v,) for v in (0, 8, 9, 16, 17)], "v int").select(T.bucket(F.col("v"), (8, 16)))
    assert [r[0] for r in found.collect()] == ["0", "0", "1", "1", "2"]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (3, -1)], "a int, b int")
    assert [r[0] for r in df.select(T.safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_surface_features(spark):
    given = list(WORKED)
    df = spark.createDataFrame(list(enumerate(given)), "query_id long, prompt string")
    for row in TF.surface_columns(df).collect():
        got = row.asDict()
        text = given[got.pop("query_id")]
        assert got == EMPTY | WORKED[text], text


def test_hash_flags_cover_whole_texts(texts):
    """A flag is set exactly if some gram of the whole text has the bucket."""
    for row in TF.extract(texts).collect():
        got = {k for k in row.features if k.startswith("hash")}
        clean = row.prompt.lower().strip()
        for n in (3, 4, 5):
            grams_of = {clean[i : i + n] for i in range(len(clean) - n + 1)}
            want = {f"hash{n}_{int.from_bytes(hashlib.md5(g.encode()).digest(), 'big') % 128}" for g in grams_of}
            assert {k for k in got if k.startswith(f"hash{n}_")} == want, row.query_id


def test_sentences_and_titles(texts):
    got = {r.query_id: (r.s, r.t) for r in texts.select("query_id", T.sentence_count(F.col("prompt")).alias("s"), T.title_count(F.col("prompt")).alias("t")).collect()}
    assert got[0] == (0, 0) and got[2] == (0, 0)
    assert got[3] == (1, 2)  # "We" and the single capital "I", not "HTTP"
    assert got[8] == (5, 4)


def test_digest_mod(spark):
    words = ["", "abc", "请解释", "x" * 1000]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    digest = F.md5(F.col("w").cast("binary"))
    for modulus in (128, 384, 1000, 97):
        rows = df.select("w", digest_mod(digest, modulus).alias("a"), digest_high_mod(digest, modulus).alias("b")).collect()
        for r in rows:
            h = int(hashlib.md5(r.w.encode()).hexdigest(), 16)
            assert (r.a, r.b) == (h % modulus, (h >> 8) % modulus)


def brute_embedding(text, dim):
    """Per gram length the multiset of grams, weighted and summed."""
    sums = np.zeros(dim)
    for n in (3, 4, 5) if text else ():
        pieces = [text] if len(text) < n else [text[i : i + n] for i in range(len(text) - n + 1)]
        for piece, times in Counter(pieces).items():
            place, weight = grams.gram_entry(piece, dim)
            sums[place] += times * weight
    length = np.linalg.norm(sums)
    return sums if length == 0 else sums / length


def test_hash_embedding(texts):
    assert grams.gram_entry("abc", 384) == (370, 951)
    for row in E.hash_embedding(texts, 48).collect():
        assert np.allclose(row.embedding, brute_embedding(row.prompt, 48), atol=1e-12), row.query_id


@pytest.mark.parametrize("window", [7, 64])
def test_embedding_windows(monkeypatch, window):
    """A text longer than a window is summed in parts."""
    monkeypatch.setattr(grams, "WINDOW", window)
    sums = grams.gram_sums(TEXTS, 32, {})
    for text, got in zip(TEXTS, sums):
        norm = np.sqrt((got * got).sum())
        assert np.allclose(got / norm if norm else got, brute_embedding(text, 32))


def test_merge_and_attach(spark):
    df = spark.sql("select map('a', '1', 'b', cast(null as string)) as given, map('a', '2', 'c', '3') as derived")
    merged = df.select(TF.merge(F.col("given"), F.col("derived")).alias("m"))
    assert merged.first().m == {"a": "2", "b": "", "c": "3"}
    assert merged.select(TF.attach_cluster(F.col("m"), 4, F.lit(2)).alias("m")).first().m["embed_cluster_4"] == "2"
    assert "embed_cluster_4" not in merged.select(TF.attach_cluster(F.col("m"), 4, F.lit(None)).alias("m")).first().m


def test_annotated(spark):
    tokens = spark.createDataFrame(
        [(1, 0, "noun"), (1, 1, "verb"), (1, 2, "noun"), (1, 3, "adj"), (1, 4, "det"), (2, 0, "")],
        "query_id long, pos int, tag string",
    )
    got = {(r.query_id, r.key): r.value for r in A.pos_top(tokens).collect()}
    assert got == {(1, "pos_top1"): "NOUN", (1, "pos_top2"): "VERB", (1, "pos_top3"): "ADJ", (2, "pos_top1"): "UNK"}
    entities = spark.createDataFrame([(1, "person"), (1, "person"), (1, "gpe")], "query_id long, label string")
    flags = A.entity_flags(spark.range(1, 3).withColumnRenamed("id", "query_id"), entities)
    assert {(r.query_id, r.key) for r in flags.collect()} == {(1, "has_ent_PERSON"), (1, "has_ent_GPE"), (2, "has_ent_NONE")}


def test_word_shapes(spark):
    df = spark.createDataFrame([("Hello WORLDS 12345 x_1 déjà... 中",)], "t string")
    assert df.select(T.word_shapes(F.col("t"))).first()[0] == ["Xxxxx", "XXXX", "dddd", "x_d", "xxxx", ".", ".", ".", "x"]


def test_one_hot_norm_and_unknown(spark):
    fit = spark.sql("select 1 as query_id, map('a','1','b','1','c','1','d','1') as features")
    new = spark.sql("select 2 as query_id, map('a','1','b','1','c','1','d','1','e','9') as features union all select 3, map('z','0')")
    vocab = E.fit_vocabulary(fit)
    assert [(r.key, r.idx) for r in vocab.orderBy("idx").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    got = E.one_hot(new, vocab).collect()
    assert {r.query_id for r in got} == {2}
    assert sorted((r.idx, round(r.value, 12)) for r in got) == [(i, 0.5) for i in range(4)]


def test_sparse_vectors_of_a_wide_vocabulary(spark):
    """More values than any list on the driver should hold; equal to the joined one-hot rows."""
    n = (1 << 20) + 1000
    fit = spark.range(n).select(F.col("id").alias("query_id"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("features"))
    vocab = E.fit_vocabulary(fit)
    new = spark.sql(
        "select 1L as query_id, map('k', '1048999', 'other', 'x') as features union all select 2L, map('k', 'none') union all select 3L, null"
    )
    found = {r.query_id: (r.indices, r["values"]) for r in E.one_hot_vectors(new, vocab).collect()}
    index = vocab.where("value = '1048999'").first().idx
    assert found == {1: ([index], [1.0]), 2: ([], []), 3: ([], [])} and vocab.count() == n


def test_constant_dimension(spark):
    fit = spark.createDataFrame([([3.0, 1.0],), ([3.0, 2.0],)], "v array<double>")
    low, high = E.min_max(fit, "v")
    new = spark.createDataFrame([([3.0, 1.5],), ([5.0, 4.0],)], "v array<double>")
    assert [r[0] for r in new.select(E.scale_min_max(F.col("v"), low, high)).collect()] == [[0.0, 0.5], [2.0, 3.0]]


def test_min_max_of_nothing(spark):
    assert E.min_max(spark.createDataFrame([], "v array<double>"), "v") == ([], [])


def test_fuse(spark):
    df = spark.sql("select array(1d, 2d) as a, array(4d) as b")
    assert df.select(E.fuse(F.col("a"), F.col("b"), 0.25)).first()[0] == [0.25, 0.5, 3.0]
    assert df.select(E.fuse(F.col("a"), F.col("b"), 7.0)).first()[0] == [1.0, 2.0, 0.0]


def test_embedding_or_hash(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, None)], "query_id long, prompt string")
    given = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = {r.query_id: r.embedding for r in E.embedding_or_hash(df, given, 2).collect()}
    assert got[1] == [1.0, 0.0] and got[3] == [0.0, 0.0]
    assert np.allclose(got[2], brute_embedding("abcd", 2))


def test_known_grams_outlive_a_full_table():
    asked = []
    known = grams.Known(lambda g: asked.append(g) or len(g), 3)
    for gram in ("a", "bb", "c", "dd", "e", "ff", "g"):
        assert known["hot"] == 3 and known[gram] == len(gram)
        known.rest()
    assert asked.count("hot") == 1 and len(known) <= 4


@pytest.mark.parametrize(("numbered", "letters"), [(1 << 20, 255), (40, 255), (1 << 20, 3)])
def test_numbered_grams_have_their_values(monkeypatch, numbered, letters):
    """Every gram once per start, also where a table is full or a letter is not among the frequent ones."""
    monkeypatch.setattr(grams, "NUMBERED", numbered)
    monkeypatch.setattr(grams, "LETTERS", letters)
    monkeypatch.setattr(grams, "WINDOW", 60)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcde fgh\u00e9\u4e2d\U0001f600"), size)) for size in (0, 1, 2, 3, 4, 5, 59, 60, 61, 300, 7)]
    table = grams.Numbered(grams.Known(lambda g: hash(g) & 0xFFFF, 1 << 10), (3, 4, 5))
    for _ in range(2):
        found = Counter()
        for n, joined, at, owner, values in table.windows(texts):
            for p, number, value in zip(at.tolist(), owner.tolist(), values.tolist(), strict=True):
                assert value in (-1, hash(joined[p : p + n]) & 0xFFFF)
                found[number, joined[p : p + n]] += 1
        assert found == Counter((i, t[p : p + n]) for i, t in enumerate(texts) for n in (3, 4, 5) for p in range(len(t) - n + 1))


def test_embedding_looks_up_no_gram_by_its_text(monkeypatch):
    """Grams of ordinary text are found by number; each is hashed once and none kept as a string."""
    asked = []
    table = grams.Numbered(grams.Known(lambda g: asked.append(g) or grams.gram_code(16)(g), 8), grams.EMBED_NGRAMS)
    first = grams.gram_sums(["always the same"] * 3, 16, table)
    assert (grams.gram_sums(["always the same"], 16, table) == first[:1]).all()
    assert max(Counter(asked).values()) == 1 and len(table.known) == 0


def test_flag_keys_of_other_bucket_counts(spark):
    df = spark.createDataFrame([("some words of a text, and a few more of them",)], "prompt string")
    keys = set(TF.extract(df, buckets=300).select(F.map_keys("features")).first()[0])
    pieces = {(n, "some words of a text, and a few more of them"[i : i + n]) for n in TF.NGRAMS for i in range(45 - n)}
    assert {f"hash{n}_{int(hashlib.md5(p.encode()).hexdigest(), 16) % 300}" for n, p in pieces} == {k for k in keys if k.startswith("hash")}


def test_embedding_keeps_grams_between_batches(spark, monkeypatch):
    asked = []
    entry = grams.gram_entry
    monkeypatch.setattr(grams, "gram_entry", lambda g, dim: asked.append(g) or entry(g, dim))
    monkeypatch.setattr(E, "GRAM_CACHE", 8)
    got = list(E.hash_embedding_udf(16).func(iter([pd.Series(["always the same"])] * 3)))
    assert all((g[0] == got[0][0]).all() for g in got)
    assert max(Counter(asked).values()) == 1


def test_flags_need_no_hash_once_all_buckets_are_found(spark, monkeypatch):
    asked = []
    md5 = TF.md5
    monkeypatch.setattr(TF, "md5", lambda g: asked.append(g) or md5(g))
    monkeypatch.setattr(TF, "GRAM_STEP", 100)
    long = "".join(chr(0x4E00 + i) for i in range(9000))
    texts = [long, "aaaa" * 200 + "b", "", None, "ab"]
    got = next(iter(TF.hash_buckets_udf(8).func(iter([pd.Series(texts)]))))
    for text, row in zip(texts, got.itertuples(index=False), strict=True):
        for n, found in zip(TF.NGRAMS, row, strict=True):
            pieces = {(text or "")[i : i + n] for i in range(len(text or "") - n + 1)}
            assert found == sorted({int(hashlib.md5(p.encode()).hexdigest(), 16) % 8 for p in pieces})
    assert len(asked) < 2000


def test_flags_of_texts_read_in_parts(spark, monkeypatch):
    """Grams that reach into the next part count; behind the part that brings the last bucket nothing is read."""
    monkeypatch.setattr(TF, "FLAG_CHARS", 7, raising=False)
    rng = random.Random(3)
    words = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [words, "aaaa" * 50 + "b", " padded \n", "", None, "ab", "abcdefg", "abcdefgh", words[:300]]
    read = []
    windows = grams._windows
    monkeypatch.setattr(grams, "_windows", lambda some: read.append(sum(map(len, some))) or windows(some))
    got = next(iter(TF.hash_buckets_udf(16).func(iter([pd.Series(texts)]))))
    for text, row in zip(texts, got.itertuples(index=False), strict=True):
        clean = (text or "").strip()
        for n, found in zip(TF.NGRAMS, row, strict=True):
            pieces = {clean[i : i + n] for i in range(len(clean) - n + 1)}
            assert found == sorted({int(hashlib.md5(p.encode()).hexdigest(), 16) % 16 for p in pieces}), (text, n)
    assert sum(read) < 3000


def test_features_are_put_into_one_map(spark, texts):
    """Every map that is made looks for repeated keys among all its entries."""
    given = texts.withColumn("features", F.create_map(F.lit("eval"), F.lit(None).cast("string"), F.lit("has_number"), F.lit("x")))
    made = TF.extract(given, name="both", given="features")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") == 1 + plan.count("map_from_arrays([], [])") and "map_concat" not in plan
    derived = {r.query_id: r.features for r in TF.extract(texts).collect()}
    assert {r.query_id: r.both for r in made.collect()} == {i: {"eval": ""} | f for i, f in derived.items()}


def odd_texts(n=400, seed=5):
    rng = random.Random(seed)
    pieces = list("aAbBzZßǅªⒶµÀé日本١٣09_-+=.!?,;:/\t\n\r\x1c\x1f\x85\xa0‍́　 𝟘𐐀𐐨😀ⅣñÑΣς﻿ͅ ") + [
        "def", "class", "```", "http://", "HTTPS://", "www.", "WWW.", "aaaaaa", "11111", "____", "ABC", "Title", "ΔΣ", "日本語", "  ", ". ", "...", "!a", "́́́́́",
    ]
    return ["", " ", None, "\x1c", *["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(n)]]


def test_measures_equal_the_expressions(spark):
    """The counts and shapes of the feature step beside the regular expressions that define them."""
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "query_id long, prompt string").repartition(3)
    text = F.col("prompt")
    counts = T.surface_counts(text) | T.linguistic_counts(text)
    want = df.select("query_id", *[c.alias(n) for n, c in counts.items()], F.map_values(TF.shape_map(text)).alias("shapes"))
    got = M.with_measures(df, text, TF.SHAPE_TOP_K).select(*want.columns)
    have = {r.query_id: r.asDict() for r in got.collect()}
    for row in want.collect():
        assert have[row.query_id] == row.asDict(), rows[row.query_id]


def test_every_character_is_measured_alike(spark):
    """Every code point alone, between letters and after a capital."""
    ids = spark.range(1, 0x110000).where("id not between 55296 and 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    text = F.concat("c", F.lit(" a"), "c", F.lit("b A"), "c", F.lit(" B."), "c", "c", "c", "c", "c")
    df = ids.groupBy((F.col("id") / 16).cast("long").alias("query_id")).agg(F.concat_ws("\n", F.collect_list(text)).alias("prompt"))
    df = materialise(df, "characters")
    counts = T.surface_counts(F.col("prompt")) | T.linguistic_counts(F.col("prompt"))
    want = df.select("query_id", *[c.alias(n) for n, c in counts.items()], F.map_values(TF.shape_map(F.col("prompt"))).alias("shapes"))
    got = M.with_measures(df, F.col("prompt"), TF.SHAPE_TOP_K).select(*want.columns)
    assert want.exceptAll(got).isEmpty()


def test_the_feature_step_runs_no_regular_expression(spark, texts):
    """A dozen of them over every text took most of the step's time."""
    plan = TF.extract(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "rlike" not in plan.lower()


def test_functions_of_a_row_are_one_pass(spark):
    """Counts, flags and embedding of a text by one Python function, as each gives on its own."""
    rows = list(enumerate(odd_texts(60)))
    df = spark.createDataFrame(rows, "query_id long, prompt string").repartition(3)
    made = TF.extract(df, more={"vector": (E.hash_embedding_udf(8), F.col("prompt"))})
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = {r.query_id: (r.f, r.v) for r in TF.extract(df, name="f").withColumn("v", E.hash_embedding_udf(8)("prompt")).collect()}
    assert {r.query_id: (r.features, r.vector) for r in made.collect()} == want
    flags = {r.query_id: {f"hash{n}_{b}" for n in TF.NGRAMS for b in r[f"hash{n}"]} for r in TF.with_hash_buckets(df).collect()}
    assert {i: {k for k in f if k.startswith("hash")} for i, (f, _) in want.items()} == flags


@pytest.mark.parametrize("shapes", [False, True])
def test_features_by_one_function_alone(spark, shapes):
    """Without hash flags only the measures are left, whose column Spark hands over as it is."""
    df = spark.createDataFrame(list(enumerate(odd_texts(60))), "query_id long, prompt string").repartition(3)
    whole = {r.query_id: r.features for r in TF.extract(df).collect()}
    want = {i: {k: v for k, v in f.items() if not k.startswith("hash") and (shapes or not k.startswith("shape_"))} for i, f in whole.items()}
    assert {r.query_id: r.features for r in TF.extract(df, hash_flags=False, shapes=shapes).collect()} == want


def test_features_keep_columns_named_like_counts(spark):
    df = spark.createDataFrame([(1, "two words", 77, "x")], "query_id long, prompt string, n_chars int, shapes string")
    assert TF.extract(df).drop("features").collect() == df.collect()
