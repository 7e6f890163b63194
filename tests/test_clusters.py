"""Clustering: merging, assignment, skewed buckets, profiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.config import RouterConfig
from switchyard.models import Models
from switchyard.operators import clusters as C
from switchyard.operators import dcf
from switchyard.operators import profiles as P
from switchyard.operators.ranking import dense_index, top_k_salted
from switchyard.operators.split import exact_split, hash_split
from switchyard.session import materialise

MODELS = Models(("a", "b", "c"), (1.0, 4.0, 2.0))


def naive_merge(weights, has, k):
    """Merge the cheapest pair, every loss from its definition."""
    w = list(weights / weights.sum())
    p = [row / max(row.sum(), 1) for row in has]
    groups = [[i] for i in range(len(w))]

    def js(i, j):
        a, b = w[i] / (w[i] + w[j]), w[j] / (w[i] + w[j])
        mix = a * p[i] + b * p[j]

        def kl(x):
            on = x > 0
            return (x[on] * np.log2(x[on] / mix[on])).sum()

        return (w[i] + w[j]) * (a * kl(p[i]) + b * kl(p[j]))

    while len(w) > k:
        _, i, j = min((round(js(i, j), 12), i, j) for i in range(len(w)) for j in range(i + 1, len(w)))
        t = w[i] + w[j]
        p[i] = (w[i] * p[i] + w[j] * p[j]) / t
        w[i] = t
        groups[i] += groups[j]
        del w[j], p[j], groups[j]
    return {frozenset(g) for g in groups}


def shares(has):
    return has / np.maximum(has.sum(axis=1, keepdims=True), 1)


@pytest.mark.parametrize("seed", range(4))
def test_merging_follows_the_definition(seed):
    rng = np.random.default_rng(seed)
    has = (rng.random((14, 9)) < 0.45).astype(float)
    has[:, 0] = 1
    weights = rng.integers(1, 6, 14).astype(float)
    labels = dcf.merge_profiles(weights, shares(has), 4)
    got = {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)}
    assert got == naive_merge(weights, has, 4)


def test_merging_limits():
    has = np.eye(6)
    assert len(set(dcf.merge_profiles(np.ones(6), has, 10))) == 6
    assert len(set(dcf.merge_profiles(np.ones(6), has, 1))) == 1
    assert len(set(dcf.merge_profiles(np.ones(6), has, 1, tau=0.0))) == 6
    assert list(dcf.merge_profiles(np.ones(1), np.ones((1, 1)), 3)) == [0]


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    data = [
        (i, 0 if i % 3 else 1, {f"k{j}": str(rng.randint(0, 2)) for j in range(5)}, rng.randint(0, 1))
        for i in range(120)
    ]
    return spark.createDataFrame(data, "query_id long, coarse_id int, features map<string,string>, local int")


def loss_by_definition(record, cluster):
    """(1 + w) * JS of a record and a cluster of records."""
    w = len(cluster)
    a, b = 1 / (1 + w), w / (1 + w)
    x = {kv: 1 / len(record) for kv in record.items()}
    c = {}
    for r in cluster:
        for kv in r.items():
            c[kv] = c.get(kv, 0) + 1 / len(r) / w
    total = 0.0
    for kv in x.keys() | c.keys():
        p, q = x.get(kv, 0), c.get(kv, 0)
        mix = a * p + b * q
        total += (a * p * math.log2(p / mix) if p else 0) + (b * q * math.log2(q / mix) if q else 0)
    return (1 + w) * total


def test_assignment_follows_the_definition(records):
    stored = records.collect()
    probs, weights = C.profile_table(records.withColumn("n", F.lit(1)))
    got = C.assign(records.drop("local"), probs, weights).collect()
    assert len(got) == len(stored)
    by_id = {r.query_id: r for r in stored}
    for r in got:
        losses = {
            local: loss_by_definition(
                by_id[r.query_id].features,
                [s.features for s in stored if s.coarse_id == r.coarse_id and s.local == local],
            )
            for local in (0, 1)
        }
        assert math.isclose(r.loss, min(losses.values()), abs_tol=1e-9)
        assert math.isclose(losses[r.local], min(losses.values()), abs_tol=1e-9)


def test_unseen_bucket(spark, records):
    probs, weights = C.profile_table(records.withColumn("n", F.lit(1)))
    new = spark.sql("select 900L as query_id, 77 as coarse_id, map('k0', '1') as features")
    found = C.assign(new, probs, weights)
    assert found.first().local is None
    with pytest.raises(ValueError, match="no training record"):
        C.check_seen(found)


def test_record_without_features(spark, records):
    """An empty map and no map at all are the same record."""
    probs, weights = C.profile_table(records.withColumn("n", F.lit(1)))
    empty = "map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"
    both = spark.sql(f"select 901L as query_id, 0 as coarse_id, {empty} as features union all select 902L, 0, null")
    got = C.assign(both, probs, weights).collect()
    assert got[0].local == got[1].local is not None and math.isclose(got[0].loss, got[1].loss)


def test_skewed_bucket_keeps_its_exact_sample(spark):
    """One bucket holds 95% of the records."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 20 == 0, 1).otherwise(0).alias("coarse_id"), F.col("id").cast("string").alias("record_key")
    )
    order = [F.md5(F.col("record_key").cast("binary")), F.col("record_key")]
    got = top_k_salted(df, "coarse_id", order, 50, F.col("record_key")).collect()
    for bucket in (0, 1):
        keys = [r.record_key for r in df.where(F.col("coarse_id") == bucket).orderBy(*order).limit(50).collect()]
        assert sorted(r.record_key for r in got if r.coarse_id == bucket) == sorted(keys)


def test_repeated_record_is_one_unique(spark):
    df = spark.range(3000).select(
        F.col("id").alias("query_id"),
        F.lit(0).alias("coarse_id"),
        F.create_map(F.lit("a"), F.when(F.col("id") < 2990, "1").otherwise(F.col("id").cast("string"))).alias("features"),
    )
    unique = C.unique_records(df).collect()
    assert len(unique) == 11 and max(r.n for r in unique) == 2990


def test_record_key_ignores_order(spark):
    df = spark.sql("select map('a','1','b','2') as x, map('b','2','a','1') as y, map('a','2','b','1') as z")
    x, y, z = df.select(*[C.record_key(F.col(c)) for c in "xyz"]).first()
    assert x == y != z


def test_fit_and_predict(spark, records):
    df = records.select("query_id", "features")
    fitted = C.fit_clusters(df, RouterConfig(num_clusters=2, coarse_clusters=3), 120)
    got = fitted.predict(df).collect()
    assert len(got) == 120 and all(r.cluster_id is not None for r in got)
    info = fitted.info.collect()
    assert sum(r.coarse_size for r in info) == 120
    assert all(1 <= r.local_clusters <= min(2, r.unique_records) for r in info)
    top = sum(r.local_clusters for r in info)
    assert all(0 <= r.cluster_id < top for r in got)
    again = fitted.predict(df.repartition(7)).collect()
    assert {(r.query_id, r.cluster_id) for r in got} == {(r.query_id, r.cluster_id) for r in again}


def test_early_stop_keeps_more_clusters(spark, records):
    df = records.select("query_id", "features")
    fitted = C.fit_clusters(df, RouterConfig(num_clusters=1, coarse_clusters=2, cluster_tau=0.0), 120)
    assert fitted.k > 32  # nothing is merged
    assert fitted.predict(df).where("cluster_id is null").isEmpty()


def test_input_checks(spark):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, quality array<double>")
    assert C.check_inputs(good, 2) == 2
    C.check_matching(good, good)
    with pytest.raises(ValueError, match="no record"):
        C.check_inputs(good.limit(0), 2)
    with pytest.raises(ValueError, match="per model"):
        C.check_inputs(good, 3)
    with pytest.raises(ValueError, match="no quality values"):
        C.check_inputs(good.union(spark.createDataFrame([(3, None)], good.schema)), 2)
    with pytest.raises(ValueError, match="match"):
        C.check_matching(good, good.limit(1))


def test_embedding_clusters(spark):
    rng = np.random.default_rng(0)
    centres = [[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]]
    data = [(i, [float(x) for x in np.array(centres[i % 3]) + rng.normal(0, 0.3, 2)]) for i in range(60)]
    df = spark.createDataFrame(data, "query_id long, embedding array<double>")
    model = C.fit_embedding_clusters(df, 3, n_init=3)
    got = {r.query_id: r.embed_cluster for r in C.predict_embedding_clusters(df, model).collect()}
    assert all(len({got[i] for i in range(s, 60, 3)}) == 1 for s in range(3)) and len(set(got.values())) == 3
    near = df.select("query_id", C.nearest_centre(F.col("embedding"), centres).alias("c")).collect()
    assert all(r.c == r.query_id % 3 for r in near)


def test_mappings(spark):
    profile = spark.createDataFrame(
        [(0, 10, [0.2, 0.9, 0.6]), (1, 5, [0.1, 0.2, 0.2]), (3, 1, [0.5, 0.5, 0.5])],
        "cluster_id int, size long, quality array<double>",
    )
    best = {r.cluster_id: r.best_model for r in P.fill_empty(P.best_by_cost(profile, MODELS, 0.5), MODELS).collect()}
    assert best == {0: "c", 1: "b", 2: "a", 3: "a"}
    useful = {r.cluster_id: r.best_model for r in P.best_by_utility(profile, MODELS, 0.0).collect()}
    assert useful == {0: "b", 1: "b", 3: "a"}
    probs = {r.cluster_id: r.probs for r in P.min_cost_probs(profile, MODELS, 0.0, 0.5).collect()}
    assert np.allclose(probs[0], [0, 1 / 3, 2 / 3]) and probs[1] == [0.0, 1.0, 0.0]


def test_separation_is_mutual_information(spark):
    rows = [(c, "f", str(c), 1, 1.0) for c in range(4)]
    apart = spark.createDataFrame(rows, "cluster_id int, key string, value string, n long, mass double")
    assert math.isclose(P.separation(apart).first().separation, 2.0)
    same = apart.withColumn("value", F.lit("x"))
    assert P.separation(same).first().separation == 0.0


def test_dense_index_and_splits(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("query_id"))
    got = dense_index(df, ["query_id"]).collect()
    assert all(r.query_id == r.idx for r in got)
    for ratio, want in ((0.2, 800), (0.0, 1000), (1.0, 0), (0.333, 667)):
        split = exact_split(df, val_ratio=ratio)
        assert split.where("split = 'train'").count() == want, ratio
    first = {r.query_id: r.split for r in hash_split(df).collect()}
    assert first == {r.query_id: r.split for r in hash_split(df.repartition(5)).collect()}
    assert 700 < sum(s == "train" for s in first.values()) < 900


def test_profiles_count_every_record(records):
    """Also when fewer records are merged than there are, and in a single bucket."""
    df = records.select("query_id", "features")
    for buckets in (3, 1):
        fitted = C.fit_clusters(df, RouterConfig(num_clusters=2, coarse_clusters=buckets, cluster_fit_size=5), 120)
        assert fitted.weights.agg(F.sum("w")).first()[0] == 120
        assert fitted.predict(df).select("coarse_id").distinct().count() <= buckets


def plain_js(x, y, a=0.5):
    mix = {t: a * x.get(t, 0) + (1 - a) * y.get(t, 0) for t in x.keys() | y.keys()}
    return sum(a * p * math.log2(p / mix[t]) for t, p in x.items()) + sum((1 - a) * p * math.log2(p / mix[t]) for t, p in y.items() if p)


def test_losses_follow_the_definition():
    """Records of different sizes, with unknown and no features, against profiles of many shapes."""
    rng = np.random.default_rng(1)
    profiles = []
    for c in range(7):
        terms = np.sort(rng.choice(40, rng.integers(1, 20), replace=False))
        p = rng.random(len(terms))
        profiles.append((c, float(rng.integers(1, 50)), terms.astype(np.int64), p / p.sum()))
    found = dcf.Profiles(*(np.array(x) for x in list(zip(*profiles))[:2]), [p[2] for p in profiles], [p[3] for p in profiles])
    lists = [np.sort(rng.choice(60, n, replace=False)) for n in (0, 1, 3, 10, 25)]
    got = found.losses(np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]))
    for r, terms in enumerate(lists):
        own = {t: 1 / len(terms) for t in terms}
        for c, w, t, p in profiles:
            other, a = dict(zip(t, p)), 1 / (1 + w)
            want = (1 + w) * plain_js(own, other, a) if own else w * math.log2((1 + w) / w)
            assert math.isclose(got[r, c], want, abs_tol=1e-9)


def test_nearest_of_many_profiles_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dcf, "PART_ROWS", 50)
    monkeypatch.setattr(dcf, "_BLOCK", 64)
    rng = random.Random(6)
    data = [(str(i), 0 if i < 200 else i % 3, sorted(rng.sample(range(50), rng.randint(0, 9)))) for i in range(300)]
    records = spark.createDataFrame(data, "record_key string, bucket int, terms array<long>")
    sides = [(b, c, float(1 + c), t, [1 / len(t)] * len(t)) for b in (0, 1) for c in range(9) for t in [rng.sample(range(50), 8)]]
    got = dcf.nearest(records, spark.createDataFrame(sides, dcf.PROFILES)).collect()
    assert len(got) == 300 and all((r.local is None) == (r.bucket == 2) for r in got)
    for r in got:
        if r.bucket == 2:
            continue
        losses = {}
        for b, c, w, t, p in sides:
            if b == r.bucket:
                own = {x: 1 / len(r.terms) for x in r.terms}
                losses[c] = (1 + w) * plain_js(own, dict(zip(t, p)), 1 / (1 + w)) if own else w * math.log2((1 + w) / w)
        assert math.isclose(r.loss, min(losses.values()), abs_tol=1e-9) and losses[r.local] < min(losses.values()) + 1e-9


def test_assignment_shuffles_no_row_per_feature_and_cluster(records):
    probs, weights = (materialise(t, "test") for t in C.profile_table(records.withColumn("n", F.lit(1))))
    plan = C.assign(records.drop("local"), probs, weights)._jdf.queryExecution().optimizedPlan().toString()
    # The profiles' copies are dealt out by a sequence; features are never exploded.
    assert "explode(features" not in plan and plan.count("explode") == plan.count("explode(sequence")


@pytest.mark.parametrize("size", [4, 1000])
def test_every_record_is_in_a_summary(spark, size):
    """A record that holds a third of the rows begins a summary; the fit ignores partitioning."""
    rng = random.Random(8)
    rows = [(i, {"a": "hot", "b": "hot"} if i % 3 == 0 else {"a": str(rng.randint(0, 30)), "b": str(rng.randint(0, 30))}) for i in range(600)]
    df = spark.createDataFrame(rows, "query_id long, features map<string,string>")
    placed = C.different(df).withColumn("bucket", F.lit(0)).persist()
    whole, members = C.summarise(placed, size)
    assert whole.agg(F.sum("n")).first()[0] == 600 and members.count() == placed.count()
    assert members.select("summary").distinct().count() == min(size, placed.count())
    hot = placed.where("n = 200").first().record_key
    assert not C.first_summaries(placed, size).where(F.col("record_key") == hot).isEmpty()
    config = RouterConfig(num_clusters=3, coarse_clusters=2, cluster_fit_size=size)
    labels = [{r.query_id: r.cluster_id for r in C.fit_clusters(d, config, 600).predict(d).collect()} for d in (df, df.repartition(5))]
    assert labels[0] == labels[1]


def test_ends_of_merging_are_exact(spark, records):
    df = records.select("query_id", "features")
    kinds = {tuple(sorted(r.features.items())) for r in df.collect()}
    whole = C.fit_clusters(df, RouterConfig(num_clusters=1, coarse_clusters=1, cluster_fit_size=7), 120)
    counts = {(r.key, r.value): r.p for r in whole.feature_probs.collect()}
    seen = [kv for r in df.collect() for kv in r.features.items()]
    assert counts.keys() == set(seen) and all(math.isclose(p, seen.count(kv) / 600) for kv, p in counts.items())
    each = C.fit_clusters(df, RouterConfig(num_clusters=500, coarse_clusters=1, cluster_fit_size=7), 120)
    assert each.k == len(kinds) and each.weights.count() == len(kinds)


def test_centres_find_separate_groups(spark):
    """Mini-batches smaller than the table, few iterations; the same centres for the same seed."""
    rows = [(i, {f"k{j}": str(i % 4) for j in range(6)} | {"own": str(i % 60)}) for i in range(400)]
    df = spark.createDataFrame(rows, "query_id long, features map<string,string>")
    records = C.different(df).persist()
    for batch, turns in ((16, 200), (5, 2)):
        config = RouterConfig(coarse_batch_size=batch, coarse_max_iter=turns)
        centres = C.fit_coarse(records, 4, config)
        again = C.fit_coarse(records.repartition(5), 4, config)
        assert sorted(map(str, centres.collect())) == sorted(map(str, again.collect()))
    centres = C.fit_coarse(records, 4, RouterConfig(coarse_batch_size=16))
    found = C.FittedClusters(1, centres, None, None, None, None).coarse_ids(df).collect()
    groups = {r.query_id % 4: r.coarse_id for r in found}
    assert len(set(groups.values())) == 4 and all(r.coarse_id == groups[r.query_id % 4] for r in found)


def test_records_of_one_bucket_go_to_several_tasks(spark):
    features = "map('a', cast(id % 7 as string), 'b', cast(id as string))"
    records = spark.range(10000).selectExpr("0 as bucket", "cast(id as string) as record_key", f"{features} as features")
    records = records.select("bucket", "record_key", dcf.terms_of(F.col("features")).alias("terms"))
    profiles = spark.createDataFrame([(0, 0, 1.0, [5], [1.0]), (0, 1, 1.0, [6], [1.0])], dcf.PROFILES)
    found = dcf.nearest(records, profiles).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 10000
    assert len(found) > 1


def test_losses_of_records_do_not_depend_on_their_company():
    r = np.random.default_rng(3)
    known = [np.sort(r.choice(60, 20, replace=False)) for _ in range(9)]
    profiles = dcf.Profiles(np.arange(9), np.arange(1.0, 10.0), known, [np.full(20, 0.05)] * 9)
    own = [np.sort(r.choice(80, n, replace=False)) for n in (0, 1, 5, 5, 30, 5)]
    together = profiles.losses(np.concatenate(own), np.array([len(o) for o in own]))
    for row, terms in zip(together, own, strict=True):
        assert (profiles.losses(terms, np.array([len(terms)])) == row).all()
        for loss, there, w in zip(row, known, profiles.w, strict=True):
            p, q = (np.isin(np.arange(80), t) / max(1, len(t)) for t in (terms, there))
            a, b = 1 / (1 + w), w / (1 + w)
            entropy = [-dcf.plogp(x).sum() for x in (a * p + b * q, p, q)]
            if len(terms):
                assert abs(loss - (1 + w) * (entropy[0] - a * entropy[1] - b * entropy[2])) < 1e-9


def test_rows_stored_with_their_keys_are_not_stored_again(spark, monkeypatch):
    """A training job stored every feature map a second time before it clustered them."""
    from switchyard.catalog import routing as R
    from switchyard.operators import routing
    from switchyard.plans import train
    from __spark_entry__ import SMOKE_DIR

    names = []
    monkeypatch.setattr(routing, "materialise", lambda df, name, own=routing.materialise: names.append(name) or own(df, name))
    items = train.prepare_items(R.items(spark, SMOKE_DIR), R.CONFIG)
    assert set(C.KEYS) <= set(items.columns)
    made = routing.cluster_training(items, R.MODELS, R.CONFIG)
    assert "keyed" not in names and made.rows.count() == items.count()
