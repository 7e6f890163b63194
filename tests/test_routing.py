"""Sources, sinks and the whole fit on a handful of queries."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from switchyard.config import RouterConfig
from switchyard.models import Models
from switchyard.operators import routing, split
from switchyard.operators.routing import Router, fit_router, manifests
from switchyard.plans.grid import RESULTS, configs, grid_search, search_and_refit
from switchyard.plans.train import log_run, train_and_evaluate
from switchyard.sources import benchmark as B
from switchyard.sources import requests as R
from switchyard.sources import runs
from switchyard.streaming.route import read_queries, route_stream

MODELS = Models(("alpha", "beta", "gamma", "delta", "omega"), (0.004, 0.02, 0.011, 0.0007, 0.006))
TEXTS = [
    ("Convert 37 degrees to Fahrenheit, step by step.", {"area": "physics", "style": "plain"}),
    ("Schreibe ein kurzes Gedicht über den Herbst!", {"area": "poetry", "style": "free"}),
    ("def area(r): return 3.14 * r * r  # why is it wrong?", {"area": "code", "style": "plain"}),
    ("日本で一番高い山は？", {"area": "geography", "style": "plain"}),
    ("Summarise https://example.org/report in two lines", {"area": "news", "style": "short"}),
    ("", {"area": "code"}),
]
CONFIG = RouterConfig(num_clusters=2, utility_beta=0.2, embedding_dim=24, fit_iterations=12)


@pytest.fixture(scope="module")
def items(spark):
    # Only "beta" answers the third, nobody the last, everyone the fifth.
    right = ["abd", "bg", "b", "abgo", "abgdo", ""]
    quality = [[1.0 if n[0] in r else 0.0 for n in MODELS.names] for r in right]
    data = [(i, t, f, quality[i]) for i, (t, f) in enumerate(TEXTS)]
    return spark.createDataFrame(data, "query_id long, text string, features map<string,string>, quality array<double>")


@pytest.fixture(scope="module")
def router(items):
    return fit_router(items, MODELS, CONFIG)


def test_train_and_predict(spark, router):
    query = spark.createDataFrame(
        [(9, "How many litres are in a gallon?", {"area": "physics", "tone": "new"})],
        "query_id long, text string, features map<string,string>",
    )
    row = router.route(query).first()
    assert row.model in MODELS.names and 0 <= row.prob <= 1 and 0 <= row.pred < 5
    assert abs(sum(row.probs) - 1) < 1e-9 and row.probs[row.pred] == row.prob


def test_fit_beats_uniform(items, router):
    """On its own training rows the classifier follows the targets."""
    rows = {r.query_id: r for r in router.route(items).collect()}
    assert rows[2].pred == 1
    assert max(rows[2].probs) > 0.2


def test_save_and_load(spark, items, router, tmp_path):
    router.save(str(tmp_path / "router"))
    again = Router.load(spark, str(tmp_path / "router"))
    assert again.models == MODELS and again.config == CONFIG
    before = {r.query_id: r.probs for r in router.route(items).collect()}
    after = {r.query_id: r.probs for r in again.route(items).collect()}
    assert before == after


def test_router_with_hidden_layers(spark, items, tmp_path):
    """The network takes the regression's place: fitted, stored, read again, answering the same."""
    config = replace(CONFIG, hidden_units=(16, 8))
    router = fit_router(items, MODELS, config)
    router.save(str(tmp_path / "router"))
    again = Router.load(spark, str(tmp_path / "router"))
    assert again.config == config and again.network.sizes[1:] == [16, 8, 5]
    before = {r.query_id: r for r in router.route(items).collect()}
    after = {r.query_id: r for r in again.route(items).collect()}
    assert before == after and before[2].pred == 1
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in before.values())


def test_a_broken_save_leaves_the_version_before(spark, items, router, tmp_path, monkeypatch):
    """Readers see a version when its manifest is there, not before; older ones stay."""
    path = str(tmp_path / "router")
    with pytest.raises(ValueError, match="no complete router"):
        Router.load(spark, path)
    router.save(path)
    changed = replace(router, low=[x - 1 for x in router.low])

    class Lost(Exception):
        pass

    def broken(self, spark):
        raise Lost

    with monkeypatch.context() as patch:
        patch.setattr(Models, "frame", broken)
        with pytest.raises(Lost):
            changed.save(path)
    assert Router.load(spark, path).low == router.low
    changed.save(path)
    assert Router.load(spark, path).low == changed.low and Router.load(spark, path, 1).low == router.low
    assert sorted(r["number"] for r in manifests(spark, path)) == [1, 2]


def test_stream_answers_equal_batch(spark, items, router, tmp_path):
    inbox = str(tmp_path / "inbox")
    items.select("query_id", "text", "features").write.json(inbox)
    route_stream(read_queries(spark, inbox), router, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r.query_id: (r.model_index, round(r.probability, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.query_id: (r.pred, round(r.prob, 9)) for r in router.route(items).collect()}
    assert got == want
    # A second run finds nothing new.
    route_stream(read_queries(spark, inbox), router, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TEXTS)


def test_embedding_clusters_and_given_embeddings(spark, items):
    given = items.withColumn("embedding", F.when(F.col("query_id") < 3, F.array(*[F.lit(float(i)) for i in range(8)])))
    config = RouterConfig(num_clusters=2, embedding_dim=8, embed_k=2, objective="min_cost", quality_threshold=0.6, fit_iterations=5)
    router = fit_router(given, MODELS, config)
    row = router.route(given).first()
    assert row.features["embed_cluster_2"] in ("0", "1")


@pytest.fixture(scope="module")
def wide(spark):
    data = [
        (i, f"question {i} " + "word " * (i % 9), f"set{i % 2}", float(i % 2), float(i % 3 > 0), 0.1, None if i % 5 == 0 else 0.4, ("m|x", "n", "other", None)[i % 4])
        for i in range(60)
    ]
    schema = "query_id long, prompt string, eval_name string, `m` double, `n` double, `m|total_cost` double, `n|total_cost` double, oracle_model_to_route_to string"
    df = spark.createDataFrame(data, schema)
    return df.withColumn(B.ORACLE, F.when(F.col(B.ORACLE) == "m|x", "m").otherwise(F.col(B.ORACLE)))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, wide, tmp_path, fmt):
    path = str(tmp_path / fmt)
    writer = wide.write.option("header", "true").option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)
    df = B.read_wide(spark, path, fmt)
    models = B.collect_models(df)
    assert models.names == ("m", "n") and abs(models.costs[1] - 0.4 * 48 / 60) < 1e-12
    rows = {r.query_id: r for r in B.to_items(df).collect()}
    assert rows[0].costs == [0.1, None] and rows[0].label == 0 and rows[1].label == 1
    assert rows[2].label is None and rows[3].label is None and rows[4].features == {"eval": "set0"}


def test_csv_with_schema(spark, wide, tmp_path):
    path = str(tmp_path / "csv")
    wide.write.option("header", "true").csv(path)
    ddl = ", ".join(f"`{n}` {t}" for n, t in wide.dtypes)
    assert B.read_wide(spark, path, "csv", schema=ddl).count() == 60


def test_usable_columns(spark, wide):
    items = B.to_items(wide)
    assert B.completeness(items).first().asDict() == {"n_rows": 60, "has_label": False, "has_quality": True, "has_costs": True}
    assert B.usable(items).where("label is not null").isEmpty()


def test_requests(spark, tmp_path):
    request = {
        "request_id": 5,
        "items": [{"text": "a", "features": {"k": "v"}}, {"text": None}],
        "model_names": ["x", "y"],
        "model_costs": [1.0, 2.0],
        "num_clusters": 4,
    }
    (tmp_path / "r.json").write_text(json.dumps(request))
    requests = R.read_requests(spark, str(tmp_path / "r.json"))
    assert [(r.pos, r.text, r.features) for r in R.request_items(requests).orderBy("pos").collect()] == [(0, "a", {"k": "v"}), (1, "", {})]
    assert [(r.model, r.model_cost) for r in R.request_models(requests).orderBy("model_idx").collect()] == [("x", 1.0), ("y", 2.0)]
    assert requests.first().num_clusters == 4


def test_train_evaluate_and_log(spark, wide, tmp_path):
    models = B.collect_models(wide)
    config = RouterConfig(num_clusters=2, coarse_clusters=2, embedding_dim=16, fit_iterations=5)
    trained = train_and_evaluate(B.to_items(wide), models, config, val_ratio=0.25)
    assert trained.predictions.count() == 15
    path = str(tmp_path)
    log_run(trained, path, "run-1")
    found = {r.metric: r for r in runs.metrics_or_not_found(spark, f"{path}/metrics", "run-1").collect()}
    assert found["n_all"].value == 15 and found["config.num_clusters"].text == "2"
    missing = runs.metrics_or_not_found(spark, f"{path}/metrics", "run-2").collect()
    assert [(r.metric, r.text) for r in missing] == [("error", "not_found")]
    schema = trained.tables["frontier_points"].schema
    assert runs.read_table(spark, f"{path}/report", "frontier_points", "run-1", schema).count() == 51
    details = runs.read_table(spark, f"{path}/clusters", "details", "run-1", trained.router.cluster_details.schema)
    assert details.agg(F.sum("size")).first()[0] == 45


def test_grid_search(spark, wide):
    base = RouterConfig(num_clusters=2, coarse_clusters=2, embedding_dim=16, fit_iterations=3)
    results, grid = grid_search(B.to_items(wide), B.collect_models(wide), configs(base, [0.3], [0.2, 0.9], clusters=[2]))
    found = results.collect()
    assert len(found) == len(grid) == 2
    assert [r.avg_cost for r in found] == sorted(r.avg_cost for r in found)


def test_search_shares_clusters_and_stores_what_it_finds(spark, wide, tmp_path, monkeypatch):
    """Nine points of one clustering; the same results one at a time; best and router stored."""
    base = RouterConfig(num_clusters=2, coarse_clusters=2, embedding_dim=8, fit_iterations=3, use_query_features=False)
    grid = configs(base, [0.2, 0.5, 0.8], [0.4, 0.6, 0.8], clusters=[2])
    made = []
    whole = routing.cluster_training
    monkeypatch.setattr(routing, "cluster_training", lambda *a: made.append(1) or whole(*a))
    items, models, path = B.to_items(wide), B.collect_models(wide), str(tmp_path / "search")
    results, chosen = search_and_refit(items, models, grid, path, "g")
    assert len(made) == 2 and results.count() == 9  # one for the search, one for the refit on all rows
    alone, _ = grid_search(items, models, grid[:3], parallel=1)
    together = {r.config: (r.avg_cost, r.top1_acc) for r in results.collect()}
    assert all(together[r.config] == (r.avg_cost, r.top1_acc) for r in alone.collect())
    stored = runs.read_table(spark, f"{path}/grid", "best", "g", RESULTS).first()
    assert grid[stored["config"]] == chosen == Router.load(spark, f"{path}/router").config


@pytest.mark.parametrize(("dims", "made"), [((8, 8), 1), ((8, 12), 2)])
def test_search_and_refit_read_the_same_features(spark, wide, tmp_path, monkeypatch, dims, made):
    """Features are derived once for the search and the fit on all rows, unless the best setting has others."""
    base = RouterConfig(num_clusters=2, coarse_clusters=2, fit_iterations=3, use_query_features=False)
    grid = [replace(base, embedding_dim=d) for d in dims]
    derived = []
    whole = routing._prepare
    monkeypatch.setattr(routing, "_prepare", lambda df, config: derived.append(config.embedding_dim) or whole(df, config))
    monkeypatch.setattr("switchyard.plans.grid.best", lambda results: results.where("config = 1"))
    items, models, path = B.to_items(wide), B.collect_models(wide), str(tmp_path / "search")
    _, chosen = search_and_refit(items, models, grid, path, "g")
    assert chosen == grid[1] and derived == list(dims)[:made]
    stored, alone = Router.load(spark, f"{path}/router"), fit_router(items, models, chosen)
    answers = [{r.query_id: (r.model, round(r.prob, 9)) for r in x.route(items).collect()} for x in (stored, alone)]
    assert answers[0] == answers[1]


def test_choose_among_own_models(spark):
    rows = [
        (1, ["b", "c"], [1.0, 2.0]),
        (2, ["c", "new", "a"], [1.0, 0.1, 3.0]),
        (3, ["new", "newer"], [2.0, 1.0]),
        (4, ["new", "newer"], None),
        (5, [], []),
        (6, None, None),
        (7, ["d", "e"], [1.0, 1.0]),
        (8, ["z"], [None]),
    ]
    df = spark.createDataFrame(rows, "request_id int, model_names array<string>, model_costs array<double>")
    probs = df.withColumn("probs", F.array(*[F.lit(p) for p in (0.1, 0.2, 0.3, 0.2, 0.2)]))
    got = {r.request_id: (r.model_name, r.probability and round(r.probability, 9)) for r in R.choose(probs, list("abcde")).collect()}
    assert got == {
        1: ("c", 0.6), 2: ("c", 0.75), 3: ("newer", None), 4: ("new", None), 5: (None, None), 6: (None, None), 7: ("d", 0.5), 8: ("z", None),
    }


def test_metric_rows_csv(spark, tmp_path):
    row = spark.sql("select 1.5d as avg_cost, 'a' as best_name")
    runs.log_metrics(runs.metric_rows(row, "r"), str(tmp_path / "m"), "csv")
    got = {r.metric: (r.value, r.text) for r in runs.metrics_of(spark, str(tmp_path / "m"), "r", "csv").collect()}
    assert got == {"avg_cost": (1.5, None), "best_name": (None, "a")}


@pytest.mark.parametrize(("few", "ratio"), [(1000, 0.2), (3, 0.2), (1, 0.5), (1000, 1.0)])
def test_exact_split_counts(spark, monkeypatch, few, ratio):
    """However far the histogram is refined; repeated ids stay together."""
    monkeypatch.setattr(split, "_FEW", few)
    df = spark.range(500).select(F.col("id").alias("query_id"))
    parts = split.exact_split(df, val_ratio=ratio).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts}.get("train", 0) == int(500 * (1 - ratio))
    same = spark.range(90).select((F.col("id") % 3).alias("query_id"))
    sides = split.exact_split(same, val_ratio=0.4).distinct().groupBy("query_id").count().collect()
    assert all(r["count"] == 1 for r in sides)


def test_keys_of_a_fit_are_made_once(spark, items, monkeypatch):
    """Record keys sort whole feature maps: the fit stores them once, and its rows take the clusters of
    their records as ``predict`` gives them."""
    config, plans = replace(CONFIG, cluster_fit_size=3), []
    written = routing.materialise

    def stored(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("md5(")))
        return written(df, name)

    for module in (routing, routing.C, routing.P, routing.X):
        monkeypatch.setattr(module, "materialise", stored)
    prepared = written(routing.prepare(items, config).select("query_id", "features", "embedding", "quality"), "prepared")
    found = routing.cluster_training(prepared, MODELS, config)
    assert [name for name, keys in plans if keys] == ["keyed"]
    fitted = routing.C.fit_clusters(prepared.select("query_id", "features"), config, len(TEXTS))
    want = {(r.query_id, r.coarse_id, r.cluster_id) for r in fitted.predict(prepared.select("query_id", "features")).collect()}
    assert {(r.query_id, r.coarse_id, r.cluster_id) for r in found.rows.collect()} == want
