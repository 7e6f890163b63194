"""F: fit, route, search; A15, A16."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard import derived as D
from switchyard.catalog import targets as _targets
from switchyard.catalog.registry import M, VIEWS, query, r9, sql
from switchyard.config import RouterConfig
from switchyard.operators import network as N
from switchyard.operators import softmax as W
from switchyard.operators.routing import Router
from switchyard.plans import grid as X
from switchyard.plans.train import Trained, refit, train_and_evaluate
from switchyard.session import scratch_path
from switchyard.sources import benchmark as B
from switchyard.sources import requests as R
from switchyard.sources import runs
from switchyard.streaming.route import answer_requests, answer_stream, answers, read_queries, request_stream, route_stream

MODELS = D.MODELS
CONFIG = RouterConfig(num_clusters=2, coarse_clusters=6, cluster_fit_size=300, embedding_dim=64, fit_iterations=30)

_trained: dict[tuple[str, str], Trained] = {}


def items(spark, sf_dir):
    return B.to_items(D.wide(spark, sf_dir))


def trained(spark, sf_dir) -> Trained:
    """One training job on all documents, shared by the queries below."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        wide = D.wide(spark, sf_dir)
        _trained[key] = train_and_evaluate(B.to_items(wide), B.collect_models(wide), CONFIG)
    return _trained[key]


def _answers(routed):
    return answers(routed).withColumn("probability", r9("probability"))


@query("f01_validation_probs")
def validation_probs(spark, sf_dir):
    """Model probabilities of the fitted classifier on the validation part."""
    found = trained(spark, sf_dir).predictions
    return found.select("query_id", F.posexplode("probs").alias("model_idx", "prob"), "label")


@query("f03_batch_routing")
def batch_routing(spark, sf_dir):
    return _answers(trained(spark, sf_dir).router.route(items(spark, sf_dir)))


@query("f04_stream_routing")
def stream_routing(spark, sf_dir):
    """All documents arrive as JSON files and are answered by a stream."""
    inbox, out, log = (scratch_path(spark, n) for n in ("inbox", "answers", "stream-log"))
    items(spark, sf_dir).select("query_id", "text", "features").write.json(inbox)
    stream = route_stream(read_queries(spark, inbox), trained(spark, sf_dir).router, out, log)
    stream.awaitTermination()
    return spark.read.parquet(out).drop("batch").withColumn("probability", r9("probability"))


@query("f05_train_and_evaluate")
def train_and_eval(spark, sf_dir):
    return runs.metric_rows(trained(spark, sf_dir).metrics, "run-1")


# Graded quality: the label comes from the yes-or-no one, so settings can miss it.
VIEWS["x_graded"] = (
    ("f_obs", "f_queries", "f_models"),
    "select o.*, ((o.query_id*31 + o.model_idx*17 + q.n_chars) % 10 + m.skill) / 20.0e0 as graded "
    "from f_obs o join f_queries q using (query_id) join f_models m using (model_idx)",
)
VIEWS["x_grid"] = (
    ("x_graded", "s_cluster", "f_labels", "f_models"),
    "select point, threshold, alpha, avg(cost) as avg_cost, avg(case when label is null then null when model_idx = label "
    "then 1.0e0 else 0.0e0 end) as top1_acc from (select *, row_number() over (partition by point, query_id "
    "order by round(target, 9) desc, model_idx) as rk from (select g.point, g.threshold, g.alpha, o.query_id, o.model_idx, o.cost, l.label, "
    "0.5e0 * o.e / sum(o.e) over w + (1 - 0.5e0) * (0.5e0 * c.soft + (1 - 0.5e0) * case when sum(o.w) over w > 0 then "
    "o.w / sum(o.w) over w when o.model_idx = 0 then 1.0e0 else 0.0e0 end) as target from "
    "(select i * 3 + j as point, t.threshold, a.alpha from (values (0, 0.4e0), (1, 0.6e0), (2, 0.8e0)) t(i, threshold), "
    "(values (0, 0.2e0), (1, 0.5e0), (2, 0.8e0)) a(j, alpha)) g cross join lateral "
    "(select *, exp((graded - g.alpha * price / 0.03e0) / 0.5e0) as e, case when graded >= g.threshold then 1 / price "
    "else 0 end as w from x_graded) o join s_cluster c using (query_id, model_idx) join f_labels l using (query_id) "
    "window w as (partition by g.point, o.query_id)) z) y where rk = 1 group by 1, 2, 3",
)


def target_grid(spark, sf_dir):
    graded = [((F.col("query_id") * 31 + i * 17 + F.col("n_chars")) % 10 + skill) / F.lit(20.0) for i, (*_, skill) in enumerate(D.SPEC)]
    df = _targets.with_cluster_soft(spark, sf_dir).withColumn("quality", F.array(*graded))
    found = X.target_grid(df, MODELS, [0.4, 0.6, 0.8], [0.2, 0.5, 0.8], [0.5], [0.5], [0.5])
    return found.select(
        "point", "threshold", "alpha", r9("avg_cost").alias("avg_cost"), r9("top1_acc").alias("top1_acc")
    )


_GRID = "select point, threshold, alpha, round(avg_cost, 9) as avg_cost, round(top1_acc, 9) as top1_acc from x_grid"


@query("f06_target_grid", sql(_GRID, "x_grid"))
def grid_of_targets(spark, sf_dir):
    return target_grid(spark, sf_dir)


_searched: dict[tuple[str, str], tuple] = {}


def searched(spark, sf_dir):
    """(path, clusterings): one grid search with stored results, best setting and refit router."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _searched:
        wide, path, shared = D.wide(spark, sf_dir), scratch_path(spark, "search"), {}
        grid = X.configs(CONFIG, lambdas=[0.5], thresholds=[0.4, 0.8], clusters=[2], fusion_betas=[None])
        X.search_and_refit(B.to_items(wide), B.collect_models(wide), grid, path, "grid-1", shared=shared)
        _searched[key] = path, len(shared)
    return _searched[key]


@query("f06_grid_search")
def grid_search(spark, sf_dir):
    """Two settings, each fitted and evaluated on the same stored features and clusters; the stored results."""
    path, _ = searched(spark, sf_dir)
    return runs.read_table(spark, f"{path}/grid", "all_results", "grid-1", X.RESULTS)


@query(
    "f06_stored_search",
    "select 2 as n_points, 1 as n_clusterings, true as best_is_first, true as all_answered from (select count(*) from documents) d",
)
def stored_search(spark, sf_dir):
    """What a search leaves behind: every point, one clustering for all of them, a best point that no
    other precedes, and a router fitted with it that answers every query."""
    path, clusterings = searched(spark, sf_dir)
    results = runs.read_table(spark, f"{path}/grid", "all_results", "grid-1", X.RESULTS)
    chosen = runs.read_table(spark, f"{path}/grid", "best", "grid-1", X.RESULTS).first()  # one row
    ahead = (F.col("avg_cost") < chosen["avg_cost"]) | ((F.col("avg_cost") == chosen["avg_cost"]) & (F.col("top1_acc") > chosen["top1_acc"]))
    router = Router.load(spark, f"{path}/router")
    fitted_so = router.config.quality_threshold == chosen["quality_threshold"]
    given = items(spark, sf_dir)
    answered = _answers(router.route(given)).where("model_name is not null").count() == given.count()
    return results.agg(
        F.count("*").alias("n_points"),
        F.lit(clusterings).alias("n_clusterings"),
        (~F.max(ahead) & F.lit(fitted_so)).alias("best_is_first"),
        F.lit(answered).alias("all_answered"),
    )


@query(
    "f07_best_setting",
    sql(f"select * from ({_GRID}) g order by avg_cost, top1_acc desc, point limit 1", "x_grid"),
)
def best_setting(spark, sf_dir):
    return X.rank(target_grid(spark, sf_dir)).limit(1)


@query("a15_grid_results", sql(_GRID, "x_grid"))
def grid_results(spark, sf_dir):
    """All grid results and the best one, written as JSON and read back."""
    path = scratch_path(spark, "grid")
    results = target_grid(spark, sf_dir)
    runs.write_tables({"all_results": results, "best": X.best(results)}, path, "grid-1")
    return runs.read_table(spark, path, "all_results", "grid-1", results.schema).select(*results.columns)


@query("f08_refit_on_all")
def refit_on_all(spark, sf_dir):
    """Fitted on every document, stored, loaded and applied."""
    path = scratch_path(spark, "router")
    wide = D.wide(spark, sf_dir)
    given = B.to_items(wide)
    refit(given, B.collect_models(wide), CONFIG, path)
    return _answers(Router.load(spark, path).route(given))


@query("a16_reloaded_router")
def reloaded_router(spark, sf_dir):
    """Every stored answer beside the reloaded router's."""
    path = scratch_path(spark, "router")
    fitted = trained(spark, sf_dir).router
    fitted.save(path)
    given = items(spark, sf_dir)
    before = _answers(fitted.route(given)).select("query_id", "model_name", "probability")
    after = _answers(Router.load(spark, path).route(given)).select(
        "query_id", F.col("model_name").alias("reloaded_name"), F.col("probability").alias("reloaded_probability")
    )
    return before.join(after, "query_id")


# --- properties that hold whatever the model has learned -------------------------------

VIEWS["x_validation"] = (
    ("f_queries", "f_labels"),
    "select s.query_id, l.label from (select query_id, row_number() over (order by md5('42:' || query_id), query_id) as rn, "
    "floor((select count(*) from f_queries) * (1.0e0 - 0.2e0)) as k from f_queries) s join f_labels l using (query_id) "
    "where s.rn > s.k",
)


@query("f01_validation_rows", sql("select query_id, label, true as is_distribution from x_validation", "x_validation"))
def validation_rows(spark, sf_dir):
    """The rows that were held out, their labels, and whether their answers are distributions."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    inside = F.forall("probs", lambda p: (p >= 0) & (p <= 1)) & (F.size("probs") == M) & (F.abs(total - 1) < 1e-9)
    return trained(spark, sf_dir).predictions.select("query_id", "label", inside.alias("is_distribution"))


@query(
    "f05_row_counts",
    sql("select count(*) as n_all, count(label) as n_labelled from x_validation", "x_validation"),
)
def row_counts(spark, sf_dir):
    metrics = trained(spark, sf_dir).metrics
    return metrics.select(*[F.col(c).cast("bigint").alias(c) for c in ("n_all", "n_labelled")])


def _same(left, right):
    """Per query: whether two tables of answers name the same model with the same probability."""
    other = right.select(
        "query_id", F.col("model_name").alias("other_name"), F.col("probability").alias("other_probability")
    )
    equal = (F.col("model_name") == F.col("other_name")) & (F.abs(F.col("probability") - F.col("other_probability")) < 1e-9)
    return left.join(other, "query_id", "full").select("query_id", F.coalesce(equal, F.lit(False)).alias("same"))


@query("f04_stream_equals_batch", sql("select query_id, true as same from f_queries", "f_queries"))
def stream_equals_batch(spark, sf_dir):
    return _same(stream_routing(spark, sf_dir), batch_routing(spark, sf_dir))


@query("a16_reloaded_equals_fitted", sql("select query_id, true as same from f_queries", "f_queries"))
def reloaded_equals_fitted(spark, sf_dir):
    path = scratch_path(spark, "router")
    trained(spark, sf_dir).router.save(path)
    return _same(_answers(Router.load(spark, path).route(items(spark, sf_dir))), batch_routing(spark, sf_dir))


@query("f03_answers", sql("select query_id, true as is_answer from f_queries", "f_queries"))
def every_query_answered(spark, sf_dir):
    """A known model and a share that is the largest of as many as there are models."""
    fine = F.col("model_name").isin(list(MODELS.names)) & F.col("probability").between(1.0 / M - 1e-9, 1.0)
    return batch_routing(spark, sf_dir).select("query_id", fine.alias("is_answer"))


@query(
    "f05_beats_fixed",
    "select true as beats_best_fixed, true as beats_uniform from (select count(*) from documents) d",
)
def beats_fixed(spark, sf_dir):
    """On held-out rows the chosen models are worth more than any single one, counted as the target
    does (quality less the weighted share of the highest price), and the probabilities lie on
    right models more than equal ones would."""
    found = trained(spark, sf_dir).predictions
    prices = [CONFIG.cost_weight * c / MODELS.max_cost for c in MODELS.costs]
    worth = found.select("pred", "probs", "quality", F.array(*[F.get("quality", F.lit(i)) - p for i, p in enumerate(prices)]).alias("worth"))
    fixed = F.array(*[F.avg(F.get("worth", F.lit(i))) for i in range(M)])
    weighted = F.aggregate(F.zip_with("probs", "quality", lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x)
    equal = F.aggregate("quality", F.lit(0.0), lambda a, x: a + x) / M
    seen = worth.agg(F.avg(F.get("worth", F.col("pred"))).alias("own"), fixed.alias("fixed"), F.avg(weighted).alias("mass"), F.avg(equal).alias("equal"))
    return seen.select((F.col("own") > F.array_max("fixed")).alias("beats_best_fixed"), (F.col("mass") > F.col("equal")).alias("beats_uniform"))


@query(
    "f01_hidden_layers",
    "select count(*) as n, true as beats_regression, true as beats_constant from embeddings where vec_id % 5 = 0",
)
def hidden_layers(spark, sf_dir):
    """Held-out divergence of a network and of a regression where the target is whether two components
    of a vector agree in sign, which no linear model shows; a constant answer is (1/2, 1/2)."""
    vectors = D.table(spark, sf_dir, "embeddings").where("vec_id is not null")
    dims = 4
    dense = F.transform(F.slice("embedding", 1, dims), lambda x: 8.0 * F.coalesce(x.cast("double"), F.lit(0.0)))
    share = F.when((F.get("dense", F.lit(0)) > 0) == (F.get("dense", F.lit(1)) > 0), 0.9).otherwise(0.1)
    rows = vectors.select(F.col("vec_id").alias("query_id"), F.array().cast("array<bigint>").alias("terms"), dense.alias("dense"))
    rows = rows.withColumn("target", F.array(share, 1 - share))
    train, held = rows.where("query_id % 5 <> 0"), rows.where("query_id % 5 = 0")
    network = N.fit(train, dims, 2, hidden=(32, 16))
    weights = sorted(W.fit(train, dims, 2, 50).collect(), key=lambda r: r["term"])  # dims + 1 rows
    none = F.array(F.lit(0.0), F.lit(0.0))
    answered = held.withColumns(
        {
            "deep": network.probabilities(F.col("terms"), F.col("dense")),
            "linear": W.probabilities(F.col("dense"), F.lit(0), none, [list(r["w"]) for r in weights], (1.0, 1.0)),
            "constant": F.array(F.lit(0.5), F.lit(0.5)),
        }
    )

    def apart(probs):
        each = F.zip_with("target", probs, lambda t, p: t * (F.log(t) - F.log(p)))
        return F.avg(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))

    found = answered.agg(F.count(F.lit(1)).alias("n"), *[apart(c).alias(c) for c in ("deep", "linear", "constant")])
    return found.select("n", (F.col("deep") < F.col("linear")).alias("beats_regression"), (F.col("deep") < F.col("constant")).alias("beats_constant"))


_RECOUNTED = ("avg_cost", "avg_quality", "oracle_quality", "top1_acc")


@query(
    "f05_metrics_recounted",
    "select unnest(['avg_cost', 'avg_quality', 'oracle_quality', 'top1_acc']) as metric, true as same from (select count(*) from documents) d",
)
def metrics_recounted(spark, sf_dir):
    """Metrics of the job beside a plain count over its stored predictions."""
    job = trained(spark, sf_dir)
    chosen = F.coalesce(F.get("cost", F.col("pred")), job.router.models.cost_of(F.col("pred")))
    labelled = F.col("label").isNotNull()
    counted = job.predictions.agg(
        F.avg(chosen).alias("avg_cost"),
        F.avg(F.get("quality", F.col("pred"))).alias("avg_quality"),
        F.avg(F.array_max("quality")).alias("oracle_quality"),
        F.avg(F.when(labelled, (F.col("pred") == F.col("label")).cast("double"))).alias("top1_acc"),
    )
    own = counted.unpivot([], list(_RECOUNTED), "metric", "counted")
    told = job.metrics.select(*[F.col(c).cast("double").alias(c) for c in _RECOUNTED]).unpivot([], list(_RECOUNTED), "metric", "told")
    return own.join(told, "metric").select("metric", (F.abs(F.col("counted") - F.col("told")) < 1e-9).alias("same"))


def _requests(spark, sf_dir):
    """A request per document, written as JSON lines: its lines are the items, and it allows some of the
    models, in an order of its own, beside one that no router knows."""
    path = scratch_path(spark, "requests")
    own = D.observations(spark, sf_dir, prompt=True).select("query_id", "prompt", "lang")
    turn = F.col("query_id") % M
    names = F.array(*[F.lit(n) for n in MODELS.names])
    order = F.transform(F.sequence(F.lit(0), F.lit(int(M - 1))), lambda i: ((i + turn) % M).cast("int"))
    allowed = F.filter(order, lambda i: (F.col("query_id") + i) % 3 != 0)
    allowed = F.when(F.col("query_id") % 10 == 9, F.array().cast("array<int>")).otherwise(allowed)
    costs = F.array(*MODELS.cost_literals)
    own.select(
        F.col("query_id").alias("request_id"),
        F.array(F.struct(F.col("prompt").alias("text"), F.create_map(F.lit("eval"), F.col("lang")).alias("features"))).alias("items"),
        F.concat(F.array(F.lit("m-new")), F.transform(allowed, lambda i: F.get(names, i))).alias("model_names"),
        F.concat(F.array(F.lit(0.5)), F.transform(allowed, lambda i: F.get(costs, i))).alias("model_costs"),
    ).write.json(path)
    return path


VIEWS["x_allowed"] = (
    ("f_preds", "f_models"),
    "select p.query_id, m.model, p.prob, (p.model_idx - p.query_id % 5 + 5) % 5 as place from f_preds p join f_models m using (model_idx) "
    "where (p.query_id + p.model_idx) % 3 <> 0 and p.query_id % 10 <> 9",
)


@query(
    "a09_answers_of_own_models",
    sql(
        "select q.query_id as request_id, 0 as pos, coalesce(a.model, 'm-new') as model_name, a.probability from f_queries q left join ("
        "select query_id, arg_min(model, (-prob, place)) as model, round(max(prob) / sum(prob), 9) as probability from x_allowed group by 1) a "
        "using (query_id)",
        "x_allowed",
        "f_queries",
    ),
)
def answers_of_own_models(spark, sf_dir):
    """Requests read from JSON, each answered among its own models by given probabilities."""
    asked = R.candidates(R.read_requests(spark, _requests(spark, sf_dir)))
    given = D.observations(spark, sf_dir).select(F.col("query_id").alias("request_id"), "probs")
    chosen = R.choose(asked.join(given, "request_id"), list(MODELS.names))
    return chosen.select("request_id", "pos", "model_name", r9("probability").alias("probability"))


@query(
    "a09_stream_of_requests",
    sql(
        "select query_id as request_id, 0 as pos, true as same, query_id % 10 = 9 or not exists "
        "(select 1 from x_allowed x where x.query_id = q.query_id) as is_unknown from f_queries q",
        "x_allowed",
        "f_queries",
    ),
)
def stream_of_requests(spark, sf_dir):
    """The fitted router answers arriving requests as it does a batch of them; where a request names
    no model that it knows, without a probability."""
    path, router = _requests(spark, sf_dir), trained(spark, sf_dir).router
    out, log = scratch_path(spark, "request-answers"), scratch_path(spark, "request-log")
    answer_stream(request_stream(spark, path), router, out, log).awaitTermination()
    batch = answer_requests(R.read_requests(spark, path), router)
    told = spark.read.parquet(out).select("request_id", "pos", F.col("model_name").alias("told"), F.col("probability").alias("p"))
    both = batch.join(told, ["request_id", "pos"], "full")
    near = F.col("probability").eqNullSafe(F.col("p")) | (F.abs(F.col("probability") - F.col("p")) < 1e-9)
    same = F.coalesce((F.col("model_name") == F.col("told")) & near, F.lit(False))
    return both.select("request_id", "pos", same.alias("same"), F.col("probability").isNull().alias("is_unknown"))
