"""E: soft labels and training target."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard import derived as D
from switchyard.catalog import cluster as _cluster  # its SQL definitions
from switchyard.catalog.registry import M, VIEWS, query, r9, sql
from switchyard.functions import rows
from switchyard.operators import profiles as P
from switchyard.operators import targets as S
from switchyard.session import materialise

MODELS = D.MODELS
THRESHOLD = 0.5

VIEWS["s_cluster"] = (
    ("f_clusters", "f_models", "k_softmax"),
    "select c.query_id, m.model_idx, coalesce(k.prob, case when m.model_idx = 0 then 1.0e0 else 0.0e0 end) as soft "
    "from f_clusters c cross join f_models m left join (select * from k_softmax where cluster_id <> 2) k "
    "on k.cluster_id = c.cluster_id and k.model_idx = m.model_idx",
)
VIEWS["s_min_cost"] = (
    ("f_obs",),
    "select query_id, model_idx, case when total > 0 then w / total when price = 0.001e0 then 1.0e0 else 0.0e0 end as soft "
    "from (select *, sum(w) over (partition by query_id) as total from (select *, case when quality >= 0.5e0 "
    "then 1 / greatest(price, 1e-6) else 0 end as w from f_obs) a) b",
)
VIEWS["s_utility"] = (
    ("f_obs",),
    "select query_id, model_idx, case when low = high then 0.2e0 when rk = 1 then 1.0e0 else 0.0e0 end as soft from ("
    "select *, min(quality) over (partition by query_id) as low, max(quality) over (partition by query_id) as high, "
    "row_number() over (partition by query_id order by quality desc, model_idx) as rk from f_obs) a",
)
VIEWS["s_blend"] = (
    ("s_cluster", "s_utility"),
    "select c.query_id, c.model_idx, 0.3e0 * c.soft + (1 - 0.3e0) * u.soft as soft from s_cluster c "
    "join s_utility u using (query_id, model_idx)",
)
VIEWS["s_cost_aware"] = (
    ("f_obs",),
    "select query_id, model_idx, e / sum(e) over (partition by query_id) as soft from (select query_id, model_idx, "
    "exp(z - max(z) over (partition by query_id)) as e from (select query_id, model_idx, "
    "(quality - 0.5e0 * price / 0.03e0) / 0.5e0 as z from f_obs) a) b",
)
VIEWS["s_target"] = (
    ("s_cost_aware", "s_blend"),
    "select a.query_id, a.model_idx, 0.4e0 * a.soft + (1 - 0.4e0) * b.soft as soft from s_cost_aware a "
    "join s_blend b using (query_id, model_idx)",
)


def _sql(view: str) -> str:
    return sql(f"select query_id, model_idx, round(soft, 9) as soft from {view}", view)


def _long(df, cols):
    return df.select("query_id", rows.long_rows({"soft": [r9(c) for c in cols]}))


def cluster_probs(spark, sf_dir):
    return P.utility_probs(P.mean_quality(D.clustered(spark, sf_dir), MODELS), MODELS, 0.1, 0.5)


def with_cluster_soft(spark, sf_dir):
    """One cluster is left out, as a new one would be: it gets model 0."""
    known = materialise(cluster_probs(spark, sf_dir).where(F.col("cluster_id") != 2), "cluster-probs")
    return S.cluster_labels(D.clustered(spark, sf_dir), known, MODELS)


@query("e01_cluster_labels", _sql("s_cluster"))
def cluster_labels(spark, sf_dir):
    return _long(with_cluster_soft(spark, sf_dir), rows.entries("soft", M))


@query("e02_min_cost_labels", _sql("s_min_cost"))
def min_cost_labels(spark, sf_dir):
    return _long(D.observations(spark, sf_dir), S.row_min_cost(rows.entries("quality", M), MODELS, THRESHOLD))


@query("e03_utility_labels", _sql("s_utility"))
def utility_labels(spark, sf_dir):
    return _long(D.observations(spark, sf_dir), S.row_utility(rows.entries("quality", M)))


@query("e04_blended_labels", _sql("s_blend"))
def blended_labels(spark, sf_dir):
    row = S.row_utility(rows.entries("quality", M))
    return _long(with_cluster_soft(spark, sf_dir), S.blend(rows.entries("soft", M), row, 0.3))


@query(
    "e05_normalised_costs",
    sql(
        "select query_id, model_idx, round(cost * price / (select max(price) from f_models), 9) as cost_norm from f_obs",
        "f_obs",
    ),
)
def normalised_costs(spark, sf_dir):
    """Each query's cost weighted by the normalised model cost."""
    df = D.observations(spark, sf_dir)
    weighted = [r9(c * n) for c, n in zip(rows.entries("cost", M), S.normalised_costs(MODELS))]
    return df.select("query_id", rows.long_rows({"cost_norm": weighted}))


@query("e06_cost_aware_target", _sql("s_cost_aware"))
def cost_aware_target(spark, sf_dir):
    return _long(D.observations(spark, sf_dir), S.cost_aware(rows.entries("quality", M), MODELS))


@query("e07_training_target", _sql("s_target"))
def training_target(spark, sf_dir):
    quality = rows.entries("quality", M)
    target = S.training_target(
        quality, rows.entries("soft", M), S.row_utility(quality), MODELS, alpha=0.5, tau=0.5, gamma=0.4, beta=0.3
    )
    return _long(with_cluster_soft(spark, sf_dir), target)


@query(
    "f02_kl_loss",
    sql(
        "select round(sum(case when y.soft > 0 then y.soft * (ln(y.soft) - ln(p.prob)) else 0 end) / "
        "count(distinct p.query_id), 9) as kl from s_min_cost y join f_preds p using (query_id, model_idx)",
        "s_min_cost",
        "f_preds",
    ),
)
def kl_loss(spark, sf_dir):
    df = D.observations(spark, sf_dir)
    target = S.row_min_cost(rows.entries("quality", M), MODELS, THRESHOLD)
    loss = S.kl_divergence(target, [F.log(p) for p in rows.entries("probs", M)])
    return df.agg(r9(F.avg(loss)).alias("kl"))
