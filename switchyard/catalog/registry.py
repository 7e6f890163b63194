"""Query registration and the shared SQL definitions.

A query is a function (spark, sf_dir) -> DataFrame.  Its SQL runs on DuckDB over
the same parquet tables; ``sql(body, *views)`` puts the named definitions, and
those they build on, in front of the body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.derived import MODELS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

M = len(MODELS)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "f_models": (
        (),
        "select * from (values (0,'m-a',0.001e0,5),(1,'m-b',0.030e0,9),(2,'m-c',0.015e0,8),"
        "(3,'m-d',0.002e0,6),(4,'m-e',0.006e0,7)) as v(model_idx, model, price, skill)",
    ),
    "f_queries": (
        (),
        "select doc_id as query_id, text as prompt, source as eval_name, lang, n_chars from documents",
    ),
    "f_obs": (
        ("f_models", "f_queries"),
        "select q.query_id, m.model_idx, m.model, "
        "case when ((ascii(substr(coalesce(q.lang, 'xx'), 2, 1)) + case when q.n_chars > 1024 then 4 else 0 end + 3*m.model_idx) "
        "% 10 < m.skill) <> ((q.query_id*31 + m.model_idx*17) % 8 = 0) then 1.0e0 else 0.0e0 end as quality, "
        "m.price * (q.n_chars/1000.0e0) as cost, m.price from f_queries q cross join f_models m",
    ),
    "f_labels": (
        ("f_obs",),
        "select query_id, case when query_id % 11 = 0 then null else model_idx end as label from ("
        "select query_id, model_idx, row_number() over (partition by query_id order by quality desc, cost, model_idx) "
        "as rn from f_obs) t where rn = 1",
    ),
    "f_preds": (
        ("f_obs", "f_queries"),
        "select query_id, model_idx, prob, row_number() over (partition by query_id order by prob desc, model_idx) as rk "
        "from (select query_id, model_idx, e / sum(e) over (partition by query_id) as prob from ("
        "select query_id, model_idx, 1 + (query_id*13 + model_idx*29 + n_chars*7) % 100 + 100 * quality as e "
        "from f_obs join f_queries using (query_id)) a) b",
    ),
    "f_clusters": (
        ("f_queries",),
        "select query_id, case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 4 end as cluster_id "
        "from f_queries",
    ),
    "f_route_log": (
        (),
        "select l_returnflag as flag, cast(l_suppkey % 5 as int) as pred, cast(l_partkey % 5 as int) as label, "
        "round(l_discount*10, 2) as conf, l_extendedprice/100000.0e0 as cost from lineitem",
    ),
    # One row per query with what routing it did.
    "f_routed": (
        ("f_queries", "f_preds", "f_labels", "f_obs"),
        "select q.query_id, q.eval_name, p.model_idx as pred, p.prob as conf, l.label, "
        "o.cost as chosen_cost, o.quality as chosen_quality, b.best_quality, lo.cost as label_cost, lp.rk as label_rank "
        "from f_queries q join f_preds p on p.query_id = q.query_id and p.rk = 1 "
        "join f_labels l on l.query_id = q.query_id "
        "join f_obs o on o.query_id = q.query_id and o.model_idx = p.model_idx "
        "join (select query_id, max(quality) as best_quality from f_obs group by query_id) b on b.query_id = q.query_id "
        "left join f_obs lo on lo.query_id = q.query_id and lo.model_idx = l.label "
        "left join f_preds lp on lp.query_id = q.query_id and lp.model_idx = l.label",
    ),
    "f_lab": (("f_routed",), "select * from f_routed where label is not null"),
    # Per-model counts over labelled rows, and the fixed-model baselines.
    "f_classes": (
        ("f_models", "f_lab", "f_obs"),
        "select m.model_idx, m.model, m.price, "
        "(select count(*) from f_lab where label = m.model_idx) as label_n, "
        "(select count(*) from f_lab where pred = m.model_idx) as pred_n, "
        "(select count(*) from f_lab where pred = m.model_idx and label = m.model_idx) as hit_n, "
        "(select count(*) from f_lab) as n, "
        "(select avg(o.cost) from f_obs o join f_lab l using (query_id) where o.model_idx = m.model_idx) as fixed_cost "
        "from f_models m",
    ),
    "f_profile": (
        ("f_obs", "f_clusters"),
        "select c.cluster_id, o.model_idx, o.model, o.price, avg(o.quality) as quality, count(*) as size, "
        "avg(o.quality) - 0.1e0 * o.price as utility "
        "from f_clusters c join f_obs o using (query_id) group by c.cluster_id, o.model_idx, o.model, o.price",
    ),
}


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(VIEWS[name][0], seen)
            if name not in seen:
                seen.append(name)
    return seen


def sql(body: str, *views: str) -> str:
    order = _needed(views, [])
    if not order:
        return body
    return "with " + ",\n".join(f"{v} as ({VIEWS[v][1]})" for v in order) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def r9(column: Column | str) -> Column:
    """Published numbers carry nine decimals: sums differ in their last bits."""
    return F.round(column, 9)
