"""G: routing metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard import derived as D
from switchyard.catalog.registry import M, VIEWS, query, r9, sql
from switchyard.config import RouterConfig
from switchyard.functions import rows
from switchyard.operators import calibrate as K
from switchyard.operators import evaluate as G
from switchyard.plans.report import evaluate, report
from switchyard.session import materialise
from switchyard.sources import runs

MODELS = D.MODELS
TEMPERATURE = 1.5


def outcomes(spark, sf_dir):
    return G.outcomes(D.observations(spark, sf_dir), MODELS)


def _tally(spark, sf_dir, labelled=False):
    out = outcomes(spark, sf_dir)
    return G.tally(G.cells(G.labelled(out) if labelled else out, MODELS), MODELS)


def _one(spark, sf_dir, **columns):
    return _tally(spark, sf_dir).select(*[r9(c).alias(n) for n, c in columns.items()])


@query("g00_labelled_rows", sql("select query_id, pred, label from f_lab", "f_lab"))
def labelled_rows(spark, sf_dir):
    return G.labelled(outcomes(spark, sf_dir)).select("query_id", "pred", "label")


@query(
    "g01_chosen_cost",
    sql(
        "select query_id, pred, round(case when pred = 4 and query_id % 7 = 0 then 0.006e0 else chosen_cost end, 9) as chosen_cost "
        "from f_routed",
        "f_routed",
    ),
)
def chosen_cost(spark, sf_dir):
    """Where the query has no own cost of the routed model, the model's mean."""
    costs = rows.entries("cost", M)
    costs[4] = F.when(F.col("query_id") % 7 != 0, costs[4])
    given = D.observations(spark, sf_dir).withColumn("cost", F.array(*costs))
    return G.outcomes(given, MODELS).select("query_id", "pred", r9("chosen_cost").alias("chosen_cost"))


@query("g02_average_cost", sql("select round(avg(chosen_cost), 9) as avg_cost from f_routed", "f_routed"))
def average_cost(spark, sf_dir):
    return _one(spark, sf_dir, avg_cost=G.average_cost())


@query(
    "g03_route_ratio",
    sql(
        "select m.model_idx, m.model, count(r.pred) as n, round(count(r.pred) / (select count(*) from f_routed), 9) as route_ratio "
        "from f_models m left join f_routed r on r.pred = m.model_idx group by 1, 2",
        "f_models",
        "f_routed",
    ),
)
def route_ratio(spark, sf_dir):
    return G.route_ratio(_tally(spark, sf_dir), MODELS).withColumn("route_ratio", r9("route_ratio"))


@query("g04_average_quality", sql("select round(avg(chosen_quality), 9) as avg_quality from f_routed", "f_routed"))
def average_quality(spark, sf_dir):
    return _one(spark, sf_dir, avg_quality=G.average_quality())


@query("g05_oracle_quality", sql("select round(avg(best_quality), 9) as oracle_quality from f_routed", "f_routed"))
def oracle_quality(spark, sf_dir):
    return _one(spark, sf_dir, oracle_quality=G.oracle_quality())


@query(
    "g06_quality_regret",
    sql(
        "select round(avg(best_quality) - avg(chosen_quality), 9) as quality_regret, "
        "round(avg(chosen_quality) / avg(best_quality), 9) as quality_retention from f_routed",
        "f_routed",
    ),
)
def quality_regret(spark, sf_dir):
    return _one(spark, sf_dir, quality_regret=G.quality_regret(), quality_retention=G.quality_retention())


@query(
    "g07_cost_savings",
    sql("select round((0.03e0 - avg(chosen_cost)) / 0.03e0, 9) as cost_savings from f_routed", "f_routed"),
)
def cost_savings(spark, sf_dir):
    return _one(spark, sf_dir, cost_savings=G.cost_savings(MODELS))


_HIT = "case when pred = label then 1.0e0 else 0.0e0 end"


@query("g08_top1_accuracy", sql(f"select round(avg({_HIT}), 9) as top1_acc from f_lab", "f_lab"))
def top1_accuracy(spark, sf_dir):
    return _one(spark, sf_dir, top1_acc=G.top1_accuracy(M))


@query(
    "g09_cost_per_correct",
    sql(
        f"select round((select avg(chosen_cost) from f_routed) / greatest(avg({_HIT}), 1e-12), 9) as cost_per_correct from f_lab",
        "f_lab",
    ),
)
def cost_per_correct(spark, sf_dir):
    return _one(spark, sf_dir, cost_per_correct=G.cost_per_correct(M))


@query(
    "g10_topk_accuracy",
    sql(
        "select round(avg(case when label_rank <= 3 then 1.0e0 else 0.0e0 end), 9) as top3_acc, "
        "round(avg(case when label_rank <= 5 then 1.0e0 else 0.0e0 end), 9) as top5_acc from f_lab",
        "f_lab",
    ),
)
def topk_accuracy(spark, sf_dir):
    return _one(spark, sf_dir, top3_acc=G.topk_accuracy(3), top5_acc=G.topk_accuracy(5))


_F1 = "case when label_n + pred_n > 0 then 2.0e0 * hit_n / (label_n + pred_n) else 0 end"


@query(
    "g11_macro_f1",
    sql(f"select round(avg({_F1}), 9) as macro_f1 from f_classes where label_n + pred_n > 0", "f_classes"),
)
def macro_f1(spark, sf_dir):
    return _one(spark, sf_dir, macro_f1=G.macro_f1(M))


@query(
    "g12_weighted_f1",
    sql(f"select round(sum({_F1} * label_n) / sum(label_n), 9) as weighted_f1 from f_classes", "f_classes"),
)
def weighted_f1(spark, sf_dir):
    return _one(spark, sf_dir, weighted_f1=G.weighted_f1(M))


_MCC = (
    "(sum(hit_n)::double * max(n) - sum(pred_n::double * label_n)) / sqrt((max(n)::double * max(n) - "
    "sum(pred_n::double * pred_n)) * (max(n)::double * max(n) - sum(label_n::double * label_n)))"
)


@query("g13_matthews_correlation", sql(f"select round({_MCC}, 9) as mcc from f_classes", "f_classes"))
def matthews_correlation(spark, sf_dir):
    return _one(spark, sf_dir, mcc=G.matthews(M))


@query(
    "g14_histogram_kl",
    sql(
        "select round(sum(p / ps * ln((p / ps) / (q / qs))), 9) as kl_div from (select p, q, sum(p) over () as ps, "
        "sum(q) over () as qs from (select greatest(pred_n / n, 1e-9) as p, greatest(label_n / n, 1e-9) as q "
        "from f_classes) a) b",
        "f_classes",
    ),
)
def histogram_kl(spark, sf_dir):
    return _one(spark, sf_dir, kl_div=G.histogram_kl(M))


VIEWS["f_fixed"] = (
    ("f_classes",),
    "select model_idx, model, label_n::double / n as acc, fixed_cost as cost, n from f_classes",
)


@query(
    "g15_fixed_baselines",
    sql("select model_idx, model, round(acc, 9) as acc, round(cost, 9) as cost from f_fixed", "f_fixed"),
)
def fixed_baselines(spark, sf_dir):
    found = G.fixed_baselines(_tally(spark, sf_dir), MODELS)
    return found.withColumns({"acc": r9("acc"), "cost": r9("cost")})


@query(
    "g16_best_fixed",
    sql(
        "select model_idx, model, round(acc, 9) as acc, round(cost, 9) as cost from f_fixed order by acc desc, model_idx limit 1",
        "f_fixed",
    ),
)
def best_fixed(spark, sf_dir):
    return G.best_fixed(_tally(spark, sf_dir), MODELS).withColumns({"acc": r9("acc"), "cost": r9("cost")})


@query(
    "g17_matched_baseline",
    sql(
        "select coalesce(model_idx, -1) as model_idx, coalesce(model, 'none') as model, "
        "round(coalesce(cost, 'infinity'::double), 9) as cost, round(coalesce(r.c / greatest(cost, 1e-12), 0), 9) as cost_ratio, "
        "case when cost is not null and r.c > cost then 0.0e0 else 1.0e0 end as meets from "
        f"(select (select avg(chosen_cost) from f_routed) as c, avg({_HIT}) as acc from f_lab) r left join lateral "
        "(select * from f_fixed x where x.acc + 1e-12 >= r.acc order by x.cost, x.model_idx limit 1) f on true",
        "f_fixed",
        "f_lab",
    ),
)
def matched_baseline(spark, sf_dir):
    found = G.matched_baseline(_tally(spark, sf_dir), MODELS)
    return found.withColumns({"cost": r9("cost"), "cost_ratio": r9("cost_ratio")})


@query(
    "g18_cheapest_model",
    sql("select model_idx, model, round(cost, 9) as cost from f_fixed order by cost, model_idx limit 1", "f_fixed"),
)
def cheapest_model(spark, sf_dir):
    return G.cheapest_fixed(_tally(spark, sf_dir), MODELS).withColumn("cost", r9("cost"))


_CONFUSION = (
    "select a.model_idx as label, b.model_idx as pred, (select count(*) from {t} l where l.label = a.model_idx "
    "and l.pred = b.model_idx) as n from f_models a cross join f_models b"
)


@query("g19_confusion", sql(_CONFUSION.format(t="f_lab"), "f_models", "f_lab"))
def confusion(spark, sf_dir):
    return G.confusion(G.cells(outcomes(spark, sf_dir), MODELS), MODELS)


@query(
    "g20_per_model",
    sql(
        "select model_idx, model, round(p, 9) as precision, round(r, 9) as recall, "
        "round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1, label_n as support, price as model_cost, "
        "round(pred_n / n, 9) as routed_ratio from (select *, hit_n / greatest(1.0e0, pred_n) as p, "
        "hit_n / greatest(1.0e0, label_n) as r from f_classes) t",
        "f_classes",
    ),
)
def per_model(spark, sf_dir):
    found = G.per_model(_tally(spark, sf_dir, labelled=True), MODELS)
    return found.withColumns({c: r9(c) for c in ("precision", "recall", "f1", "routed_ratio")})


def _bins_sql(table: str, conf: str = "conf") -> str:
    edges = " ".join(f"when {conf} < {(i * 0.1)!r}e0 then {i - 1}" for i in range(1, 10))
    return (
        f"select g.bin, count(b) as n, coalesce(avg({conf}), 0) as mean_conf, coalesce(avg(hit), 0) as mean_acc from "
        f"(select unnest(range(10))::int as bin) g left join (select case {edges} else 9 end as b, {conf}, {_HIT} as hit "
        f"from {table} where label is not null) t on t.b = g.bin group by g.bin"
    )


VIEWS["c_bins"] = (("f_routed",), _bins_sql("f_routed"))
VIEWS["c_log_bins"] = (("f_route_log",), _bins_sql("f_route_log"))
_ROUND_BINS = "select bin, n, round(mean_conf, 9) as mean_conf, round(mean_acc, 9) as mean_acc from {t}"
_ECE = (
    "select round(sum(n * abs(mean_conf - mean_acc)) / sum(n), 9) as ece, "
    "round(max(case when n > 0 then abs(mean_conf - mean_acc) else 0 end), 9) as mce from {t}"
)


def _rounded_bins(bins):
    return bins.withColumns({"mean_conf": r9("mean_conf"), "mean_acc": r9("mean_acc")})


def _rounded_error(bins):
    return K.calibration_error(bins).select(r9("ece").alias("ece"), r9("mce").alias("mce"))


@query("g21_calibration_bins", sql(_ROUND_BINS.format(t="c_bins"), "c_bins"))
def calibration_bins(spark, sf_dir):
    return _rounded_bins(K.calibration_bins(outcomes(spark, sf_dir)))


@query("g22_calibration_error", sql(_ECE.format(t="c_bins"), "c_bins"))
def calibration_error(spark, sf_dir):
    return _rounded_error(K.calibration_bins(outcomes(spark, sf_dir)))


VIEWS["c_logits"] = (
    ("f_preds", "f_labels"),
    "select p.query_id, p.model_idx, l.label, ln(p.prob) - avg(ln(p.prob)) over (partition by p.query_id) as z "
    "from f_preds p join f_labels l using (query_id)",
)
_CANDIDATES = (0.5, 1.0, 1.5, 2.0, 4.0)


@query(
    "g23_nll_by_temperature",
    sql(
        "select t as temperature, round(-avg(ln(p)), 9) as nll from (select t, query_id, label, model_idx, "
        "exp(z / t) / sum(exp(z / t)) over (partition by t, query_id) as p from c_logits, "
        "(values (0.5e0), (1.0e0), (1.5e0), (2.0e0), (4.0e0)) v(t) where label is not null) a where model_idx = label group by t",
        "c_logits",
    ),
)
def nll_by_temperature(spark, sf_dir):
    found = K.nll_by_temperature(D.observations(spark, sf_dir), MODELS, list(_CANDIDATES))
    return found.withColumn("nll", r9("nll"))


@query("g23_fitted_temperature")
def fitted_temperature(spark, sf_dir):
    """The temperature and the NLL it reaches, beside that of no scaling."""
    given = D.observations(spark, sf_dir)
    fitted = K.fit_temperature(given, MODELS)
    return K.nll_by_temperature(given, MODELS, [1.0, fitted])


@query(
    "g23_temperature_is_least", "select true as is_inside, true as is_least from (select count(*) from documents) d"
)
def temperature_is_least(spark, sf_dir):
    """The fitted temperature lies inside the searched interval, and none around it, or at the
    interval's ends, has a lower NLL."""
    given = D.observations(spark, sf_dir)
    low, high = 0.01, 100.0
    fitted = K.fit_temperature(given, MODELS, low=low, high=high)
    near = [min(high, max(low, fitted * f)) for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2.0)]
    around = K.nll_by_temperature(given, MODELS, sorted({fitted, low, high, *near}))
    own = F.abs(F.col("temperature") - fitted) < 1e-12 * fitted
    least = F.max(F.when(own, F.col("nll"))) <= F.min("nll") + 1e-12
    return around.agg(F.lit(1.01 * low < fitted < 0.99 * high).alias("is_inside"), least.alias("is_least"))


def _recalibrated(spark, sf_dir):
    out = outcomes(spark, sf_dir)
    probs = K.recalibrated(rows.entries("probs", M), TEMPERATURE)
    scaled = out.withColumn("probs_t", F.array(*probs))
    return scaled.withColumn("conf_t", rows.row_max(rows.entries("probs_t", M)))


VIEWS["c_scaled"] = (
    ("c_logits", "f_lab"),
    "select l.*, s.conf_t from f_lab l join (select query_id, max(p) as conf_t from (select query_id, "
    "exp(z / 1.5e0) / sum(exp(z / 1.5e0)) over (partition by query_id) as p from c_logits) a group by 1) s using (query_id)",
)
VIEWS["c_scaled_bins"] = (("c_scaled",), _bins_sql("c_scaled", "conf_t"))


@query("g24_recalibrated_bins", sql(_ROUND_BINS.format(t="c_scaled_bins"), "c_scaled_bins"))
def recalibrated_bins(spark, sf_dir):
    return _rounded_bins(K.calibration_bins(_recalibrated(spark, sf_dir), conf="conf_t"))


@query("g24_recalibrated_error", sql(_ECE.format(t="c_scaled_bins"), "c_scaled_bins"))
def recalibrated_error(spark, sf_dir):
    return _rounded_error(K.calibration_bins(_recalibrated(spark, sf_dir), conf="conf_t"))


@query("g25_oracle_cost", sql("select round(avg(label_cost), 9) as oracle_cost from f_lab", "f_lab"))
def oracle_cost(spark, sf_dir):
    return G.oracle_cost(_tally(spark, sf_dir)).select(r9("oracle_cost").alias("oracle_cost"))


_BEST = "(select {c} from f_fixed order by acc desc, model_idx limit 1)"


@query(
    "g26_fallback_model",
    sql(
        f"select 'best_fixed' as strategy, {_BEST.format(c='model_idx')} as model_idx, {_BEST.format(c='model')} as model "
        "union all select 'cheapest', 0, 'm-a' union all select 'named', 2, 'm-c' "
        f"union all select 'unknown', {_BEST.format(c='model_idx')}, {_BEST.format(c='model')}",
        "f_fixed",
    ),
)
def fallback_model(spark, sf_dir):
    t = _tally(spark, sf_dir)
    found = G.fallback(t, MODELS, "best_fixed")
    for strategy, name in (("cheapest", None), ("named", "m-c"), ("unknown", "no such model")):
        found = found.unionByName(G.fallback(t, MODELS, strategy, name))
    return found


VIEWS["c_frontier"] = (
    ("c_scaled", "f_obs"),
    "select tau, avg(case when use then hit when label = 0 then 1.0e0 else 0.0e0 end) as acc, "
    "avg(case when use then chosen_cost else cheap_cost end) as cost from (select i * 0.02e0 as tau, "
    f"s.conf_t >= i * 0.02e0 as use, s.label, s.chosen_cost, o.cost as cheap_cost, {_HIT} as hit from c_scaled s "
    "join f_obs o on o.query_id = s.query_id and o.model_idx = 0 cross join (select unnest(range(51)) as i) g) t group by tau",
)


def _frontier(spark, sf_dir):
    cells = K.frontier_cells(_recalibrated(spark, sf_dir), MODELS, conf="conf_t")
    return K.frontier(cells, MODELS.cheapest)


@query(
    "g27_frontier",
    sql("select round(tau, 9) as tau, round(acc, 9) as acc, round(cost, 9) as cost from c_frontier", "c_frontier"),
)
def frontier(spark, sf_dir):
    return _frontier(spark, sf_dir).select(*[r9(c).alias(c) for c in ("tau", "acc", "cost")])


@query(
    "g28_best_point",
    sql(
        "select round(f.tau, 9) as tau, round(f.acc, 9) as acc, round(f.cost, 9) as cost, "
        "round((n.cost - f.cost) / n.cost, 9) as savings_vs_current from c_frontier f, "
        "(select acc, cost from c_frontier where tau = 0) n where f.acc >= n.acc - 1e-12 order by round(f.cost, 12), f.tau limit 1",
        "c_frontier",
    ),
)
def best_point(spark, sf_dir):
    return K.best_point(_frontier(spark, sf_dir)).select(
        *[r9(c).alias(c) for c in ("tau", "acc", "cost", "savings_vs_current")]
    )


def _subgroups_sql(table: str, group: str, cost: str) -> str:
    routes = ", ".join(
        f"round(avg(case when pred = {i} then 1.0e0 else 0.0e0 end), 9) as \"route_{n}\"" for i, n in enumerate(MODELS.names)
    )
    return (
        f'select {group} as "group", count(*) as n, round(avg({_HIT}), 9) as top1_acc, round(avg({cost}), 9) as avg_cost, '
        f"{routes} from {table} where label is not null group by {group}"
    )


def _rounded_groups(found):
    return found.select("group", "n", *[r9(f"`{c}`").alias(c) for c in found.columns if c not in ("group", "n")])


@query("g29_subgroups", sql(_subgroups_sql("f_routed", "eval_name", "chosen_cost"), "f_routed"))
def subgroups(spark, sf_dir):
    return _rounded_groups(G.subgroups(outcomes(spark, sf_dir), MODELS))


# --- the routing log: one row per line item --------------------------------------


def _log(spark, sf_dir):
    return D.route_log(spark, sf_dir).withColumnRenamed("cost", "chosen_cost")


_LOG_CLASSES = (
    "select m.model_idx, m.model, (select count(*) from f_route_log where label = m.model_idx) as label_n, "
    "(select count(*) from f_route_log where pred = m.model_idx) as pred_n, "
    "(select count(*) from f_route_log where pred = m.model_idx and label = m.model_idx) as hit_n, "
    "(select count(*) from f_route_log) as n from f_models m"
)
VIEWS["l_classes"] = (("f_models", "f_route_log"), _LOG_CLASSES)


@query(
    "g02_g14_log_overall",
    sql(
        "select (select count(*) from f_route_log) as n_all, (select count(*) from f_route_log) as n_labelled, "
        f"(select round(avg({_HIT}), 9) from f_route_log) as top1_acc, "
        "(select round(avg(cost), 9) from f_route_log) as avg_cost, "
        f"(select round(avg(cost) / avg({_HIT}), 9) from f_route_log) as cost_per_correct, "
        "(select round((0.03e0 - avg(cost)) / 0.03e0, 9) from f_route_log) as cost_savings, "
        f"(select round(avg({_F1}), 9) from l_classes where label_n + pred_n > 0) as macro_f1, "
        f"(select round(sum({_F1} * label_n) / sum(label_n), 9) from l_classes) as weighted_f1, "
        f"(select round({_MCC}, 9) from l_classes) as mcc, "
        "(select round(sum(p / ps * ln((p / ps) / (q / qs))), 9) from (select p, q, sum(p) over () as ps, "
        "sum(q) over () as qs from (select greatest(pred_n / n, 1e-9) as p, greatest(label_n / n, 1e-9) as q "
        "from l_classes) a) b) as kl_div",
        "l_classes",
    ),
)
def log_overall(spark, sf_dir):
    found = G.overall(G.tally(G.cells(_log(spark, sf_dir), MODELS), MODELS), MODELS)
    return found.select(
        "n_all", "n_labelled", *[r9(c).alias(c) for c in found.columns if c not in ("n_all", "n_labelled")]
    )


@query("g19_log_confusion", sql(_CONFUSION.format(t="f_route_log"), "f_models", "f_route_log"))
def log_confusion(spark, sf_dir):
    return G.confusion(G.cells(_log(spark, sf_dir), MODELS), MODELS)


@query("g21_log_calibration_bins", sql(_ROUND_BINS.format(t="c_log_bins"), "c_log_bins"))
def log_calibration_bins(spark, sf_dir):
    return _rounded_bins(K.calibration_bins(_log(spark, sf_dir)))


@query("g22_log_calibration_error", sql(_ECE.format(t="c_log_bins"), "c_log_bins"))
def log_calibration_error(spark, sf_dir):
    return _rounded_error(K.calibration_bins(_log(spark, sf_dir)))


@query("g29_log_subgroups", sql(_subgroups_sql("f_route_log", "flag", "cost"), "f_route_log"))
def log_subgroups(spark, sf_dir):
    return _rounded_groups(G.subgroups(_log(spark, sf_dir), MODELS, "flag"))


# --- everything at once ---------------------------------------------------------------


_PAIRS = [
    ("n_all", "(select count(*) from f_routed)"),
    ("n_labelled", "(select count(*) from f_lab)"),
    ("top1_acc", f"(select avg({_HIT}) from f_lab)"),
    ("avg_cost", "(select avg(chosen_cost) from f_routed)"),
    ("cost_per_correct", f"(select avg(chosen_cost) from f_routed) / (select avg({_HIT}) from f_lab)"),
    ("cost_savings", "(0.03e0 - (select avg(chosen_cost) from f_routed)) / 0.03e0"),
    ("avg_quality", "(select avg(chosen_quality) from f_routed)"),
    ("oracle_quality", "(select avg(best_quality) from f_routed)"),
    ("quality_regret", "(select avg(best_quality) - avg(chosen_quality) from f_routed)"),
    ("quality_retention", "(select avg(chosen_quality) / avg(best_quality) from f_routed)"),
    ("top3_acc", "(select avg(case when label_rank <= 3 then 1.0e0 else 0.0e0 end) from f_lab)"),
    ("top5_acc", "(select avg(case when label_rank <= 5 then 1.0e0 else 0.0e0 end) from f_lab)"),
    ("macro_f1", f"(select avg({_F1}) from f_classes where label_n + pred_n > 0)"),
    ("weighted_f1", f"(select sum({_F1} * label_n) / sum(label_n) from f_classes)"),
    ("mcc", f"(select {_MCC} from f_classes)"),
    ("baseline_best_fixed_model", "(select model_idx from f_fixed order by acc desc, model_idx limit 1)"),
    ("baseline_best_fixed_acc", "(select acc from f_fixed order by acc desc, model_idx limit 1)"),
    ("baseline_best_fixed_cost", "(select cost from f_fixed order by acc desc, model_idx limit 1)"),
    ("baseline_cheapest_model", "(select model_idx from f_fixed order by cost, model_idx limit 1)"),
    ("baseline_cheapest_cost", "(select cost from f_fixed order by cost, model_idx limit 1)"),
]
for _i, _n in enumerate(MODELS.names):
    _PAIRS += [
        (f"route_{_n}", f"(select avg(case when pred = {_i} then 1.0e0 else 0.0e0 end) from f_routed)"),
        (f"fixed_acc_{_n}", f"(select acc from f_fixed where model_idx = {_i})"),
        (f"fixed_cost_{_n}", f"(select cost from f_fixed where model_idx = {_i})"),
    ]


@query(
    "g30_flat_metrics",
    sql(
        "select unnest([" + ", ".join(f"'{n}'" for n, _ in _PAIRS) + "]) as metric, unnest(["
        + ", ".join(f"round(({e})::double, 9)" for _, e in _PAIRS) + "]) as value",
        "f_routed", "f_lab", "f_classes", "f_fixed",
    ),
)
def flat_metrics(spark, sf_dir):
    row = evaluate(D.observations(spark, sf_dir), MODELS)
    found = runs.metric_rows(row.select(*[f"`{n}`" for n, _ in _PAIRS]), "run-1")
    return found.select("metric", r9("value").alias("value"))


_REPORT_ROWS = {
    "overall": "1", "route_ratio": "5", "per_model": "5", "confusion_matrix": "25", "calibration": "10",
    "calibration_error": "1", "calibration_after_temperature": "10", "calibration_error_after_temperature": "1",
    "baselines_fixed": "5", "baselines_best_fixed": "1", "baselines_oracle_cost": "1", "frontier_points": "51",
    "frontier_best": "1", "frontier_fallback": "1", "subgroups": "(select count(distinct eval_name) from f_lab)",
}


@query(
    "g30_full_report",
    sql(
        " union all ".join(f"select '{t}' as report_table, {n} as n_rows" for t, n in _REPORT_ROWS.items()),
        "f_lab",
    ),
)
def full_report(spark, sf_dir):
    """The number of rows of every report table."""
    preds = materialise(D.observations(spark, sf_dir), "predictions")
    tables = report(preds, MODELS, RouterConfig())
    counts = None
    for name, table in tables.items():
        one = table.agg(F.lit(name).alias("report_table"), F.count(F.lit(1)).alias("n_rows"))
        counts = one if counts is None else counts.unionByName(one)
    return counts
