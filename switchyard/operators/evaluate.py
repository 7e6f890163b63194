"""Routing metrics.

``outcomes`` adds the per-query facts (row-local); ``cells`` groups them once
by (label, pred) - at most models x (models + 1) rows - and ``tally`` folds the
cells into one row with an entry per model.  Nearly every metric is arithmetic
on that row, so a whole evaluation reads the predictions once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions import rows
from switchyard.models import Models

EPSILON = 1e-12
HIST_FLOOR = 1e-9
ORACLE_FLOOR = 1e-9


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a label only."""
    return df.where(F.col("label").isNotNull())


def label_rank(probs: list[Column], label: Column) -> Column:
    """1-based rank of the label's probability; earlier models win ties."""
    own = rows.pick(probs, label)
    before = [
        F.when((p > own) | ((p == own) & (F.lit(i) < label)), 1).otherwise(0) for i, p in enumerate(probs)
    ]
    return 1 + rows.total(before)


def outcomes(preds: DataFrame, models: Models) -> DataFrame:
    """Per-query facts from (query_id, probs, label, quality, cost, ...).

    ``chosen_cost`` is the query's own cost of the routed model; where it is
    missing, or the query has no cost vector of the right length, the model's
    mean cost.  ``label_cost`` and ``costs`` follow the same rule.
    """
    m = len(models)
    probs = rows.entries("probs", m)
    columns = set(preds.columns)
    if "cost" in columns:
        own = [F.when(F.size("cost") == m, c) for c in rows.entries("cost", m)]
        costs = [F.coalesce(o, F.lit(mean)) for o, mean in zip(own, models.costs)]
    else:
        costs = models.cost_literals
    quality = rows.entries("quality", m) if "quality" in columns else [F.lit(None).cast("double")] * m
    has_label = "label" in columns
    step = preds.withColumns(
        {
            "pred": rows.argmax(probs),
            "conf": rows.row_max(probs),
            "costs": F.array(*costs),
            "label": F.col("label") if has_label else F.lit(None).cast("int"),
        }
    )
    costs = rows.entries("costs", m)
    return step.withColumns(
        {
            "chosen_cost": rows.pick(costs, F.col("pred")),
            "label_cost": rows.pick(costs, F.col("label")),
            "chosen_quality": rows.pick(quality, F.col("pred")),
            "best_quality": rows.row_max(quality),
            "label_rank": F.when(F.col("label").isNotNull(), label_rank(probs, F.col("label"))),
        }
    )


def cells(out: DataFrame, models: Models) -> DataFrame:
    """Counts and sums per (label, pred): the only pass over the queries."""
    m = len(models)
    columns = set(out.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    if "chosen_cost" in columns:
        aggs.append(F.sum("chosen_cost").alias("cost_sum"))
    if "label_cost" in columns:
        aggs.append(F.sum("label_cost").alias("label_cost_sum"))
    if "chosen_quality" in columns:
        aggs += [
            F.count("chosen_quality").alias("n_quality"),
            F.sum("chosen_quality").alias("quality_sum"),
            F.sum("best_quality").alias("best_quality_sum"),
        ]
    if "label_rank" in columns:
        aggs += [F.count_if(F.col("label_rank") <= k).alias(f"top{k}") for k in (3, 5)]
    if "costs" in columns:
        aggs += [F.sum(c).alias(f"model_cost_sum{i}") for i, c in enumerate(rows.entries("costs", m))]
    return out.groupBy("label", "pred").agg(*aggs)


def tally(cell: DataFrame, models: Models) -> DataFrame:
    """One row: totals, and arrays over models of label_n, pred_n, hit_n and
    model_cost (sum over labelled rows)."""
    m = len(models)
    columns = set(cell.columns)

    def per_model(condition: str) -> str:
        return ", ".join(f"coalesce(sum(if({condition.format(i=i)}, n, 0)), 0)" for i in range(m))

    aggs = [
        "coalesce(sum(n), 0) as n_all",
        "coalesce(sum(if(label is not null, n, 0)), 0) as n_labelled",
        f"array({per_model('label <=> {i}')}) as label_n",
        f"array({per_model('pred = {i}')}) as pred_all_n",
        f"array({per_model('label is not null and pred = {i}')}) as pred_n",
        f"array({per_model('label <=> {i} and pred = {i}')}) as hit_n",
    ]
    aggs += [f"sum({c}) as {c}" for c in ("cost_sum", "n_quality", "quality_sum", "best_quality_sum") if c in columns]
    aggs += [f"sum(if(label is not null, {c}, null)) as {c}" for c in ("label_cost_sum", "top3", "top5") if c in columns]
    if "model_cost_sum0" in columns:
        sums = ", ".join(f"sum(if(label is not null, model_cost_sum{i}, null))" for i in range(m))
        aggs.append(f"array({sums}) as model_cost_sum")
    return cell.agg(*[F.expr(a) for a in aggs])


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0: an empty input has no mean."""
    return F.when(b != 0, a.cast("double") / b)


# --- totals -----------------------------------------------------------------


def average_cost() -> Column:
    return _ratio(F.col("cost_sum"), F.col("n_all"))


def average_quality() -> Column:
    return _ratio(F.col("quality_sum"), F.col("n_quality"))


def oracle_quality() -> Column:
    return _ratio(F.col("best_quality_sum"), F.col("n_quality"))


def quality_regret() -> Column:
    return oracle_quality() - average_quality()


def quality_retention() -> Column:
    """Average over oracle quality; 1.0 when the oracle quality is about 0."""
    return F.when(oracle_quality() > ORACLE_FLOOR, average_quality() / oracle_quality()).when(
        oracle_quality().isNotNull(), 1.0
    )


def cost_savings(models: Models) -> Column:
    """Share saved against always using the dearest model."""
    top = models.max_cost
    return (top - average_cost()) / top if top > 1e-9 else F.lit(0.0)


def top1_accuracy(m: int) -> Column:
    return _ratio(rows.total(rows.entries("hit_n", m)), F.col("n_labelled"))


def cost_per_correct(m: int) -> Column:
    return average_cost() / F.greatest(F.lit(EPSILON), top1_accuracy(m))


def topk_accuracy(k: int) -> Column:
    return _ratio(F.col(f"top{k}"), F.col("n_labelled"))


# --- classification -----------------------------------------------------------


def _f1(hit: Column, label: Column, pred: Column) -> Column:
    """2 tp / (labelled + predicted); 0 for a class without either."""
    return F.when(label + pred > 0, 2.0 * hit / (label + pred)).otherwise(0.0)


def _classes(m: int) -> list[tuple[Column, Column, Column]]:
    return list(zip(rows.entries("hit_n", m), rows.entries("label_n", m), rows.entries("pred_n", m)))


def macro_f1(m: int) -> Column:
    """Mean F1 over the classes seen in labels or predictions."""
    f1 = rows.total([_f1(h, y, p) for h, y, p in _classes(m)])
    seen = rows.total([F.when(y + p > 0, 1).otherwise(0) for _, y, p in _classes(m)])
    return _ratio(f1, seen)


def weighted_f1(m: int) -> Column:
    return _ratio(rows.total([_f1(h, y, p) * y for h, y, p in _classes(m)]), F.col("n_labelled"))


def matthews(m: int) -> Column:
    """Multiclass Matthews correlation; 0 where it is undefined."""
    s = F.col("n_labelled").cast("double")
    hits, label, pred = (rows.entries(c, m) for c in ("hit_n", "label_n", "pred_n"))
    c = rows.total(hits).cast("double")
    cross = rows.total([p.cast("double") * t for p, t in zip(pred, label)])
    pp = rows.total([p.cast("double") * p for p in pred])
    tt = rows.total([t.cast("double") * t for t in label])
    spread = (s * s - pp) * (s * s - tt)
    return F.when(spread > 0, (c * s - cross) / F.sqrt(spread)).when(s > 0, 0.0)


def histogram_kl(m: int) -> Column:
    """KL(routed || labels) of the two histograms, floored and renormalised.

    sum(p/P ln((p/P)/(q/Q))) = sum(p ln(p/q))/P + ln(Q/P), so no second pass
    over the normalised histograms is needed.
    """

    def share(name: str) -> list[Column]:
        return [F.greatest(F.lit(HIST_FLOOR), c / F.col("n_labelled")) for c in rows.entries(name, m)]

    p, q = share("pred_n"), share("label_n")
    kl = rows.total([a * F.log(a / b) for a, b in zip(p, q)]) / rows.total(p) + F.log(rows.total(q) / rows.total(p))
    return F.when(F.col("n_labelled") > 0, kl)


# --- per model and baselines -------------------------------------------------------


def route_ratio(t: DataFrame, models: Models, of_labelled: bool = False) -> DataFrame:
    """(model_idx, model, n, route_ratio), 0 for unused models."""
    m = len(models)
    counts = rows.entries("pred_n" if of_labelled else "pred_all_n", m)
    total = F.greatest(F.lit(1), F.col("n_labelled" if of_labelled else "n_all"))
    return t.select(
        rows.long_rows(
            {
                "model": [F.lit(n) for n in models.names],
                "n": counts,
                "route_ratio": [c.cast("double") / total for c in counts],
            }
        )
    )


def confusion(cell: DataFrame, models: Models) -> DataFrame:
    """(label, pred, n) with zero cells; ids outside the model list are dropped.

    Zero rows are appended to the few counted cells; nothing is joined.
    """
    m = len(models)
    ids = F.array(*[F.lit(i) for i in range(m)])
    zeros = (
        cell.sparkSession.range(1)
        .select(F.explode(ids).alias("label"))
        .select("label", F.explode(ids).alias("pred"), F.lit(0).cast("bigint").alias("n"))
    )
    inside = F.col("label").between(0, m - 1) & F.col("pred").between(0, m - 1)
    counted = cell.where(inside).select("label", "pred", "n")
    return counted.unionByName(zeros).groupBy("label", "pred").agg(F.sum("n").alias("n"))


def per_model(t: DataFrame, models: Models) -> DataFrame:
    """Precision, recall, F1 and support per model, with cost and routed ratio."""
    m = len(models)
    hits, label, pred = (rows.entries(c, m) for c in ("hit_n", "label_n", "pred_n"))
    one = F.lit(1.0)
    precision = [h / F.greatest(one, p.cast("double")) for h, p in zip(hits, pred)]
    recall = [h / F.greatest(one, y.cast("double")) for h, y in zip(hits, label)]
    f1 = [F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0) for p, r in zip(precision, recall)]
    total = F.greatest(F.lit(1), F.col("n_labelled"))
    return t.select(
        rows.long_rows(
            {
                "model": [F.lit(n) for n in models.names],
                "precision": precision,
                "recall": recall,
                "f1": f1,
                "support": label,
                "model_cost": models.cost_literals,
                "routed_ratio": [p.cast("double") / total for p in pred],
            }
        )
    )


def fixed_arrays(t: DataFrame, models: Models) -> DataFrame:
    """Add ``fixed_acc`` and ``fixed_cost``: always using one model, over the
    labelled rows."""
    m = len(models)
    acc = [_ratio(c, F.col("n_labelled")) for c in rows.entries("label_n", m)]
    if "model_cost_sum" in t.columns:
        cost = [_ratio(c, F.col("n_labelled")) for c in rows.entries("model_cost_sum", m)]
    else:
        cost = models.cost_literals
    return t.withColumns({"fixed_acc": F.array(*acc), "fixed_cost": F.array(*cost)})


def fixed_baselines(t: DataFrame, models: Models) -> DataFrame:
    """(model_idx, model, acc, cost)."""
    m = len(models)
    return fixed_arrays(t, models).select(
        rows.long_rows(
            {
                "model": [F.lit(n) for n in models.names],
                "acc": rows.entries("fixed_acc", m),
                "cost": rows.entries("fixed_cost", m),
            }
        )
    )


def best_fixed(t: DataFrame, models: Models) -> DataFrame:
    """(model_idx, model, acc, cost) of the most accurate fixed model."""
    m = len(models)
    acc = rows.entries("fixed_acc", m)
    idx = F.col("model_idx")
    return (
        fixed_arrays(t, models)
        .withColumn("model_idx", rows.argmax(acc))
        .select(
            "model_idx",
            models.name_of(idx).alias("model"),
            rows.pick(acc, idx).alias("acc"),
            rows.pick(rows.entries("fixed_cost", m), idx).alias("cost"),
        )
    )


def cheapest_fixed(t: DataFrame, models: Models) -> DataFrame:
    """(model_idx, model, cost) of the model with the lowest mean cost."""
    m = len(models)
    cost = rows.entries("fixed_cost", m)
    idx = F.col("model_idx")
    return (
        fixed_arrays(t, models)
        .withColumn("model_idx", rows.argmin(cost))
        .select("model_idx", models.name_of(idx).alias("model"), rows.pick(cost, idx).alias("cost"))
    )


def _matched(models: Models) -> Column:
    """Index of the cheapest fixed model at least as accurate as the router."""
    m = len(models)
    router = top1_accuracy(m)
    priced = [
        F.when(a + EPSILON >= router, c)
        for a, c in zip(rows.entries("fixed_acc", m), rows.entries("fixed_cost", m))
    ]
    return rows.argmin(priced)


def _matched_ratio(cost: Column) -> Column:
    return F.coalesce(average_cost() / F.greatest(F.when(cost.isNotNull(), F.lit(EPSILON)), cost), F.lit(0.0))


def _meets(cost: Column) -> Column:
    return F.when(cost.isNotNull() & (average_cost() > cost), 0.0).otherwise(1.0)


def matched_baseline(t: DataFrame, models: Models) -> DataFrame:
    """The cheapest fixed model at least as accurate as the router.

    Columns: model_idx (-1 if there is none), model ("none"), cost (infinite),
    cost_ratio (router cost over matched cost, 0 if none), meets (1.0 when the
    router is no dearer, or there is no such model).
    """
    found = fixed_arrays(t, models).withColumn("idx", _matched(models))
    cost = rows.pick(rows.entries("fixed_cost", len(models)), F.col("idx"))
    return found.select(
        F.coalesce("idx", F.lit(-1)).alias("model_idx"),
        F.coalesce(models.name_of(F.col("idx")), F.lit("none")).alias("model"),
        F.coalesce(cost, F.lit(float("inf"))).alias("cost"),
        _matched_ratio(cost).alias("cost_ratio"),
        _meets(cost).alias("meets"),
    )


def oracle_cost(t: DataFrame) -> DataFrame:
    """Mean cost of each query's labelled model."""
    return t.select(_ratio(F.col("label_cost_sum"), F.col("n_labelled")).alias("oracle_cost"))


def fallback(t: DataFrame, models: Models, strategy: str = "best_fixed", name: str | None = None) -> DataFrame:
    """(strategy, model_idx, model): the model used below a confidence cut-off.

    An unknown name means the best fixed model.
    """
    idx = fallback_index(models, strategy, name)
    return (
        fixed_arrays(t, models)
        .withColumn("model_idx", idx)
        .select(F.lit(strategy).alias("strategy"), "model_idx", models.name_of(F.col("model_idx")).alias("model"))
    )


def fallback_index(models: Models, strategy: str, name: str | None = None) -> Column:
    """Over a row with ``fixed_acc``."""
    if strategy == "cheapest":
        return F.lit(models.cheapest)
    if strategy != "best_fixed" and name in models.names:
        return F.lit(models.names.index(name))
    return rows.argmax(rows.entries("fixed_acc", len(models)))


def overall_columns(t: DataFrame, models: Models) -> list[Column]:
    """Every total that the tally allows."""
    m = len(models)
    columns = set(t.columns)
    out = {"n_all": F.col("n_all"), "n_labelled": F.col("n_labelled"), "top1_acc": top1_accuracy(m)}
    if "cost_sum" in columns:
        out |= {
            "avg_cost": average_cost(),
            "cost_per_correct": cost_per_correct(m),
            "cost_savings": cost_savings(models),
        }
    if "quality_sum" in columns:
        out |= {
            "avg_quality": average_quality(),
            "oracle_quality": oracle_quality(),
            "quality_regret": quality_regret(),
            "quality_retention": quality_retention(),
        }
    for k in (3, 5):
        if f"top{k}" in columns and k <= m:
            out[f"top{k}_acc"] = topk_accuracy(k)
    out |= {
        "macro_f1": macro_f1(m),
        "weighted_f1": weighted_f1(m),
        "mcc": matthews(m),
        "kl_div": histogram_kl(m),
    }
    return [c.alias(n) for n, c in out.items()]


def overall(t: DataFrame, models: Models) -> DataFrame:
    """One row with every total."""
    return t.select(*overall_columns(t, models))


def baseline_columns(t: DataFrame, models: Models) -> list[Column]:
    """Route shares and fixed-model baselines, over ``fixed_arrays``."""
    m = len(models)
    acc, cost = rows.entries("fixed_acc", m), rows.entries("fixed_cost", m)
    best, cheap, matched = rows.argmax(acc), rows.argmin(cost), _matched(models)
    out: dict[str, Column] = {}
    for i, name in enumerate(models.names):
        out[f"route_{name}"] = _ratio(rows.entries("pred_all_n", m)[i], F.col("n_all"))
        out[f"fixed_acc_{name}"] = acc[i]
        out[f"fixed_cost_{name}"] = cost[i]
    out |= {
        "baseline_best_fixed_model": best,
        "baseline_best_fixed_model_name": models.name_of(best),
        "baseline_best_fixed_acc": rows.pick(acc, best),
        "baseline_best_fixed_cost": rows.pick(cost, best),
        "baseline_cheapest_model": cheap,
        "baseline_cheapest_model_name": models.name_of(cheap),
        "baseline_cheapest_cost": rows.pick(cost, cheap),
        "matched_perf_min_cost_model": F.coalesce(matched, F.lit(-1)),
        "matched_perf_min_cost_model_name": F.coalesce(models.name_of(matched), F.lit("none")),
        "matched_perf_min_cost": F.coalesce(rows.pick(cost, matched), F.lit(float("inf"))),
        "cost_ratio_vs_matched": _matched_ratio(rows.pick(cost, matched)),
        "meets_cost_minimization_under_perf": _meets(rows.pick(cost, matched)),
    }
    return [c.alias(n) for n, c in out.items()]


def subgroups(out: DataFrame, models: Models, group: str = "eval_name") -> DataFrame:
    """Accuracy, cost and route shares per group of labelled rows.

    A missing group counts as "unknown"; a group without a labelled row has no
    line.
    """
    named = labelled(out).withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    return named.groupBy(F.col("_group").alias("group")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)).alias("top1_acc"),
        F.avg("chosen_cost").alias("avg_cost"),
        *[
            F.avg(F.when(F.col("pred") == i, 1.0).otherwise(0.0)).alias(f"route_{name}")
            for i, name in enumerate(models.names)
        ],
    )
