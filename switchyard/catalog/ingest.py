"""A: sources, sinks, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard import derived as D
from switchyard.catalog.registry import M, query, r9, sql
from switchyard.functions import rows
from switchyard.operators import evaluate as G
from switchyard.operators.split import exact_split, hash_split
from switchyard.session import scratch_path
from switchyard.sources import benchmark as B
from switchyard.sources import requests as R
from switchyard.sources import runs

_WIDE_COST = "case when model_idx = 4 and query_id % 7 = 0 then null else cost end"


@query(
    "a01_benchmark_items",
    sql(
        "select o.query_id, md5(any_value(q.prompt)) as text_md5, any_value(q.eval_name) as eval, any_value(l.label) as label, "
        "count(*) as n_models, round(sum(o.quality), 9) as quality_sum, "
        f"round(sum(coalesce({_WIDE_COST}, 0)), 9) as cost_sum "
        "from (select * from f_obs) o join f_queries q using (query_id) join f_labels l using (query_id) group by o.query_id",
        "f_obs",
        "f_queries",
        "f_labels",
    ),
)
def benchmark_items(spark, sf_dir):
    items = B.to_items(D.wide(spark, sf_dir))
    costs = [F.coalesce(c, F.lit(0.0)) for c in rows.entries("costs", M)]
    return items.select(
        "query_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("features")["eval"].alias("eval"),
        "label",
        F.size("quality").cast("bigint").alias("n_models"),
        r9(rows.total(rows.entries("quality", M))).alias("quality_sum"),
        r9(rows.total(costs)).alias("cost_sum"),
    )


@query(
    "a02_discovered_models",
    sql(f"select model_idx, model, count({_WIDE_COST}) as n_costs from f_obs group by model_idx, model", "f_obs"),
)
def discovered_models(spark, sf_dir):
    wide = D.wide(spark, sf_dir)
    names = B.model_names(wide.columns)
    counts = wide.agg(*[F.count(f"`{n}{B.COST_SUFFIX}`").alias(f"n{i}") for i, n in enumerate(names)])
    return counts.select(
        rows.long_rows(
            {"model": [F.lit(n) for n in names], "n_costs": [F.col(f"n{i}") for i in range(len(names))]}
        )
    )


@query(
    "a03_long_observations",
    sql(
        "select query_id, model_idx, model, case when model_idx = 2 then 0.0e0 else quality end as quality, "
        f"round({_WIDE_COST}, 9) as cost from f_obs",
        "f_obs",
    ),
)
def long_observations(spark, sf_dir):
    """One quality column is missing and counts as 0.0."""
    return B.to_long(D.wide(spark, sf_dir).drop("m-c")).withColumn("cost", r9("cost"))


@query(
    "a04_mean_costs",
    sql(
        f"select model_idx, model, round(avg(coalesce({_WIDE_COST}, 0)), 9) as mean_cost from f_obs group by model_idx, model",
        "f_obs",
    ),
)
def mean_costs(spark, sf_dir):
    return B.mean_costs(D.wide(spark, sf_dir)).withColumn("mean_cost", r9("mean_cost"))


@query(
    "a05_oracle_labels",
    sql("select query_id, case when label = 3 then null else label end as label from f_labels", "f_labels"),
)
def oracle_labels(spark, sf_dir):
    """A name outside the model list gives no label."""
    wide = D.wide(spark, sf_dir)
    renamed = wide.withColumn(B.ORACLE, F.when(F.col(B.ORACLE) == "m-d", "another").otherwise(F.col(B.ORACLE)))
    return B.to_items(renamed).select("query_id", "label")


@query(
    "a06_item_defaults",
    sql(
        "select query_id, case when query_id % 10 <> 0 then length(prompt) else 0 end as text_len, "
        "case when lang = 'en' then eval_name else 'unknown' end as eval from f_queries",
        "f_queries",
    ),
)
def item_defaults(spark, sf_dir):
    given = D.queries(spark, sf_dir).withColumns(
        {
            "prompt": F.when(F.col("query_id") % 10 != 0, F.col("prompt")),
            "eval_name": F.when(F.col("lang") == "en", F.col("eval_name")),
        }
    )
    return B.to_items(given.withColumn("m|total_cost", F.lit(0.0))).select(
        "query_id", F.char_length("text").cast("bigint").alias("text_len"), F.col("features")["eval"].alias("eval")
    )


@query(
    "a07_exact_split",
    sql(
        "select query_id, case when row_number() over (order by md5('42:' || query_id), query_id) "
        "<= floor((select count(*) from f_queries) * (1.0e0 - 0.2e0)) then 'train' else 'validation' end as split from f_queries",
        "f_queries",
    ),
)
def split_exactly(spark, sf_dir):
    return exact_split(D.queries(spark, sf_dir).select("query_id"))


@query(
    "a07_hash_split",
    sql(
        "select query_id, case when ('0x' || substr(md5('42:' || query_id), 1, 8))::bigint / 4294967296.0e0 < 0.8e0 "
        "then 'train' else 'validation' end as split from f_queries",
        "f_queries",
    ),
)
def split_by_hash(spark, sf_dir):
    return hash_split(D.queries(spark, sf_dir).select("query_id"))


@query(
    "a08_completeness",
    "select count(*) as n_rows, count(l.toxic) = count(*) as has_label, count(l.quality) = count(*) as has_quality, "
    "count(d.n_chars) = count(*) as has_costs from documents d left join labels l using (doc_id)",
)
def completeness(spark, sf_dir):
    """The labels table covers a part of the documents."""
    documents = D.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = documents.join(D.table(spark, sf_dir, "labels"), "doc_id", "left")
    return B.completeness(
        joined.select(F.col("toxic").alias("label"), "quality", F.col("n_chars").alias("costs"))
    )


@query(
    "a09_request_items",
    "select doc_id as request_id, unnest(range(len(string_split(text, chr(10))))) as pos, "
    "md5(unnest(string_split(text, chr(10)))) as text_md5, lang from documents",
)
def request_items(spark, sf_dir):
    """Each document becomes a request with its lines as items; written as JSON
    lines and read back with the request schema."""
    path = scratch_path(spark, "requests")
    documents = D.table(spark, sf_dir, "documents")
    documents.select(
        F.col("doc_id").alias("request_id"),
        F.transform(
            F.split("text", "\n"),
            lambda line: F.struct(line.alias("text"), F.create_map(F.lit("lang"), F.col("lang")).alias("features")),
        ).alias("items"),
        F.array(*[F.lit(n) for n in D.MODELS.names]).alias("model_names"),
        F.array(*D.MODELS.cost_literals).alias("model_costs"),
    ).write.json(path)
    return R.request_items(R.read_requests(spark, path)).select(
        "request_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("features")["lang"].alias("lang"),
    )


def _log_metrics(spark, sf_dir):
    by_run = (
        D.route_log(spark, sf_dir)
        .groupBy(F.col("flag").alias("run_id"))
        .agg(
            r9(F.avg("cost")).alias("avg_cost"),
            r9(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0))).alias("top1_acc"),
        )
    )
    long = by_run.unpivot("run_id", ["avg_cost", "top1_acc"], "metric", "value")
    path = scratch_path(spark, "metrics")
    runs.log_metrics(long.withColumn("text", F.lit(None).cast("string")), path)
    return path


_RUN_METRICS = (
    "select run_id, metric, value from (select flag as run_id, round(avg(cost), 9) as avg_cost, "
    "round(avg(case when pred = label then 1.0e0 else 0.0e0 end), 9) as top1_acc from f_route_log group by flag) t "
    "unpivot (value for metric in (avg_cost, top1_acc))"
)


@query("a10_metrics_sink", sql(_RUN_METRICS, "f_route_log"))
def metrics_sink(spark, sf_dir):
    path = _log_metrics(spark, sf_dir)
    return spark.read.schema(runs.METRIC_SCHEMA).parquet(path).select("run_id", "metric", "value")


@query("a11_metrics_of_run", sql(f"select * from ({_RUN_METRICS}) u where run_id = 'R'", "f_route_log"))
def metrics_of_run(spark, sf_dir):
    path = _log_metrics(spark, sf_dir)
    return runs.metrics_or_not_found(spark, path, "R").select("run_id", "metric", "value")


@query(
    "a12_report_sink",
    sql(
        "select label, pred, count(*) as n from f_route_log group by label, pred",
        "f_route_log",
    ),
)
def report_sink(spark, sf_dir):
    """A report table written as JSON and read back."""
    path = scratch_path(spark, "report")
    table = G.confusion(G.cells(D.route_log(spark, sf_dir), D.MODELS), D.MODELS)
    runs.write_tables({"confusion_matrix": table}, path, "run-1")
    return runs.read_table(spark, path, "confusion_matrix", "run-1", table.schema).select("label", "pred", "n")


@query(
    "a13_cluster_inputs",
    sql(
        "select query_id, eval_name as eval, case when lang = 'en' then lang else '' end as lang, "
        "(select sum(quality) from f_obs o where o.query_id = q.query_id) as quality_sum from f_queries q",
        "f_queries",
        "f_obs",
    ),
)
def cluster_inputs(spark, sf_dir):
    """Null feature values are written as empty strings."""
    path = scratch_path(spark, "cluster-inputs")
    given = D.observations(spark, sf_dir).withColumn(
        "features",
        F.create_map(
            F.lit("eval"), F.col("eval_name"), F.lit("lang"), F.when(F.col("lang") == "en", F.col("lang"))
        ),
    )
    runs.dump_cluster_inputs(given, path)
    back = spark.read.schema("query_id long, features map<string,string>, quality array<double>").json(path)
    return back.select(
        "query_id",
        F.col("features")["eval"].alias("eval"),
        F.col("features")["lang"].alias("lang"),
        rows.total(rows.entries("quality", M)).alias("quality_sum"),
    )
