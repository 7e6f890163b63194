"""D: clustering and cluster profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard import derived as D
from switchyard.catalog import features as _features
from switchyard.catalog.registry import M, VIEWS, query, r9, sql
from switchyard.config import RouterConfig
from switchyard.functions import rows
from switchyard.operators import clusters as C
from switchyard.operators import dcf
from switchyard.operators import profiles as P
from switchyard.operators import text_features as TF
from switchyard.session import materialise, scratch_path
from switchyard.sources import runs

MODELS = D.MODELS
BETA = 0.1

# Buckets by language, two local clusters by length.
VIEWS["k_records"] = (
    ("t_surface", "f_clusters", "f_queries"),
    "select s.*, c.cluster_id as coarse_id, case when q.n_chars <= 1500 then 0 else 1 end as local "
    "from t_surface s join f_clusters c using (query_id) join f_queries q using (query_id)",
)
_KEYS = _features.SURFACE_KEYS
_JSON = (
    "'[' || "
    + " || ',' || ".join(f"""'{{"key":"{k}","value":"' || {k} || '"}}'""" for k in _KEYS)
    + " || ']'"
)
VIEWS["k_unique"] = (
    ("k_records",),
    f"select coarse_id, md5({_JSON}) as record_key, count(*) as n, min(query_id) as first_id from k_records group by 1, 2",
)


def records(spark, sf_dir):
    """(query_id, features, coarse_id, local): surface features of documents."""
    lang = F.col("lang")
    return TF.extract(D.queries(spark, sf_dir), hash_flags=False, shapes=False).select(
        "query_id",
        "features",
        F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(4).alias("coarse_id"),
        F.when(F.col("n_chars") <= 1500, 0).otherwise(1).alias("local"),
    )


_fitted: dict[str, tuple] = {}


def fitted(spark, sf_dir):
    """One fit on the documents' surface features, shared by the queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        stored = materialise(records(spark, sf_dir).select("query_id", "features"), "records")
        config = RouterConfig(num_clusters=3, coarse_clusters=6, cluster_fit_size=500)
        _fitted[key] = (C.fit_clusters(stored, config, stored.count()), stored)
    return _fitted[key]


@query("d01_coarse_clusters")
def coarse_clusters(spark, sf_dir):
    found, stored = fitted(spark, sf_dir)
    return found.coarse_ids(stored).select("query_id", "coarse_id")


@query("d01_assigned_is_nearest", sql("select query_id, true as is_nearest from f_queries", "f_queries"))
def coarse_is_nearest(spark, sf_dir):
    """No other centre has a smaller Jensen-Shannon divergence, worked out from its definition."""
    found, stored = fitted(spark, sf_dir)
    own = found.coarse_ids(stored).select("query_id", "coarse_id")
    centres = found.centres.select(F.col("local").alias("centre"), F.explode(F.arrays_zip("terms", "p")).alias("t"))
    centres = centres.select("centre", F.col("t.terms").alias("term"), F.col("t.p").alias("p"))
    each = stored.select("query_id", (1.0 / F.size("features")).alias("x"), F.explode("features").alias("key", "value"))
    met = each.select("query_id", "x", F.xxhash64("key", "value").alias("term")).join(centres, "term")
    x, p, m = F.col("x"), F.col("p"), (F.col("x") + F.col("p")) / 2
    # A feature of one side only adds half its share.
    shared = met.withColumn("less", (x + p) / 2 - (x * F.log2(x / m) + p * F.log2(p / m)) / 2)
    sums = shared.groupBy("query_id", "centre").agg((1 - F.sum("less")).alias("js"))
    every = stored.select("query_id", F.explode(F.array(*[F.lit(r["local"]) for r in found.centres.select("local").collect()])).alias("centre"))
    js = every.join(sums, ["query_id", "centre"], "left").withColumn("js", F.coalesce("js", F.lit(1.0)))
    least = js.groupBy("query_id").agg(F.min("js").alias("least"))
    mine = js.join(own, "query_id").where("centre = coarse_id").select("query_id", "js")
    return mine.join(least, "query_id").select("query_id", (F.col("js") <= F.col("least") + 1e-8).alias("is_nearest"))


@query("d02_bucket_sizes", sql("select coarse_id, count(*) as coarse_size from k_records group by coarse_id", "k_records"))
def bucket_sizes(spark, sf_dir):
    return C.coarse_sizes(records(spark, sf_dir))


@query("d03_unique_records", sql("select coarse_id, record_key, n, first_id from k_unique", "k_unique"))
def unique_records(spark, sf_dir):
    return C.unique_records(records(spark, sf_dir))


@query(
    "d04_bounded_sample",
    sql(
        "select coarse_id, record_key, n from (select *, row_number() over (partition by coarse_id "
        "order by md5('42:' || record_key), record_key) as rk from k_unique) t where rk <= 20",
        "k_unique",
    ),
)
def bounded_sample(spark, sf_dir):
    return C.bounded_sample(C.unique_records(records(spark, sf_dir)), 20).select("coarse_id", "record_key", "n")


VIEWS["k_unkeyed"] = (
    ("t_features",),
    "select query_id, string_agg(key || '=' || value, ',' order by key) as kind from t_features group by query_id",
)


@query(
    "d05_profile_weights",
    sql("select count(*) as n_records from f_queries", "f_queries"),
)
def profile_weights(spark, sf_dir):
    """The profiles count every record, merged or assigned."""
    found, _ = fitted(spark, sf_dir)
    return found.weights.agg(F.sum("w").cast("bigint").alias("n_records"))


@query("d05_summary_weights", sql("select coarse_id, count(*) as n_records from k_records group by coarse_id", "k_records"))
def summary_weights(spark, sf_dir):
    """Before the first merge every record is in one of at most 20 summaries of its bucket."""
    given = records(spark, sf_dir)
    kinds = given.groupBy(F.col("coarse_id").alias("bucket"), C.record_key(F.col("features")).alias("record_key")).agg(
        F.count("*").alias("n"), F.first("features").alias("features")
    )
    kinds = kinds.withColumn("terms", dcf.terms_of(F.col("features")))
    whole, _ = C.summarise(materialise(kinds, "records"), 20)
    counted = whole.groupBy("coarse_id", "local").agg(F.sum("n").alias("w"))
    few = counted.groupBy("coarse_id").agg(F.count("*").alias("summaries")).where("summaries > 20").count()
    if few:
        raise ValueError("a bucket has more summaries than it may")
    return counted.groupBy("coarse_id").agg(F.sum("w").cast("bigint").alias("n_records"))


def _single_bucket(spark, sf_dir, **settings):
    stored = materialise(records(spark, sf_dir).select("query_id", "features"), "records")
    return C.fit_clusters(stored, RouterConfig(coarse_clusters=1, cluster_fit_size=50, **settings), stored.count())


@query(
    "d05_one_cluster",
    sql(
        "select key, value, round(count(*) / (13.0e0 * (select count(*) from f_queries)), 9) as p from t_features group by 1, 2",
        "t_features",
    ),
)
def one_cluster(spark, sf_dir):
    """Merged down to one cluster, the profile is that of all records."""
    return _single_bucket(spark, sf_dir, num_clusters=1).feature_probs.select("key", "value", r9("p").alias("p"))


@query(
    "d05_every_kind_a_cluster",
    sql("select n as w, count(*) as clusters from (select count(*) as n from k_unkeyed group by kind) u group by n", "k_unkeyed"),
)
def every_kind_a_cluster(spark, sf_dir):
    """With as many clusters as different records each record has its own."""
    found = _single_bucket(spark, sf_dir, num_clusters=1 << 30).weights
    return found.groupBy(F.col("w").cast("bigint").alias("w")).agg(F.count("*").alias("clusters"))


@query("d05_merged_clusters")
def merged_clusters(spark, sf_dir):
    """(query_id, coarse_id, cluster_id) after merging and assignment."""
    found, stored = fitted(spark, sf_dir)
    return found.predict(stored).select("query_id", "coarse_id", "cluster_id", r9("loss").alias("loss"))


@query(
    "d06_offsets",
    sql(
        "select coarse_id, k as local_clusters, coalesce(sum(k) over (order by coarse_id rows between unbounded preceding "
        "and 1 preceding), 0)::bigint as label_offset from (select coarse_id, count(distinct local) as k from k_records "
        "group by coarse_id) t",
        "k_records",
    ),
)
def offsets(spark, sf_dir):
    counts = records(spark, sf_dir).groupBy("coarse_id").agg((F.max("local") + 1).cast("bigint").alias("local_clusters"))
    return C.offsets(counts).withColumnRenamed("offset", "label_offset")


@query(
    "d07_cluster_info",
    sql(
        "select coarse_id, sum(n)::bigint as coarse_size, count(*) as unique_records, any_value(k) as local_clusters "
        "from k_unique join (select coarse_id, count(distinct local) as k from k_records group by 1) c using (coarse_id) "
        "group by coarse_id",
        "k_unique",
    ),
)
def cluster_info(spark, sf_dir):
    given = records(spark, sf_dir)
    counts = given.groupBy("coarse_id").agg((F.max("local") + 1).cast("bigint").alias("local_clusters"))
    return C.cluster_info(C.unique_records(given), counts)


VIEWS["k_losses"] = (
    ("k_records", "t_features"),
    "select query_id, coarse_id, local, (1 + w) * sum(case when own > 0 then a * own * log2(own / (a * own + b * p)) else 0 end "
    "+ case when p > 0 then b * p * log2(p / (a * own + b * p)) else 0 end) as loss from ("
    "select x.query_id, x.coarse_id, c.local, c.w, 1 / (1 + c.w) as a, c.w / (1 + c.w) as b, "
    "case when t.key is null then 0 else 1 / 13.0e0 end as own, coalesce(d.n, 0) / (13.0e0 * c.w) as p "
    "from (select query_id, coarse_id from k_records) x "
    "join (select coarse_id, local, count(*)::double as w from k_records group by 1, 2) c using (coarse_id) "
    "join (select distinct r.coarse_id, f.key, f.value from k_records r join t_features f using (query_id)) v using (coarse_id) "
    "left join t_features t on t.query_id = x.query_id and t.key = v.key and t.value = v.value "
    "left join (select r.coarse_id, r.local, f.key, f.value, count(*) as n from k_records r join t_features f "
    "using (query_id) group by 1, 2, 3, 4) d on d.coarse_id = x.coarse_id and d.local = c.local and d.key = v.key "
    "and d.value = v.value) z group by query_id, coarse_id, local, w",
)


@query(
    "d08_assignment",
    sql(
        "select query_id, coarse_id, arg_min(local, (round(loss, 9), local)) as local, round(min(loss), 9) as loss "
        "from k_losses group by query_id, coarse_id",
        "k_losses",
    ),
)
def assignment(spark, sf_dir):
    """Each record to the cluster of its bucket that loses least information."""
    given = materialise(records(spark, sf_dir), "records")
    probs, weights = C.profile_table(given.withColumn("n", F.lit(1)))
    found = C.assign(given.drop("local"), probs, weights)
    return found.withColumn("loss", r9("loss"))


@query("d09_cluster_sizes", sql("select cluster_id, count(*) as size from f_clusters group by cluster_id", "f_clusters"))
def cluster_sizes(spark, sf_dir):
    return P.sizes(D.clusters(spark, sf_dir))


VIEWS["k_counts"] = (
    ("t_features", "f_clusters"),
    "select cluster_id, key, value, count(*) as n from t_features join f_clusters using (query_id) group by 1, 2, 3",
)


def _cluster_features(spark, sf_dir):
    return P.cluster_features(records(spark, sf_dir).withColumnRenamed("coarse_id", "cluster_id"))


_TOP = (
    "select cluster_id, rk as rank, key, value, n from (select *, row_number() over (partition by cluster_id "
    "order by n desc, key, value) as rk from k_counts) t where rk <= {k}"
)


@query(
    "d10_coarse_summary",
    sql(
        "select t.*, s.size from (" + _TOP.format(k=5) + ") t join (select cluster_id, count(*) as size from f_clusters "
        "group by 1) s using (cluster_id)",
        "k_counts",
    ),
)
def coarse_summary(spark, sf_dir):
    given = materialise(records(spark, sf_dir).withColumnRenamed("coarse_id", "cluster_id"), "records")
    return P.top_features(P.cluster_features(given), 5).join(P.sizes(given), "cluster_id")


def _profile(spark, sf_dir):
    return P.mean_quality(D.clustered(spark, sf_dir), MODELS)


@query(
    "d11_mean_quality",
    sql("select cluster_id, model_idx, model, round(quality, 9) as quality from f_profile", "f_profile"),
)
def mean_quality(spark, sf_dir):
    return P.long_form(_profile(spark, sf_dir), MODELS, "quality").withColumn("quality", r9("quality"))


@query(
    "d12_utility",
    sql("select cluster_id, model_idx, model, round(utility, 9) as utility from f_profile", "f_profile"),
)
def utility(spark, sf_dir):
    scored = P.with_utility(_profile(spark, sf_dir), MODELS, BETA)
    return P.long_form(scored, MODELS, "utility").withColumn("utility", r9("utility"))


VIEWS["k_best"] = (
    ("f_profile",),
    "select cluster_id, model_idx as best_idx, model as best_model from (select *, row_number() over (partition by "
    "cluster_id order by utility desc, model_idx) as rk from f_profile) t where rk = 1",
)


@query("d13_best_model", sql("select * from k_best", "k_best"))
def best_model(spark, sf_dir):
    return P.best_by_utility(_profile(spark, sf_dir), MODELS, BETA)


_FILLED = (
    "select g.cluster_id, coalesce(b.best_idx, 0) as best_idx, coalesce(b.best_model, 'm-a') as best_model from "
    "(select unnest(range((select max(cluster_id) + 1 from {best})))::int as cluster_id) g left join {best} b using (cluster_id)"
)


@query("d13b_empty_clusters", sql(_FILLED.format(best="k_best"), "k_best"))
def empty_clusters(spark, sf_dir):
    return P.fill_empty(best_model(spark, sf_dir), MODELS)


_SOFTMAX = (
    "select cluster_id, model_idx, model, e / sum(e) over (partition by cluster_id) as prob from (select *, "
    "exp((utility - max(utility) over (partition by cluster_id)) / 0.5e0) as e from f_profile) t"
)
VIEWS["k_softmax"] = (("f_profile",), _SOFTMAX)
VIEWS["k_min_cost"] = (
    ("f_profile", "k_best"),
    "select p.cluster_id, p.model_idx, p.model, case when s.total > 0 then (case when quality >= 0.75e0 then "
    "1 / greatest(price, 1e-6) else 0 end) / s.total when p.model_idx = b.best_idx then 1 else 0 end as prob from f_profile p "
    "join (select cluster_id, sum(case when quality >= 0.75e0 then 1 / greatest(price, 1e-6) else 0 end) as total "
    "from f_profile group by 1) s using (cluster_id) join k_best b using (cluster_id)",
)


def _long_probs(resolved):
    return P.long_form(resolved, MODELS, "probs").select("cluster_id", "model_idx", "model", r9("probs").alias("prob"))


@query(
    "d14_softmax_probs",
    sql("select cluster_id, model_idx, model, round(prob, 9) as prob from k_softmax", "k_softmax"),
)
def softmax_probs(spark, sf_dir):
    return _long_probs(P.utility_probs(_profile(spark, sf_dir), MODELS, BETA, 0.5))


@query(
    "d15_min_cost_probs",
    sql("select cluster_id, model_idx, model, round(prob, 9) as prob from k_min_cost", "k_min_cost"),
)
def min_cost_probs(spark, sf_dir):
    return _long_probs(P.min_cost_probs(_profile(spark, sf_dir), MODELS, BETA, 0.75))


VIEWS["k_cheapest"] = (
    ("f_profile",),
    "select cluster_id, model_idx as best_idx, model as best_model from (select *, row_number() over (partition by "
    "cluster_id order by case when quality >= 0.75e0 then 0 else 1 end, "
    "case when quality >= 0.75e0 then price else -quality end, model_idx) as rk from f_profile) t where rk = 1",
)


@query("d16_min_cost_mapping", sql(_FILLED.format(best="k_cheapest"), "k_cheapest"))
def min_cost_mapping(spark, sf_dir):
    return P.fill_empty(P.best_by_cost(_profile(spark, sf_dir), MODELS, 0.75), MODELS)


@query(
    "d17_lookup",
    sql("select c.query_id, c.cluster_id, b.best_idx, b.best_model from f_clusters c join k_best b using (cluster_id)", "f_clusters", "k_best"),
)
def lookup(spark, sf_dir):
    return P.lookup(D.clusters(spark, sf_dir), best_model(spark, sf_dir))


VIEWS["k_resolved"] = (
    ("k_min_cost",),
    "select cluster_id, first(model_idx order by prob desc, model_idx) as best_idx, "
    "first(model order by prob desc, model_idx) as best_model from k_min_cost group by cluster_id",
)


def _resolved(spark, sf_dir):
    return P.resolve_probs(
        _profile(spark, sf_dir), MODELS, objective="min_cost", beta=BETA, threshold=0.75, temperature=0.5
    )


@query(
    "d18_resolved_probs",
    sql(
        "select c.cluster_id, c.model_idx, c.model, round(c.prob, 9) as prob, r.best_model from k_min_cost c "
        "join k_resolved r using (cluster_id)",
        "k_min_cost",
        "k_resolved",
    ),
)
def resolved_probs(spark, sf_dir):
    found = _resolved(spark, sf_dir)
    return found.select(
        "cluster_id",
        "best_model",
        rows.long_rows(
            {"model": [F.lit(n) for n in MODELS.names], "prob": [r9(p) for p in rows.entries("probs", M)]}
        ),
    )


@query(
    "d19_summary",
    sql(
        "select count(*) over () as n_clusters, cluster_id, size as count, best_model from (select cluster_id, "
        "any_value(size) as size from f_profile group by 1) s join k_resolved using (cluster_id) "
        "qualify row_number() over (order by size desc, cluster_id) <= 3",
        "f_profile",
        "k_resolved",
    ),
)
def summary(spark, sf_dir):
    return P.summary(_resolved(spark, sf_dir), 3).drop("probs")


_PROFILES = sql(
    "select c.cluster_id, r.best_model, "
    + ", ".join(f"round(max(case when c.model_idx = {i} then c.prob end), 9) as p{i}" for i in range(M))
    + " from k_min_cost c join k_resolved r using (cluster_id) group by 1, 2",
    "k_min_cost",
    "k_resolved",
)


@query("d20_profiles", _PROFILES)
def profiles(spark, sf_dir):
    found = _resolved(spark, sf_dir).orderBy("cluster_id")
    return found.select("cluster_id", "best_model", *[r9(p).alias(f"p{i}") for i, p in enumerate(rows.entries("probs", M))])


_ENTROPY = (
    "select cluster_id, s.size as records, round(-sum(n / (13.0e0 * s.size) * log2(n / (13.0e0 * s.size))), 9) as entropy "
    "from k_counts join (select cluster_id, count(*)::double as size from f_clusters group by 1) s using (cluster_id) "
    "group by cluster_id, s.size"
)


@query("d21_entropy", sql(_ENTROPY, "k_counts"))
def entropy(spark, sf_dir):
    found = P.entropy(_cluster_features(spark, sf_dir))
    return found.select("cluster_id", r9("records").alias("records"), r9("entropy").alias("entropy"))


@query("d21_top_features", sql(_TOP.format(k=10), "k_counts"))
def top_features(spark, sf_dir):
    return P.top_features(_cluster_features(spark, sf_dir))


@query(
    "d21_separation",
    sql(
        "select round((select -sum(p * log2(p)) from (select sum(n) / (13.0e0 * (select count(*) from f_clusters)) as p "
        "from k_counts group by key, value) a) - sum(records * entropy) / sum(records), 5) as separation from "
        "(select cluster_id, s.size as records, -sum(n / (13.0e0 * s.size) * log2(n / (13.0e0 * s.size))) as entropy "
        "from k_counts join (select cluster_id, count(*)::double as size from f_clusters group by 1) s using (cluster_id) "
        "group by cluster_id, s.size) e",
        "k_counts",
    ),
)
def separation(spark, sf_dir):
    found = P.separation(materialise(_cluster_features(spark, sf_dir), "cluster-features"))
    return found.select(F.round("separation", 5).alias("separation"))


@query(
    "d21_details_add_up",
    sql("select count(*) as n_records, true as entropies_fit, true as parents_fit from f_queries", "f_queries"),
)
def details_add_up(spark, sf_dir):
    """Sizes sum to the records; a parent's clusters are no more than its different records; no
    entropy is above that of as many equal features as the cluster can have."""
    found, stored = fitted(spark, sf_dir)
    placed = materialise(found.predict(stored).join(stored, "query_id"), "placed")
    details, _ = P.cluster_details(placed, found.offsets, found.info)
    values = placed.select("cluster_id", F.explode("features").alias("key", "value")).distinct().groupBy("cluster_id").count()
    joined = details.join(values, "cluster_id")
    return joined.agg(
        F.sum("size").alias("n_records"),
        F.min(F.col("entropy") <= F.log2("count") + 1e-9).alias("entropies_fit"),
        F.min((F.col("local_clusters") <= F.col("unique_records")) & (F.col("size") <= F.col("coarse_size"))).alias("parents_fit"),
    )


@query("d21_cluster_details")
def cluster_details(spark, sf_dir):
    """Size, entropy, separation of its bucket, parent and offset per cluster."""
    found, stored = fitted(spark, sf_dir)
    placed = materialise(found.predict(stored).join(stored, "query_id"), "placed")
    return P.cluster_details(placed, found.offsets, found.info)[0]


@query("a14_cluster_dump", _PROFILES)
def cluster_dump(spark, sf_dir):
    """Cluster profiles written as JSON and read back."""
    path = scratch_path(spark, "clusters")
    table = profiles(spark, sf_dir)
    runs.write_tables({"profiles": table}, path, "run-1")
    return runs.read_table(spark, path, "profiles", "run-1", table.schema).select(*table.columns)


@query("d22_embedding_clusters")
def embedding_clusters(spark, sf_dir):
    vectors = D.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = C.fit_embedding_clusters(vectors, 10)
    return C.predict_embedding_clusters(vectors, model).select("vec_id", "embed_cluster")


@query("d22_assigned_is_nearest", "select vec_id, true as is_nearest from embeddings")
def assigned_is_nearest(spark, sf_dir):
    """Whether each vector has the cluster whose centre is nearest to it."""
    vectors = D.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = C.fit_embedding_clusters(vectors, 10, n_init=2)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    found = C.predict_embedding_clusters(vectors, model)
    return found.select("vec_id", (F.col("embed_cluster") == C.nearest_centre(F.col("embedding"), centres)).alias("is_nearest"))


@query("d23_nearest_centre", sql("select vec_id, centre from e_nearest", "e_nearest"))
def nearest_centre(spark, sf_dir):
    centres = _features.label_centres(spark, sf_dir)
    return D.table(spark, sf_dir, "embeddings").select(
        "vec_id", C.nearest_centre(F.col("embedding"), centres).alias("centre")
    )


@query("d24_checked_input", sql("select cluster_id, count(*) as size from f_clusters group by 1", "f_clusters"))
def checked_input(spark, sf_dir):
    """Raises unless every record has one quality value per model."""
    given = D.clustered(spark, sf_dir)
    C.check_inputs(given, M)
    C.check_matching(given, D.observations(spark, sf_dir))
    return P.sizes(given)
