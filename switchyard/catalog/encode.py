"""C: vocabulary, one-hot and dense vectors, scaling, softmax, argmax."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchyard import derived as D
from switchyard.catalog import features as _features  # its SQL definitions
from switchyard.catalog.registry import M, VIEWS, query, r9, sql
from switchyard.functions import rows
from switchyard.operators import encode as E
from switchyard.operators import text_features as TF

DIM = 384

VIEWS["u_vocab"] = (
    ("u_features",),
    "select key, value, row_number() over (order by key, value) - 1 as idx from (select distinct key, value from u_features) d",
)


def _conversation_features(spark, sf_dir):
    return TF.extract(_features.user_prompts(spark, sf_dir), hash_flags=False, shapes=False).select("query_id", "features")


@query("c01_vocabulary", sql("select key, value, idx from u_vocab", "u_vocab"))
def vocabulary(spark, sf_dir):
    return E.fit_vocabulary(_conversation_features(spark, sf_dir))


_ONE_HOT = sql(
    "select query_id, idx, round(1 / sqrt(count(*) over (partition by query_id)), 9) as value "
    "from t_features join u_vocab using (key, value)",
    "t_features",
    "u_vocab",
)


@query("c02_one_hot", _ONE_HOT)
def one_hot(spark, sf_dir):
    """Documents against the conversations' vocabulary: unknown pairs drop out."""
    vocab = E.fit_vocabulary(_conversation_features(spark, sf_dir))
    documents = TF.extract(D.queries(spark, sf_dir), hash_flags=False, shapes=False)
    return E.one_hot(documents, vocab).withColumn("value", r9("value"))


@query("c02_one_hot_joined", _ONE_HOT)
def one_hot_joined(spark, sf_dir):
    """The same as one sparse vector per document."""
    vocab = E.fit_vocabulary(_conversation_features(spark, sf_dir))
    documents = TF.extract(D.queries(spark, sf_dir), hash_flags=False, shapes=False)
    found = E.one_hot_vectors(documents, vocab).select("query_id", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return found.select("query_id", F.col("e.indices").alias("idx"), r9("e.values").alias("value"))


def _hash_embedding_sql(dim: int, source: str) -> str:
    """(query_id, idx, value) of the non-zero entries, for texts of a view."""
    hi, lo = "('0x' || substr(h, 1, 15))::bigint", "('0x' || substr(h, 16, 15))::bigint"
    high = "(({hi} % {d}) * (1152921504606846976 % {d}) + {lo} % {d}) % {d}"
    w = high.format(hi=hi, lo=lo, d=1000)
    idx = f"(({high.format(hi=hi, lo=lo, d=dim)}) * 256 + ('0x' || substr(h, 31, 2))::bigint) % {dim}"
    lead = ", ".join(f"lead(c0, {k}) over (partition by query_id order by i) as c{k}" for k in range(1, 5))
    chars = (
        "select query_id, len(c) as size, unnest(c) as c0, generate_subscripts(c, 1) as i from "
        f"(select query_id, string_split(prompt, '') as c from {source} where prompt <> '') s"
    )
    short = " || ".join(["c0"] + [f"coalesce(c{k}, '')" for k in range(1, 5)])
    grams = (
        "select query_id, gram from (select query_id, "
        + ", ".join(
            f"case when size < {n} and i = 1 then {short} else {' || '.join(f'c{k}' for k in range(n))} end as g{n}"
            for n in (3, 4, 5)
        )
        + f" from (select *, {lead} from ({chars}) c) w) x unpivot (gram for n in (g3, g4, g5))"
    )
    return (
        f"select query_id, idx, w / sqrt(sum(w * w) over (partition by query_id)) as value from (select query_id, {idx} as idx, "
        f"sum({w})::double as w from (select query_id, md5(gram) as h from ({grams}) g) m group by 1, 2) t"
    )


VIEWS["t_hash_embedding"] = (("f_queries",), _hash_embedding_sql(DIM, "f_queries"))


@query(
    "c03_hash_embedding",
    sql("select query_id, idx, round(value, 9) as value from t_hash_embedding where value <> 0", "t_hash_embedding"),
)
def hash_embedding(spark, sf_dir):
    dense = E.hash_embedding(D.queries(spark, sf_dir), DIM).select("query_id", "embedding")
    return (
        dense.select("query_id", F.posexplode_outer("embedding").alias("idx", "value"))
        .where(F.col("value") != 0)
        .select("query_id", "idx", r9("value").alias("value"))
    )


@query(
    "c04_min_max",
    sql("select dim, round(min(x), 9) as low, round(max(x), 9) as high from e_long group by dim", "e_long"),
)
def min_max(spark, sf_dir):
    low, high = E.min_max(D.table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(zip(low, high))], "dim int, low double, high double"
    ).select("dim", r9("low").alias("low"), r9("high").alias("high"))


VIEWS["e_scaled"] = (
    ("e_long",),
    "select e.vec_id, e.dim, (e.x - s.low) / case when s.high = s.low then 1 else s.high - s.low end as value "
    "from e_long e join (select dim, min(x) as low, max(x) as high from e_long where label < 5 group by dim) s using (dim)",
)


def scaled_embeddings(spark, sf_dir):
    """Range taken from half of the labels, applied to all: not clipped."""
    vectors = D.table(spark, sf_dir, "embeddings")
    low, high = E.min_max(vectors.where(F.col("label") < 5), "embedding")
    scaled = E.scale_min_max(F.col("embedding").cast("array<double>"), low, high)
    return vectors.select("vec_id", scaled.alias("scaled"))


@query("c05_scaled", sql("select vec_id, dim, round(value, 9) as value from e_scaled", "e_scaled"))
def scaled(spark, sf_dir):
    return scaled_embeddings(spark, sf_dir).select(
        "vec_id", F.posexplode("scaled").alias("dim", "value")
    ).withColumn("value", r9("value"))


@query(
    "c07_softmax",
    sql(
        "select query_id, model_idx, round(e / sum(e) over (partition by query_id), 9) as prob from ("
        "select query_id, model_idx, exp((u - max(u) over (partition by query_id)) / 0.5e0) as e from ("
        "select query_id, model_idx, quality - 2.0e0 * cost as u from f_obs) a) b",
        "f_obs",
    ),
)
def softmax(spark, sf_dir):
    df = D.observations(spark, sf_dir)
    utility = [q - 2.0 * c for q, c in zip(rows.entries("quality", M), rows.entries("cost", M))]
    staged = df.select("query_id", F.array(*utility).alias("u"))
    return staged.select(
        "query_id",
        rows.long_rows({"prob": [r9(p) for p in rows.softmax(rows.entries("u", M), 0.5)]}),
    )


@query("c08_argmax", sql("select query_id, model_idx as pred from f_preds where rk = 1", "f_preds"))
def argmax(spark, sf_dir):
    return D.observations(spark, sf_dir).select("query_id", rows.argmax(rows.entries("probs", M)).alias("pred"))


VIEWS["f_unembedded"] = (("f_queries",), "select * from f_queries where query_id not in (select vec_id from embeddings)")


@query(
    "c06_fused",
    sql(
        "select query_id, model_idx as dim, round(0.3e0 * quality, 9) as value from f_obs where quality <> 0 union all "
        "select e.vec_id, e.dim + 5, round(0.7e0 * e.x, 9) from e_long e join f_queries q on q.query_id = e.vec_id where e.x <> 0 "
        f"union all select query_id, idx + 5, round(0.7e0 * value, 9) from ({_hash_embedding_sql(64, 'f_unembedded')}) h "
        "where value <> 0",
        "f_obs",
        "e_long",
        "f_queries",
        "f_unembedded",
    ),
)
def fused(spark, sf_dir):
    """Every document: one without an embedding has its hash embedding."""
    left = D.observations(spark, sf_dir).select("query_id", "quality")
    given = D.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "query_id")
    right = E.embedding_or_hash(D.queries(spark, sf_dir), given, 64)
    return (
        left.join(right, "query_id")
        .select("query_id", F.posexplode(E.fuse(F.col("quality"), F.col("embedding"), 0.3)).alias("dim", "value"))
        .where("value != 0")
        .withColumn("value", r9("value"))
    )


@query(
    "c09_embedding_or_hash",
    sql(
        "select e.vec_id as query_id, e.dim, round(e.x, 9) as value from e_long e join f_queries q on q.query_id = e.vec_id "
        f"where e.x <> 0 union all select query_id, idx, round(value, 9) from ({_hash_embedding_sql(64, 'f_unembedded')}) h "
        "where value <> 0",
        "e_long",
        "f_queries",
        "f_unembedded",
    ),
)
def embedding_or_hash(spark, sf_dir):
    given = D.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "query_id")
    found = E.embedding_or_hash(D.queries(spark, sf_dir), given, 64)
    return (
        found.select("query_id", F.posexplode_outer("embedding").alias("dim", "value"))
        .where(F.col("value") != 0)
        .select("query_id", "dim", r9("value").alias("value"))
    )
