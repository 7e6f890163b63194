"""B: text features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from switchyard import derived as D
from switchyard.catalog.registry import VIEWS, query, r9, sql
from switchyard.functions import text as T
from switchyard.operators import annotated as A
from switchyard.operators import encode as E
from switchyard.operators import tagger as G
from switchyard.operators import text_features as TF
from switchyard.operators.clusters import nearest_centre


def _bucket(value: str, thresholds) -> str:
    return "case " + " ".join(f"when {value} <= {t} then '{i}'" for i, t in enumerate(thresholds)) + f" else '{len(thresholds)}' end"


def _pct(a: str, b: str) -> str:
    return f"trunc({a} / greatest(1, {b})::double * 100)"


_BLANK = r"\s\x0b\x1c-\x1f"
_WORDS = r"[\p{L}\p{M}\p{Nd}_]+|[^\p{L}\p{M}\p{Nd}_\s]"


def _surface(source: str) -> tuple[str, str]:
    """SQL of the counts and of the buckets for (query_id, prompt) of a view."""
    counts = (
        f"select query_id, prompt, length(prompt) as n_chars, regexp_extract_all(prompt, '[^{_BLANK}]+') as tokens, "
        r"len(regexp_extract_all(prompt, '\p{Nd}')) as n_digits, "
        r"len(regexp_extract_all(prompt, '[=<>±×÷∑√∫π∞+\-*/]')) as n_math, "
        r"len(regexp_extract_all(prompt, '```|\bdef\b|\bclass\b')) as n_code, "
        "len(regexp_extract_all(prompt, '[!?,.;:]')) as n_punct, "
        r"regexp_matches(prompt, '(?i)https?://|www\.') as url, "
        f"regexp_replace(prompt, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') as body, "
        f"regexp_extract_all(prompt, '{_WORDS}') as words from {source}"
    )
    more = (
        "select *, len(tokens) as n_tokens, "
        r"len(list_filter(tokens, lambda x: regexp_full_match(x, '[\p{Lu}\p{Lo}\p{Lm}]*\p{Lu}[\p{Lu}\p{Lo}\p{Lm}]*'))) as n_upper, "
        r"len(regexp_extract_all(body, '[.!?]+([\s\x0b\x1c-\x1f]|$)')) "
        r"+ case when regexp_matches(body, '[^.!?]$') then 1 else 0 end as n_sentences, "
        r"len(words) as n_words, len(list_filter(words, lambda x: regexp_full_match(x, '\p{Lu}\p{Ll}*'))) as n_titles "
        f"from ({counts}) a"
    )
    buckets = (
        f"{_bucket('n_chars', T.LEN_THRESHOLDS)} as len_bucket, "
        f"{_bucket('n_tokens', T.TOKEN_THRESHOLDS)} as token_bucket, "
        "case when n_digits > 0 then '1' else '0' end as has_number, "
        f"{_bucket(_pct('n_digits', 'n_chars'), T.NUMBER_THRESHOLDS)} as number_density_bucket, "
        "case when n_math > 0 then '1' else '0' end as has_math_symbol, "
        f"{_bucket(_pct('n_math', 'n_tokens'), T.MATH_THRESHOLDS)} as math_density_bucket, "
        "case when n_code > 0 then '1' else '0' end as has_code_pattern, "
        f"{_bucket(_pct('n_punct', 'n_tokens'), T.PUNCT_THRESHOLDS)} as punct_density_bucket, "
        "case when url then '1' else '0' end as contains_url, "
        f"{_bucket(_pct('n_upper', 'n_tokens'), T.UPPER_THRESHOLDS)} as upper_density_bucket"
    )
    return more, buckets


_LINGUISTIC = (
    f"{_bucket('n_sentences', T.SENTENCE_THRESHOLDS)} as sent_bucket, "
    f"{_bucket('n_words', T.WORD_THRESHOLDS)} as spacy_token_bucket, "
    f"{_bucket(_pct('n_titles', 'n_words'), T.TITLE_THRESHOLDS)} as title_density_bucket"
)
_COUNTS, _BUCKETS = _surface("f_queries")
SURFACE_KEYS = (
    "contains_url", "has_code_pattern", "has_math_symbol", "has_number", "len_bucket", "math_density_bucket",
    "number_density_bucket", "punct_density_bucket", "sent_bucket", "spacy_token_bucket", "title_density_bucket",
    "token_bucket", "upper_density_bucket",
)

VIEWS["t_counts"] = (("f_queries",), _COUNTS)
VIEWS["t_surface"] = (("t_counts",), f"select query_id, {_BUCKETS}, {_LINGUISTIC} from t_counts")
VIEWS["t_features"] = (
    ("t_surface",),
    f"select query_id, key, value from t_surface unpivot (value for key in ({', '.join(SURFACE_KEYS)}))",
)
# Conversation prompts: the user turns.
VIEWS["u_prompts"] = (
    (),
    "select conv_id * 1000 + turn as query_id, text as prompt from conversations where role = 'user'",
)
_U_COUNTS, _U_BUCKETS = _surface("u_prompts")
VIEWS["u_surface"] = (("u_prompts",), f"select query_id, {_U_BUCKETS}, {_LINGUISTIC} from ({_U_COUNTS}) c")
VIEWS["u_features"] = (
    ("u_surface",),
    f"select query_id, key, value from u_surface unpivot (value for key in ({', '.join(SURFACE_KEYS)}))",
)


def user_prompts(spark, sf_dir):
    return (
        D.table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("prompt"))
    )


@query("b01_bucket", f"select doc_id as query_id, {_bucket('n_chars', (100, 1000, 2000, 5000))} as bucket from documents")
def bucket(spark, sf_dir):
    return D.queries(spark, sf_dir).select("query_id", T.bucket(F.col("n_chars"), (100, 1000, 2000, 5000)).alias("bucket"))


@query(
    "b02_safe_ratio",
    "select l_returnflag as flag, round(avg(case when l_discount > 0 then l_tax / l_discount else 0.0e0 end), 9) as ratio, "
    "count(*) as n from lineitem group by l_returnflag",
)
def safe_ratio(spark, sf_dir):
    """The denominator is 0 on some rows."""
    items = D.table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_returnflag").alias("flag")).agg(
        r9(F.avg(T.safe_ratio(F.col("l_tax"), F.col("l_discount")))).alias("ratio"), F.count(F.lit(1)).alias("n")
    )


_SURFACE_NAMES = (
    "len_bucket, token_bucket, has_number, number_density_bucket, has_math_symbol, math_density_bucket, "
    "has_code_pattern, punct_density_bucket, contains_url, upper_density_bucket"
)


@query("b03_b12_surface_features", sql(f"select query_id, {_SURFACE_NAMES} from t_surface", "t_surface"))
def surface_features(spark, sf_dir):
    return TF.surface_columns(D.queries(spark, sf_dir))


@query("b03_b12_conversation_features", sql(f"select query_id, {_SURFACE_NAMES} from u_surface", "u_surface"))
def conversation_features(spark, sf_dir):
    return TF.surface_columns(user_prompts(spark, sf_dir))


# Characters with their followers; grams of three, four and five.
VIEWS["t_chars"] = (
    ("f_queries",),
    "select query_id, unnest(c) as c0, generate_subscripts(c, 1) as i from (select query_id, string_split("
    f"regexp_replace(lower(prompt), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '') as c from f_queries) s where c <> ['']",
)
VIEWS["t_grams"] = (
    ("t_chars",),
    "select query_id, i, n, gram from (select query_id, i, c0 || c1 || c2 as g3, c0 || c1 || c2 || c3 as g4, "
    "c0 || c1 || c2 || c3 || c4 as g5 from (select *, "
    + ", ".join(f"lead(c0, {k}) over (partition by query_id order by i) as c{k}" for k in range(1, 5))
    + " from t_chars) w) x unpivot (gram for n in (g3, g4, g5))",
)
VIEWS["t_hash"] = (
    ("t_grams",),
    "select distinct query_id, 'hash' || substr(n, 2) || '_' || ('0x' || substr(md5(gram), 31, 2))::bigint % 128 as key "
    "from t_grams",
)


@query("b13_hash_flags", sql("select query_id, key from t_hash", "t_hash"))
def hash_flags(spark, sf_dir):
    hashed = TF.with_hash_buckets(D.queries(spark, sf_dir))
    return hashed.select("query_id", F.explode_outer(TF.hash_keys()).alias("key")).where(F.col("key").isNotNull())


_TAGS = (
    "select query_id, pos, case when regexp_full_match(token, '[0-9]+') then 'NUM' "
    r"when regexp_matches(token, '^\p{Lu}') then 'PROPN' when length(token) <= 2 then 'PART' else 'NOUN' end as tag "
    "from (select query_id, unnest(string_split(prompt, ' ')) as token, "
    "generate_subscripts(string_split(prompt, ' '), 1) - 1 as pos from f_queries) t"
)
VIEWS["t_tags"] = (("f_queries",), _TAGS)


@query(
    "b14_pos_top",
    sql(
        "select query_id, 'pos_top' || rk as key, tag as value from (select *, row_number() over (partition by query_id "
        "order by n desc, first_pos) as rk from (select query_id, tag, count(*) as n, min(pos) as first_pos from t_tags "
        "group by query_id, tag) a) b where rk <= 3",
        "t_tags",
    ),
)
def pos_top(spark, sf_dir):
    return A.pos_top(D.annotated_tokens(spark, sf_dir))


@query(
    "b15_entity_flags",
    sql(
        "select q.query_id, 'has_ent_' || coalesce(e.label, 'NONE') as key, '1' as value from f_queries q left join ("
        "select distinct query_id, case tag when 'PROPN' then 'NAME' else 'QUANTITY' end as label from t_tags "
        "where tag in ('PROPN', 'NUM')) e using (query_id)",
        "f_queries",
        "t_tags",
    ),
)
def entity_flags(spark, sf_dir):
    return A.entity_flags(D.queries(spark, sf_dir), D.annotated_entities(spark, sf_dir))


@query(
    "b16_b17_b19_linguistic_features",
    sql("select query_id, sent_bucket, spacy_token_bucket, title_density_bucket from t_surface", "t_surface"),
)
def linguistic_features(spark, sf_dir):
    return TF.linguistic_columns(D.queries(spark, sf_dir))


_SHAPED = "prompt"
for _pattern, _replacement in (
    (r"\p{Lu}", "X"), (r"\p{Ll}", "x"), (r"\p{Nd}", "d"), ("X{5,}", "XXXX"), ("x{5,}", "xxxx"), ("d{5,}", "dddd"),
    ("_{5,}", "____"),
):
    _SHAPED = f"regexp_replace({_SHAPED}, '{_pattern}', '{_replacement}', 'g')"


VIEWS["t_shapes"] = (
    ("f_queries",),
    "select query_id, 'shape_top' || rk as key, shape as value from (select *, row_number() over ("
    "partition by query_id order by n desc, first_pos) as rk from (select query_id, shape, count(*) as n, "
    "min(pos) as first_pos from (select query_id, unnest(w) as shape, generate_subscripts(w, 1) as pos from ("
    f"select query_id, regexp_extract_all({_SHAPED}, '{_WORDS}') as w from f_queries) s) t "
    "group by query_id, shape) a) b where rk <= 2",
)


@query("b18_shape_top", sql("select * from t_shapes", "t_shapes"))
def shape_top(spark, sf_dir):
    return A.shape_top(TF.shape_tokens(D.queries(spark, sf_dir)))


@query(
    "b20_feature_map",
    sql(
        "select * from t_features union all select query_id, key, '1' as value from t_hash union all select * from t_shapes",
        "t_features",
        "t_hash",
        "t_shapes",
    ),
)
def feature_map(spark, sf_dir):
    return E.feature_pairs(TF.extract(D.queries(spark, sf_dir)))


VIEWS["t_annotations"] = (
    ("f_queries", "t_tags"),
    "select query_id, 'pos_top' || rk as key, tag as value from (select *, row_number() over (partition by query_id "
    "order by n desc, first_pos) as rk from (select query_id, tag, count(*) as n, min(pos) as first_pos from t_tags "
    "group by query_id, tag) a) b where rk <= 3 union all "
    "select q.query_id, 'has_ent_' || coalesce(e.label, 'NONE'), '1' from f_queries q left join ("
    "select distinct query_id, case tag when 'PROPN' then 'NAME' else 'QUANTITY' end as label from t_tags "
    "where tag in ('PROPN', 'NUM')) e using (query_id)",
)


@query(
    "b20_annotated_feature_map",
    sql(
        "select * from t_features union all select * from t_shapes union all select * from t_annotations",
        "t_features",
        "t_shapes",
        "t_annotations",
    ),
)
def annotated_feature_map(spark, sf_dir):
    """Tags and entities in the same map as the features of the text."""
    queries = D.queries(spark, sf_dir)
    maps = A.annotation_map(queries, D.annotated_tokens(spark, sf_dir), D.annotated_entities(spark, sf_dir))
    return E.feature_pairs(TF.with_annotations(TF.extract(queries, hash_flags=False), maps))


def _tagged(spark, sf_dir, entities=False):
    """Tags of the held-out texts (id divisible by 5) by what the others teach: (query_id, pos, tag)."""
    words = D.queries(spark, sf_dir).where("query_id % 5 = 0").select("query_id", F.split("prompt", " ").alias("words"))
    tagger = G.fit(D.annotated_words(spark, sf_dir, entities).where("query_id % 5 <> 0"))
    return G.token_rows(tagger.tag(words))


VIEWS["t_context_tags"] = (
    ("t_tags",),
    "select query_id, pos, case when tag = 'NOUN' and lag(tag) over (partition by query_id order by pos) = 'PART' "
    "then 'OBJ' else tag end as tag from t_tags",
)


@query(
    "b14_tagger_held_out",
    sql("select tag, count(*) as n, true as accurate from t_context_tags where query_id % 5 = 0 group by tag", "t_context_tags"),
)
def tagger_held_out(spark, sf_dir):
    """Words of each true tag in held-out texts; ``accurate``: nine in ten are tagged so."""
    true = D.annotated_words(spark, sf_dir).where("query_id % 5 = 0").select("query_id", "pos", F.col("tag").alias("true_tag"))
    both = true.join(_tagged(spark, sf_dir), ["query_id", "pos"], "full")
    right = F.avg(F.when(F.col("tag") == F.col("true_tag"), 1.0).otherwise(0.0))
    return both.groupBy(F.col("true_tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"), (right >= 0.9).alias("accurate"))


@query(
    "b15_tagger_held_out",
    sql(
        "select label, count(*) as n, true as accurate from (select query_id, tag, "
        "case tag when 'PROPN' then 'NAME' else 'QUANTITY' end as label, lag(tag) over (partition by query_id order by pos) "
        "as before from t_tags) a where query_id % 5 = 0 and tag in ('PROPN', 'NUM') and tag is distinct from before group by label",
        "t_tags",
    ),
)
def entity_held_out(spark, sf_dir):
    """Entities of held-out texts by label; ``accurate``: the number found is within a twentieth of that."""
    true = G.entity_rows(D.annotated_words(spark, sf_dir, True).where("query_id % 5 = 0").drop("word"))
    found = G.entity_rows(_tagged(spark, sf_dir, True))
    n = true.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    joined = n.join(found.groupBy("label").agg(F.count(F.lit(1)).alias("found")), "label", "left")
    close = F.abs(F.coalesce("found", F.lit(0)) - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") / 20)
    return joined.select("label", "n", close.alias("accurate"))


@query(
    "b21_merged_features",
    sql(
        "select * from t_features union all select query_id, 'eval', eval_name from f_queries "
        "union all select query_id, 'lang', case when lang = 'en' then lang else '' end from f_queries",
        "t_features",
    ),
)
def merged_features(spark, sf_dir):
    """A given key that is derived as well takes the derived value; a null
    value becomes an empty string."""
    derived = TF.extract(D.queries(spark, sf_dir), hash_flags=False, shapes=False, name="derived")
    given = F.create_map(
        F.lit("eval"), F.col("eval_name"),
        F.lit("lang"), F.when(F.col("lang") == "en", F.col("lang")),
        F.lit("len_bucket"), F.lit("given"),
    )
    return E.feature_pairs(derived.withColumn("features", TF.merge(given, F.col("derived"))))


def label_centres(spark, sf_dir) -> list[list[float]]:
    """Mean embedding per label: as many short vectors as there are labels."""
    vectors = D.table(spark, sf_dir, "embeddings").select(
        "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    means = vectors.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m")).orderBy("label").collect()
    return [[float(x) for x in r["m"]] for r in means]


VIEWS["e_long"] = (
    (),
    "select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings",
)
VIEWS["e_nearest"] = (
    ("e_long",),
    "select vec_id, arg_min(centre, (d, centre)) as centre from (select e.vec_id, c.label as centre, "
    "round(sum((e.x - c.x) * (e.x - c.x)), 12) as d from e_long e join (select label, dim, avg(x) as x from e_long "
    "group by label, dim) c using (dim) group by e.vec_id, c.label) t group by vec_id",
)


@query(
    "b22_embed_cluster_feature",
    sql(
        "select vec_id as query_id, 'embed_cluster_10' as key, centre::varchar as value from e_nearest "
        "union all select vec_id, 'label', label::varchar from embeddings",
        "e_nearest",
    ),
)
def embed_cluster_feature(spark, sf_dir):
    vectors = D.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("features"),
        nearest_centre(F.col("embedding"), label_centres(spark, sf_dir)).alias("cluster"),
    )
    return E.feature_pairs(vectors.withColumn("features", TF.attach_cluster(F.col("features"), 10, F.col("cluster"))))
