"""Router inputs derived from the test tables.

The given tables hold no routing data, so quality, cost, labels and router
probabilities are computed from each document's language, length and id by integer
arithmetic: language and length carry the signal, the id adds noise.  All of it is row-local: one scan of ``documents``, no shuffle, and
queries that need no prompt never read the text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import rows
from switchyard.models import Models
from switchyard.session import configure

# Name, price per 1,000 characters, skill out of 10.
SPEC = (
    ("m-a", 0.001, 5),
    ("m-b", 0.030, 9),
    ("m-c", 0.015, 8),
    ("m-d", 0.002, 6),
    ("m-e", 0.006, 7),
)
MODELS = Models(tuple(n for n, _, _ in SPEC), tuple(p for _, p, _ in SPEC))
M = len(MODELS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(df: DataFrame) -> DataFrame:
    """A test table is one file with one row group, which one task would read: deal its rows out.
    A table of as many files as cores is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(3 * cores)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, prompt, eval_name, lang, n_chars), whole prompts."""
    return in_parts(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("query_id"),
        F.col("text").alias("prompt"),
        F.col("source").alias("eval_name"),
        "lang",
        "n_chars",
    )


def observations(spark: SparkSession, sf_dir: str, prompt: bool = False) -> DataFrame:
    """One row per query: quality, cost and probs per model, and the label.

    The label is the best model by quality, then cost, then index, and is
    missing on every 11th query.
    """
    # What a prompt shows, its language and length, decides which models answer well; one in eight differs.
    need = "(ascii(substr(coalesce(lang, 'xx'), 2, 1)) + if(n_chars > 1024, 4, 0))"
    quality = [
        f"if((({need} + {3 * i}) % 10 < {skill}) <> ((query_id * 31 + {i * 17}) % 8 = 0), 1.0D, 0.0D)"
        for i, (_, _, skill) in enumerate(SPEC)
    ]
    cost = [f"{price}D * (n_chars / 1000.0D)" for _, price, _ in SPEC]
    weight = [f"1 + (query_id * 13 + {i * 29} + n_chars * 7) % 100 + 100 * quality[{i}]" for i in range(M)]
    ranked = ", ".join(f"struct(-quality[{i}] as q, cost[{i}] as c, {i} as idx)" for i in range(M))
    total = "aggregate(weight, 0D, (a, x) -> a + x)"  # spelled out it would be repeated in every use
    columns = ["query_id", "eval_name", "lang", "n_chars"] + (["prompt"] if prompt else [])
    return (
        queries(spark, sf_dir)
        .selectExpr(
            *columns,
            f"array({', '.join(quality)}) as quality",
            f"array({', '.join(cost)}) as cost",
        )
        .selectExpr("*", f"array({', '.join(weight)}) as weight")
        .selectExpr(
            *columns,
            "quality",
            "cost",
            f"transform(weight, w -> w / {total}) as probs",
            f"if(query_id % 11 != 0, array_min(array({ranked})).idx, null) as label",
        )
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark layout: a quality and a cost column per model; the last
    model's cost is missing on every 7th query."""
    df = observations(spark, sf_dir, prompt=True)
    quality, cost = rows.entries("quality", M), rows.entries("cost", M)
    costs = list(cost)
    costs[-1] = F.when(F.col("query_id") % 7 != 0, cost[-1])
    return df.select(
        "query_id",
        "prompt",
        "eval_name",
        *[quality[i].alias(n) for i, n in enumerate(MODELS.names)],
        *[costs[i].alias(f"{n}|total_cost") for i, n in enumerate(MODELS.names)],
        MODELS.name_of(F.col("label")).alias("oracle_model_to_route_to"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, cluster_id) by language; id 3 stays empty."""
    lang = F.col("lang")
    return queries(spark, sf_dir).select(
        "query_id",
        F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(4).alias("cluster_id"),
    )


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their cluster, both from the same row."""
    lang = F.col("lang")
    return observations(spark, sf_dir).withColumn(
        "cluster_id", F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(4)
    )


def route_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A routing log with one row per line item: flag, pred, label, conf, cost."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        (F.col("l_suppkey") % M).cast("int").alias("pred"),
        (F.col("l_partkey") % M).cast("int").alias("label"),
        F.round(F.col("l_discount") * 10, 2).alias("conf"),
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("cost"),
    )


def annotated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, pos, tag): rule tags stand in for a tagger's output."""
    token = F.col("token")
    return (
        queries(spark, sf_dir)
        .select("query_id", F.posexplode(F.split("prompt", " ")).alias("pos", "token"))
        .select(
            "query_id",
            "pos",
            F.when(token.rlike("^[0-9]+$"), "NUM")
            .when(token.rlike(r"^\p{Lu}"), "PROPN")
            .when(F.char_length(token) <= 2, "PART")
            .otherwise("NOUN")
            .alias("tag"),
        )
    )


def annotated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, label): entity labels from the token tags."""
    tag = F.col("tag")
    return (
        annotated_tokens(spark, sf_dir)
        .where(tag.isin("PROPN", "NUM"))
        .select("query_id", F.when(tag == "PROPN", "NAME").otherwise("QUANTITY").alias("label"))
    )


def annotated_words(spark: SparkSession, sf_dir: str, entities: bool = False) -> DataFrame:
    """(query_id, pos, word, tag): words with tags that depend on the word before as well.

    The rule tags, where a NOUN behind a PART is an OBJ; with ``entities`` B-NAME / I-NAME for
    runs of capitalised words, B-QUANTITY / I-QUANTITY for runs of numbers, and O."""

    def rule(token: Column) -> Column:
        return (
            F.when(token.rlike("^[0-9]+$"), "NUM")
            .when(token.rlike(r"^\p{Lu}"), "PROPN")
            .when(F.char_length(token) <= 2, "PART")
            .otherwise("NOUN")
        )

    def kind(token: Column) -> Column:
        return F.when(token.rlike("^[0-9]+$"), "QUANTITY").when(token.rlike(r"^\p{Lu}"), "NAME")

    def tag(token: Column, before: Column) -> Column:
        if entities:
            own = kind(token)
            begins = F.when(own == F.coalesce(kind(before), F.lit("")), "I-").otherwise("B-")
            return F.coalesce(F.concat(begins, own), F.lit("O"))
        own = rule(token)
        return F.when((own == "NOUN") & (rule(F.coalesce(before, F.lit("Start"))) == "PART"), "OBJ").otherwise(own)

    words = queries(spark, sf_dir).select("query_id", F.split("prompt", " ").alias("words"))
    tagged = F.transform("words", lambda w, i: F.struct(w.alias("word"), tag(w, F.get("words", i - 1)).alias("tag")))
    return words.select("query_id", F.posexplode(tagged).alias("pos", "t")).select("query_id", "pos", "t.word", "t.tag")
