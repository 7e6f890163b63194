"""Registered queries of this package: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import bpe, chunks, divergence, kdshard, negatives, packing, parsing, records, repair, simhash, toxicity, urlmodel, warc
from switchyard.llm.common import table
from switchyard.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


@query("op1_simhash_neardup")
def simhash_neardup(spark, sf_dir):
    """Four-word shingles and four bits, as the query's contract has it."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


_ORIGINALS = (
    "select sha256(coalesce(html, '')) as digest, min(page_id) as original from pages "
    "where strlen(coalesce(html, '')) >= 100 group by 1 having count(*) > 1"
)


@query(
    "op5_warc_revisit",
    "select p.page_id, strlen(coalesce(p.html, ''))::bigint as payload_bytes, sha256(coalesce(p.html, '')) as payload_digest, "
    "case when o.original is null or p.page_id = o.original then 'response' else 'revisit' end as record_type, "
    "case when p.page_id <> o.original then o.original end as refers_to "
    f"from pages p left join ({_ORIGINALS}) o on o.digest = sha256(coalesce(p.html, ''))",
)
def warc_revisit(spark, sf_dir):
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.read_archives(spark, path).select(*columns)


@query("op9_distribution_divergence")
def distribution_divergence(spark, sf_dir):
    return divergence.assess(table(spark, sf_dir, "documents"))


@query("op2_kd_shards")
def kd_shards(spark, sf_dir):
    return kdshard.assign(table(spark, sf_dir, "documents"), shards=40)


@query("op7_url_model")
def url_model(spark, sf_dir):
    return urlmodel.judge(table(spark, sf_dir, "pages"))


@query("op6_byte_bpe")
def byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_tiered_packing")
def tiered_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op10_chunk_dedup")
def chunk_dedup(spark, sf_dir):
    """Per document the cut text, what was cut, and which documents keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("chars_before"))
    cut = chunks.deduplicate(docs)
    return cut.select(
        "doc_id",
        "text",
        (F.col("chars_before") - F.length("text")).alias("removed_chars"),
        F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["sources"])))).alias("source_doc_ids"),
    )


@query("op4_compression_toxicity")
def compression_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.outside(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query("op3_consistent_parsing")
def consistent_parsing(spark, sf_dir):
    return parsing.compare_with_next(table(spark, sf_dir, "documents"))


@query("op11_binary_records")
def binary_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return records.read_records(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op12_conversation_repair")
def conversation_repair(spark, sf_dir):
    return repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_hard_negatives")
def hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
