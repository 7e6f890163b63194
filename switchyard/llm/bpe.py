"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Encoding.  Texts are taken in blocks (an Arrow batch).  A block is cut into
pre-tokens; it keeps its distinct ones, dealt into buckets by checksum, and per
document the positions as numbers of distinct pre-tokens.  The buckets are shuffled:
a task meets all blocks' pre-tokens of a bucket and encodes each different one once.
The ids go back to their blocks, where a document is put together by position.  Both
shuffles carry a pre-token once per block, however often it occurs, so a word that is
everywhere weighs as much as a rare one.

The blocks are stored bucketed by block number, so that the join with the returned
ids moves the ids only.  Ids are little-endian unsigned 32-bit numbers in one binary
value.  Decoding looks each id up in the vocabulary's table of bytes, whose size is
fixed by the vocabulary.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.session import scratch_path

_BLOCK = "block string, bucket int, doc_ids array<long>, counts array<long>, data binary"
_IDS = "block string, bucket int, data binary"


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes end to end, and each id's place and length."""
    table = ranks(path)
    size = max(table.values()) + 1
    tokens = [b""] * size
    for token, rank in table.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The pieces ``chosen`` of ``flat``, end to end."""
    n = lengths[chosen]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[chosen] - (ends - n), n) + np.arange(total)]


def _pack(values: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit numbers, byte planes apart."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _cut(pattern: str, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema(
        [("block", pa.string()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("data", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(pattern).findall
        for batch in batches:
            # The number only has to be unique: a block's rows are stored together.
            block, number = uuid.uuid4().hex, {}
            places = []
            for text in batch.column(1):
                # The next number is the count so far; known words keep theirs.
                own = [number.setdefault(w, len(number)) for w in found(text.as_py() or "")]
                places.append(np.array(own, np.uint32))
            words = [w.encode("utf-8", "replace") for w in number]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            everything = np.concatenate(places) if places else np.zeros(0, np.uint32)
            rows = [(block, -1, batch.column(0).to_pylist(), [len(p) for p in places], _pack(rank[everything]))]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.unique(bucket).tolist():
                own = [words[i] for i in order[edges[b] : edges[b + 1]].tolist()]
                sizes = np.array([len(w) for w in own], "<u4").tobytes()
                packed = zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(own))
                rows.append((block, b, None, [len(own)], packed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

    return run


def _encode(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        current, known = None, {}
        for batch in batches:
            data = []
            buckets = batch.column(1).to_pylist()
            for bucket, (n,), packed in zip(buckets, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket != current:
                    current, known = bucket, {}
                raw = zstandard.ZstdDecompressor().decompress(packed)
                sizes = np.frombuffer(raw, "<u4", n)
                ends = 4 * n + np.cumsum(sizes, dtype=np.int64)
                ids = []
                for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    word = raw[a:b]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(encode(word.decode()), "<u4")
                    ids.append(got)
                lengths = np.array([len(x) for x in ids], np.uint32)
                data.append(_pack(np.concatenate([np.array([n], np.uint32), lengths, *ids])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["block", "bucket", "data"]
            )

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = [_unpack(x["data"]) for x in row["ids"]]
            lengths = np.concatenate([p[1 : 1 + p[0]] for p in parts] or [np.zeros(0)]).astype(np.int64)
            flat = np.concatenate([p[1 + p[0] :] for p in parts] or [np.zeros(0, np.uint32)]).astype("<u4")
            starts = np.cumsum(lengths) - lengths
            places, at, out = _unpack(row["data"]), 0, []
            for n in row["counts"]:
                out.append(_gather(flat, starts, lengths, places[at : at + n]).tobytes())
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids"]
            )


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id long, ids binary.

    A null or empty text has no ids.  Repeated rows and null ids stay as they are;
    an empty table gives no rows."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    name, folder = f"blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(pattern, buckets), _BLOCK)
    writer = rows.write.bucketBy(partitions, "block").option("path", folder).option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    words = blocks.where("bucket >= 0").select("block", "bucket", "counts", "data")
    ids = (
        words.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode(path, pattern), _IDS)
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "data"))).alias("ids"))
        .withColumnRenamed("block", "ids_block")
    )
    texts = blocks.where("bucket = -1").select("block", "doc_ids", "counts", "data")
    whole = texts.join(ids, F.col("block") == F.col("ids_block"), "left").select(
        "doc_ids", "counts", "data", F.coalesce("ids", F.array().cast(ids.schema["ids"].dataType)).alias("ids")
    )
    return whole.mapInArrow(_assemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path)
        for batch in batches:
            ids = (np.frombuffer(x.as_py(), "<u4") for x in batch.column(1))
            out = pa.array([_gather(*table, x).tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
