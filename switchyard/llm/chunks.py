"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends behind a white-space
character where the hash of the 16 bytes up to it divides by ``MEAN``, so it is about
``MEAN`` words long.  Cuts depend on these bytes alone: an insertion moves the chunks
behind it but does not change them.  Scripts without spaces are cut in front of
characters of three or more bytes; a run of ``RUN`` bytes or more without white space (base64,
minified code) is cut between any two characters, on average every ``RUN_MEAN`` of them.

A chunk's digest is 64 bits.  The occurrence in the smallest doc_id, and there the
first, stays; neighbouring repeated chunks form a span, and spans of at least
``LEAST`` characters are cut out.  Shorter ones are left: common phrases are no copies.

Digests are counted with partial sums and joined with the occurrences; chunks are
recomputed for the join rather than stored.  A digest that holds more than one in ``HOT``
of the repeated occurrences - there are fewer than ``HOT`` such, which is what the broadcast of them
may hold - is dealt into ``SALTS`` parts, its counted row copied to each.  Spans are
gathered per document, so a group is never larger than a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.session import materialise

MEAN = 6
WIDE_MEAN = 24
RUN = 64
RUN_MEAN = 32
HOT = 2048
SALTS = 128
LEAST = 64
_GROUP_BYTES = 1 << 21
# A table of random numbers by rule; byte 0, which parts documents, adds nothing.
_GEAR = np.array([0, *(xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(1, 256))], np.uint32)
_APART = bytes(16)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts: number of the text, begin and end in characters, digest."""
    buffer = b"".join(part for t in texts for part in (_APART, t))
    b = np.frombuffer(buffer, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + len(_APART)) - lengths
    h = _GEAR[b]
    for reach in (1, 2, 4, 8):
        moved = h.copy()
        moved[reach:] += h[:-reach] << np.uint32(reach)
        h = moved
    h >>= np.uint32(16)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    wide = np.zeros(len(b), bool)
    wide[:-1] = (b[1:] >= 0xE0) & (h[:-1] % np.uint32(WIDE_MEAN) == 0)
    # Bytes since the last white space or the text's begin; the next byte must begin a character.
    place = np.arange(len(b))
    since = place - np.maximum.accumulate(np.where(space | (b == 0), place, 0)) if len(b) else place
    inside = (since >= RUN) & (h % np.uint32(RUN_MEAN) == 0)
    inside[:-1] &= (b[1:] & 0xC0) != 0x80
    ends = np.flatnonzero((space & (h % np.uint32(MEAN) == 0)) | wide | inside) + 1
    owner = np.searchsorted(begins, ends - 1, "right") - 1
    ends = ends[(owner >= 0) & (ends <= (begins + lengths)[owner]) & (ends > begins[owner])] if len(ends) else ends
    ends = np.unique(np.concatenate([ends, (begins + lengths)[lengths > 0]]))
    owner = np.searchsorted(begins, ends - 1, "right") - 1
    starts = np.maximum(np.concatenate([[0], ends[:-1]])[: len(ends)], begins[owner])
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(buffer[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    base = chars[begins[owner]]
    return owner, chars[starts] - base, chars[ends] - base, digests.view(np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, begin, end, again) per chunk; ``again``: seen earlier in the same text.

    Rows without an id or text have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            first, size = 0, 0
            for i in range(len(ids)):
                size += len(texts[i].as_buffer())
                if size >= _GROUP_BYTES or i == len(ids) - 1:
                    own = [t.as_buffer().to_pybytes() for t in texts[first : i + 1]]
                    owner, begin, end, digest = cut(own)
                    again = np.ones(len(owner), bool)
                    again[np.unique(np.stack([owner, digest]), axis=1, return_index=True)[1]] = False
                    columns = [ids[first : i + 1][owner], digest, begin.astype(np.int32), end.astype(np.int32), again]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "digest", "begin", "end", "again"])
                    first, size = i + 1, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, digest long, begin int, end int, again boolean")


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document with something to cut: doc_id, ``spans`` of (begin, end, sources) in
    characters, in order; ``sources`` are the ids of the documents that keep the text."""
    found = chunks(docs)
    kept = found.groupBy("digest").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).where("n > 1")
    kept = materialise(kept, "repeated-digests")
    total = kept.agg(F.sum("n")).first()[0] or 0
    kept = kept.withColumn("hot", F.col("n") * HOT > total)
    hot = F.broadcast(kept.where("hot").select("digest", "hot"))  # fewer than HOT rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "begin"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = found.join(hot, "digest", "left").withColumn("salt", salt).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counted = kept.select("digest", "source", F.explode(salts).alias("salt"))
    copies = dealt.join(counted, ["digest", "salt"]).where("doc_id != source or again").select("doc_id", "begin", "end", "source")
    line = Window.partitionBy("doc_id").orderBy("begin", "end")
    # Repeated rows of a document repeat its chunks.
    copies = copies.distinct()
    parted = F.coalesce(F.lag("end").over(line) < F.col("begin"), F.lit(True)).cast("int")
    runs = copies.withColumn("parted", parted).withColumn("run", F.sum("parted").over(line))
    spans = runs.groupBy("doc_id", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sort_array(F.collect_set("source")).alias("sources")
    )
    spans = spans.where(F.col("end") - F.col("begin") >= least)
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "sources"))).alias("spans"))


def without_spans(text: str, spans: str):
    """Column: ``text`` without the characters of ``spans``; null spans leave it as it is."""
    cuts, whole = F.col(spans), F.col(text)
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["end"]))
    stops = F.concat(F.transform(cuts, lambda s: s["begin"]), F.array(F.length(whole)))
    parts = F.zip_with(starts, stops, lambda a, b: F.substring(whole, a + 1, F.greatest(b - a, F.lit(0))))
    return F.when(cuts.isNull(), whole).otherwise(F.concat_ws("", parts))


def deduplicate(docs: DataFrame, least: int = LEAST, name: str = "spans") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and column ``name``: the spans, null if
    nothing was cut.  A column of that name is replaced.

    A null text stays null, a row without an id stays as it is.  An id should name one
    text; repeated rows are cut alike.  A text may end up empty: the row stays."""
    key = "_spans_doc_id"
    spans = repeated_spans(docs, least).select(F.col("doc_id").alias(key), F.col("spans").alias(name))
    rows = docs.drop(name).join(spans, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    return rows.withColumn("text", without_spans("text", name))
