"""Toxicity by compression distance: two zstandard dictionaries, windows of words.

Every window of ``WINDOW`` words is compressed twice, with a dictionary trained on toxic
text and with one trained on ordinary text.  The bytes that the toxic dictionary saves
speak for toxic text, and those that the ordinary one saves against it.

Training.  A dictionary holds the pieces of words (4 to 10 characters) that are far more
frequent in its class, in the order of the bytes they save; a word that holds an earlier
piece is explained by it.  What both classes share would cost the same with either
dictionary, so neither holds it.  Both end with the frame that surrounds every window:
matching it pays for the headers of a compressed block, so that each further match shows
in the length, and a match can begin up to the window's last word.

A document's score is a logistic function of the largest, second largest and mean saving,
and of how many windows save bytes.  It is calibrated on labelled documents other than
those of the dictionaries, and 0.5 is the threshold.

Fitting uses at most ``FIT_ROWS`` labelled texts of a class (smallest hashes first) and of
these at most ``FIT_CHARS`` characters: whole texts until the sum is reached.  Scoring
reads all documents whole; of the fit it needs the dictionaries only, a few thousand bytes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

#: Labelled rows used of each class (ordinary, toxic), and characters of each.
FIT_ROWS = (6000, 2500)
FIT_CHARS = 16_000_000
WINDOW = 5
DICTIONARY_BYTES = 4096
FEATURES = ["most", "second", "mean", "share_one", "share_two", "log_one", "log_two", "log_windows"]
_FRAME = bytes(range(1, 9)) * 2


def windows(text: str) -> list[bytes]:
    """The whole text in framed windows of lower-case words, two spaces between words."""
    words = text.lower().split()
    parts = (" " + "  ".join(words[i : i + WINDOW]) + " " for i in range(0, len(words), WINDOW))
    return [_FRAME + p.encode("utf-8", "replace") + _FRAME for p in parts]


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes


def _pieces(word: str) -> set[str]:
    word = f" {word} "
    return {word[i : i + n] for n in range(4, 11) for i in range(len(word) - n + 1)}


def marked_pieces(own: list[str], others: list[str], ratio: float = 40, least: int = 8) -> list[str]:
    """Pieces of words that mark the texts ``own``, the one that explains most first; a word that
    holds an earlier piece is explained and counts no more."""
    seen = [Counter(w for t in texts for w in set(t.lower().split())) for texts in (own, others)]
    scale = max(len(own), 1) / max(len(others), 1)
    rare = {w: n for w, n in seen[0].items() if n >= 2 and n > ratio / 2 * (seen[1][w] + 0.5) * scale}
    count: Counter[str] = Counter()
    for word, n in rare.items():
        count.update(dict.fromkeys(_pieces(word), n))
    other: Counter[str] = Counter()
    for word, n in seen[1].items():
        other.update({p: n for p in _pieces(word) if p in count})
    good = {p for p, n in count.items() if n >= least and n > ratio * (other[p] + 0.5) * scale}
    holders: dict[str, list[str]] = {}
    for word in rare:
        for piece in _pieces(word) & good:
            holders.setdefault(piece, []).append(word)
    left, chosen = {p: count[p] for p in good}, []
    # A class mark is seen in many texts; what is left below this is chance.
    floor = max(least, len(own) // 40)
    while left:
        best = max(left, key=lambda p: (left[p] * (len(p) - 2), p))
        if left[best] < floor:
            del left[best]
            continue
        chosen.append(best)
        for word in holders[best]:
            n = rare.pop(word, 0)
            for piece in _pieces(word) & left.keys() if n else ():
                left[piece] -= n
        del left[best]
    return chosen


def _content(pieces: list[str]) -> bytes:
    """Dictionary content, the best piece last: near matches cost least."""
    content = b""
    for piece in pieces:
        if len(content) + len(piece.encode()) < DICTIONARY_BYTES:
            content = piece.encode("utf-8", "replace") + b"\0" + content
    return content + _FRAME


def train(toxic: list[str], ordinary: list[str]) -> Dictionaries:
    return Dictionaries(_content(marked_pieces(toxic, ordinary)), _content(marked_pieces(ordinary, toxic)))


@cache
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters(
        window_log=17,
        chain_log=16,
        hash_log=16,
        search_log=6,
        min_match=5,
        target_length=64,
        strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(compression_params=options, dict_data=data)


def features(text: str | None, dictionaries: Dictionaries) -> list[float]:
    """``FEATURES`` of a text; all 0 without words."""
    toxic, ordinary = _compressor(dictionaries.toxic).compress, _compressor(dictionaries.ordinary).compress
    saved = sorted((max(0, len(ordinary(w)) - len(toxic(w))) for w in windows(text or "")), reverse=True)
    if not saved:
        return [0.0] * len(FEATURES)
    n, one, two = len(saved), sum(s >= 1 for s in saved), sum(s >= 2 for s in saved)
    second = saved[1] if n > 1 else 0
    return [saved[0], second, sum(saved) / n, one / n, two / n, math.log1p(one), math.log1p(two), math.log1p(n)]


def measure(docs: DataFrame, dictionaries: Dictionaries, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and one column per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), dictionaries) for t in batch.column(len(keep))]
            columns = [pa.array(c, pa.float64()) for c in np.array(rows, np.float64).reshape(-1, len(FEATURES)).T]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *FEATURES])

    schema = StructType([docs.schema[c] for c in keep] + [StructField(f, DoubleType()) for f in FEATURES])
    return docs.select(*keep, "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries
    weights: tuple[float, ...]  # of the features, and the constant

    def probability(self) -> Column:
        """The score of a measured row."""
        terms = [w * F.col(f) for w, f in zip(self.weights, FEATURES, strict=False)]
        return 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + self.weights[-1])))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge; a class without rows gives
    a constant that says so."""
    if not y.any() or y.all():
        return (*[0.0] * len(FEATURES), 10.0 if len(y) and y.all() else -10.0)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.diag([0.05] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    return (*slopes.tolist(), float(w[-1] - slopes @ mean))


def _sample(texts: DataFrame, marks: DataFrame, toxic: int) -> DataFrame:
    """The texts of the labelled ids with the smallest hashes.

    Ids are chosen before texts are read: the broadcast side has at most FIT_ROWS rows."""
    most = FIT_ROWS[toxic]
    present = texts.select(F.col("doc_id").alias("label_id"))
    ids = marks.where(F.col("toxic") == toxic).join(present, "label_id", "left_semi")
    ids = ids.withColumn("order", F.xxhash64("label_id")).orderBy("order", "label_id").limit(most)
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("text", "toxic", "order")
    few = found.orderBy("order", F.xxhash64("text")).limit(most)  # an id may have several rows
    # At most FIT_ROWS rows here: one partition is enough for a running sum.
    line = Window.orderBy("order", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text")
    return few.withColumn("upto", F.sum(size).over(line)).where(F.col("upto") - size < FIT_CHARS).drop("upto")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all of ``labels`` (doc_id, toxic) that it is given, within the bounds above.

    Three quarters of the sample, by hash, train the dictionaries, the rest the score."""
    marks = labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")
    )
    texts, marks = docs.where("text is not null").select("doc_id", "text"), marks.distinct()
    rows = [r for k in (1, 0) for r in _sample(texts, marks, k).collect()]
    learn = [r for r in rows if r["order"] % 4]
    rest = [r for r in rows if r["order"] % 4 == 0]
    dictionaries = train(*([r["text"] for r in learn if r["toxic"] == k] for k in (1, 0)))
    if not rest:
        return Model(dictionaries, _calibrate(np.zeros((0, len(FEATURES))), np.zeros(0)))
    spark = docs.sparkSession
    held = spark.createDataFrame([(r["text"], r["toxic"]) for r in rest], "text string, toxic int")
    found = measure(held.repartition(spark.sparkContext.defaultParallelism), dictionaries, ["toxic"]).toPandas()
    x, y = found[FEATURES].to_numpy(np.float64), found["toxic"].to_numpy(np.float64)
    order = np.lexsort([*x.T, y])  # sums do not depend on the order of arrival
    return Model(dictionaries, _calibrate(x[order], y[order]))


def outside(labels: Iterable | DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the id as text does not divide by 5."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 from 0.5) for every row; a null text is scored as an empty one."""
    measured = measure(docs, model.dictionaries, keep).withColumn("score", model.probability())
    return measured.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
