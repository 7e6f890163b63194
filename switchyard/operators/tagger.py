"""A sequence tagger learned by grouped counts and decoded by dynamic programming.

Fitting counts an annotated table (id, pos, word, tag) three ways: tag after tag, tag by
word, tag by word class (kind of first letter, length, closing mark).  The first and the last
table are small by construction - ``MAX_TAGS`` tags, ``MAX_CLASSES`` classes - and the second, a
row per word, stays a table.  A word's score for a tag is log P(tag | word) - log P(tag), where
P(tag | word) leans on the class of the word with the weight of ``PRIOR`` occurrences; a word
never seen has the score of its class.

Tagging splits each text inside its row into different words with their positions, so a
text moves as short rows and its frequent words as one each.  Scores of the ``FREQUENT`` most
frequent words come by a broadcast of that many rows at most; the others are joined by
word.  Each text then chooses its likeliest tag sequence (Viterbi); a batch of texts advances
together, one position at a time.

Ids are unique.  A null or empty list of words has an empty list of tags; a null word
counts as an empty one; rows without a tag are not counted, and the word after them begins a
sequence.  Equal scores go to the tag that sorts first.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchyard.session import materialise

FREQUENT = 4096
MAX_TAGS = 128
PRIOR = 2.0
_KINDS = 4
_LENGTHS = 6
MAX_CLASSES = _KINDS * (_LENGTHS + 1) * 2


def word_class(word: Column) -> Column:
    """Kind of a word: digits / capital / small / other, its length up to 6, a mark at its end."""
    kind = (
        F.when(word.rlike(r"^\p{Nd}+$"), "d").when(word.rlike(r"^\p{Lu}"), "X").when(word.rlike(r"^\p{Ll}"), "x").otherwise("o")
    )
    mark = F.when(word.rlike(r"[^\p{L}\p{M}\p{Nd}]$"), ".").otherwise("")
    return F.concat(kind, F.least(F.char_length(word), F.lit(_LENGTHS)).cast("string"), mark)


@dataclass
class Tagger:
    """Tags in sorted order, log probabilities between them, scores of classes and of words."""

    tags: list[str]
    start: list[float]
    steps: list[list[float]]
    base: list[float]  # scores of a class never seen
    classes: DataFrame  # class, scores; at most MAX_CLASSES rows
    words: DataFrame  # word, scores, rank; rank is null beyond the FREQUENT first

    def tag(self, df: DataFrame, words: str = "words", id_col: str = "query_id") -> DataFrame:
        """(id, tags), a tag per word of the list."""
        found = df.select(id_col, F.coalesce(words, F.array().cast("array<string>")).alias("words"))
        id_type = found.schema[id_col].dataType.simpleString()
        spread = found.mapInArrow(_spread, f"`{id_col}` {id_type}, word string, positions array<int>")
        frequent = self.words.where("rank is not null").select("word", F.col("scores").alias("_often"))
        near = spread.join(F.broadcast(frequent), "word", "left")
        known = near.where("_often is not null").select(id_col, "positions", F.col("_often").alias("scores"))
        rare = self.words.where("rank is null").select("word", "scores")
        others = near.where("_often is null").drop("_often").join(rare, "word", "left")
        # The class table has MAX_CLASSES rows at most.
        by_class = F.broadcast(self.classes.select(F.col("class").alias("_class"), F.col("scores").alias("_guess")))
        guessed = others.withColumn("_class", word_class(F.col("word"))).join(by_class, "_class", "left")
        base = F.array(*[F.lit(x) for x in self.base])
        scored = known.unionByName(guessed.select(id_col, "positions", F.coalesce("scores", "_guess", base).alias("scores")))
        gathered = scored.groupBy(id_col).agg(F.collect_list(F.struct("positions", "scores")).alias("scored"))
        decode = _decoder(np.array(self.start), np.array(self.steps))
        tagged = gathered.mapInArrow(decode, f"`{id_col}` {id_type}, _tags array<int>")
        names = F.array(*[F.lit(t) for t in self.tags])
        return tagged.select(id_col, F.transform("_tags", lambda i: F.get(names, i)).alias("tags"))

    def save(self, path: str) -> None:
        spark = self.words.sparkSession
        self.words.write.parquet(f"{path}/words")
        self.classes.write.parquet(f"{path}/classes")
        small = json.dumps({"tags": self.tags, "start": self.start, "steps": self.steps, "base": self.base})
        spark.createDataFrame([(small,)], "model string").coalesce(1).write.parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Tagger":
        small = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        return Tagger(**small, classes=spark.read.parquet(f"{path}/classes"), words=spark.read.parquet(f"{path}/words"))


def fit(annotated: DataFrame, id_col: str = "query_id") -> Tagger:
    """Learn from (id, pos, word, tag)."""
    rows = annotated.select(id_col, "pos", F.coalesce("word", F.lit("")).alias("word"), "tag")
    # Tags are few, so (word, tag) counts are combined before they move.
    counts = materialise(
        rows.where("tag is not null").groupBy("word", "tag").agg(F.count(F.lit(1)).cast("double").alias("n")), "tag-counts"
    )
    totals = {r["tag"]: r["n"] for r in counts.groupBy("tag").agg(F.sum("n").alias("n")).limit(MAX_TAGS + 1).collect()}
    if not totals:
        raise ValueError("no tagged row to learn from")
    if len(totals) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    tags = sorted(totals)
    everything = sum(totals.values())
    log_share = [math.log(totals[t] / everything) for t in tags]

    before = F.lag("tag").over(Window.partitionBy(id_col).orderBy("pos"))
    pairs = rows.select(before.alias("before"), "tag").where("tag is not null").groupBy("before", "tag").count().collect()
    position = {t: i for i, t in enumerate(tags)}
    table = np.full((len(tags) + 1, len(tags)), 0.5)
    for r in pairs:
        table[position[r["before"]] if r["before"] is not None else -1, position[r["tag"]]] += r["count"]
    table = np.log(table / table.sum(axis=1, keepdims=True))

    def vector(n: Column) -> Column:
        return F.array(*[F.coalesce(F.try_element_at(n, F.lit(t)), F.lit(0.0)) for t in tags])

    by_tag = F.map_from_entries(F.collect_list(F.struct("tag", "n")))
    share = [F.lit(math.exp(x)) for x in log_share]
    own = counts.select(word_class(F.col("word")).alias("class"), "tag", "n")
    classes = own.groupBy("class", "tag").agg(F.sum("n").alias("n")).groupBy("class").agg(by_tag.alias("by_tag"), F.sum("n").alias("total"))
    smoothed = classes.select("class", vector(F.col("by_tag")).alias("v"), "total").select(
        "class", F.array(*[(F.col("v")[i] + PRIOR * share[i]) / (F.col("total") + PRIOR) for i in range(len(tags))]).alias("shares")
    )
    smoothed = materialise(smoothed, "tag-classes")

    words = counts.groupBy("word").agg(by_tag.alias("by_tag"), F.sum("n").alias("total"))
    words = words.select("word", vector(F.col("by_tag")).alias("v"), "total", word_class(F.col("word")).alias("class"))
    words = words.join(F.broadcast(smoothed), "class").select(
        "word",
        "total",
        F.array(
            *[F.log((F.col("v")[i] + PRIOR * F.col("shares")[i]) / (F.col("total") + PRIOR)) - log_share[i] for i in range(len(tags))]
        ).alias("scores"),
    )
    words = materialise(words, "tag-words")
    first = words.orderBy(F.desc("total"), "word").limit(FREQUENT).select("word", F.lit(1).alias("rank"))
    ranked = materialise(words.drop("total").join(F.broadcast(first), "word", "left"), "tag-words-ranked")
    scores = F.array(*[F.log(F.col("shares")[i]) - log_share[i] for i in range(len(tags))])
    return Tagger(
        tags=tags,
        start=[float(x) for x in table[-1]],
        steps=[[float(x) for x in line] for line in table[:-1]],
        base=[0.0] * len(tags),
        classes=materialise(smoothed.select("class", scores.alias("scores")), "tag-class-scores"),
        words=ranked,
    )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) -> a row per different word of the list; a row without positions where it is empty."""
    for batch in batches:
        keys = batch.column(0)
        for i, words in enumerate(batch.column(1)):
            positions: dict[str, list[int]] = {}
            for p, word in enumerate(words.as_py()):
                positions.setdefault(word or "", []).append(p)
            positions = positions or {"": []}
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array([i] * len(positions), pa.int32())),
                    pa.array(list(positions), pa.string()),
                    pa.array(list(positions.values()), pa.list_(pa.int32())),
                ],
                names=[batch.schema.names[0], "word", "positions"],
            )


def likeliest(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Viterbi over sequences laid end to end in ``scores``; all advance together."""
    order = np.argsort(-lengths, kind="stable")
    offsets = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest + 1), side="left")  # sequences longer than s
    back = np.zeros(scores.shape, np.int16)
    out = np.zeros(len(scores), np.int32)
    best = start + scores[offsets[: alive[0]]] if longest else np.zeros((0, len(start)))
    last = np.zeros(len(lengths), np.int64)
    for s in range(1, longest + 1):
        n = alive[s]
        last[n : len(best)] = best[n:].argmax(axis=1)
        if n:
            ways = best[:n, :, None] + steps
            back[offsets[:n] + s] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[offsets[:n] + s]
    for s in range(longest - 1, -1, -1):
        n = alive[s]
        out[offsets[:n] + s] = last[:n]
        last[:n] = back[offsets[:n] + s, last[:n]]
    return out


def _decoder(start: np.ndarray, steps: np.ndarray):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = batch.column(1)
            entries = scored.flatten()
            lists, vectors = entries.field("positions"), entries.field("scores")
            per_word = np.asarray(lists.value_lengths()).astype(np.int64)
            words_of = np.asarray(scored.value_lengths()).astype(np.int64)
            text_of_word = np.repeat(np.arange(len(batch)), words_of)
            lengths = np.bincount(text_of_word, weights=per_word, minlength=len(batch)).astype(np.int64)
            offsets = np.cumsum(lengths) - lengths
            places = np.repeat(offsets[text_of_word], per_word) + np.asarray(lists.flatten())
            values = np.asarray(vectors.flatten()).reshape(len(entries), len(start))
            scores = np.empty((int(lengths.sum()), len(start)))
            scores[places] = np.repeat(values, per_word, axis=0)
            tags = likeliest(scores, lengths, start, steps)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(tags, pa.int32()))],
                names=[batch.schema.names[0], "_tags"],
            )

    return decode


def token_rows(tagged: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, tags) -> (id, pos, tag), the annotated layout."""
    return tagged.select(id_col, F.posexplode("tags").alias("pos", "tag"))


def entity_rows(tokens: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, label), a row per entity, from tags B-<label> / I-<label>: a run begins at B, or at an I
    that continues nothing of its label."""
    tag = F.col("tag")
    before = F.lag("tag").over(Window.partitionBy(id_col).orderBy("pos"))
    label = F.substring(tag, 3, 1 << 20)
    marked = tokens.select(id_col, "tag", F.coalesce(before, F.lit("")).alias("before"))
    begins = tag.startswith("B-") | (tag.startswith("I-") & (F.substring("before", 3, 1 << 20) != label))
    return marked.where(begins).select(id_col, label.alias("label"))
