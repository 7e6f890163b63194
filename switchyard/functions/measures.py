"""Counts and word shapes of whole texts, for one Arrow batch.

The measures are those of ``functions.text``, by arithmetic on the classes of all characters of
many texts at once: a dozen regular expressions one after another over every text took most
of the time of the feature step.  Which classes a character has is asked of Spark's own
regular expressions, so both ways follow the same Unicode tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import text as T

CLASSES = {
    "blank": rf"(?U)[{T._SPACE}]",
    "space": r"(?U)\s",
    "word": r"(?U)\w",
    "digit": r"\p{Nd}",
    "math": T.MATH_CLASS,
    "punct": T.PUNCT_CLASS,
    "end": r"[.!?]",
    "letter": r"\p{L}",
    "upper": r"[\p{L}&&\p{IsUppercase}]",
    "high": r"[\p{L}&&[^\p{IsLowercase}\p{Lt}]]",
    "capital": r"\p{Lu}",
    "small": r"\p{Ll}",
}
_BITS = {name: 1 << i for i, name in enumerate(CLASSES)}
_POINTS = 0x110000
# A text has fewer characters than that.
_PLACE = np.int32
# Characters measured together, and different shapes named per text.
WINDOW = 1 << 16
COUNTS = ("n_tokens", "n_digits", "n_math", "n_code", "n_punct", "n_upper", "n_urls", "n_sentences", "n_words", "n_titles")
CODE = ("def", "class")

_classes: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def char_classes(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """(starts, masks) of the runs of code points that have the same classes."""
    key = spark.sparkContext.applicationId
    if key not in _classes:
        mask = sum((F.when(F.col("char").rlike(p), _BITS[n]).otherwise(0) for n, p in CLASSES.items()), F.lit(0))
        points = spark.range(_POINTS).where("id not between 55296 and 57343")  # no text has half a pair
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = points.select("id", char.alias("char")).select("id", mask.alias("mask")).toArrow()
        masks = np.zeros(_POINTS, np.uint16)
        masks[found["id"].to_numpy()] = found["mask"].to_numpy()
        starts = np.flatnonzero(np.diff(masks, prepend=masks[:1] ^ 1))
        _classes[key] = starts, masks[starts]
    return _classes[key]


class Measures:
    """What a task needs to measure texts: the classes of every character."""

    def __init__(self, starts: np.ndarray, masks: np.ndarray):
        self.masks = np.repeat(masks, np.diff(starts, append=_POINTS))
        shape = np.arange(_POINTS, dtype=np.uint32)
        for name, sign in (("letter", "x"), ("upper", "X"), ("digit", "d")):
            shape[(self.masks & _BITS[name]) != 0] = ord(sign)
        self.shape = shape

    def of(self, texts: list[str], shapes: int) -> tuple[dict[str, np.ndarray], list[list[str]]]:
        """The counts of each text and its ``shapes`` most common word shapes, ties by first occurrence."""
        joined = "\n".join(["", *texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
        masks = self.masks.take(points)
        is_a = {name: (masks & bit) != 0 for name, bit in _BITS.items()}
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes

        def upto(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, _PLACE)
            np.cumsum(flags, out=sums[1:])
            return sums

        def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where runs begin and end; line ends stand before and behind every text."""
            change = np.flatnonzero(flags[1:] != flags[:-1]) + 1
            return change[::2], change[1::2]

        def placed(at: np.ndarray) -> np.ndarray:
            """How many of the ascending places each text has, its line end included."""
            return np.diff(np.searchsorted(at, ends, "right"), prepend=np.searchsorted(at, 0, "left"))

        def per_text(flags: np.ndarray) -> np.ndarray:
            """Flags of the line ends between texts do not count."""
            at = np.flatnonzero(flags)
            return np.searchsorted(at, ends, "left") - np.searchsorted(at, starts, "left")

        blank, word = is_a["blank"], is_a["word"]
        first, behind = runs(~blank)
        low = upto(~is_a["high"])
        shouted = np.flatnonzero(low[behind] == low[first])
        upper = np.flatnonzero(is_a["upper"])
        shouted = shouted[np.searchsorted(upper, behind[shouted]) > np.searchsorted(upper, first[shouted])]
        n_tokens = placed(first)
        last = behind[np.cumsum(n_tokens) - 1] - 1 if len(behind) else np.zeros(len(texts), np.int64)
        unfinished = (n_tokens > 0) & ~is_a["end"][last]
        closed = is_a["end"] & np.append(blank[1:], True)
        word_first, word_behind = runs(word)
        # Looking back, an expression sees half of a pair, which is no word's.
        alone = np.append(False, ~word[:-1] | (points[:-1] > 0xFFFF))
        title = np.flatnonzero(is_a["capital"] & alone)
        other = np.flatnonzero(~is_a["small"])
        rest = word_behind[np.searchsorted(word_behind, title, "right")]
        title = title[np.searchsorted(other, rest) == np.searchsorted(other, title + 1)]
        mark = ~word & ~is_a["space"]
        counts = {
            "n_tokens": n_tokens,
            **{f"n_{name}s" if name == "digit" else f"n_{name}": per_text(is_a[name]) for name in ("digit", "math", "punct")},
            "n_upper": placed(first[shouted]),
            "n_sentences": per_text(closed) + unfinished,
            "n_words": placed(word_first) + per_text(mark),
            "n_titles": placed(title),
        }
        counts["n_code"] = placed(_code_words(joined, word)) + [t.count("```") for t in texts]
        lowered = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # of bytes: A-Z only
        counts["n_urls"] = np.array([sum(map(t.count, (b"http://", b"https://", b"www."))) for t in lowered], np.int64)
        return counts, self._shapes(points, word, mark, starts, ends, shapes) if shapes else [[] for _ in texts]

    def _shapes(self, points, word, mark, starts, ends, k: int) -> list[list[str]]:
        code = self.shape.take(points)
        again = np.append(False, word[1:] & (code[1:] == code[:-1]))  # a word's character after an equal one
        # Of equal characters in a row the first four.
        fifth = again[3:] & again[2:-1] & again[1:-2] & again[:-3]
        dropped = np.zeros(len(code), bool)
        dropped[3:] = fifth
        # Every token behind a line end, which no token holds.
        spelt = np.full((len(code), 2), ord("\n"), np.uint32)
        spelt[:, 1] = code
        taken = np.empty((len(code), 2), bool)
        taken[:, 0] = mark | (word & ~np.append(False, word[:-1]))
        taken[:, 1] = mark | (word & ~dropped)
        at = np.flatnonzero(taken)
        shaped = spelt.reshape(-1).take(at).tobytes().decode("utf-32-le", "surrogatepass")
        bounds = zip(*(np.searchsorted(at, 2 * x).tolist() for x in (starts, ends)), strict=True)
        return [[s for s, _ in Counter(shaped[a:b].split("\n")[1:]).most_common(k)] for a, b in bounds]


def _code_words(joined: str, word: np.ndarray) -> np.ndarray:
    """Where words of ``CODE`` stand alone."""
    found = []
    for name in CODE:
        at = joined.find(name)
        while at >= 0:
            if not word[at - 1] and not word[at + len(name)]:
                found.append(at)
            at = joined.find(name, at + len(name))
    return np.sort(np.array(found, np.int64))


def measures_udf(spark: SparkSession, shapes: int):
    """text -> its counts and its most common word shapes; a null text has null counts and no shapes."""
    starts, masks = char_classes(spark)

    @F.pandas_udf(", ".join(f"{n} int" for n in COUNTS) + ", shapes array<string>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Measures(starts, masks)
        for batch in batches:
            texts, parts, group, filled = batch.tolist(), [], [], 0
            for text in texts:
                if group and filled + len(text or "") > WINDOW:
                    parts.append(known.of(group, shapes))
                    group, filled = [], 0
                group.append(text or "")
                filled += len(text or "")
            if group:
                parts.append(known.of(group, shapes))
            found = {n: np.concatenate([c[n] for c, _ in parts]) if parts else [] for n in COUNTS}
            rows = pd.DataFrame(found).astype("Int32")
            rows[batch.isna().to_numpy()] = pd.NA
            yield rows.assign(shapes=[s for _, lists in parts for s in lists])

    return measured


def with_measures(df, text: Column, shapes: int):
    """Add the columns of ``text.surface_counts`` and ``text.linguistic_counts``, and ``shapes``."""
    out = df.withColumn("_measures", measures_udf(df.sparkSession, shapes)(text)).withColumn("n_chars", F.char_length(text))
    return out.withColumns({n: F.col(f"_measures.{n}") for n in (*COUNTS, "shapes")}).drop("_measures")
