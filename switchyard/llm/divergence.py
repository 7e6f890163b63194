"""Quality rules by distribution divergence, in built-in functions only.

Every document gets two histograms: characters by class, and the common words of
its language with all other words in one bin.  They are compared with the
histograms of all documents of the language by the Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1).  Documents shorter than
``MIN_WORDS`` are too short for a histogram and are not judged by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import GAP, words
from switchyard.session import materialise

MIN_WORDS = 50
#: A document is rejected above either distance.  On texts that pass the base rules the distance of
#: characters has two groups, ordinary ones below 0.25 and those full of symbols above 0.30.
MAX_CHARS = 0.30
MAX_WORDS = 0.50
# Characters that count as symbols, and ten frequent words per language.
SYMBOLS = "#*$%&|<>"
COMMON = {
    "de": "der die und in den von zu das mit sich".split(),
    "en": "the of and to in a is that was for".split(),
    "es": "de la que el en y los se del las".split(),
    "fr": "de la le et les des en un du une".split(),
}
WIDTH = 10
CLASSES = ["lower", "space", "upper", "digit", "mark", "other"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_TALLIES = [f"c{i}" for i in range(len(CLASSES))] + [f"w{i}" for i in range(WIDTH + 1)]


def _occurrences(word: Column) -> Column:
    return F.size(F.filter("_common", lambda w: w == word)).cast("long")


def tallies(docs: DataFrame) -> DataFrame:
    """Adds the language key, the words and both histograms (``c0`` .. and ``w0`` ..)."""
    chain = docs.withColumn("_t0", F.coalesce("text", F.lit(""))).withColumn("_words", words(F.col("text")))
    # Each step removes one class of characters, so that later steps see little text.
    patterns = ["[a-z]+", GAP, "[A-Z]+", "[0-9]+", "[!-~]+"]
    for i, pattern in enumerate(patterns):
        chain = chain.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", pattern, ""))
    sizes = [F.length(f"_t{i}").cast("long") for i in range(len(patterns) + 1)]
    counts = [a - b for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1]]
    # Symbols are marks: they are there until marks are removed.
    plain = F.length(F.translate("_t4", SYMBOLS, ""))
    chain = chain.withColumn("n_symbols", sizes[4] - plain).withColumn("word_chars", sizes[0] - counts[1])
    chain = chain.withColumns({f"c{i}": c for i, c in enumerate(counts)})
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = sorted({w for v in COMMON.values() for w in v})
    chain = (
        chain.withColumn("language", F.coalesce("lang", F.lit("")))
        .withColumn("_list", F.coalesce(F.element_at(lists, F.col("language")), F.array().cast("array<string>")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_common", F.filter(F.transform("_words", F.lower), lambda w: w.isin(known)))
    )
    for i in range(WIDTH):
        chain = chain.withColumn(f"w{i}", _occurrences(F.get(F.col("_list"), F.lit(i))))
    rest = F.col("n_words") - reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(WIDTH)])
    chain = chain.withColumn(f"w{WIDTH}", rest)
    return chain.drop("_list", "_common", *[f"_t{i}" for i in range(1, len(patterns) + 1)])


def repeats(counted: DataFrame) -> DataFrame:
    """Adds the line and three-word-window repetition counts and ``base_failed``."""
    lines = F.filter(F.split("_t0", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = counted.withColumn("_lines", lines).withColumn(
        "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    )
    w = F.col("_words")
    hashes = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.slice("_words", 1, F.col("n_words").cast("int") - 2),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_h", hashes).withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    ordered = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.col("_again"), ordered))
    s = F.col("_s")

    def found(x: Column, k: Column) -> Column:
        """The window's position if a neighbour in hash order is equal, else null."""
        before = F.when(k > 0, F.get(s, k - 1)["h"])
        same = (F.get(s, k + 1)["h"] == x["h"]) | (before == x["h"])
        return F.when(F.coalesce(same, F.lit(False)), x["i"])

    out = out.withColumn("_p", F.array_sort(F.filter(F.transform("_s", found), lambda p: p.isNotNull())))
    p = F.col("_p")
    covered = F.transform("_p", lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_h", "_again", "_s", "_p")


def references(counted: DataFrame) -> DataFrame:
    """One row per language: the summed histograms of all its documents."""
    sums = counted.groupBy("language").agg(*[F.sum(c).alias(f"ref_{c}") for c in _TALLIES])
    return sums.withColumnRenamed("language", "ref_language")


def _distance(names: list[str]) -> Column:
    """Jensen-Shannon distance of columns ``x`` and ``ref_x``; 0 where either is empty.

    The columns become two arrays: a sum over bins spelled out makes a method that is too
    large to compile."""
    own, ref = (F.array(*[F.col(f"{side}{n}").cast("double") for n in names]) for side in ("", "ref_"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    n_own, n_ref = total(own), total(ref)
    shares = F.transform(own, lambda x: x / n_own), F.transform(ref, lambda x: x / n_ref)
    divergence = total(F.zip_with(*shares, lambda p, q: term(p, q) + term(q, p))) / 2
    return F.when((n_own > 0) & (n_ref > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def compare(counted: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``char_distance`` and ``word_distance`` to the language's reference."""
    joined = counted.join(refs, F.col("language") == F.col("ref_language"), "left")
    chars, common = _TALLIES[: len(CLASSES)], _TALLIES[len(CLASSES) :]
    return joined.withColumn("char_distance", _distance(chars)).withColumn("word_distance", _distance(common))


def verdicts(measured: DataFrame) -> DataFrame:
    """Adds ``kept``: the base rules hold and no distance is above its limit."""
    near = (F.col("char_distance") <= MAX_CHARS) & (F.col("word_distance") <= MAX_WORDS)
    return measured.withColumn("kept", ~F.col("base_failed") & near)


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, both distances, base_failed, kept.

    A null text has no words and fails the base rules; a null or unknown language
    has its own reference over characters, and its word distance is 0.  Repeated
    rows stay repeated, an empty table gives an empty result.  The measured columns
    of each document (no text) are stored once, as the references need all first."""
    rows = docs.select("doc_id", "text", "lang")
    counted = repeats(tallies(rows)).select("doc_id", "language", *BASE, "base_failed", *_TALLIES)
    stored = materialise(counted, "histograms")
    refs = materialise(references(stored), "references")
    judged = verdicts(compare(stored, refs))
    return judged.select("doc_id", *BASE, "base_failed", "char_distance", "word_distance", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, all columns unchanged.

    The rows are stored once with their measured columns: the verdict needs the references
    of all of them, and a filter on columns that are not stored would have each step of
    their computation repeated for each use."""
    # The measured columns could clash with those of the input: carry the row as one value.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    counted = repeats(tallies(rows)).select("_row", "language", *BASE, "base_failed", *_TALLIES)
    stored = materialise(counted, "histograms")
    refs = materialise(references(stored), "references")
    return verdicts(compare(stored, refs)).where("kept").select("_row.*")
