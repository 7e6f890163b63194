"""Text measures and bucketed categorical features of a prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket thresholds and character classes that must equal the
# defaults users already rely on.
LEN_THRESHOLDS = (32, 64, 128, 256, 512, 1024)
TOKEN_THRESHOLDS = (8, 16, 32, 64, 128)
NUMBER_THRESHOLDS = (1, 5, 10, 20)
MATH_THRESHOLDS = (1, 5, 10)
PUNCT_THRESHOLDS = (10, 20, 40, 60)
UPPER_THRESHOLDS = (5, 15, 30, 60)
SENTENCE_THRESHOLDS = (1, 2, 3, 5, 8)
WORD_THRESHOLDS = (16, 32, 64, 128, 256)
TITLE_THRESHOLDS = (5, 15, 30, 50)
MATH_CLASS = r"[=<>±×÷∑√∫π∞+\-*/]"
CODE_PATTERN = r"```|\bdef\b|\bclass\b"
PUNCT_CLASS = r"[!?,.;:]"
URL_PATTERN = r"https?://|www\."

# Unicode-aware; the four separators below count as blanks too.
_SPACE = r"\s\x1c-\x1f"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_TOKEN = rf"(?U)[^{_SPACE}]+"
# Words and single punctuation marks.
_WORD = r"(?U)\w+|[^\w\s]"
# Letters that are neither upper, lower nor title case.
_CASELESS = r"[\p{L}&&[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]]"
_UPPER_TOKEN = (
    rf"(?U)(?<![^{_SPACE}]){_CASELESS}*+[\p{{L}}&&\p{{IsUppercase}}]"
    rf"[\p{{L}}&&[^\p{{IsLowercase}}\p{{Lt}}]]*+(?![^{_SPACE}])"
)
_TITLE_WORD = r"(?U)(?<!\w)\p{Lu}\p{Ll}*+(?!\w)"


def bucket(value: Column, thresholds: Sequence[float]) -> Column:
    """Index of the first threshold >= value, else their count, as a string."""
    chain = F.when(value <= F.lit(thresholds[0]), "0")
    for i, limit in enumerate(thresholds[1:], start=1):
        chain = chain.when(value <= F.lit(limit), str(i))
    return chain.otherwise(str(len(thresholds)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 when the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(0.0)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def token_count(text: Column) -> Column:
    """Blank-separated tokens."""
    return matches(text, _TOKEN)


def percent(numerator: Column, denominator: Column) -> Column:
    """Whole percent, cut towards zero."""
    return (safe_ratio(numerator, F.greatest(F.lit(1), denominator)) * 100).cast("int")


def flag(condition: Column) -> Column:
    return F.when(condition, "1").otherwise("0")


def surface_counts(text: Column) -> dict[str, Column]:
    """Raw counts from which the surface features are taken."""
    return {
        "n_chars": F.char_length(text),
        "n_tokens": token_count(text),
        "n_digits": matches(text, r"\p{Nd}"),
        "n_math": matches(text, MATH_CLASS),
        "n_code": matches(text, f"(?U){CODE_PATTERN}"),
        "n_punct": matches(text, PUNCT_CLASS),
        "n_upper": matches(text, _UPPER_TOKEN),
        "n_urls": matches(text, f"(?i){URL_PATTERN}"),
    }


def surface_features() -> dict[str, Column]:
    """The ten surface features, over columns named as in ``surface_counts``.

    Counts and buckets are separate steps: a bucket compares its count several
    times, and the count must not be taken again for every comparison.
    """
    chars, tokens = F.col("n_chars"), F.col("n_tokens")
    return {
        "len_bucket": bucket(chars, LEN_THRESHOLDS),
        "token_bucket": bucket(tokens, TOKEN_THRESHOLDS),
        "has_number": flag(F.col("n_digits") > 0),
        "number_density_bucket": bucket(percent(F.col("n_digits"), chars), NUMBER_THRESHOLDS),
        "has_math_symbol": flag(F.col("n_math") > 0),
        "math_density_bucket": bucket(percent(F.col("n_math"), tokens), MATH_THRESHOLDS),
        "has_code_pattern": flag(F.col("n_code") > 0),
        "punct_density_bucket": bucket(percent(F.col("n_punct"), tokens), PUNCT_THRESHOLDS),
        "contains_url": flag(F.col("n_urls") > 0),
        "upper_density_bucket": bucket(percent(F.col("n_upper"), tokens), UPPER_THRESHOLDS),
    }


def sentence_count(text: Column) -> Column:
    """Runs of . ! ? before a blank or the end, plus an unfinished last one."""
    closed = matches(text, rf"(?U)[.!?]++(?=[{_SPACE}]|\z)")
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return closed + F.when(last.isin("", ".", "!", "?"), 0).otherwise(1)


def word_count(text: Column) -> Column:
    return matches(text, _WORD)


def title_count(text: Column) -> Column:
    """Words that are one capital followed by small letters only."""
    return matches(text, _TITLE_WORD)


def word_shapes(text: Column) -> Column:
    """Word tokens with letters as X/x, digits as d, equal runs cut to 4.

    The classes are replaced on the whole text at once: every replaced
    character stays a word character, so token borders do not move.
    """
    shaped = F.regexp_replace(text, r"[\p{L}&&\p{IsUppercase}]", "X")
    shaped = F.regexp_replace(shaped, r"[\p{L}&&[^X]]", "x")
    shaped = F.regexp_replace(shaped, r"\p{Nd}", "d")
    shaped = F.regexp_replace(shaped, r"(?U)(\w)\1{3,}", "$1$1$1$1")
    return F.regexp_extract_all(shaped, F.lit(_WORD), 0)


def linguistic_counts(text: Column) -> dict[str, Column]:
    return {"n_sentences": sentence_count(text), "n_words": word_count(text), "n_titles": title_count(text)}


def linguistic_features() -> dict[str, Column]:
    """Rule-based features over columns named as in ``linguistic_counts``."""
    return {
        "sent_bucket": bucket(F.col("n_sentences"), SENTENCE_THRESHOLDS),
        "spacy_token_bucket": bucket(F.col("n_words"), WORD_THRESHOLDS),
        "title_density_bucket": bucket(percent(F.col("n_titles"), F.col("n_words")), TITLE_THRESHOLDS),
    }


def gram_at(chars: Column, position: Column, n: int) -> Column:
    """The n-gram starting at the 1-based ``position`` of a character array."""
    return F.concat(*[F.element_at(chars, position + k) for k in range(n)])
