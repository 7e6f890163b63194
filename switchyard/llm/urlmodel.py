"""URL filter: host rules first, then a ratio of two character language models.

URLs that a rule allows train one smoothed variable-order Markov model, those
that a rule blocks the other; a URL without a rule is judged by the difference
of its log-likelihoods per character.  Built-in functions only.

Counting.  Equal URLs are counted together first.  A padded URL gives one gram of
``ORDER + 1`` characters for each character; shorter contexts are sums over these
grams, so the corpus is cut up once.  Every distinct gram gets its log ratio once
(Witten-Bell: a context's probability is mixed with that of the next shorter one,
by the number of different characters that follow), and the characters of a URL
are joined with this table.  The table grows with the number of different grams and
is joined, not collected.

Calibration.  Every fifth of the different URLs, by checksum, stays out of the
counts.  The threshold is the edge, among fixed ones, with the best mean of both
classes' hit rates on them; only the histogram over these edges is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.session import materialise

ORDER = 3
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Probability of a character without any context: one of the byte values.
_FLOOR = 1 / 256
#: Width and greatest size of the edges that the threshold is chosen from.
EDGE, EDGES = 0.02, 250


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow | block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that the registered query is asked for.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def matched(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits columns ``host`` and ``path``, and its verdict; else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        own = (F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))
        fits = own & F.startswith("path", F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """Adds a row for each character and the end of ``line``: ``gram``, it and the ORDER characters before."""
    padded = F.concat(F.lit(_START * ORDER), F.col("line"), F.lit(_END))
    return (
        urls.withColumn("padded", padded)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("line") + 1)))
        .withColumn("gram", F.substring("padded", F.col("at"), F.lit(ORDER + 1)))
        .drop("padded", "at")
    )


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, allow, block) counts -> (gram, ratio): ln P(last | before) of allow minus that of block."""
    kinds = ("allow", "block")
    model = grams
    zero = grams.groupBy(F.substring("gram", ORDER + 1, 1).alias("g")).agg(*[F.sum(k).alias(k) for k in kinds])
    base = zero.agg(
        *[F.sum(k).alias(k) for k in kinds], *[F.sum((F.col(k) > 0).cast("long")).alias(f"t_{k}") for k in kinds]
    ).first()
    for order in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        counts = grams.groupBy(tail.alias("tail")).agg(*[F.sum(k).alias(f"n_{k}") for k in kinds])
        model = model.withColumn("tail", tail).join(counts, "tail")
        if order:
            context = F.substring("tail", 1, order)
            totals = counts.groupBy(context.alias("context")).agg(
                *[F.sum(f"n_{k}").alias(f"s_{k}") for k in kinds],
                *[F.sum((F.col(f"n_{k}") > 0).cast("long")).alias(f"t_{k}") for k in kinds],
            )
            model = model.withColumn("context", context).join(totals, "context").drop("context")
        else:
            for k in kinds:
                model = model.withColumn(f"s_{k}", F.lit(base[k] or 0)).withColumn(f"t_{k}", F.lit(base[f"t_{k}"] or 0))
        for k in kinds:
            shorter = F.col(f"p_{k}") if order else F.lit(_FLOOR)
            seen = F.col(f"s_{k}") + F.col(f"t_{k}")
            mixed = (F.col(f"n_{k}") + F.col(f"t_{k}") * shorter) / seen
            model = model.withColumn(f"p_{k}", F.when(seen > 0, mixed).otherwise(shorter))
        model = model.drop("tail", *[f"{x}_{k}" for x in "nst" for k in kinds])
    return model.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(line) -> (line, score): the mean log ratio of its characters and its end."""
    found = _grams(urls.select("line")).join(ratios, "gram", "left")
    total = F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count("*")
    return found.groupBy("line").agg(F.round(total, 9).alias("score"))


def threshold(labelled: DataFrame) -> float:
    """(score, verdict, n) -> the edge with the best mean hit rate, the one nearest to 0 of equals."""
    edge = F.greatest(F.least(F.floor(F.col("score") / EDGE), F.lit(EDGES)), F.lit(-EDGES))
    rows = labelled.groupBy(edge.cast("int").alias("edge"), "verdict").agg(F.sum("n").alias("n")).collect()
    allow, block = ({r["edge"]: r["n"] for r in rows if r["verdict"] == k} for k in ("allow", "block"))
    n_allow, n_block = sum(allow.values()), sum(block.values())
    if not n_allow or not n_block:
        return 0.0

    def merit(e: int) -> tuple[float, int]:
        hits = sum(n for x, n in allow.items() if x >= e) / n_allow + sum(n for x, n in block.items() if x < e) / n_block
        return round(hits, 12), -abs(e)

    return max(range(-EDGES, EDGES + 1), key=merit) * EDGE


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, score, verdict (allow or block).

    A URL without host and path, a null one too, has no characters and is allowed.
    Without allowed or blocked URLs to learn from the threshold is 0.  Repeated rows
    stay repeated and count as often as they occur; an empty table gives no rows."""
    host, path = split_url(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(rules)
    urls = (
        rows.groupBy("host", "path")
        .agg(F.count("*").alias("n"))
        .withColumn("rule", rule)
        .withColumn("verdict", verdict)
        .withColumn("line", F.concat("host", "path"))
        .withColumn("out", F.crc32(F.col("line").cast("binary")) % 5 == 0)
    )
    urls = materialise(urls, "urls")
    weight = [
        F.sum(F.when((F.col("verdict") == k) & ~F.col("out"), F.col("n")).otherwise(0)).alias(k) for k in ("allow", "block")
    ]
    grams = materialise(_grams(urls).groupBy("gram").agg(*weight), "grams")
    scored = materialise(scores(urls, materialise(log_ratios(grams), "ratios")), "scores")
    known = scored.withColumnRenamed("line", "scored_line")
    urls = urls.join(known, F.col("line") == F.col("scored_line")).drop("scored_line", "n_chars")
    limit = threshold(urls.where(F.col("out") & F.col("verdict").isNotNull()))
    method = F.when((F.col("line") == "") | (F.col("score") >= limit), "allow").otherwise("block")
    judged = urls.select(
        F.col("host").alias("own_host"), F.col("path").alias("own_path"), "rule", "score", F.coalesce("verdict", method).alias("verdict")
    )
    same = (F.col("host") == F.col("own_host")) & (F.col("path") == F.col("own_path"))
    return rows.join(judged, same).select("page_id", "host", "path", "rule", "score", "verdict")
