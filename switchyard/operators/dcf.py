"""Distributional cluster features: the weight and the sparse profile of records and clusters.

A record spreads its weight evenly over its features; a cluster's profile is the mean of
its records'.  Joining two loses ``(w1 + w2) * JS`` bits, where the Jensen-Shannon
divergence takes them with shares ``w1 / (w1 + w2)`` and ``w2 / (w1 + w2)``.  Features are
named by a 64-bit hash of key and value, so no vocabulary is fitted, collected or sent.

Profiles of a bucket and its records meet in one sorted stream, profiles first: a task
holds the profiles of one bucket and compares a batch of records with all of them in one
sparse product.  A bucket of many records is dealt into parts, each with the profiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.session import task_count

#: Records that share one copy of a bucket's profiles.
PART_ROWS = 1 << 12
#: Entries of a block of the sparse product.
_BLOCK = 1 << 20

PROFILES = "bucket int, local int, w double, terms array<long>, p array<double>"
_NO_TERMS, _NO_SHARES = "array<bigint>", "array<double>"


def term(key: Column | str, value: Column | str) -> Column:
    return F.xxhash64(key, value)


def terms_of(features: Column) -> Column:
    """The features of a map as sorted hashes; a null map has none."""
    pairs = F.transform(F.map_entries(features), lambda e: F.xxhash64(e["key"], e["value"]))
    return F.coalesce(F.sort_array(pairs), F.array().cast(_NO_TERMS))


def pack(feature_probs: DataFrame, weights: DataFrame) -> DataFrame:
    """``PROFILES`` from (coarse_id, key, value, local, p) and (coarse_id, local, w)."""
    lists = feature_probs.groupBy("coarse_id", "local").agg(
        F.array_sort(F.collect_list(F.struct(term("key", "value").alias("term"), "p"))).alias("_t")
    )
    t = F.col("_t")
    return weights.join(lists, ["coarse_id", "local"], "left").select(
        F.col("coarse_id").cast("int").alias("bucket"),
        F.col("local").cast("int").alias("local"),
        F.col("w").cast("double").alias("w"),
        F.coalesce(F.transform(t, lambda x: x["term"]), F.array().cast(_NO_TERMS)).alias("terms"),
        F.coalesce(F.transform(t, lambda x: x["p"]), F.array().cast(_NO_SHARES)).alias("p"),
    )


def plogp(p: np.ndarray) -> np.ndarray:
    return p * np.log2(np.maximum(p, 1e-300))


class Profiles:
    """Profiles of one bucket, by term, for products with records."""

    def __init__(self, local: np.ndarray, w: np.ndarray, terms: list[np.ndarray], shares: list[np.ndarray]):
        order = np.argsort(local, kind="stable")
        self.local, self.w = local[order], w[order]
        sizes = [len(terms[i]) for i in order]
        flat = np.concatenate([terms[i] for i in order]) if sizes else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(order)), sizes)
        by_term = np.argsort(flat, kind="stable")
        self.terms, self.starts = np.unique(flat[by_term], return_index=True)
        self.starts = np.append(self.starts, len(flat))
        self.owner = owner[by_term]
        self.p = (np.concatenate([shares[i] for i in order]) if sizes else np.zeros(0))[by_term]
        self.bp = (self.w / (1.0 + self.w))[self.owner] * self.p
        self.bplog = plogp(self.bp)

    def _cost(self, own: np.ndarray, w: np.ndarray, p: np.ndarray | float) -> np.ndarray:
        """What one feature adds, without ``b p log2(1/b)``, which the profile's whole mass adds."""
        a, b = 1.0 / (1.0 + w), w / (1.0 + w)
        mix = a * own + b * p
        return plogp(a * own) - a * own * np.log2(a) + plogp(b * p) - plogp(mix)

    def _shared(self, at: np.ndarray, size: int) -> np.ndarray:
        """[term, profile]: what terms at ``at`` add for records of ``size`` features, beyond lacking them."""
        counts = self.starts[at + 1] - self.starts[at]
        step = np.repeat(self.starts[at] - np.append(0, np.cumsum(counts))[:-1], counts) + np.arange(counts.sum())
        owner, own = self.owner[step], 1.0 / (size * (1.0 + self.w))
        mix = own[owner] + self.bp[step]
        found = np.zeros((len(at) + 1, len(self.w)))  # the last row is for terms that no profile has
        found[np.repeat(np.arange(len(at)), counts), owner] = self.bplog[step] + plogp(own)[owner] - mix * np.log2(mix)
        return found

    def losses(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[record, profile]: what a record of weight 1 loses by joining a profile.

        What a term adds depends on the record's number of features only: it is worked out once
        for all records of one size, which then add up rows, in the order of their terms."""
        m, b = np.maximum(sizes, 1).astype(float), self.w / (1.0 + self.w)
        # As if the profile lacked all features of the record; shared ones correct it.
        lacking = sizes[:, None] * self._cost(1.0 / m[:, None], self.w[None, :], 0.0)
        shared = np.zeros((len(sizes), len(self.w)))
        at = np.searchsorted(self.terms, flat)
        if len(self.terms):
            at[self.terms[np.minimum(at, len(self.terms) - 1)] != flat] = len(self.terms)
        first = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[sizes > 0]).tolist() if len(self.terms) else []:
            of_size = np.flatnonzero(sizes == size)
            step = max(1, _BLOCK // (size * 8))
            for some in (of_size[i : i + step] for i in range(0, len(of_size), step)):
                places, numbers = np.unique(at[first[some][:, None] + np.arange(size)], return_inverse=True)
                numbers = numbers.reshape(len(some), size)
                if places[-1] == len(self.terms):
                    places = places[:-1]
                added, total = self._shared(places, size), np.zeros((len(some), len(self.w)))
                for j in range(size):
                    total += added[numbers[:, j]]
                shared[some] = total
        mass = np.bincount(self.owner, weights=self.p, minlength=len(self.w))
        return (1.0 + self.w)[None, :] * (lacking + shared - (b * np.log2(b) * mass)[None, :])


def _nearest(profiles: Profiles, batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """(local, loss) per record; equal losses, to nine digits, give the smaller number."""
    lists = batch.column("terms")
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    local, loss = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
    step = max(1, 4 * _BLOCK // max(1, len(profiles.w)))
    for at in range(0, len(sizes), step):
        upto = min(at + step, len(sizes))
        found = profiles.losses(flat[offsets[at] : offsets[upto]], sizes[at:upto])
        best = np.round(found, 9).argmin(axis=1)
        local[at:upto], loss[at:upto] = profiles.local[best], found[np.arange(upto - at), best]
    return pa.array(local), pa.array(loss)


def nearest(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """(bucket, record_key, terms) and ``PROFILES`` -> the records with local and loss.

    ``local`` is the profile of the record's bucket that it joins with the least loss, null
    in a bucket without profiles.  Records should be different ones: each is compared once."""
    sizes = records.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    copies = profiles.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = records.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("record_key"), F.col("parts")).cast("int"))
    null = F.lit(None)
    columns = ["bucket", "part", "kind", "record_key", "local", "w", "terms", "p"]
    met = copies.select("bucket", "part", F.lit(0).alias("kind"), null.cast("string").alias("record_key"), "local", "w", "terms", "p").union(
        dealt.select("bucket", "part", F.lit(1).alias("kind"), "record_key", null.cast("int"), null.cast("double"), "terms", null.cast(_NO_SHARES))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, gathered, profiles = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "kind")]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                now = int(keys[0][a]), int(keys[1][a])
                if now != place:
                    place, gathered, profiles = now, [], None
                if keys[2][a] == 0:
                    gathered.append(part)
                    continue
                if profiles is None and gathered:
                    rows = [r for g in gathered for r in zip(*(g.column(c).to_pylist() for c in ("local", "w", "terms", "p")), strict=True)]
                    local, w, terms, p = zip(*rows, strict=True)
                    profiles = Profiles(np.array(local), np.array(w), [np.array(t, np.int64) for t in terms], [np.array(x, float) for x in p])
                    gathered = []
                if profiles is None:
                    found = pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.float64())
                else:
                    found = _nearest(profiles, part)
                kept = [part.column(c) for c in ("bucket", "record_key", "terms")]
                yield pa.RecordBatch.from_arrays([*kept, *found], ["bucket", "record_key", "terms", "local", "loss"])

    schema = "bucket int, record_key string, terms array<long>, local int, loss double"
    tasks = task_count(records.sparkSession)
    return met.select(*columns).repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part", "kind").mapInArrow(run, schema)


# --- merging ----------------------------------------------------------------------------------


def merge_profiles(weights: np.ndarray, shares: np.ndarray, k: int, tau: float | None = None) -> np.ndarray:
    """Cluster number per profile after joining the cheapest pair again and again.

    ``shares`` is the matrix of profiles and features, its rows sum to 1 or are zero.
    Stops at ``k`` clusters, or when the next join would lose more than ``tau`` bits of the
    whole; losses equal to twelve digits give the first pair."""
    n = len(weights)
    if n <= max(1, k):
        return np.arange(n)
    w, p = weights.astype(float) / weights.sum(), shares.astype(float).copy()
    mass, own = p.sum(axis=1), plogp(p).sum(axis=1)

    def losses(i: int, others: np.ndarray) -> np.ndarray:
        """Of joining ``i`` with each of ``others``: only features of ``i`` can be shared."""
        joint = w[i] + w[others]
        a, b = w[i] / joint, w[others] / joint
        on = np.flatnonzero(p[i])
        x, y = a[:, None] * p[i, on], b[:, None] * p[np.ix_(others, on)]
        shared = (plogp(x) + plogp(y) - plogp(x + y)).sum(axis=1)
        mixed = -(plogp(a) * mass[i] + a * own[i] + plogp(b) * mass[others] + b * own[others]) + shared
        return np.round(joint * mixed + w[i] * own[i] + w[others] * own[others], 12)

    loss = np.full((n, n), np.inf)
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        loss[i, later] = loss[later, i] = losses(i, later)
    # The least loss of every row, kept up to date, instead of a search of the whole matrix.
    best = loss.argmin(axis=1) if n else np.zeros(0, int)
    least = loss[np.arange(n), best] if n else np.zeros(0)
    members, alive = np.arange(n), np.ones(n, bool)
    for _ in range(n - max(1, k)):
        i = int(least.argmin())
        j = int(best[i])
        if not np.isfinite(least[i]) or (tau is not None and least[i] > tau):
            break
        i, j = min(i, j), max(i, j)
        joint = w[i] + w[j]
        p[i] = (w[i] * p[i] + w[j] * p[j]) / joint
        w[i] = joint
        mass[i], own[i] = p[i].sum(), plogp(p[i]).sum()
        members[members == j] = i
        alive[j] = False
        loss[j], loss[:, j], least[j] = np.inf, np.inf, np.inf
        others = np.flatnonzero(alive & (np.arange(n) != i))
        if len(others):
            loss[i, others] = loss[others, i] = losses(i, others)
        stale = others[(best[others] == i) | (best[others] == j)]
        for r in (i, *stale.tolist()):
            best[r] = loss[r].argmin()
            least[r] = loss[r, best[r]]
        better = others[(loss[others, i] < least[others]) | ((loss[others, i] == least[others]) & (i < best[others]))]
        best[better], least[better] = i, loss[better, i]
    return np.unique(members, return_inverse=True)[1]


# --- mini-batch centres -----------------------------------------------------------------------


class Centres:
    """Centres that batches of records move; as many columns as features seen."""

    def __init__(self, k: int, seed: int):
        self.k, self.seed = k, seed
        self.terms = np.zeros(0, np.int64)
        self.mass = np.zeros((0, 0))
        self.weight = np.zeros(0)

    def _columns(self, flat: np.ndarray) -> np.ndarray:
        new = np.setdiff1d(flat, self.terms)
        if len(new):
            terms = np.union1d(self.terms, new)
            mass = np.zeros((len(self.mass), len(terms)))
            mass[:, np.searchsorted(terms, self.terms)] = self.mass
            self.terms, self.mass = terms, mass
        return np.searchsorted(self.terms, flat)

    def divergence(self, columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[record, centre] Jensen-Shannon divergence in bits, equal shares."""
        record = np.repeat(np.arange(len(sizes)), sizes)
        own = 0.5 / np.maximum(sizes, 1)[record]
        out = np.zeros((len(sizes), len(self.mass)))
        for c in range(len(self.mass)):
            p = 0.5 * self.mass[c] / self.weight[c]
            q = p[columns]
            part = plogp(own) + plogp(q) - plogp(own + q)
            out[:, c] = np.bincount(record, weights=part, minlength=len(sizes)) + 0.5 * (sizes > 0) + p.sum()
        return out

    def _begin(self, columns: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> None:
        """First centres among a batch: each next one by chance, far ones more likely."""
        rng, far = np.random.default_rng(self.seed), None
        sizes = np.diff(offsets)
        for _ in range(min(self.k, len(sizes))):
            chance = weights if far is None else weights * far
            if far is not None and chance.sum() <= 1e-12:
                break
            row = int(np.searchsorted(np.cumsum(chance), rng.random() * chance.sum(), "right"))
            row = min(row, len(sizes) - 1)
            first = np.zeros((1, len(self.terms)))
            first[0, columns[offsets[row] : offsets[row + 1]]] = 1.0 / max(1, sizes[row])
            self.mass, self.weight = np.vstack([self.mass, first]), np.append(self.weight, 1.0)
            mine = self.divergence(columns, sizes)[:, -1]
            far = np.maximum(mine if far is None else np.minimum(far, mine), 0.0)

    def move(self, flat: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> float:
        """Assign a batch, add it to its centres; the mean divergence before that."""
        sizes = np.diff(offsets)
        columns = self._columns(flat)
        if not len(self.mass):
            self.mass = np.zeros((0, len(self.terms)))
            self._begin(columns, offsets, weights)
        found = self.divergence(columns, sizes)
        best = np.round(found, 9).argmin(axis=1)
        record = np.repeat(np.arange(len(sizes)), sizes)
        np.add.at(self.mass, (best[record], columns), (weights / np.maximum(sizes, 1))[record])
        self.weight += np.bincount(best, weights=weights, minlength=len(self.weight))
        return float((found[np.arange(len(sizes)), best] * weights).sum() / weights.sum())


#: Batches without a better mean divergence after which the centres rest, and how it is smoothed.
PATIENCE, SMOOTH, PASSES = 10, 0.3, 3


def fit_centres(records: DataFrame, n_records: int, k: int, seed: int, batch_size: int, max_iter: int) -> DataFrame:
    """``PROFILES`` of ``k`` centres, bucket 0, from different records (record_key, n, terms).

    Batches of ``batch_size`` records in an order that the seed decides move the centres one
    after another, at most ``max_iter`` batches and ``PASSES`` passes; so this is one task's
    work, bounded by these parameters and not by the table, which holds the centres and one
    batch.  A centre is the mean profile of all records that it was given."""
    passes = max(1, min(PASSES, max_iter * batch_size // max(1, n_records)))
    share = min(1.0, max_iter * batch_size / max(1, n_records * passes))
    order = F.xxhash64(F.lit(seed), "pass", "record_key")
    chosen = (
        records.where(F.pmod(F.xxhash64(F.lit(seed), "record_key"), F.lit(1 << 32)) < int(share * (1 << 32)))
        .select("record_key", "n", "terms", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
        .withColumn("order", order)
    )
    placed = chosen.repartition(1).sortWithinPartitions("pass", "order", "record_key").select("n", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, mean, least, waited, turns = Centres(k, seed), None, np.inf, 0, 0
        waiting: list[pa.RecordBatch] = []

        def turn(rows: pa.Table) -> float:
            lists = rows["terms"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets = lists.offsets.to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            return centres.move(flat, offsets - offsets[0], rows["n"].to_numpy().astype(float))

        def whole() -> Iterator[pa.Table]:
            nonlocal waiting
            for batch in batches:
                waiting.append(batch)
                while sum(b.num_rows for b in waiting) >= batch_size:
                    rows = pa.Table.from_batches(waiting)
                    yield rows.slice(0, batch_size)
                    waiting = rows.slice(batch_size).to_batches()
            if sum(b.num_rows for b in waiting):
                yield pa.Table.from_batches(waiting)

        for rows in whole():
            now = turn(rows)
            mean = now if mean is None else SMOOTH * now + (1 - SMOOTH) * mean
            waited, least = (0, mean) if mean < least - 1e-9 else (waited + 1, least)
            turns += 1
            if waited >= PATIENCE or turns >= max_iter:
                break
        shares = [m / w for m, w in zip(centres.mass, centres.weight, strict=True)]
        on = [np.flatnonzero(s) for s in shares]
        columns = [
            pa.array(np.zeros(len(on), np.int32)),
            pa.array(np.arange(len(on), dtype=np.int32)),
            pa.array(np.ones(len(on))),  # equal shares: the weight of a centre does not repel
            pa.array([centres.terms[o] for o in on], pa.list_(pa.int64())),
            pa.array([s[o] for s, o in zip(shares, on, strict=True)], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PROFILES.split(", ")])

    return placed.mapInArrow(run, PROFILES)
