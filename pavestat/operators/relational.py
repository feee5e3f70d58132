"""Joins, rankings, samples and order-dependent operators over DataFrames.

Order is explicit everywhere: ``order`` columns say what comes first, and ties go by
the columns that follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, weighted_pearson
from .order import percentiles, place, ranked_pairs, same_keys


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, which fails when it runs if a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("repeated key")).cast("boolean"))).drop("__n")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key), key, "left_anti")


def counted_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows of ``left`` with and without a match in ``right``."""
    known = right.select(key).distinct().withColumn("__hit", F.lit(1))
    return left.join(known, key, "left").agg(F.count("__hit").alias("num_evaluated"), (F.count("*") - F.count("__hit")).alias("num_without_match"))


def fingerprints(df: DataFrame, group: str, key: str) -> DataFrame:
    """``(group, fingerprint)``: the SHA-256 of the group's keys in order, each with a line's end.
    Keys are sorted by Spark and streamed: a digest is a chain, so a group is one task's work,
    but no task holds it. Null keys are out; a group of none has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for g, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or g != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = g, hashlib.sha256()
                digest.update(f"{k}\n".encode())
        if digest is not None:
            done.append((now, digest.hexdigest()))
        if done:
            groups, found = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(found)], names=["group", "fingerprint"])

    own = df.where(F.col(key).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(key).cast("string").alias("key"))
    found = own.repartition("group").sortWithinPartitions("group", "key").mapInArrow(run, "group string, fingerprint string")
    return found.withColumnRenamed("group", group)


def fallback_join(samples: DataFrame, records: DataFrame, sample: str, record: str, keys: Sequence[tuple[str, str]], order: Sequence[str] = ()) -> DataFrame:
    """Each sample with the record that agrees on the first of ``keys`` that any record
    agrees on; of several, the first by ``order`` (columns of ``records``), then by ``record``.
    Every key is an equi-join; samples without a match keep a null record."""
    found = None
    first = F.min_by(record, F.struct(*order, record)).alias(record)
    for rank, (s, r) in enumerate(keys):
        hits = samples.select(F.col(sample), F.col(s).alias("__v")).join(records.where(F.col(r).isNotNull()).groupBy(F.col(r).alias("__v")).agg(first), "__v")
        hits = hits.select(sample, F.struct(F.lit(rank).alias("key_rank"), F.col(record)).alias("__best"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(sample).agg(F.min("__best").alias("__best"))
    return samples.join(best, sample, "left").select("*", "__best.*").drop("__best")


def top_and_bottom(df: DataFrame, group: Sequence[str], metric: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` best and ``k`` worst of each group; nulls are out. ``side`` is top or
    bottom, ``place`` counts from 1."""
    df = df.where(finite(F.col(metric)).isNotNull())
    out = []
    for side, order in (("top", [F.desc(metric), *map(F.asc, ties)]), ("bottom", [F.asc(metric), *map(F.desc, ties)])):
        w = Window.partitionBy(*group).orderBy(*order)
        out.append(df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1])


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation per group with average ranks; null under ``least`` pairs."""
    pairs = df.select(*group, finite(F.col(x)).alias("__x"), finite(F.col(y)).alias("__y")).where("__x is not null and __y is not null")
    ranked = ranked_pairs(pairs, group, "__x", "__y")
    n = F.sum("__n")
    return ranked.groupBy(*group).agg(n.alias("n"), F.when(n >= least, weighted_pearson(F.col("__rx"), F.col("__ry"), F.col("__n"))).alias("rho"))


def third_bounds(df: DataFrame, x: str, ties: Sequence[str]) -> tuple[int, Row, Row]:
    """The number of rows, and the last row by (x, ties) of the lowest third and the first of the
    highest; a third is max(1, n // 3) rows."""
    n = df.count()
    third = max(1, n // 3)
    low, high = (place(df, [x, *ties], k) for k in (third - 1, n - third))
    return n, low, high


def _as_struct(row: Row, names: Sequence[str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)])


def tertile_effect(df: DataFrame, x: str, y: str, ties: Sequence[str], least: int = 10) -> DataFrame:
    """Mean of ``y`` in the lowest third by ``x`` less that in the highest. ``ties`` are numbers
    that tell rows of one x apart."""
    df = df.select(finite(F.col(x)).alias("__x"), finite(F.col(y)).alias("__y"), *ties).where("__x is not null and __y is not null")
    n = df.count()
    if n < least:
        return df.agg(F.lit(n).cast("long").alias("n"), F.lit(None).cast("double").alias("effect"))
    _, low, high = third_bounds(df, "__x", ties)
    names = ["__x", *ties]
    own = F.struct(*names)
    return df.agg(F.count("*").alias("n"), (F.avg(F.when(own <= _as_struct(low, names), F.col("__y"))) - F.avg(F.when(own >= _as_struct(high, names), F.col("__y")))).alias("effect"))


def median_split(df: DataFrame, x: str, y: str) -> DataFrame:
    """Means of ``y`` at or under the median of ``x`` and above it."""
    df = df.select(finite(F.col(x)).alias("__x"), finite(F.col(y)).alias("__y")).where("__x is not null and __y is not null")
    middle = percentiles(df, [], F.col("__x"), [0.5]).select(F.col("q0").alias("median"))  # one row
    low = F.col("__x") <= F.col("median")
    return df.crossJoin(F.broadcast(middle)).agg(F.first("median").alias("median"), F.avg(F.when(low, F.col("__y"))).alias("low_mean"), F.avg(F.when(~low, F.col("__y"))).alias("high_mean"))


def runs(df: DataFrame, group: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Runs of equal states: ``run`` from 0, ``state`` and ``length``."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(F.when(F.row_number().over(w) == 1, 0).otherwise(1))
    numbered = df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w))
    return numbered.groupBy(*group, "run").agg(F.first(state).alias("state"), F.count("*").alias("length"))


def degradation(df: DataFrame, condition: str, scores: Sequence[str], least: int, prefer: Sequence[str]) -> DataFrame:
    """Per condition the means of ``scores`` and the sum of the drops against a baseline: the
    first preferred condition that is there, else the largest group (ties by name). A
    missing score counts as no drop; groups under ``least`` rows are out, and under two groups
    there is no row."""
    names = [f"mean_{s}" for s in scores]
    means = df.where(F.col(condition).isNotNull()).groupBy(condition).agg(F.count("*").alias("n"), *[F.avg(finite(F.col(s))).alias(m) for s, m in zip(scores, names, strict=True)]).where(F.col("n") >= least)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, prefer)), F.col(condition)), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(len(prefer) + 1)
    base = means.agg(F.min_by(F.struct(F.col(condition).alias("baseline"), *[F.col(m).alias("__" + m) for m in names]), F.struct(rank, -F.col("n"), condition)).alias("b"), F.count("*").alias("__groups")).select("b.*", "__groups")  # one row
    drop = sum((F.coalesce(F.col("__" + m) - F.col(m), F.lit(0.0)) for m in names), F.lit(0.0))
    return means.crossJoin(F.broadcast(base)).where("__groups >= 2").select(condition, "n", "baseline", *names, drop.alias("drop"))


def unpivot_flags(df: DataFrame, keys: Sequence[str], rules: dict[str, tuple[str, float]]) -> DataFrame:
    """For metrics with a rule (lt, gt, eq, gte and a bound): one row per metric and row of
    ``df`` with ``flagged``; null never is."""
    ops = {"lt": lambda c, v: c < v, "gt": lambda c, v: c > v, "eq": lambda c, v: c == v, "gte": lambda c, v: c >= v}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(ops[op](finite(F.col(m)), F.lit(v)), F.lit(False)).alias("flagged")) for m, (op, v) in rules.items()])
    return df.select(*keys, F.inline(cells))


def one_hot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """A 0/1 column for each value of a list column."""
    return df.select(*keys, *[F.coalesce(F.array_contains(column, v), F.lit(False)).cast("int").alias(f"{prefix}{v}") for v in values])


def stratified_targets(df: DataFrame, stratum: Sequence[str], share: float, least: int) -> DataFrame:
    """Rows to draw per stratum: max(least, half-even rounded share), capped at its size."""
    n = F.count("*")
    return df.groupBy(*stratum).agg(n.alias("n"), F.least(n, F.greatest(F.lit(least).cast("long"), F.bround(n * share).cast("long"))).alias("target"))


def stratified_sample(df: DataFrame, stratum: Sequence[str], key: str, share: float, least: int, seed: str) -> DataFrame:
    """The rows with the least seeded hashes in each stratum, as many as its target. Hashes are
    counted by their first digits; what lies under the cut is taken as it is, and only rows of
    the one bin that the cut falls in are ordered."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    own = df.withColumn("__h", h).withColumn("__bin", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = own.groupBy(*stratum, "__bin").agg(F.count("*").alias("__c"))
    over = Window.partitionBy(*stratum).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(over), F.lit(0)))
    targets = stratified_targets(df, stratum, share, least).select(*stratum, "target")
    cut = same_keys(counts, targets, stratum).where((F.col("__before") < F.col("target"))).groupBy(*stratum).agg(F.max(F.struct("__bin", "__before", "target")).alias("__cut"))
    near = same_keys(own, cut, stratum).where(F.col("__bin") <= F.col("__cut.__bin"))
    below = near.where(F.col("__bin") < F.col("__cut.__bin"))
    place_ = F.row_number().over(Window.partitionBy(*stratum).orderBy("__h", key))
    inside = near.where(F.col("__bin") == F.col("__cut.__bin")).withColumn("__place", place_).where(F.col("__place") + F.col("__cut.__before") <= F.col("__cut.target"))
    return below.select(*df.columns).unionByName(inside.select(*df.columns))


def step_quantile(df: DataFrame, group: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """The first value at which the running weight reaches ``q`` of all weight."""
    df = df.groupBy(*group, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*group).orderBy(value)
    df = df.withColumn("__run", F.sum("__w").over(w)).withColumn("__all", F.sum("__w").over(Window.partitionBy(*group)))
    return df.where(F.col("__run") >= F.col("__all") * q).groupBy(*group).agg(F.min(value).alias("quantile"))


def support_curve(df: DataFrame, key: Sequence[str], forward: str, backward: str, deltas: Sequence[float]) -> DataFrame:
    """Per distance bound: mean precision, recall and F1 over the rows that define each.
    ``forward`` and ``backward`` are arrays of distances; an empty one defines nothing."""
    exploded = df.select(*key, forward, backward, F.explode(F.array(*map(F.lit, deltas))).alias("delta"))
    hit = lambda c: F.try_divide(F.size(F.filter(c, lambda d: d <= F.col("delta"))).cast("double"), F.size(c).cast("double"))
    scored = exploded.select("delta", hit(backward).alias("p"), hit(forward).alias("r"))
    f = F.when((F.col("p") + F.col("r")) == 0, 0.0).otherwise(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return scored.withColumn("f", f).groupBy("delta").agg(F.avg("p").alias("mean_precision"), F.avg("r").alias("mean_recall"), F.avg("f").alias("mean_f1"), F.count("f").alias("n_f1"))
