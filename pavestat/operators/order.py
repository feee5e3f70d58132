"""Order statistics, ranks and positions: nothing orders a whole group or table in one task.

* ``values_at``: exact values at ranks. A mergeable quantile sketch per group brackets each
  rank to a few ten-thousandths of the group; what lies under a bracket is only counted,
  what lies in it is counted by value, and only that is ordered. Sketches bound ranks, not
  values, so outliers and ties leave brackets as they are. For larger groups the sketch is
  made more accurate, so that a bracket holds at most some ``HELD`` values.
* ``average_ranks``: equal values are counted first; splitters of the different values cut each
  group into parts of as many values, and ranks run inside a part after its beginning.
* ``place``: the row at a place of several columns, one column after another among the rows
  that are equal so far.
* ``numbered``: positions by sort keys of any type, from the rows of range partitions.
* ``large_groups`` tells the groups that one task should not order. For all others, which may be
  as many as the rows, ``middle_parts`` finds medians in a window, without sketches or joins.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..sources.scratch import scratch

#: Ranks of a sketch are right within a group's size by this.
ACCURACY = 10_000
#: Values of a bracket that one task orders.
HELD = 1 << 20
#: Parts of a group whose ranks run by themselves, a power of two, and the bits that number them.
PARTS = 256
#: Hashes of groups whose rows are counted before groups are.
HASHES = 1 << 16


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joined where the keys are equal or both null; without keys with the one row of ``right``."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, on).drop(*[f"__right_{k}" for k in keys])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its size known to later joins."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sketched(own: DataFrame, group: Sequence[str], fractions: Sequence[float], accuracy: int) -> DataFrame:
    """Per group its size ``__n`` and a bracket of values for each fraction of it."""
    margin = 3 / accuracy
    marks = [max(0.0, q - margin) for q in fractions] + [min(1.0, q + margin) for q in fractions]
    found = own.groupBy(*group).agg(F.count("*").alias("__n"), F.percentile_approx("__v", marks, accuracy).alias("__marks"))
    return written(found, "sketch")


def values_at(df: DataFrame, group: Sequence[str], value: Column, fractions: Sequence[float], ranks: Sequence[Sequence[Column]]) -> DataFrame:
    """Rows ``(group, k, rank, v, before, n, size)``: for the ranks (from 0, told from the group's
    size ``__n``) beside the k-th of ``fractions``, the value there, how many values of the group
    are less, how many are equal, and how many there are. Null, NaN and infinite values are out. A rank beyond
    its bracket by more than one place fails the query."""
    own = df.select(*group, finite(value).alias("__v")).where("__v is not null")
    sketch = _sketched(own, group, fractions, ACCURACY)
    most = sketch.agg(F.max("__n")).first()[0] or 0
    if most * 8 // ACCURACY > HELD:
        sketch = _sketched(own, group, fractions, most * 8 // HELD + 1)
    brackets = F.array(*[F.struct(F.lit(k).alias("k"), F.col("__marks")[k].alias("low"), F.col("__marks")[k + len(fractions)].alias("high")) for k in range(len(fractions))])
    held = same_keys(own, sketch, group).select(*group, "__v", "__n", F.inline(brackets))
    kind = F.when(F.col("__v") < F.col("low"), 0).when(F.col("__v") <= F.col("high"), 1).otherwise(2)
    keyed = held.select(*group, "k", "__n", "__v", kind.alias("kind"), F.when(kind == 1, F.col("__v")).alias("key"))
    counted = keyed.groupBy(*group, "k", "kind", "key").agg(F.count("*").alias("n"), F.min("__v").alias("v"), F.max("__v").alias("last"), F.first("__n").alias("__n"))
    under = Window.partitionBy(*group, "k").orderBy("kind", "key").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(under), F.lit(0)))
    asked = F.filter(F.array(*[F.struct(F.lit(k).alias("of"), r.cast("long").alias("rank")) for k, rs in enumerate(ranks) for r in rs]), lambda z: (z["of"] == F.col("k")) & (z["rank"] >= F.col("before")) & (z["rank"] < F.col("before") + F.col("n")))
    found = counted.withColumn("asked", asked).where(F.size("asked") > 0).withColumn("rank", F.explode("asked.rank"))
    # beside the bracket only the next values are known
    v = (
        F.when(F.col("kind") == 1, F.col("v")).when((F.col("kind") == 2) & (F.col("rank") == F.col("before")), F.col("v"))
        .when((F.col("kind") == 0) & (F.col("rank") == F.col("before") + F.col("n") - 1), F.col("last"))
        .otherwise(F.raise_error(F.lit("a rank outside its bracket")).cast("double"))
    )
    return found.select(*group, "k", "rank", v.alias("v"), "before", "n", F.col("__n").alias("size"))


def large_groups(df: DataFrame, group: Sequence[str], most: int) -> DataFrame:
    """The groups of more than ``most`` rows, written. Rows are counted by a hash of the group
    first, which shuffles ``HASHES`` numbers a task; only groups under a heavy hash are counted."""
    own = df.select(*group, F.pmod(F.xxhash64(*group), F.lit(HASHES)).alias("__hash"))
    heavy = own.groupBy("__hash").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("__hash")
    counted = own.join(F.broadcast(heavy), "__hash", "left_semi").groupBy(*group).agg(F.count("*").alias("__n"))
    return written(counted.where(F.col("__n") > most).select(*group), "large")


def middle_parts(df: DataFrame, group: Sequence[str], value: str, as_: str) -> DataFrame:
    """``df`` with each row's part of its group's median of ``value`` (null or a finite double),
    which is the sum of the parts: all or half of a middle value, null elsewhere. A task
    orders a group."""
    order = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())
    n = F.count(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumns({"__twice": 2 * F.row_number().over(order), "__n": n})
    part = F.col(value) * F.when(F.col("__n") % 2 == 1, 1.0).otherwise(0.5)
    return df.withColumn(as_, F.when(F.col("__twice").between(F.col("__n"), F.col("__n") + 2), part)).drop("__twice", "__n")


def percentiles(df: DataFrame, group: Sequence[str], value: Column, qs: Sequence[float]) -> DataFrame:
    """Per group exact percentiles ``q0, q1, ...`` of the finite values, between values where
    they fall so."""
    at = lambda size: [(F.col(size) - 1) * F.lit(float(q)) for q in qs]
    found = values_at(df, group, value, qs, [[F.floor(a), F.floor(a) + 1] for a in at("__n")])
    share = 1 - F.abs(F.element_at(F.array(*at("size")), F.col("k") + 1) - F.col("rank"))
    return found.groupBy(*group).agg(*[F.sum(F.when((F.col("k") == k) & (share > 0), F.col("v") * share)).alias(f"q{k}") for k in range(len(qs))])


def split(by: DataFrame, group: Sequence[str], value: str, parts: int = PARTS) -> DataFrame:
    """``by``, a row for each value of a group, with ``__part``: the group's values cut into
    parts of as many values by splitters that a sketch tells. Searched by halves."""
    marks = [k / parts for k in range(1, parts)]
    cuts = by.groupBy(*group).agg(F.percentile_approx(value, marks, 4 * parts).alias("__cuts"))
    steps = F.array(*[F.lit(1 << b) for b in range(parts.bit_length() - 2, -1, -1)])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at("__cuts", at + step) < F.col(value), at + step).otherwise(at))
    return same_keys(by, cuts, group).withColumn("__part", part).drop("__cuts")


def _counted_ranks(by: DataFrame, group: Sequence[str], value: str, as_: str) -> DataFrame:
    """``by(group, value, __n)`` to ``(group, value, as_)``: the average rank of each value."""
    own = written(split(by, group, value), "parts")  # both its sums and its ranks read it
    under = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # ``PARTS`` rows
    starts = own.groupBy(*group, "__part").agg(F.sum("__n").alias("__s")).select(*group, "__part", F.coalesce(F.sum("__s").over(under), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__start") + F.coalesce(F.sum("__n").over(inside), F.lit(0)) + (F.col("__n") + 1) / 2
    return same_keys(own, starts, [*group, "__part"]).select(*group, value, rank.alias(as_))


def average_ranks(df: DataFrame, group: Sequence[str], value: str, as_: str) -> DataFrame:
    """``df`` with the average rank of ``value`` in its group."""
    by = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    return same_keys(df, _counted_ranks(by, group, value, as_), [*group, value])


def ranked_pairs(pairs: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """``(group, x, y, __n, __rx, __ry)``: the different pairs of each group, how often each
    stands there, and the average ranks of both. Rows that repeat travel once."""
    by = written(pairs.groupBy(*group, x, y).agg(F.count("*").alias("__n")), "pairs")
    cells = F.inline(F.array(*[F.struct(F.lit(s).alias("__side"), F.col(c).alias("__value"), "__n") for s, c in ((0, x), (1, y))]))
    sides = by.select(*group, cells).groupBy(*group, "__side", "__value").agg(F.sum("__n").alias("__n"))
    ranks = _counted_ranks(sides, [*group, "__side"], "__value", "__rank")
    for side, c, as_ in ((0, x, "__rx"), (1, y, "__ry")):
        own = ranks.where(F.col("__side") == side).select(*group, F.col("__value").alias(c), F.col("__rank").alias(as_))
        by = same_keys(by, own, [*group, c])
    return by


def place(df: DataFrame, columns: Sequence[str], k: int) -> Row | None:
    """The values of ``columns``, numbers, of the row at place ``k`` from 0 in their order; None
    if there are not as many rows without nulls. A few numbers reach the driver; of rows that
    are equal in the first columns only the next column is looked at."""
    df = df.dropna(subset=list(columns)).select(*columns)
    n, found = df.count(), []
    if not 0 <= k < n:
        return None
    for c in columns:
        at = values_at(df, [], F.col(c), [k / n], [[F.lit(k)]]).first()
        found.append(df.where(F.col(c).cast("double") == at.v).agg(F.min(c)).first()[0])
        df, n, k = df.where(F.col(c) == found[-1]), at.n, k - at.before
        if n == 1:
            return df.first()
    return Row(*columns)(*found)


def numbered(df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``position`` from 0 by ``order`` (columns of any type that tell all rows
    apart), counted anew in each group of ``within``, which ``order`` begins with. Spark's range
    partitions are cut by sampled keys; the sorted table is written with each row's place in
    its partition, and a count per partition says where its positions begin."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    own = written(placed, "ordered").withColumn("__task", F.shiftright("__at", 33))
    under = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = own.groupBy("__task").agg(F.count("*").alias("__c")).select("__task", F.coalesce(F.sum("__c").over(under), F.lit(0)).alias("__start"))
    own = own.join(F.broadcast(starts), "__task").withColumn("position", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__task", "__at", "__start")
    if not within:
        return own
    firsts = own.groupBy(*within).agg(F.min("position").alias("__first"))
    return same_keys(own, firsts, within).withColumn("position", F.col("position") - F.col("__first")).drop("__first")
