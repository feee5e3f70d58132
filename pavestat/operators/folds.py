"""Folds of cross-validation: balanced, stratified by class, or of whole groups.

Rows are dealt in a seeded order by their positions, so fold sizes differ by one row at most,
in each class and overall. Groups are packed greedily, the largest first, each into the
lightest fold. The packing goes by sizes, not by groups: of the groups of one size the greedy
rule gives every fold a number that a level of water tells, and which group goes where follows
from its place among those of its size. So the driver sees each different size once (of n
rows there are at most the square root of 2 n), not the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, same_keys

#: Different sizes of groups at most: their number reaches the driver.
MOST_SIZES = 1 << 20


def _order(seed: int, columns: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))


def balanced(df: DataFrame, folds: int, key: Sequence[str], stratum: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` from 0. ``key`` tells rows apart. With ``stratum`` each class is dealt
    by itself, beginning where the class before ended; a null class is one. There are no more
    folds than rows, or rows of the smallest class; ValueError with fewer than two."""
    by = [stratum] if stratum else []
    least = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    folds = min(folds, least)
    if folds < 2:
        raise ValueError("two folds at least")
    placed = numbered(df.withColumn("__h", _order(seed, key)), [*by, "__h", *key])
    # positions run on through the classes, as ``order`` begins with the class
    return placed.withColumn("fold", (F.col("position") % folds).cast("int")).drop("__h", "position")


def packed(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """``(size, fold, first, end)``: of the groups of a size those with places from ``first`` up to
    ``end`` go to ``fold``. ``sizes`` are (size, groups). What one group after another into the
    lightest fold (the first of equals) would give."""
    load, out = [0] * folds, []
    for size, groups in sorted(sizes, reverse=True):
        # the greedy rule fills up to a level: fold f takes ceil((level - load) / size) groups
        takes = lambda level: [max(0, -(-(level - x) // size)) for x in load]
        low, high = min(load), max(load) + size * groups
        while low < high:  # the highest level that takes no more than there are
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(takes(middle)) <= groups else (low, middle - 1)
        given = takes(low)
        left = groups - sum(given)
        for _, f in sorted((x + size * n, f) for f, (x, n) in enumerate(zip(load, given, strict=True)))[:left]:
            given[f] += 1
        first = 0
        for f, n in enumerate(given):
            if n:
                out.append((size, f, first, first + n))
                first += n
                load[f] += n * size
    return out


def grouped(df: DataFrame, folds: int, group: str, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` from 0; no group is cut. Rows of a null group are one. There are
    no more folds than groups; ValueError with fewer than two."""
    counts = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__size"))
    ordered = numbered(counts.withColumn("__h", _order(seed, ["__group"])), ["__size", "__h", "__group"], ["__size"])
    sizes = ordered.groupBy("__size").agg(F.count("*").alias("groups"))
    if sizes.limit(MOST_SIZES + 1).count() > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} different sizes of groups")
    found = [(r[0], r[1]) for r in sizes.collect()]
    folds = min(folds, sum(n for _, n in found))
    if folds < 2:
        raise ValueError("two folds at least")
    dealt = df.sparkSession.createDataFrame(packed(found, folds), "__size long, fold int, first long, end long")
    chosen = ordered.join(dealt, "__size").where("position >= first and position < end").select(F.col("__group").alias(group), "fold")
    return same_keys(df, chosen, [group])


def sizes(df: DataFrame, stratum: Sequence[str] = ()) -> DataFrame:
    """Rows of each fold and class."""
    return df.groupBy("fold", *stratum).agg(F.count("*").alias("n"))


