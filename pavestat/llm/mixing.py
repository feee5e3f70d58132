"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a tree (domain, language, source) have token counts. A budget flows down from
the root: children share it by weight, none gets more than its leaves can give in
``epochs`` passes, and what one cannot take goes to its siblings before anything goes
back up. A leaf gives whole passes over its documents and then a prefix, by tokens, of
one more pass; each pass has its own seeded order.

Only leaf sums (one row per leaf) reach the driver. Selection does not sort leaves: a
pass is cut into ``SLICES`` by hash, slices are summed, and in the one slice per leaf that
the budget falls in the keys are ordered, without the rows' other columns. That tells the
first row that goes over, and a row is taken if it stands before it: texts are compared with
one row per leaf (broadcast only if there are few) and are not shuffled for it.

Defined results: null branch values are a branch of their own; a null text has no
tokens; a document is taken if the tokens up to and with it stay within the budget, so
all of a leaf without tokens are taken once; ties in the order go by id, then by a hash of the row; rows without an id are ordered by
that hash; a weight that is missing counts 1, children of weight 0 get what their
siblings cannot take; rows that repeat are separate rows; other columns are kept, but
``mix_epoch`` and ``mix_tokens`` of the input are replaced; an empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_broadcast, written

#: Slices of a pass, a power of two: by the first bits of keys of 60.
SLICES = 1024
SLICE_SHIFT = 60 - SLICES.bit_length() + 1
#: Leaves whose rows are broadcast at most; more are joined by a shuffle.
BROADCAST_LEAVES = 1 << 17
#: The words of a text, as tokens where no other count is given.
WORDS = "regexp_count(text, '[^ \\\\t-\\\\r]+')"
Path = tuple


def fill(budget: int, weights: list[float], capacity: list[int]) -> list[int]:
    """``budget`` dealt by weight, nobody above capacity, whole tokens; shortages go to
    those with room, by weight. Deals as much as capacity allows."""
    dealt, rest = [0] * len(weights), min(budget, sum(capacity))
    while rest:
        room = [i for i, c in enumerate(capacity) if dealt[i] < c]
        open_ = [i for i in room if weights[i] > 0] or room
        share = {i: weights[i] if weights[i] > 0 else 1.0 for i in open_}
        total = sum(share.values())
        full = [i for i in open_ if capacity[i] - dealt[i] <= rest * share[i] / total]
        if full:
            for i in full:
                rest -= capacity[i] - dealt[i]
                dealt[i] = capacity[i]
            continue
        exact = [rest * share[i] / total for i in open_]
        down = [int(x) for x in exact]
        left = rest - sum(down)
        by_part = sorted(range(len(open_)), key=lambda k: (down[k] - exact[k], k))
        for k, i in enumerate(open_):
            dealt[i] += down[k]
        for k in by_part:
            if left and dealt[open_[k]] < capacity[open_[k]]:
                dealt[open_[k]] += 1
                left -= 1
        rest = 0
    return dealt


def budgets(leaves: Mapping[Path, int], weights: Mapping[Path, float], total: int, epochs: int) -> dict[Path, int]:
    """Tokens for each leaf path. ``weights`` has the weight of inner and leaf paths
    among their siblings."""
    out: dict[Path, int] = {}

    def deal(prefix: Path, below: list[Path], budget: int) -> None:
        if below == [prefix]:
            out[prefix] = budget
            return
        depth = len(prefix) + 1
        children: dict[Path, list[Path]] = {}
        for leaf in below:
            children.setdefault(leaf[:depth], []).append(leaf)
        names = sorted(children, key=lambda p: [(x is not None, str(x)) for x in p])
        caps = [epochs * sum(leaves[x] for x in children[n]) for n in names]
        for n, b in zip(names, fill(budget, [float(weights.get(n, 1.0)) for n in names], caps), strict=True):
            deal(n, children[n], b)

    if leaves:
        deal((), list(leaves), total)
    return out


def _key(seed: int, epoch: Column, doc_id: Column, rest: Column) -> Column:
    """60 bits of the md5 of seed, pass and id."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), rest.cast("string")))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), own)), 1, 15), 16, 10).cast("long")


def mix(
    df: DataFrame,
    branches: Sequence[str | Column],
    weights: Mapping[Path, float],
    total: int | None = None,
    share: float = 1.0,
    epochs: int = 1,
    seed: int = 1,
    tokens: str = WORDS,
    doc_id: str = "doc_id",
) -> DataFrame:
    """The chosen rows with ``mix_epoch`` (from 0) and ``mix_tokens`` at the end. The
    budget is ``total`` tokens, or ``share`` of the tokens that ``df`` has."""
    df = df.drop("mix_epoch", "mix_tokens")
    kept = df.columns
    names = [f"branch_{k}" for k in range(len(branches))]
    rest = F.xxhash64(*[c for c in kept if c != doc_id]) if len(kept) > 1 else F.lit(0).cast("long")
    # the input's columns go into one, so that none of them meets a name of this module
    own = df.select(
        F.struct(*kept).alias("row"), F.col(doc_id).alias("id"), rest.alias("other"), F.coalesce(F.expr(tokens).cast("long"), F.lit(0)).alias("n"),
        *[(F.col(b) if isinstance(b, str) else b).cast("string").alias(n) for b, n in zip(branches, names, strict=True)],
    )
    # one small row per leaf; every leaf's rows are pre-aggregated where they are read
    sums = {tuple(r[:-1]): r[-1] for r in own.groupBy(*names).agg(F.sum("n")).collect()}
    budget = total if total is not None else int(share * sum(sums.values()))
    plan = budgets(sums, weights, budget, epochs)
    # a leaf without tokens is within any budget: one pass
    rows = [(*path, *(divmod(n, sums[path]) if sums[path] else (1, 0))) for path, n in plan.items()]
    of_leaf = [f"{n}_p" for n in names]
    schema = ", ".join([f"{n} string" for n in of_leaf] + ["whole long", "left long"])
    same = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(p)) for n, p in zip(names, of_leaf, strict=True)])
    leaves = sized_broadcast(df.sparkSession.createDataFrame(rows, schema), BROADCAST_LEAVES)
    planned = own.join(leaves, same).drop(*of_leaf)

    whole = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    part = planned.where("left > 0").withColumn("epoch", F.col("whole"))
    part = part.withColumn("key", _key(seed, F.col("epoch"), F.col("id"), F.col("other"))).withColumn("slice", F.shiftright("key", SLICE_SHIFT))
    sliced = part.groupBy(*names, "slice").agg(F.sum("n").alias("s"), F.first("left").alias("left"))
    running = sliced.withColumn("upto", F.sum("s").over(Window.partitionBy(*names).orderBy("slice")))
    # one row per leaf: the first slice that goes over the budget, and the tokens before it
    over = F.min(F.struct("slice", (F.col("upto") - F.col("s")).alias("before"))).alias("cut")
    cuts = running.where(F.col("upto") > F.col("left")).groupBy(*[F.col(n).alias(p) for n, p in zip(names, of_leaf, strict=True)]).agg(over)
    # in the slice that the budget falls in: the first row that goes over it, without its columns
    tie = ["key", "id", "other"]
    near = part.join(sized_broadcast(written(cuts, "cuts"), BROADCAST_LEAVES), same).where(F.col("slice") == F.col("cut.slice"))
    equal = near.groupBy(*names, *tie).agg(F.count("*").alias("rows"), F.first("n").alias("n"), F.first("left").alias("left"), F.first("cut.before").alias("before"))
    order = Window.partitionBy(*names).orderBy(*tie)
    equal = equal.withColumn("upto", F.col("before") + F.sum(F.col("n") * F.col("rows")).over(order))
    fits = F.expr("(left - (upto - n * rows)) div nullif(n, 0)").alias("copies")  # of rows that are alike in all
    first = equal.where("upto > left").groupBy(*[F.col(n).alias(p) for n, p in zip(names, of_leaf, strict=True)]).agg(F.min(F.struct(F.struct(*tie).alias("at"), fits)).alias("end"))
    ended = part.join(sized_broadcast(written(first, "ends"), BROADCAST_LEAVES), same).drop(*of_leaf)
    before = ended.where(F.struct(*tie) < F.col("end.at"))
    alike = ended.where((F.struct(*tie) == F.col("end.at")) & (F.col("end.copies") > 0)).groupBy(*names, *tie).agg(*[F.first(c).alias(c) for c in ("row", "n", "epoch")], F.first("end.copies").alias("copies"))
    alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    columns = [*[F.col("row").getField(c).alias(c) for c in kept], F.col("epoch").alias("mix_epoch"), F.col("n").alias("mix_tokens")]
    return functools.reduce(DataFrame.unionByName, [x.select(*columns) for x in (whole, before, alike)])
