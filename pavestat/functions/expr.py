"""Column builders with the null rules of metric records: a value that cannot be computed
is null, never 0 or NaN, and null takes no part in anything."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of each visibility group.
OCCLUDED = ("occluded", "partially missing")
DEGRADED = ("faded / worn / not visible", "low contrast")
CLEAR = ("clearly visible",)


def finite(c: Column) -> Column:
    """A double, or null where it is null, NaN, infinite or no number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(c: Column, low: float, high: float) -> Column:
    """``greatest`` and ``least`` skip nulls; a clipped null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean(c: Column) -> Column:
    return F.avg(finite(c))


def weighted_mean(terms: Mapping[Column, float] | Sequence[tuple[Column, float]]) -> Column:
    """Of the terms that are there, weights renormalised over them; null without any."""
    pairs = list(terms.items()) if isinstance(terms, Mapping) else list(terms)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for c, w in pairs:
        x = finite(c)
        top = top + F.coalesce(x * w, F.lit(0.0))
        bottom = bottom + F.when(x.isNotNull(), w).otherwise(0.0)
    return F.try_divide(top, bottom)


def pooled(part: Column, whole: Column, eligible: Column | None = None) -> Column:
    """Sum over sum, not the mean of ratios."""
    keep = F.lit(True) if eligible is None else eligible
    return ratio(F.sum(F.when(keep, part)), F.sum(F.when(keep, whole)))


def gap(c: Column, left: Column, right: Column, least: int = 3) -> Column:
    """Mean where ``left`` holds less mean where ``right`` holds; null with fewer than
    ``least`` values on a side."""
    a, b = F.when(left, finite(c)), F.when(right, finite(c))
    return F.when((F.count(a) >= least) & (F.count(b) >= least), F.avg(a) - F.avg(b))


def consistency(c: Column) -> Column:
    """1 - population deviation / mean, in [0, 1]; null with fewer than two values."""
    x = finite(c)
    return F.when(F.count(x) >= 2, clip(1 - F.try_divide(F.stddev_pop(x), F.avg(x)), 0.0, 1.0))


def pearson(x: Column, y: Column) -> Column:
    """Null where a side does not vary, also under ANSI rules."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def weighted_pearson(x: Column, y: Column, n: Column) -> Column:
    """Of pairs that stand there ``n`` times each; for ranks, whose spread is of the size of
    their mean, as sums lose digits otherwise. Null where a side does not vary."""
    n = n.cast("double")
    spread = lambda a, b: F.sum(n * a * b) - F.sum(n * a) * F.try_divide(F.sum(n * b), F.sum(n))
    varies = lambda a: F.when(spread(a, a) > 1e-12 * F.sum(n * a * a), spread(a, a))
    return F.try_divide(spread(x, y), F.sqrt(varies(x)) * F.sqrt(varies(y)))


def tags(c: Column) -> Column:
    """A tag list with null as the empty one and no null elements."""
    return F.coalesce(F.array_compact(c), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty lists."""
    a, b = tags(a), tags(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union.cast("double")))


def visibility_group(c: Column, fallback: str = "not_applicable") -> Column:
    """Of a list between semicolons: occluded before degraded before clear."""
    own = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ";"), lambda x: F.trim(x))
    has = lambda names: F.arrays_overlap(own, F.array(*map(F.lit, names)))
    return F.when(has(OCCLUDED), "occluded").when(has(DEGRADED), "degraded").when(has(CLEAR), "clear").otherwise(fallback)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing was to be found or said."""
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def readiness_class(r1: Column, r2: Column) -> Column:
    return F.when((r1 >= 80) & (r2 >= 80), "HIGH").when((r1 >= 60) | (r2 >= 60), "MODERATE").otherwise("LOW")


def hash_share(seed: str, key: Column) -> Column:
    """In [0, 1]: the first 32 bits of sha256 of seed:key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967295


def grid(height: Column, step: int) -> Column:
    """Rows step, 2 step, ... below ``height``; empty for none (``sequence`` would count down)."""
    return F.when(height > step, F.sequence(F.lit(step), height - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def reversals(k: Column, high: float, separation: float) -> Column:
    """Sign changes along the array ``k``: a sample of at least ``high`` in size sets the
    sign, if that of the last change differs and lies ``separation`` of the length back.
    Null samples are passed over; a null array gives null, an empty one 0."""
    apart = separation * (F.size(k) - 1)

    def step(state: Column, sample: Column) -> Column:
        sign, at = F.signum(sample["x"]).cast("int"), sample["i"]
        new = F.struct(sign.alias("sign"), at.alias("at"), (state["n"] + (state["sign"] != 0).cast("int")).alias("n"))
        strong = F.coalesce(F.abs(sample["x"]) >= high, F.lit(False))
        changed = (state["sign"] == 0) | ((sign != state["sign"]) & (at - state["at"] >= apart))
        return F.when(strong & changed, new).otherwise(state)

    samples = F.transform(k, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.aggregate(samples, F.struct(F.lit(0).alias("sign"), F.lit(0).alias("at"), F.lit(0).alias("n")), step, lambda s: s["n"])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def autocorrelation(p: Column, q: Column, lag: int) -> Column:
    """Correlation of the array ``p`` with itself ``lag`` places on, each pair weighted by
    the product of its ``q``, from 0 to 1; 0 if too short, without weight or constant.
    One pass over the pairs sums what it takes."""
    n = F.greatest(F.size(p) - lag, F.lit(0))
    sides = F.zip_with(F.slice(p, 1, n), F.slice(p, lag + 1, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    weights = F.zip_with(F.slice(q, 1, n), F.slice(q, lag + 1, n), lambda a, b: a * b)
    pairs = F.zip_with(sides, weights, lambda v, w: F.struct(v["a"].alias("a"), v["b"].alias("b"), w.alias("w")))
    sums = {"w": "", "a": "a", "b": "b", "ab": "ab", "aa": "aa", "bb": "bb"}

    def add(state: Column, v: Column) -> Column:
        out = []
        for name, factors in sums.items():
            term = v["w"]
            for f in factors:
                term = term * v[f]
            out.append((state[name] + F.coalesce(term, F.lit(0.0))).alias(name))
        return F.struct(*out)

    def value(s: Column) -> Column:
        def about(x: str, y: str) -> Column:
            return s[x + y] - F.try_divide(s[x] * s[y], s["w"])

        return F.try_divide(about("a", "b"), F.sqrt(F.greatest(about("a", "a") * about("b", "b"), F.lit(0.0))))

    found = F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(x) for x in sums]), add, value)
    return F.when(p.isNull() | q.isNull(), None).when((n <= 2) | F.lit(lag < 2), 0.0).otherwise(clip(F.coalesce(found, F.lit(0.0)), 0.0, 1.0))


def arc_length(x: Column, y: Column) -> Column:
    """Length of the line through the points of two arrays; 0 for under two points."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    steps = [F.zip_with(F.slice(c, 2, n), F.slice(c, 1, n), lambda b, a: b - a) for c in (x, y)]
    return _total(F.zip_with(*steps, F.hypot))


def stop_reason(n: Column, least_count: Column, since_progress: Column, left: Column, per_tag: int, total: int, patience: int, cap: int) -> Column:
    """Why sampling ends after ``n`` samples, the rarest tag seen ``least_count`` times;
    null to go on."""
    return (
        F.when((n >= total) & (least_count >= per_tag), "coverage")
        .when((n >= total) & (since_progress >= patience), "stalled")
        .when(n >= cap, "cap")
        .when(left <= 0, "pool_exhausted")
    )


#: Conditions that name a context, and what a marking's tag says of its wear.
CONTEXTS = ("curve", "cross", "crowded", "no_marking", "shadow", "dazzle")
WORN = ("faded", "worn", "not visible", "missing", "low contrast")


def either(*columns: Column) -> Column:
    """The first text that is there and not empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def context(condition: Column, scene: Column, lanes: Column) -> Column:
    """A telling condition itself; else road kind by scene and number of lanes; else the
    condition, which may be null."""
    town, n = scene.isin("urban", "city street"), F.coalesce(lanes, F.lit(0))
    return (
        F.when(condition.isin(*CONTEXTS), condition)
        .when((scene == "highway") & (n <= 2), "rural_highway")
        .when(town & n.between(2, 3), "urban_street")
        .when(town & (n > 3), "urban_intersection")
        .otherwise(condition)
    )


def traffic(told: Column, dark: Column) -> Column:
    """What is told; else by the share of dark pixels; unknown without either."""
    return F.coalesce(told, F.when(dark > 0.30, "high").when(dark > 0.15, "medium").when(dark.isNotNull(), "low"), F.lit("unknown"))


def has_tags(c: Column, wanted: Sequence[str], every: bool = False) -> Column:
    """Whether a tag list has any, or every one, of ``wanted``; nothing wanted is had by all."""
    if not wanted:
        return F.lit(True)
    want = F.array(*map(F.lit, wanted))
    return F.size(F.array_except(want, tags(c))) == 0 if every else F.arrays_overlap(want, tags(c))


def wear_bucket(tag: Column) -> Column:
    t = F.lower(tag)
    worn = F.lit(False)
    for word in WORN:
        worn = worn | F.contains(t, F.lit(word))
    return F.when(worn, "worn/faded").when(F.contains(t, F.lit("clearly visible")), "clearly_visible").otherwise("other")


def stratum(metadata: Column, dimension: str) -> Column:
    """The value of a dimension in a map of metadata; ``time``, ``context`` and ``traffic`` go
    by other names there."""
    if dimension == "context":
        return either(metadata["condition"], metadata["scene"])
    return metadata[{"time": "timeofday", "traffic": "traffic_proxy"}.get(dimension, dimension)]


def unconflicted(seen: Column) -> Column:
    """Visibility tags, and those that are dropped: "clearly visible" beside any tag of
    occlusion or wear. A struct of ``kept`` and ``dropped``."""
    own = tags(seen)
    among = lambda names: lambda t: F.lower(F.trim(t)).isin(*names)
    clash = F.exists(own, among((*OCCLUDED, *DEGRADED))) & F.exists(own, among(CLEAR))
    dropped = F.when(clash, F.filter(own, among(CLEAR))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.array_except(own, dropped).alias("kept"), dropped.alias("dropped"))


def stem(path: Column) -> Column:
    """The file's name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"(?<=.)\.[^.]*$", "")


def safe_name(name: Column) -> Column:
    return F.translate(name, "/\\", "__")


def normal_tag(tag: Column) -> Column:
    """Lower case, one space between words and around slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(tag), r"\s*/\s*", " / "), r"\s+", " "))


def dimension_column(name: Column) -> Column:
    return F.concat(F.lit("tag_"), F.replace(F.replace(F.replace(F.lower(name), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_")))


def saturation(x: Column, scale: float) -> Column:
    return 1 - F.exp(-x / scale)


def root_mean_square(*terms: Column) -> Column:
    """Of the terms that are there; null without any."""
    squares = [finite(t) * finite(t) for t in terms]
    n = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in squares), F.lit(0))
    return F.sqrt(F.try_divide(sum((F.coalesce(s, F.lit(0.0)) for s in squares), F.lit(0.0)), n))


def softmax(scores: Column) -> Column:
    """Of an array; shifted by its maximum."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(raised, lambda s: F.try_divide(s, _total(raised)))
