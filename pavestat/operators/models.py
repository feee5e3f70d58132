"""Regression by sums: each fit is a few one-pass aggregates of k * k numbers, which alone
reach the driver; rows are never collected."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .folds import balanced, grouped
from .order import written

STEPS, CLOSE = 25, 1e-10


@dataclass
class Fit:
    terms: list[str]
    coef: np.ndarray
    covariance: np.ndarray
    rows: int
    family: str = "ols"
    alpha: float = 0.0
    extra: dict = field(default_factory=dict)


def recommend(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row: for each column the model that its values suggest. Two different values of any
    kind are binary, before all else; then shares of 0 to 1, whole numbers from 0 on, numbers.
    Text of other than two values, or no values, gives null."""
    own = df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns.values())])
    ends = own.agg(*[f(F.col(f"c{k}")).alias(f"{e}{k}") for k in range(len(columns)) for e, f in (("low", F.min), ("high", F.max))])  # one row
    cells = []
    for k, name in enumerate(columns):
        raw, low, high = F.col(f"c{k}"), F.col(f"low{k}"), F.col(f"high{k}")
        cells.append(F.struct(F.lit(name).alias("name"), raw.isNotNull().alias("there"), ((raw != low) & (raw != high)).alias("inner"), (low < high).alias("wide"), raw.try_cast("double").alias("y")))
    # values of all columns one below another: one small aggregate for all of them
    y = F.col("y")
    found = own.crossJoin(F.broadcast(ends)).select(F.inline(F.array(*cells))).groupBy("name").agg(
        F.max("wide").alias("wide"), F.count_if("inner").alias("inner"), F.count_if("there").alias("there"), F.count(y).alias("numbers"), F.min(y).alias("low"), F.max(y).alias("high"),
        F.count_if(F.abs(y - F.round(y)) > 1e-8 + 1e-5 * F.abs(F.round(y))).alias("broken"), F.avg(y).alias("mean"), F.var_samp(y).alias("spread"),
    )
    many = F.coalesce((F.col("mean") > 0) & (F.col("spread") > 1.25 * F.col("mean")), F.lit(False))
    told = (
        F.when(F.col("wide") & (F.col("inner") == 0), "binomial")
        .when((F.col("there") > F.col("numbers")) | (F.col("there") == 0), None)
        .when((F.col("low") >= 0) & (F.col("high") <= 1), "fractional")
        .when((F.col("broken") == 0) & (F.col("low") >= 0), F.when(many, "negative_binomial").otherwise("poisson"))
        .otherwise("ols")
    )
    named = found.select("name", told.alias("told"))
    return named.agg(*[F.max(F.when(F.col("name") == n, F.col("told"))).alias(n) for n in columns])


TRUE = ("1", "true", "yes", "y", "t")


def _flag(c: Column) -> Column:
    """1 for a number 1 or a word of assent; null is 0."""
    return F.coalesce((c.try_cast("double") == 1) | F.lower(F.trim(c.cast("string"))).isin(*TRUE), F.lit(False))


def derive(df: DataFrame, specs: Sequence[Mapping]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column per spec (``name, operation, columns`` and, for a threshold,
    ``value``), in order, so that later ones may use earlier ones; and what could not be made.
    Operations: and, or, product, sum, mean, difference, ratio, threshold. A null part makes a
    null whole, but for flags, where it is false; a ratio over 0 is null."""
    errors = []
    for spec in specs:
        name, kind, names = spec["name"], spec["operation"], list(spec["columns"])
        if lacking := [c for c in names if c not in df.columns]:
            errors.append(f"{name}: missing source column(s): {', '.join(lacking)}")
            continue
        parts, flags = [F.col(f"`{c}`").try_cast("double") for c in names], [_flag(F.col(f"`{c}`")) for c in names]
        if kind in ("and", "or"):
            made = functools.reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), flags).cast("int")
        elif kind in ("product", "sum", "mean"):
            made = functools.reduce((lambda a, b: a * b) if kind == "product" else (lambda a, b: a + b), parts)
            made = made / len(parts) if kind == "mean" else made
        elif kind == "difference":
            made = parts[0] - parts[1]
        elif kind == "ratio":
            made = F.try_divide(parts[0], parts[1])
        elif kind == "threshold":
            made = (parts[0] >= float(spec["value"])).cast("int")
        else:
            errors.append(f"{name}: no operation {kind!r}")
            continue
        df = df.withColumn(name, made)
    return df, errors


def outcome(y: Column, treatment: str = "numeric", value: object = None) -> Column:
    """An outcome as a number, null where ``y`` is: ``equals`` a value, ``at_least`` or
    ``below`` a bound as 0 or 1, or the number itself."""
    number = y.try_cast("double")
    if treatment == "equals":
        return (y == F.lit(value)).cast("double")
    if treatment in ("at_least", "below"):
        return ((number >= float(value)) if treatment == "at_least" else (number < float(value))).cast("double")
    if treatment != "numeric":
        raise ValueError(f"no treatment {treatment!r}")
    return number


def validate(df: DataFrame, y: str, family: str) -> None:
    """ValueError unless the values of ``y`` fit the family."""
    c = F.col(y)
    low, high, odd = df.agg(F.min(c), F.max(c), F.count_if(F.abs(c - F.round(c)) > 1e-8 + 1e-5 * F.abs(c))).first()
    if low is None or low == high:
        raise ValueError("the outcome must have two different values")
    if family in ("binomial", "fractional") and (low < 0 or high > 1):
        raise ValueError("shares must be from 0 to 1")
    if family == "binomial" and df.where((c != 0) & (c != 1)).limit(1).count():
        raise ValueError("a binary outcome must be 0 or 1")
    if family in ("poisson", "negative_binomial") and (low < 0 or odd):
        raise ValueError("counts must be whole numbers from 0 on")


#: Levels of a categorical predictor at most: each is a column of the design.
LEVELS = 256


@dataclass
class Design:
    """Complete rows as numbers: ``y``, the predictors ``xs`` and, if grouped, ``group``."""

    df: DataFrame
    y: str
    xs: list[str]
    notes: list[str]


def design(df: DataFrame, y: str, xs: Sequence[str], categorical: Sequence[str] = (), group: str | None = None, standardise: bool = False) -> Design:
    """Rows complete in all columns; 0/1 columns for the levels of categories but the first by
    name; predictors that do not vary dropped; numbers beside 0 and 1 brought to mean 0 and
    deviation 1 if asked. ValueError under ten rows, without a predictor, or if predictors
    depend on each other."""
    own = df.select(F.col(y).try_cast("double").alias(y), *[F.col(x).cast("string").alias(x) if x in categorical else F.col(x).try_cast("double").alias(x) for x in xs], *([F.col(group).alias("__group")] if group else []))
    for c in own.columns:
        own = own.where(F.col(c).isNotNull() if c in categorical or c == "__group" else E.finite(F.col(c)).isNotNull())
    made: dict[str, Column] = {}
    for x in xs:
        if x not in categorical:
            made[x] = F.col(x)
            continue
        levels = sorted(r[0] for r in own.select(x).distinct().limit(LEVELS + 1).collect())
        if len(levels) > LEVELS:
            raise ValueError(f"{x} has over {LEVELS} levels")
        made |= {f"{x}_{level}": (F.col(x) == level).cast("double") for level in levels[1:]}
    own = own.select(y, *[c.alias(n) for n, c in made.items()], *(["__group"] if group else []))
    names, stats = list(made), []
    stats = own.agg(F.count("*"), *[f(F.col(f"`{n}`")) for n in names for f in (F.min, F.max, F.avg, F.stddev_pop)], *[F.count_if(~F.col(f"`{n}`").isin(0.0, 1.0)) for n in names]).first()
    if stats[0] < 10:
        raise ValueError("fewer than 10 complete rows")
    about = {n: stats[1 + 4 * k : 5 + 4 * k] for k, n in enumerate(names)}
    other = dict(zip(names, stats[1 + 4 * len(names) :], strict=True))
    flat = [n for n in names if about[n][0] == about[n][1]]
    kept = [n for n in names if n not in flat]
    notes = [f"dropped constant predictor(s): {', '.join(flat)}"] if flat else []
    if not kept:
        raise ValueError("no predictor varies")
    scaled = [n for n in kept if standardise and n in xs and n not in categorical and other[n]]
    own = own.select(y, *[((F.col(f"`{n}`") - about[n][2]) / about[n][3] if n in scaled else F.col(f"`{n}`")).alias(n) for n in kept], *(["__group"] if group else []))
    if scaled:
        notes.append(f"standardised predictor(s): {', '.join(scaled)}")
    sums, n = _sums(own, [F.lit(1.0), *[F.col(f"`{x}`") for x in kept]], F.lit(1.0))
    size = np.sqrt(np.diag(sums))
    if np.linalg.eigvalsh(sums / np.outer(size, size))[0] < 1e-10:
        raise ValueError("predictors depend on each other: remove one")
    return Design(own, y, kept, notes)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where all columns are finite numbers, as doubles."""
    return complete_with(df, columns)


def complete_with(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """``complete`` with other columns kept beside."""
    own = df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns], *more)
    for c in columns:
        own = own.where(E.finite(F.col(f"`{c}`")).isNotNull())
    return own


def _dot(terms: Sequence[Column], values: Sequence[float]) -> Column:
    return sum((t * float(v) for t, v in zip(terms, values, strict=True)), F.lit(0.0))


def _sums(df: DataFrame, columns: Sequence[Column], weight: Column) -> tuple[np.ndarray, int]:
    """Weighted sums of products of all pairs of columns, and the number of rows."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(F.count("*"), *[F.sum(columns[i] * columns[j] * weight) for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out, row[0]


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    """Least squares with a constant; HC3 covariance from a second pass."""
    own = complete(df, [y, *xs])
    terms = [F.lit(1.0), *[F.col(f"`{x}`") for x in xs]]
    sums, n = _sums(own, [*terms, F.col(y)], F.lit(1.0))
    inverse = np.linalg.pinv(sums[:-1, :-1])
    coef = inverse @ sums[:-1, -1]
    leverage = sum((t * _dot(terms, inverse[i]) for i, t in enumerate(terms)), F.lit(0.0))
    error = (F.col(y) - _dot(terms, coef)) / F.greatest(F.lit(1.0) - leverage, F.lit(1e-12))
    middle, _ = _sums(own, terms, error * error)
    return Fit(["const", *xs], coef, inverse @ middle @ inverse, n)


def nb_alpha(df: DataFrame, y: str) -> float:
    """Dispersion of counts by their mean and variance; 1 if all are 0."""
    mean, variance = df.agg(F.avg(y), F.var_samp(y)).first()
    return 1.0 if not mean or mean <= 0 else max(((variance if variance is not None else mean) - mean) / mean**2, 1e-8)


def _mean(eta: Column, family: str) -> Column:
    return eta if family == "ols" else 1 / (1 + F.exp(-eta)) if family in ("binomial", "fractional") else F.exp(eta)


def _variance(mu: Column, family: str, alpha: float) -> Column:
    return mu * (1 - mu) if family in ("binomial", "fractional") else mu + alpha * mu * mu if family == "negative_binomial" else mu


def glm(df: DataFrame, y: str, xs: Sequence[str], family: str) -> Fit:
    """Binomial (also of shares), Poisson or negative binomial with the logit or log link, by
    reweighted least squares: one aggregate per step, ``STEPS`` at most, over the complete rows,
    written once. Outcomes that are all alike have no fit: ValueError."""
    own = written(complete(df, [y, *xs]).select(*[f"`{c}`" for c in dict.fromkeys([y, *xs])]), "fitted-rows")
    terms = [F.lit(1.0), *[F.col(f"`{x}`") for x in xs]]
    low, high, mean = own.agg(F.min(y), F.max(y), F.avg(y)).first()
    if low is None or low == high:
        raise ValueError("the outcome must have two different values")
    share = family in ("binomial", "fractional")
    alpha = nb_alpha(own, y) if family == "negative_binomial" else 0.0
    coef = np.zeros(len(terms))
    coef[0] = np.log(mean / (1 - mean)) if share else np.log(mean)
    for _ in range(STEPS):
        eta = F.greatest(F.least(_dot(terms, coef), F.lit(30.0)), F.lit(-30.0))
        mu = _mean(eta, family)
        slope = mu * (1 - mu) if share else mu  # of the mean by the linear part
        weight = slope * slope / _variance(mu, family, alpha)
        sums, n = _sums(own, [*terms, eta + (F.col(y) - mu) / slope], weight)
        inverse = np.linalg.pinv(sums[:-1, :-1])
        last, coef = coef, inverse @ sums[:-1, -1]
        if np.abs(coef - last).max() < CLOSE:
            break
    return Fit(["const", *xs], coef, inverse, n, family, alpha)


def robust(df: DataFrame, fit: Fit, y: str, group: str | None = None) -> Fit:
    """The fit with a covariance that holds without equal variances: each row's error over one
    less its leverage, or, with ``group``, the errors of a group summed first (ten groups at
    least). Rows are those of the fit; groups are summed where they lie."""
    xs = fit.terms[1:]
    own = complete_with(df, [y, *xs], *([F.col(group).alias("__group")] if group else []))
    terms = [F.lit(1.0), *[F.col(f"`{x}`") for x in xs]]
    eta = _dot(terms, fit.coef)
    mu = _mean(eta, fit.family)
    share = fit.family in ("binomial", "fractional")
    slope = F.lit(1.0) if fit.family == "ols" else mu * (1 - mu) if share else mu
    variance = F.lit(1.0) if fit.family == "ols" else _variance(mu, fit.family, fit.alpha)
    bread, n = _sums(own, terms, slope * slope / variance)
    inverse = np.linalg.pinv(bread)
    error = (F.col(y) - mu) * slope / variance
    k = len(terms)
    if group is None:
        leverage = sum((t * _dot(terms, inverse[i]) for i, t in enumerate(terms)), F.lit(0.0)) * slope * slope / variance
        error = error / F.greatest(1 - leverage, F.lit(1e-12))
        middle, _ = _sums(own, terms, error * error)
    else:
        sums = own.groupBy("__group").agg(*[F.sum(t * error).alias(f"s{i}") for i, t in enumerate(terms)])
        middle, groups = _sums(sums, [F.col(f"s{i}") for i in range(k)], F.lit(1.0))
        if groups < 10:
            raise ValueError("fewer than 10 groups")
        middle *= groups / (groups - 1) * (n - 1) / (n - k)
    return Fit(fit.terms, fit.coef, inverse @ middle @ inverse, n, fit.family, fit.alpha)


STARS = [(0.001, "p<0.001"), (0.01, "p<0.01"), (0.05, "p<0.05"), (0.10, "p<0.10")]


def coefficient_table(df: DataFrame, fit: Fit) -> DataFrame:
    """A row per term: coefficient, standard error, z, two-sided p, 95 % interval, how
    significant, and for odds the exponential."""
    rows = []
    for term, c, v in zip(fit.terms, fit.coef, np.diag(fit.covariance), strict=True):
        se = math.sqrt(max(v, 0.0))
        z = float(c) / se if se else None
        p = None if z is None else math.erfc(abs(z) / math.sqrt(2))
        star = "not significant" if p is None else next((s for bound, s in STARS if p <= bound), "not significant")
        rows.append((term, float(c), se, z, p, float(c - 1.959964 * se), float(c + 1.959964 * se), star, float(math.exp(c)) if fit.family in ("binomial", "fractional") else None))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, standard_error double, z double, p_value double, low double, high double, significance string, exp_coefficient double")


def quality(df: DataFrame, fit: Fit, y: str) -> dict[str, float]:
    """Figures of a fit on its rows, by one aggregate: log-likelihood, AIC, BIC, RMSE, MAE, and
    by family R², explained deviance and Pearson dispersion, accuracy."""
    own = complete(df, [y, *fit.terms[1:]])
    terms, c = [F.lit(1.0), *[F.col(f"`{x}`") for x in fit.terms[1:]]], F.col(y)
    mu = _mean(_dot(terms, fit.coef), fit.family)
    n, k, mean = fit.rows, len(fit.terms), own.agg(F.avg(y)).first()[0]
    square, part = F.sum((c - mu) * (c - mu)), lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    out = [square.alias("square"), F.sum(F.abs(c - mu)).alias("absolute"), F.var_pop(c).alias("spread"), F.sum((c - mu) * (c - mu) / _variance(mu, fit.family, fit.alpha)).alias("pearson")]
    share, a = fit.family in ("binomial", "fractional"), fit.alpha
    if fit.family == "ols":
        like, deviance, null = F.lit(0.0), square, F.lit(0.0)
    elif share:
        like = F.sum(c * F.log(mu) + (1 - c) * F.log(1 - mu))
        dev = lambda m: F.sum(2 * (part(c, m) + part(1 - c, 1 - m)))
        deviance, null = dev(mu), dev(F.lit(mean))
    elif fit.family == "poisson":
        like = F.sum(c * F.log(mu) - mu - _log_gamma(c + 1))
        dev = lambda m: F.sum(2 * (part(c, m) - (c - m)))
        deviance, null = dev(mu), dev(F.lit(mean))
    else:
        like = F.sum(_log_gamma(c + 1 / a) - _log_gamma(F.lit(1 / a)) - _log_gamma(c + 1) + c * F.log(a * mu / (1 + a * mu)) - F.log(1 + a * mu) / a)
        dev = lambda m: F.sum(2 * (part(c, m) - (c + 1 / a) * F.log((1 + a * c) / (1 + a * m))))
        deviance, null = dev(mu), dev(F.lit(mean))
    row = own.agg(*out, like.alias("like"), deviance.alias("deviance"), null.alias("null"), F.avg(((mu >= 0.5).cast("double") == c).cast("double")).alias("right")).first()
    like_ = -n / 2 * (math.log(2 * math.pi * row["square"] / n) + 1) if fit.family == "ols" else row["like"]
    found = {"observations": n, "estimated_parameters": k, "log_likelihood": like_, "AIC": 2 * k - 2 * like_, "BIC": k * math.log(n) - 2 * like_, "RMSE": math.sqrt(row["square"] / n), "MAE": row["absolute"] / n}
    if fit.family == "ols":
        r2 = 1 - row["square"] / (row["spread"] * n)
        return found | {"R_squared": r2, "adjusted_R_squared": 1 - (1 - r2) * (n - 1) / (n - k)}
    found |= {"explained_deviance": 1 - row["deviance"] / row["null"] if row["null"] > 0 else math.nan, "pearson_dispersion": row["pearson"] / (n - k)}
    return found | ({"accuracy": row["right"]} if fit.family == "binomial" else {})


def _log_gamma(x: Column) -> Column:
    """Stirling's series, after the argument is raised by eight."""
    raised, low = x + 8, F.lit(0.0)
    for j in range(8):
        low = low + F.log(x + j)
    return (raised - 0.5) * F.log(raised) - raised + 0.5 * math.log(2 * math.pi) + 1 / (12 * raised) - 1 / (360 * raised * raised * raised) + 1 / (1260 * F.pow(raised, F.lit(5))) - low


def adjusted_regression(df: DataFrame, least: int = 10, y: str = "D3_f1", x: str = "I5_alignment_complexity", others: Sequence[str] = ("I1_pattern_continuity", "I2_local_contrast", "I3_boundary_sharpness"), effects: Sequence[str] = ("dataset", "model_name"), space: str = "I5_measurement_space") -> dict:
    """Least squares of ``y`` by ``x`` and ``others`` (0 where missing) with a column for each
    level of ``effects`` but the first, over the rows of the commonest measurement space. An
    association; ``available`` is False, with a reason, under ``max(3 * least, 30)`` rows."""
    needed = max(3 * least, 30)
    rows = df.select(E.finite(F.col(y)).alias("y"), E.finite(F.col(x)).alias(x), *[F.coalesce(E.finite(F.col(o)), F.lit(0.0)).alias(o) for o in others], *[F.coalesce(F.col(e).cast("string"), F.lit("None")).alias(e) for e in effects], F.coalesce(F.col(space).cast("string"), F.lit("None")).alias("space"))
    rows = rows.where(f"y is not null and `{x}` is not null")
    spaces = {r[0]: r[1] for r in rows.groupBy("space").count().orderBy(F.desc("count"), "space").limit(LEVELS).collect()}  # kinds of space are few
    n = sum(spaces.values())
    if n < needed:
        return {"available": False, "n": n, "reason": f"insufficient_samples_n_lt_{needed}"}
    main = next(iter(spaces))
    if spaces[main] < needed:
        return {"available": False, "n": spaces[main], "reason": "insufficient_same_measurement_space_samples", "measurement_space": main}
    own = rows.where(F.col("space") == main)
    names, terms = ["intercept", x, *others], [F.lit(1.0), F.col(x), *[F.col(o) for o in others]]
    for e in effects:
        levels = sorted(r[0] for r in own.select(e).distinct().limit(LEVELS + 1).collect())
        if len(levels) > LEVELS:
            raise ValueError(f"{e} has over {LEVELS} levels")
        names += [f"{e}__{v}" for v in levels[1:]]
        terms += [(F.col(e) == v).cast("double") for v in levels[1:]]
    if spaces[main] <= len(terms):
        return {"available": False, "n": spaces[main], "reason": "insufficient_degrees_of_freedom_for_fixed_effects"}
    sums, n = _sums(own, [*terms, F.col("y")], F.lit(1.0))
    coef = np.linalg.lstsq(sums[:-1, :-1], sums[:-1, -1], rcond=None)[0]
    total = sums[-1, -1] - sums[0, -1] ** 2 / n
    left = sums[-1, -1] - coef @ sums[:-1, -1]
    return {"available": True, "n": n, "measurement_space": main, "excluded": sum(spaces.values()) - n, "coefficients": dict(zip(names, map(float, coef), strict=True)), "r_squared": float(1 - left / total) if total > 1e-8 else None}


def explore(df: DataFrame, y: str, xs: Sequence[str], categorical: Sequence[str] = (), treatment: str = "numeric", value: object = None, family: str | None = None, group: str | None = None, derived: Sequence[Mapping] = (), standardise: bool = False, folds: int = 5) -> dict:
    """From a table to a model: derived columns, the outcome, the family that it suggests if
    none is given, the design, the fit with a robust covariance, its figures, inflation and
    cross-validation by folds of whole groups, or by balanced ones (of each class if the outcome
    has two). Tables are DataFrames."""
    own, errors = derive(df, derived)
    own = own.withColumn("__y", outcome(F.col(y), treatment, value))
    family = family or recommend(own, {"__y": F.col("__y")}).first()[0]
    if family is None:
        raise ValueError("no family suits the outcome")
    d = design(own, "__y", xs, categorical, group, standardise)
    validate(d.df, "__y", family)
    fit = robust(d.df, ols(d.df, "__y", d.xs) if family == "ols" else glm(d.df, "__y", d.xs, family), "__y", "__group" if group else None)
    dealt = grouped(d.df, folds, "__group") if group else balanced(d.df, folds, d.df.columns, "__y" if family == "binomial" else None)
    return {
        "family": family, "notes": d.notes, "errors": errors, "fit": fit, "coefficients": coefficient_table(d.df, fit), "statistics": quality(d.df, fit, "__y"),
        "inflation": vif(d.df, d.xs), "cross_validation": cross_validate(dealt, "__y", d.xs, F.col("fold"), family), "design": d.df,
    }


def write_results(found: dict, path: str, configuration: Mapping) -> None:
    """What ``explore`` gives, a folder of tables: coefficients, statistics, inflation,
    cross_validation, design, configuration."""
    for name in ("coefficients", "inflation", "cross_validation", "design"):
        found[name].write.mode("overwrite").parquet(f"{path}/{name}")
    spark = found["design"].sparkSession
    for name, values in (("statistics", found["statistics"]), ("configuration", {k: str(v) for k, v in configuration.items()})):
        spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def coefficients(df: DataFrame, fit: Fit) -> DataFrame:
    """A row per term: coefficient, standard error, z, 95 % interval."""
    se = np.sqrt(np.maximum(np.diag(fit.covariance), 0))
    rows = [(t, float(c), float(s), float(c / s) if s else None, float(c - 1.959964 * s), float(c + 1.959964 * s)) for t, c, s in zip(fit.terms, fit.coef, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, low double, high double")


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Inflation of each predictor by the others, without a constant and not centred."""
    sums, _ = _sums(complete(df, xs), [F.col(f"`{x}`") for x in xs], F.lit(1.0))
    value = np.diag(sums) * np.diag(np.linalg.pinv(sums))
    return df.sparkSession.createDataFrame([(x, float(v)) for x, v in zip(xs, value, strict=True)], "term string, vif double")


def fit_statistics(y: Column, p: Column) -> list[Column]:
    """Aggregates of a prediction ``p``."""
    error = F.sum((y - p) * (y - p))
    return [F.sqrt(error / F.count(y)).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (1 - F.try_divide(error, F.var_pop(y) * F.count(y))).alias("r2")]


def auc(df: DataFrame, y: str, p: str, bins: int = 1024) -> DataFrame:
    """Area under the curve, ties by half. Rows are summed by score; running sums are taken
    inside ``bins`` of the scores from 0 to 1 and over the bins, so no task orders all."""
    by = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("one"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("zero"))
    by = by.withColumn("bin", F.floor(F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0)) * bins))
    over = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = F.broadcast(by.groupBy("bin").agg(F.sum("zero").alias("z")).select("bin", F.coalesce(F.sum("z").over(over), F.lit(0)).alias("below")))  # a row per bin
    inside = Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    won = by.join(below, "bin").withColumn("less", F.col("below") + F.coalesce(F.sum("zero").over(inside), F.lit(0)))
    return won.agg(F.try_divide(F.sum(F.col("one") * (F.col("less") + F.col("zero") / 2)), F.sum("one").cast("double") * F.sum("zero")).alias("auc"))


def cross_validate(df: DataFrame, y: str, xs: Sequence[str], fold: Column, family: str = "ols") -> DataFrame:
    """Rows ``fold, n, rmse, mae`` of predictions by fits on the other folds. ``fold`` is
    an expression of the row: of a group's key, and no group is cut. Least squares take the
    sums of all folds in one pass, as a fold's fit needs the whole less its own; other
    families are fitted fold by fold. There should be few folds: each is a number in the
    plan. Rows of a null fold, or not complete in ``y`` and ``xs``, are left out."""
    own = complete_with(df, [y, *xs], fold.cast("int").alias("fold")).where("fold is not null")
    terms = [F.lit(1.0), *[F.col(f"`{x}`") for x in xs]]
    columns = [*terms, F.col(y)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    coefs: dict[int, np.ndarray] = {}
    if family == "ols":
        sums = {}
        for row in own.groupBy("fold").agg(*[F.sum(columns[i] * columns[j]) for i, j in pairs]).collect():  # a row per fold
            m = sums[row[0]] = np.zeros((len(columns), len(columns)))
            for (i, j), v in zip(pairs, row[1:], strict=True):
                m[i, j] = m[j, i] = v
        whole = sum(sums.values())
        for k, m in sums.items():
            rest = whole - m
            coefs[k] = np.linalg.pinv(rest[:-1, :-1]) @ rest[:-1, -1]
    else:
        for (k,) in own.select("fold").distinct().collect():
            coefs[k] = glm(own.where(F.col("fold") != k), y, xs, family).coef
    guess = F.lit(None).cast("double")
    for k, c in coefs.items():
        eta = _dot(terms, c)
        guess = F.when(F.col("fold") == k, _mean(eta, family)).otherwise(guess)
    scored = own.withColumn("p", guess)
    return scored.groupBy("fold").agg(F.count("*").alias("n"), *fit_statistics(F.col(y), F.col("p"))[:2])
