"""Maximum-likelihood fits of the GEV, one per group, by grouped functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tailcast.functions import gev
from tailcast.functions.statistics import cramer_von_mises_p, gev_nll, ks_one_sample_p, lmoments_start, minimise
from tailcast.operators import extremes
from tailcast.operators.newton import fit_by_sums

# Names of first guesses.
STARTS = ("LMM", "scipy_fitstart", "scipy", "scipy_subset", "xclim_fitstart", "xclim", "moments", "LMM_subset")
TESTS = ("lrt", "aic", "aicc", "bic")
PARAMETERS = {True: ("c", "location", "scale"), False: ("c", "location_0", "location_1", "scale_0", "scale_1")}


def start_of(x: np.ndarray, kind: str) -> np.ndarray:
    """First guesses [b, 3] for complete samples [b, n]."""
    if kind == "LMM":
        return lmoments_start(x)
    if kind == "LMM_subset":
        return lmoments_start(x[:, ::2])
    if kind == "moments":
        scale = np.maximum(x.std(1) * math.sqrt(6) / math.pi, 1e-6)
        return np.column_stack([np.full(len(x), 1e-3), x.mean(1) - 0.5772 * scale, scale])
    if kind == "xclim_fitstart":
        scale = np.maximum(np.sqrt(6 * x.var(1)) / math.pi, 1e-6)
        return np.column_stack([np.full(len(x), 0.1), x.mean(1) - 0.57722 * scale, scale])
    if kind == "scipy_fitstart":
        # a shape by the sign of the skewness, then location and scale that give mean and variance
        centred = x - x.mean(1, keepdims=True)
        c = np.where((centred**3).mean(1) < 0, 0.5, -0.5)
        # of the standard distribution: gamma(1.5), 1 - gamma(1.5)**2 over c**2; at -0.5 the variance is infinite
        mean = np.where(c > 0, (1 - 0.886226925) / 0.5, (1 - 1.772453851) / -0.5)
        spread = np.where(c > 0, math.sqrt(1 - 0.886226925**2) / 0.5, 2.5)
        scale = np.maximum(x.std(1) / spread, 1e-6)
        return np.column_stack([c, x.mean(1) - scale * mean, scale])
    if kind in ("scipy", "scipy_subset", "xclim"):
        part = x[:, ::2] if kind == "scipy_subset" else x
        return fit_samples(part, start_of(part, "xclim_fitstart" if kind == "xclim" else "scipy_fitstart"))[0]
    raise ValueError(f"unknown start {kind}")


def fit_samples(x: np.ndarray, start: np.ndarray, fixed: dict[int, float] | None = None, passes: int = 2, bounds: dict[int, tuple[float, float]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stationary fits of samples [b, n] at once; ``fixed`` pins parameters by position, ``bounds``
    holds them within (low, high)."""
    x = np.atleast_2d(x)
    centre, width = x.mean(1, keepdims=True), np.maximum(x.std(1, keepdims=True), 1e-12)
    y = (x - centre) / width

    def pinned(t: np.ndarray, at: np.ndarray) -> np.ndarray:
        t = t.copy()
        for k, v in (fixed or {}).items():
            t[:, k] = v if k == 0 else (v - centre[at, 0]) / width[at, 0] if k == 1 else v / width[at, 0]
        for k, (lo, hi) in (bounds or {}).items():
            ends = [np.full(len(t), v) if k == 0 else (v - centre[at, 0]) / width[at, 0] if k == 1 else v / width[at, 0] for v in (lo, hi)]
            t[:, k] = np.clip(t[:, k], *ends)
        return t

    every = np.arange(len(x))
    best = pinned(np.column_stack([start[:, 0], (start[:, 1] - centre[:, 0]) / width[:, 0], start[:, 2] / width[:, 0]]), every)
    steps = np.tile([0.1, 0.2, 0.2], (len(x), 1))
    for k in range(passes):
        best, _ = minimise(lambda t, at: gev_nll(pinned(t, at), y[at]), best, steps / 4**k)
        best = pinned(best, every)
    theta = np.column_stack([best[:, 0], best[:, 1] * width[:, 0] + centre[:, 0], best[:, 2] * width[:, 0]])
    return theta, gev_nll(theta, x)


def fit_trend(
    x: np.ndarray, covariate: np.ndarray, start: np.ndarray, trends: tuple[bool, bool] = (True, True), basin_hops: int = 0, seed: int = 0, slopes: tuple[float | None, float | None] = (None, None),
    bounds: dict[int, tuple[float, float]] | None = None, temperature: float = 1.0, step: float = 0.5,
) -> tuple[np.ndarray, float]:
    """Five parameters of one sample; the covariate is standardised inside. ``trends`` frees
    location_1 and scale_1, ``slopes`` are their first guesses (else the line's slope and 0). ``bounds`` holds
    parameters, by position, within (low, high): what leaves them is moved to the nearest end before it is judged, so that the
    simplex slides along. With ``basin_hops`` a Metropolis chain goes from minimum to minimum (``hop``)."""
    mid, spread = covariate.mean(), max(covariate.std(), 1e-12)
    z = (covariate - mid) / spread
    free = np.array([1, 1, trends[0], 1, trends[1]], dtype=float)

    def own(t: np.ndarray) -> np.ndarray:
        """Parameters by the covariate itself."""
        return np.column_stack([t[:, 0], t[:, 1] - t[:, 2] * mid / spread, t[:, 2] / spread, t[:, 3] - t[:, 4] * mid / spread, t[:, 4] / spread])

    def held(t: np.ndarray) -> np.ndarray:
        if not bounds:
            return t * free
        theta = own(t * free)
        for k, (lo, hi) in bounds.items():
            theta[:, k] = np.clip(theta[:, k], lo, hi)
        return np.column_stack([theta[:, 0], theta[:, 1] + theta[:, 2] * mid, theta[:, 2] * spread, theta[:, 3] + theta[:, 4] * mid, theta[:, 4] * spread])

    def f(t: np.ndarray, at: np.ndarray) -> np.ndarray:
        t = held(t)
        return gev_nll(t, np.repeat(x[None], len(t), 0), np.repeat(z[None], len(t), 0)) + 1e10 * (t[:, 3] < 1e-6)

    def minimum(tries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = size
        for _ in range(3):
            tries, value = minimise(f, held(tries), np.tile(width, (len(tries), 1)))
            width = width / 3
        return held(tries), value

    slope = (np.polyfit(z, x, 1)[0] if slopes[0] is None else slopes[0] * spread) if trends[0] else 0.0
    base = np.array([start[0], start[1], slope, start[2], (slopes[1] or 0.0) * spread])
    size = np.array([0.1, 0.2 * start[2], 0.2 * start[2], 0.2 * start[2], 0.1 * start[2]])
    ends, value = minimum(base + np.vstack([np.zeros(5), [0, 0, -slope, 0, 0]]))
    t = ends[value.argmin()]
    if basin_hops:
        unit = np.array([1.0, start[2], start[2], start[2], start[2]]) * free
        t = hop(minimum, t, float(value.min()), unit, basin_hops, temperature, step, np.random.default_rng(seed))
    theta = own(t[None])
    return theta[0], float(gev_nll(theta, x[None], covariate[None])[0])


def hop(minimum: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], at: np.ndarray, value: float, unit: np.ndarray, hops: int, temperature: float, step: float, rng: np.random.Generator, every: int = 10, wanted: float = 0.5) -> np.ndarray:
    """Basin hopping: from the current minimum each parameter moves by up to ``step`` of its ``unit``, and the minimum reached
    from there is taken if it is lower, or else with probability exp(-rise / ``temperature``). ``every`` so many hops the
    step grows or shrinks by a tenth, as more or fewer than the ``wanted`` share were taken. The lowest minimum counts."""
    best, lowest, taken = at, value, 0
    for n in range(1, hops + 1):
        ends, values = minimum((at + step * unit * rng.uniform(-1, 1, len(at)))[None])
        if values[0] <= value or rng.random() < np.exp(-(values[0] - value) / max(temperature, 1e-300)):
            at, value, taken = ends[0], float(values[0]), taken + 1
            if value < lowest:
                best, lowest = at, value
        if n % every == 0:
            step *= 1 / 0.9 if taken > wanted * every else 0.9
            taken = 0
    return best


def goodness(x: np.ndarray, theta: np.ndarray, covariate: np.ndarray | None, test: str) -> float:
    """p-value of the fitted distribution: ``ks`` or ``cvm``."""
    if len(theta) == 5:
        loc, scale = theta[1] + theta[2] * covariate, theta[3] + theta[4] * covariate
    else:
        loc, scale = theta[1], theta[2]
    with np.errstate(all="ignore"):
        z = (x - loc) / scale
        u = np.exp(-np.exp(-z)) if abs(theta[0]) < 1e-9 else np.exp(-np.maximum(1 - theta[0] * z, 0) ** (1 / theta[0]))
    u, n = np.sort(u), len(x)
    k = np.arange(1, n + 1)
    if test == "ks":
        return ks_one_sample_p(max((k / n - u).max(), (u - (k - 1) / n).max()), n)
    if test == "cvm":
        return cramer_von_mises_p(1 / (12 * n) + ((u - (2 * k - 1) / (2 * n)) ** 2).sum())
    raise ValueError(f"unknown test {test}")


def prefers_trend(test: str, nll3: float, nll5: float, n: int, extra: int, alpha: float) -> bool:
    """Whether the model with a trend is the better."""
    k3, k5 = 3, 3 + extra
    if test == "lrt":
        gain = max(2 * (nll3 - nll5), 0.0)
        return (math.exp(-gain / 2) if extra == 2 else math.erfc(math.sqrt(gain / 2))) <= alpha
    cost = {"aic": lambda k: 2 * k, "aicc": lambda k: 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1e-9), "bic": lambda k: k * math.log(n)}
    if test not in cost:
        raise ValueError(f"unknown test {test}")
    return cost[test](k5) + 2 * nll5 < cost[test](k3) + 2 * nll3


def fit_gev(
    df: DataFrame,
    by: Sequence[str],
    value: str = "value",
    stationary: bool = True,
    covariate: str | None = None,
    start: str = "LMM",
    location_trend: bool = True,
    scale_trend: bool = True,
    fixed: dict[str, float] | None = None,
    retry: bool = False,
    assert_good_fit: bool = False,
    test: str = "ks",
    pick_best_model: str | None = None,
    alpha: float = 0.05,
    basin_hops: int = 0,
    bounds: dict[str, tuple[float, float]] | None = None,
    loc1: float | None = None,
    scale1: float | None = None,
    goodness_alpha: float | None = None,
    temperature: float = 1.0,
    hop_step: float = 0.5,
) -> DataFrame:
    """(by..., n, parameters..., nllf, pvalue): a fit for each group of ``by`` (one shuffle).

    Missing values are left out; groups of under four values or of one value only have
    missing parameters. ``retry`` also starts elsewhere and keeps the better end.
    ``assert_good_fit`` makes parameters missing where the p-value is at most ``goodness_alpha`` (``alpha``
    without). ``bounds`` of c, location and scale hold for the stationary fit, also as the start of one
    with trends, those of c, location_0, location_1, scale_0 and scale_1 for the latter; ``loc1`` and ``scale1`` are the first
    guesses of the trends. ``basin_hops`` hops at ``temperature``, of up to ``hop_step`` scales, look for lower minima.
    ``pick_best_model`` (lrt, aic, aicc, bic) sets trends to 0 where they don't pay.
    """
    if stationary and pick_best_model:
        raise ValueError("a stationary fit has no models to pick from")
    if not stationary and not covariate:
        raise ValueError("a fit with trends needs a covariate")
    if start not in STARTS or (pick_best_model and pick_best_model not in TESTS):
        raise ValueError("unknown start or test")
    names = PARAMETERS[stationary]
    pins = {("c", "location", "scale").index(k): v for k, v in (fixed or {}).items()}
    unknown = set(bounds or {}) - {*PARAMETERS[True], *names}
    if unknown:
        raise ValueError(f"no parameters of that name: {sorted(unknown)}")
    limits = {PARAMETERS[True].index(k): v for k, v in (bounds or {}).items() if k in PARAMETERS[True]}
    trend_limits = {names.index(k): v for k, v in (bounds or {}).items() if k in names} if not stationary else {}
    keys = list(by)

    def one(x: np.ndarray, cov: np.ndarray | None) -> tuple[np.ndarray, float, float]:
        missing = np.full(len(names), np.nan), math.nan, math.nan
        if len(x) < 4 or np.ptp(x) == 0:
            return missing
        theta, nll = fit_samples(x[None], start_of(x[None], start), pins, bounds=limits)
        if retry:
            other, other_nll = fit_samples(x[None], start_of(x[None], "moments" if start != "moments" else "LMM"), pins, bounds=limits)
            if other_nll[0] < nll[0]:
                theta, nll = other, other_nll
        theta, nll = theta[0], float(nll[0])
        if not stationary:
            five, nll5 = fit_trend(x, cov, theta, (location_trend, scale_trend), basin_hops, slopes=(loc1, scale1), bounds=trend_limits, temperature=temperature, step=hop_step)
            flat = np.array([theta[0], theta[1], 0.0, theta[2], 0.0])
            within = all(lo <= flat[k] <= hi for k, (lo, hi) in trend_limits.items())
            if within and (nll5 > nll or (pick_best_model and not prefers_trend(pick_best_model, nll, nll5, len(x), location_trend + scale_trend, alpha))):
                theta = flat
            else:
                theta, nll = five, nll5
        p = goodness(x, theta, cov, test)
        if assert_good_fit and p <= (alpha if goodness_alpha is None else goodness_alpha):
            return np.full(len(names), np.nan), nll, p
        return theta, nll, p

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf["_x"].notna() & np.isfinite(pdf["_x"])
        if covariate:
            good &= pdf["_cov"].notna()
        x = pdf.loc[good, "_x"].to_numpy(float)
        cov = pdf.loc[good, "_cov"].to_numpy(float) if covariate else None
        order = np.lexsort((cov, x)) if covariate else np.argsort(x)
        theta, nll, p = one(x[order], cov[order] if covariate else None)
        row = {k: pdf[k].iloc[0] for k in keys} | {"n": len(x)} | dict(zip(names, theta, strict=True)) | {"nllf": nll, "pvalue": p}
        return pd.DataFrame([row])

    columns = [*keys, F.col(value).cast("double").alias("_x")] + ([F.col(covariate).cast("double").alias("_cov")] if covariate else [])
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["n long"] + [f"{p} double" for p in names] + ["nllf double", "pvalue double"])
    out = df.select(*columns).groupBy(*keys).applyInPandas(fit, schema)
    return out.select(*keys, "n", *[F.nanvl(c, F.lit(None)).alias(c) for c in (*names, "nllf", "pvalue")])


def check_gev_fit(df: DataFrame, params: DataFrame, by: Sequence[str], value: str = "value", test: str = "ks", covariate: str | None = None) -> DataFrame:
    """(by..., n, statistic, pvalue): whether values are draws of given distributions (``params``: by...,
    and the three parameters, or the five and a ``covariate`` column of ``df``), by Kolmogorov
    and Smirnov (``ks``) or Cramer and von Mises (``cvm``). Ranks in ranges, one row a group for the p-value.
    """
    if test not in ("ks", "cvm"):
        raise ValueError(f"unknown test {test}")
    names = PARAMETERS[covariate is None]
    joined = df.where(F.col(value).isNotNull()).join(params.select(*by, *names), list(by))
    at = gev.at_covariate({k: F.col(k) for k in names}, F.col(covariate) if covariate else None)
    ranks = gev.distinct_ranks(joined.select(*by, gev.cdf(F.col(value).cast("double"), *at).alias("_u")), "_u", list(by))
    u, m, k, n = F.col("_x"), F.col("_m").cast("double"), F.col("_before").cast("double"), F.col("_n").cast("double")
    if test == "ks":
        made = F.max(F.greatest((k + m) / n - u, u - k / n))
    else:  # the sum of squares of u - (2 j - 1) / 2 n over ranks j = k + 1 .. k + m, about their mean
        made = 1 / (12 * F.max(n)) + F.sum(m * F.pow(u - (2 * k + m) / (2 * n), 2) + m * (m * m - 1) / (12 * n * n))
    found = ranks.groupBy(*by).agg(F.max("_n").alias("n"), made.alias("statistic"))
    return found.select(*by, "n", "statistic", (_ks_p if test == "ks" else _cvm_p)("statistic", "n").alias("pvalue"))


@F.pandas_udf(DoubleType())
def _ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([ks_one_sample_p(x, int(m)) for x, m in zip(d, n, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _cvm_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([cramer_von_mises_p(x) for x in t], dtype=float)


def check_gev_relative_fit(fits: DataFrame, by: Sequence[str], test: str = "lrt", alpha: float = 0.05, extra: int = 2) -> DataFrame:
    """(by..., prefers_trend): whether the model with ``extra`` trends is the better, of (by..., n, nllf_stationary,
    nllf_trend): by the likelihood ratio at level ``alpha``, or the smaller criterion."""
    if test not in TESTS:
        raise ValueError(f"unknown test {test}")
    n, one, other = F.col("n"), F.col("nllf_stationary"), F.col("nllf_trend")
    if test == "lrt":
        better = extremes.likelihood_ratio_p(one, other, extra) <= alpha
    else:
        better = extremes.information_criteria(n, 3 + extra, other)[test] < extremes.information_criteria(n, 3, one)[test]
    return fits.select(*by, better.alias("prefers_trend"))


def bootstrap_fits(df: DataFrame, by: Sequence[str], value: str = "value", n_resamples: int = 1000, parametric: bool = False, max_shape_ratio: float | None = None, seed: int = 0, part: int = 50) -> DataFrame:
    """(by..., k, c, location, scale): fits of the sample (k = -1) and of bootstrap samples, of
    its values or drawn from its fit.

    A group's sorted values are one row, sent with the number of its part: ``part``
    replicates are a task's work and are fitted together, from the sample's own parameters.
    Replicates whose shape is more than ``max_shape_ratio`` times the sample's are left out.
    """
    keys = list(by)
    typed = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    samples = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_x")).where(F.size("_x") >= 4)
    parts = samples.withColumn("_k", F.explode(F.sequence(F.lit(-1), F.lit((n_resamples - 1) // part)))).repartition(*keys, "_k")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, k = np.asarray(row[len(keys)], dtype=float), row[len(keys) + 1]
                whole, _ = fit_samples(x[None], lmoments_start(x[None]))
                theta, number = whole, np.array([-1])
                if k >= 0:
                    rng = np.random.default_rng([seed, k])
                    b = min(part, n_resamples - k * part)
                    u = rng.random((b, len(x)))
                    draws = quantile(whole, u) if parametric else x[(u * len(x)).astype(int)]
                    theta, _ = fit_samples(draws, np.repeat(whole, b, 0), passes=1)
                    number = k * part + np.arange(b)
                    if max_shape_ratio:
                        good = np.abs(theta[:, 0]) <= max_shape_ratio * abs(whole[0, 0])
                        theta, number = theta[good], number[good]
                out = pd.DataFrame({"k": number, "c": theta[:, 0], "location": theta[:, 1], "scale": theta[:, 2]})
                for name, v in zip(keys, row, strict=False):
                    out[name] = [v] * len(out)
                yield out[[*keys, "k", "c", "location", "scale"]]

    return parts.mapInPandas(run, ", ".join([*typed, "k int, c double, location double, scale double"]))


def _interval(fits: DataFrame, keys: list[str], made: Column, name: str, level: float) -> DataFrame:
    """The sample's own value and the percentiles of the replicates' finite ones."""
    tail, own = (1 - level) / 2, F.col("k") < 0
    drawn = F.when(~own & (F.abs(made) < float("inf")), made)
    return fits.groupBy(*keys).agg(F.max(F.when(own, made)).alias(name), F.percentile(drawn, tail).alias("ci_lower"), F.percentile(drawn, 1 - tail).alias("ci_upper"))


def _replicated(df: DataFrame, by: Sequence[str], value: str, covariate: str | None, row: Sequence[str] | None, n_resamples: int, parametric: bool, max_shape_ratio: float | None, seed: int, by_sums: bool) -> DataFrame:
    """(by..., k, parameters...): the fit of each group (k = -1) and of its bootstrap samples."""
    if not covariate and not by_sums:
        return bootstrap_fits(df, by, value, n_resamples, parametric, max_shape_ratio, seed)
    if parametric:
        raise ValueError("parametric bootstraps are of fits without trends, a task for each part of a group")
    fits = fit_by_sums(df, by, value, covariate, n_resamples=n_resamples, row=row, seed=seed)
    if not max_shape_ratio:
        return fits
    own = F.max(F.when(F.col("k") < 0, F.abs("c"))).over(Window.partitionBy(*by))
    return fits.withColumn("_own", own).where((F.col("k") < 0) | (F.abs("c") <= max_shape_ratio * F.col("_own"))).drop("_own")


def fit_confidence(
    df: DataFrame, by: Sequence[str], value: str = "value", periods: Sequence[float] = (10, 50, 100, 500), level: float = 0.95,
    covariate: str | None = None, at: Sequence[float] = (), row: Sequence[str] | None = None, n_resamples: int = 1000, parametric: bool = False, max_shape_ratio: float | None = None, seed: int = 0, by_sums: bool = False,
) -> DataFrame:
    """(by..., return_period, return_level, ci_lower, ci_upper): levels of each group's fit and the percentiles of those of its
    bootstrap samples, which are fitted again.

    With a ``covariate`` fits have trends, values and covariates are drawn together, and levels are those
    ``at`` chosen covariates (a column of its name). Then, or if asked for ``by_sums`` for large groups, samples are counts of
    rows (``newton.fit_by_sums``), told apart by ``row``; ``parametric`` ones are drawn from the group's fit. Replicates whose shape is more
    than ``max_shape_ratio`` times the group's are left out.
    """
    if covariate and not at:
        raise ValueError("levels of a fit with trends need covariates to hold at")
    each = _replicated(df, by, value, covariate, row, n_resamples, parametric, max_shape_ratio, seed, by_sums)
    each, keys = each.withColumn("return_period", F.explode(F.array(*[F.lit(float(t)) for t in periods]))), [*by, "return_period"]
    if covariate:
        each, keys = each.withColumn(covariate, F.explode(F.array(*[F.lit(float(x)) for x in at]))), [*by, covariate, "return_period"]
    made = gev.return_level(F.col("return_period"), *_parameters(covariate))
    return _interval(each, keys, made, "return_level", level)


def _parameters(covariate: str | None) -> tuple[Column, Column, Column]:
    return gev.at_covariate({k: F.col(k) for k in PARAMETERS[covariate is None]}, F.col(covariate) if covariate else None)


def event_confidence(
    df: DataFrame, by: Sequence[str], event: float, value: str = "value", level: float = 0.95,
    covariate: str | None = None, at: Sequence[float] = (), row: Sequence[str] | None = None, n_resamples: int = 1000, parametric: bool = False, max_shape_ratio: float | None = None, seed: int = 0, by_sums: bool = False,
) -> DataFrame:
    """(by..., return_period, ci_lower, ci_upper) of an event, as ``fit_confidence`` has levels."""
    if covariate and not at:
        raise ValueError("periods of a fit with trends need covariates to hold at")
    each, keys = _replicated(df, by, value, covariate, row, n_resamples, parametric, max_shape_ratio, seed, by_sums), list(by)
    if covariate:
        each, keys = each.withColumn(covariate, F.explode(F.array(*[F.lit(float(x)) for x in at]))), [*by, covariate]
    return _interval(each, keys, gev.return_period(F.lit(float(event)), *_parameters(covariate)), "return_period", level)


def quantile(theta: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Values not exceeded with probability ``p`` [b, m] under [b, 3]."""
    c, loc, scale = theta[:, :1], theta[:, 1:2], theta[:, 2:3]
    y = -np.log(np.clip(p, 1e-300, 1 - 1e-16))
    flat = np.abs(c) < 1e-9
    return np.where(flat, loc - scale * np.log(y), loc + scale * (1 - y**c) / np.where(flat, 1.0, c))
