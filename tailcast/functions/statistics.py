"""p-values and fits on numpy arrays, for use inside grouped functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

from tailcast.functions.gev import PENALTY

#: Two-sample Kolmogorov-Smirnov p-values are exact up to this sample size.
EXACT_KS = 10_000

# Critical values of the k = 2 Anderson-Darling statistic and their levels.
AD_CRITICAL = (0.325, 1.226, 1.961, 2.718, 3.752, 4.592, 6.546)
AD_LEVELS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)


def kolmogorov_sf(x: float) -> float:
    """Tail of the Kolmogorov distribution."""
    if x <= 0:
        return 1.0
    k = np.arange(1, 101)
    if x < 1.18:
        y = np.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x))
        return float(1 - math.sqrt(2 * math.pi) / x * y.sum())
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum())))


def ks_two_sample_p(d: float, n1: int, n2: int) -> float:
    """Exact (lattice paths that stay within the distance) up to EXACT_KS, else asymptotic."""
    m, n = sorted((n1, n2))
    if m == 0:
        return math.nan
    if n > EXACT_KS:
        return kolmogorov_sf(d * math.sqrt(m * n / (m + n)))
    q = (0.5 + math.floor(d * m * n - 1e-7)) / (m * n)
    j = np.arange(n + 1)
    u = (j / n <= q).astype(float)
    for i in range(1, m + 1):
        inside = np.abs(i / m - j / n) <= q
        u = np.where(inside, np.cumsum(np.where(inside, u * (i / (i + n)), 0.0)), 0.0)
    return float(min(1.0, max(0.0, 1 - u[n])))


def ks_one_sample_p(d: float, n: int) -> float:
    """Stephens's form of the asymptotic p-value."""
    return kolmogorov_sf(d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)))


def cramer_von_mises_p(w: float) -> float:
    """Tail of the limiting distribution, a weighted sum of squared normals, by numerical
    inversion of its characteristic function."""
    weights = 1 / (np.arange(1, 201) * math.pi) ** 2
    u = np.linspace(1e-6, 400, 40_001)
    angle = 0.5 * np.arctan(weights[:, None] * u).sum(0) - 0.5 * w * u
    size = np.exp(0.25 * np.log1p((weights[:, None] * u) ** 2).sum(0))
    y = np.sin(angle) / (u * size)
    return float(min(1.0, max(0.0, 0.5 + ((y[1:] + y[:-1]) / 2 * np.diff(u)).sum() / math.pi)))


def anderson_darling_p(statistic: float) -> float:
    """By a quadratic of the log level in the critical values; within [0.001, 0.25]."""
    if not AD_CRITICAL[0] < statistic < AD_CRITICAL[-1]:
        return AD_LEVELS[0] if statistic <= AD_CRITICAL[0] else AD_LEVELS[-1]
    fit = np.polyfit(AD_CRITICAL, np.log(AD_LEVELS), 2)
    return float(min(AD_LEVELS[0], max(AD_LEVELS[-1], math.exp(np.polyval(fit, statistic)))))


def ad_sigma(n1: int, n2: int) -> float:
    """Standard deviation of the k = 2 Anderson-Darling statistic (Scholz and Stephens)."""
    n, k = n1 + n2, 2
    inverse = 1 / np.arange(1, n)
    big_h, h = 1 / n1 + 1 / n2, inverse.sum()
    tail = np.cumsum(inverse[::-1])[::-1]
    g = (tail[1:] / (n - np.arange(1, n - 1))).sum()
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * big_h
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * big_h - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * big_h + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    return math.sqrt((a * n**3 + b * n**2 + c * n + d) / ((n - 1) * (n - 2) * (n - 3)))


def gev_nll(theta: np.ndarray, x: np.ndarray, covariate: np.ndarray | None = None) -> np.ndarray:
    """Negative log-likelihoods of samples [b, n] (NaN: missing) under parameters [b, 3]
    (c, location, scale), or [b, 5] with a covariate [b, n]."""
    c = theta[:, :1]
    if theta.shape[1] == 3:
        loc, scale = theta[:, 1:2], theta[:, 2:3]
    else:
        loc, scale = theta[:, 1:2] + theta[:, 2:3] * covariate, theta[:, 3:4] + theta[:, 4:5] * covariate
    with np.errstate(all="ignore"):
        z = (x - loc) / scale
        inner = 1 - c * z
        log_t = np.where(np.abs(c) < 1e-9, -z, np.log(inner) / np.where(np.abs(c) < 1e-9, 1.0, c))
        one = np.log(scale) - (1 - c) * log_t + np.exp(log_t)
        good = np.isfinite(one) & (scale > 0)
    there = ~np.isnan(x)
    return np.where(good & there, one, 0.0).sum(1) + (~good & there).sum(1) * PENALTY


def lmoments_start(x: np.ndarray) -> np.ndarray:
    """(c, location, scale) of samples [b, n] without missing values, by L-moments."""
    x = np.sort(x, axis=1)
    n = x.shape[1]
    j = np.arange(1, n + 1)
    b0, b1 = x.mean(1), (x * ((j - 1) / max(n - 1, 1))).mean(1)
    b2 = (x * ((j - 1) * (j - 2) / max((n - 1) * (n - 2), 1))).mean(1)
    l2 = 2 * b1 - b0
    with np.errstate(all="ignore"):
        y = 2 / (3 + (6 * b2 - 6 * b1 + b0) / l2) - math.log(2) / math.log(3)
    y = np.clip(np.nan_to_num(y), -0.12, 0.25)
    c = 7.8590 * y + 2.9554 * y * y
    c = np.where(np.abs(c) < 1e-6, 1e-6, c)
    g = np.array([math.gamma(1 + k) for k in c])
    scale = np.maximum(l2 * c / ((1 - 2.0**-c) * g), 1e-6)
    return np.column_stack([c, b0 - scale * (1 - g) / c, scale])


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, step: np.ndarray, rounds: int = 600, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Nelder-Mead on many problems at once. ``f`` takes points [m, p] and the numbers [m] of
    the problems they belong to; problems that are done are not evaluated again."""
    b, p = start.shape
    simplex = np.repeat(start[:, None, :], p + 1, axis=1)
    for k in range(p):
        simplex[:, k + 1, k] += step[:, k]
    value = np.stack([f(simplex[:, k], np.arange(b)) for k in range(p + 1)], axis=1)
    live = np.arange(b)
    for _ in range(rounds):
        order = value[live].argsort(1)
        s, v = np.take_along_axis(simplex[live], order[:, :, None], 1), np.take_along_axis(value[live], order, 1)
        simplex[live], value[live] = s, v
        going = v[:, -1] - v[:, 0] > tolerance * (1 + np.abs(v[:, 0]))
        if not going.any():
            break
        live, s, v = live[going], s[going], v[going]
        centre, worst = s[:, :-1].mean(1), s[:, -1]
        new = 2 * centre - worst
        fnew = f(new, live)
        best, poor = fnew < v[:, 0], fnew >= v[:, -2]
        if best.any():
            far = 3 * centre[best] - 2 * worst[best]
            ffar = f(far, live[best])
            better = ffar < fnew[best]
            at = np.flatnonzero(best)[better]
            new[at], fnew[at] = far[better], ffar[better]
        shrink = np.zeros(len(live), dtype=bool)
        if poor.any():
            toward = np.where((fnew[poor] < v[poor, -1])[:, None], new[poor], worst[poor])
            near = (centre[poor] + toward) / 2
            fnear = f(near, live[poor])
            good = fnear < np.minimum(fnew[poor], v[poor, -1])
            at = np.flatnonzero(poor)
            new[at[good]], fnew[at[good]] = near[good], fnear[good]
            shrink[at[~good]] = True
        keep = ~shrink
        simplex[live[keep], -1], value[live[keep], -1] = new[keep], fnew[keep]
        if shrink.any():
            at = live[shrink]
            simplex[at, 1:] = (simplex[at, 1:] + simplex[at, :1]) / 2
            for k in range(1, p + 1):
                value[at, k] = f(simplex[at, k], at)
    rows, best = np.arange(b), value.argmin(1)
    return simplex[rows, best], value[rows, best]


def bca_ends(replicates: np.ndarray, below: float, acceleration: float, level: float) -> tuple[float, float]:
    """Ends of the bias-corrected and accelerated interval, given the share of replicates less than the statistic."""
    normal = NormalDist()
    z0 = normal.inv_cdf(float(np.clip(below, 1e-9, 1 - 1e-9)))
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(normal.cdf(z0 + z / (1 - acceleration * z)))
    lo, hi = np.quantile(replicates, ends)
    return float(lo), float(hi)


def bca_interval(x: np.ndarray, statistic: Callable[[np.ndarray], float], replicates: np.ndarray, level: float) -> tuple[float, float]:
    """Bias-corrected, accelerated bootstrap interval."""
    left_out = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
    d = left_out.mean() - left_out
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if (d**2).sum() else 0.0
    return bca_ends(replicates, (replicates < statistic(x)).mean(), a, level)
