"""Maximum-likelihood fits of the GEV by grouped sums, for groups of any size and for bootstraps.

Rows are packed once into blocks of a group's rows, with the counts that bootstrap samples hold them by. Parameters of all groups are a
small table: each round joins it to the blocks, adds up, for each group and sample, the negative log-likelihood, its gradient and its second
derivatives, and a damped Newton step follows from the sums. No group is ever gathered: what is shuffled is one row of sums for each
block and sample. A bootstrap sample is the same rows with counts drawn from a hash of seed, replicate and row, so nothing is copied.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.operators.resampling import draw, numbered
from tailcast.tables import dropped, written

NAMES = {False: ("c", "location", "scale"), True: ("c", "location_0", "location_1", "scale_0", "scale_1")}
#: Rounds at most, each a scan, of groups and of bootstrap samples; Newton's steps need about eight, and from the group's own
#: fit three or four. More are for samples whose best parameters lie at the end of what their values allow.
ROUNDS, SAMPLE_ROUNDS = 40, 12
#: A group, or a bootstrap sample, is done when its next step is smaller, in widths of the group's values.
SMALLEST_STEP, SAMPLE_STEP = 1e-8, 1e-5
#: Share of a parameter, or of 1, within which it counts as being at a bound.
_ROOM = 1e-8
#: Rows of a block, on average, and of a task: each row meets all replicates.
BLOCK_ROWS, TASK_ROWS = 10_000, 100_000
#: Quantiles that starts are taken from.
_QUANTILES = (0.1, 0.5, 0.9)
#: Where |shape * z| is less, logarithms are worked out by series.
_SERIES = 0.01

#: Counts of a row are draws from the Poisson distribution of mean 1: its cumulated probabilities in 2**32 parts.
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def resampled_count(seed: int, replicate: Column, row: Column) -> Column:
    """How often a bootstrap sample holds a row: Poisson draws, which counts of draws with replacement are in
    large samples, from the hash of seed, replicate and row; the sample's size varies with them."""
    u = draw(seed, replicate, row)
    return reduce(lambda made, k: made.when(u < POISSON[k], k), range(1, len(POISSON)), F.when(u < POISSON[0], 0)).otherwise(len(POISSON))


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))


def _keyed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _series(a: np.ndarray, factors: list[float]) -> np.ndarray:
    """The sum of ``factors[i] * a ** i``."""
    return reduce(lambda made, f: made * a + f, reversed(factors[:-1]), np.full_like(a, factors[-1]))


def _terms(c: float, mu: np.ndarray | float, sigma: np.ndarray | float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are possible, and their negative log-likelihood and its first and second derivatives by shape, location and scale, [10, m]:
    f, c, m, s, cc, cm, cs, mm, ms, ss. ``u`` is minus the log of minus the log of the distribution function, ``uc``, ``ucc``, ``uz`` its derivatives."""
    sigma = np.broadcast_to(np.asarray(sigma, dtype=float), y.shape)
    with np.errstate(all="ignore"):
        z = (y - mu) / sigma
        good = (sigma > 0) & (c * z < 1)
        if not good.all():
            z, sigma = z[good], sigma[good]
        a = c * z
        w = 1 - a
        near = np.abs(a) < _SERIES
        by = c or 1.0
        u = np.log(w) / by
        uc = -(u + z / w) / by
        ucc = -(2 * uc + z * z / (w * w)) / by
        if near.any():
            n, x = a[near], z[near]
            u[near] = -x * _series(n, [1 / (k + 1) for k in range(9)])
            uc[near] = -x * x * _series(n, [k / (k + 1) for k in range(1, 10)])
            ucc[near] = -x * x * x * _series(n, [k * (k - 1) / (k + 1) for k in range(2, 11)])
        t, uz = np.exp(u), -1 / w
        e = t - 1 + c
        lz, lzz, lzc = e * uz, (t - e * c) * uz * uz, (t * uc + 1 - e * z * uz) * uz
        square = sigma * sigma
        by_scale = [(1 - z * lz) / sigma, 2 * uc + t * uc * uc + e * ucc, -lzc / sigma, -z * lzc / sigma, lzz / square, (lz + z * lzz) / square, (2 * z * lz + z * z * lzz - 1) / square]
        return good, np.stack([np.log(sigma) - (1 - c) * u + t, u + e * uc, -lz / sigma, *by_scale])


def _kinds(trend: bool) -> tuple[list[int], list[int]]:
    """Of each sum - the negative log-likelihood, its gradient, the upper triangle of its second derivatives - the term and the power of the covariate."""
    names = ["f", "c", "m", "s", "cc", "cm", "cs", "mm", "ms", "ss"]
    kinds = "cmMsS" if trend else "cms"
    made = ["f", *kinds, *[a + b for i, a in enumerate(kinds) for b in kinds[i:]]]
    return [names.index("".join(sorted(m.lower(), key="cms".index)) if m != "f" else m) for m in made], [sum(x in "MS" for x in m) for m in made]


def _packed(rows: DataFrame, units: DataFrame, keys: list[str], n_resamples: int, seed: int) -> DataFrame:
    """(keys..., _y, _v, _counts): rows as blocks of about ``BLOCK_ROWS`` of a group; values, covariates and,
    two to a byte, the counts of each row in all samples."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    sizes = units.select(*_keyed(keys), F.ceil(F.col("_n") / BLOCK_ROWS).alias("_parts"))
    dealt = rows.join(sizes, _same(keys)).withColumn("_part", F.monotonically_increasing_id() % F.col("_parts")).select(*rows.columns, "_part")
    samples = [f"{seed}:{k}:".encode() for k in range(n_resamples)]

    def pack(table: pa.Table) -> pa.Table:
        counts = np.zeros((len(table), n_resamples + n_resamples % 2), dtype=np.uint8)
        for i, row in enumerate(table.column("_id").to_pylist() if n_resamples else []):
            name = row.encode()
            hashes = np.frombuffer(b"".join([hashlib.md5(s + name).digest() for s in samples]), dtype=">u4")[::4]
            counts[i, :n_resamples] = np.searchsorted(POISSON, hashes.astype(np.int64), side="right")
        columns = [table.column(c).to_numpy().astype(float).tobytes() for c in ("_value", "_x")] + [(counts[:, ::2] | counts[:, 1::2] << 4).tobytes()]
        return pa.table([*[table.column(k).slice(0, 1) for k in keys], *[pa.array([c], pa.binary()) for c in columns]], names=[*keys, "_y", "_v", "_counts"])

    schema = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys) + "_y binary, _v binary, _counts binary"
    return written(dealt.repartition(tasks, *keys, "_part").groupBy(*keys, "_part").applyInArrow(pack, schema))


def summed(blocks: DataFrame, live: DataFrame, keys: list[str], trend: bool) -> DataFrame:
    """(keys..., k, _weight, _bad, _sums, _least, _most) of blocks under the parameters ``tried`` of ``live``: the sum of counts and that
    of impossible values, and the negative log-likelihood, its gradient and the upper
    triangle of its second derivatives, in order; the ends of the values. All in standard units."""
    tried = live.groupBy(*keys).agg(F.first("unit").alias("_unit"), F.collect_list(F.struct("k", "tried")).alias("_tried")).select(*_keyed(keys), "_unit", "_tried")
    term, power = _kinds(trend)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                y, v, counts, unit, tries = (batch.column(name)[i].as_py() for name in ("_y", "_v", "_counts", "_unit", "_tried"))
                y = (np.frombuffer(y) - unit[0]) / unit[1]
                v = (np.frombuffer(v) - unit[2]) / unit[3] if trend else np.zeros(len(y))
                counts = np.frombuffer(counts, dtype=np.uint8).reshape(len(y), -1).T
                for one in tries:
                    k, t = one["k"], one["tried"]
                    count = counts[k // 2] >> 4 * (k % 2) & 15 if k >= 0 else np.ones(len(y), dtype=np.uint8)
                    held = np.flatnonzero(count)
                    if not len(held):
                        continue
                    w, own, x = count[held].astype(float), y[held], v[held]
                    good, terms = _terms(t[0], t[1] + t[2] * x if trend else t[1], t[3] + t[4] * x if trend else t[2], own)
                    wg, x = w[good], x[good]
                    sums = np.einsum("tm,pm->tp", terms, np.stack([wg, wg * x, wg * x * x] if trend else [wg]))
                    at.append(i)
                    found.append((k, w.sum(), w.sum() - wg.sum(), sums[term, power].tolist(), own.min(), own.max()))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*[batch.column(name).take(pa.array(at, pa.int64())) for name in keys], *columns], names=[*keys, "k", *names])

    types, names = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64()], ["_weight", "_bad", "_sums", "_least", "_most"]
    schema = "".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}, " for k in keys) + "k int, _weight double, _bad double, _sums array<double>, _least double, _most double"
    parts = blocks.join(tried, _same(keys)).select(*keys, "_y", "_v", "_counts", "_unit", "_tried").mapInArrow(run, schema)
    whole = F.array(*[F.sum(F.col("_sums")[i]) for i in range(len(term))])
    return parts.groupBy(*keys, "k").agg(F.sum("_weight").alias("_weight"), F.sum("_bad").alias("_bad"), whole.alias("_sums"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))


def _to_physical(t: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Parameters of values and covariates in standard units as those in their own; ``unit``: mean, width, mid, spread."""
    m, s, mid, spread = unit
    if len(t) == 3:
        return np.array([t[0], m + s * t[1], s * t[2]])
    up, wider = s * t[2] / spread, s * t[4] / spread
    return np.array([t[0], m + s * t[1] - up * mid, up, s * t[3] - wider * mid, wider])


def _to_standard(theta: np.ndarray, unit: np.ndarray) -> np.ndarray:
    m, s, mid, spread = unit
    if len(theta) == 3:
        return np.array([theta[0], (theta[1] - m) / s, theta[2] / s])
    return np.array([theta[0], (theta[1] + theta[2] * mid - m) / s, theta[2] * spread / s, (theta[3] + theta[4] * mid) / s, theta[4] * spread / s])


def _moves(gradient: np.ndarray, hessian: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """Damped Newton moves [b, p], downhill whatever the curvature, none longer than half a width."""
    values, vectors = np.linalg.eigh(hessian)
    along = np.einsum("bpk,bp->bk", vectors, gradient) / (np.maximum(np.abs(values), 1e-8) + damping[:, None])
    move = -np.einsum("bpk,bk->bp", vectors, along)
    return move * np.minimum(1.0, 0.5 / np.maximum(np.abs(move).max(1, initial=0.0), 1e-300))[:, None]


def _held_back(best: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, damping: float, unit: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A move that leaves alone the parameters at a bound that the slope pushes them against."""
    theta = _to_physical(best, unit)
    size = np.maximum(np.abs(theta), 1.0)
    to_standard = np.column_stack([_to_standard(theta + row, unit) - best for row in np.diag(size)]) / size
    slope, room = to_standard.T @ gradient, _ROOM * size
    free = ~(((theta <= low + room) & (slope > 0)) | ((theta >= high - room) & (slope < 0)) | (low == high))
    if not free.any():
        return np.zeros_like(best)
    basis = np.linalg.qr(to_standard[:, free])[0]
    return basis @ _moves((basis.T @ gradient)[None], (basis.T @ hessian @ basis)[None], np.array([damping]))[0]


def _inside(move: np.ndarray, best: np.ndarray, least: float, most: float) -> np.ndarray:
    """The move, or as much of it as leaves all values possible (three parameters)."""
    whole = move
    for _ in range(40):
        c, mu, sigma = best + move
        if sigma > 0 and c * (least - mu) < sigma and c * (most - mu) < sigma:
            break
        move = move / 2
    return move if move is whole else 0.9 * move


def _advanced(states: DataFrame, sums: DataFrame, keys: list[str], p: int, low: np.ndarray, high: np.ndarray, smallest: float) -> DataFrame:
    """States after a round: the parameters tried are kept if they are better, and the next ones set."""
    schema = states.schema
    upper = np.triu_indices(p)
    gumbel = np.array([0.0, -0.05, 0.35] if p == 3 else [0.0, -0.05, 0.0, 0.35, 0.0])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            unit, tried, best, held, got = (np.array(pdf[c].tolist(), dtype=float) for c in ("unit", "tried", "best", "held", "_sums"))
            damping, before, first = pdf["damping"].to_numpy(float), pdf["value"].to_numpy(float), pdf["n"].isna().to_numpy()
            weight = np.maximum(pdf["_weight"].to_numpy(float), 1.0)
            value = np.where((pdf["_bad"].to_numpy() == 0) & np.isfinite(got).all(1), got[:, 0], np.inf)
            before = np.where(first, np.inf, before)
            kept = np.isfinite(value) & (value <= before + 1e-12 * (1 + np.abs(np.where(first, 0.0, before))))
            damping = np.where(kept, np.where(damping > 1e-8, damping / 30, 0.0), np.where(first, damping, np.maximum(damping * 30, 1e-2)))
            best, held, value = np.where(kept[:, None], tried, best), np.where(kept[:, None], got, held), np.where(kept, value, before)
            hessian = np.zeros((len(pdf), p, p))
            hessian[:, upper[0], upper[1]] = held[:, 1 + p :]
            hessian = (hessian + np.triu(hessian, 1).transpose(0, 2, 1)) / weight[:, None, None]
            slope = held[:, 1 : 1 + p] / weight[:, None]
            move = _moves(slope, hessian, damping)
            following = best.copy()
            for i, ends in enumerate(zip(pdf["_least"], pdf["_most"], strict=True)):
                lost = first[i] and not kept[i]  # an impossible start: a Gumbel distribution allows all values
                if lost:
                    following[i] = gumbel
                elif (low == high).any() or not _within(best[i], unit[i], low, high, _ROOM):
                    move[i] = _held_back(best[i], slope[i], hessian[i], damping[i], unit[i], low, high)
                if not lost:
                    following[i] = best[i] + (_inside(move[i], best[i], *ends) if p == 3 else move[i])
                if not _within(following[i], unit[i], low, high):
                    following[i] = _to_standard(np.clip(_to_physical(following[i], unit[i]), low, high), unit[i])
            known = ~(first & ~kept)
            tries = pdf["tries"].to_numpy() + ~known
            done = np.where(known, (np.abs(following - best).max(1) < smallest) | (damping > 1e8), tries > 2)
            n = np.where(known, np.where(kept, pdf["_weight"].to_numpy(float), pdf["n"].to_numpy(float)), np.nan)
            out = pdf.assign(best=list(best), tried=list(following), value=np.where(known, value, np.nan), n=n, held=list(held), damping=damping, tries=tries, done=done)[schema.names]
            yield out.astype(object).where(out.notna(), None) if not known.all() else out

    joined = states.join(sums.select(*_keyed([*keys, "k"]), "_weight", "_bad", "_sums", "_least", "_most"), _same([*keys, "k"]), "left")
    width = 1 + p + p * (p + 1) // 2
    rest = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in (("_weight", 0.0), ("_bad", 1.0), ("_least", 0.0), ("_most", 0.0))]
    filled = joined.select(*states.columns, F.coalesce("_sums", F.array(*[F.lit(0.0)] * width)).alias("_sums"), *rest)
    return filled.mapInPandas(run, schema)


def _within(t: np.ndarray, unit: np.ndarray, low: np.ndarray, high: np.ndarray, room: float = 0.0) -> bool:
    """Whether parameters keep the bounds, by ``room`` at least."""
    theta = _to_physical(t, unit)
    return bool((theta >= low + room * np.maximum(1, np.abs(theta))).all() and (theta <= high - room * np.maximum(1, np.abs(theta))).all())


def _rounds(blocks: DataFrame, states: DataFrame, keys: list[str], trend: bool, low: np.ndarray, high: np.ndarray, most: int = ROUNDS, smallest: float = SMALLEST_STEP) -> DataFrame:
    """States when all are done, or after ``most`` rounds; blocks are read once a round."""
    p, made = len(NAMES[trend]), [written(states)]
    for _ in range(most):
        going = made[-1].where("not done")
        if going.isEmpty():
            break
        made.append(written(_advanced(going, summed(blocks, going.select(*keys, "k", "unit", "tried"), keys, trend), keys, p, low, high, smallest)))
    out = written(reduce(DataFrame.unionByName, [m.where("done") for m in made[:-1]], made[-1]))
    dropped(*made)
    return out


def _finite(df: DataFrame, keys: list[str], value: str, covariate: str | None, row: Sequence[str] | None = None) -> DataFrame:
    """(keys..., _value, _x, _id): values and covariates (0 without one), neither missing nor infinite, and what tells rows apart."""
    x = F.col(covariate).cast("double") if covariate is not None else F.lit(0.0)
    told = F.concat_ws("|", *[F.col(c).cast("string") for c in row]) if row else F.lit(None).cast("string")
    rows = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_value"), F.nanvl(x, F.lit(None)).alias("_x"), told.alias("_id"))
    return rows.where((F.abs("_value") < float("inf")) & (F.abs("_x") < float("inf")))


def sums_at(df: DataFrame, fits: DataFrame, by: Sequence[str], value: str = "value", covariate: str | None = None) -> DataFrame:
    """(by..., n, nllf, by_...): for each group of ``by`` the number of values that its parameters allow, their negative log-likelihood and
    its derivative by each parameter. ``fits`` has a row of parameters for a group, by the names of ``fit_by_sums``; of
    parameters that are missing or not finite, or allow no value, there is no row."""
    trend, keys = covariate is not None, list(by)
    names = NAMES[trend]
    known = reduce(and_, [F.abs(F.nanvl(F.col(name), F.lit(None))) < float("inf") for name in names])
    unit, tried = F.array(*[F.lit(v) for v in (0.0, 1.0, 0.0, 1.0)]), F.array(*[F.col(name).cast("double") for name in names])
    given = written(fits.select(*keys, *names))
    live = given.where(known).select(*keys, F.lit(-1).alias("k"), unit.alias("unit"), tried.alias("tried"))
    rows = written(_finite(df, keys, value, covariate))
    units = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    blocks = _packed(rows, units, keys, 0, 0)
    sums = written(summed(blocks, live, keys, trend))
    dropped(given, rows, units, blocks)
    made = sums.select(*keys, (F.col("_weight") - F.col("_bad")).cast("long").alias("n"), *[F.col("_sums")[i].alias(name) for i, name in enumerate(("nllf", *[f"by_{name}" for name in names]))])
    return made.where("n > 0")


def fit_by_sums(
    df: DataFrame,
    by: Sequence[str],
    value: str = "value",
    covariate: str | None = None,
    fixed: dict[str, float] | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
    n_resamples: int = 0,
    row: Sequence[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """(by..., k, n, parameters..., nllf): fits of every group of ``by``, of any size, and of ``n_resamples`` bootstrap samples of it,
    numbered by ``k`` (the group itself is -1), by Newton rounds over grouped sums.

    Three parameters, or with a ``covariate`` five, whose location and scale have trends. ``fixed`` pins parameters and
    ``bounds`` holds them within (low, high), by name; without others the shape is at most 1, beyond which the likelihood has no
    maximum; the scale is positive wherever there are values. Missing values, infinite ones and those without a covariate are left out;
    groups of under four values or of one value only, or one covariate, have missing parameters. ``row`` names the
    columns that tell a group's rows apart, by which counts are drawn; without, rows are numbered by
    value and covariate. A bootstrap sample keeps a row's value and covariate together and starts
    from the group's own fit; ``n`` is its size. A group whose bounds leave no possible parameters near its moments has missing ones.
    """
    trend, keys = covariate is not None, list(by)
    names = NAMES[trend]
    low, high = np.full(len(names), -np.inf), np.full(len(names), np.inf)
    high[0] = 1.0
    for name, (lo, hi) in (bounds or {}).items():
        low[names.index(name)], high[names.index(name)] = lo, hi
    for name, at in (fixed or {}).items():
        low[names.index(name)] = high[names.index(name)] = at

    rows = _finite(df, keys, value, covariate, row)
    if n_resamples and not row:
        rows = numbered(rows, keys, ["_value", "_x"]).select(*keys, "_value", "_x", F.col("idx").cast("string").alias("_id"))
    rows = written(rows)
    spread = F.stddev_pop("_x") if trend else F.lit(1.0)
    slope = F.coalesce(F.try_divide(F.covar_pop("_value", "_x"), F.var_pop("_x")), F.lit(0.0)) if trend else F.lit(0.0)
    shares = F.percentile_approx("_value", [float(q) for q in _QUANTILES], 1000)
    units = rows.groupBy(*keys).agg(F.count("*").alias("_n"), shares.alias("_q"), F.stddev_pop("_value").alias("_sd"), F.avg("_x").alias("_mid"), spread.alias("_spread"), slope.alias("_slope"))
    # the middle and the width of most values, which heavy tails don't move
    width = F.when(F.col("_q")[2] > F.col("_q")[0], F.col("_q")[2] - F.col("_q")[0]).otherwise(F.col("_sd"))
    units = written(units.select(*keys, "_n", "_q", "_slope", F.array(F.col("_q")[1], width, "_mid", "_spread").alias("unit")))
    good = units.where((F.col("_n") >= 4) & (F.col("unit")[1] > 0) & (F.col("unit")[3] > 0))
    blank = [F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("n"), F.array(*[F.lit(0.0)] * (1 + len(names) + len(names) * (len(names) + 1) // 2)).alias("held"), F.lit(1e-3).alias("damping"), F.lit(0).alias("tries"), F.lit(False).alias("done")]
    clipped = _started(good.select(*keys, F.lit(-1).alias("k"), "unit", "_q", "_slope"), trend, low, high)
    blocks = _packed(rows, units, keys, n_resamples, seed)
    own = _rounds(blocks, clipped.select(*keys, "k", "unit", F.col("tried").alias("best"), "tried", *blank), keys, trend, low, high)
    fits = own
    if n_resamples:
        k = F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("k")
        again = _rounds(blocks, own.where("value is not null").select(*keys, k, "unit", "best", F.col("best").alias("tried"), *blank), keys, trend, low, high, SAMPLE_ROUNDS, SAMPLE_STEP)
        fits = own.unionByName(again)
    dropped(rows, blocks)
    made = fits.select(*keys, "k", "n", _physical(trend), (F.col("value") + F.col("n") * F.ln(F.col("unit")[1])).alias("nllf"), "value")
    made = made.select(*keys, "k", "n", *[F.when(F.col("value").isNotNull(), F.col("_theta")[i]).alias(name) for i, name in enumerate(names)], "nllf")
    rest = units.join(made.where("k < 0").select(*_keyed(keys), F.lit(True).alias("_fitted")), _same(keys), "left").where("_fitted is null")
    none = rest.select(*keys, F.lit(-1).alias("k"), F.col("_n").cast("double").alias("n"), *[F.lit(None).cast("double").alias(name) for name in (*names, "nllf")])
    return made.unionByName(none).withColumn("n", F.col("n").cast("long"))


def _started(groups: DataFrame, trend: bool, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Starts ``tried``, within the bounds: the shape by which the outer quantiles lie about the median, and the slope of the line."""
    shapes = np.linspace(-0.95, 0.95, 191) + 1e-6
    y = -np.log(np.array(_QUANTILES))
    points = (1 - y[None, :] ** shapes[:, None]) / shapes[:, None]
    ratios = (points[:, 2] - points[:, 1]) / (points[:, 1] - points[:, 0])  # falls with the shape

    def run(batches):
        for pdf in batches:
            tried = []
            for q, slope, unit in zip(pdf.pop("_q"), pdf.pop("_slope"), pdf["unit"], strict=True):
                k = np.abs(ratios - (q[2] - q[1]) / max(q[1] - q[0], 1e-300)).argmin()
                scale = unit[1] / (points[k, 2] - points[k, 0])
                theta = np.array([shapes[k], q[1] - scale * points[k, 1], scale])
                if trend:
                    theta = np.array([theta[0], theta[1] - slope * unit[2], slope, scale, 0.0])
                tried.append(list(_to_standard(np.clip(theta, low, high), np.asarray(unit))))
            yield pdf.assign(tried=tried)

    kept = groups.drop("_q", "_slope")
    return groups.mapInPandas(run, kept.withColumn("tried", F.col("unit")).schema)


def _physical(trend: bool) -> Column:
    t, u = F.col("best"), F.col("unit")
    if not trend:
        return F.array(t[0], u[0] + u[1] * t[1], u[1] * t[2]).alias("_theta")
    up, wider = u[1] * t[2] / u[3], u[1] * t[4] / u[3]
    return F.array(t[0], u[0] + u[1] * t[1] - up * u[2], up, u[1] * t[3] - wider * u[2], wider).alias("_theta")
