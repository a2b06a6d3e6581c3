"""Bootstraps whose draws are a function of seed, replicate and position, so that they are
the same however the data are partitioned."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.functions.gev import distinct_ranks
from tailcast.functions.statistics import bca_ends, bca_interval
from tailcast.tables import written


def draw(seed: int, replicate: Column, position: Column) -> Column:
    """A whole number in [0, 2**32) from the MD5 of ``seed:replicate:position``."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), position.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def replicates(df: DataFrame, n_repeats: int, name: str = "k") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``idx`` from 0 in a total order, and ``n``, the group's size.

    Rows are ranked within equal values of the first column of the order; what comes before
    is added up over its distinct values, so that no window holds a group's rows.
    """
    first, rest = order[0], list(order[1:]) or [order[0]]
    up = Window.partitionBy(*by).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, first).agg(F.count("*").alias("_c"))
    counts = counts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*by, first])], F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*by, first])]
    placed = df.withColumn("_in", F.row_number().over(Window.partitionBy(*by, first).orderBy(*rest))).join(counts, reduce(and_, same))
    return placed.select(*df.columns, (F.col("_before") + F.col("_in") - 1).alias("idx"), "n")


def index_table(sizes: DataFrame, by: Sequence[str], n_repeats: int, seed: int = 0, block: int = 1, size: int | None = None) -> DataFrame:
    """(by..., k, pos, idx) for (by..., n): draws with replacement of single positions, or of
    runs of ``block`` (the last may be shorter) that start where they fit."""
    length = F.lit(size) if size else F.col("n")
    each = replicates(sizes.withColumn("_m", length.cast("int")), n_repeats)
    if block == 1:
        pos = each.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        return pos.select(*by, "k", "pos", (draw(seed, F.col("k"), F.col("pos")) % F.col("n")).alias("idx"))
    blocks = each.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / block).cast("int"))))
    start = draw(seed, F.col("k"), F.col("_b")) % (F.col("n") - block + 1)
    pos = blocks.withColumn("_start", start).withColumn("_in", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return pos.withColumn("pos", F.col("_b") * block + F.col("_in")).where("pos < _m").select(*by, "k", "pos", (F.col("_start") + F.col("_in")).alias("idx"))


def resample(df: DataFrame, by: Sequence[str], order: Sequence[str], n_repeats: int, seed: int = 0, block: int = 1, size: int | None = None) -> DataFrame:
    """(k, pos, columns of ``df``): ``n_repeats`` samples of each group of ``by``. Several
    columns are drawn together, since rows are."""
    rows = numbered(df, by, order)
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    return index_table(sizes, by, n_repeats, seed, block, size).join(rows.drop("n"), [*by, "idx"]).drop("idx")


def resample_dims(df: DataFrame, dims: dict[str, tuple[int, int]], n_repeats: int, seed: int = 0) -> DataFrame:
    """Samples over dimensions together: for each dim (size, block), labels are drawn and the
    cube read at their combinations; positions are ``<dim>_pos``. Index tables are of the
    dims' size times ``n_repeats``."""
    index = df.sparkSession.range(n_repeats).select(F.col("id").cast("int").alias("k"))
    for j, (dim, (size, block)) in enumerate(dims.items()):
        labels = numbered(df.select(dim).distinct(), [], [dim])
        n = labels.groupBy().agg(F.count("*").alias("n"))
        drawn = index_table(n, [], n_repeats, seed + j, block, size).join(labels.select("idx", dim), "idx").select("k", F.col("pos").alias(f"{dim}_pos"), dim)
        index = index.join(drawn, "k")
    return index.join(df, list(dims))


def resample_tables(
    tables: dict[str, DataFrame], dims: dict[str, tuple[int, int]], n_repeats: int, function: Callable[..., pd.DataFrame], schema: str, seed: int = 0, bundled: bool = False,
) -> DataFrame:
    """(k, columns of ``schema``): any function of samples of several tables that are drawn together.

    Labels of each dim (size, block) are drawn once a replicate, from the first table that has the dim, and all tables that have it are
    read at them; positions are ``<dim>_pos``. ``bundled`` functions get a replicate's tables, by name, as pandas frames (one without
    rows has none); others get one at a time, and ``table`` says which. A replicate is one task's work: a sample of the sizes asked for.
    """
    first = next(iter(tables.values()))
    drawn = {}
    for j, (dim, (size, block)) in enumerate(dims.items()):
        labels = numbered(next(t for t in tables.values() if dim in t.columns).select(dim).distinct(), [], [dim])
        index = index_table(labels.groupBy().agg(F.count("*").alias("n")), [], n_repeats, seed + j, block, size)
        drawn[dim] = index.join(labels.select("idx", dim), "idx").select("k", F.col("pos").alias(f"{dim}_pos"), dim)
    parts = []
    for name, df in tables.items():
        index = first.sparkSession.range(n_repeats).select(F.col("id").cast("int").alias("k"))
        own = [d for d in dims if d in df.columns]
        for dim in own:
            index = index.join(drawn[dim], "k")
        parts.append((index.join(df, own) if own else index.crossJoin(df)).withColumn("table", F.lit(name)))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    own_columns = {name: [c for c in part.columns if c not in ("k", "table")] for name, part in zip(tables, parts, strict=True)}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        frames = {name: pdf.loc[pdf["table"] == name, columns] for name, columns in own_columns.items()}
        made = function(**frames) if bundled else function(frames[key[1]])
        return made.assign(k=key[0]) if bundled else made.assign(k=key[0], table=key[1])

    if bundled:
        return whole.groupBy("k").applyInPandas(run, f"k int, {schema}")
    return whole.groupBy("k", "table").applyInPandas(run, f"k int, table string, {schema}")


def permutation(df: DataFrame, by: Sequence[str], order: Sequence[str], n_repeats: int, seed: int = 0) -> DataFrame:
    """``df`` with ``k`` and ``pos``: each replicate puts every group's rows in a random order
    (draws without replacement are the first ones)."""
    rows = replicates(numbered(df, by, order), n_repeats)
    shuffled = Window.partitionBy(*by, "k").orderBy(draw(seed, F.col("k"), F.col("idx")), "idx")
    return rows.withColumn("pos", F.row_number().over(shuffled) - 1)


def drawn_first(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, n_repeats: int, seed: int = 0) -> DataFrame:
    """The first ``size`` (a column, the same in a group) rows of each replicate's random order, as ``permutation`` has it, with ``k`` and ``pos``.

    Only rows whose draw is under a bound are ordered: so many that fewer than ``size`` pass it with a probability under
    1e-18; were it to happen, the job fails. So a replicate shuffles about ``size`` rows, however large the group.
    """
    wanted = F.col(size).cast("double")
    bound = F.floor((wanted + 10 * F.sqrt(wanted) + 50) / F.col("n") * 2.0**32)
    rows = replicates(numbered(df, by, order), n_repeats).withColumn("_draw", draw(seed, F.col("k"), F.col("idx"))).where(F.col("_draw") < bound)
    group = Window.partitionBy(*by, "k")
    placed = rows.withColumn("pos", F.row_number().over(group.orderBy("_draw", "idx")) - 1).withColumn("_passed", F.count("*").over(group))
    short = (F.col("_passed") < F.col(size)) & (F.col("_passed") < F.col("n"))
    checked = F.when(short, F.raise_error(F.lit("fewer rows passed the bound than are drawn: choose another seed")).cast("boolean")).otherwise(F.col("pos") < F.col(size))
    return placed.where(checked).drop("_draw", "_passed")


def percentile_interval(df: DataFrame, by: Sequence[str], statistic: Column, level: float = 0.95, prefix: str = "ci") -> DataFrame:
    """Interval of an aggregate over replicates ``k``: two aggregations."""
    tail = (1 - level) / 2
    each = df.groupBy(*by, "k").agg(statistic.alias("_s"))
    return each.groupBy(*by).agg(F.percentile("_s", tail).alias(f"{prefix}_lower"), F.percentile("_s", 1 - tail).alias(f"{prefix}_upper"))


def statistic_interval(
    df: DataFrame, by: Sequence[str], statistic: Callable[[np.ndarray], float], value: str = "value", sample_size: int | None = None, n_resamples: int = 9999, level: float = 0.95, method: str = "percentile", seed: int = 0
) -> DataFrame:
    """(by..., statistic, ci_lower, ci_upper) of any function of a sample, a group at a time:
    ``percentile``, or ``bca`` (bias-corrected and accelerated). A group is one task's work; ``quantile_interval``
    and ``bca_interval_by_columns`` take groups of any size."""
    if method not in ("percentile", "bca") or not 0 < level < 1:
        raise ValueError("method is percentile or bca, the level within (0, 1)")
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["_x"].dropna().to_numpy(float))
        out = {k: pdf[k].iloc[0] for k in keys}
        if not len(x):
            return pd.DataFrame([out | dict.fromkeys(("statistic", "ci_lower", "ci_upper"), None)])
        rng, m = np.random.default_rng(seed), sample_size or len(x)
        drawn = np.array([statistic(x[rng.integers(len(x), size=m)]) for _ in range(n_resamples)])
        lo, hi = bca_interval(x, statistic, drawn, level) if method == "bca" else np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([out | {"statistic": statistic(x), "ci_lower": lo, "ci_upper": hi}])

    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["statistic double", "ci_lower double", "ci_upper double"])
    return df.select(*keys, F.col(value).cast("double").alias("_x")).groupBy(*keys).applyInPandas(run, schema)


def _quantile_without(df: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """(by..., _theta, _w): the quantile of each group without one of its values, and without how many of them it is that:
    it lies between two of three neighbours in the order, whichever value is left out."""
    ranked = numbered(df, by, ["_x"])
    at = F.floor(F.lit(q) * (F.col("n") - 2))
    part = F.lit(q) * (F.col("n") - 2) - at
    near = ranked.where((F.col("n") > 1) & F.col("idx").between(at, at + 2)).groupBy(*by, "n").agg(*[F.max(F.when(F.col("idx") == at + k, F.col("_x"))).alias(f"_{k}") for k in range(3)])
    # of two values the one that is left is the quantile
    x0, x1, x2 = F.col("_0"), F.coalesce("_1", "_0"), F.coalesce("_2", "_1", "_0")
    cases = [(x1 + part * (x2 - x1), at + 1), (x0 + part * (x2 - x0), F.lit(1)), (x0 + part * (x1 - x0), F.col("n") - at - 2)]
    return near.select(*by, F.explode(F.array(*[F.struct(t.alias("_theta"), w.cast("double").alias("_w")) for t, w in cases])).alias("_e")).select(*by, "_e.*")


def bca_interval_by_columns(df: DataFrame, by: Sequence[str], statistic: str | float, order: Sequence[str], value: str = "value", sample_size: int | None = None, n_resamples: int = 9999, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by..., statistic, below, acceleration, ci_lower, ci_upper): the bias-corrected and accelerated interval of the ``mean``,
    the ``std`` or a quantile (a number in [0, 1]) of groups of any size.

    Replicates are aggregates over joined draws; what a statistic is without one value follows from a
    group's sums, or its neighbours in the order, so nothing is left out in turn. A group's ``n_resamples``
    replicates are all that comes together in one row. ``below`` is the share of replicates less than the statistic. Missing
    values are left out; groups of under two values have no interval, those without spread one of no width.
    """
    if not 0 < level < 1 or not (statistic in ("mean", "std") if isinstance(statistic, str) else 0 <= statistic <= 1):
        raise ValueError("the level lies within (0, 1); the statistic is mean, std or a quantile")
    keys = list(by)
    made = {"mean": F.avg, "std": F.stddev_pop}.get(statistic, lambda x: F.percentile(x, float(statistic)))
    seen = df.where(F.col(value).isNotNull()).select(*{*keys, *order}, F.col(value).cast("double").alias("_x"))
    whole = seen.groupBy(*keys).agg(made("_x").alias("statistic"), F.avg("_x").alias("_mean"), F.var_pop("_x").alias("_var"), F.count("*").cast("double").alias("_n"))
    if isinstance(statistic, str):
        n, x, m = F.col("_n"), F.col("_x"), F.col("_mean")
        shifted = (m - x) / (n - 1)  # of the mean, by leaving x out
        spread = F.sqrt(F.greatest(n / (n - 1) * F.col("_var") - n / ((n - 1) * (n - 1)) * (x - m) * (x - m), F.lit(0.0)))
        without = seen.join(whole, keys).where("_n > 1").select(*keys, (m + shifted if statistic == "mean" else spread).alias("_theta"), F.lit(1.0).alias("_w"))
    else:
        without = _quantile_without(seen, keys, float(statistic))
    d, w = F.col("_theta") - F.col("statistic"), F.col("_w")
    sums = without.join(whole.select(*keys, "statistic"), keys).groupBy(*keys).agg(F.sum(w).alias("_c"), *[F.sum(w * F.pow(d, k)).alias(f"_s{k}") for k in (1, 2, 3)])
    c, mean = F.col("_c"), F.col("_s1") / F.col("_c")
    squares = F.col("_s2") - c * mean * mean
    cubes = -(F.col("_s3") - 3 * mean * F.col("_s2") + 2 * c * F.pow(mean, 3))
    # sums of squares that are rounding alone are none
    pushed = F.when(squares > 1e-14 * F.col("_s2"), F.try_divide(cubes, 6 * F.pow(F.greatest(squares, F.lit(0.0)), 1.5)))
    pulled = sums.select(*keys, F.coalesce(pushed, F.lit(0.0)).alias("acceleration"))
    drawn = resample(seen, keys, [*order, "_x"], n_resamples, seed, size=sample_size).groupBy(*keys, "k").agg(made("_x").alias("_s"))
    below = drawn.join(whole.select(*keys, "statistic"), keys).groupBy(*keys).agg(F.avg((F.col("_s") < F.col("statistic")).cast("double")).alias("below"), F.collect_list("_s").alias("_all"))
    joined = whole.select(*keys, "statistic").join(below, keys, "left").join(pulled, keys, "left")

    @F.pandas_udf("ci_lower double, ci_upper double")
    def ends(drawn: pd.Series, below: pd.Series, pull: pd.Series) -> pd.DataFrame:
        rows = [bca_ends(np.asarray(x, dtype=float), b, a, level) if x is not None and a == a and a is not None else (None, None) for x, b, a in zip(drawn, below, pull, strict=True)]
        return pd.DataFrame(rows, columns=["ci_lower", "ci_upper"], dtype=float)

    return joined.withColumn("_ends", ends("_all", "below", "acceleration")).select(*keys, "statistic", "below", "acceleration", *[F.nanvl(f"_ends.{c}", F.lit(None)).alias(c) for c in ("ci_lower", "ci_upper")])


#: Places of a group's order are looked up by so many cells at most, in which they are compared with the values' places.
_CELLS = 1_000_000


def quantile_interval(df: DataFrame, by: Sequence[str], q: float, value: str = "value", sample_size: int | None = None, n_resamples: int = 9999, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by..., statistic, ci_lower, ci_upper): the bias-corrected and accelerated interval of a quantile of groups of any size.

    A quantile of a sample lies between two neighbours in the sample's order. The places of these in the order of the whole group are drawn at once, from
    the distribution (of neighbouring order statistics of uniform draws) that they have in samples with replacement, so that a replicate costs the
    same however large the group, and its two values are looked up by rank, as are those by which leaving out each value moves the
    quantile. A group's ``n_resamples`` replicates are all that comes together. Missing values and NaN are left out;
    groups without values have no statistic, those of one value no interval.
    """
    if not 0 < level < 1 or not 0 <= q <= 1:
        raise ValueError("the level lies within (0, 1), the quantile within [0, 1]")
    keys = list(by)
    ranks = written(distinct_ranks(df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_x")), "_x", keys))

    @F.pandas_udf("lo long, hi long, part double")
    def places(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        made = []
        for size, replicate in zip(n.tolist(), k.tolist(), strict=True):
            if replicate < -1:  # neighbours of the quantile of all values but one
                at = min(max(int(q * (size - 2)), 0) - 2 - replicate, size - 1)
                made.append((at, at, 0.0))
                continue
            m = size if replicate < 0 else sample_size or size
            lo = int(q * (m - 1))
            ends = (lo, min(lo + 1, m - 1))
            if replicate >= 0:
                rng = np.random.default_rng([seed, replicate])
                first = rng.beta(lo + 1, m - lo)
                second = first + (1 - first) * rng.beta(1, m - lo - 1) if lo + 1 < m else first
                ends = (min(int(size * first), size - 1), min(int(size * second), size - 1))
            made.append((*ends, q * (m - 1) - lo))
        return pd.DataFrame(made, columns=["lo", "hi", "part"])

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        both = pdf.sort_values(["k", "_side"])
        lo, hi, part = both["_x"].to_numpy(float)[::2], both["_x"].to_numpy(float)[1::2], both["part"].to_numpy(float)[::2]
        found, n = lo + part * (hi - lo), int(pdf["_n"].iloc[0])
        (x2, x1, x0, statistic), drawn = found[:4], found[4:]
        out = {"statistic": statistic, "ci_lower": None, "ci_upper": None}
        if n > 1:
            at = int(q * (n - 2))
            part = q * (n - 2) - at
            without, times = np.array([x1 + part * (x2 - x1), x0 + part * (x2 - x0), x0 + part * (x1 - x0)]), np.array([at + 1, 1, n - at - 2])
            d = (times * without).sum() / n - without
            squares = (times * d**2).sum()
            a = (times * d**3).sum() / (6 * squares**1.5) if squares > 1e-20 * (times * without**2).sum() else 0.0
            out["ci_lower"], out["ci_upper"] = bca_ends(drawn, (drawn < statistic).mean(), a, level)
        return pd.DataFrame([{k: pdf[f"_k{i}"].iloc[0] for i, k in enumerate(keys)} | out])

    def same(prefix: str) -> Column:
        return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)], F.lit(True))

    names = [f"_k{i}" for i in range(len(keys))]
    wide = F.greatest(F.floor(F.col("_n") / _CELLS), F.lit(1))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    sizes = ranks.groupBy(*keys).agg(F.max("_n").alias("_n"))
    wanted = sizes.select(*own, "_n", F.explode(F.sequence(F.lit(-4), F.lit(n_resamples - 1))).alias("k")).withColumn("_d", places("_n", "k"))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("_side"), F.col(f"_d.{c}").alias("_at")) for i, c in enumerate(("lo", "hi"))])).alias("_e")
    wanted = wanted.select(*names, "_n", "k", "_d.part", sides).select(*names, "_n", "k", "part", "_e.*").withColumn("_at_cell", F.floor(F.col("_at") / wide))
    covered = ranks.select(*keys, "_x", "_before", "_m", F.explode(F.sequence(F.floor(F.col("_before") / wide), F.floor((F.col("_before") + F.col("_m") - 1) / wide))).alias("_cell"))
    met = wanted.join(covered, same("_k") & (F.col("_at_cell") == F.col("_cell")) & (F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_m")))
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["statistic double", "ci_lower double", "ci_upper double"])
    found = met.groupBy(*names).applyInPandas(ends, schema)
    groups = df.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).distinct() if keys else df.sparkSession.range(1)
    return groups.join(found, same("_g"), "left").select(*[F.col(f"_g{i}").alias(k) for i, k in enumerate(keys)], "statistic", "ci_lower", "ci_upper")
