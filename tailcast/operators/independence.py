"""From which lead on are ensemble members independent draws?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.operators.resampling import drawn_first
from tailcast.tables import written


def detrended(df: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Values less the ensemble mean's line over the starts, of each initial month and lead,
    as it departs from the first start. Adds ``init_month``. The table is written, to be worked out once."""
    d = written(df).withColumn("init_month", F.month("init_date")).withColumn("_x", F.unix_date(F.col("init_date").cast("date")).cast("double"))
    keys = ["init_month", "lead_time", *by]
    means = d.groupBy(*keys, "_x").agg(F.avg(value).alias("_m"))
    lines = means.groupBy(*keys).agg(F.regr_slope("_m", "_x").alias("_slope"), F.min("_x").alias("_x0"))
    gone = F.coalesce(F.col("_slope"), F.lit(0.0)) * (F.col("_x") - F.col("_x0"))
    return d.join(lines, keys).withColumn(value, F.col(value) - gone).drop("_slope", "_x0", "_x")


def average_rank(value: str, by: Sequence[str]) -> Column:
    w = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2


def mean_correlation(df: DataFrame, by: Sequence[str], member: str = "ensemble", along: str = "init_date", value: str = "value") -> DataFrame:
    """(by..., r): the mean over pairs of members of Spearman's correlation along the starts.

    Members are ranked once. Where every member has all starts the mean over pairs is had
    from the sums of standardised ranks, with no pairs at all; other groups go by pairs of
    members and the starts that both have. The values are written first, as each of these steps reads them.
    """
    kept = written(df.where(F.col(value).isNotNull()).select(*by, member, along, value))
    shape = kept.groupBy(*by).agg(F.countDistinct(member).alias("_e"), F.countDistinct(along).alias("_i"), F.count("*").alias("_n"))
    sized = kept.join(shape, list(by)) if by else kept.crossJoin(F.broadcast(shape))
    whole = sized.where("_n = _e * _i and _e > 1")
    return _dense(whole, by, member, along, value).unionByName(_by_pairs(sized.where("_n <> _e * _i"), by, member, along, value))


def _dense(df: DataFrame, by: Sequence[str], member: str, along: str, value: str) -> DataFrame:
    one = Window.partitionBy(*by, member)
    ranked = df.withColumn("_r", average_rank(value, [*by, member]))
    centred = ranked.withColumn("_c", F.col("_r") - (F.col("_i") + 1) / 2)
    z = F.try_divide(F.col("_c"), F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(one)))
    scaled = centred.withColumn("_z", z)
    members = F.countDistinct(F.when(F.col("_z").isNotNull(), F.col(member)))
    sums = scaled.groupBy(*by, along).agg(F.sum("_z").alias("_s"))
    counts = scaled.groupBy(*by).agg(members.cast("double").alias("_m"))
    squared = sums.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    joined = squared.join(counts, list(by)) if by else squared.crossJoin(counts)
    return joined.select(*by, F.try_divide(F.col("_q") - F.col("_m"), F.col("_m") * (F.col("_m") - 1)).alias("r"))


def _by_pairs(df: DataFrame, by: Sequence[str], member: str, along: str, value: str) -> DataFrame:
    x = df.select(*by, along, F.col(member).alias("_a"), F.col(value).alias("_x"))
    y = df.select(*by, along, F.col(member).alias("_b"), F.col(value).alias("_y"))
    pairs = x.join(y, [*by, along]).where("_a < _b")
    keys = [*by, "_a", "_b"]
    ranked = pairs.withColumn("_rx", average_rank("_x", keys)).withColumn("_ry", average_rank("_y", keys))
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("_r")).groupBy(*by).agg(F.avg("_r").alias("r"))


def cross_correlation(df: DataFrame, other: DataFrame, by: Sequence[str], member: str = "ensemble", along: str = "init_date", value: str = "value") -> DataFrame:
    """(by..., r): the mean of Spearman's correlation along the starts that both have, over pairs of a
    member of ``df`` and one of ``other`` that comes at no smaller place in the order of members."""

    def placed(d: DataFrame, at: str, v: str) -> DataFrame:
        labels = d.select(member).distinct().withColumn(at, F.row_number().over(Window.orderBy(member)))
        return d.where(F.col(value).isNotNull()).join(F.broadcast(labels), member).select(*by, along, at, F.col(value).alias(v))

    keys = [*by, "_a", "_b"]
    pairs = placed(df, "_a", "_x").join(placed(other, "_b", "_y"), [*by, along]).where("_a <= _b")
    ranked = pairs.withColumn("_rx", average_rank("_x", keys)).withColumn("_ry", average_rank("_y", keys))
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("_r")).groupBy(*by).agg(F.avg("_r").alias("r"))


def null_bounds(df: DataFrame, by: Sequence[str] = (), n_resamples: int = 100, level: float = 0.95, value: str = "value", seed: int = 0) -> DataFrame:
    """(init_month, by..., ci_lower, ci_upper): bounds of the mean correlation of members
    made of draws without replacement from all starts, leads and members of a month;
    the same for all its leads."""
    if not 0 < level < 1:
        raise ValueError("the level lies within (0, 1)")
    keys = ["init_month", *by]
    df = written(df.select(*keys, "init_date", "lead_time", "ensemble", value))
    shape = df.groupBy(*keys).agg(F.countDistinct("init_date").alias("_i"), F.countDistinct("ensemble").alias("_e"))
    sized = df.where(F.col(value).isNotNull()).join(shape, keys).withColumn("_size", F.col("_i") * F.col("_e"))
    drawn = drawn_first(sized, keys, ["init_date", "lead_time", "ensemble"], "_size", n_resamples, seed)
    cells = drawn.select(*keys, "k", F.floor(F.col("pos") / F.col("_e")).alias("init_date"), (F.col("pos") % F.col("_e")).alias("ensemble"), value)
    r = mean_correlation(cells, [*keys, "k"], value=value)
    tail = (1 - level) / 2
    return r.groupBy(*keys).agg(F.percentile("r", tail).alias("ci_lower"), F.percentile("r", 1 - tail).alias("ci_upper"))


def min_independent_lead(r: DataFrame, bounds: DataFrame, by: Sequence[str] = (), two_sided: bool = False) -> DataFrame:
    """(init_month, by..., min_lead): the first lead whose correlation is not at or above the
    upper bound; one without a correlation counts as independent; 0 if there is none.
    ``two_sided`` asks for a correlation between both bounds."""
    keys = ["init_month", *by]
    joined = r.join(bounds, keys)
    dependent = F.coalesce((F.col("r") >= F.col("ci_lower")) & (F.col("r") >= F.col("ci_upper")), F.lit(False))
    if two_sided:
        dependent = F.coalesce(~F.col("r").between(F.col("ci_lower"), F.col("ci_upper")), F.lit(False))
    return joined.groupBy(*keys).agg(F.coalesce(F.min(F.when(~dependent, F.col("lead_time"))), F.lit(0)).alias("min_lead"))


def run_tests(df: DataFrame, by: Sequence[str] = (), n_resamples: int = 100, level: float = 0.95, detrend: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Correlations by initial month and lead, null bounds and first independent leads."""
    d = written(detrended(df, by) if detrend else df.withColumn("init_month", F.month("init_date")))
    r = mean_correlation(d, ["init_month", "lead_time", *by])
    bounds = null_bounds(d, by, n_resamples, level)
    return r, bounds, min_independent_lead(r, bounds, by)
