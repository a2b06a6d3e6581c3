"""The generalised extreme value distribution (shape c > 0: bounded above) as columns."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.tables import written

#: What a value outside the support adds to a negative log-likelihood.
PENALTY = math.log(1.7976931348623157e308) * 100
INF = float("inf")


def _t(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    """(1 - c z) ** (1 / c), exp(-z) for c = 0; null outside the support."""
    z = (x - loc) / scale
    inner = 1 - c * z
    return F.when(c == 0, F.exp(-z)).when(inner > 0, F.exp(F.ln(inner) / F.when(c != 0, c)))


def cdf(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    outside = F.when(c > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(F.exp(-_t(x, c, loc, scale)), outside))


def sf(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    """Probability of more than ``x``."""
    t = _t(x, c, loc, scale)
    outside = F.when(c > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(-F.expm1(-t), outside))


def isf(p: Column, c: Column, loc: Column, scale: Column) -> Column:
    """Value exceeded with probability ``p``; at 1 the lower end of the support."""
    y = -F.ln(F.when(p < 1, 1 - p))
    body = F.when(c == 0, loc - scale * F.ln(y)).otherwise(loc + scale * (1 - F.pow(y, c)) / F.when(c != 0, c))
    lower = F.when(c < 0, loc + scale / F.when(c != 0, c)).otherwise(F.lit(-INF))
    return F.when(p >= 1, lower).otherwise(body)


def pdf(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    t = _t(x, c, loc, scale)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(F.pow(t, 1 - c) * F.exp(-t) / scale, F.lit(0.0)))


def nllf(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    """Negative log-likelihood of one value; null where it has no density."""
    t = _t(x, c, loc, scale)
    good = F.ln(F.when(scale > 0, scale)) - (1 - c) * F.ln(F.when(t > 0, t)) + t
    return F.when(x.isNotNull(), good)


def penalised_sum(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    """Aggregate: the sample's negative log-likelihood, PENALTY for each impossible value."""
    one = nllf(x, c, loc, scale)
    return F.sum(F.when(x.isNotNull(), F.coalesce(one, F.lit(PENALTY))))


def return_period(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    p = sf(x, c, loc, scale)
    return F.when(p == 0, F.lit(INF)).otherwise(F.try_divide(F.lit(1.0), p))


def return_level(period: Column, c: Column, loc: Column, scale: Column) -> Column:
    return isf(F.lit(1.0) / period, c, loc, scale)


def at_covariate(params: dict[str, Column], x: Column | None = None) -> tuple[Column, Column, Column]:
    """c, loc, scale from 3 (c, location, scale) or 5 (c, location_0, location_1, scale_0,
    scale_1) parameters, the latter at covariate ``x``."""
    if set(params) == {"c", "location", "scale"}:
        return params["c"], params["location"], params["scale"]
    if set(params) == {"c", "location_0", "location_1", "scale_0", "scale_1"} and x is not None:
        return params["c"], params["location_0"] + params["location_1"] * x, params["scale_0"] + params["scale_1"] * x
    raise ValueError("3 parameters, or 5 and a covariate")


# Lanczos coefficients (g = 7).
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def gamma_of_one_plus(x: Column) -> Column:
    """Gamma(1 + x) for x > -1/2; by reflection below."""

    def lanczos(y: Column) -> Column:
        series = F.lit(_LANCZOS[0])
        for i, k in enumerate(_LANCZOS[1:], 1):
            series = series + k / (y + i)
        w = y + 7.5
        return F.lit(math.sqrt(2 * math.pi)) * F.pow(w, y + 0.5) * F.exp(-w) * series

    reflected = F.lit(math.pi) / (F.sin(F.lit(math.pi) * (1 + x)) * lanczos(-1 - x))
    return F.when(x > -0.5, lanczos(x)).otherwise(reflected)


def distinct_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., _x, _m, _before, _n): each distinct value of a group, how often it occurs, how many values are less, and the group's number.

    Values are counted first, so that ties are one row, and these rows dealt out by ranges of group and value that Spark
    samples, so that outliers and heavy tails leave no range overfull; what lies in the ranges before is
    added up by range. The dealt table is written, for both to see the same ranges.
    """
    seen = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    counted = seen.groupBy(*by, "_x").agg(F.count("*").alias("_m"))
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = written(counted.repartitionByRange(ranges, *by, "_x").withColumn("_slot", F.spark_partition_id()))
    keys = [F.col(c).alias(f"_{i}") for i, c in enumerate(by)]
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_slot").agg(F.sum("_m").alias("_c"))
    sums = sums.select(*keys, F.col("_slot").alias("_of"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_lower"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    within = Window.partitionBy(*by, "_slot").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("_m").over(within), F.lit(0)))
    return placed.join(sums, reduce(and_, same, F.col("_slot") == F.col("_of"))).select(*by, "_x", "_m", (F.col("_lower") + F.col("_in")).alias("_before"), "_n")


def ranked(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., _x, _j, _n): values, their ranks from 1 and number in the group, a row for each."""
    return distinct_ranks(df, value, by).select(*by, "_x", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_m"))).alias("_j"), "_n")


def fit_lmoments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, c, location, scale) by L-moments: probability-weighted moments from the ranks of each
    group's distinct values, those of ties added up in closed form, then Hosking's closed form."""
    x, m, k, n = F.col("_x"), F.col("_m").cast("double"), F.col("_before").cast("double"), F.col("_n").cast("double")
    # sums of i and of i * (i - 1) for i = k .. k + m - 1
    one, two = m * (2 * k + m - 1) / 2, m * (3 * k * k + 3 * k * (m - 2) + (m - 1) * (m - 2)) / 3
    sums = distinct_ranks(df, value, by).groupBy(*by).agg(
        F.max("_n").alias("n"), F.sum(x * m / n).alias("b0"), F.sum(F.try_divide(one, n - 1) * x / n).alias("b1"), F.sum(F.try_divide(two, (n - 1) * (n - 2)) * x / n).alias("b2")
    )
    l2 = 2 * F.col("b1") - F.col("b0")
    t3 = F.try_divide(6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"), l2)
    y = 2 / (3 + t3) - math.log(2) / math.log(3)
    shaped = sums.withColumn("_l2", l2).withColumn("c", 7.8590 * y + 2.9554 * y * y)
    c, g = F.col("c"), gamma_of_one_plus(F.col("c"))
    scaled = shaped.withColumn("scale", F.try_divide(F.col("_l2") * c, (1 - F.pow(F.lit(2.0), -c)) * g))
    return scaled.withColumn("location", F.col("b0") - F.try_divide(F.col("scale") * (1 - g), c)).select(*by, "n", "c", "location", "scale")


def aep_to_ari(aep: Column) -> Column:
    """Average recurrence interval of an annual exceedance probability in % (below 100)."""
    return F.when(aep < 100, F.try_divide(F.lit(1.0), -F.ln(1 - aep / 100)))


def ari_to_aep(ari: Column) -> Column:
    return 100 * (F.exp(1 / ari) - 1) / F.exp(1 / ari)
