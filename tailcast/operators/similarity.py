"""Two-sample tests: are model and observations draws of one distribution?"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tailcast.functions import statistics


def pooled(fcst: DataFrame, obs: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by..., src, value): model values are f, observations o; missing ones are left out."""
    one = fcst.select(*by, F.lit("f").alias("src"), F.col(value).cast("double").alias("value"))
    other = obs.select(*by, F.lit("o").alias("src"), F.col(value).cast("double").alias("value"))
    return one.unionByName(other).where("value is not null")


def counted(both: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, f, o): how often each distinct value is in both samples, counted map-side; what was counted before is added up."""
    if "src" in both.columns:
        return both.groupBy(*by, "value").agg(F.count(F.when(F.col("src") == "f", 1)).alias("f"), F.count(F.when(F.col("src") == "o", 1)).alias("o"))
    return both.groupBy(*by, "value").agg(F.sum("f").alias("f"), F.sum("o").alias("o"))


def _cumulated(both: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each distinct pooled value: counts of both samples there and below, so that windows hold distinct
    values only."""
    counts = counted(both, by)
    w = Window.partitionBy(*by)
    up = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, "value", "f", "o", F.sum("f").over(up).alias("cf"), F.sum("o").over(up).alias("co"), F.sum("f").over(w).alias("nf"), F.sum("o").over(w).alias("no"), F.count("*").over(w).alias("distinct"))


def ks_statistic(both: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ks_statistic, n_f, n_o): the largest distance of the two distributions."""
    gap = F.abs(F.try_divide(F.col("cf").cast("double"), F.col("nf")) - F.try_divide(F.col("co").cast("double"), F.col("no")))
    return _cumulated(both, by).groupBy(*by).agg(F.max(gap).alias("ks_statistic"), F.max("nf").alias("n_f"), F.max("no").alias("n_o"))


def ad_raw(both: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., a2, n_f, n_o): the midrank Anderson-Darling sum, not yet standardised; missing
    where either sample is empty or all values are one."""
    c = _cumulated(both, by)
    each = F.col("f") + F.col("o")
    n = F.col("nf") + F.col("no")
    b = F.col("cf") + F.col("co") - each / 2
    below = b * (n - b) - n * each / 4

    def part(own: str) -> Column:
        m = F.col(f"c{own}") - F.col(own) / 2
        return F.sum(F.try_divide(each / n * F.pow(n * m - b * F.col(f"n{own}"), 2), below)) / F.max(F.col(f"n{own}"))

    usable = (F.max("distinct") > 1) & (F.min("nf") > 0) & (F.min("no") > 0)
    total = F.max(n)
    made = F.when(usable, (total - 1) / total * (part("f") + part("o")))
    return c.where("nf > 0 and no > 0").groupBy(*by).agg(made.alias("a2"), F.max("nf").alias("n_f"), F.max("no").alias("n_o"))


@pandas_udf(DoubleType())
def _ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([statistics.ks_two_sample_p(*x) if x[0] == x[0] else None for x in zip(d, n1, n2, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def _ad_standard(a2: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([(a - 1) / statistics.ad_sigma(int(x), int(y)) if a == a and x + y > 3 else None for a, x, y in zip(a2, n1, n2, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def _ad_p(a: pd.Series) -> pd.Series:
    return pd.Series([statistics.anderson_darling_p(x) if x == x else None for x in a], dtype=float)


def ks_test(both: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ks_statistic, ks_pvalue); p-values from one row a group."""
    s = ks_statistic(both, by).where("n_f > 0 and n_o > 0")
    return s.select(*by, "ks_statistic", _ks_p("ks_statistic", "n_f", "n_o").alias("ks_pvalue"))


def anderson_darling_test(both: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ad_statistic, ad_pvalue); the p-value lies within [0.001, 0.25]."""
    s = ad_raw(both, by).where("n_f > 0 and n_o > 0").select(*by, _ad_standard("a2", "n_f", "n_o").alias("ad_statistic"))
    return s.select(*by, F.nanvl("ad_statistic", F.lit(None)).alias("ad_statistic"), F.nanvl(_ad_p("ad_statistic"), F.lit(None)).alias("ad_pvalue"))


def similarity_tests(fcst: DataFrame, obs: DataFrame, by: Sequence[str] = (), by_lead: bool = False, value: str = "value") -> DataFrame:
    """Both tests for each place, and each lead against all observations with ``by_lead``: these are counted first, so
    that each lead gets distinct values with their counts, not all rows again."""
    keys = list(by)
    if by_lead:
        keys = [*keys, "lead_time"]
        model, seen = counted(pooled(fcst, fcst.limit(0), keys, value), keys), counted(pooled(obs.limit(0), obs, by, value), by)
        both = model.unionByName(seen.join(fcst.select("lead_time").distinct(), how="cross"))
    else:
        both = pooled(fcst, obs, keys, value)
    one, other = ks_test(both, keys), anderson_darling_test(both, keys)
    return one.join(other, keys, "full") if keys else one.crossJoin(other)
