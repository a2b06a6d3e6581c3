"""Bias of forecasts against observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.operators.reshape import stack_by_init_date
from tailcast.operators.temporal import climatology

METHODS = ("additive", "multiplicative")


def bias(
    fcst: DataFrame, obs: DataFrame, method: str, period: Sequence[str] | None = None, rounding: str = "A", by_lead: bool = False, by: Sequence[str] = (), n_leads: int | None = None
) -> DataFrame:
    """(init_month, [lead_time], by..., bias): the forecasts' mean less the observations', or
    divided by it, where observations are stacked onto the forecasts' starts and leads.

    The period goes by valid time, the groups by the month of the start. Missing values
    take no part in either mean; a mean of 0 gives no ratio.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    keys = ["lead_time", *by] if by_lead else [*by]
    modelled = climatology(fcst, "value", keys, period, "time", "init_date").withColumnRenamed("value", "_f")
    if n_leads is None:
        n_leads = fcst.agg(F.max("lead_time")).first()[0] + 1
    stacked = stack_by_init_date(obs, fcst.select("init_date"), n_leads, rounding=rounding, by=by)
    observed = climatology(stacked, "value", keys, period, "time", "init_date").withColumnRenamed("value", "_o")
    both = modelled.join(observed, [*keys, "init_month"])
    made = F.col("_f") - F.col("_o") if method == "additive" else F.try_divide(F.col("_f"), F.col("_o"))
    return both.select("init_month", *keys, made.alias("bias"))


def remove_bias(fcst: DataFrame, biases: DataFrame, method: str) -> DataFrame:
    """Forecasts with the bias of their initial month (and lead and place) taken out."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    keys = [c for c in biases.columns if c != "bias"]
    joined = fcst.withColumn("init_month", F.month("init_date")).join(biases, keys, "left")
    made = F.col("value") - F.col("bias") if method == "additive" else F.try_divide(F.col("value"), F.col("bias"))
    return joined.withColumn("value", made).drop("init_month", "bias")
