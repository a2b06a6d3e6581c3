"""Calendar bins, climatologies and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.operators.selection import select_time_period

# Months, and the label month of each season's bins.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
SEASONS = {"DJF": 2, "MAM": 5, "JJA": 8, "SON": 11}
METHODS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def _anchor(freq: str) -> tuple[str, int]:
    kind, _, month = freq.partition("-")
    if kind in ("M", "ME"):
        return "M", 12
    if kind in ("Y", "YE", "A") or kind in ("Q", "QE"):
        return kind[0].replace("A", "Y"), MONTHS.index(month or "DEC") + 1
    raise ValueError(f"unknown frequency {freq}")


def period_end(time: Column, freq: str) -> Column:
    """Last day of the calendar bin: ``ME``, ``YE-<month>`` (or ``A-``), ``Q-<month>``."""
    kind, anchor = _anchor(freq)
    if kind == "M":
        return F.last_day(time)
    step = 12 if kind == "Y" else 3
    ahead = F.pmod(F.lit(anchor) - F.month(time), F.lit(step))
    return F.last_day(F.add_months(F.trunc(time, "month"), ahead))


def _labels(df: DataFrame, time: str, freq: str) -> DataFrame:
    """All bins from the first to the last of the table, empty ones too."""
    kind, _ = _anchor(freq)
    step = {"M": 1, "Q": 3, "Y": 12}[kind]
    ends = df.agg(period_end(F.min(time), freq).alias("lo"), period_end(F.max(time), freq).alias("hi")).where("lo is not null")
    months = F.floor(F.months_between(F.trunc("hi", "month"), F.trunc("lo", "month")) / step).cast("int")
    each = F.transform(F.sequence(F.lit(0), months), lambda k: F.last_day(F.add_months(F.trunc("lo", "month"), k * step)))
    return ends.select(F.explode(each).alias("_label"))


def temporal_aggregation(
    df: DataFrame,
    freq: str,
    method: str,
    value: str = "value",
    time: str = "time",
    by: Sequence[str] = (),
    input_freq: str = "D",
    season: str | None = None,
    min_tsteps: int | None = None,
    dates: bool = False,
    reset_times: bool = False,
    dense: bool = True,
) -> DataFrame:
    """(by..., time, value): one row a bin, labelled by its last day.

    Sums of bins without values are 0, other results missing; with ``dense`` the bins that
    have no rows are there too. Monthly input has its means weighted by days in the month,
    months without a value counting in the divisor. With ``min_tsteps`` a bin goes if any
    group has fewer values in it. ``dates`` adds ``event_time``, the first day of the
    largest or smallest value. ``reset_times`` labels annual bins by the month and day of
    the first time. Nothing happens if the input has the target's frequency already.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    kind, _ = _anchor(freq)
    if input_freq[0] == kind:
        return df
    if dates and method not in ("min", "max"):
        raise ValueError("dates are for min and max")
    v, keys = F.col(value), [*by, "_label"]
    if method == "mean" and input_freq[0] == "M":
        days = F.day(F.last_day(time))
        made = F.try_divide(F.sum(v * days), F.sum(days))
    elif method == "mean" and input_freq[0] != "D":
        raise ValueError("means are of daily or monthly values")
    else:
        made = METHODS[method](v)
    binned = df.withColumn("_label", period_end(F.col(time), freq))
    extra = []
    if dates:
        found = F.when(v.isNotNull(), F.struct(v.alias("v"), ((-1 if method == "max" else 1) * F.unix_date(F.col(time).cast("date"))).alias("d")))
        extra = [(F.max(found) if method == "max" else F.min(found)).alias("_event")]
    out = binned.groupBy(*keys).agg(made.alias("_value"), F.count(v).alias("_n"), *extra)
    if dense:
        every = _labels(df, time, freq)
        if by:
            every = df.select(*by).distinct().crossJoin(F.broadcast(every))
        out = every.join(out, keys, "left")
    if method == "sum":
        out = out.withColumn("_value", F.coalesce("_value", F.lit(0.0)))
    if season:
        if _anchor(freq) != ("Q", 11):
            raise ValueError("seasons need bins of Q-NOV")
        out = out.where(F.month("_label") == SEASONS[season])
    if min_tsteps:
        short = out.groupBy("_label").agg(F.min(F.coalesce("_n", F.lit(0))).alias("_least")).where(F.col("_least") < min_tsteps)
        out = out.join(short, "_label", "left_anti")
    columns = [*by, F.col("_label").alias(time), F.col("_value").alias(value)]
    if dates:
        columns.append(F.date_format(F.date_from_unix_date(F.col("_event.d") * (-1 if method == "max" else 1)), "yyyy-MM-dd").alias("event_time"))
    out = out.select(*columns)
    return reset_annual(out, df, time) if reset_times else out


def reset_annual(binned: DataFrame, source: DataFrame, time: str = "time") -> DataFrame:
    """Annual labels with the month and day of the source's first time."""
    first = source.agg(F.min(time).alias("_first"))
    moved = binned.crossJoin(F.broadcast(first))
    return moved.withColumn(time, F.make_date(F.year(time), F.month("_first"), F.day("_first"))).drop("_first")


def event_dates(df: DataFrame, freq: str, method: str = "max", **how: object) -> DataFrame:
    return temporal_aggregation(df, freq, method, dates=True, **how)


def _several(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def climatology(df: DataFrame, value: str | Sequence[str] = "value", by: Sequence[str] = (), period: Sequence[str] | None = None, time: str = "time", init: str | None = None) -> DataFrame:
    """(by..., [init_month], value): the mean of each group, of each initial month if ``init``
    is the column of initial dates; of several values in one aggregation. Rows outside ``period`` take no part."""
    if period:
        df = select_time_period(df, period, time, auxiliary=init is not None)
    keys = [F.col(c) for c in by] + ([F.month(init).alias("init_month")] if init else [])
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in _several(value)])


def _less(df: DataFrame, mean: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Values less those of ``mean`` that have the same keys."""
    names = {v: f"_clim_{i}" for i, v in enumerate(values)}
    joined = df.join(mean.withColumnsRenamed(names), keys, "left")
    return joined.withColumns({v: F.col(v) - F.col(c) for v, c in names.items()}).drop(*names.values())


def anomalies(df: DataFrame, period: Sequence[str] | None = None, frequency: str | None = None, value: str | Sequence[str] = "value", time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """Observations, of one or several values, less their mean over ``period``, of each month (or day of the year) if
    ``frequency`` is ``month`` (``day``)."""
    unit = {"month": F.month, "day": F.dayofyear}.get(frequency or "")
    keys = [*by, "_unit"]
    d = df.withColumn("_unit", unit(time) if unit else F.lit(0))
    return _less(d, climatology(d, value, keys, period, time), _several(value), keys).drop("_unit")


def forecast_anomalies(df: DataFrame, period: Sequence[str] | None = None, value: str | Sequence[str] = "value", time: str = "time", init: str = "init_date", lead: str = "lead_time", by: Sequence[str] = ()) -> DataFrame:
    """Forecasts, of one or several values, less the mean over members and starts of their initial month, lead and place."""
    mean = climatology(df, value, [lead, *by], period, time, init)
    return _less(df.withColumn("init_month", F.month(init)), mean, _several(value), [lead, *by, "init_month"]).drop("init_month")
