"""Selecting rows and masking values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")


def check_date(text: str) -> str:
    """A date as YYYY-MM-DD; ValueError otherwise."""
    if not _DATE.search(text):
        raise ValueError(f"not of the form YYYY-MM-DD: {text}")
    return text


def project(df: DataFrame, variables: str | Sequence[str], dims: Sequence[str]) -> DataFrame:
    return df.select(*dims, *([variables] if isinstance(variables, str) else variables))


def isel(df: DataFrame, dim: str, which: int | slice) -> DataFrame:
    """Rows at positions of ``dim``'s distinct sorted values; slices are half open, negative
    positions count from the end."""
    found = df.select(dim).where(F.col(dim).isNotNull()).distinct()
    ranked = found.withColumn("_at", F.row_number().over(Window.orderBy(dim)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    at, n = F.col("_at"), F.col("_n")

    def place(i: int) -> Column:
        return F.lit(i) if i >= 0 else n + i

    if isinstance(which, slice):
        step = which.step or 1
        start = place(which.start or 0)
        good = (at >= start) & ((at - start) % step == 0)
        if which.stop is not None:
            good &= at < place(which.stop)
    else:
        good = at == place(which)
    return df.join(ranked.where(good).select(dim), dim, "left_semi")


def sel(df: DataFrame, dim: str, which: object) -> DataFrame:
    """Rows by label: one, or a slice with both ends included."""
    if isinstance(which, slice):
        good = F.lit(True)
        if which.start is not None:
            good &= F.col(dim) >= F.lit(which.start)
        if which.stop is not None:
            good &= F.col(dim) <= F.lit(which.stop)
        return df.where(good)
    return df.where(F.col(dim) == F.lit(which))


def select_months(df: DataFrame, months: Iterable[int], time: str = "time", init_month: bool = False) -> DataFrame:
    """Rows of these months; with ``init_month`` all times move back by what lies between the first
    time of the table and the first that is kept."""
    kept = df.where(F.month(time).isin(*months))
    if not init_month:
        return kept
    first = df.agg(F.min(time).alias("_old")).crossJoin(kept.agg(F.min(time).alias("_new")))
    moved = kept.crossJoin(F.broadcast(first))
    return moved.withColumn(time, F.date_add(time, F.datediff("_old", "_new"))).drop("_old", "_new")


def select_time_period(df: DataFrame, period: Sequence[str], time: str = "time", auxiliary: bool = False) -> DataFrame:
    """Rows of a period. As a dimension the whole last day counts; as an auxiliary
    coordinate its midnight is the end. Rows without a time go."""
    start, stop = map(check_date, period)
    if time not in df.columns:
        raise ValueError(f"no time column {time}")
    if auxiliary:
        return df.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")))
    return df.where((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.date_add(F.lit(stop).cast("date"), 1).cast("timestamp_ntz")))


def drop_leap_days(df: DataFrame, time: str = "time") -> DataFrame:
    return df.where(~((F.month(time) == 2) & (F.day(time) == 29)))


def select_point(df: DataFrame, lat: float, lon: float, lat_dim: str = "lat", lon_dim: str = "lon") -> DataFrame:
    """The cell nearest along each axis on its own; longitudes are brought to [0, 360). Of
    two as near the larger coordinate counts."""

    def nearest(dim: str, distance: Column) -> DataFrame:
        return df.groupBy().agg(F.min_by(dim, F.struct(distance, -F.col(dim))).alias(dim))

    turned = F.pmod(F.col(lon_dim), F.lit(360.0))
    rows = nearest(lat_dim, F.abs(F.col(lat_dim) - lat))
    columns = nearest(lon_dim, F.abs(turned - lon % 360))
    return df.join(F.broadcast(rows), lat_dim, "left_semi").join(F.broadcast(columns), lon_dim, "left_semi")


def subset_lat(df: DataFrame, south: float, north: float, lat: str = "lat") -> DataFrame:
    if not (-90 <= south <= 90 and -90 <= north <= 90):
        raise ValueError("latitudes lie within [-90, 90]")
    return df.where(F.col(lat).between(south, north))


def subset_lon(df: DataFrame, west: float, east: float, lon: str = "lon") -> DataFrame:
    """Both ends included; if ``east`` is no larger than ``west``, round the back."""
    if east > west:
        return df.where(F.col(lon).between(west, east))
    return df.where((F.col(lon) >= west) | (F.col(lon) <= east))


def within_longitudes(df: DataFrame, bounds: Sequence[float], lon: str = "lon") -> DataFrame:
    """``df``; raises when it is read if a bound lies outside of its longitudes."""
    seen = df.agg(F.min(lon).alias("_west"), F.max(lon).alias("_east"))
    good = [F.lit(float(b)).between(F.col("_west"), F.col("_east")) for b in bounds]
    checked = seen.select(F.when(good[0] & good[1], F.lit(True)).otherwise(F.raise_error(F.lit(f"longitudes {tuple(bounds)} lie outside of the data"))).alias("_within"))
    return df.crossJoin(F.broadcast(checked)).where("_within").drop("_within")


def mask_leads(df: DataFrame, least: int | dict[int, int] | DataFrame, value: str = "value", lead: str = "lead_time", init: str = "init_date") -> DataFrame:
    """NULL where the lead is below the least: a number, one for each initial month, or a
    table (month, min_lead) of at most 12 rows."""
    if isinstance(least, int):
        return df.withColumn(value, F.when(F.col(lead) >= least, F.col(value)))
    if isinstance(least, dict):
        limit = F.lit(None).cast("int")
        for month, n in least.items():
            limit = F.when(F.month(init) == month, F.lit(n)).otherwise(limit)
        return df.withColumn(value, F.when(F.col(lead) >= limit, F.col(value)))
    small = least.select(F.col("month").alias("_month"), F.col("min_lead").alias("_least"))
    joined = df.withColumn("_month", F.month(init)).join(F.broadcast(small), "_month", "left")
    return joined.withColumn(value, F.when(F.col(lead) >= F.col("_least"), F.col(value))).drop("_month", "_least")


def drop_max(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """NULL for all values that equal their group's largest."""
    top = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn(value, F.when(F.col(value) < top, F.col(value)))


def first_leads(df: DataFrame, n: int, lead: str = "lead_time") -> DataFrame:
    return df.where(F.col(lead) < n)


def drop_missing(df: DataFrame, dim: str, value: str = "value", how: str = "any") -> DataFrame:
    """Without the labels of ``dim`` for which any, or all, values are missing."""
    counted = df.groupBy(dim).agg(F.count(value).alias("_there"), F.count("*").alias("_all"))
    good = counted.where("_there = _all" if how == "any" else "_there > 0").select(dim)
    return df.join(good, dim, "left_semi")


def squeeze(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Without those of ``dims`` that have a single value: one aggregate over the table."""
    if not dims:
        return df
    one = df.agg(*[(F.min(d) == F.max(d)).alias(d) for d in dims]).first()
    return df.drop(*[d for d in dims if one[d]])


