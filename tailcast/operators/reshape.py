"""Between (time) and (init_date, lead_time)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailcast.tables import written

#: How times are compared: to the year, month or day.
ROUNDING = {"A": "YEAR", "Y": "YEAR", "M": "MONTH", "D": "DAY"}


def to_init_lead(df: DataFrame, time: str = "time", by: Sequence[str] = (), init_date: str | None = None) -> DataFrame:
    """Adds ``lead_time``, 0 on in the order of time within ``by``, and ``init_date``, the
    given one or the first time.

    Rows are dealt out by ranges of group and time that Spark samples, equal times by a hash of the row; what lies in
    the ranges before is added up by range, so that no task holds a whole group.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    tied = df.withColumn("_tie", F.xxhash64(*hashed))
    dealt = written(tied.repartitionByRange(ranges, *by, time, "_tie").withColumn("_slot", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    sums = dealt.groupBy(*by, "_slot").agg(F.count("*").alias("_c"), F.min(F.col(time).cast("date")).alias("_least"))
    lower = F.coalesce(F.sum("_c").over(group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lower")
    sums = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slot").alias("_of"), lower, F.min("_least").over(group).alias("_least"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_slot") == F.col("_of"))
    placed = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_slot").orderBy(time, "_tie"))).join(sums, same)
    first = F.lit(init_date).cast("date") if init_date else F.col("_least")
    kept = [F.col(c) for c in df.columns if c not in ("init_date", "lead_time")]
    return placed.select(*kept, first.alias("init_date"), (F.col("_lower") + F.col("_in") - 1).cast("int").alias("lead_time"))


def time_to_lead(df: DataFrame, time: str = "time", init: str = "init_date", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Leads of each start counted over its times that have values."""
    kept = df.where(F.col(value).isNotNull())
    return kept.withColumn("lead_time", F.dense_rank().over(Window.partitionBy(init, *by).orderBy(time)) - 1)


def lead_to_time(df: DataFrame, init: str = "init_date", lead: str = "lead_time", unit: str = "M") -> DataFrame:
    """Adds ``time``: the start moved by the lead in days or months."""
    moved = F.add_months(init, F.col(lead)) if unit == "M" else F.date_add(init, F.col(lead))
    return df.withColumn("time", moved)


def stack_by_init_date(df: DataFrame, starts: DataFrame, n_leads: int, time: str = "time", value: str = "value", rounding: str = "D", by: Sequence[str] = ()) -> DataFrame:
    """(by..., init_date, lead_time, time, value): for each start in ``starts`` (init_date)
    that lies in the range of times, the values at the first time equal to it, to the
    precision of ``rounding``, and the ``n_leads - 1`` after it; missing beyond the end.

    Starts that no time equals are left out. Times are numbered once for the whole table,
    which its groups share.
    """
    unit = ROUNDING[rounding]
    times = df.select(time).where(F.col(time).isNotNull()).distinct()
    at = times.withColumn("_at", F.row_number().over(Window.orderBy(time)))
    ends = times.agg(F.min(F.date_trunc(unit, time)).alias("_lo"), F.max(F.date_trunc(unit, time)).alias("_hi"))
    matched = starts.select("init_date").distinct().withColumn("_unit", F.date_trunc(unit, "init_date")).join(at.groupBy(F.date_trunc(unit, time).alias("_unit")).agg(F.min("_at").alias("_start")), "_unit")
    inside = matched.crossJoin(F.broadcast(ends)).where("_unit between _lo and _hi")
    leads = inside.select("init_date", F.explode(F.sequence(F.lit(0), F.lit(n_leads - 1))).alias("lead_time"), "_start").withColumn("_at", F.col("_start") + F.col("lead_time"))
    lattice = leads.select("init_date", "lead_time", "_at")
    if by:
        lattice = lattice.crossJoin(df.select(*by).distinct())
    placed = df.join(at, time).select(*by, "_at", F.col(time).alias("time"), F.col(value).alias("value"))
    return lattice.join(placed, [*by, "_at"], "left").select(*by, "init_date", "lead_time", "time", "value")


def densify(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every combination of the labels of ``dims``, with missing values where none were."""
    every = df.select(dims[0]).distinct()
    for d in dims[1:]:
        every = every.crossJoin(df.select(d).distinct())
    return every.join(df, list(dims), "left")


def with_covariate(df: DataFrame, covariates: DataFrame, value: str = "value", time: str = "time", name: str = "covariate") -> DataFrame:
    """``df`` with the ``value`` of ``covariates`` at the same time; missing where there is none."""
    return df.join(covariates.select(time, F.col(value).alias(name)), time, "left")


def concatenated(tables: Sequence[DataFrame], dim: str) -> DataFrame:
    """The tables below each other along a new dimension, numbered from 0; columns that one lacks are missing."""
    numbered = [t.withColumn(dim, F.lit(i)) for i, t in enumerate(tables)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), numbered)
