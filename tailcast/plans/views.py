"""The driver's tables as observations, forecasts, fields and samples, in both engines' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, value): a daily series."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("time")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def fcst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(init_date, ensemble, lead_time, time, value): starts are quarters, leads months."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "quarter").alias("init_date"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lead = (F.col("l_partkey") % 12).cast("int").alias("lead_time")
    cells = joined.groupBy("init_date", F.col("l_linenumber").alias("ensemble"), lead).agg(F.max("l_extendedprice").alias("value"))
    return cells.select("init_date", "ensemble", "lead_time", F.add_months("init_date", F.col("lead_time")).alias("time"), "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, lat, lon, value): months over a five by five lattice."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("time"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lat = (-40.0 + 5 * F.floor(F.col("c_nationkey") / 5)).cast("double").alias("lat")
    lon = (110.0 + 10 * (F.col("c_nationkey") % 5)).cast("double").alias("lon")
    return joined.groupBy("time", lat, lon).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, time, value)."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("time"), "value")


OBS = "obs as (select cast(o_orderdate as date) as time, round(sum(o_totalprice), 2) as value from orders group by 1)"
FCST = """fcst as (
    select init_date, ensemble, lead_time, cast(init_date + to_months(lead_time) as date) as time, value from (
        select cast(date_trunc('quarter', o_orderdate) as date) as init_date, l_linenumber as ensemble, cast(l_partkey % 12 as integer) as lead_time, max(l_extendedprice) as value
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3))"""
GRID = """grid as (
    select cast(date_trunc('month', o_orderdate) as date) as time, cast(-40 + 5 * (c_nationkey // 5) as double) as lat, cast(110 + 10 * (c_nationkey % 5) as double) as lon, round(sum(o_totalprice), 2) as value
    from orders join customer on o_custkey = c_custkey group by 1, 2, 3)"""
SAMPLE = "sample as (select event_id, event_type, ts as time, value from events)"
