"""Areas, polygons and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.operators import spatial as s
from tailcast.plans.views import GRID, grid
from tailcast.queries import query
from tailcast.queries.selection import r6

#: (west, south, east, north)
BOXES = {"west": (105.0, -42.5, 125.0, -22.5), "north": (108.0, -27.0, 155.0, -18.0), "south-east": (127.0, -43.0, 153.0, -31.0)}
IN_BOX = " union all ".join(f"select '{k}' as region, lat, lon from (select distinct lat, lon from grid) where lat >= {y1} and lat < {y2} and lon >= {x1} and lon < {x2}" for k, (x1, y1, x2, y2) in BOXES.items())
MASK = f"mask as ({IN_BOX})"
COS = "cos(radians(grid.lat))"
JOINED = "mask join grid on mask.lat = grid.lat and mask.lon = grid.lon"


def _shapes(spark: SparkSession) -> DataFrame:
    return s.shapes_table(spark, {k: s.ring_of_box(*b) for k, b in BOXES.items()})


def _regions(spark: SparkSession, d: str, agg: str, **how: bool) -> DataFrame:
    g, shapes = grid(spark, d), _shapes(spark)
    return r6(s.select_regions(g, s.centre_mask(g, shapes), agg, ["time"], shapes=shapes, **how))


@query(f"with {GRID} select time, round(avg(value), 6) as value from grid group by 1")
def spatial_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(s.aggregate(grid(spark, d), "mean", ["time"]))


@query(f"with {GRID} select time, round(sum(value), 2) as value from grid group by 1")
def spatial_sum(spark: SparkSession, d: str) -> DataFrame:
    return s.aggregate(grid(spark, d), "sum", ["time"]).withColumn("value", F.round("value", 2))


@query(f"with {GRID} select time, round(sum(value * {COS}) / sum({COS}), 6) as value from grid group by 1")
def spatial_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(s.aggregate(grid(spark, d), "weighted_mean", ["time"]))


@query(f"with {GRID}, {MASK} select region, time, round(avg(value), 6) as value from {JOINED} group by 1, 2")
def region_mean(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d, "mean")


@query(f"with {GRID}, {MASK} select region, time, round(median(value), 6) as value from {JOINED} group by 1, 2")
def region_median(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d, "median")


@query(f"with {GRID}, {MASK} select region, time, min(value) as low, max(value) as high from {JOINED} group by 1, 2")
def region_min_max(spark: SparkSession, d: str) -> DataFrame:
    low = _regions(spark, d, "min").withColumnRenamed("value", "low")
    return low.join(_regions(spark, d, "max").withColumnRenamed("value", "high"), ["region", "time"])


@query(f"with {GRID}, {MASK}, named as (from mask union all select 'all' as region, lat, lon from (select distinct lat, lon from mask)) select region, time, round(sum(value * {COS}) / sum({COS}), 6) as value from named as mask join grid on mask.lat = grid.lat and mask.lon = grid.lon group by 1, 2")
def region_combined_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d, "weighted_mean", combine=True)


@query(f"with {GRID}, {MASK} select region, grid.lat, grid.lon, time, value from {JOINED}")
def region_cells(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return s.select_regions(g, s.centre_mask(g, _shapes(spark)), None, []).select("region", "lat", "lon", "time", "value")


FRACTIONS = " union all ".join(
    f"select '{k}' as region, lat, lon, count(*) / 100 as frac from points where y >= {y1} and y < {y2} and x >= {x1} and x < {x2} group by 2, 3" for k, (x1, y1, x2, y2) in BOXES.items()
)
POINTS = f"""{GRID}, cells as (select distinct lat, lon from grid), k as (select unnest(range(0, 10)) as k),
    points as (select lat, lon, lat + 5 * ((a.k + 0.5) / 10 - 0.5) as y, lon + 10 * ((b.k + 0.5) / 10 - 0.5) as x from cells, k a, k b)"""


@query(f"with {POINTS} select region, lat, lon, cast(frac as double) as frac from ({FRACTIONS}) where frac > 0.3")
def overlap_mask(spark: SparkSession, d: str) -> DataFrame:
    return s.overlap_fractions(grid(spark, d), _shapes(spark)).where("frac > 0.3")


def _target(spark: SparkSession) -> DataFrame:
    lats = spark.createDataFrame([(-38.0,), (-31.0,), (-24.0,)], "lat double")
    return lats.crossJoin(spark.createDataFrame([(112.0,), (128.0,), (144.0,)], "lon double"))


TARGET = "target as (select lat, lon from (values (-38.0), (-31.0), (-24.0)) a(lat), (values (112.0), (128.0), (144.0)) b(lon))"
SUMMED = "select time, dlat as lat, dlon as lon, case when count(*) = count(value) then round(sum(value * w), 6) end as value from"


@query(f"""with {GRID}, slat as (select lat, lat - 2.5 as lo, lat + 2.5 as hi from (select distinct lat from grid)), slon as (select lon, lon - 5 as lo, lon + 5 as hi from (select distinct lon from grid)),
    tlat as (select lat, lat - 3.5 as lo, lat + 3.5 as hi from (values (-38.0), (-31.0), (-24.0)) a(lat)), tlon as (select lon, lon - 8 as lo, lon + 8 as hi from (values (112.0), (128.0), (144.0)) b(lon)),
    wlat as (select s.lat, t.lat as dlat, sin(radians(least(s.hi, t.hi))) - sin(radians(greatest(s.lo, t.lo))) as w from slat s join tlat t on s.lo < t.hi and t.lo < s.hi),
    wlon as (select s.lon, t.lon as dlon, least(s.hi, t.hi) - greatest(s.lo, t.lo) as w from slon s join tlon t on s.lo < t.hi and t.lo < s.hi),
    w as (select lat, lon, dlat, dlon, wlat.w * wlon.w / sum(wlat.w * wlon.w) over (partition by dlat, dlon) as w from wlat, wlon)
    select time, cast(dlat as double) as lat, cast(dlon as double) as lon, round(sum(value * w), 4) as value from grid join w using (lat, lon) group by 1, 2, 3""")
def regrid_conservative(spark: SparkSession, d: str) -> DataFrame:
    return s.regrid(grid(spark, d), _target(spark), "conservative", ["time"]).withColumn("value", F.round("value", 4))


@query(f"""with {GRID}, slat as (select lat as a, lead(lat) over (order by lat) as b from (select distinct lat from grid)), slon as (select lon as a, lead(lon) over (order by lon) as b from (select distinct lon from grid)), {TARGET},
    tlat as (select distinct lat from target), tlon as (select distinct lon from target),
    wlat as (select t.lat as dlat, unnest([a, b]) as lat, unnest([1 - (t.lat - a) / (b - a), (t.lat - a) / (b - a)]) as w from tlat t join slat on t.lat >= a and t.lat < b),
    wlon as (select t.lon as dlon, unnest([a, b]) as lon, unnest([1 - (t.lon - a) / (b - a), (t.lon - a) / (b - a)]) as w from tlon t join slon on t.lon >= a and t.lon < b)
    select time, cast(dlat as double) as lat, cast(dlon as double) as lon, round(sum(value * wlat.w * wlon.w), 4) as value from grid join wlat using (lat) join wlon using (lon) where wlat.w * wlon.w > 0 group by 1, 2, 3""")
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return s.regrid(grid(spark, d), _target(spark), "bilinear", ["time"]).withColumn("value", F.round("value", 4))


@query(f"""with {GRID}, {TARGET}, tlat as (select t.lat as dlat, first(s.lat order by abs(s.lat - t.lat), -s.lat) as lat from (select distinct lat from target) t, (select distinct lat from grid) s group by 1),
    tlon as (select t.lon as dlon, first(s.lon order by abs(s.lon - t.lon), -s.lon) as lon from (select distinct lon from target) t, (select distinct lon from grid) s group by 1)
    select time, cast(dlat as double) as lat, cast(dlon as double) as lon, value from grid join tlat using (lat) join tlon using (lon)""")
def regrid_nearest(spark: SparkSession, d: str) -> DataFrame:
    return s.regrid(grid(spark, d), _target(spark), "nearest_s2d", ["time"])
