"""Areas, polygons and grids.

Masks and weights are tables of cells: of the grid's size, not the data's. They are made
from the grid's coordinates and joined to the data on (lat, lon).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AGGREGATES = ("sum", "mean", "weighted_mean")
Ring = Sequence[tuple[float, float]]


def _cos(lat: str) -> Column:
    return F.cos(F.radians(F.col(lat)))


def _aggregate(method: str, value: str, lat: str) -> Column:
    v = F.col(value)
    if method == "weighted_mean":
        return F.try_divide(F.sum(v * _cos(lat)), F.sum(F.when(v.isNotNull(), _cos(lat))))
    made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median}
    if method not in made:
        raise ValueError(f"unknown aggregate {method}")
    return made[method](v)


def aggregate(df: DataFrame, method: str, by: Sequence[str], value: str = "value", lat: str = "lat") -> DataFrame:
    """Over latitude and longitude: sum, mean, or mean weighted by the cosine of latitude
    over the cells that have values."""
    if method not in AGGREGATES:
        raise ValueError(f"unknown aggregate {method}")
    return df.groupBy(*by).agg(_aggregate(method, value, lat).alias(value))


def edges(shapes: DataFrame, region: str = "region", ring: str = "ring") -> DataFrame:
    """(region, x1, y1, x2, y2): the edges of shapes given as rings of (lon, lat); rings of
    one region count together, so holes and parts are rings of their own."""
    numbered = shapes.withColumn("_next", F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)))
    each = numbered.select(region, F.explode(F.arrays_zip(F.col(ring).alias("p"), F.col("_next").alias("q"))).alias("e"))
    return each.select(region, F.col("e.p.lon").alias("x1"), F.col("e.p.lat").alias("y1"), F.col("e.q.lon").alias("x2"), F.col("e.q.lat").alias("y2"))


def inside(points: DataFrame, shapes: DataFrame, lat: str = "lat", lon: str = "lon", region: str = "region") -> DataFrame:
    """(region, point columns) for points in a shape: a ray to the east crosses its edges an
    odd number of times. Edges are half open: points on the lower or left side belong.

    Each edge meets the points in its band of latitude, found through whole degrees.
    """
    e = edges(shapes, region).where("y1 <> y2").select("*", F.least("y1", "y2").alias("lo"), F.greatest("y1", "y2").alias("hi"))
    e = e.select("*", F.explode(F.sequence(F.floor("lo"), F.floor("hi"))).alias("band"))
    p = points.withColumn("band", F.floor(lat))
    hit = p.join(e, "band").where((F.col(lat) >= F.col("lo")) & (F.col(lat) < F.col("hi")))
    cross = F.col("x1") + (F.col(lat) - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    return hit.where(cross > F.col(lon)).groupBy(region, *points.columns).agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def centre_mask(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """(region, lat, lon) for cells whose centre is in the region."""
    return inside(cells.select("lat", "lon").distinct(), shapes)


def overlap_fractions(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """(region, lat, lon, frac): share of a 10 x 10 lattice of points of each cell that lies
    in the region. Cells are as wide as the first two coordinates are apart."""

    def spread(dim: str) -> DataFrame:
        c = cells.select(dim).distinct()
        one = c.agg(F.min(dim).alias("_lo"), F.sort_array(F.collect_set(dim))[1].alias("_second"))
        parts = F.array(*[F.lit(k) for k in range(10)])
        return c.crossJoin(F.broadcast(one)).select(dim, F.explode(F.transform(parts, lambda k: F.col(dim) + (F.col("_second") - F.col("_lo")) * ((k + 0.5) / 10 - 0.5))).alias(f"_{dim}"))

    points = cells.select("lat", "lon").distinct().join(spread("lat"), "lat").join(spread("lon"), "lon")
    return inside(points, shapes, "_lat", "_lon").groupBy("region", "lat", "lon").agg((F.count("*") / 100).alias("frac"))


def overlap_mask(cells: DataFrame, shapes: DataFrame, threshold: float) -> DataFrame:
    """Cells of which strictly more than ``threshold``, within (0, 1], lies in the region."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies within (0, 1]")
    return overlap_fractions(cells, shapes).where(F.col("frac") > threshold).select("region", "lat", "lon")


def buffered(cells: DataFrame, shapes: DataFrame, degrees: float) -> DataFrame:
    """(region, lat, lon) for cells whose centre is in the region or within ``degrees`` of its
    outline, distances taken on the plane of degrees; ``projected_buffer`` takes them on a projection."""
    e = edges(shapes)
    c = cells.select("lat", "lon").distinct()
    near = c.join(e, F.col("lat").between(F.least("y1", "y2") - degrees, F.greatest("y1", "y2") + degrees) & F.col("lon").between(F.least("x1", "x2") - degrees, F.greatest("x1", "x2") + degrees))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("lon") - F.col("x1")) * dx + (F.col("lat") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    away = F.sqrt(F.pow(F.col("lon") - F.col("x1") - t * dx, 2) + F.pow(F.col("lat") - F.col("y1") - t * dy, 2))
    return near.where(away <= degrees).select("region", "lat", "lon").union(centre_mask(cells, shapes).select("region", "lat", "lon")).distinct()


# The WGS 84 ellipsoid (metres; eccentricity) and metres of a buffer's degree.
AXIS, ECCENTRICITY, DEGREE = 6378137.0, 0.0818191908426215, 111_320.0


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres on the ellipsoidal Mercator projection."""
    wave = ECCENTRICITY * F.sin(F.radians(lat))
    upright = F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) + ECCENTRICITY / 2 * F.ln((1 - wave) / (1 + wave))
    return AXIS * F.radians(lon), AXIS * upright


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """An outline without the points that lie within ``tolerance`` of the line that the others make (Douglas and
    Peucker); what would be left with no area stays whole. A small helper for one ring."""
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        dx, dy = x2 - x1, y2 - y1
        far, at = tolerance, 0
        for i in range(a + 1, b):
            x, y = points[i]
            t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            away = math.hypot(x - x1 - t * dx, y - y1 - t * dy)
            if away > far:
                far, at = away, i
        if at:
            keep.add(at)
            spans += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)] if len(keep) > 3 else points


def projected_buffer(cells: DataFrame, shapes: DataFrame, degrees: float, tolerance: float = 10_000.0) -> DataFrame:
    """(region, lat, lon) for cells whose centre is within ``degrees`` (of 111.32 km of the projection) of a shape, or in it: shapes
    are put on the Mercator projection, their outlines simplified by up to ``tolerance`` metres, and distances taken there.

    Metres of the projection grow away from the equator, there a degree of longitude stays a degree, and
    one of latitude becomes larger; at 40 degrees a buffer of 1 reaches 0.77 degrees north and south and 1 east and west.
    """
    def placed(p: Column) -> Column:
        x, y = mercator(p["lat"], p["lon"])
        return F.struct((x / DEGREE).alias("lon"), (y / DEGREE).alias("lat"))

    rings = shapes.select("region", F.transform("ring", placed).alias("ring"))

    def coarser(batches):
        for pdf in batches:
            made = []
            for ring in pdf["ring"]:
                outline = [(p["lon"], p["lat"]) for p in ring]
                closed = outline if outline[0] == outline[-1] else [*outline, outline[0]]
                made.append([{"lon": a, "lat": b} for a, b in simplified(closed, tolerance / DEGREE)[:-1]])
            yield pdf.assign(ring=made)[["region", "ring"]]

    flat = rings.mapInPandas(coarser, "region string, ring array<struct<lon double, lat double>>")
    u, v = (c / DEGREE for c in mercator(F.col("_lat"), F.col("_lon")))
    places = cells.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct().select("_lat", "_lon", v.alias("lat"), u.alias("lon"))
    near = buffered(places.select("lat", "lon"), flat, degrees)
    return near.join(places, ["lat", "lon"]).select("region", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))


def with_combined(mask: DataFrame, name: str = "all") -> DataFrame:
    """The mask with one more region, the union of all."""
    return mask.select("region", "lat", "lon").unionByName(mask.select(F.lit(name).alias("region"), "lat", "lon").distinct())


def select_regions(df: DataFrame, mask: DataFrame, agg: str | None, by: Sequence[str], value: str = "value", combine: bool = False, shapes: DataFrame | None = None) -> DataFrame:
    """(region, by..., value) over the cells of each region; with no ``agg`` the cells
    themselves. ``combine`` adds the region ``all`` and goes with weighted means only.
    With ``shapes`` given, a shape that caught no cell is an error."""
    if combine and agg not in (None, "weighted_mean"):
        raise ValueError("shapes are combined for weighted means only")
    if shapes is not None:
        empty = [r["region"] for r in shapes.select("region").distinct().join(mask, "region", "left_anti").take(5)]
        if empty:
            raise ValueError(f"no cells in {empty}")
    joined = df.join(with_combined(mask) if combine else mask.select("region", "lat", "lon"), ["lat", "lon"])
    if agg in (None, "none"):
        return joined
    return joined.groupBy("region", *by).agg(_aggregate(agg, value, "lat").alias(value))


def create_grid(spark: SparkSession, name: str, lat_offset: float = 0.0, lon_offset: float = 0.0) -> DataFrame:
    """(lat, lon): cell centres of a named grid ``AUSXXXi`` with steps of XXX hundredths of a
    degree inside a fixed box, to two decimals; offsets in degrees are added after."""
    found = re.fullmatch(r"AUS(\d{3})i", name)
    if not found:
        raise ValueError(f"not a grid name: {name}")
    step = int(found[1]) / 100
    box = {"lat": (-44.5, -10.0, lat_offset), "lon": (112.0, 156.25, lon_offset)}  # fixed values: south, north; west, east
    axes = [spark.createDataFrame([(float(x + more),) for x in np.arange(lo + step / 2, hi - step / 2, step).round(2)], f"{dim} double") for dim, (lo, hi, more) in box.items()]
    return axes[0].crossJoin(axes[1])


def _bounds(cells: DataFrame, dim: str) -> DataFrame:
    """(dim, lo, hi): midpoints to the neighbours, the end cells as wide as their neighbours."""
    w = Window.orderBy(dim)
    before, after = F.lag(dim).over(w), F.lead(dim).over(w)
    c = F.col(dim)
    return cells.select(dim).distinct().select(dim, (c - F.coalesce(c - before, after - c) / 2).alias("lo"), (c + F.coalesce(after - c, c - before) / 2).alias("hi"))


def _axis_overlap(source: DataFrame, target: DataFrame, dim: str, length: Column) -> DataFrame:
    s = _bounds(source, dim).select(F.col(dim).alias(f"src_{dim}"), F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    t = _bounds(target, dim).select(F.col(dim).alias(f"dst_{dim}"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    met = s.join(t, (F.col("slo") < F.col("thi")) & (F.col("tlo") < F.col("shi"))).withColumn("a", F.greatest("slo", "tlo")).withColumn("b", F.least("shi", "thi"))
    return met.select(f"src_{dim}", f"dst_{dim}", length.alias(f"w_{dim}"))


def conservative_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """(src_lat, src_lon, dst_lat, dst_lon, weight): shares of each target cell's area on the
    sphere; axes are worked out apart and joined."""
    lat = _axis_overlap(source, target, "lat", F.sin(F.radians("b")) - F.sin(F.radians("a")))
    lon = _axis_overlap(source, target, "lon", F.col("b") - F.col("a"))
    both = lat.crossJoin(lon).withColumn("w", F.col("w_lat") * F.col("w_lon"))
    area = F.sum("w").over(Window.partitionBy("dst_lat", "dst_lon"))
    return both.select("src_lat", "src_lon", "dst_lat", "dst_lon", (F.col("w") / area).alias("weight"))


def bilinear_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """The four neighbours of each target point inside the source grid's hull."""

    def axis(dim: str) -> DataFrame:
        w = Window.orderBy(dim)
        s = source.select(dim).distinct().select(F.col(dim).alias("a"), F.lead(dim).over(w).alias("b"), F.row_number().over(w.orderBy(F.desc(dim))).alias("last")).where("b is not null")
        t = target.select(F.col(dim).alias(f"dst_{dim}")).distinct()
        x = F.col(f"dst_{dim}")
        met = t.join(s, (x >= F.col("a")) & ((x < F.col("b")) | ((F.col("last") == 2) & (x == F.col("b")))))
        part = (x - F.col("a")) / (F.col("b") - F.col("a"))
        pair = F.array(F.struct(F.col("a").alias("c"), (1 - part).alias("w")), F.struct(F.col("b").alias("c"), part.alias("w")))
        return met.select(f"dst_{dim}", F.explode(pair).alias("p")).select(F.col("p.c").alias(f"src_{dim}"), f"dst_{dim}", F.col("p.w").alias(f"w_{dim}"))

    both = axis("lat").crossJoin(axis("lon"))
    return both.select("src_lat", "src_lon", "dst_lat", "dst_lon", (F.col("w_lat") * F.col("w_lon")).alias("weight")).where("weight > 0")


def nearest_weights(source: DataFrame, target: DataFrame, to: str = "source") -> DataFrame:
    """Each target cell's nearest source cell, or each source cell's nearest target cell
    (``to="target"``), along each axis on its own, ties to the larger coordinate."""
    own, other, a, b = (target, source, "dst", "src") if to == "source" else (source, target, "src", "dst")

    def axis(dim: str) -> DataFrame:
        x, y = own.select(F.col(dim).alias(f"{a}_{dim}")).distinct(), other.select(F.col(dim).alias(f"{b}_{dim}")).distinct()
        away = F.struct(F.abs(F.col(f"{a}_{dim}") - F.col(f"{b}_{dim}")), -F.col(f"{b}_{dim}"))
        return x.crossJoin(y).groupBy(f"{a}_{dim}").agg(F.min_by(f"{b}_{dim}", away).alias(f"{b}_{dim}"))

    return axis("lat").crossJoin(axis("lon")).select("src_lat", "src_lon", "dst_lat", "dst_lon", F.lit(1.0).alias("weight"))


WEIGHTS = {"conservative": conservative_weights, "bilinear": bilinear_weights, "nearest_s2d": nearest_weights, "nearest_d2s": lambda s, t: nearest_weights(s, t, "target")}


def regrid(df: DataFrame, target: DataFrame, method: str, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by..., lat, lon, value) on the grid ``target`` (lat, lon): weighted sums; missing where
    any cell that counts is missing. The weights are a table of the grids' size."""
    if method not in WEIGHTS:
        raise ValueError(f"unknown method {method}")
    w = WEIGHTS[method](df.select("lat", "lon"), target)
    joined = df.join(w, (F.col("lat") == F.col("src_lat")) & (F.col("lon") == F.col("src_lon")))
    whole = F.count(F.when(F.col(value).isNull(), 1)) == 0
    return joined.groupBy(*by, "dst_lat", "dst_lon").agg(F.when(whole, F.sum(F.col(value) * F.col("weight"))).alias(value)).select(*by, F.col("dst_lat").alias("lat"), F.col("dst_lon").alias("lon"), value)


def ring_of_box(west: float, south: float, east: float, north: float) -> list[tuple[float, float]]:
    """(lon, lat) corners."""
    return [(west, south), (east, south), (east, north), (west, north)]


def shapes_table(spark: SparkSession, shapes: dict[str, Ring]) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in shapes.items()], "region string, ring array<struct<lon: double, lat: double>>")

