"""The chain from files to an analysis-ready table, in its fixed order."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.dims import DIMS, Dims
from tailcast.functions import units as u
from tailcast.functions.indices import rolling_sum
from tailcast.operators import selection as s
from tailcast.operators import spatial, temporal
from tailcast.operators.reshape import to_init_lead
from tailcast.sources import files

# What the fire index is made of, and in which units.
FFDI_INPUTS = {"pr": "mm day-1", "hur": "%", "tasmax": "degC", "uas": "km/h", "vas": "km/h"}


@dataclass(frozen=True)
class OpenSpec:
    """What to do between reading and analysis; steps that are not asked for are left out."""

    variables: tuple[str, ...] = ()
    dims: Dims = DIMS
    file_format: str | None = None
    metadata: dict = field(default_factory=dict)
    isel: dict[str, int | slice] = field(default_factory=dict)
    sel: dict[str, object] = field(default_factory=dict)
    months: tuple[int, ...] = ()
    init_month: bool = False
    scale_factors: dict[str, float | str] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    units_timing: str = "end"
    regrid: DataFrame | None = None
    regrid_method: str = "conservative"
    point: tuple[float, float] | None = None
    lat_bnds: tuple[float, float] | None = None
    lon_bnds: tuple[float, float] | None = None
    shapes: DataFrame | None = None
    shape_overlap: float | None = None
    #: In degrees.
    shape_buffer: float | None = None
    combine_shapes: bool = False
    spatial_agg: str | None = None
    #: What spatial_agg aggregates over, if not latitude and longitude.
    agg_y_dim: str | None = None
    agg_x_dim: str | None = None
    no_leap_days: bool = False
    rolling_sum_window: int | None = None
    time_freq: str | None = None
    time_agg: str | None = None
    time_agg_dates: bool = False
    min_tsteps: int | None = None
    season: str | None = None
    reset_times: bool = False
    input_freq: str = "D"
    squeeze: bool = True

    def __post_init__(self) -> None:
        if self.units_timing not in ("start", "middle", "end"):
            raise ValueError("units_timing is start, middle or end")
        if self.time_freq and not self.time_agg:
            raise ValueError("time_freq needs time_agg")


def for_indices(spec: OpenSpec) -> OpenSpec:
    """If ``ffdi`` is asked for, its inputs in its units."""
    if "ffdi" not in spec.variables:
        return spec
    return replace(spec, variables=tuple(FFDI_INPUTS), units=FFDI_INPUTS | {k: v for k, v in spec.units.items() if k != "ffdi"})


def _convert(df: DataFrame, spec: OpenSpec) -> DataFrame:
    for name, target in spec.units.items():
        if name in df.columns:
            source = files.unit_of(df, name) or target
            df = files.with_unit(df.withColumn(name, u.convert_units(F.col(name), source, target).alias(name)), name, target)
    return df


def prepare(df: DataFrame, spec: OpenSpec) -> DataFrame:
    """All steps on a table whose columns are dims and variables. The order counts: rolling
    sums come after areas and before bins, and leap days go before windows close over them."""
    spec, d = for_indices(spec), spec.dims
    unit = {c: files.unit_of(df, c) for c in df.columns}
    df = files.fix_metadata(df, spec.metadata)
    unit |= {c: files.unit_of(df, c) for c in df.columns}
    y, x = spec.agg_y_dim or d.lat, spec.agg_x_dim or d.lon
    places = [c for c in dict.fromkeys((d.time, d.lat, d.lon, d.ensemble, d.init_date, d.lead_time, y, x)) if c in df.columns]
    values = list(spec.variables) or [c for c, t in df.dtypes if c not in places and t in ("double", "float", "int", "bigint")]
    df = s.project(df, values, places)

    def kept_units(made: DataFrame) -> DataFrame:
        for v in values:
            if unit.get(v) and v in made.columns:
                made = files.with_unit(made, v, unit[v])
        return made

    for dim, which in spec.isel.items():
        df = s.isel(df, dim, which)
    for dim, which in spec.sel.items():
        df = s.sel(df, dim, which)
    if spec.months:
        df = s.select_months(df, spec.months, d.time, spec.init_month)
    for v, by in spec.scale_factors.items():
        df = df.withColumn(v, u.scaled(F.col(v), by, F.col(d.time) if d.time in df.columns else None))
    df = kept_units(df)
    if spec.units_timing == "start":
        df = _convert(df, spec)
    unit |= {v: files.unit_of(df, v) for v in values}

    def others(*less: str) -> list[str]:
        return [c for c in df.columns if c not in (*values, *less)]

    def each(apply, by: list[str]) -> DataFrame:
        """A step that works on one variable, given its name and what else locates a value; several
        variables go through it together, as rows of one column."""
        if len(values) == 1:
            return kept_units(apply(df, values[0], by))
        one, name = "_value", "_variable"
        typed = df.select(*[c for c in df.columns if c not in values], *[F.col(v).cast("double").alias(v) for v in values])
        made = apply(typed.unpivot([c for c in df.columns if c not in values], values, name, one), one, [*by, name])
        keys = [c for c in made.columns if c not in (one, name, "event_time")]
        wide = made.groupBy(*keys).pivot(name, values).agg(F.first(one, ignorenulls=True))
        if "event_time" in made.columns:  # the first variable's, as one column has room for
            dates = made.where(F.col(name) == values[0]).select(*keys, "event_time")
            wide = wide.join(dates, keys, "left")
        return kept_units(wide)

    if spec.regrid is not None:
        by = others(d.lat, d.lon)
        df = each(lambda one, v, by: spatial.regrid(one.withColumnsRenamed({d.lat: "lat", d.lon: "lon"}), spec.regrid, spec.regrid_method, by, v).withColumnsRenamed({"lat": d.lat, "lon": d.lon}), by)
    if spec.point:
        df = s.select_point(df, *spec.point, d.lat, d.lon)
    if spec.lat_bnds:
        df = s.subset_lat(df, *spec.lat_bnds, d.lat)
    if spec.lon_bnds:
        df = s.subset_lon(s.within_longitudes(df, spec.lon_bnds, d.lon), *spec.lon_bnds, d.lon)
    if spec.shapes is not None:
        by = others(d.lat, d.lon)
        cells = df.select(F.col(d.lat).alias("lat"), F.col(d.lon).alias("lon")).distinct()
        if spec.shape_buffer:
            mask = spatial.projected_buffer(cells, spec.shapes, spec.shape_buffer)
        elif spec.shape_overlap:
            mask = spatial.overlap_mask(cells, spec.shapes, spec.shape_overlap)
        else:
            mask = spatial.centre_mask(cells, spec.shapes)
        df = each(lambda one, v, by: spatial.select_regions(one.withColumnsRenamed({d.lat: "lat", d.lon: "lon"}), mask, spec.spatial_agg, by, v, spec.combine_shapes, spec.shapes), by)
    elif spec.spatial_agg:
        df = each(lambda one, v, by: spatial.aggregate(one, spec.spatial_agg, by, v, y), others(y, x))
    df = kept_units(df)
    if spec.units_timing == "middle":
        df = _convert(df, spec)
        unit |= {v: files.unit_of(df, v) for v in values}
    if spec.no_leap_days:
        df = s.drop_leap_days(df, d.time)
    if spec.rolling_sum_window:
        by = others(d.time)
        df = df.withColumns({v: rolling_sum(F.col(v), spec.rolling_sum_window, by, d.time) for v in values})
    if spec.time_freq:
        by = others(d.time)
        df = each(lambda one, v, by: temporal.temporal_aggregation(one, spec.time_freq, spec.time_agg, v, d.time, by, spec.input_freq, spec.season, spec.min_tsteps, spec.time_agg_dates, spec.reset_times), by)
        if spec.time_agg == "sum":
            unit = {v: u.rate_after_sum(unit[v], spec.input_freq, spec.time_freq) if unit.get(v) else None for v in unit}
    df = kept_units(df)
    if spec.units_timing == "end":
        df = _convert(df, spec)
    return s.squeeze(df, [c for c in df.columns if c in (d.lat, d.lon, d.ensemble)]) if spec.squeeze else df


def open_dataset(spark: SparkSession, infiles: Sequence[str] | str, spec: OpenSpec | None = None) -> DataFrame:
    spec = spec or OpenSpec()
    return prepare(files.read(spark, infiles, spec.file_format, variables=stored_variables(spec)), spec)


def stored_variables(spec: OpenSpec) -> list[str]:
    """The names that the files have for the variables that are asked for."""
    before = {new: old for old, new in spec.metadata.get("rename", {}).items()}
    return [before.get(v, v) for v in for_indices(spec).variables]


def open_forecasts(spark: SparkSession, names: Sequence[str] | str, spec: OpenSpec | None = None, n_time_files: int = 1, n_ensemble_files: int = 1) -> DataFrame:
    """Forecasts from an ordered list of files: times fastest, then members, then starts.

    All files are one scan; a table of the list (as long as the list) tells each file's
    start and member, and leads are counted within them. Files that hold members already
    have an ``ensemble`` column.
    """
    spec = spec or OpenSpec()
    listed = files.file_list(spark, names)
    places = [(re.sub("^file:/+", "/", f.rstrip("/")), i, e) for i, start in enumerate(files.nested(listed, n_time_files, n_ensemble_files)) for e, member in enumerate(start) for f in member]
    known = spark.createDataFrame(places, "_file string, _start int, _member int")
    path = F.regexp_replace(F.col("_path"), "^file:/+", "/")
    either = F.array(path, F.regexp_replace(path, "/[^/]*$", ""))  # listed is a file, or the folder that holds it
    rows = files.read(spark, listed, spec.file_format, "_path", stored_variables(spec)).withColumn("_file", F.explode(either))
    joined = files.fix_metadata(rows.join(F.broadcast(known), "_file").drop("_file", "_path"), spec.metadata)
    if spec.dims.ensemble not in joined.columns:
        joined = joined.withColumn(spec.dims.ensemble, F.col("_member"))
    cells = [c for c in (spec.dims.lat, spec.dims.lon) if c in joined.columns]
    prepared = to_init_lead(joined, spec.dims.time, ["_start", spec.dims.ensemble, *cells])
    first = prepared.groupBy("_start").agg(F.min("init_date").alias("_first"))
    prepared = prepared.join(F.broadcast(first), "_start").withColumn("init_date", F.col("_first")).drop("_start", "_first", "_member")
    return prepare(prepared, replace(spec, metadata={}))
