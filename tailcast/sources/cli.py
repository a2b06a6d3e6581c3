"""The programs: ``python -m tailcast.sources.cli <program> ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.dims import Dims
from tailcast.operators import bias, gevfit, independence, moments, selection, similarity
from tailcast.plans import plotdata, stability
from tailcast.sources import files
from tailcast.sources.dataset import OpenSpec, open_dataset, open_forecasts


class Pairs(argparse.Action):
    """``a=1 b=2:5 c=x`` as a dict: whole numbers, slices, floats, else text."""

    def __call__(self, parser, namespace, values, option_string=None) -> None:
        setattr(namespace, self.dest, dict(self.pair(v) for v in values))

    @staticmethod
    def number(text: str) -> int | float | str:
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
        return text

    @classmethod
    def pair(cls, text: str) -> tuple[str, object]:
        key, _, value = text.partition("=")
        if ":" in value:
            return key, slice(*[cls.number(x) if x else None for x in value.split(":")])
        return key, cls.number(value)


#: Options that name the columns of dimensions.
DIM_OPTIONS = {"time": "time_dim", "lat": "lat_dim", "lon": "lon_dim", "ensemble": "ensemble_dim", "init_date": "init_dim", "lead_time": "lead_dim"}


def _names(p: argparse.ArgumentParser, *dims: str) -> None:
    for dim in dims:
        p.add_argument(f"--{DIM_OPTIONS[dim]}", dest=f"dim_{dim}", default=dim)


def _session(p: argparse.ArgumentParser) -> None:
    p.add_argument("--dask_config", "--session_config", dest="session_config", help="a YAML file of the session's master and settings")
    p.add_argument("--output_chunks", nargs="*", action=Pairs, default={}, help="dimensions whose ranges the parts of the output hold")


def _outfile(p: argparse.ArgumentParser) -> None:
    """In its place, or by name."""
    p.add_argument("outfile", nargs="?")
    p.add_argument("--outfile", dest="named_outfile")


def lead(text: str) -> int | str:
    """A number of leads, or the name of a table of them by month."""
    return int(text) if text.lstrip("-").isdigit() else text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tailcast", description="Analysis of large forecast ensembles")
    sub = p.add_subparsers(dest="program", required=True)

    f = sub.add_parser("fileio", help="prepare files for analysis")
    f.add_argument("infiles", nargs="*")
    f.add_argument("outfile")
    f.add_argument("--forecast", action="store_true")
    f.add_argument("--n_ensemble_files", type=int, default=1)
    f.add_argument("--n_time_files", type=int, default=1)
    f.add_argument("--metadata_file")
    f.add_argument("--variables", nargs="*", default=[])
    f.add_argument("--isel", nargs="*", action=Pairs, default={})
    f.add_argument("--sel", nargs="*", action=Pairs, default={})
    f.add_argument("--months", nargs="*", type=int, default=[])
    f.add_argument("--init_month", action="store_true")
    f.add_argument("--season", choices=["DJF", "MAM", "JJA", "SON"])
    f.add_argument("--time_freq")
    f.add_argument("--time_agg", choices=["mean", "max", "min", "sum"])
    f.add_argument("--time_agg_dates", action="store_true")
    f.add_argument("--time_agg_min_tsteps", type=int)
    f.add_argument("--reset_times", action="store_true")
    f.add_argument("--input_freq", choices=["M", "D", "Q", "Y"], default="D")
    f.add_argument("--no_leap_days", action="store_true")
    f.add_argument("--rolling_sum_window", type=int)
    f.add_argument("--anomaly", nargs=2)
    f.add_argument("--anomaly_freq", choices=["month"])
    f.add_argument("--regrid_grid", "--regrid_name", dest="regrid_grid", help="the name of a grid, or a file that has its cells")
    f.add_argument("--regrid_lat_offset", type=float, default=0.0)
    f.add_argument("--regrid_lon_offset", type=float, default=0.0)
    f.add_argument("--regrid_method", default="conservative")
    f.add_argument("--point_selection", nargs=2, type=float)
    f.add_argument("--lat_bnds", nargs=2, type=float)
    f.add_argument("--lon_bnds", nargs=2, type=float)
    f.add_argument("--shapefile")
    f.add_argument("--shp_overlap", type=float)
    f.add_argument("--shp_buffer", type=float)
    f.add_argument("--shp_header", help="the column of the shapes that names them")
    f.add_argument("--combine_shapes", action="store_true")
    f.add_argument("--standard_calendar", action="store_true", help="dates of tables are of the standard calendar in any case")
    _names(f, *DIM_OPTIONS)
    f.add_argument("--agg_y_dim", help="the dimension that --spatial_agg takes for latitude")
    f.add_argument("--agg_x_dim", help="the dimension that --spatial_agg takes for longitude")
    f.add_argument("--input_chunks", nargs="*", action=Pairs, default={}, help="taken and left: Spark splits what it reads by bytes")
    f.add_argument("--verbose", action="store_true", help="print the files of each start and member")
    _session(f)
    f.add_argument("--spatial_agg", choices=["mean", "sum", "weighted_mean"])
    f.add_argument("--units", nargs="*", action=Pairs, default={})
    f.add_argument("--units_timing", choices=["start", "middle", "end"], default="end")
    f.add_argument("--scale_factors", nargs="*", action=Pairs, default={})
    f.add_argument("--lead_dim_max_size", type=int)
    f.add_argument("--partition_by", nargs="*", default=[])

    i = sub.add_parser("independence", help="from which lead on members are independent")
    for name in ("fcst_file", "var", "outfile"):
        i.add_argument(name)
    i.add_argument("--confidence_interval", type=float, default=0.95)
    i.add_argument("--n_resamples", type=int, default=100)
    i.add_argument("--spatial_selection", nargs="*", action=Pairs, default={})
    i.add_argument("--plot_outfile")
    _names(i, "ensemble", "init_date", "lead_time")
    _session(i)

    s = sub.add_parser("similarity", help="tests of model against observations")
    for name in ("fcst_file", "obs_file", "var", "outfile"):
        s.add_argument(name)
    s.add_argument("--reference_time_period", nargs=2)
    s.add_argument("--min_lead", type=lead)
    s.add_argument("--min_lead_kwargs", nargs="*", action=Pairs, default={})
    s.add_argument("--by_lead", action="store_true")
    s.add_argument("--regrid", choices=["obs", "fcst"])
    s.add_argument("--regrid_method", default="conservative")
    s.add_argument("--plot_outfile")
    _names(s, "time", "ensemble", "init_date", "lead_time")
    _session(s)

    b = sub.add_parser("bias_correction", help="take the model's bias out")
    for name in ("fcst_file", "obs_file", "var"):
        b.add_argument(name)
    b.add_argument("method", choices=bias.METHODS)
    b.add_argument("outfile")
    b.add_argument("--base_period", nargs=2)
    b.add_argument("--rounding_freq", choices=["M", "D", "A"], default="A")
    b.add_argument("--min_lead", type=lead)
    b.add_argument("--min_lead_kwargs", nargs="*", action=Pairs, default={})
    b.add_argument("--by_lead", action="store_true")
    b.add_argument("--regrid", choices=["obs", "fcst"])
    b.add_argument("--regrid_method", default="conservative")
    _names(b, "init_date", "lead_time")
    _session(b)

    t = sub.add_parser("stability", help="distributions by lead and by time")
    for name in ("fcst_file", "var"):
        t.add_argument(name)
    _outfile(t)
    t.add_argument("--start_years", nargs="+", type=int, required=True)
    t.add_argument("--uncertainty", action="store_true")
    t.add_argument("--return_method", choices=["empirical", "gev"], default="empirical")
    t.add_argument("--units", default="", help="kept with the values")
    t.add_argument("--ylim", nargs=2, type=float, help="the range of the values that are drawn")
    _names(t, "ensemble", "init_date", "lead_time")

    m = sub.add_parser("moments", help="moments of observations in the model's intervals")
    for name in ("fcst_file", "obs_file", "var"):
        m.add_argument(name)
    _outfile(m)
    m.add_argument("--bias_file")
    m.add_argument("--min_lead", type=lead)
    m.add_argument("--min_lead_kwargs", nargs="*", action=Pairs, default={})
    m.add_argument("--n_resamples", type=int, default=1000)
    m.add_argument("--units", default="")
    m.add_argument("--plot_outfile")
    _names(m, "ensemble", "init_date", "lead_time")

    e = sub.add_parser("eva", help="fits of the generalised extreme value distribution")
    for name in ("file", "var", "outfile"):
        e.add_argument(name)
    e.add_argument("--stack_dims", nargs="*", default=["ensemble", "init_date", "lead_time", "time"])
    e.add_argument("--core_dim", default="time", help="the dimension along which values are fitted, if none are stacked")
    e.add_argument("--stationary", action="store_true", help="the default")
    e.add_argument("--nonstationary", action="store_true")
    e.add_argument("--file_kwargs", nargs="*", action=Pairs, default={}, help="fields of OpenSpec for the file: time_freq=YE-DEC time_agg=max")
    _names(e, "ensemble", "init_date", "lead_time")
    e.add_argument("--fitstart", choices=gevfit.STARTS, default="LMM")
    e.add_argument("--retry_fit", action="store_true")
    e.add_argument("--use_basinhopping", action="store_true")
    e.add_argument("--assert_good_fit", action="store_true")
    e.add_argument("--pick_best_model", choices=gevfit.TESTS)
    e.add_argument("--covariate", default="time.year")
    e.add_argument("--covariate_file")
    e.add_argument("--min_lead", type=lead)
    e.add_argument("--min_lead_kwargs", nargs="*", action=Pairs, default={})
    e.add_argument("--drop_max", action="store_true")
    e.add_argument("--plot_outfile")
    e.add_argument("--n_resamples", type=int, default=1000)
    e.add_argument("--reference_time_period", nargs=2)
    return p


def _masked(spark: SparkSession, df: DataFrame, least: int | str | None, value: str, which: dict) -> DataFrame:
    """``which`` picks rows of a table of least leads."""
    if least is None or isinstance(least, int):
        return df if least is None else selection.mask_leads(df, least, value)
    known = files.read(spark, least)
    for dim, labels in which.items():
        known = selection.sel(known, dim, labels)
    return selection.mask_leads(df, known, value)


def _shapes(spark: SparkSession, name: str, header: str | None) -> DataFrame:
    found = files.read(spark, name)
    return found.drop("region").withColumnRenamed(header, "region") if header and header != "region" else found


def _dims(a: argparse.Namespace) -> Dims:
    return Dims(**{d: getattr(a, f"dim_{d}", d) for d in DIM_OPTIONS})


def _value(df: DataFrame, var: str, a: argparse.Namespace) -> DataFrame:
    """The variable as ``value``, and dimensions by the names that the operators know."""
    for dim in DIM_OPTIONS:
        df = df.withColumnRenamed(getattr(a, f"dim_{dim}", dim), dim)
    return df.withColumnRenamed(var, "value")


def _parts(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Rows put into parts by ranges of the dimensions that were named."""
    named = [c for c in a.output_chunks if c in df.columns]
    return df.repartitionByRange(*named) if named else df


def _cells(df: DataFrame) -> list[str]:
    return [c for c in ("lat", "lon", "region") if c in df.columns]


def _one_grid(fcst: DataFrame, obs: DataFrame, which: str | None, method: str) -> tuple[DataFrame, DataFrame]:
    from tailcast.operators.spatial import regrid

    if which == "obs":
        obs = regrid(obs, fcst.select("lat", "lon").distinct(), method, ["time"])
    elif which == "fcst":
        fcst = regrid(fcst, obs.select("lat", "lon").distinct(), method, ["init_date", "ensemble", "lead_time", "time"])
    return fcst, obs


def fileio(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from tailcast.operators.spatial import create_grid
    from tailcast.operators.temporal import anomalies, forecast_anomalies

    grid = None
    if a.regrid_grid:
        grid = create_grid(spark, a.regrid_grid, a.regrid_lat_offset, a.regrid_lon_offset) if a.regrid_grid.startswith("AUS") else files.read(spark, a.regrid_grid).select("lat", "lon").distinct()
    spec = OpenSpec(
        variables=tuple(a.variables), metadata=files.load_metadata(a.metadata_file) if a.metadata_file else {}, isel=a.isel, sel=a.sel, months=tuple(a.months), init_month=a.init_month,
        scale_factors=a.scale_factors, units=a.units, units_timing=a.units_timing, regrid=grid, regrid_method=a.regrid_method, point=a.point_selection, lat_bnds=a.lat_bnds, lon_bnds=a.lon_bnds,
        shapes=_shapes(spark, a.shapefile, a.shp_header) if a.shapefile else None, dims=_dims(a), shape_overlap=a.shp_overlap, shape_buffer=a.shp_buffer, combine_shapes=a.combine_shapes, spatial_agg=a.spatial_agg,
        no_leap_days=a.no_leap_days, rolling_sum_window=a.rolling_sum_window, time_freq=a.time_freq, time_agg=a.time_agg, time_agg_dates=a.time_agg_dates, min_tsteps=a.time_agg_min_tsteps,
        season=a.season, reset_times=a.reset_times, input_freq=a.input_freq, agg_y_dim=a.agg_y_dim, agg_x_dim=a.agg_x_dim,
    )
    if a.verbose and a.forecast:
        for i, start in enumerate(files.nested(files.file_list(spark, a.infiles), a.n_time_files, a.n_ensemble_files)):
            for e, names in enumerate(start):
                print(f"start {i}, member {e}: {' '.join(names)}")
    out = open_forecasts(spark, a.infiles, spec, a.n_time_files, a.n_ensemble_files) if a.forecast else open_dataset(spark, a.infiles, spec)
    if a.anomaly:
        values = list(a.variables) or [c for c, t in out.dtypes if t == "double" and c not in ("lat", "lon")]
        out = forecast_anomalies(out, a.anomaly, values, by=_cells(out)) if a.forecast else anomalies(out, a.anomaly, a.anomaly_freq, values, by=_cells(out))
    if a.lead_dim_max_size:
        out = selection.first_leads(out, a.lead_dim_max_size)
    return out


def run(argv: Sequence[str], spark: SparkSession | None = None) -> None:
    asked = parser()
    a = asked.parse_args(argv)
    a.outfile = getattr(a, "named_outfile", None) or a.outfile
    if not a.outfile:
        asked.error("an outfile is needed")
    spark = spark or files.session_from(files.load_config(a.session_config) if getattr(a, "session_config", None) else {})
    history = files.provenance(argv=["tailcast", *argv])
    if a.program == "fileio":
        return files.write(_parts(fileio(spark, a), a), a.outfile, a.partition_by, history)
    if a.program == "eva":
        df = _value(open_dataset(spark, a.file, replace(OpenSpec(dims=_dims(a)), **a.file_kwargs)), a.var, a)
        df = _masked(spark, df, a.min_lead, "value", a.min_lead_kwargs)
        if a.reference_time_period:
            df = selection.select_time_period(df, a.reference_time_period)
        by = [c for c in df.columns if c not in (*a.stack_dims, "value", "time", a.core_dim)]
        keyed, keys = (df, by) if by else (df.withColumn("all", F.lit(1)), ["all"])
        if a.drop_max:
            keyed = selection.drop_max(keyed, keys)
        covariate = None
        if a.nonstationary:
            if a.covariate_file:
                keyed, covariate = keyed.join(_value(open_dataset(spark, a.covariate_file), a.covariate, a).select("time", F.col("value").alias("covariate")), "time", "left"), "covariate"
            elif a.covariate == "time.year":
                keyed, covariate = keyed.withColumn("covariate", F.year("time")), "covariate"
            else:
                covariate = a.covariate
        fitted = gevfit.fit_gev(keyed, keys, stationary=not a.nonstationary, covariate=covariate, start=a.fitstart, retry=a.retry_fit, assert_good_fit=a.assert_good_fit, pick_best_model=a.pick_best_model, basin_hops=8 if a.use_basinhopping else 0)
        if a.plot_outfile:
            files.write(plotdata.trend_curves(fitted, keyed, covariate, keys) if a.nonstationary else plotdata.gev_return_curve(keyed, keys, a.n_resamples), a.plot_outfile)
        return files.write(fitted, a.outfile, (), history)
    fcst = _value(open_dataset(spark, a.fcst_file, OpenSpec(squeeze=False, dims=_dims(a))), a.var, a)
    fcst = _masked(spark, fcst, getattr(a, "min_lead", None), "value", getattr(a, "min_lead_kwargs", {}))
    if a.program == "independence":
        for dim, which in a.spatial_selection.items():
            fcst = selection.sel(fcst, dim, which)
        r, bounds, least = independence.run_tests(fcst, _cells(fcst), a.n_resamples, a.confidence_interval)
        keys = ["init_month", *_cells(fcst)]
        if a.plot_outfile:
            files.write(r.join(bounds, keys), a.plot_outfile)
        return files.write(_parts(r.join(bounds, keys).join(least, keys), a), a.outfile, (), history)
    if a.program == "stability":
        drawn = stability.summary(fcst, a.start_years, a.return_method, a.uncertainty)
        if a.ylim:
            drawn = drawn.where(F.col("value").between(*a.ylim))
        return files.write(files.with_unit(drawn, "value", a.units) if a.units else drawn, a.outfile, (), history)
    obs = _value(open_dataset(spark, a.obs_file, OpenSpec(squeeze=False, dims=_dims(a))), a.var, a)
    if a.program == "similarity":
        if a.reference_time_period:
            obs = selection.select_time_period(obs, a.reference_time_period)
        fcst, obs = _one_grid(fcst, obs, a.regrid, a.regrid_method)
        tests = similarity.similarity_tests(fcst, obs, _cells(fcst), a.by_lead)
        if a.plot_outfile:
            files.write(plotdata.similarity_map(tests, by=[c for c in tests.columns if not c.startswith(("ks_", "ad_"))]), a.plot_outfile)
        return files.write(_parts(tests, a), a.outfile, (), history)
    if a.program == "bias_correction":
        fcst, obs = _one_grid(fcst, obs, a.regrid, a.regrid_method)
        found = bias.bias(fcst, obs, a.method, a.base_period, a.rounding_freq, a.by_lead, _cells(fcst))
        return files.write(_parts(bias.remove_bias(fcst, found, a.method), a), a.outfile, (), history)
    model = _value(open_dataset(spark, a.bias_file, OpenSpec(squeeze=False, dims=_dims(a))), a.var, a) if a.bias_file else fcst
    cells = _cells(model)
    size = obs.where(F.col("value").isNotNull()).groupBy(*cells).count().agg(F.max("count")).first()[0] or 0
    drawn = ["init_date", "ensemble", "lead_time"]
    bounds = moments.moments_interval(model, cells, drawn, size, a.n_resamples, gev=True)
    seen = moments.moments(obs, cells, gev="lmoments")
    if a.plot_outfile:
        long = seen.unpivot(cells, [c for c in seen.columns if c not in cells], "moment", "obs")
        files.write(plotdata.moment_densities(moments.moment_replicates(model, cells, drawn, size, a.n_resamples, gev=True), long, by=cells), a.plot_outfile)
    return files.write(moments.compared(seen, bounds, cells, a.units), a.outfile, (), history)


if __name__ == "__main__":
    import sys

    run(sys.argv[1:])
