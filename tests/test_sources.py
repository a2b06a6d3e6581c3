from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tailcast.sources import cli, files
from tailcast.sources.dataset import OpenSpec, open_dataset, open_forecasts


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rows = [(date(2000 + m // 12, m % 12 + 1, 1), float(a), float(o), 1.0 + m + a / 10, 300.0) for m in range(36) for a in (-30, -20) for o in (110, 120)]
    spark.createDataFrame(rows, "when date, lat double, lon double, rain double, t double").coalesce(1).write.parquet(f"{root}/obs.parquet")
    (root / "meta.yml").write_text("rename:\n  when: time\n  rain: pr\nunits:\n  pr: mm day-1\n  t: K\nround_coords: [lat]\n")
    names = []
    for year in (2000, 2001):
        for member in range(2):
            part = [(date(year, k + 1, 1), float(year - 2000 + member + k)) for k in range(6)]
            spark.createDataFrame(part, "time date, pr double").coalesce(1).write.parquet(f"{root}/f{year}_{member}.parquet")
            names.append(f"{root}/f{year}_{member}.parquet")
    (root / "list.txt").write_text("\n".join(names) + "\n")
    return root


def test_formats():
    assert [files.guess_format(x) for x in ("a.nc", "b.zarr", "c.zarr.zip", "d.parquet", "e.csv")] == ["netcdf4", "zarr", "zarr", "parquet", "csv"]
    with pytest.raises(ValueError):
        files.guess_format("a.doc")
    assert files.nested(list("abcdefgh"), 2, 2) == [[["a", "b"], ["c", "d"]], [["e", "f"], ["g", "h"]]]
    with pytest.raises(ValueError):
        files.nested(list("abc"), 2, 1)


def test_metadata(spark, tree):
    meta = files.load_metadata(f"{tree}/meta.yml")
    df = files.fix_metadata(spark.read.parquet(f"{tree}/obs.parquet"), meta)
    assert files.unit_of(df, "pr") == "mm day-1" and df.schema["time"].metadata["original_name"] == "when"
    (tree / "bad.yml").write_text("other: 1\n")
    with pytest.raises(KeyError):
        files.load_metadata(f"{tree}/bad.yml")


def test_chain(spark, tree):
    spec = OpenSpec(
        variables=("pr", "t"), metadata=files.load_metadata(f"{tree}/meta.yml"), lat_bnds=(-30, -20), spatial_agg="mean", time_freq="YE-DEC", time_agg="sum", input_freq="M", units={"t": "degC"}, units_timing="start"
    )
    rows = open_dataset(spark, f"{tree}/obs.parquet", spec).orderBy("time").collect()
    assert [r["time"] for r in rows] == [date(y, 12, 31) for y in (2000, 2001, 2002)]
    assert rows[0]["pr"] == pytest.approx(sum(1 + m - 2.5 for m in range(12)))
    assert rows[0]["t"] == pytest.approx(12 * 26.85)
    unit = files.unit_of(open_dataset(spark, f"{tree}/obs.parquet", spec), "pr")
    assert unit == "mm day-1" or "year" in unit
    with pytest.raises(ValueError):
        OpenSpec(units_timing="late")


def test_chain_runs_no_job_but_for_squeezing(spark, tree):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    open_dataset(spark, f"{tree}/obs.parquet", OpenSpec(metadata=files.load_metadata(f"{tree}/meta.yml"), months=(1, 2), spatial_agg="mean", squeeze=False))
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("lazy")]
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 1  # the file's footer


def test_forecasts(spark, tree):
    df = open_forecasts(spark, f"{tree}/list.txt", OpenSpec(squeeze=False), 1, 2)
    assert set(df.columns) == {"time", "ensemble", "init_date", "lead_time", "pr"}
    assert df.count() == 24
    assert df.where("lead_time = 3 and ensemble = 1 and init_date = date '2001-01-01'").first()["pr"] == 5
    assert df.agg(F.countDistinct("init_date")).first()[0] == 2


def test_paths():
    path = "/a/b/c/d/e/f/g/CMIP6/Model-X/hist/s1960-r2i1p1f3/x.nc"
    assert files.run_of(path) == "r2i1p1f3" and files.model_of(path) == "CMIP6"
    assert "tailcast x" in files.provenance({"in": "old"}, argv=["tailcast", "x"])


def test_pairs():
    assert dict(map(cli.Pairs.pair, ["a=1", "b=2:5", "c=x", "d=0.5", "e=:3"])) == {"a": 1, "b": slice(2, 5), "c": "x", "d": 0.5, "e": slice(None, 3)}
    assert cli.lead("3") == 3 and cli.lead("t.parquet") == "t.parquet"


def test_programs(spark, tree):
    out = f"{tree}/annual.parquet"
    cli.run(["fileio", f"{tree}/obs.parquet", out, "--metadata_file", f"{tree}/meta.yml", "--variables", "pr", "--spatial_agg", "mean", "--time_freq", "YE-DEC", "--time_agg", "max", "--input_freq", "M"], spark)
    assert spark.read.parquet(out).count() == 3
    rng = range(8)
    rows = [(date(2000 + y, 1, 1), e, k, date(2000 + y, 1 + k, 1), float((y * 7 + e * 3 + k * 5) % 11 + y / 10)) for y in rng for e in range(3) for k in range(4)]
    spark.createDataFrame(rows, "init_date date, ensemble int, lead_time int, time date, pr double").write.parquet(f"{tree}/fcst.parquet")
    spark.createDataFrame([(date(2000 + m // 12, m % 12 + 1, 1), float(m % 13)) for m in range(120)], "time date, pr double").write.parquet(f"{tree}/series.parquet")
    f, o = f"{tree}/fcst.parquet", f"{tree}/series.parquet"
    for name, args in {
        "independence": [f, "pr", "OUT", "--n_resamples", "5"],
        "similarity": [f, o, "pr", "OUT", "--by_lead", "--min_lead", "1", "--plot_outfile", f"{tree}/similarity-plot.parquet"],
        "bias_correction": [f, o, "pr", "additive", "OUT", "--rounding_freq", "M", "--base_period", "2000-01-01", "2006-12-31"],
        "stability": [f, "pr", "OUT", "--start_years", "2000", "2004", "--uncertainty"],
        "moments": [f, o, "pr", "OUT", "--n_resamples", "5", "--units", "mm", "--plot_outfile", f"{tree}/moments-plot.parquet"],
        "eva": [f, "pr", "OUT", "--nonstationary", "--min_lead", "1"],
    }.items():
        target = f"{tree}/{name}-out.parquet"
        cli.run([name, *[target if a == "OUT" else a for a in args]], spark)
        assert spark.read.parquet(target).count() > 0, name
    assert spark.read.parquet(f"{tree}/moments-out.parquet").first()["text"].endswith(" mm")
    assert spark.read.parquet(f"{tree}/similarity-plot.parquet").count() == 6  # three leads, two tests
    assert spark.read.parquet(f"{tree}/moments-plot.parquet").count() > 0


def test_names_of_dimensions_and_shapes(spark, tree):
    from tailcast.operators.spatial import ring_of_box, shapes_table

    rows = [(date(2000, 1, 1), float(y), float(x), 1.0 + x) for y in (0, 1) for x in (0, 1)]
    spark.createDataFrame(rows, "t date, y double, x double, pr double").write.parquet(f"{tree}/named.parquet")
    shapes_table(spark, {"box": ring_of_box(-1.0, -1.0, 0.5, 2.0)}).withColumnRenamed("region", "title").write.parquet(f"{tree}/titled.parquet")
    out = f"{tree}/named-out.parquet"
    cli.run(["fileio", f"{tree}/named.parquet", out, "--variables", "pr", "--time_dim", "t", "--lat_dim", "y", "--lon_dim", "x", "--shapefile", f"{tree}/titled.parquet", "--shp_header", "title", "--spatial_agg", "mean", "--standard_calendar"], spark)
    assert [(r["region"], r["pr"]) for r in spark.read.parquet(out).collect()] == [("box", 1.0)]


def test_zip(spark, tree):
    files.write(spark.range(3), f"{tree}/z.parquet.zip", history="made")
    assert (tree / "z.parquet.zip").exists() and not (tree / "z.parquet").exists()


def test_buffers_are_in_degrees(spark, tree):
    """One cell in the shape, one within two degrees, one beyond."""
    from tailcast.operators.spatial import ring_of_box, shapes_table

    rows = [(date(2000, 1, 1), 0.0, lon, lon) for lon in (0.0, 2.5, 5.0)]
    spark.createDataFrame(rows, "time date, lat double, lon double, pr double").write.parquet(f"{tree}/cells.parquet")
    shapes_table(spark, {"box": ring_of_box(-1.0, -1.0, 1.0, 1.0)}).write.parquet(f"{tree}/shape.parquet")
    shapes = spark.read.parquet(f"{tree}/shape.parquet")
    for buffer, want in ((None, 0.0), (1.0, 0.0), (2.0, 1.25)):
        spec = OpenSpec(variables=("pr",), shapes=shapes, shape_buffer=buffer, spatial_agg="mean")
        assert [r["pr"] for r in open_dataset(spark, f"{tree}/cells.parquet", spec).collect()] == [want], buffer
    cli.run(["fileio", f"{tree}/cells.parquet", f"{tree}/near.parquet", "--variables", "pr", "--shapefile", f"{tree}/shape.parquet", "--shp_buffer", "2", "--spatial_agg", "mean"], spark)
    assert [r["pr"] for r in spark.read.parquet(f"{tree}/near.parquet").collect()] == [1.25]


def test_longitudes_outside_of_the_data(spark, tree):
    spec = OpenSpec(metadata=files.load_metadata(f"{tree}/meta.yml"), lon_bnds=(100, 115))
    with pytest.raises(Exception, match="outside of the data"):
        open_dataset(spark, f"{tree}/obs.parquet", spec).collect()


def test_forecasts_with_metadata(spark, tree):
    meta = {"rename": {"pr": "rain"}, "units": {"rain": "mm"}}
    df = open_forecasts(spark, f"{tree}/list.txt", OpenSpec(variables=("rain",), metadata=meta, squeeze=False), 1, 2)
    assert "rain" in df.columns and df.count() == 24


def test_files_of_events(spark, tmp_path):
    """Only the files that an event needs are in the plan; others may be no files at all."""
    from tailcast.sources import circulation

    days = [date(2000, 1, 1) + timedelta(days=k) for k in range(120)]
    for run in ("r1i1p1f1", "r2i1p1f1"):
        for m, (lo, hi) in enumerate(((0, 31), (31, 60), (60, 91), (91, 120))):
            name = f"{tmp_path}/s1999-{run}/pr_day_{days[lo]:%Y%m%d}-{days[hi - 1]:%Y%m%d}.parquet"
            spark.createDataFrame([(d, 0.0, 1.0, float(k + 1000 * (run[1] == "2"))) for k, d in list(enumerate(days))[lo:hi]], "time date, lat double, lon double, value double").coalesce(1).write.parquet(name)
    paths = [f"file://{p}" for p in sorted(str(p) for p in tmp_path.glob("*/*.parquet"))]
    files = circulation.described(spark.createDataFrame([(p,) for p in paths] + [("/no/such/pr_20000125-20000210.txt",), ("/x/plain.parquet",)], "path string"))
    known = {r["path"].rpartition("/")[2]: r for r in files.collect()}
    assert known["pr_day_20000101-20000131.parquet"]["last"] == date(2000, 1, 31) and known["pr_day_20000101-20000131.parquet"]["start_year"] == 1999
    assert known["plain.parquet"]["first"] is None and known["plain.parquet"]["run"] is None
    events = spark.createDataFrame([(1, date(2000, 2, 2), "r1i1p1f1", date(1999, 11, 1)), (2, date(2000, 4, 20), "r2i1p1f1", date(1999, 11, 1))], "event int, time date, run string, init_date date")
    found = {(r["event"], r["path"].split("/")[-2][6:8], r["path"][-16:-8]) for r in circulation.files_of_events(events, files, 3, run="run", init_date="init_date").collect()}
    assert found == {(1, "r1", "20000131"), (1, "r1", "20000229"), (2, "r2", "20000429")}
    one = circulation.described(spark.createDataFrame([("/a/x_199001-199112.nc",), ("/a/x_1990-1991.nc",)], "path string")).collect()
    assert [(r["first"], r["last"]) for r in one] == [(date(1990, 1, 1), date(1991, 12, 31))] * 2
    listed = circulation.catalogue(spark, f"file://{tmp_path}", "part-*.parquet")
    assert listed.count() == 8


def test_fields_of_events_read_their_files_only(spark, tmp_path):
    from tailcast.sources import circulation

    days = [date(2000, 1, 1) + timedelta(days=k) for k in range(60)]
    for name, part in (("f_20000101-20000131", days[:31]), ("f_20000201-20000229", days[31:])):
        rows = spark.createDataFrame([(d, float(lat), 5.0, float(d.day)) for d in part for lat in (0, 1)], "time date, lat double, lon double, value double").toPandas()
        rows.to_parquet(f"{tmp_path}/{name}.parquet")
    files = circulation.catalogue(spark, f"file://{tmp_path}", "f_*.parquet")
    events = spark.createDataFrame([(7, date(2000, 2, 2))], "event int, time date")
    got = circulation.event_fields(spark, events, files, 3, agg="sum").collect()
    assert sorted(tuple(r) for r in got) == [(7, 0.0, 5.0, 30.0 + 31 + 1 + 2), (7, 1.0, 5.0, 64.0)]
    late = circulation.event_fields(spark, spark.createDataFrame([(7, date(2000, 2, 20))], "event int, time date"), files, 3)
    assert [f.rpartition("/")[2] for f in late.inputFiles() if "f_2000" in f] == ["f_20000201-20000229.parquet"] and late.first()["value"] == 18.5
    with pytest.raises(ValueError):
        circulation.event_fields(spark, spark.createDataFrame([(7, date(2001, 2, 20))], "event int, time date"), files, 3)


def test_anomalies_of_all_variables(spark, tmp_path):
    rows = [(date(2000 + y, m, 1), float(m + y), float(10 * m - y)) for y in range(3) for m in (1, 2)]
    spark.createDataFrame(rows, "time date, pr double, tas double").write.parquet(f"{tmp_path}/in.parquet")
    cli.run(["fileio", f"{tmp_path}/in.parquet", f"{tmp_path}/out.parquet", "--anomaly", "2000-01-01", "2002-12-31", "--anomaly_freq", "month"], spark)
    got = {r["time"]: (r["pr"], r["tas"]) for r in spark.read.parquet(f"{tmp_path}/out.parquet").collect()}
    assert got == {date(2000 + y, m, 1): (float(y - 1), float(1 - y)) for y in range(3) for m in (1, 2)}


def test_options_of_programs(spark, tmp_path):
    """Other names of dimensions, named outputs, drawn tables with trends and cells, parts of outputs."""
    rows = [(date(2000 + y, 1, 1), e, k, date(2000 + y, 1 + k, 1), cell, float((y * 7 + e * 3 + k * 5 + cell) % 11 + y / 10)) for y in range(8) for e in range(3) for k in range(4) for cell in (0, 1)]
    spark.createDataFrame(rows, "start date, member int, lead int, time date, lat int, pr double").write.parquet(f"{tmp_path}/f.parquet")
    spark.createDataFrame([(date(2000 + m // 12, m % 12 + 1, 1), cell, float(m % 13)) for m in range(96) for cell in (0, 1)], "time date, lat int, pr double").write.parquet(f"{tmp_path}/o.parquet")
    f, o, names = f"{tmp_path}/f.parquet", f"{tmp_path}/o.parquet", ["--ensemble_dim", "member", "--init_dim", "start", "--lead_dim", "lead"]
    cli.run(["similarity", f, o, "pr", f"{tmp_path}/s.parquet", *names, "--output_chunks", "lat=1"], spark)
    assert spark.read.parquet(f"{tmp_path}/s.parquet").count() == 2
    cli.run(["independence", f, "pr", f"{tmp_path}/i.parquet", *names, "--n_resamples", "5"], spark)
    cli.run(["stability", f, "pr", "--outfile", f"{tmp_path}/t.parquet", "--start_years", "2000", "2004", *names, "--units", "mm", "--ylim", "0", "9"], spark)
    drawn = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert files.unit_of(drawn, "value") == "mm" and drawn.agg(F.max("value")).first()[0] <= 9
    cli.run(["moments", f, o, "pr", "--outfile", f"{tmp_path}/m.parquet", *names, "--n_resamples", "5", "--plot_outfile", f"{tmp_path}/mp.parquet"], spark)
    assert {r["lat"] for r in spark.read.parquet(f"{tmp_path}/mp.parquet").select("lat").distinct().collect()} == {0, 1}
    cli.run(["eva", f, "pr", f"{tmp_path}/e.parquet", "--nonstationary", *names, "--plot_outfile", f"{tmp_path}/ep.parquet"], spark)
    curves = spark.read.parquet(f"{tmp_path}/ep.parquet")
    assert {tuple(r) for r in curves.select("kind", "covariate", "lat").distinct().collect()} == {(k, c, lat) for k in ("curve", "density") for c in (2000.0, 2007.0) for lat in (0, 1)}
    cli.run(["eva", o, "pr", f"{tmp_path}/a.parquet", "--file_kwargs", "time_freq=YE-DEC", "time_agg=max"], spark)
    assert {r["n"] for r in spark.read.parquet(f"{tmp_path}/a.parquet").collect()} == {8}
    with pytest.raises(SystemExit):
        cli.run(["stability", f, "pr", "--start_years", "2000"], spark)


def test_options_of_fileio(spark, tmp_path, capsys):
    rows = [(date(2000, 1, 1), float(a), float(b), float(10 * a + b)) for a in range(2) for b in range(3)]
    spark.createDataFrame(rows, "time date, row double, col double, pr double").write.parquet(f"{tmp_path}/g.parquet")
    cli.run(["fileio", f"{tmp_path}/g.parquet", f"{tmp_path}/out.parquet", "--variables", "pr", "--spatial_agg", "mean", "--agg_y_dim", "row", "--agg_x_dim", "col", "--input_chunks", "time=5"], spark)
    assert [(r["time"], r["pr"]) for r in spark.read.parquet(f"{tmp_path}/out.parquet").collect()] == [(date(2000, 1, 1), 6.0)]
    wide = [(date(2000, 1, 1), lat, lon, lat) for lat in (-30.0, -29.0, -28.0) for lon in (130.0, 131.0, 132.0)]
    spark.createDataFrame(wide, "time date, lat double, lon double, pr double").write.parquet(f"{tmp_path}/w.parquet")
    cli.run(["fileio", f"{tmp_path}/w.parquet", f"{tmp_path}/r.parquet", "--variables", "pr", "--regrid_name", "AUS100i", "--regrid_lat_offset", "0.25", "--regrid_method", "bilinear"], spark)
    assert {r["lat"] % 1 for r in spark.read.parquet(f"{tmp_path}/r.parquet").where("pr is not null").collect()} == {0.25}
    one = [(date(2000, 1, k), 1.0) for k in (1, 2)]
    spark.createDataFrame(one, "time date, pr double").write.parquet(f"{tmp_path}/m0.parquet")
    cli.run(["fileio", f"{tmp_path}/m0.parquet", f"{tmp_path}/v.parquet", "--forecast", "--verbose"], spark)
    assert "start 0, member 0" in capsys.readouterr().out
    (tmp_path / "s.yml").write_text("cluster: local\nconf:\n  spark.sql.ansi.enabled: 'true'\n")
    assert files.load_config(f"{tmp_path}/s.yml")["conf"] == {"spark.sql.ansi.enabled": "true"}
    (tmp_path / "bad.yml").write_text("queue: x\n")
    with pytest.raises(KeyError):
        files.load_config(f"{tmp_path}/bad.yml")
