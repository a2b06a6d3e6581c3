import json
import struct
import zipfile
import zlib
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailcast.sources import arrays, cli, files
from tailcast.sources.dataset import OpenSpec, open_dataset, open_forecasts
from tailcast.sources.netcdf import write_netcdf
from tailcast.sources.zarr import blosc

LATS, LONS = [-30.0, -20.0, -10.0], [110.0, 120.0, 130.0, 140.0, 150.0]


def blosc_frame(data, width, block):
    """Shuffled blocks, their streams compressed one by one."""
    out, offsets = b"", []
    n = -(-len(data) // block)
    for k in range(n):
        part = data[k * block : (k + 1) * block]
        mixed = np.frombuffer(part, "u1").reshape(-1, width).T.tobytes()
        offsets.append(16 + 4 * n + len(out))
        pieces = width if len(part) == block else 1
        for i in range(pieces):
            piece = mixed[i * len(mixed) // pieces : (i + 1) * len(mixed) // pieces]
            packed = pa.compress(piece, "lz4_raw", asbytes=True)
            packed = piece if len(packed) >= len(piece) else packed
            out += struct.pack("<i", len(packed)) + packed
    head = bytes([2, 1, 1 | 1 << 5, width]) + struct.pack("<iii", len(data), block, 16 + 4 * n + len(out))
    return head + b"".join(struct.pack("<i", o) for o in offsets) + out


def store(path, values, first="1999-12-30", calendar="standard", packer="zlib", consolidated=True):
    """A store in an archive, of (time, lat, lon) in chunks of (4, 2, 5); a chunk of missing values alone is left out."""
    pack = {"zlib": zlib.compress, "blosc": lambda x: blosc_frame(x, 8, 1024), None: lambda x: x}[packer]
    meta = {".zgroup": {"zarr_format": 2}}
    parts = {}

    def add(name, a, dims, chunks, attrs, fill=None):
        meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": {"id": packer} if packer else None, "fill_value": fill, "order": "C", "filters": None}
        meta[f"{name}/.zattrs"] = attrs | {"_ARRAY_DIMENSIONS": dims}
        for at in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunks)]):
            whole = np.full(chunks, np.nan if a.dtype.kind == "f" else 0, a.dtype)
            part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
            whole[tuple(slice(n) for n in part.shape)] = part
            if a.dtype.kind != "f" or not np.isnan(whole).all():
                parts[f"{name}/{'.'.join(map(str, at))}"] = pack(whole.tobytes())

    add("pr", values, ["time", "lat", "lon"], [4, 2, 5], {"units": "mm day-1"}, "NaN")
    add("time", np.arange(len(values), dtype="<i8"), ["time"], [len(values)], {"units": f"days since {first}", "calendar": calendar})
    add("lat", np.array(LATS), ["lat"], [3], {})
    add("lon", np.array(LONS), ["lon"], [5], {})
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        if consolidated:
            z.writestr(".zmetadata", json.dumps({"metadata": meta}))
        for k, v in meta.items():
            z.writestr(k, json.dumps(v))
        for k, v in parts.items():
            z.writestr(k, v)
    return path


def cube(n=10, seed=0):
    values = np.random.default_rng(seed).normal(size=(n, 3, 5))
    values[2, 1, 3] = np.nan
    values[4:8, :2] = np.nan
    return values


def expected(values, days):
    return {(d, la, lo): None if np.isnan(x) else x for d, plane in zip(days, values) for la, row in zip(LATS, plane) for lo, x in zip(LONS, row)}


@pytest.mark.parametrize(("packer", "consolidated"), [("zlib", True), ("blosc", False), (None, True)])
def test_zarr_archive(spark, tmp_path, packer, consolidated):
    values = cube()
    path = store(f"{tmp_path}/a.zarr.zip", values, packer=packer, consolidated=consolidated)
    df = files.read(spark, path)
    assert df.dtypes == [("time", "date"), ("lat", "double"), ("lon", "double"), ("pr", "double")]
    assert files.unit_of(df, "pr") == "mm day-1"
    days = [(np.datetime64("1999-12-30") + k).item() for k in range(10)]
    assert {(r["time"], r["lat"], r["lon"]): r["pr"] for r in df.collect()} == expected(values, days)


def test_zarr_folder(spark, tmp_path):
    with zipfile.ZipFile(store(f"{tmp_path}/a.zip", cube(), consolidated=False)) as z:
        z.extractall(f"{tmp_path}/a.zarr")
    assert files.read(spark, f"{tmp_path}/a.zarr").agg(F.count("pr"), F.count("*")).first()[:] == (150 - 41, 150)


def test_blosc_frames():
    data = np.arange(1000, dtype="<f8").tobytes()
    assert blosc(blosc_frame(data, 8, 1024)) == data
    with pytest.raises(ValueError):
        blosc(bytes([2, 1, 1, 8]) + b"\0" * 12)


class _Source(arrays.ArraySource):
    def open(self, path):
        from tailcast.sources.zarr import ZarrStore

        return ZarrStore(path)


def test_filters_leave_chunks_out(spark, tmp_path, monkeypatch):
    path = store(f"{tmp_path}/a.zarr.zip", cube())
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    def planned(*filters):
        reader = arrays.ArrayReader(_Source({"path": path}))
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [b for p in reader.partitions() for b in p.boxes]

    assert len(planned()) == 6
    assert planned(GreaterThanOrEqual(("time",), date(2000, 1, 3)), LessThan(("time",), date(2000, 1, 5))) == [((4, 6), (0, 2), (0, 5)), ((4, 6), (2, 3), (0, 5))]
    assert planned(EqualTo(("lat",), -10.0), In(("lon",), (120.0, 140.0))) == [((0, 4), (2, 3), (1, 4)), ((4, 8), (2, 3), (1, 4)), ((8, 10), (2, 3), (1, 4))]
    assert planned(EqualTo(("lat",), 5.0)) == []
    monkeypatch.setattr(arrays, "PARTITION", 1)
    assert len(arrays.ArrayReader(_Source({"path": path})).partitions()) == 6
    df = files.read(spark, path)
    assert df.where((F.col("time") >= "2000-01-03") & (F.col("time") < "2000-01-05") & F.col("lat").isin(-10.0, -20.0)).count() == 20
    assert df.where("lat > 50").count() == 0


def test_calendars():
    n = np.array([0, 58, 59, 60, 365, np.nan])
    assert [str(x)[:10] for x in arrays.times(n, "days since 2000-01-01", "noleap")] == ["2000-01-01", "2000-02-28", "2000-03-01", "2000-03-02", "2001-01-01", "NaT"]
    assert [str(x)[:10] for x in arrays.times(n, "days since 2000-01-01", "360_day")] == ["2000-01-01", "2000-02-29", "NaT", "2000-03-01", "2001-01-06", "NaT"]
    assert [str(x) for x in arrays.times(n[:2], "hours since 1850-01-01 12:00:00")] == ["1850-01-01T12:00:00", "1850-01-03T22:00:00"]
    for units, calendar in (("months since 2000-01-01", "standard"), ("days since 2000-01-01", "julian")):
        with pytest.raises(ValueError):
            arrays.times(n, units, calendar)


def test_packed_and_missing():
    got = arrays.decoded(np.array([1, -999, 3], "i2"), {"_FillValue": -999, "scale_factor": 0.5, "add_offset": 10})
    assert got.tolist() == [10.5, None, 11.5]


def test_chain_and_forecasts_of_stores(spark, tmp_path):
    spec = OpenSpec(variables=("rain",), metadata={"rename": {"pr": "rain"}}, time_freq="YE-DEC", time_agg="max", spatial_agg="mean")
    path = store(f"{tmp_path}/a.zarr.zip", cube())
    got = open_dataset(spark, path, spec).orderBy("time").collect()
    daily = np.nanmean(cube(), axis=(1, 2))
    assert [r["rain"] for r in got] == pytest.approx([daily[:2].max(), daily[2:].max()])
    names = [store(f"{tmp_path}/f{y}_{e}.zarr.zip", cube(seed=e), f"{y}-05-01") for y in (2000, 2001) for e in range(2)]
    rows = open_forecasts(spark, names, OpenSpec(point=(-30.0, 110.0)), n_ensemble_files=2).collect()
    assert {(r["init_date"].year, r["ensemble"], r["lead_time"]) for r in rows} == {(y, e, k) for y in (2000, 2001) for e in range(2) for k in range(10)}
    assert {r["pr"] for r in rows if (r["ensemble"], r["lead_time"]) == (1, 9)} == {cube(seed=1)[9, 0, 0]}


def test_netcdf_bytes(spark, tmp_path):
    """A file of two values, taken apart by hand."""
    df = files.with_unit(spark.createDataFrame([(10, 1.5), (20, None)], "x int, v double"), "v", "mm")
    assert write_netcdf(df, f"{tmp_path}/a.nc", ["x"], "made so") == 2
    data = open(f"{tmp_path}/a.nc", "rb").read()
    assert data[:12] == b"CDF\x05" + bytes(8)
    assert data[12:40] == struct.pack(">iqq", 10, 1, 1) + b"x\0\0\0"[:4] + struct.pack(">q", 2)[:4]
    assert b"history\0" + struct.pack(">iq", 2, 7) + b"made so\0" in data and b"units\0\0\0" + struct.pack(">iq", 2, 2) + b"mm\0\0" in data
    assert data.endswith(struct.pack(">ii", 10, 20) + struct.pack(">d", 1.5) + struct.pack(">d", np.nan)) and not list(tmp_path.glob("*.part"))


def test_netcdf_round_trip(spark, tmp_path, monkeypatch):
    from tailcast.sources import netcdf

    monkeypatch.setattr(netcdf, "SLAB", 16)
    values = cube()
    table = files.read(spark, store(f"{tmp_path}/a.zarr.zip", values)).where("pr is not null and not (lat = -20 and time = '2000-01-08')")
    table = table.withColumns({"region": F.lit("Süd"), "n": F.col("lon").cast("int"), "big": F.col("lat").cast("long"), "small": F.col("pr").cast("float")})
    files.write(table, f"{tmp_path}/b.nc", history="h")
    back = files.read(spark, f"{tmp_path}/b.nc")
    assert files.unit_of(back, "pr") == "mm day-1" and back.columns[:4] == ["region", "time", "lat", "lon"]
    keys = ["region", "time", "lat", "lon"]
    full = back.count()
    assert full == 150 and back.where("pr is null").count() == 150 - table.count()
    there, here = (sorted(x.select(*keys, "pr", "n", "big", "small").collect()) for x in (back.where("pr is not null"), table))
    assert there == here
    assert back.where("time = '2000-01-01' and lat >= -20").count() == 10
    forecasts = table.select(F.lit(1).alias("ensemble"), F.to_date(F.lit("1999-12-30")).alias("init_date"), F.datediff("time", F.lit("1999-12-30")).alias("lead_time"), "time", "lat", "lon", "pr")
    files.write(forecasts, f"{tmp_path}/c.nc")
    got = files.read(spark, f"{tmp_path}/c.nc", path_column="p").where("pr is not null")
    assert got.columns == ["init_date", "ensemble", "lead_time", "lat", "lon", "time", "pr", "p"]
    assert sorted(got.select("time", "lat", "lon", "pr").collect()) == sorted(table.select("time", "lat", "lon", "pr").collect())


def test_netcdf_refuses(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "x int, v double")
    with pytest.raises(Exception, match="two rows of one cell"):
        write_netcdf(df, f"{tmp_path}/a.nc", ["x"])
    with pytest.raises(ValueError, match="null"):
        write_netcdf(df.withColumn("x", F.expr("nullif(x, 1)")), f"{tmp_path}/a.nc", ["x"])
    with pytest.raises(ValueError, match="numbers"):
        write_netcdf(df.withColumn("s", F.lit("s")), f"{tmp_path}/a.nc", ["x"])
    with pytest.raises(ValueError, match="folder"):
        write_netcdf(df, "s3://b/a.nc", ["x"])
    (tmp_path / "hdf.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(100))
    with pytest.raises(Exception, match="version 4"):
        files.read(spark, f"{tmp_path}/hdf.nc").count()
    empty = df.where("x < 0")
    write_netcdf(empty, f"{tmp_path}/e.nc", ["x"])
    assert files.read(spark, f"{tmp_path}/e.nc").count() == 0


def test_netcdf_records(spark, tmp_path):
    """Version 1, two variables by record, one of short numbers: what other programs write."""
    name = lambda x: struct.pack(">i", len(x)) + x + b"\0" * (-len(x) % 4)
    dims = struct.pack(">ii", 10, 2) + name(b"t") + struct.pack(">i", 0) + name(b"x") + struct.pack(">i", 3)
    none = struct.pack(">ii", 0, 0)

    def var(n, code, size, begin):
        return name(n) + struct.pack(">iii", 2, 0, 1) + none + struct.pack(">iii", code, size, begin)

    def head(at):
        return b"CDF\x01" + struct.pack(">i", 4) + dims + none + struct.pack(">ii", 11, 2) + var(b"a", 3, 8, at) + var(b"b", 6, 24, at + 8)

    body = b"".join(np.array([r, r + 1, r + 2], ">i2").tobytes() + b"\0\0" + np.array([r, 10.0 * r, 0.5], ">f8").tobytes() for r in range(4))
    (tmp_path / "r.nc").write_bytes(head(len(head(0))) + body)
    got = sorted(files.read(spark, f"{tmp_path}/r.nc").collect())
    assert [tuple(r) for r in got] == [(r, x, r + x, (float(r), 10.0 * r, 0.5)[x]) for r in range(4) for x in range(3)]


def test_parts_of_files_are_read_alone(spark, tmp_path, monkeypatch):
    """Boxes of any shape, and no more bytes than from their first to their last cell."""
    from tailcast.sources import netcdf

    files.write(files.read(spark, store(f"{tmp_path}/a.zarr.zip", cube())), f"{tmp_path}/b.nc")
    opened, read = netcdf.NetcdfStore(f"{tmp_path}/b.nc"), []
    plain = netcdf.NetcdfStore._read
    monkeypatch.setattr(netcdf.NetcdfStore, "_read", lambda self, at, n, kind: read.append(n) or plain(self, at, n, kind))
    for box in (((0, 10), (0, 3), (0, 5)), ((3, 4), (1, 2), (2, 4)), ((2, 9), (1, 3), (0, 1)), ((5, 5), (0, 3), (0, 5))):
        read.clear()
        want = cube()[tuple(slice(*b) for b in box)]
        np.testing.assert_array_equal(opened.box("pr", box), want)
        assert sum(read) <= (2 if box[0] == (3, 4) else 150)


def test_events_in_files_of_arrays(spark, tmp_path):
    """Only the files that hold an event's days are opened: another of that ending is no such file."""
    from tailcast.sources import circulation

    table = files.read(spark, store(f"{tmp_path}/a b.zarr.zip", np.arange(150.0).reshape(10, 3, 5))).withColumnRenamed("pr", "value")
    files.write(table.where("time <= '1999-12-31'"), f"{tmp_path}/f_19991230-19991231.nc")
    files.write(table.where("time > '1999-12-31'"), f"{tmp_path}/f_20000101-20000108.nc")
    (tmp_path / "f_20010101-20010108.nc").write_bytes(b"none")
    known = circulation.catalogue(spark, f"file://{tmp_path}", "f_*.nc")
    assert known.count() == 3
    events = spark.createDataFrame([(1, date(2000, 1, 1))], "event int, time date")
    got = {(r["lat"], r["lon"]): r["value"] for r in circulation.event_fields(spark, events, known, 1).collect()}
    assert len(got) == 15 and got[-30.0, 110.0] == (15 + 30) / 2


def test_program_reads_and_writes_arrays(spark, tmp_path):
    path = store(f"{tmp_path}/a.zarr.zip", cube())
    cli.run(["fileio", path, f"{tmp_path}/o.nc", "--variables", "pr", "--lat_bnds", "-20", "-10"], spark)
    assert files.read(spark, f"{tmp_path}/o.nc").where("pr is not null").count() == 100 - 21
