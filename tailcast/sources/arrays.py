"""Stores of arrays as tables: a row for each cell, a partition for each run of chunks.

What is common to the formats: coordinates, the CF conventions for times and missing or packed
values, and filters on coordinates, which leave out the chunks that none of their labels is in.
"""

from __future__ import annotations

import itertools
import json
import re
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

#: Cells of a batch of rows, and at least of a partition if chunks are smaller.
BATCH, PARTITION = 1 << 17, 1 << 22
# Seconds in the units of time that CF names.
SECONDS = {"day": 86400, "days": 86400, "hour": 3600, "hours": 3600, "minute": 60, "minutes": 60, "second": 1, "seconds": 1}
MONTH_ENDS = np.cumsum([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
Box = tuple[tuple[int, int], ...]


@dataclass
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    chunks: tuple[int, ...]
    attrs: dict = field(default_factory=dict)


class Store(ABC):
    """An opened store: what its variables are, and parts of them."""

    variables: dict[str, Variable]

    @abstractmethod
    def box(self, name: str, box: Box) -> np.ndarray:
        """The values of a variable between the bounds in each dimension."""


def whole(v: Variable) -> Box:
    return tuple((0, n) for n in v.shape)


def times(values: np.ndarray, units: str, calendar: str = "standard") -> np.ndarray:
    """Numbers ``since`` a time as datetime64[s]. Days of other calendars keep their names; one that the
    Gregorian calendar lacks (30 February) is NaT, and so is NaN. Calendars with Julian dates aren't known."""
    unit, _, base = units.partition(" since ")
    if unit not in SECONDS:
        raise ValueError(f"unknown unit of time {units}")
    y, m, d, clock = re.fullmatch(r"\s*(\d+)-(\d+)-(\d+)(?:[T ]+([\d:.]*)[^\d]*)?", base).groups()
    hms = [float(x) for x in (clock or "0").split(":")]
    start = int(sum(x * s for x, s in zip(hms, (3600, 60, 1))))
    known = np.isfinite(values.astype("float64"))
    after = np.round(np.where(known, values, 0).astype("float64") * SECONDS[unit]).astype("int64") + start
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        made = np.datetime64(f"{int(y):04d}-{int(m):02d}-{int(d):02d}", "s") + after
    elif calendar in ("noleap", "365_day", "360_day"):
        ends = np.arange(30, 361, 30) if calendar == "360_day" else MONTH_ENDS
        days = int(y) * ends[-1] + (ends[int(m) - 2] if int(m) > 1 else 0) + int(d) - 1 + after // 86400
        year, of_year = np.divmod(days, ends[-1])
        month = np.searchsorted(ends, of_year, side="right")
        day = of_year - np.where(month > 0, ends[month - 1], 0)
        first = (year - 1970).astype("datetime64[Y]").astype("datetime64[M]") + month
        date = first.astype("datetime64[D]") + day
        date = np.where(date.astype("datetime64[M]") == first, date, np.datetime64("NaT"))
        made = date.astype("datetime64[s]") + after % 86400
    else:
        raise ValueError(f"unknown calendar {calendar}")
    return np.where(known, made, np.datetime64("NaT", "s"))


def decoded(values: np.ndarray, attrs: dict) -> np.ma.MaskedArray:
    """Values with what is missing masked, unpacked, and times as times."""
    flat = np.ma.masked_array(values, mask=np.zeros(values.shape, bool))
    if values.dtype.kind in "iuf":
        for name in ("_FillValue", "missing_value"):
            for missing in np.atleast_1d(attrs[name]) if attrs.get(name) is not None else ():
                flat.mask |= values == values.dtype.type(missing)
        if values.dtype.kind == "f":
            flat.mask |= np.isnan(values)
        if "scale_factor" in attrs or "add_offset" in attrs:
            packed = values.astype("float64") * float(np.ravel(attrs.get("scale_factor", 1))[0]) + float(np.ravel(attrs.get("add_offset", 0))[0])
            flat = np.ma.masked_array(packed, mask=flat.mask)
        if " since " in str(attrs.get("units", "")):
            made = times(flat.data, attrs["units"], attrs.get("calendar", "standard"))
            flat = np.ma.masked_array(made, mask=flat.mask | np.isnat(made))
    elif values.dtype.kind in "SUO":
        flat = np.ma.masked_array(np.array([x.decode() if isinstance(x, bytes) else str(x) for x in values.ravel()], dtype=object).reshape(values.shape), mask=flat.mask)
    return flat


def field_type(v: Variable, times_as: str) -> tuple[T.DataType, pa.DataType]:
    if v.dtype.kind in "iuf" and " since " in str(v.attrs.get("units", "")):
        return (T.DateType(), pa.date32()) if times_as == "date" else (T.TimestampType(), pa.timestamp("us", "UTC"))
    if v.dtype.kind in "SUO":
        return T.StringType(), pa.string()
    if v.dtype.kind in "iu" and not {"scale_factor", "add_offset"} & set(v.attrs):
        return T.LongType(), pa.int64()
    if v.dtype == np.dtype("float32").newbyteorder(v.dtype.byteorder) and not {"scale_factor", "add_offset"} & set(v.attrs):
        return T.FloatType(), pa.float32()
    if v.dtype.kind not in "iuf":
        raise ValueError(f"no column for values of type {v.dtype}")
    return T.DoubleType(), pa.float64()


def column(values: np.ma.MaskedArray, kind: pa.DataType) -> pa.Array:
    plain, mask = values.data, np.ma.getmaskarray(values)
    if plain.dtype.kind == "M":
        plain = plain.astype("datetime64[D]" if pa.types.is_date(kind) else "datetime64[us]")
        return pa.array(plain, mask=mask).cast(kind)
    if plain.dtype.kind in "iuf":
        plain = plain.astype(kind.to_pandas_dtype())
    return pa.array(plain, kind, mask=mask)


def table_of(store: Store, wanted: Sequence[str]) -> tuple[list[str], tuple[str, ...]]:
    """The variables that make a table, and their dimensions: those named, or all with the most dimensions."""
    held = {k: v for k, v in store.variables.items() if v.dims and v.dims != (k,)}
    bounds = {str(v.attrs.get("bounds")) for v in store.variables.values()}
    if not wanted:
        most = max((len(v.dims) for k, v in held.items() if k not in bounds), default=0)
        wanted = [k for k, v in held.items() if len(v.dims) == most and k not in bounds]
    lacking = [k for k in wanted if k not in held]
    if lacking or not wanted:
        raise ValueError(f"no variables {lacking} among {sorted(held)}")
    if len({held[k].dims for k in wanted}) > 1:
        raise ValueError(f"variables of different dimensions, name some of them: { {k: held[k].dims for k in wanted} }")
    return list(wanted), held[wanted[0]].dims


@dataclass
class Boxes(ds.InputPartition):
    path: str
    boxes: list[Box]


class ArrayReader(ds.DataSourceReader):
    """Reads what ``plan`` left of the stores' chunks, as batches."""

    def __init__(self, source: ArraySource) -> None:
        self.source = source
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """All filters stay with Spark too: chunks are left out as wholes."""
        self.filters = list(filters)
        return filters

    def kept(self, dim: str, labels: np.ndarray) -> np.ndarray:
        """Which labels all filters on this coordinate alone admit."""
        ok = np.ones(len(labels), bool)

        def like(x: object) -> object:
            return np.datetime64(x.replace(tzinfo=None) if hasattr(x, "hour") else x) if labels.dtype.kind == "M" else x

        for f in self.filters:
            if getattr(f, "attribute", None) != (dim,):
                continue
            match f:
                case ds.In():
                    ok &= np.isin(labels, [like(x) for x in f.value if x is not None])
                case ds.EqualTo():
                    ok &= labels == like(f.value)
                case ds.GreaterThan():
                    ok &= labels > like(f.value)
                case ds.GreaterThanOrEqual():
                    ok &= labels >= like(f.value)
                case ds.LessThan():
                    ok &= labels < like(f.value)
                case ds.LessThanOrEqual():
                    ok &= labels <= like(f.value)
        return ok

    def partitions(self) -> list[Boxes]:
        found = []
        for path in self.source.paths:
            store = self.source.open(path)
            names, dims = table_of(store, self.source.wanted)
            grid = store.variables[names[0]]
            spans = []
            for dim, n, step in zip(dims, grid.shape, grid.chunks):
                ok = self.kept(dim, self.source.labels(store, dim, n).data)
                spans.append([(lo + hit[0], lo + hit[-1] + 1) for lo in range(0, n, step) if len(hit := np.flatnonzero(ok[lo : lo + step]))])
            boxes: list[Box] = []
            cells = 0
            for box in itertools.product(*spans):
                boxes.append(tuple((int(a), int(b)) for a, b in box))
                cells += int(np.prod([b - a for a, b in box]))
                if cells >= PARTITION:
                    found.append(Boxes(path, boxes))
                    boxes, cells = [], 0
            if boxes:
                found.append(Boxes(path, boxes))
        return found or [Boxes("", [])]

    def read(self, partition: Boxes) -> Iterator[pa.RecordBatch]:
        if not partition.boxes:
            return
        s = self.source
        store = s.open(partition.path)
        names, dims = table_of(store, s.wanted)
        kinds = {f.name: k for f, k in zip(*s.fields(store))}
        shape = store.variables[names[0]].shape
        labels = {d: s.labels(store, d, n) for d, n in zip(dims, shape)}
        for box in partition.boxes:
            values = {k: store.box(k, box).reshape(-1) for k in names}
            sizes = [b - a for a, b in box]
            n = int(np.prod(sizes))
            for at in range(0, n, BATCH):
                cells = np.unravel_index(np.arange(at, min(at + BATCH, n)), sizes)
                out = {d: column(labels[d][i + lo], kinds[d]) for d, i, (lo, _) in zip(dims, cells, box)}
                out |= {k: column(decoded(v[at : at + BATCH], store.variables[k].attrs), kinds[k]) for k, v in values.items()}
                if s.file_column:
                    out[s.file_column] = pa.array([partition.path] * len(cells[0]), pa.string())
                yield pa.RecordBatch.from_pydict(out)


class ArraySource(ds.DataSource, ABC):
    """Options: ``variables``, by commas (all of the most dimensions); ``times_as``, ``date`` or ``timestamp``; ``file_column``, a
    column for the path. Attributes ``units`` become the columns' metadata. Dimensions without labels count from 0."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.paths: list[str] = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.wanted = [x.strip() for x in options.get("variables", "").split(",") if x.strip()]
        self.times_as, self.file_column = options.get("times_as", "date"), options.get("file_column")

    @abstractmethod
    def open(self, path: str) -> Store: ...

    def labels(self, store: Store, dim: str, n: int) -> np.ma.MaskedArray:
        v = store.variables.get(dim)
        if v is None or v.dims[:1] != (dim,):
            return np.ma.masked_array(np.arange(n), mask=np.zeros(n, bool))
        attrs = {k: x for k, x in v.attrs.items() if k not in ("_FillValue", "missing_value")}
        made = decoded(store.box(dim, whole(v)), attrs)
        return made.astype("datetime64[D]") if made.dtype.kind == "M" and self.times_as == "date" else made

    def fields(self, store: Store) -> tuple[list[T.StructField], list[pa.DataType]]:
        names, dims = table_of(store, self.wanted)
        made, kinds = [], []
        for name in (*dims, *names):
            v = store.variables.get(name) or Variable((name,), (0,), np.dtype("int64"), (1,))
            spark, arrow = field_type(v, self.times_as)
            units = str(v.attrs.get("units", ""))
            made.append(T.StructField(name, spark, True, {"units": units} if units and " since " not in units else None))
            kinds.append(arrow)
        if self.file_column:
            made.append(T.StructField(self.file_column, T.StringType()))
            kinds.append(pa.string())
        return made, kinds

    def schema(self) -> T.StructType:
        return T.StructType(self.fields(self.open(self.paths[0]))[0])

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(self)


def register(spark: SparkSession) -> None:
    """Makes ``zarr`` and ``netcdf4`` known to the session, and lets filters reach them."""
    from tailcast.sources.netcdf import NetcdfSource
    from tailcast.sources.zarr import ZarrSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZarrSource, NetcdfSource):
        spark.dataSource.register(source)
