"""Files of NetCDF's classic formats (versions 1, 2 and 5): tables of them, and tables into them."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailcast.sources.arrays import ArraySource, Box, Store, Variable
from tailcast.sources.zarr import filesystem

# The format's numbers of types and tags, and what stands for missing whole numbers.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
FILL = {">i4": -2147483647, ">i8": -9223372036854775806, ">f4": np.nan, ">f8": np.nan}
#: Cells that a task holds and writes together.
SLAB = 1 << 20
EPOCH = "1970-01-01"


class _Header:
    """Reads a header in order."""

    def __init__(self, f: BinaryIO) -> None:
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a file of NetCDF's classic formats (files of version 4 need another data source)")
        self.wide, self.far = magic[3] == 5, magic[3] != 1

    def number(self, wide: bool | None = None) -> int:
        return struct.unpack(*((">q", self.f.read(8)) if (self.wide if wide is None else wide) else (">i", self.f.read(4))))[0]

    def padded(self, n: int) -> bytes:
        return self.f.read(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def listed(self) -> range:
        self.number(False)
        return range(self.number())

    def attributes(self) -> dict:
        found = {}
        for _ in self.listed():
            name, kind, n = self.name(), np.dtype(TYPES[self.number(False)]), self.number()
            data = self.padded(n * kind.itemsize)
            made = np.frombuffer(data, kind)
            found[name] = data.decode(errors="replace") if kind.kind == "S" else (made[0].item() if n == 1 else made.tolist())
        return found


class NetcdfStore(Store):
    """A dimension of records varies slowest, with the values of all its variables together."""

    def __init__(self, path: str) -> None:
        where, name = filesystem(path)
        self.file = where.open_input_file(name)
        h = _Header(self.file)
        records = h.number()
        sizes = [(h.name(), h.number()) for _ in h.listed()]
        h.attributes()
        self.variables, self.places, self.by_record = {}, {}, set()
        record = 0
        for _ in h.listed():
            name = h.name()
            ids = [h.number() for _ in range(h.number())]
            attrs, kind = h.attributes(), np.dtype(TYPES[h.number(False)])
            size, begin = h.number(), h.number(h.far)
            shape = tuple(sizes[i][1] or (records if k == 0 else 0) for k, i in enumerate(ids))
            if ids and sizes[ids[0]][1] == 0:
                self.by_record.add(name)
                record += size
            dims = tuple(sizes[i][0] for i in ids)
            if kind == "S1" and shape:  # texts
                dims, shape, kind = dims[:-1], shape[:-1], np.dtype(f"S{max(1, shape[-1])}")
            self.variables[name], self.places[name] = Variable(dims, shape, kind, _chunks(shape), attrs), begin
        only = [self.variables[k] for k in self.by_record]
        self.record = int(np.prod(only[0].shape[1:])) * only[0].dtype.itemsize if len(only) == 1 else record  # one alone isn't padded

    def _read(self, at: int, n: int, kind: np.dtype) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)

    def _part(self, at: int, kind: np.dtype, shape: Sequence[int], box: Box) -> np.ndarray:
        """What lies between the first and the last cell of a box is read, no more."""
        if any(b <= a for a, b in box):
            return np.empty([max(0, b - a) for a, b in box], kind)
        steps = [int(np.prod(shape[k + 1 :], dtype="int64")) for k in range(len(shape))]
        first = sum(a * s for (a, _), s in zip(box, steps))
        n = sum((b - 1) * s for (_, b), s in zip(box, steps)) - first + 1
        flat = self._read(at + first * kind.itemsize, n, kind)
        return np.lib.stride_tricks.as_strided(flat, [b - a for a, b in box], [s * kind.itemsize for s in steps], writeable=False)

    def box(self, name: str, box: Box) -> np.ndarray:
        v, begin = self.variables[name], self.places[name]
        if name not in self.by_record:
            return self._part(begin, v.dtype, v.shape, box)
        parts = [self._part(begin + r * self.record, v.dtype, v.shape[1:], box[1:]) for r in range(*box[0])]
        return np.stack(parts) if parts else np.empty([0, *[b - a for a, b in box[1:]]], v.dtype)


def _chunks(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Parts of about a slab's cells that are whole in the dimensions that vary fastest."""
    out, left = [], SLAB
    for n in reversed(shape):
        out.append(max(1, min(n, left)))
        left //= max(1, n)
    return tuple(reversed(out))


class NetcdfSource(ArraySource):
    @classmethod
    def name(cls) -> str:
        return "netcdf4"

    def open(self, path: str) -> NetcdfStore:
        return NetcdfStore(path)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def _attribute(name: str, value: object, kind: str) -> bytes:
    data = value.encode() if isinstance(value, str) else np.array(value, kind).tobytes()
    code = 2 if isinstance(value, str) else next(k for k, t in TYPES.items() if t == kind)
    n = len(data) if isinstance(value, str) else 1
    return _name(name) + struct.pack(">iq", code, n) + _padded(data)


def _name(text: str) -> bytes:
    return struct.pack(">q", len(text.encode())) + _padded(text.encode())


def _list(tag: int, items: Sequence[bytes]) -> bytes:
    return struct.pack(">iq", tag if items else 0, len(items)) + b"".join(items)


def header(dims: dict[str, int], attrs: dict[str, str], variables: dict[str, tuple[tuple[str, ...], str, dict]]) -> tuple[bytes, dict[str, int], int]:
    """The head of a file of version 5, where each variable's values begin, and the file's size."""
    order, begins = list(dims), dict.fromkeys(variables, 0)
    sizes = {k: int(np.prod([dims[d] for d in v[0]], dtype="int64")) * np.dtype(v[1]).itemsize for k, v in variables.items()}

    def made() -> bytes:
        parts = []
        for name, (names, kind, has) in variables.items():
            code = next(k for k, t in TYPES.items() if t == kind)
            parts.append(_name(name) + struct.pack(f">q{len(names)}q", len(names), *map(order.index, names)) + _list(ATTRIBUTE, [_attribute(k, v, kind) for k, v in has.items()]) + struct.pack(">iqq", code, -(-sizes[name] // 4) * 4, begins[name]))
        return b"CDF\x05" + struct.pack(">q", 0) + _list(DIMENSION, [_name(k) + struct.pack(">q", n) for k, n in dims.items()]) + _list(ATTRIBUTE, [_attribute(k, v, "i1") for k, v in attrs.items()]) + _list(VARIABLE, parts)

    at = len(made())  # its length doesn't depend on the numbers in it
    for name, size in sizes.items():
        begins[name] = at
        at += -(-size // 4) * 4
    return made(), begins, at


def _stored(df: DataFrame, name: str) -> tuple[Column, str, dict]:
    """A column as the file has it, with its type there and its attributes."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double"), ">f8", {"units": f"days since {EPOCH}", "calendar": "proleptic_gregorian"}
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / 1e6, ">f8", {"units": f"seconds since {EPOCH}", "calendar": "proleptic_gregorian"}
    if isinstance(kind, T.StringType):
        return c, "S1", {}
    unit = {"units": df.schema[name].metadata["units"]} if df.schema[name].metadata.get("units") else {}
    if isinstance(kind, T.FloatType):
        return c, ">f4", unit
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("int"), ">i4", unit
    if isinstance(kind, T.LongType):
        return c, ">i8", unit
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return c.cast("double"), ">f8", unit
    raise ValueError(f"no values of type {kind.simpleString()} in such a file: {name}")


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError("tasks write at offsets of one file: it must be in a folder that all executors see as a local one")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def write_netcdf(df: DataFrame, path: str, dims: Sequence[str], history: str | None = None) -> int:
    """Replaces the file by the cells of a table: ``dims`` are its coordinates, slowest first, all other columns
    its variables. Returns how many cells had a row; others, nulls and NaN are missing. A null coordinate is an
    error, as are two rows of one cell, and columns of text that aren't coordinates.

    One aggregation finds the labels of the axes, which the header holds; so each value's place is known before
    it is written. Rows are shuffled by slabs of a million cells; a task writes a slab of all variables in its place,
    the same again if it is repeated. The folder must be shared; the file has its name only when it is whole.
    The table is worked out twice, once for the axes: write one that is dear first.
    """
    names = [c for c in df.columns if c not in dims]
    stored = {c: _stored(df, c) for c in df.columns}
    if not names or any(stored[c][1] == "S1" for c in names):
        raise ValueError(f"variables must be numbers or times: {names}")
    plain = df.select(*[stored[c][0].alias(c) for c in df.columns])
    kept = [f"`{d}`" for d in dims]
    found = plain.agg(*[F.array_sort(F.collect_set(F.col(c))).alias(f"_{i}") for i, c in enumerate(kept)], *[F.count_if(F.col(c).isNull()).alias(f"_null{i}") for i, c in enumerate(kept)]).first()
    if any(found[f"_null{i}"] for i in range(len(dims))):
        raise ValueError(f"null coordinates among {list(dims)}")
    axes = {d: found[f"_{i}"] for i, d in enumerate(dims)}
    sizes = {d: len(axes[d]) for d in dims}
    texts = {d: np.array([x.encode() for x in axes[d]], dtype="S") for d in dims if stored[d][1] == "S1"}
    lengths = {f"{d}_length": t.dtype.itemsize for d, t in texts.items()}
    variables = {d: ((d, f"{d}_length") if d in texts else (d,), stored[d][1], stored[d][2]) for d in dims}
    variables |= {c: (tuple(dims), stored[c][1], stored[c][2] | {"_FillValue": FILL[stored[c][1]]}) for c in names}
    head, begins, size = header(sizes | lengths, {"history": history} if history else {}, variables)

    target = _local(path)
    part = f"{target}.part"
    with open(part, "wb") as f:
        f.write(head)
        for d in dims:
            f.seek(begins[d])
            f.write((texts[d] if d in texts else np.array(axes[d], stored[d][1])).tobytes())
        f.truncate(size)

    place, step = F.lit(0).cast("long"), 1
    rows = plain
    for i, d in reversed(list(enumerate(dims))):
        kind = plain.schema[d].dataType.simpleString()
        axis = df.sparkSession.createDataFrame([(x, k) for k, x in enumerate(axes[d])], f"`{d}` {kind}, _at{i} long")
        rows = rows.join(axis, d)
        place, step = place + F.col(f"_at{i}") * step, step * sizes[d]
    cells = step
    placed = rows.select(place.alias("_cell"), *[F.col(f"`{c}`").alias(f"_v{k}") for k, c in enumerate(names)])
    nothing = df.sparkSession.range(-(-cells // SLAB)).select((F.col("id") * -1 - 1).alias("_cell"))  # so that each slab has a row
    slab = F.when(F.col("_cell") < 0, -F.col("_cell") - 1).otherwise(F.floor(F.col("_cell") / F.lit(SLAB)))
    kinds, starts = [stored[c][1] for c in names], [begins[c] for c in names]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        seen, low = np.zeros(0, bool), 0
        for batch in batches:
            where = batch.column("_cell").to_numpy(zero_copy_only=False)
            if not out and len(where):
                low = (int(where[0]) // SLAB if where[0] >= 0 else -int(where[0]) - 1) * SLAB
                out = [np.full(min(SLAB, cells - low), FILL[k], k) for k in kinds]
                seen = np.zeros(len(out[0]), bool)
            real = np.flatnonzero(where >= 0)
            at = where[real] - low
            if seen[at].any() or len(np.unique(at)) < len(at):
                raise ValueError("two rows of one cell")
            seen[at] = True
            for k, kind in enumerate(kinds):
                got = batch.column(f"_v{k}").take(pa.array(real))
                known = ~np.asarray(got.is_null())
                out[k][at[known]] = got.drop_null().to_numpy(zero_copy_only=False)
        with open(part, "r+b") as f:
            for begin, values in zip(starts, out):
                f.seek(begin + low * values.dtype.itemsize)
                f.write(values.tobytes())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_pydict({"cells": pa.array([int(seen.sum())], pa.int64())})

    written = placed.unionByName(nothing, allowMissingColumns=True).groupBy(slab.alias("_slab")).applyInArrow(save, "cells long").agg(F.sum("cells")).first()[0]
    os.replace(part, target)
    return written or 0
