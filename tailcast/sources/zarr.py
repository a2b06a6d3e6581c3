"""Zarr stores (version 2), in folders or archives, as tables."""

from __future__ import annotations

import bz2
import itertools
import json
import lzma
import zipfile
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs

from tailcast.sources.arrays import ArraySource, Box, Store, Variable


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def blosc(data: bytes) -> bytes:
    """A frame of Blosc: blocks of streams, each compressed, with bytes of a kind together if shuffled."""
    flags, width = data[2], data[3]
    size, block_size = (int.from_bytes(data[i : i + 4], "little") for i in (4, 8))
    if flags & 2:  # stored
        return data[16 : 16 + size]
    codec = {1: "lz4_raw", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if codec is None or flags & 4:
        raise ValueError("Blosc frames of this codec or shuffled by bits aren't read")
    blocks = -(-size // block_size)
    out = []
    for k in range(blocks):
        at = int.from_bytes(data[16 + 4 * k : 20 + 4 * k], "little")
        n = min(block_size, size - k * block_size)
        split = not flags & 16 and n == block_size and width <= 16 and block_size >= 128 * width
        streams = width if split else 1
        parts = []
        for _ in range(streams):
            packed = int.from_bytes(data[at : at + 4], "little")
            piece, at = data[at + 4 : at + 4 + packed], at + 4 + packed
            if packed != n // streams:  # else stored
                piece = zlib.decompress(piece) if codec == "zlib" else pa.decompress(piece, n // streams, codec, asbytes=True)
            parts.append(piece)
        block = b"".join(parts)
        if flags & 1 and width > 1:
            even = n // width * width
            block = np.frombuffer(block[:even], "u1").reshape(width, -1).T.tobytes() + block[even:]
        out.append(block)
    return b"".join(out)


def zstd(data: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()


# Names of compressors.
CODECS: dict[str, Callable[[bytes], bytes]] = {"zlib": zlib.decompress, "gzip": lambda x: zlib.decompress(x, 31), "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": zstd, "blosc": blosc}


class ZarrStore(Store):
    """Metadata are read at once; chunks when asked for. A chunk that isn't there has the fill value."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = filesystem(path.rstrip("/"))
        self.archive = zipfile.ZipFile(self.fs.open_input_file(self.root)) if path.endswith(".zip") else None
        self.arrays: dict[str, dict] = {}
        self.variables = {}
        meta = self._metadata(path)
        for key, made in meta.items():
            name, _, what = key.rpartition("/")
            if what != ".zarray":
                continue
            attrs = dict(meta.get(f"{name}/.zattrs", {}))
            dims = tuple(attrs.pop("_ARRAY_DIMENSIONS", [f"{name}_{i}" for i in range(len(made["shape"]))]))
            fill = made["fill_value"]
            fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(fill, fill) if isinstance(fill, str) else fill
            if fill is not None and np.dtype(made["dtype"]).kind in "iuf":
                attrs["_FillValue"] = fill
            known = [f["id"] for f in made["filters"] or []]
            if known not in ([], ["vlen-utf8"]) or (made["compressor"] and made["compressor"]["id"] not in CODECS):
                raise ValueError(f"{name}: filters {known} or compressor {made['compressor']} not known")
            self.arrays[name] = made | {"fill_value": fill}
            self.variables[name] = Variable(dims, tuple(made["shape"]), np.dtype(made["dtype"]), tuple(made["chunks"]), attrs)

    def _get(self, key: str) -> bytes | None:
        try:
            if self.archive:
                return self.archive.read(key)
            with self.fs.open_input_file(f"{self.root}/{key}") as f:
                return f.read()
        except (KeyError, FileNotFoundError):
            return None

    def _metadata(self, path: str) -> dict[str, dict]:
        together = self._get(".zmetadata")
        if together:
            return json.loads(together)["metadata"]
        if self.archive:
            keys = self.archive.namelist()
        else:
            folders = [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.root)) if x.type == fs.FileType.Directory]
            keys = [f"{x}/{y}" for x in folders for y in (".zarray", ".zattrs")]
        found = {k: self._get(k) for k in keys if k.endswith((".zarray", ".zattrs"))}
        if not any(k.endswith(".zarray") and v for k, v in found.items()):
            raise ValueError(f"no arrays of Zarr version 2 in {path}")
        return {k: json.loads(v) for k, v in found.items() if v}

    def _chunk(self, name: str, at: tuple[int, ...]) -> np.ndarray:
        made, v = self.arrays[name], self.variables[name]
        data = self._get(f"{name}/" + (made.get("dimension_separator", ".").join(map(str, at)) or "0"))
        if data is None:
            fill = made["fill_value"] if made["fill_value"] is not None else ("" if v.dtype.kind in "SUO" else 0)
            return np.full(v.chunks, fill, v.dtype)
        if made["compressor"]:
            data = CODECS[made["compressor"]["id"]](data)
        if v.dtype.kind == "O":
            return np.array(_texts(data), dtype=object).reshape(v.chunks, order=made["order"])
        return np.frombuffer(data, v.dtype).reshape(v.chunks, order=made["order"])

    def box(self, name: str, box: Box) -> np.ndarray:
        v = self.variables[name]
        out = np.empty([b - a for a, b in box], v.dtype)
        for at in itertools.product(*[range(a // c, -(-b // c)) for (a, b), c in zip(box, v.chunks)]):
            lows = [k * c for k, c in zip(at, v.chunks)]
            spans = [(max(a, lo), min(b, lo + c)) for (a, b), lo, c in zip(box, lows, v.chunks)]
            here = tuple(slice(p - lo, q - lo) for (p, q), lo in zip(spans, lows))
            out[tuple(slice(p - a, q - a) for (p, q), (a, _) in zip(spans, box))] = self._chunk(name, at)[here]
        return out


def _texts(data: bytes) -> list[str]:
    """Texts with their lengths in bytes before them, after their number."""
    out, at = [], 4
    for _ in range(int.from_bytes(data[:4], "little")):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out


class ZarrSource(ArraySource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def open(self, path: str) -> ZarrStore:
        return ZarrStore(path)
