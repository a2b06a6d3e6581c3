"""Formats, file lists, metadata files, sinks and provenance."""

from __future__ import annotations

import datetime
import json
import re
import subprocess
import sys
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.dims import DIMS
from tailcast.sources.arrays import register
from tailcast.sources.netcdf import write_netcdf

# What a file name ends with and how it is read.
FORMATS = {".parquet": "parquet", ".csv": "csv", ".csv.gz": "csv", ".json": "json", ".orc": "orc", ".avro": "avro"}
ARRAYS = {".nc": "netcdf4", ".zarr.zip": "zarr", ".zarr": "zarr"}
METADATA_KEYS = ("rename", "drop_coords", "round_coords", "units")


def guess_format(name: str) -> str:
    """The reader's name; ValueError for what is not known."""
    plain = name.rstrip("/")
    for end, kind in (ARRAYS | FORMATS).items():
        if plain.endswith(end):
            return kind
    raise ValueError(f"unknown type of file: {name}")


def read(spark: SparkSession, files: Sequence[str] | str, file_format: str | None = None, path_column: str | None = None, variables: Sequence[str] = ()) -> DataFrame:
    """All files as one lazy table; text formats have a header and are typed by Spark. ``path_column`` has each row's
    file. Of stores of arrays ``variables`` are read alone: they must have the same dimensions."""
    paths = [files] if isinstance(files, str) else list(files)
    kind = file_format or guess_format(paths[0])
    if kind in ARRAYS.values():
        register(spark)
        options = {"path": paths[0]} if len(paths) == 1 else {"paths": json.dumps(paths)}
        return spark.read.format(kind).options(**options, **({"file_column": path_column} if path_column else {}), variables=",".join(variables)).load()
    if path_column:
        return read(spark, paths, kind).withColumn(path_column, F.col("_metadata.file_path"))
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return reader.load(paths)


def file_list(spark: SparkSession, names: Sequence[str] | str) -> list[str]:
    """The names, or those in the lines of a single text file."""
    names = [names] if isinstance(names, str) else list(names)
    if len(names) == 1 and names[0].endswith(".txt"):
        return [r["value"].strip() for r in spark.read.text(names[0], wholetext=False).collect() if r["value"].strip()]
    return names


def chunks(items: Sequence[str], n: int) -> Iterator[Sequence[str]]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


def nested(names: Sequence[str], n_time: int, n_ensemble: int) -> list[list[list[str]]]:
    """Starts, of members, of files: times change fastest in the list, starts slowest."""
    if len(names) % (n_time * n_ensemble):
        raise ValueError("files don't fill starts of so many members and times")
    return [[list(x) for x in chunks(start, n_time)] for start in chunks(names, n_time * n_ensemble)]


def load_metadata(path: str) -> dict:
    with open(path) as f:
        made = yaml.safe_load(f) or {}
    unknown = set(made) - set(METADATA_KEYS)
    if unknown:
        raise KeyError(f"unknown keys in {path}: {sorted(unknown)}")
    return made


def fix_metadata(df: DataFrame, metadata: dict) -> DataFrame:
    """Renames columns (their old names are kept as ``original_name``), drops coordinates,
    rounds others to three decimals, and sets units."""
    for old, new in metadata.get("rename", {}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new).withMetadata(new, df.schema[old].metadata | {"original_name": old})
    df = df.drop(*metadata.get("drop_coords", []))
    for name in metadata.get("round_coords", []):
        df = df.withColumn(name, F.round(name, 3))
    for name, unit in metadata.get("units", {}).items():
        df = with_unit(df, name, unit)
    return df


def with_unit(df: DataFrame, name: str, unit: str) -> DataFrame:
    return df.withMetadata(name, df.schema[name].metadata | {"units": unit})


def unit_of(df: DataFrame, name: str) -> str | None:
    return df.schema[name].metadata.get("units")


def provenance(inputs: dict[str, str] | None = None, repo_dir: str | None = None, argv: Sequence[str] | None = None) -> str:
    """A line on when and how a table was made, then what is known of its inputs."""
    commit = ""
    if repo_dir:
        done = subprocess.run(["git", "-C", repo_dir, "rev-parse", "--short", "HEAD"], capture_output=True, text=True)
        commit = f" (git {done.stdout.strip()})" if done.returncode == 0 else ""
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%a %b %d %H:%M:%S %Y")
    lines = [f"{now}: {' '.join(argv or sys.argv)}{commit}"]
    return "\n".join(lines + [f"history of {k}: {v}" for k, v in (inputs or {}).items()])


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), history: str | None = None) -> None:
    """Replaces ``path``. The ending gives the format (Parquet otherwise); one of ``.zip`` puts
    the files into an archive beside, uncompressed, and is for local paths. ``.nc`` is one file in a folder that
    all executors share."""
    if path.endswith(".nc"):
        write_netcdf(df, path, axes_of(df), history)
        return
    target = path.removesuffix(".zip")
    kind = next((v for k, v in FORMATS.items() if target.endswith(k)), "parquet")
    if history and df.columns:
        name = df.columns[-1]
        df = df.withMetadata(name, df.schema[name].metadata | {"history": history})
    df.write.mode("overwrite").format(kind).partitionBy(*partition_by).save(target)
    if path.endswith(".zip"):
        zip_folder(target, path)


def axes_of(df: DataFrame) -> list[str]:
    """The columns that are a cube's coordinates: those of starts and leads, else times, and places, and all texts.
    With starts and leads the time is a variable."""
    cube = [DIMS.init_date, DIMS.ensemble, DIMS.lead_time] if {DIMS.init_date, DIMS.lead_time} <= set(df.columns) else [DIMS.ensemble, DIMS.time]
    texts = [c for c, t in df.dtypes if t == "string"]
    return [c for c in (*texts, *cube, DIMS.lat, DIMS.lon) if c in df.columns]


def zip_folder(folder: str, archive: str) -> None:
    root = Path(folder.removeprefix("file://"))
    with zipfile.ZipFile(archive.removeprefix("file://"), "w", zipfile.ZIP_STORED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(root))
    for p in sorted(root.rglob("*"), reverse=True):
        p.rmdir() if p.is_dir() else p.unlink()
    root.rmdir()


def run_of(path: str) -> str:
    """The member in a path: ``r1i2p3f4`` or with a start, ``s1960-r1i2p3f4``'s ``r1i2p3f4``."""
    found = re.search(r"r\d+i\d+p\d+f\d+", path)
    if not found:
        raise ValueError(f"no member in {path}")
    return found[0]


def model_of(path: str, part: int = 9) -> str:
    """The model: the ``part``-th part of a path, counting from the root's."""
    return path.split("/")[part - 1]


def makefile_variables(makefile: str, target: str = "print_file_vars", **variables: str) -> dict[str, str]:
    """``key=value`` lines that ``make`` prints, by lower-case key."""
    said = subprocess.run(["make", "-f", makefile, target, *[f"{k}={v}" for k, v in variables.items()]], capture_output=True, text=True, check=True).stdout
    return dict(sorted((k.strip().lower(), v.strip()) for k, _, v in (x.partition("=") for x in said.splitlines()) if v))


def load_config(path: str) -> dict:
    """What ``session_from`` takes, from a YAML file."""
    with open(path) as f:
        made = yaml.safe_load(f) or {}
    if set(made) - {"cluster", "conf"}:
        raise KeyError(f"unknown keys in {path}: {sorted(set(made) - {'cluster', 'conf'})}")
    return made


def session_from(config: dict) -> SparkSession:
    """A session from ``{"cluster": local | master address, "conf": {...}}``."""
    master = config.get("cluster", "local")
    if master == "local":
        master = "local[*]"
    elif not re.match(r"local\[|spark://|yarn|k8s://", master):
        raise ValueError(f"unknown cluster {master}")
    return SparkSession.builder.master(master).config(map={"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | config.get("conf", {})).getOrCreate()
