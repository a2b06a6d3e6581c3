"""Helpers shared by the text operators: saved tables, size-checked joins, vectorised words."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted and are no more than this.
BROADCAST_ROWS = 50_000
#: Bytes of text that one numpy step works on, so that its temporaries stay near 100 MB.
STEP_BYTES = 1_500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a new local folder serves, in local mode only, and is
    remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tailcast.shared.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tailcast-")
    spark.conf.set("tailcast.shared.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it: lineage ends
    there, and a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tailcast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search("/tailcast-[0-9a-f]{32}$", folder):  # as saved names them
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def small_side(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``table`` (saved before, so that counting is cheap) has
    at most ``most`` rows; else the plain table, joined by shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Bits of ``id_bitmap``: 8 MB whatever the number of ids.
BITMAP_BITS = 26


def id_bitmap(ids: DataFrame) -> Broadcast:
    """A broadcast bitmap of fixed size of the low bits of hashed 64-bit ``id``s, made by
    grouped aggregation. What it lacks is surely not among the ids; the more there are,
    the more it lets through besides, so it only saves work ahead of an exact join."""
    slot = F.col("id").bitwiseAND((1 << BITMAP_BITS) - 1)
    parts = ids.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits"))
    whole = np.zeros(1 << BITMAP_BITS >> 3, dtype=np.uint8)
    for row in parts.collect():  # at most 2048 rows of 4 KB
        whole[row["part"] << 12 : (row["part"] + 1) << 12] = np.frombuffer(row["bits"], dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole)


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids & ((1 << BITMAP_BITS) - 1)
    return (bitmap[slot >> 3] >> (slot & 7)) & 1 > 0


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed, null as empty; ASCII alone goes the shorter way."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def added_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns added for a while: ``_name``, with as many more underscores before
    it as it takes to be none of ``df``'s, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``, for fitting. Hashes
    under a bound, set by the number of rows to let half as many again through, are
    picked where they are read, so that no task gathers more than that."""
    part = min(1.0, 1.5 * most / max(df.count(), 1))
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return df.where(spread <= int(part * (1 << 30))).orderBy(spread, key).limit(most)


def steps(batches: Iterable[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row slices of Arrow batches with the bytes of ``column``, null as empty; a
    slice has at most ``most`` bytes of text, or one row."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        first, held = 0, 0
        for i, x in enumerate(texts):
            if i > first and held + len(x) > most:
                yield batch.slice(first, i - first), texts[first:i]
                first, held = i, 0
            held += len(x)
        if texts:
            yield batch.slice(first), texts[first:]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= STEP_BYTES + 4096:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than ``most`` bytes in parts of about eight that end where two bytes say so,
    so that an edit changes the parts next to it only."""
    long = np.flatnonzero(ends - starts > most)
    if not len(long):
        return starts, ends
    size = ends[long] - starts[long] - 1
    inner = np.arange(size.sum()) + np.repeat(starts[long] + 1 - (np.cumsum(size) - size), size)
    pair = buf[inner - 1].astype(np.uint64) << np.uint64(8) | buf[inner]
    cuts = inner[mix(pair + np.uint64(1)) >> np.uint64(61) == 0]
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))


def word_hashes(texts: list[bytes], longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, of
    all texts in order, and for each text the index of its first word (one more
    entry at the end). Words of more than ``longest`` bytes, if given, are cut."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if longest:
        starts, ends = _cut(buf, starts, ends, longest)
    lengths = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(buf)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _BACK, len(buf))[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), first


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word
    shingles; a shorter text is one shingle, one without words none."""
    words, first = word_hashes(texts)
    n = len(words)
    rolled = words.copy()
    for k in range(1, min(size, n)):
        rolled[: n - k] = mix(rolled[: n - k] * np.uint64(0xD6E8FEB86659FD93) + words[k:])
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        else:
            h = words[lo:hi][:1].copy()
            for w in words[lo + 1 : hi]:
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(h)
    return out
