"""Near-duplicate detection by MinHash with tensored banding.

Two collections of ``tables`` short hashes (``width`` minhashes each) are worked
out per text; the key of table (i, j) joins the i-th of one with the j-th of the
other. So ``tables ** 2`` tables of ``2 * width`` minhashes need
``2 * tables * width`` minhashes instead of ``2 * tables**2 * width``. A pair of
similarity s meets in some table with probability (1 - (1 - s**width)**tables)**2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.llm.buckets import link, shared_only
from tailcast.llm.common import discard, mix, saved, shingle_sets, steps
from tailcast.llm.graph import components

_SIGNED = "id long, n_shingles long, digest string, u array<long>, v array<long>"


def signatures(docs: DataFrame, shingle: int, tables: int, width: int) -> DataFrame:
    """For (id, text): number of distinct shingles, digest of the set and the two
    collections of short hashes (null without words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, 4 * tables * width + 1, dtype=np.uint64)).reshape(2, -1)
        for rows, texts in steps(batches, "text"):
            sets = shingle_sets(texts, shingle)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = sizes > 0
            short = np.zeros((2 * tables, int(full.sum())), dtype=np.uint64)
            if full.any():
                values, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                for k, (flip, times) in enumerate(zip(seeds[0], seeds[1] | np.uint64(1), strict=True)):
                    low = np.minimum.reduceat((values ^ flip) * times, starts)
                    short[k // width] = mix(short[k // width] + low + np.uint64(k + 1))
            place = np.cumsum(full) - 1
            lists = [pa.array([short[part, p].view(np.int64).tolist() if f else None for p, f in zip(place, full, strict=True)], pa.list_(pa.int64())) for part in (slice(0, tables), slice(tables, None))]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes), pa.array(digests), *lists], names=["id", "n_shingles", "digest", "u", "v"])

    return docs.mapInArrow(run, _SIGNED)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least ``percent`` % of their
    union in common; ``texts`` has (id, text)."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, a_texts in steps(batches, "a_text"):
            b_texts = [x or b"" for x in rows.column("b_text").cast(pa.binary()).to_pylist()]
            apart = list(dict.fromkeys(b_texts))
            known = dict(zip(apart, _sets(apart, shingle), strict=True))
            good = []
            for x, y in zip(_sets(a_texts, shingle), b_texts, strict=True):
                y = known[y]
                common = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """``shingle_sets`` in steps of bounded size."""
    out, part, held = [], [], 0
    for x in texts:
        if part and held + len(x) > 1_500_000:
            out, part, held = out + shingle_sets(part, shingle), [], 0
        part.append(x)
        held += len(x)
    return out + (shingle_sets(part, shingle) if part else [])


def across_components(placed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of (id, component) in different components that may be linked; every
    linked pair is among them.

    A prefix join: with each text's shingles in one order, rarest first, two texts with
    an overlap of o share one of the first n - o + 1 of each, and what follows their
    first common shingle must leave room for the rest of the overlap. Edited shingles
    are rare and come first, so that copies apart by their edits never meet.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts_ in steps(batches, "text"):
            sets = shingle_sets(texts_, shingle)
            names = pa.array([hashlib.blake2b(s.tobytes(), digest_size=8).hexdigest() for s in sets])
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("component"), names, values], names=["id", "component", "set", "s"])

    sets = texts.join(placed, "id").select("id", "component", "text").mapInArrow(run, "id long, component long, set string, s array<long>")
    each = sets.select("id", "component", "set", F.size("s").cast("long").alias("n"), F.explode("s").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often"))
    first = Window.partitionBy("id", "set").orderBy("often", "s")
    ranked = each.join(often, "s").withColumn("at", F.row_number().over(first) - 1)
    prefix = saved(ranked.where((F.col("often") > 1) & (100 * (F.col("n") - F.col("at")) >= percent * F.col("n"))))
    x, y = prefix.alias("x"), prefix.alias("y")
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    sizes = F.col("x.n") + F.col("y.n")
    could = (F.col("x.component") < F.col("y.component")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * room >= percent * sizes)
    return x.join(y, (F.col("x.s") == F.col("y.s")) & could).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, tables: int = 8, width: int = 3, exact: bool = False) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer than
    ``shingle`` words is one shingle; one without words, or null, has none and is linked
    with nothing. Texts with equal sets form a class, named by its smallest id, at
    once; the tables work on classes only, so copies cost nothing further.

    Pairs are verified on full sets, and no link that the tables offer is lost (see
    ``buckets.link``); a pair's sizes must allow it. With ``exact`` a prefix join over all classes
    then finds what no table has put together, at a cost that grows with how often shingles repeat.
    Rows that share an id are one document when links are followed. A null id gets the
    component of its equals, or null, and is not kept. Empty tables give no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = saved(signatures(own, shingle, tables, width))
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("u").alias("u"), F.first("v").alias("v")).where("id is not null")
    keys = classes.select("id", F.explode("u").alias("u"), "v").select("id", "u", F.explode("v").alias("v")).select(F.xxhash64("u", "v").alias("key"), "id")

    def sized(x: Column, y: Column) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    members = shared_only(keys, classes.select("id", F.col("n").alias("attr")), sized(F.min("attr"), F.max("attr")))
    texts = saved(own.join(members.select("id").distinct(), "id", "left_semi"))
    linked = link(members, sized, lambda pairs: verified(pairs, texts, shingle, percent), lambda placed: across_components(placed.select("id", "component").distinct(), texts, shingle, percent), 0)
    if exact:
        everyone = classes.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        whole = saved(own.join(classes.select("id"), "id", "left_semi"))
        tree = linked.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = saved(verified(across_components(everyone, whole, shingle, percent), whole, shingle, percent))
        linked = saved(components(tree.union(found)))
        discard(whole, found)
    # written, so that the hot side of the last join is an exchange that can be split
    named = saved(classes.select("digest", F.col("id").alias("name")).join(linked.withColumnRenamed("id", "name"), "name", "left").select("digest", F.coalesce("component", "name").alias("component")))
    out = signed.join(named, "digest", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    discard(members, texts, linked)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep. Rows with a null
    id stay."""
    gone = near_duplicates(docs, doc_id, text, **how).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")
