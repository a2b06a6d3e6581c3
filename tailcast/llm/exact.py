"""Exact deduplication by content sort.

Rows are dealt by sampled splitters over their normalised content, sorted there by
Spark's external sort, and neighbours compared in full. Equal texts are put
together within each input batch first, so that a group of copies of any size
reaches its partition as one row a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.llm.common import added_names, steps

#: Runs of white space but single spaces, which are right already.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Bytes of the text at the head of the sort key; the digest after them keeps
#: splitters short and parts texts that begin alike.
HEAD = 48
_BATCH_BYTES = 8_000_000
_spaces = re.compile(SPACES.encode())


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _plain(texts: list[bytes]) -> list[bytes]:
    return [_spaces.sub(b" ", x) for x in texts]


def content_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct normalised text: the row of ``docs`` with the smallest
    ``doc_id`` (nulls last; any of equal ones) with all its columns, then
    ``_group_size`` (long) and ``_sha256`` (lowercase hex of the normalised text), which replace
    columns of these names.

    Null texts count as empty; an empty table gives no rows.
    """
    groups, size, digest = _grouped(docs, doc_id, text)
    rest = [c for c in docs.columns if c.lower() not in ("_group_size", "_sha256")]
    return groups.select(*rest, F.col(size).alias("_group_size"), F.col(digest).alias("_sha256"))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """``content_groups`` with names of the two columns that none of ``docs`` has."""
    size, digest, head = added_names(docs, "group_size", "sha256", "head")
    shape = docs.withColumns({size: F.lit(0).cast("long"), digest: F.lit(""), head: F.lit(b"")}).schema

    def within_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in steps(batches, text, _BATCH_BYTES):
            ids, best, count = rows.column(doc_id).to_pylist(), {}, {}
            for i, x in enumerate(_plain(texts)):
                j = best.setdefault(x, i)
                count[x] = count.get(x, 0) + 1
                if ids[i] is not None and (ids[j] is None or ids[i] < ids[j]):
                    best[x] = i
            added = pa.array(count.values(), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in best], pa.string()), pa.array([x[:HEAD] for x in best], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.take(pa.array(best.values(), pa.int64())).columns, *added], names=shape.names)

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shape.names.index(size)
        held, held_text, held_size = None, None, 0

        def sized(rows: pa.RecordBatch, sizes: list[int]) -> pa.RecordBatch:
            return rows.set_column(at, size, pa.array(sizes, pa.int64()))

        for rows, texts in steps(batches, text, _BATCH_BYTES):
            plain, sizes = _plain(texts), rows.column(at).to_pylist()
            firsts = [i for i, x in enumerate(plain) if x != (plain[i - 1] if i else held_text)]
            held_size += sum(sizes[: firsts[0] if firsts else None])
            if firsts:
                if held is not None:
                    yield sized(held, [held_size])
                sums = [sum(sizes[a:b]) for a, b in pairwise([*firsts, len(plain)])]
                if firsts[1:]:
                    yield sized(rows.take(pa.array(firsts[:-1], pa.int64())), sums[:-1])
                held, held_text, held_size = rows.slice(firsts[-1], 1), plain[firsts[-1]], sums[-1]
        if held is not None:
            yield sized(held, [held_size])

    local = docs.mapInArrow(within_batches, shape)
    dealt = local.repartitionByRange(head, digest)
    in_order = dealt.sortWithinPartitions(head, digest, normalised(F.col(text)), F.col(doc_id).asc_nulls_last())
    return in_order.mapInArrow(neighbours, shape).drop(head), size, digest


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the smallest id among equal texts; null only if all ids of the
    group are. Rows that repeat both id and text are all marked alike; a row with a
    null id is kept only where ``deduplicate`` would keep it, which this table can't
    show, and is marked as not kept. The digest names groups that full comparisons
    have formed; a hot group is one row on the side of the groups, and adaptive
    execution splits its rows on the other side.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = content_groups(own).select("_sha256", "_group_size", F.col("doc_id").alias("keep_id"))
    rows = own.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return rows.join(groups, rows["text_sha256"] == groups["_sha256"]).select("doc_id", "keep_id", F.col("_group_size").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts: the one with the
    smallest id. The rows come straight out of the sort; nothing is joined. Columns of any names pass through."""
    return _grouped(docs, doc_id, text)[0].select(*docs.columns)
