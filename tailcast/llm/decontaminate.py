"""Benchmark decontamination, by DataFrame functions only.

Items of a benchmark are cut into windows of ten consecutive words (a shorter item is one
window). Hashes of the windows are a broadcast hash set; all windows of the documents are hashed, held against
it where they are made, and hits verified by their words. Words inside hits are merged to spans, which
are counted, cut out, or condemn their document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.llm.common import saved
from tailcast.llm.licence import words

#: Words of a window.
SIZE = 10
#: Words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of the benchmark that one hash set holds, about; with more the documents are scanned once for each such part.
SET_WINDOWS = 200_000


def _window(w: Column, pos: Column, length: Column) -> Column:
    return F.slice(w, pos + 1, length)


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(hash, gram, length, items): each distinct window, and the sorted ids, as strings, of the items that
    hold it. A null id is '', rows of one id are one item, items without words have no window."""
    w, n = F.col("w"), F.size("w")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(n > 0)
    length = F.least(n, F.lit(size))
    grams = F.transform(F.sequence(F.lit(0), n - length), lambda i: F.array_join(_window(w, i, length), " "))
    each = items.select("item", length.alias("length"), F.explode(F.array_distinct(grams)).alias("gram"))
    grouped = each.groupBy("gram", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return grouped.select(F.xxhash64(F.split("gram", " ")).alias("hash"), "gram", "length", "items")


def hits(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, pos, length, gram): the places, from word 0, where windows of the saved table ``found``
    occur in documents. ``digest`` is a hash of the text: of repeated ids each text counts alone."""
    lengths = sorted(r["length"] for r in found.select("length").distinct().collect())  # at most the words of a window
    sets = -(-found.count() // SET_WINDOWS)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("digest"), words(F.col(text)).alias("w"))
    if not lengths:
        return rows.where(F.lit(False)).select("id", "digest", F.lit(0).alias("pos"), F.lit(0).alias("length"), F.lit("").alias("gram"))
    # the outer form: with the other Spark works the words out once more, to see that there are any
    each = rows.select("id", "digest", "w", F.posexplode_outer("w").alias("pos", "word")).drop("word")
    each = each.withColumn("length", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*[F.lit(k) for k in lengths])))
    own = _window(F.col("w"), F.col("pos"), F.col("length"))
    each = each.where(F.col("pos") + F.col("length") <= F.size("w")).withColumn("hash", F.xxhash64(own))
    same = F.array_join(own, " ")

    def part(k: int) -> DataFrame:
        held = found.where(F.pmod("hash", F.lit(sets)) == k).select(F.col("hash").alias("_hash"), "gram")
        return each.join(F.broadcast(held), (F.col("hash") == F.col("_hash")) & (same == F.col("gram"))).select("id", "digest", "pos", "length", "gram")

    return reduce(DataFrame.unionByName, [part(k) for k in range(sets)])


def spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """(id, digest, first, last, items): runs of words inside windows of the benchmark, from word ``first`` to ``last``,
    and sorted ids of the items whose windows they hold.

    Overlapping and adjoining windows are one run. Null and empty texts, and documents without
    hits, have no row; equal rows give the runs once. Hits are few beside the words read,
    and gathered by document, never by window or item.
    """
    found = saved(windows(benchmark, item_id, item_text, size))
    seen = hits(docs, found, doc_id, text).distinct().join(found.select("gram", "items"), "gram")
    order = Window.partitionBy("id", "digest").orderBy("pos", "length")
    end = F.col("pos") + F.col("length")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = seen.withColumn("new", F.when(F.col("pos") <= before, 0).otherwise(1))
    run = opened.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    items = F.sort_array(F.array_distinct(F.flatten(F.collect_set("items"))))
    return run.groupBy("id", "digest", "run").agg(F.min("pos").alias("first"), (F.max(end) - 1).alias("last"), items.alias("items")).drop("run")


def judged(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_words, n_hit (words inside a window of the benchmark),
    n_items, items_sha256 (of their sorted ids, joined by commas), contaminated.

    Null and empty texts have no words and no hits; without items the digest is that of ''. Other
    columns, of any name, are not read.
    """
    runs = spans(docs, benchmark, doc_id, text, item_id, item_text, size)
    items = F.sort_array(F.array_distinct(F.flatten(F.collect_set("items"))))
    summed = runs.groupBy("id", "digest").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), items.alias("items"))
    summed = summed.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "n_hit", "items")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = rows.join(summed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with its columns, without the contaminated documents, or with ``remove="spans"`` all documents,
    without the runs of words that the benchmark holds (and what stands between the words of a run).

    Null and empty texts stay as they are. Equal rows are treated alike. Columns of any name pass through.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    runs = spans(docs, benchmark, doc_id, text, item_id, item_text, size)
    cut = runs.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    if remove == "documents":
        return rows.join(cut, same, "left_anti").select("row.*")
    joined = rows.join(cut, same, "left")
    changed = F.col("row").withField(text, without(F.col("text"), F.col("runs")))
    return joined.select(F.when(F.col("runs").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*")


def without(text: Column, runs: Column) -> Column:
    """The text less runs of words (sorted structs of first and last)."""
    between, found = F.split(text, WORD), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    tokens = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.concat(a, b))
    # from behind each run to before the next one, and what stands there
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(found)))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat(F.array_join(F.slice(tokens, a + 1, b - a), ""), F.get(between, b))), "")
