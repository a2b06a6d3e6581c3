"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's rows are cut into blocks. With integer shares that add up to D, block k
(from 0) of a source of share q may start at slot floor(k*D/q) and must be done by
slot ceil((k+1)*D/q); in each slot the released block with the earliest deadline
goes first. The plan of D slots repeats, for after D slots every source has had
exactly its share.

Sources of one share have the same releases and deadlines. So the schedule is worked out for the
named sources and for the stretches of all others between these in the order of names, and a source
finds its slots by its place in its stretch; there may be any number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.llm.common import added_names, discard, saved, small_side

#: Rows that one window task ranks at most, on average; only speed depends on it.
RANK_ROWS = 500
#: What the shares of named sources and stretches may add up to: the schedule has as many rows, squared.
MOST_TURNS = 2_000


def stretches(sources: DataFrame, named: list[str]) -> DataFrame:
    """(source, share, stretch, nth), saved: for (source, share), one row a source, with one share for all
    but ``named``: the number of its stretch in the order of names, in which each named source is
    one of its own, and the source's number in it from 0.

    Sorted by ranges of names, with the counts of the ranges before added.
    """
    names = F.array(*[F.lit(n) for n in sorted(named)]).cast("array<string>")
    below = F.size(F.filter(names, lambda n: n < F.col("source")))
    own = sources.withColumn("stretch", 2 * below + F.array_contains(names, F.col("source")).cast("int"))
    dealt = saved(own.repartitionByRange("source").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("stretch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("stretch", "range").count().select("stretch", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("stretch", "range").orderBy("source")
    placed = dealt.withColumn("at", F.row_number().over(within)).join(offsets, ["stretch", "range"])
    out = saved(placed.select("source", "share", "stretch", (F.col("offset") + F.col("at") - 1).alias("nth")))
    discard(dealt)
    return out


def runs(shares: DataFrame) -> DataFrame:
    """For (stretch, share, sources), one row a stretch, (stretch, turn, first, slot, length, cycle_length), saved:
    the sources of a stretch get their slots of a turn in runs; a run of ``length`` sources from number
    ``first`` has the slots from ``slot``.

    Earliest deadline first, ties to the smaller stretch, so to the smaller source. By time t the
    jobs of the g highest priorities have been served min over u <= t of (jobs of these released
    before u) + t - u times, where only releases matter as u; what priority g gets between two
    releases is the rest after those before it.
    """
    whole = shares.agg(F.sum(F.col("share") * F.col("sources")), F.sum("share")).first()
    if (whole[1] or 0) > MOST_TURNS:
        raise ValueError(f"the shares of named sources and of the stretches between them may add up to {MOST_TURNS}")
    jobs = shares.withColumn("d", F.lit(whole[0]).cast("long")).select("*", F.explode(F.expr("sequence(0L, share - 1)")).alias("turn"))
    jobs = jobs.withColumn("release", F.expr("(turn * d) div share")).withColumn("deadline", F.expr("((turn + 1) * d + share - 1) div share"))
    timed = jobs.withColumn("releases", F.collect_set("release").over(Window.partitionBy("d")))
    grid = saved(timed.select("stretch", "sources", "turn", "d", "release", "deadline", F.explode(F.concat("releases", F.array("d"))).alias("t")))
    by_priority = Window.partitionBy("t").orderBy("deadline", "stretch")
    by_time = Window.partitionBy("stretch", "turn").orderBy("t")
    arrived = F.sum(F.when(F.col("release") < F.col("t"), F.col("sources")).otherwise(0)).over(by_priority.rowsBetween(Window.unboundedPreceding, 0))
    ahead = grid.withColumn("ahead", arrived - F.col("t"))
    served = ahead.withColumn("served", F.col("t") + F.min("ahead").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    later = served.withColumn("then", F.lead("served").over(by_time))
    gained = later.withColumn("gained", F.col("then") - F.col("served"))
    lower = gained.withColumn("served_before", F.lag("served", 1, 0).over(by_priority)).withColumn("gained_before", F.lag("gained", 1, 0).over(by_priority))
    own = lower.select("stretch", "turn", F.expr("served - served_before").alias("first"), F.expr("t + gained_before").alias("slot"), F.expr("gained - gained_before").alias("length"), F.col("d").alias("cycle_length"))
    out = saved(own.where("length > 0"))
    discard(grid)
    return out


def _runs_of(places: DataFrame) -> DataFrame:
    return runs(places.groupBy("stretch", "share").agg(F.count("*").alias("sources")))


def plan(sources: DataFrame) -> DataFrame:
    """(source, slot, turn, cycle_length) of one cycle for (source, share), one row a
    source: slot from 0, turn from 0 among the source's own slots. As many rows as the shares add up to.
    Sources of other than the commonest share are taken as the named ones."""
    typed = sources.select("source", F.col("share").cast("long").alias("share"))
    common = typed.groupBy("share").count().orderBy(F.desc("count"), "share").first()
    named = typed.where(F.col("share") != common["share"]).select("source").limit(MOST_TURNS + 1) if common else typed.limit(0)
    places = stretches(typed, [r["source"] for r in named.collect()])
    at = (F.col("stretch") == F.col("of")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("length"))
    return places.join(small_side(_runs_of(places).withColumnRenamed("stretch", "of")), at).select("source", (F.col("slot") + F.col("nth") - F.col("first")).alias("slot"), "turn", "cycle_length")


def _shares(source: Column, shares: dict[str, int], other: int) -> Column:
    if not shares:
        return F.lit(other).cast("long")
    named = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    return F.coalesce(F.try_element_at(named, source), F.lit(other)).cast("long")


def mixed(docs: DataFrame, shares: dict[str, int], other: int = 1, block_rows: int = 64, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``_source``, ``_block`` (from 0 in its source), ``_cycle``, ``_slot``
    and ``_rank`` (from 0 in its source), which replace columns of these names; others pass
    through. In the order of _cycle, _slot, _rank the
    number of blocks that a source has had differs from its share of the blocks so far
    by less than one, as long as all sources last. When one runs out its slots are
    skipped; the others keep their proportions, and every row appears once.

    A source's rows are in the order of the MD5 of the id, then the id, then the hash of all
    columns: a fixed shuffle; only rows alike in every column come in any order. Sources without a
    share get ``other``; a null source is the source ''. Shares and block size must be at least 1, and
    shares of the named sources and of the stretches between them may add up to ``MOST_TURNS``.

    Ranks come from counts of each source's leading MD5 digits, so many that a window
    ranks about RANK_ROWS rows however large the source is; the counts are added up in two steps.
    Rows of one MD5, so of one id, are ranked by one task.
    """
    if block_rows < 1 or other < 1 or any(v < 1 for v in shares.values()):
        raise ValueError("shares and block_rows must be at least 1")
    results = ["_source", "_block", "_cycle", "_slot", "_rank"]
    rest = [c for c in docs.columns if c.lower() not in results]
    src, mark, part, part_, spread, nth, before, of, share, stretch, base = added_names(docs, "src", "mark", "part", "part_of", "spread", "nth", "before", "of", "share", "stretch", "base")
    block, cycle, turn, rank, run, run_turn, first, slot, length = added_names(docs, "b", "c", "t", "r", "run", "run_turn", "first", "s", "length")
    kept = docs.withColumn(src, F.coalesce(F.col(source).cast("string"), F.lit("")))
    sizes = saved(kept.groupBy(F.col(src).alias("source")).agg(F.count("*").alias("n")).withColumn("share", _shares(F.col("source"), shares, other)))
    largest, digits = sizes.agg(F.max("n")).first()[0] or 0, 0
    while largest > RANK_ROWS * 16**digits and digits < 8:
        digits += 1
    kept = kept.withColumn(mark, F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))).withColumn(spread, F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]))
    kept = kept.withColumn(part, F.substring(mark, 1, digits))
    counts = kept.groupBy(F.col(src).alias("source"), F.col(part).alias("part")).agg(F.count("*").alias("n"))
    counts = saved(counts.withColumn("high", F.substring("part", 1, digits // 2)))
    upto = Window.unboundedPreceding, -1
    tops = counts.groupBy("source", "high").agg(F.sum("n").alias("all"))
    tops = tops.select("source", "high", F.coalesce(F.sum("all").over(Window.partitionBy("source").orderBy("high").rowsBetween(*upto)), F.lit(0)).alias("above"))
    offsets = counts.withColumn("below", F.coalesce(F.sum("n").over(Window.partitionBy("source", "high").orderBy("part").rowsBetween(*upto)), F.lit(0)))
    offsets = offsets.join(tops, ["source", "high"]).select(F.col("source").alias(of), F.col("part").alias(part_), (F.col("above") + F.col("below")).alias(before))
    within = Window.partitionBy(src, part).orderBy(mark, doc_id, spread)
    ranked = kept.withColumn(nth, F.row_number().over(within)).join(offsets, (F.col(src) == F.col(of)) & (F.col(part) == F.col(part_))).drop(of, part_)

    places = stretches(sizes.select("source", "share"), list(shares))
    found = _runs_of(places).select(*[F.col(c).alias(n) for c, n in (("stretch", run), ("turn", run_turn), ("first", first), ("slot", slot), ("length", length))])
    own = places.select(*[F.col(c).alias(n) for c, n in (("source", of), ("share", share), ("stretch", stretch), ("nth", base))])
    ranked = ranked.join(small_side(own), F.col(src) == F.col(of)).drop(of).withColumn(rank, F.col(before) + F.col(nth) - 1)
    ranked = ranked.withColumn(block, F.expr(f"`{rank}` div {block_rows}")).withColumn(cycle, F.expr(f"`{block}` div `{share}`")).withColumn(turn, F.col(block) % F.col(share))
    at = (F.col(stretch) == F.col(run)) & (F.col(turn) == F.col(run_turn)) & (F.col(base) >= F.col(first)) & (F.col(base) < F.col(first) + F.col(length))
    placed = ranked.join(small_side(found), at)
    values = [F.col(src), F.col(block), F.col(cycle), F.col(slot) + F.col(base) - F.col(first), F.col(rank)]
    return placed.select(*rest, *[v.alias(name) for v, name in zip(values, results, strict=True)])


def in_order(placed: DataFrame, keep: list[str]) -> DataFrame:
    """The rows of ``mixed`` with only the columns ``keep``, dealt and sorted so that
    files, read by name, have them in the order of the schedule."""
    order = ["_cycle", "_slot", "_rank"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep)


def positioned(docs: DataFrame) -> DataFrame:
    """``docs``, just read from Parquet files, with ``position`` (long, from 0), which replaces a column of
    this name: the place in the order of the files' numbers, then of rows in a file, whatever splits
    they are read in. One row a file is numbered in one task."""
    name, row, before = added_names(docs, "file", "row", "before")
    kept = [c for c in docs.columns if c.lower() != "position"]
    meta = docs.metadataColumn("_metadata")
    at = docs.select(*kept, meta["file_name"].alias(name), meta["row_index"].alias(row))
    number = F.regexp_extract("file", r"^part-([0-9]{1,18})", 1)
    upto = Window.orderBy(F.when(number != "", number).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = at.groupBy(F.col(name).alias("file")).agg(F.max(row).alias("last"))
    files = files.select(F.col("file").alias(name), F.coalesce(F.sum(F.col("last") + 1).over(upto), F.lit(0)).alias(before))
    placed = at.join(small_side(saved(files)), name)
    return placed.select(*kept, (F.col(before) + F.col(row)).cast("long").alias("position"))
