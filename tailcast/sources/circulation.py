"""Finding the files that hold the days about an event, before anything of them is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.sources.files import read
from tailcast.tables import written

#: Files that one call reads at most: their names go through the driver, as those of any read do.
MOST_FILES = 100_000


def catalogue(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``described`` files under a folder, on any store that Spark reads; they are listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return described(found.select("path"))


def described(paths: DataFrame, part: int = 9) -> DataFrame:
    """(path, model, run, start_year, first, last) of ``path``s: the ``part``-th part of the path (null if shorter), ``r1i2p3f4``,
    the year of ``s1960-``, and the days from ``19600101-19601231``, months or years before the suffix. What a
    path lacks is null; a file without dates may hold any day."""
    path = F.col("path")

    def group(pattern: str, k: int = 1) -> Column:
        got = F.regexp_extract(path, pattern, k)
        return F.when(got != "", got)

    dates = r"[_.-](\d{4}(?:\d{2}){0,2})-(\d{4}(?:\d{2}){0,2})\.[A-Za-z.]+$"
    early, late = group(dates, 1), group(dates, 2)
    first = F.when(F.length(early) == 8, F.to_date(early, "yyyyMMdd")).when(F.length(early) == 6, F.to_date(early, "yyyyMM")).otherwise(F.to_date(early, "yyyy"))
    last = F.when(F.length(late) == 8, F.to_date(late, "yyyyMMdd")).when(F.length(late) == 6, F.last_day(F.to_date(late, "yyyyMM"))).otherwise(F.make_date(F.substring(late, 1, 4).cast("int"), F.lit(12), F.lit(31)))
    model = F.get(F.split(path, "/"), F.lit(part - 1))
    return paths.select("path", model.alias("model"), group(r"(r\d+i\d+p\d+f\d+)").alias("run"), group(r"[/_.-]s(\d{4})-").cast("int").alias("start_year"), first.alias("first"), last.alias("last"))


def files_of_events(events: DataFrame, files: DataFrame, days: int, event: str = "event", time: str = "time", run: str | None = None, init_date: str | None = None, init_year_offset: int = 0) -> DataFrame:
    """(event, path): the ``described`` files that may hold a day of the ``days`` before an event's and that day itself, of its ``run`` and
    of the start in the year of its ``init_date`` plus the offset, if these columns are named. An interval join of two tables of names."""
    wanted = events.select(event, F.date_sub(F.col(time).cast("date"), days).alias("_from"), F.col(time).cast("date").alias("_to"), *[F.col(c).alias(a) for c, a in ((run, "_run"), (init_date, "_init")) if c])
    held = (F.coalesce(F.col("first") <= F.col("_to"), F.lit(True))) & (F.coalesce(F.col("last") >= F.col("_from"), F.lit(True)))
    if run:
        held &= F.col("run") == F.col("_run")
    if init_date:
        held &= F.col("start_year") == F.year("_init") + init_year_offset
    return wanted.join(files, held).select(event, "path").distinct()


def event_fields(spark: SparkSession, events: DataFrame, files: DataFrame, days: int, agg: str = "mean", event: str = "event", time: str = "time", by: Sequence[str] = ("lat", "lon"), value: str = "value", file_format: str | None = None, **matching: object) -> DataFrame:
    """(event, by..., value): the field over the ``days`` before each event's and that day itself, from the files that ``files_of_events``
    finds alone. Of an event only its own files count. No file found is an error."""
    found = written(files_of_events(events, files, days, event, time, **matching))
    names = sorted(r["path"] for r in found.select("path").distinct().limit(MOST_FILES + 1).collect())
    if not names or len(names) > MOST_FILES:
        raise ValueError(f"{'no' if not names else 'more than ' + str(MOST_FILES)} files of these events")
    field = read(spark, names, file_format, "_path").withColumnRenamed(value, "value")
    spread = events.select(event, F.explode(F.sequence(F.date_sub(time, days), F.col(time).cast("date"))).alias("_day"))
    mine = field.withColumn("_day", F.col("time").cast("date")).join(spread, "_day").join(found.withColumnRenamed("path", "_path"), [event, "_path"])
    return mine.groupBy(event, *by).agg({"mean": F.avg, "sum": F.sum}[agg]("value").alias("value"))
