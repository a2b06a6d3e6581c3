"""Source divergence audit by a baseline-correction inverted index.

How differently do the sources of a language use its terms? Two sources differ by the sum over all kept terms of
the absolute difference of their smoothed shares. Most terms of a large vocabulary are missing from most
sources, so a pair starts at what it would be if all counts were zero, and the postings of each
term correct that: a source's own postings once for each other source, by their distinct shares; and the
terms that both sources have by pairs of a term's postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.llm.common import lowered, saved, small_side

#: Documents of a language that a kept term is in at least.
LEAST_DOCUMENTS = 30
#: Terms listed for a source at most.
TOP_TERMS = 50


def terms(text: Column) -> Column:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null as empty."""
    return F.array_remove(F.split(lowered(text), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), "")


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(1000000000 * (count + 5) / (total + 5 * size)), exact: in decimals of 38 digits."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * (cast({count} as decimal(19, 0)) + 5)) div (cast({total} as decimal(19, 0)) + 5 * cast({size} as decimal(12, 0)))")


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, m): occurrences of the kept terms in the source's documents of the language
    and in all of the language's. Counted before they are shuffled; a term of a language has a row a source."""
    base = docs.select(_named(lang).alias("lang"), _named(source).alias("source"), terms(F.col(text)).alias("w"))
    kinds = F.array(F.struct(F.lit(0).alias("d"), F.col("w").alias("w")), F.struct(F.lit(1).alias("d"), F.array_distinct("w").alias("w")))
    # the outer forms: with the others Spark works all arrays out once more, to see whether they are empty
    each = base.select("lang", "source", F.explode_outer(kinds).alias("k")).select("lang", "source", F.col("k.d").alias("d"), F.explode_outer("k.w").alias("term")).where("term is not null")
    counted = each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("d")).alias("n"), F.sum("d").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    seen = counted.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("m"), F.sum("docs").over(whole).alias("in_all"))
    return seen.where(F.col("in_all") >= least).drop("in_all")


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _sized(docs: DataFrame, found: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, total, lang_total, size, zero): each occurring group, with the sums of counts, the number of the language's
    kept terms, and the share of a count of zero (null without kept terms)."""
    groups = docs.select(_named(lang).alias("lang"), _named(source).alias("source")).distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = found.groupBy("lang", "term").agg(F.first("m").alias("m")).groupBy("lang").agg(F.sum("m").alias("lang_total"), F.count("*").alias("size"))
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "size"])
    return sized.withColumn("zero", F.when(F.col("size") > 0, share("0", "total", "greatest(size, 1)")))


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language (item), by the sum over the kept
    terms of the absolute differences of shares, largest first. Part ``term``: the source's terms (item) of a
    larger share than in the language as a whole, by the difference, the first ``top``. Ties by item.

    Shares are ``share``'s whole numbers. Null text, lang and source are ''. A group without terms has pairs
    and no terms; a language without kept terms has pairs of value 0. Other columns, of any name, are not read.
    Work grows with the postings and, for each kept term, the square of its sources; a language's pairs
    of sources are the result's own rows.
    """
    found = saved(postings(docs, text, lang, source, least))
    sized = saved(_sized(docs, found, lang, source))
    mine = found.join(small_side(sized), ["lang", "source"]).select("lang", "source", "term", "zero", share("n", "total", "size").alias("p"), share("m", "lang_total", "size").alias("q"))

    lesser, greater = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    other = sized.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    at_zero = F.abs(F.col("zero") - F.col("other_zero"))
    start = sized.join(other, "lang").where(F.col("source") < F.col("item")).select("lang", lesser, greater, F.coalesce(F.col("size") * at_zero, F.lit(0)).alias("value"))
    # the source has the term: as if the other had not
    shares = mine.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("k"))
    alone = F.abs(F.col("p") - F.col("other_zero")) - at_zero
    one = shares.join(small_side(other), "lang").where(F.col("source") != F.col("item")).select("lang", lesser, greater, (F.col("k") * alone).alias("value"))
    # both have: what that takes back
    theirs = mine.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    both_have = F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("other_p") - F.col("zero")) + at_zero
    both = mine.join(theirs, ["lang", "term"]).where(F.col("source") < F.col("item")).select("lang", lesser, greater, both_have.alias("value")).where("value <> 0")
    summed = start.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = summed.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = mine.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    listed = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(listed)
