"""URL filters from association rules.

FP-growth mines which combinations of URL tokens go with blocked pages; rules pruned
by support, confidence and lift are indexed by their rarest token, and a URL is held only
against the rules that its tokens lead to. Fixed rules of host and path come first.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.llm.common import discard, saved, small_side

#: (verdict, host and path); the longest that fits decides.
Rules = Sequence[tuple[str, str]]
#: Standard deviations of the interval that a rule's share of blocked URLs lies in: 90 %.
SURE = 1.645


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, each part of the host, each part of the path with
    runs of digits as #, names of query parameters, presence of a fragment."""
    lower = F.translate(F.coalesce(url, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(lower, r"^([a-z0-9+.-]*)://", 1)))
    host = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host="), x))
    path = F.transform(F.split(F.regexp_replace(path_of(lower), r"[0-9]+", "#"), r"[/.]"), lambda x: F.concat(F.lit("path="), x))
    query = F.transform(F.regexp_extract_all(lower, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("query="), x))
    mark = F.when(F.contains(lower, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(scheme, host, path, query, mark), lambda x: ~x.isin("host=", "path=", "scheme=")))


def _lowest(blocked: Column, urls: Column) -> Column:
    """Lower end of Wilson's interval of a share, so that few URLs alone make no confident rule."""
    share, z = blocked / urls, SURE * SURE / urls
    return (share + z / 2 - SURE * F.sqrt(share * (1 - share) / urls + z / (4 * urls))) / (1 + z)


def mine(labelled: DataFrame, url: str = "url", blocked: str = "blocked", confidence: float = 0.75, least: int = 5, lift: float = 1.5, longest: int = 3, widest: int = 12) -> DataFrame:
    """(rule, token, items, blocked, urls, confidence), saved: combinations of up to ``longest`` tokens that
    at least ``least`` different blocked URLs have, however many are labelled, and whose URLs are blocked
    in a share of at least ``confidence`` and ``lift`` times the rate of all, by the lower end of the share's
    90 % interval (``confidence`` in the result). ``token`` is the rarest one. A combination adds nothing
    if a part of it is a rule of no less confidence. No labels, no rules.

    FP-growth runs over the blocked URLs' frequent tokens; how often combinations are found among all is
    counted through the index that matches rules. Tokens that the same URLs have are one item, named by
    all of them in a rule. A URL of more than ``widest`` items is mined as several baskets of that many, such that any ``longest``
    items are together in one, so that no basket has more combinations, whatever the URL's length, and none is left out;
    what it adds to a combination's support is corrected by that count. A URL with
    different labels counts as blocked if most of them are; equal URLs count once.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col(blocked).isNotNull() & F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg((F.avg(F.col(blocked).cast("int")) > 0.5).alias("blocked"))
    known = saved(known.select(F.xxhash64("url").alias("id"), "blocked", tokens(F.col("url")).alias("tokens")))
    rate = known.agg(F.avg(F.col("blocked").cast("int")), F.count_if("blocked")).first()
    empty = spark.createDataFrame([], "rule long, token string, items array<string>, blocked long, urls long, confidence double")
    if (rate[1] or 0) < least:
        return empty
    bad = F.count_if("blocked").alias("bad")
    # a sum of hashes tells whether two tokens have the same URLs
    counted = known.select("id", "blocked", F.explode("tokens").alias("token")).groupBy("token").agg(bad, F.count("*").alias("n"), F.sum(F.xxhash64("id") % (1 << 40)).alias("urls"))
    items = counted.where(F.col("bad") >= least).groupBy("urls", "n", "bad").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"))
    items = saved(items.select("item", "tokens", "n", (F.col("bad") / F.col("n")).alias("share")))
    each = known.where("blocked").select("id", F.explode("tokens").alias("item")).join(small_side(items.select("item", "share")), "item")
    baskets = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("share", "item")), asc=False).alias("i")).select(F.col("i")["item"].alias("items"))
    whole = saved(baskets)
    baskets = saved(_baskets(whole, widest, longest))
    urls = baskets.count()
    if urls < least:
        return empty
    # half a basket less, so that rounding up a share of all gives the count
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / urls, minConfidence=1.0).fit(baskets).freqItemsets
    sets = saved(found.where(F.size("items") <= longest).select(F.array_sort("items").alias("items")))
    rare = sets.select(F.monotonically_increasing_id().alias("set"), "items")
    rare = saved(rare)
    named = rare.select("set", F.explode("items").alias("item")).join(items, "item").groupBy("set").agg(F.min_by("item", F.struct("n", "item")).alias("token"), F.array_sort(F.flatten(F.collect_list("tokens"))).alias("items"))
    index = saved(named)
    met = known.select("blocked", "tokens", F.explode("tokens").alias("token")).join(small_side(index), "token").where(F.size(F.array_except("items", "tokens")) == 0)
    sums = met.groupBy("set").agg(F.count_if("blocked").alias("blocked"), F.count("*").alias("urls")).withColumn("confidence", _lowest(F.col("blocked"), F.col("urls")))
    good = saved(sums.where((F.col("blocked") >= least) & (F.col("confidence") >= confidence) & (F.col("confidence") >= lift * rate[0])).join(rare.withColumnRenamed("items", "parts"), "set").join(index, "set"))
    within = good.select("set", "confidence", F.explode(_parts(F.col("parts"), longest)).alias("parts"))
    covered = within.alias("x").join(good.alias("y"), (F.col("x.parts") == F.col("y.parts")) & (F.col("y.confidence") >= F.col("x.confidence"))).select(F.col("x.set").alias("set")).distinct()
    rules = saved(good.join(covered, "set", "left_anti").select(F.xxhash64("items").alias("rule"), "token", "items", "blocked", "urls", "confidence"))
    discard(known, items, whole, baskets, sets, rare, index, good)
    return rules


def _baskets(whole: DataFrame, widest: int, longest: int) -> DataFrame:
    """(items) of at most ``widest`` (``longest`` at least): those of more items are dealt into blocks, and each choice of ``longest`` blocks is a basket."""
    each = max(1, widest // longest)
    n = F.ceil(F.size("items") / each).cast("int")
    chosen = whole.where(F.size("items") > max(widest, longest)).select("items", n.alias("n"), F.lit(-1).alias("last"), F.array().cast("array<string>").alias("basket"))
    for still in range(longest - 1, -1, -1):
        chosen = chosen.withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.col("n") - 1 - still)))
        chosen = chosen.withColumn("basket", F.concat("basket", F.slice("items", F.col("last") * each + 1, F.lit(each))))
    return whole.where(F.size("items") <= max(widest, longest)).select("items").union(chosen.select("basket"))


def _parts(items: Column, longest: int) -> Column:
    """All non-empty true subsets of a sorted array of at most ``longest`` items."""
    masks = F.array([F.lit(m) for m in range(1, (1 << longest) - 1)])
    some = F.transform(masks, lambda m: F.filter(items, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    return F.filter(F.array_distinct(some), lambda x: (F.size(x) > 0) & (F.size(x) < F.size(items)))


def _fitting(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = where.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(where)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def by_rules(url: Column, rules: Rules) -> Column:
    """Whether the longest of ``rules`` that fits blocks the url; null if none fits."""
    return _fitting(host_of(url), path_of(url), rules)[1] == "block"


def judged(pages: DataFrame, mined: DataFrame, rules: Rules, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for every row of ``pages``: page_id, host, path, rule (the longest fixed one
    that fits its host or a parent of it and the start of its path; else null), verdict
    (``allow`` or ``block``: the fixed rule's, else block if a mined rule matches),
    mined_rules (number of mined rules that match).

    Null urls, or without ``://``, have an empty host and path. Repeated rows, equal or
    null ids each give a row. Mined rules are broadcast only if counted to be few.
    """
    index = small_side(saved(mined.select("token", "items")))
    u = F.col("url")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    split = rows.select("row", "page_id", host_of(u).alias("host"), path_of(u).alias("path"), tokens(u).alias("tokens"))
    each = split.select("*", F.explode_outer("tokens").alias("token")).join(index, "token", "left")
    hit = F.when(F.size(F.array_except("items", "tokens")) == 0, 1)
    counted = each.groupBy("row", "page_id", "host", "path").agg(F.count(hit).alias("mined_rules"))
    rule, verdict = _fitting(F.col("host"), F.col("path"), rules)
    return counted.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rules") > 0, "block").otherwise("allow")).alias("verdict"), "mined_rules")
