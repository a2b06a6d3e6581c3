"""Links between members of shared buckets, without forming all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.llm.common import discard, saved, small_side
from tailcast.llm.graph import components


def shared_only(keys: DataFrame, nodes: DataFrame | None, pair: Column) -> DataFrame:
    """(key, id, attr, members), saved: the rows of (key, id) whose key has several, with their number
    and the ``attr`` of (id, attr); without ``nodes`` the keys have it. Keys are counted map-side first, nothing is gathered by key, and
    only keys and ids are shuffled. Where just two share a key, mostly by chance and more so the more
    rows there are, they go at once if ``pair``, an aggregate of their ``attr``, shows that they can't be linked.
    """
    if nodes is None:
        counted = keys.groupBy("key").agg(F.count("*").alias("members"), F.coalesce(pair, F.lit(True)).alias("could"))
        counted = counted.where("members > 2 or members = 2 and could").select("key", "members")
        return saved(keys.join(counted, "key").select("key", "id", "attr", "members"))
    counted = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    found = saved(keys.join(counted, "key").join(nodes, "id").select("key", "id", "attr", "members"))
    vain = found.where("members = 2").groupBy("key").agg(pair.alias("could")).where("not could").select("key")
    out = saved(found.join(vain, "key", "left_anti"))
    discard(found)
    return out


def link(
    members: DataFrame,
    feasible: Callable[[Column, Column], Column],
    verified: Callable[[DataFrame], DataFrame],
    across: Callable[[DataFrame], DataFrame],
    small: int,
) -> DataFrame:
    """(id, component), saved, for all ids with a verified link that the buckets offer.

    All members of a bucket are compared with its hub, the one that meets most others
    over all buckets. What is in one component after that needs no comparison. Members of
    a bucket that are still in different components are compared with each other if they
    are ``small`` in number at most, so that a member meets no more than that many; ``across``
    finds the candidates (a, b) of all larger buckets' (key, id, attr, component, hub), losing no
    link. So every link between members of a bucket counts. ``feasible`` tells from
    both ``attr`` whether a pair can be linked at all; ``verified`` keeps the pairs
    (a, b) that are.
    """
    weight = members.groupBy("id").agg(F.sum("members").alias("weight"))
    best = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id", "attr")).alias("hub"))
    hubs = saved(best.select("key", F.col("hub.id").alias("hub"), F.col("hub.attr").alias("hub_attr")))
    met = members.join(hubs, "key").where((F.col("id") != F.col("hub")) & feasible(F.col("attr"), F.col("hub_attr")))
    tried = saved(met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    links = saved(verified(tried))
    first = components(links)

    placed = members.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("key", "size")
    open_ = saved(placed.join(split, "key").join(hubs.select("key", "hub"), "key").select("key", "id", "attr", "component", "size", "hub"))
    x, y = (open_.where(F.col("size") <= small).alias(n) for n in "xy")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & feasible(F.col("x.attr"), F.col("y.attr")))
    met = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    apart = met.union(across(open_.where(F.col("size") > small).drop("size"))).distinct()
    rest = saved(apart.join(tried, ["a", "b"], "left_anti"))
    more = saved(verified(rest))
    # what is put together now are components
    into = small_side(first)
    ends = more.join(into.select(F.col("id").alias("a"), F.col("component").alias("x")), "a", "left").join(into.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left")
    merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    alone = merged.join(into, "id", "left_anti").select("id", F.col("id").alias("component"))
    named = first.union(alone).join(small_side(merged.select(F.col("id").alias("component"), F.col("component").alias("whole"))), "component", "left")
    out = saved(named.select("id", F.coalesce("whole", "component").alias("component")))
    discard(hubs, tried, links, first, open_, rest, more, merged)
    return out
