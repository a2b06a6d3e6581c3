"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.llm.common import BROADCAST_ROWS, discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component), read from a saved table: the smallest id reachable over ``edges`` (a, b), for every id on
    an edge between different ids. Nulls and loops are left out.

    Alternating large-star and small-star rounds: each hooks neighbours onto the
    smallest id seen, so the number of rounds grows with the logarithm of the longest
    path. They end as soon as all edges are stars. No round makes more edges than it gets. Minima are
    aggregated before they are joined; if they are few they are broadcast, else written first, so that both
    sides of a join are plain exchanges of which adaptive execution can split a hot id.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    now = saved(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a > b))
    while True:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        ends = both.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        # in stars, an id with a smaller neighbour has no other
        seen = saved(ends.select("a", F.least("a", "lo").alias("m"), ((F.col("lo") < a) & (F.col("lo") < F.col("hi"))).alias("open")))
        if seen.where("open").isEmpty():
            discard(now)
            return seen.select(a.alias("id"), m.alias("component"))
        few = seen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        least = seen.select(a.alias("b"), "m")
        large = now.join(F.broadcast(least) if few else least, "b").select("a", m.alias("b"))
        large = large if few else saved(large.distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = F.broadcast(lower) if few else saved(lower)
        small = large.join(lower, "a").select(F.when(b == m, a).otherwise(b).alias("a"), m.alias("b"))
        new = saved(small if few else small.distinct())
        discard(now, seen, *([] if few else [large, lower]))
        now = new
