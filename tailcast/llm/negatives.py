"""Hard-negative mining over inverted lists of a k-means quantiser with stored radii.

Every vector lies in the list of its nearest centroid; a list keeps its radius, the largest distance
from the centroid. By Cauchy and Schwarz the product of a vector of the list with an anchor lies within the
anchor's norm times the radius of the centroid's product. Anchors visit lists by that upper bound, the first few at
once; then only lists that the bound does not put strictly below the k-th score found so far,
nor outside the window of scores asked for. So nothing that counts is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailcast.llm.common import bounded_sample, discard, saved, small_side

#: Vectors that the centroids are fitted on at most: those with the smallest hashed ids.
FIT_ROWS = 10_000
#: Lists at most; fewer vectors have half the root of their number.
MOST_LISTS = 1024
#: Lists that an anchor visits at once, before it has a score to hold bounds against.
FIRST_LISTS = 4
#: Rows of a part of a list, and anchors of a block, about.
LIST_PART, ANCHOR_BLOCK = 16_384, 4_096
#: Share by which float64 bounds may be off, with room.
_ROUNDING = 1e-9
#: Scores and a hundred times them must be whole numbers of 63 bits.
_LARGEST = 2.0**56

FOUND = "anchor_id long, bar long, vec_id long, score long"


def centroids(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Means [lists, dim] by Lloyd's rounds; a list that loses all its vectors starts anew at one of them."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[: min(lists, len(x))]].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, centre)[0]
        size = np.bincount(near, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre[size > 0] = sums[size > 0] / size[size > 0, None]
        centre[size == 0] = x[rng.integers(len(x), size=int((size == 0).sum()))]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and distance to each row's nearest centroid."""
    squared = (x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)
    near = squared.argmin(1)
    return near, np.sqrt(((x - centre[near]) ** 2).sum(1))


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest products [anchors, lists] that rows of lists can have, with room for rounding."""
    middle, norm = q @ centre.T, np.sqrt((q**2).sum(1))[:, None]
    reach = norm * radius
    room = _ROUNDING * (1 + norm * np.sqrt((centre**2).sum(1)) + reach)
    return middle - reach - room, middle + reach + room


def first(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest allowed scores, largest first, ties to the earlier place."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).astype(kind).reshape(-1, dim)


class _Index:
    """The saved inverted lists: (id, label, v, list, part), the centroids and radii of at most MOST_LISTS lists, and the number of parts of each."""

    def __init__(self, good: DataFrame, dim: int, exact: bool) -> None:
        self.dim, self.kind = dim, np.float64 if exact else np.int64
        rows = saved(good.select("id", "label", "v").distinct())
        n = rows.count()
        sample = bounded_sample(rows, "id", FIT_ROWS).select("v").toPandas()["v"]
        centre = centroids(np.array(sample.tolist(), dtype=np.float64).reshape(-1, dim), min(MOST_LISTS, max(1, round(n**0.5 / 2))))

        def assign(batches):
            for batch in batches:
                near, away = nearest(_matrix(batch.column("v"), dim), centre)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(away, pa.float64())], names=[*batch.schema.names, "list", "away"])

        placed = saved(rows.mapInArrow(assign, "id long, label string, v array<long>, list int, away double"))
        discard(rows)
        self.centre, self.radius, self.parts = centre, np.full(len(centre), -1.0), np.zeros(len(centre), dtype=np.int64)
        for r in placed.groupBy("list").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect():  # a row a list
            self.radius[r["list"]], self.parts[r["list"]] = r["away"], -(-r["n"] // LIST_PART)
        self.rows = placed

    def table(self) -> DataFrame:
        """With ``part``, so many as keep each at LIST_PART rows or about."""
        parts = self.rows.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(self.parts) if p], "list int, parts int")
        return self.rows.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "label", "v")


def _blocks(anchors: DataFrame) -> DataFrame:
    """Anchors with ``block``: those of one list, or of a few small ones, together, ANCHOR_BLOCK or about."""
    first_of, rows, held = {}, 0, 0
    for r in anchors.groupBy("list").count().orderBy("list").collect():  # a row a list
        if held and held + r["count"] > ANCHOR_BLOCK:
            rows, held = rows + 1, 0
        own = -(-r["count"] // ANCHOR_BLOCK)
        first_of[r["list"]] = (r["list"], rows, own)
        rows, held = (rows + own, 0) if own > 1 else (rows, held + r["count"])
    table = anchors.sparkSession.createDataFrame(list(first_of.values()) or [(0, 0, 1)], "list int, first int, own int")
    return anchors.join(F.broadcast(table), "list").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("own"))).cast("int")).drop("list", "first", "own")


def _visit(anchors: DataFrame, index: _Index, k: int, same: bool, low: int, later: bool) -> DataFrame:
    """(anchor_id, bar, vec_id, score): of each list visited the ``k`` best rows for each anchor, of its own label (``same``),
    or of other labels and with scores from ``low`` % of each of the anchor's ``bars`` up to it.

    ``anchors``: (id, label, v, block, bars, kth), ``kth`` the k-th scores found so far by bar, null for none. Each
    list is visited ``later`` or else among the first few.
    """
    centre, radius, parts, dim, kind = index.centre, index.radius, index.parts, index.dim, index.kind

    def listed(batches):
        for batch in batches:
            lower, upper = bounds(_matrix(batch.column("v"), dim), centre, radius)
            rows, lists, part = [], [], []
            for i, (bars, kths) in enumerate(zip(batch.column("bars").to_pylist(), batch.column("kth").to_pylist(), strict=True)):
                inside, alive = np.zeros(len(radius), dtype=bool), np.zeros(len(radius), dtype=bool)
                for bar, kth in zip(bars, kths, strict=True):
                    window = (radius >= 0) if same else (radius >= 0) & (lower[i] <= bar) & (100 * upper[i] >= low * bar)
                    inside |= window
                    alive |= window & (upper[i] >= (-np.inf if kth is None else kth))
                order = np.argsort(-upper[i], kind="stable")
                order = order[inside[order]]
                for j in order[FIRST_LISTS:][alive[order[FIRST_LISTS:]]] if later else order[:FIRST_LISTS]:
                    for p in range(parts[j]):
                        rows.append(i), lists.append(j), part.append(p)
            taken = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists, pa.int32()), pa.array(part, pa.int32())], names=[*taken.schema.names, "list", "part"])

    asked = anchors.select("id", "label", "v", "block", "bars", "kth")
    visits = saved(asked.mapInArrow(listed, "id long, label string, v array<long>, block int, bars array<long>, kth array<long>, list int, part int"))
    wanted = saved(visits.select("list", "block").distinct())
    rows = index.table().join(small_side(wanted), "list")

    def meet(asking: pa.Table, there: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if asking.num_rows and there.num_rows:
            there = there.sort_by("id")
            ids, labels, x = there.column("id").to_numpy(), np.array(there.column("label").to_pylist()), _matrix(there.column("v"), dim, kind)
            q, q_ids, q_labels, bars = _matrix(asking.column("v"), dim, kind), asking.column("id").to_pylist(), asking.column("label").to_pylist(), asking.column("bars").to_pylist()
            for lo in range(0, len(q), 128):
                scores = (q[lo : lo + 128] @ x.T).astype(np.int64)
                for i in range(lo, min(lo + 128, len(q))):
                    own, alike = scores[i - lo], labels == q_labels[i]
                    for bar in bars[i]:
                        good = alike & (ids != q_ids[i]) if same else ~alike & (ids != q_ids[i]) & (own <= bar) & (100 * own >= low * bar)
                        at = first(own, good, k)
                        for column, values in zip(out, ([q_ids[i]] * len(at), [bar] * len(at), ids[at], own[at]), strict=True):
                            column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "bar", "vec_id", "score"])

    key = ["block", "list", "part"]
    met = visits.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, FOUND)
    found = saved(met)
    discard(visits, wanted)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "bar").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(anchors: DataFrame, index: _Index, k: int, same: bool, low: int = 0) -> DataFrame:
    """(anchor_id, bar, vec_id, score, rank), a saved table: first lists, then those that their k-th scores leave."""
    none = anchors.withColumn("kth", F.transform("bars", lambda _: F.lit(None).cast("long")))
    early = _visit(none, index, k, same, low, later=False)
    kth = _best(early, k).where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("bar", "score"))).alias("known"))
    held = anchors.join(kth.withColumnRenamed("anchor_id", "id"), "id", "left")
    held = saved(held.withColumn("kth", F.transform("bars", lambda b: F.get(F.map_values(F.map_filter(F.coalesce("known", F.create_map().cast("map<bigint,bigint>")), lambda key, _: key == b)), F.lit(0)))).drop("known"))
    late = _visit(held, index, k, same, low, later=True)
    out = saved(_best(early.unionByName(late), k))
    discard(early, late, held)
    return out


def mined(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``anchor`` holds its ``positives`` best
    other rows of the same label, and for each of these the ``negatives`` best rows of other labels whose scores are
    from ``low`` % of the positive's score up to it. Ties go to the smaller id; all, if there are fewer.

    A score is the inner product of the components' whole numbers, floor(``scale`` * x). Rows with a null id or label, a null
    vector, or a null or non-finite component take no part, nor do those of other than the commonest dimension (the
    smaller of two). Equal rows count once. Rows of an id that differ in vector or label each are
    candidates, the smallest vector of the id is the anchor, and no row is a candidate for its own id. A
    positive of a negative score has no negatives, an anchor without other rows of its label no rows. Components
    so large that a score might not fit 56 bits raise an error. Other columns, of any name, are not read.
    """
    x = F.col(vector)
    fine = F.coalesce(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    made = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    label = F.col(label) if isinstance(label, str) else label
    good = vectors.where(fine & F.col(vec_id).isNotNull() & label.isNotNull()).select(F.col(vec_id).cast("long").alias("id"), label.cast("string").alias("label"), made.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    large = F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))), F.lit(0.0))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(large).alias("most")).orderBy(F.desc("n"), "d").first()
    if sizes is None or not sizes["d"]:
        return _empty(vectors.sparkSession)
    dim, most = sizes["d"], sizes["d"] * sizes["most"] ** 2
    if most >= _LARGEST:
        raise ValueError("scores of these components may not fit 56 bits: choose a smaller scale")
    good = good.where(F.size("v") == dim)
    index = _Index(good, dim, most < 2.0**53)
    asks = good.where("asks").groupBy("id").agg(F.min(F.struct("v", "label")).alias("one")).select("id", "one.label", "one.v")
    asked = saved(_blocks(index.rows.select("id", "label", "v", "list").join(asks, ["id", "label", "v"], "left_semi")))

    close = _searched(asked.withColumn("bars", F.array(F.lit(0).cast("long"))), index, positives, same=True)
    bars = close.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set("score")).alias("bars"))  # at most ``positives``
    hard = _searched(saved(asked.join(bars, "id")), index, negatives, same=False, low=low)
    discard(asked)
    pairs = close.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    theirs = hard.select("anchor_id", F.col("bar").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(theirs, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
