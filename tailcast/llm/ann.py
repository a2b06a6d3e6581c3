"""Nearest neighbours by largest inner product, with score-aware quantisation.

Vectors are cut into pairs of components, each quantised to one of 16 centres (four
bits). Centres and codes minimise a loss that weighs the residual along the vector
more than that across it, since only the former shifts large inner products. A scan
adds up table entries for all codes; a vector's product differs from its sum by at most
the query's norm times that of the vector's residual, so all that may be among the best
are ranked again by exact products, and none of the best is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.llm.common import bounded_sample, saved

#: Vectors that the centres are fitted on at most: those with the smallest hashed ids.
FIT_ROWS = 10_000
#: Rows that a block of queries and one of vectors have on average.
QUERY_BLOCK, VECTOR_BLOCK = 4_096, 16_384
#: Vectors of a block that are ranked exactly for a query first, to set the bound for the others.
RERANK = 128
#: Share of the norms' product by which float32 sums may be off, with room.
_ROUNDING = 1e-4
#: Products of at least this share of the norm are those that matter for the loss.
THRESHOLD = 0.2


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the squared residual along the vector against that across it."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _pairs(x: np.ndarray) -> np.ndarray:
    """[n, subspaces, 2], with a zero added to an odd number of components."""
    if x.shape[1] % 2:
        x = np.column_stack([x, np.zeros(len(x))])
    return x.reshape(len(x), -1, 2)


def _unit(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt((p**2).sum(axis=(1, 2), keepdims=True))


def encode(x: np.ndarray, centres: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Codes [n, subspaces]: nearest centres first, then each subspace's code in turn is
    chosen to make the loss smallest given the others."""
    p = _pairs(x)
    unit, extra = _unit(p), parallel_weight(x.shape[1]) - 1
    codes = np.stack([((p[:, m, None] - centres[m]) ** 2).sum(-1).argmin(1) for m in range(p.shape[1])], axis=1)
    along = sum(((p[:, m] - centres[m][codes[:, m]]) * unit[:, m]).sum(-1) for m in range(p.shape[1]))
    for _ in range(rounds):
        for m in range(p.shape[1]):
            rest = p[:, m, None] - centres[m]
            part = (rest * unit[:, m, None]).sum(-1)
            others = along - part[np.arange(len(p)), codes[:, m]]
            best = ((rest**2).sum(-1) + extra * (others[:, None] + part) ** 2).argmin(1)
            along, codes[:, m] = others + part[np.arange(len(p)), best], best
    return codes.astype(np.uint8)


def fit(x: np.ndarray, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres [subspaces, 16, 2]: codes and, given them, the centres of one subspace
    after the other (a 2 x 2 system each) are made best in turn."""
    rng, p = np.random.default_rng(seed), _pairs(x)
    unit, extra = _unit(p), parallel_weight(x.shape[1]) - 1
    centres = np.stack([p[rng.integers(len(p), size=16), m] for m in range(p.shape[1])])
    for _ in range(rounds):
        codes = encode(x, centres, 1)
        along = sum(((p[:, m] - centres[m][codes[:, m]]) * unit[:, m]).sum(-1) for m in range(p.shape[1]))
        for m in range(p.shape[1]):
            u, c = unit[:, m], codes[:, m]
            others = along - ((p[:, m] - centres[m][c]) * u).sum(-1)
            system = np.zeros((16, 2, 2))
            right = np.zeros((16, 2))
            np.add.at(system, c, np.eye(2) + extra * u[:, :, None] * u[:, None, :])
            np.add.at(right, c, p[:, m] + extra * u * (others + (p[:, m] * u).sum(-1))[:, None])
            used = np.bincount(c, minlength=16) > 0
            centres[m][used] = np.linalg.solve(system[used], right[used][..., None])[..., 0]
            centres[m][~used] = p[rng.integers(len(p), size=int((~used).sum())), m]
            along = others + ((p[:, m] - centres[m][c]) * u).sum(-1)
    return centres


def scan(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate products [queries, vectors]; each packed byte, two codes, is looked up
    in a table of the 256 sums of two entries."""
    q = _pairs(queries)
    table = np.einsum("qmd,mcd->qmc", q, centres).astype(np.float32)
    if table.shape[1] % 2:
        table = np.concatenate([table, np.zeros_like(table[:, :1])], axis=1)
    both = (table[:, ::2, :, None] + table[:, 1::2, None, :]).reshape(len(q), -1, 256)
    out = np.zeros((len(q), len(packed)), dtype=np.float32)
    for m in range(both.shape[1]):
        out += np.take(both[:, m], packed[:, m], axis=1)
    return out


def residuals(x: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Norms of what codes leave of vectors, with room for rounding."""
    p = _pairs(x)
    codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, : p.shape[1]]
    left = sum(((p[:, m] - centres[m][codes[:, m]]) ** 2).sum(-1) for m in range(p.shape[1]))
    return np.sqrt(left) + _ROUNDING * (np.sqrt(left) + np.sqrt((p**2).sum(axis=(1, 2))))


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.column_stack([codes, np.zeros(len(codes), dtype=np.uint8)])
    return codes[:, ::2] << 4 | codes[:, 1::2]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _block(name: str, rows: int, most: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(-(-max(rows, 1) // most))).cast("int")


def searched(vectors: DataFrame, query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` where ``query`` holds,
    the ``k`` rows of largest inner product among all others, ties to the smaller
    id; all, if there are fewer. ``score`` is the exact product in double precision.

    Null vectors and ids, zero vectors, vectors holding nulls or non-finite components,
    and those of other than the commonest dimension take no part. Rows of equal vectors
    are one entry of the index, which keeps the k + 1 smallest ids: no result can hold
    more. A row is no candidate for queries with its own id. Of rows that share an id but not the vector
    each is a candidate, and the smallest vector, by its components in order, asks. Every vector is scanned:
    each block of queries meets each block of vectors in one task, both of bounded size.
    """
    good = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["d"]
    good = good.where(F.size("v") == dim)
    by_vector = Window.partitionBy("v").orderBy("id")
    index = good.select("id", "v").distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    index = saved(index.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("first", F.col("ids")[0]))
    asked = saved(good.where("asks").groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("q")))
    sample = bounded_sample(index, "first", FIT_ROWS).select("v").toPandas()["v"]
    centres = fit(np.array(sample.tolist(), dtype=np.float64))

    def coded(batches):
        for rows in batches:
            codes = pack(encode(np.asarray(rows.column("v").flatten(), dtype=np.float64).reshape(-1, dim), centres)) if rows.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x.tobytes() for x in codes], pa.binary())], names=[*rows.schema.names, "code"])

    codes = index.mapInArrow(coded, index.withColumn("code", F.lit(b"")).schema)
    n_vectors, n_queries = index.count(), asked.count()
    q_blocks, v_blocks = -(-max(n_queries, 1) // QUERY_BLOCK), -(-max(n_vectors, 1) // VECTOR_BLOCK)
    left = asked.withColumn("qb", _block("query_id", n_queries, QUERY_BLOCK)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    right = codes.withColumn("vb", _block("first", n_vectors, VECTOR_BLOCK)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def meet(asking: pa.Table, indexed: pa.Table) -> pa.Table:
        found = ([], [], [])
        if asking.num_rows and indexed.num_rows:
            ids = indexed.column("ids").to_pylist()
            firsts = np.array([x[0] for x in ids])
            exact = _matrix(indexed.column("v"), dim)
            packed = np.frombuffer(b"".join(indexed.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            q, q_ids = _matrix(asking.column("q"), dim), asking.column("query_id").to_pylist()
            rest = residuals(exact, packed, centres)
            alone = np.array([len(x) == 1 for x in ids])
            most = min(max(RERANK, k + 1), len(ids))
            for lo in range(0, len(q), 128):
                part = q[lo : lo + 128]
                upper = scan(part, packed, centres)
                near = np.argpartition(-upper, most - 1, axis=1)[:, :most]
                scores = np.einsum("qd,qrd->qr", part, exact[near])
                norms = np.sqrt((part**2).sum(axis=1))
                upper += norms[:, None] * rest
                for one, asks, bound, first, score in zip(q_ids[lo : lo + 128], part, upper, near, scores, strict=True):
                    bound[first] = -np.inf
                    others = score[~(alone[first] & (firsts[first] == one))]
                    reach = np.partition(others, -k)[-k] if len(others) >= k else -np.inf
                    more = np.flatnonzero((bound >= reach) & (bound > -np.inf))
                    cand, score = np.concatenate([first, more]), np.concatenate([score, np.einsum("d,rd->r", asks, exact[more])])
                    best: list[tuple[float, int]] = []
                    for r in np.lexsort((firsts[cand], -score)):
                        if len(best) >= k and -score[r] > best[k - 1][0]:
                            break
                        best += [(-score[r], i) for i in ids[cand[r]] if i != one]
                        best.sort()
                    for s, i in best[:k]:
                        found[0].append(one), found[1].append(i), found[2].append(-s)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
