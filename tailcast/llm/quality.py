"""Quality classification by hierarchical empirical Bayes.

A logistic classifier of each document's characters gives evidence; grouped sums of
it give a posterior rate for every host, shrunk towards the corpus, and for every
path of a host, shrunk towards the host. The strength of each prior comes from the
spread between sites (method of moments), so sites with few documents stay near it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.llm.common import added_names, bounded_sample, discard, saved, small_side, steps, word_hashes

#: Documents that the classifier is fitted on at most: those whose hashed ids are smallest.
FIT_ROWS = 20_000
#: A document is kept at this posterior or more; below even odds, since a clean one lost costs more.
THRESHOLD = 0.4

_CLASSES = np.zeros((256, 7), dtype=bool)
_CLASSES[65:91, 0] = True  # capitals
_CLASSES[97:123, 1] = _CLASSES[128:, 1] = True  # small letters, bytes beyond ASCII
_CLASSES[48:58, 2] = True  # digits
_CLASSES[[32, *range(9, 14)], 3] = True  # white space
_CLASSES[[33, 63], 4] = True  # exclamation and question marks
_CLASSES[[46, 44, 59, 58, 39, 34, 40, 41, 45], 5] = True  # ordinary punctuation
_CLASSES[33:127, 6] = ~_CLASSES[33:127, :6].any(axis=1)  # other symbols


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: shares of the byte classes, square roots of them (they tell
    few from none), share of words that equal the one before, compressed share of the
    size (repetition), mean word length and logarithm of the size."""
    buf = np.frombuffer(b"".join(texts) + b" ", dtype=np.uint8)
    size = np.array([len(x) for x in texts], dtype=np.int64)
    starts = np.cumsum(size) - size
    counts = np.zeros((len(texts), 7))
    for k in range(7):
        ones = np.concatenate(([0], np.cumsum(_CLASSES[buf, k], dtype=np.int64)))
        counts[:, k] = ones[starts + size] - ones[starts]
    share = counts / np.maximum(size, 1)[:, None]
    word = np.minimum((size - counts[:, 3]) / (counts[:, 3] + 1), 40.0) / 10
    words, first = word_hashes(texts)
    again = np.concatenate(([0, 0], np.cumsum(words[1:] == words[:-1])))
    inner = np.maximum(first[1:] - first[:-1] - 1, 0)
    repeated = np.where(inner > 0, again[np.maximum(first[1:], 1)] - again[np.minimum(first[:-1] + 1, len(again) - 1)], 0) / np.maximum(inner, 1)
    packed = np.array([len(zlib.compress(x, 1)) for x in texts]) / (size + 60)
    return np.column_stack([share, np.sqrt(share), repeated, packed, word, np.log1p(size) / 10])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps. Without
    both kinds of labels the weights are 0 and the constant is the smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        z = np.column_stack([x, np.ones(len(x))])
        keep = np.diag([*[ridge] * x.shape[1], 1e-9])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> np.ndarray:
    """Weights fitted on documents of at most ``most`` labelled ids, one of each, whose features alone come
    to the driver. Null labels and texts without a label take no part."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y"))
    known = bounded_sample(known.groupBy("_id").agg(F.avg("_y").alias("_y")), "_id", most)
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in steps(batches, "_text"):
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_y"), pa.array(features(texts).tolist(), pa.list_(pa.float64()))], names=["i", "y", "x"])

    # one row an id, however often it is repeated
    found = sorted(chosen.mapInArrow(run, f"i {chosen.schema['_id'].dataType.simpleString()}, y double, x array<double>").groupBy("i").agg(F.min(F.struct("y", "x")).alias("f")).select("f.*").collect())
    x = np.array([r["x"] for r in found]).reshape(len(found), features([b""]).shape[1])
    return fit(x, np.array([float(r["y"] >= 0.5) for r in found]))


def with_evidence(docs: DataFrame, weights: np.ndarray, text: str, evidence: str) -> DataFrame:
    """``docs`` with ``evidence``, the classifier's probability from the whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in steps(batches, text):
            logit = features(texts) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=[*rows.schema.names, evidence])

    return docs.mapInArrow(run, docs.withColumn(evidence, F.lit(0.0)).schema)


def _strength(sites: DataFrame, mean: str, n: str, rate: float) -> float:
    """Pseudo-counts of a beta prior, from the spread of the sites' means beyond what
    their documents' own spread explains."""
    s = sites.agg(F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * (F.col(mean) - rate) ** 2).alias("ss"), F.sum("within").alias("w"), F.count("*").alias("k"), F.sum(F.col(n) ** 2).alias("n2")).first()
    if not s["k"] or s["k"] < 2:
        return 100.0
    inner = s["w"] / max(s["n"] - s["k"], 1)
    spread = (s["ss"] - (s["k"] - 1) * inner) / max(s["n"] - s["n2"] / s["n"], 1e-9)
    return float(np.clip(rate * (1 - rate) / max(spread, 1e-6) - 1, 1.0, 1e4))


def site_sums(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """For (host, path, p): (host, path, n, sum, host_n, host_sum, strength), saved: documents and summed
    evidence of each path and of its host, and the pseudo-counts that a path's host counts for; then those
    that the corpus counts for at a host, and the corpus's rate."""
    by_path = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("sum"), F.sum(F.col("p") ** 2).alias("sq")))
    by_host = saved(by_path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("sum").alias("host_sum"), F.sum("sq").alias("host_sq")))
    total = by_host.agg(F.sum("host_sum"), F.sum("host_n")).first()
    rate = float(np.clip(total[0] / total[1], 1e-6, 1 - 1e-6)) if total[1] else 0.5
    means = by_host.select("host_n", (F.col("host_sum") / F.col("host_n")).alias("m"), (F.col("host_sq") - F.col("host_sum") ** 2 / F.col("host_n")).alias("within"))
    of_host = _strength(means, "m", "host_n", rate)
    means = by_path.select("n", (F.col("sum") / F.col("n")).alias("m"), (F.col("sq") - F.col("sum") ** 2 / F.col("n")).alias("within"))
    of_path = _strength(means, "m", "n", rate)
    sites = saved(by_path.join(by_host, "host").select("host", "path", "n", "sum", "host_n", "host_sum", F.lit(of_path).alias("strength")))
    discard(by_path, by_host)
    return sites, of_host, rate


def _judged(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, host: str, path: str, whole: bool) -> tuple[DataFrame, list[str]]:
    """``docs`` (without the text if not ``whole``) and columns whose names none of them has: the text's
    evidence, the site's rate, both together."""
    weights = train(docs, labels, doc_id, text)
    p, site, quality, h, l, *sums = added_names(docs, "p", "site", "quality", "host", "path", "n", "sum", "host_n", "host_sum", "strength")
    placed = docs.withColumns({name: F.coalesce(F.col(c).cast("string"), F.lit("")) for name, c in ((h, host), (l, path))})
    scored = with_evidence(placed, weights, text, p)
    if whole:  # worked out again where rows are read, so that no text is written
        narrow = with_evidence(placed.select(text, h, l), weights, text, p)
    else:
        scored = narrow = saved(scored.drop(text))
    sites, of_host, rate = site_sums(narrow.select(F.col(h).alias("host"), F.col(l).alias("path"), F.col(p).alias("p")))
    joined = scored.join(small_side(sites.toDF(h, l, *sums)), [h, l])
    n, total, host_n, host_sum, strength = (F.col(c) for c in sums)
    # all without the document itself
    parent = (host_sum - F.col(p) + of_host * rate) / (host_n - 1 + of_host)
    own = (total - F.col(p) + strength * parent) / (n - 1 + strength)
    odds = F.col(p) / (1 - F.col(p)) * F.col(site) / (1 - F.col(site)) / (rate / (1 - rate))
    out = joined.withColumn(site, F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))).withColumn(quality, odds / (1 + odds))
    return out, [p, site, quality]


def classified(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", whole: bool = True) -> DataFrame:
    """``docs`` with ``_p`` (the text's evidence), ``_site`` (the posterior rate of its
    path, which leans on its host's and that on the corpus's, all but the last without the document
    itself) and ``_quality`` (both combined by their odds), which replace columns of these names;
    others pass through. Without the text's column if not ``whole``: texts are read once then.

    Null or empty texts have the evidence of their (zero) features; null hosts and paths
    are '' . With no labels, or of one kind only, everything gets that rate. Repeated rows
    each count. Sites are joined by broadcast only if they were counted to be few.
    """
    judged, names = _judged(docs, labels, doc_id, text, host, path, whole)
    results = ["_p", "_site", "_quality"]
    rest = [c for c in docs.columns if c.lower() not in results and (whole or c != text)]
    return judged.select(*rest, *[F.col(c).alias(r) for c, r in zip(names, results, strict=True)])


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` without those whose posterior is below ``threshold``; columns of any names pass through."""
    judged, names = _judged(docs, labels, doc_id, text, host, path, True)
    return judged.where(F.col(names[2]) >= threshold).select(*docs.columns)
