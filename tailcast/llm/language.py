"""Language identification by Bayesian evidence fusion.

The likelihood of a page's text (naive Bayes on byte pairs) is combined with its
declared markup language, the suffix of its address, and a prior of its host and of
its path within the host. How far a declaration or suffix can be trusted, and the
priors, come from grouped sums of the text's posteriors over all pages; hosts with few
pages lean on the corpus, paths on their host.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailcast.llm.common import bounded_sample, saved, small_side, steps
from tailcast.llm.urls import host_of, path_of

#: Ids whose documents the text model is fitted on at most: those with the smallest hashes.
FIT_ROWS = 10_000
#: Byte pairs are not independent: so many of them count as one.
PAIRS_A_WITNESS = 4.0
#: Pseudo-counts of the corpus in a host's prior, of the host in a path's, and of the
#: corpus's distribution in what a declaration or suffix says.
PRIOR = 10.0

_raw = re.compile(rb"<(script|style)\b")
_end = re.compile(rb"\s*>")
_lang = re.compile(rb"\blang\s*=\s*[\"']?\s*([a-z]{2,3})")


def visible(html: bytes) -> bytes:
    """The text outside of tags, comments, scripts and styles, with a space for each. One pass: an
    end that was looked for in vain is not looked for again."""
    low, out, at, missing = html.lower(), [], 0, set()

    def after(what: bytes, start: int, end: re.Pattern | None = None) -> int:
        """Where what comes after ``what`` begins, -1 without."""
        while what not in missing:
            found = low.find(what, start)
            if found < 0:
                missing.add(what)
                break
            start = found + len(what)
            if end is None:
                return start
            if closed := end.match(low, start):
                return closed.end()
        return -1

    while (start := low.find(b"<", at)) >= 0:
        stop = -1
        if raw := _raw.match(low, start):
            stop = after(b"</" + raw[1], raw.end(), _end)
        elif low.startswith(b"<!--", start):
            stop = after(b"-->", start + 4)
        if stop < 0:
            stop = after(b">", start + 1)
        if stop < 0:
            break
        out.append(html[at:start])
        at = stop
    return b" ".join([*out, html[at:]])


def declared(html: bytes) -> str:
    """The language in the first ``html`` tag that has one, or ''."""
    low, at = html.lower(), 0
    while (start := low.find(b"<html", at)) >= 0:
        at = start + 5
        if low[at : at + 1].isalnum() or low[at : at + 1] == b"_":
            continue
        stop = low.find(b">", at)
        stop = len(low) if stop < 0 else stop
        if found := _lang.search(low, at, stop):
            return found[1].decode()
        at = stop
    return ""


def _pairs(text: bytes) -> np.ndarray:
    """Counts of the byte pairs, A-Z lower-cased, digits and punctuation as spaces."""
    buf = np.frombuffer(text, dtype=np.uint8).copy()
    capital = (buf >= 65) & (buf <= 90)
    buf[capital] += 32
    buf[(buf < 97) | ((buf > 122) & (buf < 128))] = 32
    pair = buf[:-1].astype(np.int32) * 256 + buf[1:] if len(buf) > 1 else np.zeros(0, np.int32)
    return np.bincount(pair[pair != 32 * 257], minlength=65536)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each byte pair in each, from the documents of at most
    ``most`` ids, counted where they are read and summed by language before anything comes to the driver.
    Rows without id, language or text take no part."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    ids = bounded_sample(known.select("key").distinct(), "key", most)
    chosen = known.join(F.broadcast(ids), "key", "left_semi").select("lang", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, texts in steps(batches, "text"):
            for name, x in zip(rows.column("lang").to_pylist(), texts, strict=True):
                sums[name] = sums.get(name, 0) + _pairs(x)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "pair", "n"])

    counted = chosen.mapInArrow(run, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.full((len(langs), 65536), 0.5)
    for i, name in enumerate(langs):
        own = counted[counted["lang"] == name]
        table[i, own["pair"]] += own["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _shares(columns: list[Column]) -> list[Column]:
    whole = sum(columns[1:], columns[0])
    return [c / whole for c in columns]


def identified(pages: DataFrame, model: tuple[list[str], np.ndarray], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for every row of ``pages``: page_id, host, declared (language, '' without),
    text_lang (most likely by the text alone), lang, probability, both null if the
    model has no languages.

    What hosts, paths, declarations and suffixes say of a page comes from all other pages only.
    A page without text, null or empty html, or a null url keeps the other evidence and
    the priors. Other columns are not read. Repeated rows, equal or null ids each give a row and count in the priors.
    """
    langs, table = model
    if not langs:
        nothing = F.lit(None).cast("string")
        return pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), F.lit("").alias("declared"), nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("probability"))
    suffix = F.substring_index(host_of(F.col(url)), ".", -1)
    own = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), F.regexp_extract(path_of(F.col(url)), r"^/([^/]*)/", 1).alias("path"), suffix.alias("suffix"), F.col(html).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in steps(batches, "html"):
            log = np.stack([table @ _pairs(visible(x)) for x in texts]) / PAIRS_A_WITNESS
            p = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -30))
            p /= p.sum(axis=1, keepdims=True)
            said = pa.array([declared(x) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.drop_columns(["html"]).columns, said, *map(pa.array, p.T)], names=[*rows.schema.names[:-1], "declared", *[f"p{i}" for i in range(len(langs))]])

    kinds = "page_id {}, host string, path string, suffix string, declared string, ".format(own.schema["page_id"].dataType.simpleString())
    read = saved(own.mapInArrow(run, kinds + ", ".join(f"p{i} double" for i in range(len(langs)))))
    each = range(len(langs))

    def sums(by: list[str], to: str) -> DataFrame:
        return saved(read.groupBy(*by).agg(*[F.sum(f"p{i}").alias(f"{to}{i}") for i in each]))

    total = read.agg(*[F.sum(f"p{i}") for i in each]).first()
    corpus = [((x or 0) + 1) / (sum(y or 0 for y in total) + len(langs)) for x in total]
    paths = sums(["host", "path"], "s")
    hosts = paths.groupBy("host").agg(*[F.sum(f"s{i}").alias(f"h{i}") for i in each])
    joined = read.join(small_side(saved(paths.join(hosts, "host"))), ["host", "path"])
    for c in ("declared", "suffix"):
        joined = joined.join(small_side(sums([c], c)), c)

    def others(name: str, prior: list[Column]) -> list[Column]:
        """Distribution of the sums without the page itself, leaning on ``prior``."""
        return _shares([F.greatest(F.col(f"{name}{i}") - F.col(f"p{i}"), F.lit(0.0)) + PRIOR * prior[i] for i in each])

    whole_corpus = [F.lit(c) for c in corpus]
    prior = others("s", others("h", whole_corpus))
    told = [others(c, whole_corpus) for c in ("declared", "suffix")]
    weights = [F.col(f"p{i}") * prior[i] * told[0][i] / corpus[i] * told[1][i] / corpus[i] for i in each]
    whole = sum(weights[1:], weights[0])
    first = F.array_max(F.array(*[F.struct((w / whole).alias("p"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]))
    alone = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("i")) for i in each]))
    names = F.array(*[F.lit(x) for x in langs])
    out = joined.withColumns({"_first": first, "_alone": alone})
    return out.select("page_id", "host", "declared", names[-F.col("_alone.i")].alias("text_lang"), names[-F.col("_first.i")].alias("lang"), F.col("_first.p").alias("probability"))
