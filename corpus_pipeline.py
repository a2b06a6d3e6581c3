"""Raw documents to a mixed, tokenised corpus in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailcast.llm import bpe, exact, mixing, near, quality
from tailcast.llm.common import discard, saved
from tailcast.llm.queries import BLOCK_ROWS, OTHER_SHARE, SHARES, VOCABULARY, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near-duplicates one stays: shingles of five words, 80 %."""
    return near.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule; whole as one column, so that no name clashes."""
    whole = docs.select("doc_id", "source", F.struct("*").alias("row"))
    return mixing.in_order(mixing.mixed(whole, SHARES, OTHER_SHARE, BLOCK_ROWS), ["row"]).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids and their number instead of the text, and ``position``, the place (from
    0) in the order of the files that ``docs`` is read from."""
    return bpe.encode(mixing.positioned(docs), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding", tokenise),
]

#: The classifier and the MinHash tables can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read by the next; what a
    stage has read is deleted once its own rows are written."""
    docs, own = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        discard(*own)
        own = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
