"""A corpus-cleaning pipeline out of the text operators.

Each stage gets what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``. The order: quality
rules, line dedup, near duplicates, benchmark decontamination, BPE encoding.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.llm import bpe_codec, decontaminate, jaccard_join, line_dedup, quality_rules
from fundflow.llm.common import discard, packed, stored, unpacked
from fundflow.shipping import ship

MIN_DOCS = 10
POLICY = "v2"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality_rules.passing(docs, POLICY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of :data:`MIN_DOCS` or more documents go; n_chars follows."""
    kept = line_dedup.dedup_lines(docs, MIN_DOCS, counts=False)
    return unpacked(packed(kept, "text"), docs.columns, n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    ship(spark)
    return jaccard_join.without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of the decoded text."""
    ship(spark)
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True, decoded=False, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark),
    ("bpe_codec", tokens),
]

#: The last stage is beyond SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
            discard(before)
    return docs
