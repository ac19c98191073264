"""The training-data pipeline: its stages in order, each on all that the one before kept.

1. quality: documents that the quality rules reject go.
2. exact: of equal texts the smallest doc_id stays.
3. near: of documents connected by shingle similarity the smallest doc_id stays.
4. passages: bytes of passages that occurred before go; texts and n_chars change.
5. packing: what is left, tokenised and packed into sequences.

The first four return the columns of `documents`, further ones included; the last
returns one row a piece. Null and empty texts fail the first stage. Rows without
a doc_id pass it like any other and go in the second. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldscape.llm import exact_dedup, jaccard_join, packing, quality, suffix_dedup
from foldscape.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("exact", exact), ("near", near), ("passages", passages), ("packing", packed)]
#: Token ids, hashed likelihoods and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` through all stages, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
