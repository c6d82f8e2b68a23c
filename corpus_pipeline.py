"""A training corpus from ``documents``: five stages, each an operator of
``tidemark.llm``, each written as Parquet and read again by the next.

Quality rules drop what they reject; of each group of near copies (five-word
shingles, similarity of 0.8 or more) one document stays; documents with
benchmark windows are dropped; sources are mixed to target weights, so that a
document stays, goes or is repeated; what remains is put into sixteen shards.

A null text counts as empty and fails the quality rules, as do empty ones. Of
rows that repeat, one stays. Null doc_ids and sources are values like others,
texts are read whole, further columns are kept (those named shard, slot or
size are replaced by the last stage), and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import Winnowing, drop_contaminated
from tidemark.llm.jaccard_join import Threshold, keep_one_per_group
from tidemark.llm.mixing import mix
from tidemark.llm.quality import Rules, keep_good
from tidemark.llm.sharding import shard
from tidemark.llm.storage import read
from tidemark.sources.scratch import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read(spark, sf_dir, "labels"), Rules())


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs, Threshold(k=5, num=80, den=100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"), Winnowing(window=10, k=5))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs, 16)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]
#: A learned classifier and the components of a similarity graph have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded corpus: the columns of documents, and shard, slot, size."""
    folder = scratch_path(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
