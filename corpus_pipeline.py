"""A training corpus from `documents`: known languages, lines once, one of each group of near copies, no benchmark items, packed.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
`documents`. Stages learn and count on their own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, language_id, line_dedup, near_dedup, packing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without a letter and those between two languages go."""
    return language_id.accepted(docs, language_id.fit(docs.select("text", "lang")))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of long lines in three or more documents only the last document's stay; n_chars follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of similarity 0.8 or more on five words join."""
    return near_dedup.deduplicate(docs, 5, "0.8")


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of `benchmark`."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", lines_once),
    ("near_dedup", one_of_near_copies),
    ("decontamination", no_benchmark_items),
    ("packing", packed),
]

#: SQL has neither the compression classifier nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written once and read by the next."""
    from tidewell.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.durable(stage(spark, docs, sf_dir))
        if i:
            common.discard(before)  # the next stage's table holds what is left of it
    return STAGES[-1][1](spark, docs, sf_dir)
