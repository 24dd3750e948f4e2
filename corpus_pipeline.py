"""A corpus in five stages: quality rules, near-duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of ``documents``; the last returns
the pieces of the packed sequences.

Defined cases, at every stage: a null text counts as empty, so the quality
rules reject it; a null id or source is kept as it is. Of rows with equal id
and text one stays after the near-duplicate stage; before it they are judged
row by row, after it mixing may repeat a document. Extra columns go along. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import mixing, packing, pii, quality, simhash
from granary.llm.common import saved

#: The mix flattens the sources' shares a little and repeats no document more than this.
REPEAT = 2.0


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their host's verdict reject go."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return simhash.keep_representatives(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources have their target weights."""
    return mixing.mix_rows(docs, repeat=REPEAT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenized and packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("simhash", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
