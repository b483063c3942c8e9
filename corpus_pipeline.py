"""Five stages that turn ``documents`` into a training mix; each is written as Parquet and reread as the next one's input.

1. toxicity: documents that the classifier rejects go.
2. near_dedup: one document of each group of near copies stays, that of the least doc_id. Links of the SimHash operator
   and what they miss are checked for a similarity of 0.8 on five-word shingles.
3. decontaminate: documents into which a benchmark item leaks go.
4. secrets: secrets within texts are masked; the documents stay.
5. mix: sources are brought to their target shares; ``taken`` says how many words of a document are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, near_copies, secrets, toxicity
from ledgerloom.llm.common import discard, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontaminate", drop_leaks), ("secrets", mask_secrets), ("mix", mix_sources)]
#: The toxicity model cannot be expressed in SQL; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
