"""A training-data pipeline over documents: quality, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the
shared scratch folder and reads it back as the next one's docs. Nulls, ties, repeated rows and empty
tables are handled as each operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import discard, materialize, table
from pulsegrid.llm.decontaminate import decontaminate
from pulsegrid.llm.exact_dedup import drop_exact_duplicates
from pulsegrid.llm.near_dedup import drop_near_duplicates
from pulsegrid.llm.packing import pack
from pulsegrid.llm.quality import keep_good

#: SQL cannot express the classifier, so no stage after it either; tests/llm hold each stage against a plain version, and run() against the stages one by one.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)  # a stage's table is read by the next one only
    return STAGES[-1][1](spark, docs, sf_dir)
