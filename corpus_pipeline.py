"""The corpus pipeline: each stage works on the rows that the one before it left, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citespark.llm import packing, pii, simhash, spans, toxicity
from citespark.llm.common import Scratch, documents

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_dedup", simhash.stage),
    ("substring_dedup", spans.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]
#: A trained score, components and a packing search are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return docs
