"""The index as tables: postings, terms with their weight, lengths. Written once, read by every query, replaced as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.operators import rank

TABLES = ("postings", "terms", "meta")
_BUILT: dict[tuple[str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """Where tables are kept: the folder that driver and executors share; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="citespark-index-")


def build(postings: DataFrame, path: str, n_docs: int) -> None:
    """postings (doc_id, term, tf, dl) -> tables below path. Statistics are those of all chunks, whatever is asked later."""
    spark = postings.sparkSession
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    length = postings.agg(F.sum("tf")).first()[0] or 0
    meta = spark.createDataFrame([(n_docs, length / n_docs if n_docs else 0.0)], "n long, avgdl double")
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    df = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(meta))  # meta is one row
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    raw.write.mode("overwrite").parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * rank.EPSILON
    raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")


def load(spark: SparkSession, path: str, more: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in (*TABLES, *more)}


def once(spark: SparkSession, name: str, make, more: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The index of this name, built by make(path) at its first use in this application; ``more``: what else make writes."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _BUILT:
        path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
        make(path)
        _BUILT[key] = path
    return load(spark, _BUILT[key], more)


def replace(spark: SparkSession, name: str, make, more: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Build anew beside the old one and switch; queries that run keep reading the old tables."""
    _BUILT.pop((spark.sparkContext.applicationId, name), None)
    return once(spark, name, make, more)
