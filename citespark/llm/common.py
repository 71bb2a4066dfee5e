"""What the operators of this subpackage share: scratch tables in the cluster's shared folder, and key columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle files go when the query that wrote them ends. Left to the collector, those of the last query outlive it: the listeners' queue holds its plan until the next event.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="citespark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Written tables that cut lineage: a lost executor rereads them instead of redoing what came before."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.sweep()
        path, had = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if had is None else self.spark.conf.set(CLEANUP, had)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and let Spark's cleaner free shuffles that are out of use."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.sweep()

    def only(self, *names: str) -> None:
        """Delete all tables but these: what an operator hands on must not hang on to what it took to get there."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.drop(*(n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n not in names))

    def sweep(self) -> None:
        """Collect plans out of reach: Spark deletes the files of their shuffles when the driver's objects go, else only every 30 minutes."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """Tells rows with one doc_id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or a variation that no column of df has (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with groups, one row for each value of keys, n of them in rows; keys are not null. The column n is dropped.

    Groups with over 1/512 of the rows, of which there can be 511 at most, are broadcast, so that their rows stay where they
    are; the others are joined by a shuffle.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(n) * 512 > total).drop(n))
    cold = groups.where(F.col(n) * 512 <= total).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold.hint("shuffle_merge"), keys))


def per_row(make: Callable[[], Callable[[str], tuple]], keep: list[str], text: str, out: list[str]):
    """A mapInPandas function: columns keep, then what make()(text) returns for each row. make runs once in each task."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for pdf in batches:
            made = [f(t if isinstance(t, str) else "") for t in pdf[text]]
            add = pd.DataFrame(made, columns=out, index=pdf.index) if made else pd.DataFrame(columns=out)
            yield pd.concat([pdf[keep], add], axis=1)

    return run
