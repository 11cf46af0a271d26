"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch, at most: whole texts go through these, and an executor holds several of them beside its heap.
ARROW_ROWS = 500
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the rows of one Arrow batch.

    On a cluster ship the package with ``--py-files``; the path set here only
    helps where workers see the driver's checkout.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # Spark's own Bloom filters on shuffled joins, of a fixed size, whatever the sizes of the tables: texts that can't match aren't shuffled.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "64m")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (as in tests) gets a local folder; on a cluster there is none that all machines see, so it is an error.
    """
    there = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"file://{tempfile.gettempdir()}/xylem-shared-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir()
    return there


#: Spark's own switch for shuffle files to go as soon as the execution that made them has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read and nothing more. What was shuffled for the table is freed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._xylem_path = path
    return out


def drop_materialised(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` once nothing reads it any more."""
    path = getattr(df, "_xylem_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def clear_materialised(spark: SparkSession) -> None:
    """Delete all tables that this package has written under the shared folder; for the end of a session, when nothing reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A materialised table with a broadcast hint if it has at most ``rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` with a hint that joins of it, and of what is filtered, projected or aggregated from it, are merge joins unless the other side is broadcast by a hint.

    The planner takes a table's size from its compressed files and the share of its columns: a column of some bytes in nodes that are repeated text looks like
    a hundredth of what it is, and what is parsed from a text looks like the text. A broadcast by such an estimate is gathered in the driver.
    """
    return df.hint("merge")


def key_text(key: str) -> Column:
    """An integer key as text, for the way through pandas, where nulls would turn integers to floats."""
    return F.col(key).cast("long").cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
