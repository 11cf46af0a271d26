"""Where parsed documents are kept: node tables bucketed by document.

Every axis, window and aggregate of the engine is keyed by ``doc_id``. A table that is bucketed and sorted by it is read already partitioned, so a
path of many steps plans without a shuffle of the nodes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import never_broadcast, shared_dir


def save_nodes(nodes: DataFrame, buckets: int, table: str | None = None, path: str | None = None) -> DataFrame:
    """Write the nodes as a table of ``buckets`` buckets by ``doc_id`` and read it back.

    Size buckets so that one fits a task: about the bytes of the nodes over 128 MB. The files go to ``path``, or to the shared folder.
    """
    spark = nodes.sparkSession
    # Joins on the document and more keys then keep the partitioning by document alone, instead of shuffling for all keys.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = table or f"nodes_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/tables/{table}"
    nodes.repartition(buckets, "doc_id").write.format("parquet").bucketBy(buckets, "doc_id").sortBy("doc_id", "pre").option("path", path).mode("overwrite").saveAsTable(table)
    return never_broadcast(spark.table(table))
