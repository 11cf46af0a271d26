"""Connected components by contraction, all of it DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialised, materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Each round every vertex points at its smallest neighbour, pointers are followed twice, and edges
    are renamed to where their ends point; edges inside a cluster vanish. Rounds are about the logarithm of
    the longest path. Loops and nulls are ignored; no edges give no rows. A hub's neighbours are reduced by
    partial aggregation, and the joins are on vertices, which adaptive execution splits where skewed.
    """
    live = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        far = up.join(up.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        far = materialise(far, "jumps")
        if labels is None:
            new = far.select("v", F.col("p").alias("component"))
        else:
            new = labels.join(far.withColumnRenamed("v", "component"), "component", "left").select("v", F.coalesce("p", "component").alias("component"))
        new = materialise(new, "labels")
        a, b = far.select(F.col("v").alias("a"), F.col("p").alias("pa")), far.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        renamed = live.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b")
        following = materialise(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        for old in (live, up, far, *([labels] if labels is not None else [])):
            drop_materialised(old)
        live, labels = following, new
    if labels is None:
        return live.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels
