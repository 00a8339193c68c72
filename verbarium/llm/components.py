"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, root): for every end of ``edges`` (a, b) the smallest id that edges lead to.

    Each pass takes the smallest root among neighbours, then the root's root, so
    that chains shorten by powers of two. Passes end when no root changes; tables
    between them are written, and nothing is gathered on the driver. Self-loops,
    repeated edges and an empty table are harmless; rows with a null end are left out.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = scratch.save(e.union(e.select("b", "a")).distinct(), f"{name}_edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root")), f"{name}_0")
    step, before = 0, None
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        low = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = scratch.save(low.join(jump, "root").select("id", F.least("root", "top").alias("root"), "old"), f"{name}_{step + 1}")
        if before:
            scratch.drop(before)
        changed = new.where("root <> old").limit(1).count()
        before, labels, step = f"{name}_{step}", new.select("id", "root"), step + 1
        if not changed:
            return labels
