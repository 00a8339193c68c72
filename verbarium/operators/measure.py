"""Ranks and counts that no single task has to gather: numbering within keys, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, keys: list[str], order: str, chunk: Column, name: str) -> DataFrame:
    """df with ``name``: 1, 2, ... within keys by ``order``, of which ``chunk`` is a rising function.

    Rows are numbered within a chunk and set off by the counts of the chunks before it, so
    that a key with most of the rows is numbered by many tasks. Null keys are a key.
    """
    rows = df.withColumn("_at", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), chunk.alias("chunk")))  # structs are equal where both have null, so that one shuffle serves ranks and join
    counts = rows.groupBy("_at").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(*([F.col(f"_at.k{i}") for i in range(len(keys))] or [F.lit(0)])).orderBy("_at.chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_at", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy("_at").orderBy(order))
    out = rows.withColumn("_rn", rn).join(before, "_at")
    return out.withColumn(name, F.col("_before") + F.col("_rn")).select(*df.columns, name)


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, mean, a column for each share): of n values in order, that at place round((n - 1) * share), halves up.

    Exact: equal values are counted first, then dealt into bins with a count each; only
    bins that hold a sought place are put in order.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    edges = F.percentile_approx(value, [i / 200 for i in range(1, 200)], 2000)
    keyed = counted.groupBy(key).agg(F.sum("_n").alias("_all"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), F.array_distinct(edges).alias("_edges"))
    binned = counted.join(keyed.select(key, "_edges"), key).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    so_far = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(key, "_bin").agg(F.sum("_n").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(so_far), F.lit(0)))
    places = F.array(*(F.struct(F.lit(k).alias("share"), (F.floor((F.col("_all") - 1) * v + 0.5) + 1).alias("place")) for k, v in shares.items()))
    sought = bins.join(keyed.select(key, F.explode(places).alias("_s")), key).where((F.col("_s.place") > F.col("_before")) & (F.col("_s.place") <= F.col("_before") + F.col("_size")))
    sought = sought.groupBy(key, "_bin").agg(F.min("_before").alias("_before"), F.collect_list("_s").alias("_s"))
    here = binned.join(sought, [key, "_bin"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_bin").orderBy(value))
    hits = here.withColumn("_upto", upto).withColumn("_x", F.explode("_s")).where((F.col("_x.place") <= F.col("_upto")) & (F.col("_x.place") > F.col("_upto") - F.col("_n")))
    found = hits.groupBy(key).agg(*(F.max(F.when(F.col("_x.share") == k, F.col(value))).alias(k) for k in shares))
    return keyed.select(key, "mean").join(found, key)
