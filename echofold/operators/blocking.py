"""Bucket keys for candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.session import cut


def resolution_tier(pixels: Column) -> Column:
    out = F.when(pixels.isNull(), "unknown")
    for most, name in ((153_600, "ld"), (409_920, "sd"), (921_600, "hd"), (2_073_600, "fhd"), (3_686_400, "qhd")):
        out = out.when(pixels <= most, name)
    return out.otherwise("uhd")


def size_tier(size: Column) -> Column:
    """-1 without size, else the whole part of log2 of the MiB, 0.1 at least."""
    return F.when(size.isNull() | (size <= 0), -1).otherwise(F.log2(F.greatest(size / F.lit(1048576.0), F.lit(0.1))).cast("int"))


def anchors(files: DataFrame, key: str, tolerance: float = 2.0) -> DataFrame:
    """(key, anchor): the bucket of each distinct value; a bucket opens at its first value and holds values up to 2 * tolerance above.

    After a gap of more than 2 * tolerance a bucket opens whatever came before, so the distinct values are cut there into
    islands, each folded by a task of its own. Gaps are found in ranges: a range looks at its own values, and at the last one
    of the range before it.
    """
    wide = 2 * tolerance
    values = files.where(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("_v")).distinct()
    ranged = cut(values.repartitionByRange("_v").sortWithinPartitions("_v").withColumn("_part", F.spark_partition_id()))
    ends = ranged.groupBy("_part").agg(F.max("_v").alias("_end"))  # one row a range
    before = F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_part", before.alias("_before"))
    own = Window.partitionBy("_part").orderBy("_v")
    last = F.coalesce(F.lag("_v").over(own), F.col("_before"))
    marked = ranged.join(F.broadcast(ends), "_part").withColumn("_new", (last.isNull() | (F.col("_v") - last > wide)).cast("long"))
    islands = marked.withColumn("_k", F.sum("_new").over(own))
    tops = islands.groupBy("_part").agg(F.max("_k").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a range
    islands = islands.join(F.broadcast(tops), "_part").select("_v", (F.col("_k") + F.col("_base")).alias("_island"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island = anchor = None
        for batch in batches:
            out = []
            for k, v in zip(batch["_island"], batch["_v"], strict=True):
                if k != island or v - anchor > wide:
                    island, anchor = k, v
                out.append(anchor)
            yield pd.DataFrame({key: batch["_v"].astype(float), "anchor": pd.Series(out, dtype=float)})

    return islands.repartition("_island").sortWithinPartitions("_island", "_v").mapInPandas(run, f"{key} double, anchor double")


def anchored_buckets(files: DataFrame, key: str, tolerance: float = 2.0) -> DataFrame:
    """`files` with `bucket` (null = the bucket of unknown values), buckets of one file left out. Counted by aggregation, so that no bucket gathers."""
    anchor = anchors(files, key, tolerance).withColumnRenamed(key, "_k").withColumnRenamed("anchor", "bucket")
    counts = files.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("double").alias("_k")).agg(F.count("*").alias("_c")).join(anchor, "_k")
    kept = counts.groupBy("bucket").agg(F.sum("_c").alias("_n")).where("_n > 1").select("bucket")
    known = anchor.join(kept, "bucket", "left_semi")
    own = files.withColumn("_k", F.col(key).cast("double"))
    return own.join(known, "_k", "left").where(F.col("bucket").isNotNull() | F.col("_k").isNull()).drop("_k")


def refined_buckets(bucketed: DataFrame, pair_limit: int | None = 50_000) -> DataFrame:
    """`bucketed` with `sub`: buckets of more than `pair_limit` pairs are split by resolution, those still above by size; parts of one file are left out. Lossy by definition; pair_limit=None keeps buckets whole."""
    if pair_limit is None:
        return bucketed.withColumn("sub", F.lit(""))
    counts = bucketed.withColumn("_tier", resolution_tier(F.col("width").cast("long") * F.col("height"))).withColumn("_size", size_tier(F.col("file_size")).cast("string"))
    pairs = lambda n: n * (n - 1) / 2
    # at most a few hundred rows a bucket, whatever the bucket's size
    per = counts.groupBy("bucket", "_tier", "_size").agg(F.count("*").alias("n"))
    per = per.withColumn("n_tier", F.sum("n").over(Window.partitionBy("bucket", "_tier"))).withColumn("n_bucket", F.sum("n").over(Window.partitionBy("bucket")))
    sub = F.when(pairs(F.col("n_bucket")) <= pair_limit, F.lit("")).when(pairs(F.col("n_tier")) <= pair_limit, F.col("_tier")).otherwise(F.concat_ws("/", "_tier", "_size"))
    size = F.when(F.col("sub") == "", F.col("n_bucket")).when(F.col("sub") == F.col("_tier"), F.col("n_tier")).otherwise(F.col("n"))
    keys = per.withColumn("sub", sub).where(size > 1).select(F.col("bucket").alias("_b"), F.col("_tier").alias("_t"), F.col("_size").alias("_s"), "sub")
    return counts.join(keys, F.col("bucket").eqNullSafe(F.col("_b")) & (F.col("_tier") == F.col("_t")) & (F.col("_size") == F.col("_s"))).drop("_b", "_t", "_s", "_tier", "_size")


def time_window(epoch: Column, seconds: int = 1800) -> Column:
    """The 30-minute window of a time, cut off towards zero."""
    return (epoch / seconds).cast("long")
