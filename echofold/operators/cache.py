"""Reusing what earlier runs computed: tables keyed by path and valid while size and time are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["path", "file_size", "mtime"]


def hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached rows of files whose size and time haven't changed."""
    return cached.join(files.select(*KEY).distinct(), KEY, "left_semi")


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    return files.join(cached.select(*KEY).distinct(), KEY, "left_anti")


def hit_counts(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(hits, misses) in one row."""
    marked = files.join(cached.select(*KEY, F.lit(1).alias("_hit")).distinct(), KEY, "left")
    return marked.agg(F.count("_hit").alias("hits"), (F.count("*") - F.count("_hit")).alias("misses"))


def store(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with `fresh` rows in place of those of the same path."""
    return cached.join(fresh.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def pair_hits(cached: DataFrame, files: DataFrame, config_hash: str | None = None) -> DataFrame:
    """Cached pairs of which both files are there with the same times, of one configuration."""
    own = cached.where(F.col("config_hash") == config_hash) if config_hash else cached
    times = files.select("path", "mtime").distinct()
    for s in "ab":
        own = own.join(times.toDF(f"path_{s}", f"mtime_{s}"), [f"path_{s}", f"mtime_{s}"], "left_semi")
    return own


def prune(cached: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of paths that are still active; of pairs, both must be."""
    paths = active.select("path").distinct()
    for c in ("path", "path_a", "path_b"):
        if c in cached.columns:
            cached = cached.join(paths.withColumnRenamed("path", c), c, "left_semi")
    return cached


def detail_rows(pairs: DataFrame) -> DataFrame:
    """(entry_id, comparator, raw, weight) out of the JSON of cached pairs, {name: [raw, weight]}."""
    parsed = F.from_json("detail", "map<string,array<double>>")
    return pairs.select("entry_id", F.explode(parsed).alias("comparator", "v")).select("entry_id", "comparator", F.get("v", 0).alias("raw"), F.get("v", 1).alias("weight"))
