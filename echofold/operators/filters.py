"""Filters on file metadata. An unknown (null) attribute passes every filter but the one on size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(c: Column, least=None, most=None, null_passes: bool = True) -> Column:
    """Inclusive bounds; either may be missing."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (c >= least)
    if most is not None:
        ok = ok & (c <= most)
    return c.isNull() | ok if null_passes else ok


def pixels(width: str = "width", height: str = "height") -> Column:
    return F.col(width).cast("long") * F.col(height)


def metadata_filter(
    files: DataFrame, *, min_size=None, max_size=None, min_duration=None, max_duration=None, min_resolution=None, max_resolution=None, min_bitrate=None, max_bitrate=None, codecs: Iterable[str] | None = None
) -> DataFrame:
    """The files within all bounds. Resolutions are (width, height) and compare by pixels; codecs compare without case."""
    area = lambda r: None if r is None else r[0] * r[1]
    ok = within(F.col("file_size"), min_size, max_size, null_passes=False) & within(F.col("duration"), min_duration, max_duration)
    ok = ok & within(pixels(), area(min_resolution), area(max_resolution)) & within(F.col("bitrate"), min_bitrate, max_bitrate)
    if codecs is not None:
        ok = ok & (F.col("codec").isNull() | F.lower("codec").isin([c.lower() for c in codecs]))
    return files.where(ok)


def under(path: Column, directories: Iterable[str]) -> Column:
    """Whether a path lies under one of the directories."""
    out = F.lit(False)
    for d in directories:
        out = out | path.startswith(d.rstrip("/") + "/")
    return out


def tag_references(files: DataFrame, directories: Iterable[str]) -> DataFrame:
    """Marks the files under the directories as references."""
    return files.withColumn("is_reference", F.coalesce(F.col("is_reference"), F.lit(False)) | under(F.col("path"), directories))


def search(pairs: DataFrame, text: str) -> DataFrame:
    """Pairs with the text in either path, without regard to case."""
    return pairs.where(F.lower("path_a").contains(text.lower()) | F.lower("path_b").contains(text.lower()))


def unordered(pairs: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """The smaller path first."""
    return pairs.withColumns({a: F.least(F.col(a), F.col(b)), b: F.greatest(F.col(a), F.col(b))})


def without_ignored(pairs: DataFrame, ignored: DataFrame) -> DataFrame:
    """Pairs not on the list, whatever the order of the two paths."""
    keys = ignored.select(F.least("path_a", "path_b").alias("_x"), F.greatest("path_a", "path_b").alias("_y")).distinct()
    return pairs.join(keys, (F.least("path_a", "path_b") == F.col("_x")) & (F.greatest("path_a", "path_b") == F.col("_y")), "left_anti")


def touching(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with at least one path among `members` (path)."""
    keys = members.select("path").distinct()
    a = pairs.join(keys.withColumnRenamed("path", "path_a"), "path_a", "left_semi")
    b = pairs.join(keys.withColumnRenamed("path", "path_b"), "path_b", "left_semi")
    return a.unionByName(b.select(a.columns)).distinct()
