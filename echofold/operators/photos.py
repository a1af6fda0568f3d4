"""The photo library's own rules for buckets, pairs across buckets, and comparators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions import names
from echofold.operators import blocking, comparators, scoring


def video_bucket(duration: Column) -> Column:
    """The whole two-second step of a duration, -1 for an unknown one."""
    return F.coalesce((duration / 2).cast("long"), F.lit(-1))


def image_bucket(taken: Column, pixels: Column) -> Column:
    """The 30-minute window of the time taken, without one the resolution tier."""
    return F.coalesce(blocking.time_window(taken).cast("string"), blocking.resolution_tier(F.coalesce(pixels, F.lit(0).cast("long"))))


def token_sort_levenshtein(a: Column, b: Column) -> Column:
    """Levenshtein ratio of two normalized names with their words sorted."""
    return names.levenshtein_ratio(names.sorted_tokens(a), names.sorted_tokens(b))


def filename() -> Column:
    """The file-name comparator of structs a and b (name), by Levenshtein instead of indel ratio."""
    return comparators.filename(token_sort_levenshtein(F.col("a.name"), F.col("b.name")))


def exif() -> Column:
    """Time taken (one second apart is equal, then linear over an hour), camera, lens and place of structs a and b."""
    x, y = F.col("a.exif_datetime"), F.col("b.exif_datetime")
    apart = F.abs(x - y)
    taken = F.when(x.isNotNull() & y.isNotNull(), F.when(apart <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / 3600.0)))
    equal = lambda f: F.when(F.col(f"a.{f}").isNotNull() & F.col(f"b.{f}").isNotNull(), (F.col(f"a.{f}") == F.col(f"b.{f}")).cast("double"))
    place = [F.col(f"{s}.exif_gps_{k}") for s in "ab" for k in ("lat", "lon")]
    known = place[0].isNotNull() & place[1].isNotNull() & place[2].isNotNull() & place[3].isNotNull()
    near = F.when(known, F.greatest(F.lit(0.0), 1 - comparators.metres(*place) / 1000.0))
    return comparators.weighted([(0.35, taken), (0.20, equal("exif_camera")), (0.10, equal("exif_lens")), (0.25, near)])


def video_pairs(videos: DataFrame, least: float = 0.8) -> DataFrame:
    """(path_a, path_b, same_bucket): videos (path, duration, name) of one bucket, and of different buckets those whose names compare to `least` or more.

    A Levenshtein ratio is never above the indel ratio of the same strings, so the lossless join of similar names gives all
    candidates.
    """
    keyed = videos.select("path", "name", video_bucket(F.col("duration")).alias("bucket"))
    inside = scoring.bucket_pairs(keyed, ("bucket",)).withColumn("same_bucket", F.lit(True))
    side = lambda s: keyed.select(F.col("path").alias(f"path_{s}"), F.struct("name", "bucket").alias(s))
    met = scoring.similar_names(videos.select("path", "name"), least).join(side("a"), "path_a").join(side("b"), "path_b")
    across = met.where((F.col("a.bucket") != F.col("b.bucket")) & (filename() >= least)).select("path_a", "path_b", F.lit(False).alias("same_bucket"))
    return inside.unionByName(across)


def image_pairs_across(images: DataFrame, seconds: float = 120.0) -> DataFrame:
    """(path_a, path_b): images (path, name, taken, pixels) of equal, not empty normalized name and different buckets, `seconds` apart at most where both times are known."""
    keyed = images.where("name <> ''").select("path", "name", "taken", image_bucket(F.col("taken"), F.col("pixels")).alias("bucket"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.col("a.taken").isNull() | F.col("b.taken").isNull() | (F.abs(F.col("a.taken") - F.col("b.taken")) <= seconds)
    on = (F.col("a.name") == F.col("b.name")) & (F.col("a.path") < F.col("b.path")) & (F.col("a.bucket") != F.col("b.bucket")) & near
    return a.join(b, on).select(F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"))
