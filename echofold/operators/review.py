"""What comes after scoring: filters by what people decided, sorting and limits, group-aware totals, pairs out of groups, cached pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators import filters, groups

def _reference(s: str = "is_reference") -> Column:
    return F.coalesce(F.col(s), F.lit(False))


# --- sorting and limits
def sort_pairs(attached: DataFrame, by: str = "score") -> DataFrame:
    """Pairs (path_a, path_b, score, structs a and b) by score, size of both, path or latest time (unknown is 0); ties by path."""
    total = F.coalesce("a.file_size", F.lit(0)) + F.coalesce("b.file_size", F.lit(0))
    last = F.greatest(F.coalesce("a.mtime", F.lit(0.0)), F.coalesce("b.mtime", F.lit(0.0)))
    first = {"score": [F.desc("score")], "size": [total.desc()], "path": [], "mtime": [last.desc()]}[by]
    return attached.orderBy(*first, "path_a", "path_b")


def sort_groups(stats: DataFrame, by: str = "score") -> DataFrame:
    """Groups (group_id, max_score, files array of structs) by best score, size of all members, smallest path or latest time; ties by group_id."""
    size = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["file_size"], F.lit(0)))
    last = F.array_max(F.transform("files", lambda f: F.coalesce(f["mtime"], F.lit(0.0))))
    first = F.array_min(F.transform("files", lambda f: f["path"]))
    keys = {"score": [F.desc_nulls_last("max_score")], "size": [size.desc_nulls_last()], "path": [first.asc_nulls_last()], "mtime": [last.desc_nulls_last()]}[by]
    return stats.orderBy(*keys, "group_id")


def finish_pairs(scored: DataFrame, ignored: DataFrame, files: DataFrame, min_score: float | None = None, by: str = "score", limit: int | None = None) -> DataFrame:
    """The order of steps after scoring: ignored pairs, least (rounded) score, sorting, limit."""
    out = filters.without_ignored(scored, ignored)
    if min_score is not None:
        out = out.where(F.round("score", 1) >= min_score)
    side = lambda s: files.select(F.col("path").alias(f"path_{s}"), F.struct("file_size", "mtime").alias(s))
    out = sort_pairs(out.join(side("a"), "path_a", "left").join(side("b"), "path_b", "left"), by).drop("a", "b")
    return out.limit(limit) if limit else out


# --- totals of groups
def recoverable_in_groups(members: DataFrame, strategy: str) -> DataFrame:
    """(path, file_size): the files that the groups (group_id, path and attributes) would free: of each group's files that are no references all but the best; all of them where none is."""
    free = members.where(~_reference())
    keep = groups.group_keeper(free, strategy)
    return free.join(keep, ["group_id", "path"], "left_anti").groupBy("path").agg(F.max("file_size").alias("file_size"))


def space_of_groups(members: DataFrame) -> DataFrame:
    """(n_files, bytes): all that is no reference where a group has one, else all but its largest file (of equals the greatest path). A path of several groups counts once, with its largest size."""
    own = members.groupBy("group_id").agg(F.max(_reference()).alias("has"), F.max(F.struct(F.coalesce("file_size", F.lit(0)).alias("s"), "path")).alias("top"))
    free = members.join(own, "group_id").where(F.when(F.col("has"), ~_reference()).otherwise(F.col("path") != F.col("top.path")))
    return free.groupBy("path").agg(F.max(F.coalesce("file_size", F.lit(0))).alias("s")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))


# --- what people decided
def active_pairs(pairs: DataFrame, actioned: DataFrame, ignored: DataFrame, resolved: DataFrame) -> DataFrame:
    """`pairs` with `resolved`: those of an actioned file (path) drop out unless they are resolved (path_a, path_b), ignored ones always."""
    done = resolved.select(F.least("path_a", "path_b").alias("_x"), F.greatest("path_a", "path_b").alias("_y")).distinct().withColumn("resolved", F.lit(True))
    x, y = F.least("path_a", "path_b"), F.greatest("path_a", "path_b")
    out = filters.without_ignored(pairs, ignored).join(done, (x == F.col("_x")) & (y == F.col("_y")), "left").drop("_x", "_y").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    for s in ("a", "b"):
        gone = actioned.select(F.col("path").alias(f"path_{s}"), F.lit(True).alias(f"_{s}")).distinct()
        out = out.join(gone, f"path_{s}", "left")
    return out.where(F.col("resolved") | ~(F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)))).select(*pairs.columns, "resolved")


def active_groups(envelopes: DataFrame, actioned: DataFrame, ignored: DataFrame) -> DataFrame:
    """`envelopes` without groups of which all files that may go (neither kept nor references) are actioned, or all pairs ignored."""
    files = envelopes.select("group_id", "keep", F.explode("files").alias("f")).select("group_id", "f.path", F.coalesce(F.col("f.path") != F.col("keep"), F.lit(True)).alias("other"), F.coalesce("f.is_reference", F.lit(False)).alias("ref"))
    may_go = files.where("other and not ref and path is not null").join(actioned.select("path", F.lit(1).alias("gone")).distinct(), "path", "left")
    all_gone = may_go.groupBy("group_id").agg(F.count("*").alias("n"), F.count("gone").alias("m")).where("n = m").select("group_id")
    pairs = envelopes.select("group_id", F.explode("pairs").alias("p")).select("group_id", F.least("p.file_a", "p.file_b").alias("x"), F.greatest("p.file_a", "p.file_b").alias("y"))
    listed = ignored.select(F.least("path_a", "path_b").alias("x"), F.greatest("path_a", "path_b").alias("y"), F.lit(1).alias("hidden")).distinct()
    all_ignored = pairs.join(listed, ["x", "y"], "left").groupBy("group_id").agg(F.count("*").alias("n"), F.count("hidden").alias("m")).where("n = m").select("group_id")
    return envelopes.join(all_gone.unionByName(all_ignored).distinct(), "group_id", "left_anti")


def pairs_of_groups(envelopes: DataFrame) -> DataFrame:
    """(group_id, path_a, path_b, score, size_a, size_b, reference_a, reference_b, keep): each group's pairs, with what its array says of the files (the first entry of a path), and keep 'a' or 'b' where the group keeps one of the two."""
    own = envelopes.select("group_id", "keep", "files", F.explode("pairs").alias("p"))
    of = lambda p: F.get(F.filter("files", lambda f: f["path"] == F.col(p)), F.lit(0))
    a, b = of("p.file_a"), of("p.file_b")
    keep = F.when(F.col("keep") == F.col("p.file_a"), "a").when(F.col("keep") == F.col("p.file_b"), "b")
    return own.select(
        "group_id", F.col("p.file_a").alias("path_a"), F.col("p.file_b").alias("path_b"), F.col("p.score").alias("score"), F.coalesce(a["file_size"], F.lit(0)).alias("size_a"), F.coalesce(b["file_size"], F.lit(0)).alias("size_b"),
        F.coalesce(a["is_reference"], F.lit(False)).alias("reference_a"), F.coalesce(b["is_reference"], F.lit(False)).alias("reference_b"), keep.alias("keep"),
    )


def bulk_candidates(envelopes: DataFrame, actioned: DataFrame) -> DataFrame:
    """(path, file_size): each file of the groups with a kept one that is neither kept, nor a reference, nor actioned; once, with its largest size."""
    files = envelopes.where("keep is not null").select("keep", F.explode("files").alias("f")).where((F.col("f.path") != F.col("keep")) & ~F.coalesce("f.is_reference", F.lit(False)))
    return files.select("f.path", "f.file_size").join(actioned.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.max("file_size").alias("file_size"))


# --- cached pairs, rates, overlap
def cached_pairs(cached: DataFrame, threshold: float = 50.0, digits: int = 1) -> DataFrame:
    """(entry_id, path_a, path_b, score, breakdown): scored pairs as a cache holds them, detail being JSON {name: [raw, weight]}; the threshold applies to the stored score, unknown aspects are lost."""
    detail = F.from_json("detail", "map<string,array<double>>")
    part = F.transform_values(detail, lambda _, v: F.round(F.get(v, F.lit(0)) * F.get(v, F.lit(1)), digits))
    return cached.where(F.col("score") >= threshold).select("entry_id", "path_a", "path_b", F.round("score", 1).alias("score"), part.alias("breakdown"))


def smoothed(values: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array in its order, from its first value on; null for an empty array."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)).cast("double"), lambda s, x: alpha * x + (1 - alpha) * s)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null where either is null, 0.0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both))
