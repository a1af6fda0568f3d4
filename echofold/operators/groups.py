"""Groups of linked files, who is kept, and what the groups add up to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions import names
from echofold.session import cut


def connected(pairs: DataFrame) -> DataFrame:
    """(path, root): the smallest path linked with each path of (path_a, path_b), directly or not.

    Each round every path takes the smallest label among its neighbours and then that label's own label, so that
    distances halve; rounds end when no label changes. Aggregation before the shuffle keeps hubs small.
    """
    edges = cut(pairs.where("path_a <> path_b").select(F.explode(F.array(F.struct(F.col("path_a").alias("x"), F.col("path_b").alias("y")), F.struct(F.col("path_b").alias("x"), F.col("path_a").alias("y")))).alias("e")).select("e.*").distinct())
    label = cut(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("path"), F.least("x", "m").alias("root")))
    while True:
        near = edges.join(label.select(F.col("path").alias("y"), "root"), "y").groupBy(F.col("x").alias("path")).agg(F.min("root").alias("m"))
        step = label.join(near, "path").select("path", F.least("root", "m").alias("new"), F.col("root").alias("old"))
        jump = step.select(F.col("path").alias("new"), F.col("new").alias("top"))
        step = cut(step.join(jump, "new", "left").select("path", F.coalesce(F.least("new", "top"), "new").alias("root"), "old"))
        changed = step.where("root <> old").limit(1).count()
        label = step.select("path", "root")
        if not changed:
            return label


def group_pairs(pairs: DataFrame) -> DataFrame:
    """(group_id, root, n_files, n_pairs, max_score, min_score, avg_score): groups numbered from 1, best score first, then smaller path."""
    roots = cut(connected(pairs))
    links = pairs.where("path_a <> path_b").join(roots.withColumnRenamed("path", "path_a"), "path_a")
    stats = links.groupBy("root").agg(F.count("*").alias("n_pairs"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.avg("score").alias("avg_score"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n_files"))
    ranked = stats.join(sizes, "root")
    return numbered(ranked, [F.desc("max_score"), F.asc("root")], "group_id").select("group_id", "root", "n_files", "n_pairs", "max_score", "min_score", "avg_score")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with numbers from 1 in a total order: sorted in ranges, counted by partition, numbered within."""
    parts = cut(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return parts.join(F.broadcast(before.select("_p", "_first", "_before")), "_p").withColumn(name, (F.col("_i") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_p", "_i", "_first", "_before")


_MORE = {"newest": "mtime", "longest": "duration", "biggest": "file_size", "oldest": "mtime", "smallest": "file_size"}


def _key(strategy: str, side: str) -> Column:
    if strategy == "highest-res":
        return F.col(f"{side}.width").cast("long") * F.col(f"{side}.height")
    return F.col(f"{side}.{_MORE[strategy]}")


def _sidecars(side: str) -> Column:
    return F.coalesce(F.size(F.col(f"{side}.sidecars")), F.lit(0)) if side else F.lit(0)


def pick_keep(strategy: str, sidecars: bool = True) -> Column:
    """'a', 'b' or null for struct columns a and b: the better one by the strategy, then the larger, then the one with more sidecars.

    One unknown value loses, two decide nothing; biggest and smallest know no further rule; edited asks for sidecars
    first and then for the newer.
    """
    side = lambda won: F.when(won, "a").otherwise("b")
    differ = lambda x, y, more=True: F.when(x != y, side((x > y) if more else (x < y)))
    attached = lambda s: F.greatest(_sidecars(s), F.lit(0)) if sidecars else F.lit(0)
    by_sidecars = differ(attached("a"), attached("b"))
    if strategy == "edited":
        return F.coalesce(by_sidecars, pick_keep("newest", sidecars))
    x, y = _key(strategy, "a"), _key(strategy, "b")
    first = differ(x, y, strategy not in ("oldest", "smallest"))
    if strategy in ("biggest", "smallest"):
        return first
    size = differ(F.col("a.file_size"), F.col("b.file_size"))
    return F.when(x.isNull() & y.isNull(), F.lit(None)).when(x.isNull(), "b").when(y.isNull(), "a").otherwise(F.coalesce(first, size, by_sidecars))


def group_keeper(members: DataFrame, strategy: str) -> DataFrame:
    """(group_id, path): who is kept in each group of members (group_id, path and attributes); no row where the best two tie in all that counts.

    Members without a value are no candidates. Ties fall to the larger file (also for oldest), then to more sidecars.
    The two best of a group are enough, so groups are cut down before they are ranked.
    """
    attached = F.coalesce(F.greatest(F.size("sidecars"), F.lit(0)), F.lit(0)) if "sidecars" in members.columns else F.lit(0)
    value = attached if strategy == "edited" else F.col("width").cast("long") * F.col("height") if strategy == "highest-res" else F.col(_MORE[strategy])
    up = -1 if strategy in ("oldest", "smallest") else 1
    size = F.lit(0) if strategy in ("biggest", "smallest") else F.col("file_size")
    side = F.lit(0) if strategy in ("biggest", "smallest", "edited") else attached
    own = members.where(value.isNotNull()).select("group_id", "path", (value * up).cast("double").alias("v"), size.alias("s"), side.alias("c"))
    order = [F.desc("v"), F.desc("s"), F.desc("c"), F.asc("path")]
    salted = own.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(16))).withColumn("r", F.row_number().over(Window.partitionBy("group_id", "salt").orderBy(*order))).where("r <= 2")
    top = salted.withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where("r <= 2")
    tie = top.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("v", "s", "c").alias("d"), F.min_by("path", "r").alias("path"))
    return tie.where("n = 1 or d = 2").select("group_id", "path")


def auto_delete(scored: DataFrame) -> DataFrame:
    """(path, kept, score): the files a greedy run over the pairs deletes, best score first, within each component.

    `scored` has path_a, path_b, score, keep ('a', 'b' or null) and ref_a, ref_b. A pair is passed over where either
    file is gone, keep is null, or the loser is a reference. What happens in one component never reaches another.
    """
    roots = connected(scored)
    own = scored.join(roots.withColumnRenamed("path", "path_a"), "path_a").where("keep is not null and not (ref_a and ref_b)")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for r in pdf.sort_values(["score", "path_a", "path_b"], ascending=[False, True, True]).itertuples():
            loser, kept, ref = (r.path_b, r.path_a, r.ref_b) if r.keep == "a" else (r.path_a, r.path_b, r.ref_a)
            if r.path_a not in gone and r.path_b not in gone and not ref:
                gone.add(loser)
                out.append((loser, kept, r.score))
        return pd.DataFrame(out, columns=["path", "kept", "score"])

    return own.select("root", "path_a", "path_b", "score", "keep", "ref_a", "ref_b").groupBy("root").applyInPandas(run, "path string, kept string, score double")


def group_deletes(members: DataFrame, strategy: str) -> DataFrame:
    """(group_id, path): all but the kept one and references, of groups of two or more whose keeper is decided."""
    keep = group_keeper(members, strategy)
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2")
    rest = members.where("not coalesce(is_reference, false)").join(keep.select("group_id").join(sizes, "group_id"), "group_id", "left_semi")
    return rest.join(keep, ["group_id", "path"], "left_anti").select("group_id", "path")


def unique_files(pairs: DataFrame) -> DataFrame:
    """(path): each file of the pairs once."""
    return pairs.select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct()


def recoverable(attached: DataFrame) -> DataFrame:
    """(path, file_size): what the pairs (structs a and b) would free: of two references nothing, else the one that is no reference, else the smaller, of equals a."""
    ra, rb = (F.coalesce(F.col(f"{s}.is_reference"), F.lit(False)) for s in "ab")
    pick = F.when(ra & rb, F.lit(None)).when(ra, F.col("b")).when(rb, F.col("a")).when(F.col("a.file_size") <= F.col("b.file_size"), F.col("a")).otherwise(F.col("b"))
    return attached.select(F.struct(pick["path"].alias("path"), pick["file_size"].alias("file_size")).alias("p")).where("p.path is not null").select("p.*").distinct()


def directory_stats(attached: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, total_files, duplicate_files, total_size, recoverable_size, density) of every directory with a duplicate."""
    both = attached.select(F.explode(F.array(*[F.struct(F.col(f"{s}.path").alias("path"), F.col(f"{s}.file_size").alias("file_size")) for s in "ab"])).alias("f")).select("f.*").distinct()
    own = both.withColumn("directory", names.parent(F.col("path"))).groupBy("directory").agg(F.count("*").alias("duplicate_files"), F.sum("file_size").alias("total_size"))
    free = recoverable(attached).withColumn("directory", names.parent(F.col("path"))).groupBy("directory").agg(F.sum("file_size").alias("recoverable_size"))
    known = files.groupBy(names.parent(F.col("path")).alias("directory")).agg(F.count("*").alias("total_files"))
    out = own.join(free, "directory", "left").join(known, "directory", "left")
    total = F.coalesce("total_files", "duplicate_files")
    return out.select("directory", total.alias("total_files"), "duplicate_files", "total_size", F.coalesce("recoverable_size", F.lit(0)).alias("recoverable_size"), (F.col("duplicate_files") / total).alias("density"))


def score_histogram(pairs: DataFrame, width: int = 5) -> DataFrame:
    """(bin, n): counts by bins of `width` from the lowest bin that occurs to the last, empty ones included; 100 belongs to the last."""
    bins = pairs.where("score is not null").groupBy(F.least(F.floor(F.floor("score") / width) * width, F.lit(100 - width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    span = bins.agg(F.min("bin").alias("lo")).where("lo is not null").select(F.explode(F.sequence(F.col("lo"), F.lit(100 - width), F.lit(width))).alias("bin"))
    return span.join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def filetype_breakdown(files: DataFrame) -> DataFrame:
    """(extension, n, bytes) of distinct files (path, file_size)."""
    return files.groupBy(names.suffix(F.col("path")).alias("extension")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


def timeline(files: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(day, total_files, duplicate_files) by UTC day of mtime; unknown times are left out."""
    day = lambda df, n: df.where("mtime is not null").groupBy(F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias(n))
    return day(files, "total_files").join(day(duplicates, "duplicate_files"), "day", "full").select("day", F.coalesce("total_files", F.lit(0)).alias("total_files"), F.coalesce("duplicate_files", F.lit(0)).alias("duplicate_files"))
