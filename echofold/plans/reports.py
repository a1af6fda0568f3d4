"""Reports and plans as DataFrames: records, lines of scripts, totals. Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions import formats, names
from echofold.operators import groups

SHOWN = ("duration", "width", "height", "file_size", "codec", "bitrate", "framerate", "audio_channels", "mtime")


def pair_json(attached: DataFrame) -> DataFrame:
    """(path_a, path_b, record): a JSON record of each pair with both files' attributes; unknown ones are null in it."""
    side = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in SHOWN])
    record = F.struct(F.col("path_a").alias("file_a"), F.col("path_b").alias("file_b"), "score", side("a").alias("file_a_metadata"), side("b").alias("file_b_metadata"), F.coalesce("a.is_reference", F.lit(False)).alias("file_a_is_reference"), F.coalesce("b.is_reference", F.lit(False)).alias("file_b_is_reference"))
    return attached.select("path_a", "path_b", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def shell_lines(pairs: DataFrame) -> DataFrame:
    """(path_a, path_b, line): removes the loser of each pair; only a comment where none is decided or the loser is a reference."""
    loser = F.when(F.col("keep") == "a", F.col("path_b")).when(F.col("keep") == "b", F.col("path_a"))
    safe = F.when(F.col("keep") == "a", F.coalesce("b.is_reference", F.lit(False))).otherwise(F.coalesce("a.is_reference", F.lit(False)))
    line = F.when(loser.isNull(), F.concat(F.lit("# undecided: "), formats.comment_text(F.concat_ws(" ", "path_a", "path_b")))).when(safe, F.concat(F.lit("# reference: "), formats.comment_text(loser)))
    return pairs.select("path_a", "path_b", line_or(line, F.concat(F.lit("rm -- "), formats.shell_quote(loser))).alias("line"))


def line_or(line, other):
    return F.coalesce(line, other)


def markdown_rows(pairs: DataFrame, cap: int = 500) -> DataFrame:
    """The best `cap` pairs (path_a, path_b, score, breakdown) as table rows with the comparator that counts most."""
    entries = F.filter(F.map_entries("breakdown"), lambda e: e["value"].isNotNull())
    top = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    row = F.concat(F.lit("| "), formats.markdown_cell(F.col("path_a")), F.lit(" | "), formats.markdown_cell(F.col("path_b")), F.lit(" | "), F.format_string("%.1f", "score"), F.lit(" | "), F.coalesce(top, F.lit("")), F.lit(" |"))
    return pairs.orderBy(F.desc("score"), "path_a", "path_b").limit(cap).select("path_a", "path_b", row.alias("row"))


def pair_csv(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with one column for each comparator; unknown values are empty."""
    return pairs.select("path_a", "path_b", "score", *[F.coalesce(F.col("breakdown")[c].cast("string"), F.lit("")).alias(c) for c in columns])


def group_json(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(root, n_files, record): a JSON record of each group, its members and pairs in order of path.

    A group is one record, so its members are gathered in one row; use group_pairs and members apart where groups may
    be larger than a row should be.
    """
    roots = groups.connected(pairs)
    member = F.struct(F.col("path"), *[F.col(c) for c in SHOWN])
    members = roots.join(files.select("path", *SHOWN), "path", "left").groupBy("root").agg(F.array_sort(F.collect_list(member)).alias("files"))
    links = pairs.join(roots.withColumnRenamed("path", "path_a"), "path_a").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path_a", "path_b", "score"))).alias("pairs"))
    return members.join(links, "root").select("root", F.size("files").alias("n_files"), F.to_json(F.struct("files", "pairs")).alias("record"))


def group_rows(envelopes: DataFrame) -> DataFrame:
    """A row for each member, its group's numbers repeated, `kept` where the group keeps it."""
    own = envelopes.select("group_id", "file_count", F.round("max_score", 4).alias("max_score"), "keep", F.posexplode("files").alias("place", "f"))
    return own.select("group_id", "file_count", "max_score", "place", "f.path", "f.file_size", F.coalesce(F.col("f.path") == F.col("keep"), F.lit(False)).alias("kept"))


def replay_groups(envelopes: DataFrame) -> DataFrame:
    """(group_id, file_a, file_b, score): the pairs of an earlier run's groups, each pair of files of a group once with its best score."""
    return envelopes.select("group_id", F.explode("pairs").alias("p")).select("group_id", "p.*").where("file_a is not null and file_b is not null").groupBy("group_id", "file_a", "file_b").agg(F.max("score").alias("score"))


def planned_actions(deletes: DataFrame, keepers: DataFrame, action: str = "moved", folder: str = "/trash") -> DataFrame:
    """(action, path, kept, destination): what a run would do."""
    return deletes.join(keepers.withColumnRenamed("path", "kept"), "group_id").select(F.lit(action).alias("action"), "path", "kept", F.concat(F.lit(folder + "/"), names.basename(F.col("path"))).alias("destination")).distinct()


def undo_lines(actions: DataFrame) -> DataFrame:
    """(path, line, reversible): moves back what was moved, unlinks what was linked, and warns of what is gone."""
    q = lambda c: formats.shell_quote(F.col(c))
    line = F.when(F.col("action") == "moved", F.concat(F.lit("mv -n -- "), q("destination"), F.lit(" "), q("path")))
    line = line.when(F.col("action").isin("hardlinked", "symlinked", "reflinked"), F.concat(F.lit("cp --remove-destination -- "), q("kept"), F.lit(" "), q("path")))
    return actions.select("path", line.otherwise(F.concat(F.lit("# can't be undone ("), F.col("action"), F.lit("): "), formats.comment_text(F.col("path")))).alias("line"), F.col("action").isin("moved", "hardlinked", "symlinked", "reflinked").alias("reversible"))


def dry_run(doomed: DataFrame) -> DataFrame:
    """(n_files, bytes, n_sidecars) of the files that would go."""
    own = doomed.select("path", "file_size", F.coalesce(F.greatest(F.size("sidecars"), F.lit(0)), F.lit(0)).alias("s")).dropDuplicates(["path"])
    return own.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_sidecars"))


def envelope(stats: DataFrame, args: dict[str, str], version: str = "1") -> DataFrame:
    """(envelope): one JSON record of a run's version, time, arguments and the one row of `stats`; pairs or groups are written beside it, one record a line."""
    told = F.struct(*[F.lit(v).alias(k) for k, v in args.items()]) if args else F.struct(F.lit(None).cast("string").alias("none"))
    head = F.struct(F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), told.alias("args"), F.struct(*stats.columns).alias("stats"))
    return stats.select(F.to_json(head).alias("envelope"))
