"""Watching for new files: each micro-batch is scored against all known files and against itself, then becomes known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echofold.functions import alike, names
from echofold.operators import scoring
from echofold.session import shared_folder

ATTRIBUTES = ("path", "duration", "width", "height", "file_size", "mtime")
KNOWN = "path string, duration double, width int, height int, file_size bigint, mtime double, batch bigint"
ASPECTS = ("filename", "duration", "resolution", "file_size")


def default_weights(kind: str) -> dict[str, float]:
    """The weights of a kind's profile, of the aspects that watching looks at."""
    return {k: float(w) for k, w in scoring.WEIGHTS[kind].items() if k in ASPECTS}


def _ratio(x: Column, y: Column) -> Column:
    """Smaller by larger; 1.0 for two zeros, 0.0 where either is unknown."""
    return F.when(x.isNull() | y.isNull(), 0.0).when((x == 0) & (y == 0), 1.0).otherwise(F.least(x, y) / F.greatest(x, y).cast("double"))


def _within_reach(weights: dict[str, float], needed: float, a: pd.DataFrame, b: pd.DataFrame, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of rows (stem, pixels, size) whose weighted sum without durations can reach `needed`: letters in common bound the name from above."""
    bags, columns = alike.Bags(a["stem"].tolist(), b["stem"].tolist()), [(weights.get(k, 0.0), *[x[c].to_numpy(np.float32, na_value=np.nan) for x in (a, b)]) for k, c in (("resolution", "pixels"), ("file_size", "size"))]
    (la, lb), name = (n.astype(np.float32) for n in bags.lengths), np.float32(weights.get("filename", 0.0))
    for at in range(0, len(a), alike.TILE):
        rows = slice(at, at + alike.TILE)
        longer = np.maximum(la[rows, None], lb[None, :])
        bound = bags.common(rows)
        if (la[rows] > alike.WIDE).any() or (lb > alike.WIDE).any():
            bound = np.where((la[rows, None] > alike.WIDE) | (lb[None, :] > alike.WIDE), longer, bound)
        bound = np.where(longer > 0, bound / np.maximum(longer, 1), np.float32(1)) * name
        for w, x, y in columns:
            if w:
                low, high = np.minimum(x[rows, None], y[None, :]), np.maximum(x[rows, None], y[None, :])
                # unknown counts 0; what isn't positive is left to the exact score
                bound += np.where(np.isnan(high), np.float32(0), np.where(high > 0, low / np.where(high > 0, high, 1), np.float32(np.inf))) * np.float32(w)
        i, j = np.nonzero(bound >= needed - 1e-3)
        i = i + at
        yield (i[i < j], j[i < j]) if same else (i, j)


def alerts(new: DataFrame, known: DataFrame | None, threshold: float = 85.0, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(path, match, score) of new files against known ones of the same kind; with None, against each other, each pair once, path > match.

    Durations differ by 2 s at most where both are known; an unknown one meets all files of the kind. The score is the
    weighted mean of name (Levenshtein), duration (10 % tolerance), resolution and size in whole percent; an unknown aspect
    counts 0 and keeps its weight. `weights` by kind replaces default_weights. Known durations are joined on neighbouring
    two-second cells. Where one is unknown, files of a kind meet in blocks, and what sizes, pixels and common letters can
    reach at most decides which are scored, so no pair is lost and no task holds more than two blocks. Rows without a path or of no
    known kind give nothing.
    """
    weights = weights or {kind: default_weights(kind) for kind in names.SUFFIXES}
    keyed = lambda df: df.where("path is not null").select(*ATTRIBUTES, names.media_type(F.col("path")).alias("kind"), F.lower(names.stem(F.col("path"))).alias("stem")).withColumn("cell", F.floor(F.col("duration") / 2))
    left, right = keyed(new), keyed(new if known is None else known)
    around = lambda c: F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)]))
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.path") > F.col("b.path") if known is None else F.col("a.path") != F.col("b.path"))
    shown = [*ATTRIBUTES, "kind", "stem"]
    sides = [F.struct(*[f"{k}.{c}" for c in shown]).alias(k) for k in ("a", "b")]
    met = left.withColumn("near", around("cell")).alias("a").join(right.alias("b"), same & (F.col("a.near") == F.col("b.cell")) & (F.abs(F.col("a.duration") - F.col("b.duration")) <= 2)).select(*sides)
    needed = {kind: (threshold - 0.5) / 100 * sum(w.values()) for kind, w in weights.items()}
    # without a duration the threshold can be out of reach
    open_kinds = [kind for kind, w in weights.items() if sum(v for k, v in w.items() if k != "duration") >= needed[kind]]
    if open_kinds:
        own = lambda df: df.where(F.col("kind").isin(open_kinds)).select("path", F.col("kind").alias("_key"), "stem", (F.col("width").cast("double") * F.col("height")).alias("pixels"), F.col("file_size").cast("double").alias("size"), F.to_json(F.struct(*shown)).alias("row"), F.col("duration").isNull().alias("bare"))

        def look(a: pd.DataFrame, b: pd.DataFrame, once: bool) -> Iterator[pd.DataFrame]:
            kind = a["_key"].iloc[0]
            for i, j in _within_reach(weights[kind], needed[kind], a, b, once):
                yield pd.DataFrame({"a": a["row"].to_numpy()[i], "b": b["row"].to_numpy()[j]})

        x, y = own(left), own(right)
        bare = lambda df, yes: df.where(F.col("bare") if yes else ~F.col("bare"))
        blocks = lambda p, q=None: scoring.in_blocks(p, "path", ["stem", "pixels", "size", "row"], look, "a string, b string", others=q)
        reached = blocks(bare(x, True)).unionByName(blocks(bare(x, True), bare(y, False))) if known is None else blocks(bare(x, True), y).unionByName(blocks(bare(x, False), bare(y, True)))
        rows = reached.select(*[F.from_json(k, left.select(*shown).schema).alias(k) for k in "ab"])
        if known is None:
            up = F.col("a.path") > F.col("b.path")
            rows = rows.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"))
        met = met.unionByName(rows.where(same))
    d, e = F.col("a.duration"), F.col("b.duration")
    pixels = [F.col(f"{s}.width").cast("long") * F.col(f"{s}.height") for s in "ab"]
    raw = {
        "filename": names.levenshtein_ratio(F.col("a.stem"), F.col("b.stem")),
        "duration": F.when(d.isNull() | e.isNull(), 0.0).when((d == 0) & (e == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(d - e) / (F.greatest(d, e) * 0.1))),
        "resolution": _ratio(*pixels),
        "file_size": _ratio(F.col("a.file_size"), F.col("b.file_size")),
    }
    score = F.lit(None).cast("int")
    for kind, w in weights.items():
        if (total := sum(w.values())) > 0:
            score = F.when(F.col("a.kind") == kind, F.round(sum((raw[k] * v for k, v in w.items()), F.lit(0.0)) / total * 100).cast("int")).otherwise(score)
    return met.select(F.col("a.path").alias("path"), F.col("b.path").alias("match"), score.alias("score")).where(F.col("score") >= threshold)


def renames(new: DataFrame, vanished: DataFrame) -> DataFrame:
    """(path, was): new files that are known files under another name, by inode, else by size where that is unique on both sides."""
    by = lambda key: new.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("path").alias("path")).join(vanished.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("m"), F.min("path").alias("was")), key).where("n = 1 and m = 1").select("path", "was")
    first = by("inode")
    return first.unionByName(by("file_size").join(first.select("path"), "path", "left_anti").join(first.select("was"), "was", "left_anti").select("path", "was"))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def watch(stream: DataFrame, known_dir: str, alerts_dir: str, checkpoint: str, threshold: float = 85.0) -> StreamingQuery:
    """Runs `alerts` on each micro-batch of the stream until it has read what is there.

    A known path of the same size and time is dropped; a changed one is scored again. Two copies in one batch find each
    other once. A batch writes its files under its own number, so that running it again after a failure replaces them. If
    the known files can't be read the batch fails; only a folder that isn't there yet means that nothing is known.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.where("path is not null")
        fresh = (scoring.latest(own) if "scanned_at" in own.columns else own.dropDuplicates(["path"])).select(*ATTRIBUTES).persist()
        known = spark.read.schema(KNOWN).parquet(known_dir) if _exists(spark, known_dir) else spark.createDataFrame([], KNOWN)
        known = known.where(F.col("batch") < number)
        last = known.groupBy("path").agg(F.max_by(F.struct(*ATTRIBUTES[1:]), "batch").alias("k")).select("path", "k.*")
        new = fresh.join(last.select("path", "file_size", "mtime"), ["path", "file_size", "mtime"], "left_anti").persist()
        out = alerts(new, last, threshold).unionByName(alerts(new, None, threshold))
        out.write.mode("overwrite").parquet(f"{alerts_dir}/batch={number}")
        new.write.mode("overwrite").parquet(f"{known_dir}/batch={number}")
        new.unpersist()
        fresh.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed_alerts(spark: SparkSession, source: str, name: str, threshold: float = 85.0) -> DataFrame:
    """The alerts of a stream that reads the table at `source`; state is kept in the shared folder under `name`, by which a broken run is taken up again."""
    base = f"{shared_folder(spark)}/watch-{name}"
    folder, _, file = source.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "*.parquet").parquet(source if not source.endswith(".parquet") else f"{folder}/{file[:-8]}*.parquet")
    watch(stream, f"{base}/known", f"{base}/alerts", f"{base}/state", threshold).awaitTermination()
    return spark.read.schema("path string, match string, score int").parquet(f"{base}/alerts").select("path", "match", "score")
