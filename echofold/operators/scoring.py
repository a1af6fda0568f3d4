"""Scoring candidate pairs: weighted comparators, the file-name gate and the threshold."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions import alike, fingerprints, names
from echofold.operators import blocking, comparators, weighed
from echofold.session import cut, default_parallelism

# Default weights by profile.
WEIGHTS = {
    "video": {"filename": 35, "duration": 35, "resolution": 15, "file_size": 15},
    "video+content": {"filename": 20, "duration": 20, "resolution": 10, "file_size": 10, "content": 40},
    "video+audio": {"filename": 25, "duration": 25, "resolution": 10, "file_size": 10, "audio": 30},
    "video+audio+content": {"filename": 15, "duration": 15, "resolution": 10, "file_size": 10, "audio": 10, "content": 40},
    "image": {"filename": 25, "resolution": 20, "file_size": 15, "exif": 40},
    "image+content": {"filename": 15, "resolution": 10, "file_size": 10, "exif": 25, "content": 40},
    "audio": {"filename": 30, "duration": 30, "tags": 40},
    "audio+fp": {"filename": 15, "duration": 15, "tags": 20, "audio": 50},
    "document": {"filename": 30, "file_size": 15, "page_count": 15, "doc_meta": 40},
    "document+content": {"filename": 15, "file_size": 10, "page_count": 10, "doc_meta": 25, "content": 40},
}
GATE = 0.6
ATTRIBUTES = (
    "path filename duration width height file_size mtime is_reference pre_hash exif_datetime exif_camera exif_lens exif_gps_lat exif_gps_lon exif_width exif_height tag_title tag_artist tag_album page_count "
    "doc_title doc_author doc_created"
).split()


def parse_weights(spec: str) -> dict[str, float]:
    """'filename=50, duration=50' and the like: finite, not negative, no name twice; filesize stands for file_size."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, sep, value = part.partition("=")
        name = {"filesize": "file_size"}.get(name.strip(), name.strip())
        w = float(value) if sep else math.nan
        if name in out or not math.isfinite(w) or w < 0:
            raise ValueError(f"not a weight: {part!r}")
        out[name] = w
    return out


def with_directory(weights: dict[str, float]) -> dict[str, float]:
    """Weights that include a directory weight, brought to a sum of 100."""
    total = sum(weights.values())
    return {k: v * 100 / total for k, v in weights.items()} if weights.get("directory", 0) > 0 and total > 0 else dict(weights)


def config_hash(config: dict) -> str:
    """MD5 of a configuration, whatever the order of its keys."""
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()


def latest(files: DataFrame) -> DataFrame:
    """One row a path: of several scans the last one, of equal ones the greatest values."""
    rest = sorted(c for c in files.columns if c not in ("path", "scanned_at") and not c.startswith("sidecars"))
    best = files.groupBy("path").agg(F.max(F.struct("scanned_at", *rest)).alias("r"), F.max_by("sidecars", F.struct("scanned_at", *rest)).alias("sidecars")) if "sidecars" in files.columns else files.groupBy("path").agg(F.max(F.struct("scanned_at", *rest)).alias("r"))
    return best.select("path", "r.*", *(["sidecars"] if "sidecars" in files.columns else []))


def prepared(files: DataFrame) -> DataFrame:
    """The attributes that comparators read, with the normalized name."""
    return files.select(*ATTRIBUTES, names.normalize_filename(F.col("filename")).alias("name"))


#: Files of a bucket that one task pairs with as many others.
BLOCK = 2_000


def bucket_pairs(bucketed: DataFrame, keys: tuple[str, ...] = ("bucket", "sub"), block: int = BLOCK, carried: tuple[str, ...] = ()) -> DataFrame:
    """(path_a, path_b), path_a < path_b: all pairs within a bucket; with `carried`, structs a and b of these columns as well, so that pairs need no join to get them.

    A bucket of more than `block` files, that of unknown values for one, is cut into blocks by hash, and each block is joined
    with each: so no task holds more than two blocks, and every pair still meets once.
    """
    thin = bucketed.select("path", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]).alias("_key"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_own_{c}") for c in carried])
    large = cut(thin.groupBy("_key").count().where(F.col("count") > block).select("_key", F.ceil(F.col("count") / block).cast("int").alias("_n")))
    thin = thin.join(large, "_key", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("path"), F.col("_n")).cast("int"))
    # a block meets itself and those after it as the left side, and those before it as the right side
    a = thin.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).alias("a")
    b = thin.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).alias("b")
    same = (F.col("a._key") == F.col("b._key")) & (F.col("a._b") == F.col("b._with")) & (F.col("a._with") == F.col("b._b"))
    for i in range(len(keys)):
        same = same & F.col(f"a._{i}").eqNullSafe(F.col(f"b._{i}"))
    sides = [F.struct(F.col(f"{s}.path"), *[F.col(f"{s}._own_{c}").alias(c) for c in carried]).alias(s) for s in "ab"] if carried else []
    return a.join(b, same & (F.col("a.path") < F.col("b.path"))).select(F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"), *sides)


#: Names that one task compares with as many others.
NAMES = 8_192
#: Buckets up to which their numbers of blocks are broadcast, so that no bucket gathers in one task to get its own.
FEW = 10_000
#: Blocks of a bucket that are enough to keep all tasks busy.
MANY = 8


def _seen(n: Column) -> dict[str, Column]:
    return {"words": names.sorted_tokens(n), "id": names.is_numeric_id(n), "digits": names.digits(n), "text": names.skeleton(n), "runs": F.array_join(names.digit_runs(n), " ")}


def _told(named: DataFrame, *more: str) -> DataFrame:
    """What alike.near looks at."""
    return named.select(*more, "name", *[c.alias(k) for k, c in _seen(F.col("name")).items()])


def in_blocks(rows: DataFrame, of: str, seen: list[str], look: Callable, out: str, block: int = NAMES, others: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """What look(a, b, same) yields (frames of `out`) of the rows (of, _key, seen) of one _key, each two meeting once in blocks; with `others`, of each row with each of those.

    A row is copied for each block that it meets: with `most`, where there are more than MANY blocks, they grow up to that size.
    """
    parts = default_parallelism(rows.sparkSession)
    of_size = lambda n: F.ceil(F.col("count") / n).cast("int")
    blocks = F.least(of_size(block), F.greatest(F.lit(MANY), of_size(most))) if most else of_size(block)
    counts = lambda df, n, over=0: df.groupBy("_key").count().where(F.col("count") > over).select("_key", blocks.alias(n))
    seen = ["_key", "_i", "_j", *seen]
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}{s}") for c in seen]).repartition(parts, f"_key{s}", f"_i{s}", f"_j{s}")
    placed = lambda n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    small = lambda df: F.broadcast(df) if df.count() <= FEW else df
    # a fixed number of parts: few rows with much work must not be coalesced
    if others is None:
        rows = rows.join(small(cut(counts(rows, "_n", 1))), "_key").withColumn("_b", placed("_n"))
        left = side(rows.withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence(F.col("_b"), F.col("_n") - 1))), "a")
        right = side(rows.withColumn("_j", F.col("_b")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b")))), "b")
    else:
        n = small(cut(counts(rows, "_n").join(counts(others, "_m"), "_key")))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = side(rows.join(n, "_key").withColumn("_i", placed("_n")).withColumn("_j", every("_m")), "a")
        right = side(others.join(n, "_key").withColumn("_j", placed("_m")).withColumn("_i", every("_n")), "b")
    self = others is None
    columns = [c.split(" ")[0] for c in out.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            a, b = a.set_axis(seen, axis=1), b.set_axis(seen, axis=1)
            same = self and int(a["_i"].iloc[0]) == int(a["_j"].iloc[0])
            found = list(look(a, a if same else b, same))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in columns}, dtype=object)

    return left.groupBy("_keya", "_ia", "_ja").cogroup(right.groupBy("_keyb", "_ib", "_jb")).applyInPandas(run, out)


def _near_names(rows: DataFrame, of: str, least: float, low: float | None = None, block: int = NAMES, others: DataFrame | None = None) -> DataFrame:
    """(x, y): the values of `of` of two rows (of, _key, and those of _told) of one _key that alike.near finds, in either order, each two rows meeting once in blocks; with `others`, of a row and one of those."""

    def look(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        for i, j in alike.near(a, b, same, least, low):
            yield pd.DataFrame({"x": a["_of"].to_numpy()[i], "y": b["_of"].to_numpy()[j]})

    rows, others = (df if df is None else df.withColumn("_of", F.col(of)) for df in (rows, others))
    return in_blocks(rows, "_of", ["_of", "name", "words", "id", "digits", "text", "runs"], look, "x string, y string", block, others)


def gated_pairs(bucketed: DataFrame, keys: tuple[str, ...] = ("bucket", "sub"), block: int = NAMES, but: Column | None = None) -> DataFrame:
    """(path_a, path_b), path_a < path_b: of the pairs within a bucket those that the file-name gate can let through, and those of equal names. Files without a name pair with none.

    Pairs of two files for which `but` holds are left out.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    rows = bucketed.where("path is not null and name is not null").withColumn("_key", key)
    told = lambda df: _told(df, "path", "_key")
    near = lambda df, others=None: _near_names(df, "path", comparators.READ_ALIKE, GATE, block, others)
    if but is None:
        met = near(told(rows))
    else:
        few = told(rows.where(~but))
        met = near(few).unionByName(near(few, told(rows.where(but))))
    return met.select(F.least("x", "y").alias("path_a"), F.greatest("x", "y").alias("path_b"))


#: Files that weighed.within_reach compares with as many others.
CONTENTS = 2_048


def _fit(field: str, rotated: bool) -> Column:
    """Whether weighed.within_reach measures this content, and knows what else is told of the file: there, nan is unknown."""
    c = F.col(field)
    real = F.lit(True)
    for n in ("duration", "exif_datetime", "exif_gps_lat", "exif_gps_lon"):
        real = real & ~F.coalesce(F.isnan(n), F.lit(False))
    size = F.size(c) > 0 if field == "audio_fingerprint" else (F.size(c) >= 4) if rotated else F.size(c) == 4
    return c.isNotNull() & size & ~F.exists(c, lambda x: x.isNull()) & real


def weighed_pairs(bucketed: DataFrame, aspect: str, field: str, weights: dict[str, float], threshold: float, rotated: bool, block: int = CONTENTS) -> tuple[DataFrame, DataFrame]:
    """Of the pairs within a bucket (`cell`) that both have `field`: weighed.OUT of those that reach the threshold, and (path_a, path_b) of all that can't be measured here."""
    exif = [F.col(c) for c in ("exif_width", "exif_height", "width", "height")]
    # as comparators.exif has it: known if all four are, alike if both are true to their pictures
    frame = F.when(exif[0].isNotNull() & exif[1].isNotNull() & exif[2].isNotNull() & exif[3].isNotNull(), F.when((exif[0] == exif[2]) & (exif[1] == exif[3]), F.concat_ws("x", exif[0], exif[1])).otherwise(F.concat(F.lit("not "), F.col("path"))))
    plain = F.filter(F.split("name", " "), comparators.plain_word)
    made = _seen(F.col("name")) | {"plain": plain, "pixels": F.col("width").cast("double") * F.col("height"), "exif_size": frame, "measured": F.col(field)}
    rows = bucketed.where(F.col(field).isNotNull() & F.col("path").isNotNull())
    rows = rows.select(F.col("cell").alias("_key"), *[made.get(c, F.col(c)).alias(c) for c in weighed.SEEN], _fit(field, rotated).alias("fit"))

    def look(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        yield from weighed.within_reach(a, b, same, weights, threshold, aspect, comparators.READ_ALIKE)

    def cross(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        yield a[["path"]].merge(b[["path"]], how="cross", suffixes=("_a", "_b"))

    measured = in_blocks(rows.where("fit"), "path", weighed.SEEN, look, weighed.OUT, block, most=2 * block)
    rest = in_blocks(rows.where("not fit").select("_key", "path"), "path", ["path"], cross, "path_a string, path_b string", block, rows.select("_key", "path"))
    return measured, rest.where("path_a <> path_b").select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"))


def similar_names(files: DataFrame, least: float = 0.8) -> DataFrame:
    """(path_a, path_b): pairs whose sorted words are alike by `least`, from all files (path, name); names that exclude each other are left out.

    Equal names are compared once, all distinct ones with all others, in blocks (alike.near), so nothing is lost.
    """
    own = files.select("path", "name", names.sorted_tokens(F.col("name")).alias("words")).where("words <> ''")
    distinct = cut(own.select("name").distinct())
    near = _near_names(_told(distinct.withColumn("_key", F.lit("")), "_key"), "name", least)
    near = near.unionByName(distinct.select(F.col("name").alias("x"), F.col("name").alias("y")))
    left, right = own.select(F.col("path").alias("p"), F.col("name").alias("x")), own.select(F.col("path").alias("q"), F.col("name").alias("y"))
    pairs = near.join(left, "x").join(right, "y").where("p <> q and (x <> y or p < q)").select("p", "q", F.struct(F.col("x").alias("name")).alias("a"), F.struct(F.col("y").alias("name")).alias("b"))
    return pairs.where(~comparators.filename_exclusion()).select(F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b")).distinct()


def candidates(*passes: DataFrame) -> DataFrame:
    """The union of several passes, each pair once."""
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path_a", "path_b"])


def attach(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(path_a, path_b, a struct, b struct): the files' attributes, joined late."""
    side = lambda s: files.select(F.col("path").alias(f"path_{s}"), F.struct(*files.columns).alias(s))
    return pairs.join(side("a"), "path_a").join(side("b"), "path_b")


CHEAP = {"duration": comparators.duration, "resolution": comparators.resolution, "file_size": comparators.file_size, "page_count": comparators.page_count, "exif": comparators.exif, "directory": comparators.directory}
COSTLY = {"tags": comparators.tags, "doc_meta": comparators.document}


def score_pairs(pairs: DataFrame, weights: dict[str, float], threshold: float = 50.0, extra: dict[str, Column] | None = None) -> DataFrame:
    """(path_a, path_b, total double, score double, identical boolean, breakdown map<string,double>, detail map<string,struct<raw,weight>> of what is known) of pairs with structs a and b.

    Unknown aspects add nothing and give no weight to others. Equal normalized names of equal size are 100. Pairs of
    equal size, equal hash of the first block and equal SHA-256 (a field of a and b; without it none is claimed) are
    byte-identical: 100, with that alone as breakdown. Other pairs need a file-name value of 0.6, unless `extra` (Columns by name, for content and audio) has a value, and a
    total of `threshold` before rounding. What built-in expressions can tell rejects pairs before the costly ratios run.
    """
    extra = extra or {}
    own = {k: (extra[k] if k in extra else CHEAP[k]()) for k in weights if k in CHEAP or k in extra}
    size = F.col("a.file_size")
    same_size = (size == F.col("b.file_size")) & (size > 0)
    identical = F.coalesce((F.col("a.name") == F.col("b.name")) & same_size, F.lit(False))
    told = "sha256" in pairs.schema["a"].dataType.names
    bytes_equal = F.coalesce(~identical & same_size & (F.col("a.pre_hash") == F.col("b.pre_hash")) & (F.col("a.sha256") == F.col("b.sha256")), F.lit(False)) if told else F.lit(False)
    step = pairs.select("path_a", "path_b", "a", "b", identical.alias("identical"), bytes_equal.alias("bytes_equal"), *[c.alias(f"raw_{k}") for k, c in own.items()])
    sure = sum((F.coalesce(F.col(f"raw_{k}") * weights[k], F.lit(0.0)) for k in own), F.lit(0.0))
    open_weight = sum(w for k, w in weights.items() if k not in own)
    step = step.where(F.col("identical") | F.col("bytes_equal") | (sure + open_weight >= threshold))
    words = [names.sorted_tokens(F.col(f"{s}.name")) for s in "ab"]
    late = {k: COSTLY[k]().alias(f"raw_{k}") for k in weights if k in COSTLY}
    step = step.withColumn("_r", F.when(F.col("a.name").isNotNull() & F.col("b.name").isNotNull(), names.ratio(*words)))
    step = step.withColumn("raw_filename", comparators.filename(F.col("_r")))
    has_content = F.lit(False)
    for k in extra:
        has_content = has_content | F.col(f"raw_{k}").isNotNull()
    if weights.get("filename", 0) > 0:
        step = step.where(F.col("identical") | F.col("bytes_equal") | has_content | (F.col("raw_filename") >= GATE))
    return _totalled(step.select("*", *late.values()), weights, threshold)


def _totalled(step: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """What score_pairs yields, of pairs whose aspects have their values (raw_*, identical, bytes_equal)."""
    total = sum((F.coalesce(F.col(f"raw_{k}") * float(w), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    total = F.when(F.col("identical") | F.col("bytes_equal"), 100.0).otherwise(total)
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.round(F.col(f"raw_{k}") * float(w), 1) for k, w in weights.items()]))
    breakdown = F.when(F.col("bytes_equal"), F.create_map(F.lit("byte_identical"), F.lit(100.0))).otherwise(full)
    pairs_of = F.array(*[F.struct(F.lit(k).alias("key"), F.struct(F.col(f"raw_{k}").alias("raw"), F.lit(float(w)).alias("weight")).alias("value")) for k, w in weights.items()])
    detail = F.map_from_entries(F.filter(pairs_of, lambda e: e["value"]["raw"].isNotNull()))
    detail = F.when(F.col("bytes_equal"), F.create_map(F.lit("byte_identical"), F.struct(F.lit(1.0).alias("raw"), F.lit(100.0).alias("weight")))).otherwise(detail)
    out = step.select("path_a", "path_b", total.alias("total"), "identical", breakdown.alias("breakdown"), detail.alias("detail"))
    return out.where(F.col("total") >= threshold).withColumn("score", F.round("total", 1))


def content_pairs(hashes: DataFrame, least: float = 0.95) -> DataFrame:
    """(path_a, path_b): all pairs of files (path, content_hash array<long>, whole hashes of 4 longs) with two hashes alike by `least` or more, however they are named.

    Hashes that differ in at most r of 256 bits agree in one of r + 1 blocks of bits, so the join on blocks loses none; the
    higher `least`, the longer and more selective the blocks. Equal hashes are compared once.

    No side is broadcast: Spark's estimate knows nothing of the length of arrays, nor of the rows explode makes of each.
    """
    frames = hashes.where("path is not null and size(content_hash) >= 4").select("path", F.explode(F.transform(F.sequence(F.lit(0), (F.size("content_hash") / 4).cast("int") - 1), lambda k: F.slice("content_hash", k * 4 + 1, F.lit(4)))).alias("h")).distinct()
    distinct = frames.select("h").distinct()
    n = math.floor((1 - least) * 256 + 1e-9) + 1
    bits = F.concat(*[F.lpad(F.bin(F.get("h", k)), 64, "0") for k in range(4)])
    cuts = [round(256 * k / n) for k in range(n + 1)]
    keys = distinct.select("h", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring(bits, a + 1, b - a)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    wrong = F.aggregate(F.zip_with(F.col("a.h"), F.col("b.h"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    met = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.h") <= F.col("b.h")) & (wrong < n)).select(F.col("a.h").alias("x"), F.col("b.h").alias("y")).distinct()
    left, right = frames.select(F.col("path").alias("p"), F.col("h").alias("x")), frames.select(F.col("path").alias("q"), F.col("h").alias("y"))
    return met.join(left.hint("merge"), "x").join(right.hint("merge"), "y").where("p <> q").select(F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b")).distinct()


def content_comparator(rotated: bool = False) -> Column:
    """How alike the contents of structs a and b are, by the first of these that both have: SimHash of a document, vectors of frames, perceptual hashes; null where they share none."""
    both = lambda f: (F.col(f"a.{f}"), F.col(f"b.{f}"))
    hashes = fingerprints.rotated_similarity(*both("content_hash")) if rotated else fingerprints.hash_similarity(*both("content_hash"))
    known = lambda f: F.col(f"a.{f}").isNotNull() & F.col(f"b.{f}").isNotNull()
    return F.when(known("simhash"), fingerprints.simhash_similarity(*both("simhash"))).when(known("clip_embedding"), fingerprints.frames_cosine(*both("clip_embedding"))).when(known("content_hash"), hashes)


CONTENT = "path string, content_hash array<bigint>, clip_embedding array<float>, simhash bigint, audio_fingerprint array<bigint>"


def with_content(files: DataFrame, content: DataFrame | None) -> DataFrame:
    """`files` with the columns of CONTENT from `content` (path and any of them); those it lacks are null."""
    if content is None:
        return files
    kinds = dict(c.split(" ", 1) for c in CONTENT.split(", "))
    shown = [F.col(c) if c in content.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    return files.join(content.select(*shown), "path", "left")


def find_duplicates(
    files: DataFrame, mode: str, threshold: float = 50.0, weights: dict[str, float] | None = None, pair_limit: int | None = None, cross_names: bool = True,
    content: DataFrame | None = None, sha256: DataFrame | None = None, rotated: bool = False, least_content: float = 0.95, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Scored pairs of one mode (video, image, audio, document): pairs within a bucket, across buckets those with similar names, and those of similar content.

    pair_limit splits buckets of more pairs by resolution and size, which loses pairs; by default none is. `content` (path,
    content_hash, clip_embedding, simhash, audio_fingerprint; one row a path) adds the comparators content and audio and the
    pass over hashes alike by `least_content`; `weights` defaults to the mode's profile with them. `sha256` (path, sha256)
    tells byte-identical files. `extra` adds comparators of one's own, Columns over structs a and b.
    """
    own = with_content(prepared(latest(files.where(names.media_type(F.col("path")) == mode))), content)
    if sha256 is not None:
        own = own.join(sha256.select("path", "sha256"), "path", "left")
    own = cut(own)  # buckets, names, contents and the joins of pairs all start from it
    extra, ours, kinds = dict(extra or {}), set(), [c.split(" ")[0] for c in CONTENT.split(", ")[1:]]
    profile = mode
    if content is not None:
        if "audio_fingerprint" in content.columns:
            extra["audio"] = fingerprints.audio_similarity(F.col("a.audio_fingerprint"), F.col("b.audio_fingerprint"))
            ours.add("audio")
            profile = {"video": "video+audio", "audio": "audio+fp"}.get(mode, mode)
        if set(content.columns) & {"content_hash", "clip_embedding", "simhash"}:
            extra["content"] = content_comparator(rotated)
            ours.add("content")
            profile += "+content"
    weights = weights or WEIGHTS[profile]
    extra = {k: c for k, c in extra.items() if k in weights}
    if mode == "image":
        bucketed = own.withColumn("bucket", blocking.resolution_tier(F.col("width").cast("long") * F.col("height")))
        bucketed = blocking.refined_buckets(bucketed, pair_limit)
    else:
        bucketed = blocking.refined_buckets(blocking.anchored_buckets(own, "page_count" if mode == "document" else "duration"), pair_limit)
    # the gate drops what it can't let through before the pairs are made, unless content or bytes may stand in for the name;
    # where that is one content which is measured in blocks, it decides there
    own_only = weights.get("filename", 0) > 0 and sha256 is None
    one = next(((k, f) for k, f in (("content", "content_hash"), ("audio", "audio_fingerprint")) if content is not None and set(extra) == {k} and k in ours and set(content.columns) & set(kinds) == {f}), None)
    measured = one if own_only and min(weights.values()) >= 0 else None
    gated = own_only and (not extra or measured)
    if measured:  # read for the gate, the blocks and the rest, on both sides
        bucketed = cut(bucketed.withColumn("cell", F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in ("bucket", "sub")])))
    pairs = (gated_pairs(bucketed, but=F.coalesce(_fit(measured[1], rotated), F.lit(False)) if measured else None)) if gated else bucket_pairs(bucketed)
    if measured:
        met, rest = weighed_pairs(bucketed, *measured, weights, threshold, rotated)
        pairs = candidates(pairs, rest)
    if cross_names:
        pairs = candidates(pairs, similar_names(own.select("path", "name")))
    if "content" in extra:
        pairs = candidates(pairs, content_pairs(own.select("path", "content_hash"), least_content))
    if not measured:
        return score_pairs(attach(pairs, own), weights, threshold, extra)
    cells = bucketed.where(_fit(measured[1], rotated)).select("path", "cell")
    others = attach(pairs, own.join(cells, "path", "left")).where(F.coalesce(F.col("a.cell") != F.col("b.cell"), F.lit(True)))
    if set(weights) <= {*weighed.VALUED, measured[0]}:
        raw = {k: F.col("value" if k == measured[0] else f"raw_{k}") for k in weights}
        known = _totalled(met.select("path_a", "path_b", "identical", F.lit(False).alias("bytes_equal"), *[F.when(~F.isnan(c), c).alias(f"raw_{k}") for k, c in raw.items()]), weights, threshold)
    else:
        known = score_pairs(attach(met.select("path_a", "path_b", "value"), own.drop(measured[1])), weights, threshold, {measured[0]: F.col("value")})  # measured, so nothing large is carried along
    return known.unionByName(score_pairs(others, weights, threshold, extra))
