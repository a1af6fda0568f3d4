"""Fingerprints of texts, images, audio and vectors, and how alike two of them are; all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simhash64(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash long): the 64-bit SimHash of each row's word pairs; null for texts of fewer than two words.

    Words are split at blanks, pairs hashed by the first 8 bytes of their MD5 (big-endian), a bit is set where more
    pairs have it than not. A row's pairs are summed up in the task that made them, so one row of 64 sums is shuffled.
    """
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    rows = df.select(key, words.alias("_w")).withColumn("_row", F.monotonically_increasing_id())
    pairs = F.when(F.size("_w") >= 2, F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1))))
    hashed = rows.select("_row", key, F.explode_outer(pairs).alias("_g")).select("_row", key, F.conv(F.substring(F.md5("_g"), 1, 16), 16, -10).cast("long").alias("_h"))
    votes = hashed.groupBy("_row", key).agg(*[F.sum((F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(1)) * 2 - 1).cast("int")).alias(f"_{b}") for b in range(64)])
    value = None
    for b in range(64):
        bit = F.when(F.col(f"_{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
        value = bit if value is None else value.bitwiseOR(bit)
    return votes.select(key, F.when(F.col("_0").isNotNull(), value).alias("simhash"))


def simhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits; null where either is null."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _slide(a: Column, b: Column, width: int, bits: int) -> Column:
    """Share of equal bits of the shorter array of longs at its best place inside the longer, whole groups of `width` values at a time; 0 for empty arrays."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    offsets = F.sequence(F.lit(0), (F.size(long_) - F.size(short)).cast("int"), F.lit(width))
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    wrong = lambda o: F.aggregate(F.zip_with(short, F.slice(long_, o + 1, F.size(short)), lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(mask))), F.lit(0), lambda n, d: n + d)
    best = 1 - F.array_min(F.transform(offsets, wrong)) / (F.size(short) * F.lit(float(bits)))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(best)


def hash_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of 256-bit hashes (4 longs each)."""
    return _slide(a, b, 4, 64)


def rotated_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of hashes, one for each orientation: the first of either against any of the other."""
    one = lambda x, y: F.array_max(F.transform(F.sequence(F.lit(0), (F.size(y) / 4 - 1).cast("int")), lambda k: hash_similarity(F.slice(x, 1, 4), F.slice(y, k * 4 + 1, F.lit(4)))))
    return F.when((F.size(a) < 4) | (F.size(b) < 4), 0.0).otherwise(F.greatest(one(a, b), one(b, a)))


def audio_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of 32-bit values."""
    return _slide(a, b, 1, 32)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of floats, 0.0 to 1.0; null where either is null, of no length or of another size."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & (dot(a, a) > 0) & (dot(b, b) > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def frames_cosine(a: Column, b: Column, dims: int = 512) -> Column:
    """Of two arrays of one or more frames of `dims` floats: the mean cosine of the shorter one's frames at its best place in the longer, 0.0 to 1.0.

    Null where either is null or not of whole frames; frames without length are like nothing (0.0).
    """
    frames = lambda x: F.transform(F.sequence(F.lit(0), (F.size(x) / dims).cast("int") - 1), lambda k: F.slice(x, k * dims + 1, F.lit(dims)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    near = lambda x, y: F.coalesce(dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0)), F.lit(0.0))
    swap = F.size(a) <= F.size(b)
    short, long_ = frames(F.when(swap, a).otherwise(b)), frames(F.when(swap, b).otherwise(a))
    offsets = F.sequence(F.lit(0), F.size(long_) - F.size(short))
    mean = lambda o: F.aggregate(F.zip_with(short, F.slice(long_, o + 1, F.size(short)), near), F.lit(0.0), lambda s, v: s + v) / F.size(short)
    whole = (F.size(a) >= dims) & (F.size(b) >= dims) & (F.size(a) % dims == 0) & (F.size(b) % dims == 0)
    return F.when(whole, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_max(F.transform(offsets, mean)))))


def tfidf_cosine(pairs: DataFrame, weights: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(a, b, cosine) of pairs of keys whose texts tfidf() has weighted; 0.0 where they share no term, no row where either has no weights."""
    sides = pairs.select(a, b).distinct()
    known = weights.select(key).distinct()
    sides = sides.join(known.withColumnRenamed(key, a), a, "left_semi").join(known.withColumnRenamed(key, b), b, "left_semi")
    x, y = weights.select(F.col(key).alias(a), "term", F.col("weight").alias("_x")), weights.select(F.col(key).alias(b), "term", F.col("weight").alias("_y"))
    shared = sides.join(x, a).join(y, [b, "term"]).groupBy(a, b).agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))
    return sides.join(shared, [a, b], "left").select(a, b, F.coalesce(F.least("cosine", F.lit(1.0)), F.lit(0.0)).alias("cosine"))


def pre_hash(content: Column) -> Column:
    """MD5 of the first 4 KiB."""
    return F.md5(F.substring(content, 1, 4096))


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): rows of length 1 with smooth inverse document frequencies, ln((1 + n) / (1 + df)) + 1.

    Terms are runs of two or more letters, digits or underscores in lower case; texts without one have no rows.
    """
    words = df.where(F.col(text).isNotNull()).select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = df.where(F.col(text).isNotNull()).agg(F.count("*").alias("n"))  # one row
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))
