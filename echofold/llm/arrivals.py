"""Deduplicating new batches against all history.

Bit signatures (perceptual hashes, audio fingerprints) go through a persisted `store.BucketStore`: minwise band keys with
signatures, in folders by key. History is stored first; what has arrived since then probes only the folders of its own
buckets, is verified bit by bit and on the whole arrays, and stored in its turn. History is never keyed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.signatures import HASHES, PRINTS, Shape
from echofold.llm.store import BucketStore
from echofold.session import shared_folder


def usable(rows: DataFrame, values: str, shape: Shape) -> DataFrame:
    """(id, new, v, rotated) of the rows that can match: an array with a null in it, or of hashes with an unfinished last hash, is cut before it."""
    rotated = F.coalesce(F.col("rotation_invariant"), F.lit(False)) if "rotation_invariant" in rows.columns else F.lit(False)
    v = F.col(values)
    hole = F.coalesce(F.array_position(F.transform(v, lambda x: x.isNull()), True), F.lit(0))
    whole = F.when(hole > 0, F.slice(v, 1, F.greatest(hole - 1, F.lit(0)).cast("int"))).otherwise(v)
    if shape.word == 64:
        whole = F.slice(whole, 1, (F.size(whole) - F.size(whole) % 4).cast("int"))
    own = rows.where(F.col("entry_id").isNotNull() & v.isNotNull())
    return own.select(F.col("entry_id").alias("id"), (F.coalesce(F.col("batch_no"), F.lit(0)) >= 1).alias("new"), whole.alias("v"), rotated.alias("rotated")).where(F.size("v") > 0)


def repeats(rows: DataFrame, values: str, shape: Shape, least: float = 0.8, folder: str | None = None) -> DataFrame:
    """(id long): the entry_id of each row with batch_no >= 1 that repeats a row of smaller entry_id, whatever that row's batch.

    `rows` has entry_id, batch_no, the array `values` and maybe rotation_invariant. Null and empty arrays and rows
    without an id match nothing. Similarity is signatures.similarity; equal contents are found by their digest, others by
    band keys (signatures.bands_for tells the probability). Batch 0 is stored in `folder` (one of its own in the shared
    folder if none is given), the batches after it have piled up and are added together; BucketStore.add takes them one by
    one as well. Empty tables give no rows.
    """
    table = usable(rows, values, shape)
    units = F.size("v") / 4 if shape.word == 64 else F.greatest(F.size("v") - (shape.values - 1), F.lit(1))
    n, shortest = table.agg(F.coalesce(F.sum(units), F.lit(0.0)), F.coalesce(F.min(units), F.lit(1.0))).first()
    spark = rows.sparkSession
    store = BucketStore(spark, folder or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", shape, int(n), int(shortest), least)
    store.append(table.where("not new"), 0)
    return store.add(table.where("new"), 1)


def repeated_pairs(scored: DataFrame) -> DataFrame:
    """(id long): the entry_id of each row of scored_pairs with batch_no >= 1 whose two files (in either order, each with its mtime) and configuration an earlier row has.

    Configurations compare without case and surrounding blanks. Rows without either path or an id match nothing; an
    unknown mtime or configuration (null) equals another unknown one.
    """
    side = lambda s: F.struct(F.col(f"path_{s}").alias("p"), F.coalesce(F.col(f"mtime_{s}"), F.lit(float("-inf"))).alias("t"))
    config = F.regexp_replace(F.lower(F.col("config_hash")), r"^\s+|\s+$", "")
    rows = scored.where("entry_id is not null and path_a is not null and path_b is not null").select(F.col("entry_id").alias("id"), "batch_no", F.least(side("a"), side("b")).alias("x"), F.greatest(side("a"), side("b")).alias("y"), F.coalesce(config, F.lit("")).alias("config"))
    key = F.sha2(F.to_json(F.struct("x", "y", "config")), 256)
    firsts = rows.groupBy(F.unhex(key).alias("key")).agg(F.min("id").alias("id")).select("id")
    return rows.where("batch_no >= 1").select("id").join(firsts, "id", "left_anti").distinct()


def found(hashes: DataFrame, prints: DataFrame, scored: DataFrame) -> DataFrame:
    """(table_name, entry_id): the rows of later batches that bring nothing new, of the three cached tables."""
    parts = (
        ("content_hashes", repeats(hashes, "hashes", HASHES)),
        ("audio_fingerprints", repeats(prints, "fingerprint", PRINTS)),
        ("scored_pairs", repeated_pairs(scored)),
    )
    out = [ids.select(F.lit(name).alias("table_name"), F.col("id").alias("entry_id")) for name, ids in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
