"""A store of all rows that have arrived, for `arrivals`: their contents, and their units partitioned by band key.

Under one folder each batch has its own numbered part of three tables: `rows` (distinct contents with a digest), `leads`
(fine keys of first units) and `units` (signatures once for each band, in folders by bucket). A batch is written in place of
what an earlier attempt left under its number, and only batches with smaller numbers, and itself, are ever read for it: a
crash between two writes or a repeated attempt neither loses nor doubles rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import signatures
from echofold.llm.signatures import FIRST, ONLY, ROTATED, UNIT
from echofold.session import cut

#: Units a bucket (or a block of a crowded one) is meant to hold.
BUCKET_UNITS = 64_000
#: Crowded buckets up to this number (16 bytes each) are broadcast; more are joined.
BROADCAST_BUCKETS = 100_000
_TABLES = {
    "rows": "id bigint, v array<bigint>, rotated boolean, digest binary",
    "leads": "bucket bigint, id bigint",
    "units": "bucket bigint, id bigint, flags int, unit binary, part int",
}


class BucketStore:
    """`units` is the number of units the store is made for, `shortest` the units that the shortest row has, `each` those a bucket is to hold.

    They fix the keys, so a store must be opened as it was made. A batch reads only the folders of its own buckets: with
    small `each` (finer keys, more bands, more copies of a signature) a small batch reads less of the store.
    """

    def __init__(self, spark: SparkSession, folder: str, shape: signatures.Shape, units: int = 1_000_000, shortest: int = 1, least: float = 0.8, each: int | None = None, most_parts: int = 4096):
        self.spark, self.folder, self.shape, self.least, self.each = spark, folder.rstrip("/"), shape, least, each or BUCKET_UNITS
        self.bits = signatures.key_bits(-(-units // shape.stride), self.each)
        self.tries = max(1, shortest // shape.stride)
        self.bands = signatures.bands_for(self.bits, self.tries)
        self.parts = min(self.bands << self.bits, most_parts)
        self.numbers: list[int] = []

    def _write(self, df: DataFrame, name: str, number: int, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.folder}/{name}/batch={number}")
        if number not in self.numbers:
            self.numbers.append(number)

    def _read(self, name: str, numbers: list[int]) -> DataFrame:
        """The table's rows of these batches; an unwritten one is an error, not an empty table."""
        if not numbers:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).option("basePath", self.folder).parquet(*[f"{self.folder}/{name}/batch={n}" for n in numbers])

    def open(self, numbers: list[int]) -> BucketStore:
        """The store with the batches that earlier runs have completed."""
        self.numbers = sorted(set(numbers))
        return self

    def append(self, batch: DataFrame, number: int) -> None:
        """Stores the batch (id long, v array<long>, rotated boolean) under its number: one row for each distinct content, the smallest id's."""
        usable = batch.where("id is not null and size(v) > 0").select("id", "v", F.coalesce("rotated", F.lit(False)).alias("rotated"))
        digest = F.unhex(F.md5(F.concat_ws(",", F.col("v").cast("array<string>"), F.array(F.col("rotated").cast("string")))))
        firsts = usable.groupBy(digest.alias("digest")).agg(F.min(F.struct("id", "v", "rotated")).alias("r")).select("r.id", "r.v", "r.rotated", "digest")
        self._write(firsts, "rows", number)
        rows = self._read("rows", [number])
        self._write(signatures.units_of(rows, self.shape, 20, 2, only_first=True, signature=False).select("bucket", "id"), "leads", number)
        units = signatures.units_of(rows, self.shape, self.bits, self.bands, self.shape.stride).withColumn("part", F.pmod("bucket", F.lit(self.parts)).cast("int"))
        if rows.rdd.getNumPartitions() * self.parts > 100_000:  # else as many files as tasks times folders
            units = units.repartition(F.col("part"), F.pmod(F.xxhash64("id"), F.lit(8)))
        self._write(units, "units", number, "part")

    def touched(self, asking: DataFrame) -> list[int]:
        """The folders that hold the buckets of the units `asking`, at most `parts`."""
        return sorted(r["p"] for r in asking.select(F.pmod("bucket", F.lit(self.parts)).cast("int").alias("p")).distinct().collect())

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """(id): the rows of `batch` (id long, v array<long>, rotated boolean) that repeat a row of smaller id, of the batch or an earlier one; the batch is stored, all its rows count for later ones.

        Numbers grow from batch to batch. Rows with null or empty arrays repeat nothing and aren't stored; an empty batch
        changes nothing.
        """
        self.append(batch, number)
        numbers = [n for n in self.numbers if n <= number]
        rows = self._read("rows", numbers)
        own = self._read("rows", [number]).select("id", "digest")
        digest = F.unhex(F.md5(F.concat_ws(",", F.col("v").cast("array<string>"), F.array(F.coalesce("rotated", F.lit(False)).cast("string")))))
        seen = rows.groupBy("digest").agg(F.min("id").alias("first"))
        copies = cut(batch.where("id is not null and size(v) > 0").select("id", digest.alias("digest")).join(seen, "digest").where("id > first").select("id").distinct())
        fresh = own.join(copies, "id", "left_anti").select("id")
        # the first row of a fine key settles what is like it, so that copies of one thing never meet all pairs
        leads = self._read("leads", numbers).groupBy("bucket").agg(F.min("id").alias("other"))
        to_first = self._read("leads", [number]).join(leads, "bucket").where("id > other").select("id", "other").distinct()
        settled = cut(signatures.verify(to_first.join(fresh, "id", "left_semi"), rows, self.shape, self.least).select("id").distinct())
        asking = self._read("rows", [number]).join(fresh, "id", "left_semi").join(settled, "id", "left_anti")
        met = cut(self._met(signatures.units_of(asking, self.shape, self.bits, self.bands), numbers).distinct())
        proven = met.where("other is null").select("id").distinct()
        near = proven.unionByName(signatures.verify(met.where("other is not null").join(proven, "id", "left_anti"), rows, self.shape, self.least).select("id"))
        return copies.unionByName(settled).unionByName(near).distinct()

    def _met(self, asking: DataFrame, numbers: list[int]) -> DataFrame:
        """(id, other): of the units `asking`, the stored rows with a smaller id and a unit alike; other is null where the units alone prove the rows alike."""
        shape, each, tries = self.shape, self.each, max(1.0, self.tries / 2)  # windows of one row overlap
        if shape.word == 64:
            most = math.floor((1 - self.least) * UNIT + 1e-9)
        else:
            most = math.floor((1 - self.least + 0.06) * UNIT)  # of a pair's windows the best stored one can be a little below their mean
        known = self._read("units", numbers).where(F.col("part").isin(self.touched(asking))).drop("part")
        crowded = cut(known.groupBy("bucket").count().where(F.col("count") > 2 * each).select(F.col("bucket").alias("crowd"), F.ceil(F.col("count") / each).cast("int").alias("blocks")))
        n = crowded.count()
        left, right = asking.withColumn("p", F.lit(0)).withColumn("k", F.lit(0)), known.withColumn("p2", F.lit(0)).withColumn("k2", F.lit(0))
        if n:  # every block of askers with every block of the known, each a task of its own
            crowded = F.broadcast(crowded) if n <= BROADCAST_BUCKETS else crowded
            block = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.coalesce("blocks", F.lit(1))).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
            with_blocks = lambda df: df.join(crowded, F.col("bucket") == F.col("crowd"), "left")
            left = with_blocks(asking).select("bucket", "id", "flags", "unit", block(1).alias("p"), every.alias("k"))
            right = with_blocks(known).select("bucket", "id", "flags", "unit", every.alias("p2"), block(2).alias("k2"))
        right = right.select(F.col("bucket").alias("b2"), "p2", "k2", "id", "flags", "unit")
        schema = pa.schema([("id", pa.int64()), ("other", pa.int64())])

        def match(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return schema.empty_table()
            fa, fb, ids, others = a["flags"].to_numpy(), b["flags"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy()

            def proves(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                turned, first, only = (fa[i] | fb[j]) & ROTATED > 0, (fa[i] | fb[j]) & FIRST > 0, (fa[i] | fb[j]) & ONLY > 0
                return np.where(turned, first, only)

            if shape.word == 64:
                i, j = signatures.meet(a, b, most, settle=proves)
                proven, possible = proves(i, j), ((fa[i] | fb[j]) & (ROTATED | ONLY)) == 0
            else:
                i, j = signatures.meet(a, b, most, tries)
                proven, possible = np.zeros(len(i), bool), np.ones(len(i), bool)
            sure = np.unique(ids[i[proven]])
            possible &= ~np.isin(ids[i], sure)
            pairs = np.unique(np.stack([ids[i[possible]], others[j[possible]]], 1), axis=0)
            return pa.table([pa.array(np.concatenate([sure, pairs[:, 0]])), pa.concat_arrays([pa.nulls(len(sure), pa.int64()), pa.array(pairs[:, 1])])], schema=schema)

        return left.groupBy("bucket", "p", "k").cogroup(right.groupBy("b2", "p2", "k2")).applyInArrow(match, "id long, other long")
