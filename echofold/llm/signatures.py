"""Bit signatures of arrays of longs: their units of 256 bits, band keys, and exact comparison.

An array (perceptual hashes of 4 longs each, or 32-bit words of an audio fingerprint) is read as units of 256 bits. Band
keys are the values of a few bit positions drawn by hashing, the minwise keys of bit vectors: two units share a key with
their share of equal bits to the power of the key's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 256


@dataclass(frozen=True)
class Shape:
    """How an array becomes units. word: bits of a value that count; step: values from one unit to the next; stride: every how many units a row is known by."""

    word: int
    step: int
    stride: int

    @property
    def values(self) -> int:
        return UNIT // self.word


# of overlapping windows every fourth is enough on one side, as the other side has them all
HASHES, PRINTS = Shape(64, 4, 1), Shape(32, 1, 4)
#: Bits of `flags` of a unit: its row holds orientations; it is the row's first; it is the row's only one.
ROTATED, FIRST, ONLY = 1, 2, 4


def band_bits(bands: int, bits: int, seed: int = 20_24) -> np.ndarray:
    """(bands, bits) positions in a unit, drawn without replacement per band; the first `bands` rows are the same for every number of bands."""
    return np.stack([np.random.default_rng([seed, b]).choice(UNIT, bits, replace=False) for b in range(bands)])


def key_bits(units: int, each: int) -> int:
    """Bits of a key so that the buckets of unrelated units hold about `each` at any number of units."""
    return min(UNIT // 4, max(0, math.ceil(math.log2(max(units, 1) / each))))


def bands_for(bits: int, tries: float, similarity: float = 0.84, recall: float = 0.985) -> int:
    """Bands so that a pair of this similarity, met by `tries` units, shares a key with probability `recall`."""
    if not bits:
        return 1
    p = similarity**bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p) / tries))


def _unit_bits(values: np.ndarray, shape: Shape) -> np.ndarray:
    """The 0/1 matrix of a row's units. A unit shorter than 256 bits does not occur: short arrays are repeated to its length."""
    if shape.word == 64:
        return np.unpackbits(values.astype("<i8").view(np.uint8)).reshape(-1, UNIT)
    words = np.unpackbits((values & 0xFFFFFFFF).astype("<u4").view(np.uint8)).reshape(-1, 32)
    n = shape.values
    if len(words) < n:
        words = np.tile(words, (-(-n // len(words)), 1))[:n]
    return np.lib.stride_tricks.sliding_window_view(words, (n, 32))[:, 0].reshape(-1, UNIT)


def similarity(a: np.ndarray, b: np.ndarray, shape: Shape, rotated: bool = False) -> float:
    """Share of equal bits at the best position of the shorter array inside the longer; of rotated hashes, of the first of one and any of the other. 0 for empty arrays."""
    if shape.word == 64:
        x, y = (z.astype("<i8").view("<u8").reshape(-1, 4) for z in (a, b))
    else:
        x, y = ((z & 0xFFFFFFFF).astype("<u4").reshape(-1, 1) for z in (a, b))
    if not len(x) or not len(y):
        return 0.0
    total = x.shape[1] * (64 if shape.word == 64 else 32)
    if rotated:
        one = np.bitwise_count(x[:1] ^ y).sum(1, dtype=np.int64).min()
        two = np.bitwise_count(x ^ y[:1]).sum(1, dtype=np.int64).min()
        return 1 - min(one, two) / total
    d = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
    if len(x) > len(y):
        d = d.T
    k, m = d.shape
    return 1 - min(int(np.trace(d, offset=o)) for o in range(m - k + 1)) / (total * k)


def _keys(columns: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The numbers that the bits at `positions` make; columns: (256, n) of 0 and 1."""
    out = np.zeros(columns.shape[1], np.int64 if len(positions) > 16 else np.uint16)
    for k, p in enumerate(positions):
        out |= columns[p].astype(out.dtype) << out.dtype.type(k)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as one binary column, without a Python object a row."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """The byte matrix of a binary column whose values all have UNIT bits."""
    parts = []
    for c in column.chunks:
        if len(c):
            start = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[start : start + len(c) * UNIT // 8].reshape(-1, UNIT // 8))
    return np.concatenate(parts) if parts else np.zeros((0, UNIT // 8), np.uint8)


def units_of(rows: DataFrame, shape: Shape, bits: int, bands: int, stride: int = 1, only_first: bool = False, signature: bool = True) -> DataFrame:
    """(bucket long, id long, flags int, unit binary): of rows (id, v array<long>, rotated boolean) every `stride`-th unit, or the first only, once for each band."""
    positions = band_bits(bands, bits)
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("flags", pa.int32())] + [("unit", pa.binary())] * signature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                part = whole.slice(at, 512).to_pandas()
                units = [_unit_bits(v, shape) for v in part["v"]]
                sizes = np.array([len(u) for u in units])
                units = [u[:1] if only_first else u[::stride] for u in units]
                n = np.array([len(u) for u in units])
                if not n.sum():
                    continue
                m = np.concatenate(units)
                ids, rotated = np.repeat(part["id"].to_numpy(), n), np.repeat(part["rotated"].to_numpy(bool), n)
                first = np.concatenate([np.arange(k) == 0 for k in n])
                flags = (rotated * ROTATED + first * FIRST + (np.repeat(sizes, n) == 1) * ONLY).astype(np.int32)
                columns, packed = np.ascontiguousarray(m.T), np.packbits(m, axis=1)
                for b in range(bands):
                    bucket = (b << bits) + _keys(columns, positions[b]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids), pa.array(flags)] + [_binary(packed)] * signature, schema=schema)

    return rows.select("id", "v", "rotated").mapInArrow(run, "bucket long, id long, flags int" + ", unit binary" * signature)


def meet(probes: pa.Table, known: pa.Table, most: int, tries: float = 1.0, settle=None, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of probes, row of known) of units with at most `most` differing bits and a smaller id on the known side.

    Keys finer than the bucket's lead to the pairs that are compared bit by bit, `at_once` of them or those of one probe at a
    time; a pair of rows has `tries` chances to meet. settle(i, j) tells which of the pairs found prove their probe's row; the units of a proven row are looked up no more.
    """
    p, x = _bytes(probes["unit"]), _bytes(known["unit"])
    pb, xb = (np.ascontiguousarray(np.unpackbits(z, axis=1).T) for z in (p, x))
    (p2, p1), (x2, x1) = ([np.ascontiguousarray(z.view(np.uint64)[:, h : h + 2]) for h in (0, 2)] for z in (p, x))
    pid, xid = probes["id"].to_numpy(), known["id"].to_numpy()
    bits = max(8, math.ceil(math.log2(max(len(x), 1))))  # about one unrelated unit a key
    left, right, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(p))
    for positions in band_bits(bands_for(bits, tries), bits, seed=77):
        xk, pk = _keys(xb, positions), _keys(pb, positions)[todo]
        order = np.argsort(xk, kind="stable")
        count = np.bincount(xk, minlength=1 << bits)
        lo, n = (np.cumsum(count) - count)[pk], count[pk]
        if not len(pk):
            break
        ends = np.cumsum(n)
        a, done = 0, []
        while a < len(pk):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once, "right")))
            m = n[a:b]
            i = np.repeat(todo[a:b], m)
            j = order[np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            ok = xid[j] < pid[i]
            i, j = i[ok], j[ok]
            half = np.bitwise_count(p2[i] ^ x2[j]).sum(1, dtype=np.int16)  # most pairs differ too much in half of the unit already
            i, j, half = (z[half <= most] for z in (i, j, half))
            near = half + np.bitwise_count(p1[i] ^ x1[j]).sum(1, dtype=np.int16) <= most
            i, j = i[near], j[near]
            left.append(i)
            right.append(j)
            if settle is not None and len(i):
                done.append(pid[i[settle(i, j)]])
            a = b
        if done:
            todo = todo[~np.isin(pid[todo], np.concatenate(done))]
    return np.concatenate(left), np.concatenate(right)


def verify(pairs: DataFrame, rows: DataFrame, shape: Shape, least: float) -> DataFrame:
    """(id, other) of pairs (id, other) whose contents in rows (id, v, rotated) are at least `least` alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = [similarity(a, b, shape, r or q) for a, b, r, q in zip(batch["v"], batch["w"], batch["rotated"], batch["r2"], strict=True)]
            yield batch.loc[np.array(s, float) >= least, ["id", "other"]] if len(batch) else batch[["id", "other"]]

    left = rows.select("id", "v", "rotated")
    right = rows.select(F.col("id").alias("other"), F.col("v").alias("w"), F.col("rotated").alias("r2"))
    return pairs.join(left, "id").join(right, "other").select("id", "v", "rotated", "other", "w", "r2").mapInPandas(run, "id long, other long")
