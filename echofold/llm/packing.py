"""Filling fixed-capacity containers with items of varying length.

Only the histogram of lengths (at most `capacity` rows) reaches the driver. Shallow combinations of up to three coarse
lengths that fill a container exactly are enumerated; non-negative least squares tells how often to repeat each so that
the histogram is used up; the counts are rounded down and what remains is packed greedily, best fit first, into open and
new containers. The plan says which ranks of which length go where; items find their container by their rank.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.session import cut

#: Where the vocabulary lies on the driver unless the session's spark.echofold.tokenizer names another file; it is shipped with the job.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items of one length that are ranked together.
CHUNK = 50_000
# Fixed value: how that tokenizer's vocabulary cuts texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row of `documents` (doc_id, text); null and empty texts have 0."""
    spark = documents.sparkSession
    tokenizer = tokenizer or spark.conf.get("spark.echofold.tokenizer", TOKENIZER)
    spark.sparkContext.addFile(tokenizer)
    file = os.path.basename(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(SparkFiles.get(file)).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ b
    for _ in range(rounds):
        if free.all() or slope[~free].max() <= 1e-8 * max(1.0, np.abs(b).max()):
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 1e-12)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-12)).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                s = x
                break
        x = s
        slope = a.T @ (b - a @ x)
    return x


def combinations(bins: int) -> list[tuple[int, ...]]:
    """All ways to write `bins` as a sum of one to three coarse lengths, in descending order."""
    out: list[tuple[int, ...]] = [(bins,)]
    for i in range(bins - 1, 0, -1):
        if i >= bins - i > 0:
            out.append((i, bins - i))
        out += [(i, j, bins - i - j) for j in range(min(i, bins - i - 1), 0, -1) if j >= bins - i - j > 0]
    return out


def plan(histogram: dict[int, int], capacity: int, bins: int = 64) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(repeats, ((length, how often), ...)): containers that hold every item of the histogram (lengths 1..capacity), each at most full."""
    left = {k: n for k, n in histogram.items() if n > 0 and 0 < k <= capacity}
    step = capacity / bins
    coarse = defaultdict(list)
    for k in sorted(left, reverse=True):
        coarse[max(1, int(np.ceil(k / step - 1e-9)))].append(k)
    counts = np.array([sum(left[k] for k in coarse[b]) for b in range(1, bins + 1)], float)
    combos = [c for c in combinations(bins) if all(counts[b - 1] > 0 for b in c)]
    open_groups: list[tuple[int, int]] = []  # (free, number in `groups`), in order
    groups: list[list] = []  # [repeats, {length: times}]

    def add(free: int, repeats: int, what: dict[int, int]) -> None:
        groups.append([repeats, what])
        insort(open_groups, (free, len(groups) - 1))

    if combos:
        a = np.zeros((bins, len(combos)))
        for j, c in enumerate(combos):
            for b in c:
                a[b - 1, j] += 1
        weight = np.sqrt(np.arange(1, bins + 1))  # long items are harder to place later
        repeats = np.floor(nnls(a * weight[:, None], counts * weight) + 1e-9).astype(int)
        for j in np.argsort([-max(c) for c in combos], kind="stable"):
            times = repeats[j]
            while times > 0:  # the longest of the first bin with the shortest of the others, in runs of equal lengths
                pick = []
                for i, b in enumerate(combos[j]):
                    have = [k for k in coarse[b] if left.get(k, 0) > sum(p == k for p in pick)]
                    if not have:
                        break
                    pick.append(have[0] if i == 0 else have[-1])
                if len(pick) < len(combos[j]) or sum(pick) > capacity:
                    break
                what = {k: pick.count(k) for k in pick}
                run = int(min(times, *(left[k] // n for k, n in what.items())))
                for k, n in what.items():
                    left[k] -= run * n
                times -= run
                add(capacity - sum(pick), run, what)
    for k in sorted(left, reverse=True):  # best fit, longest first, whole groups of equal containers at a time
        n = left[k]
        while n > 0:
            at = bisect_left(open_groups, (k, -1))
            if at == len(open_groups):
                per = min(capacity // k, n)
                run = n // per
                add(capacity - per * k, run, {k: per})
                n -= run * per
                continue
            free, g = open_groups.pop(at)
            repeats, what = groups[g]
            per = min(free // k, max(1, n // repeats)) if n >= repeats else 1
            use = min(repeats, n // per)
            if use < repeats:
                add(free, repeats - use, dict(what))
            groups[g] = [use, what | {k: what.get(k, 0) + per}]
            insort(open_groups, (free - per * k, g))
            n -= use * per
    return [(int(r), tuple(sorted(w.items(), reverse=True))) for r, w in groups if r > 0]


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, container): every item of `items` (doc_id, n_tokens) in containers of `capacity`.

    An item longer than a container is split into full pieces and a rest; no other is split. Each row is an item of its
    own, also a repeated one; items without length (null, 0) need no container and get no row. Containers are numbered
    from 0; the plan depends on the histogram only, the order within a length on the ids.
    """
    spark = items.sparkSession
    whole = items.where("n_tokens > 0")
    starts = F.posexplode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity)))
    pieces = whole.select("doc_id", "n_tokens", starts.alias("piece", "start"))
    pieces = cut(pieces.select("doc_id", "piece", "start", F.least(F.col("n_tokens") - F.col("start"), F.lit(capacity)).cast("int").alias("length")))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table, base, used = [], 0, defaultdict(int)
    for repeats, what in plan(counts, capacity):
        for length, times in what:
            table.append((length, used[length], times, base))
            used[length] += repeats * times
        base += repeats
    lengths, first, times, bases = (np.array(x, np.int64) for x in zip(*sorted(table), strict=True)) if table else (np.zeros(0, np.int64),) * 4
    # places of all lengths on one line: items of a length follow each other
    line = dict(zip(sorted(counts), np.cumsum([0, *[counts[k] for k in sorted(counts)]])[:-1].tolist(), strict=True)) if counts else {}
    at = np.array([line[k] for k in lengths.tolist()], np.int64) + first if len(lengths) else first
    shared = spark.sparkContext.broadcast((at, times, bases, line))
    chunks = spark.createDataFrame([(k, max(1, n // CHUNK)) for k, n in counts.items()], "length int, chunks int")  # a row a length
    own = pieces.join(F.broadcast(chunks), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.col("chunks"))).drop("chunks")
    before = own.groupBy("length", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece")) - 1).join(before, ["length", "chunk"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, times, bases, line = shared.value
        for batch in batches:
            where = batch["length"].map(line).to_numpy(np.int64) + batch["rank"].to_numpy(np.int64)
            i = np.searchsorted(at, where, "right") - 1
            yield batch.assign(container=bases[i] + (where - at[i]) // times[i])[["doc_id", "piece", "start", "length", "container"]]

    ranked = ranked.select("doc_id", "piece", F.col("start").cast("long").alias("start"), "length", (F.col("k") + F.coalesce("before", F.lit(0))).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length int, container long")
