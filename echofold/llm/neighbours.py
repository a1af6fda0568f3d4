"""Most similar vectors for every vector.

A hierarchical k-means tree is fitted on a bounded sample; every vector goes to its nearest leaf. Leaves that hold more than
a block are split further by subtrees fitted where their vectors are, level by level, so that leaves stay small however many
vectors there are; only a leaf that no split would tighten stays whole. As a vector is copied to each leaf that it visits,
large tables are gone through a share of the leaves at a time, so that copies of one share only lie on disk at once. A query walks the tree best bin first through a
priority queue and visits the leaves that a calibration against brute force found necessary; as a pair is looked at from both
sides, it is enough that one of the two visits the other's leaf. Whole leaves are cut into blocks, so that one with a third of
all vectors is spread over many tasks of bounded size, each a dense matrix product. Equal vectors are searched once and
expanded again at the end.
"""

from __future__ import annotations

import gc
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.session import cut


@dataclass
class Tree:
    """Nodes in order of creation; centres has unit rows; a node without children is a leaf."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)

    @property
    def leaves(self) -> list[int]:
        return [k for k, c in enumerate(self.children) if not c]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Labels of spherical k-means, seeded by k-means++."""
    centres, far = [x[rng.integers(len(x))]], None
    for _ in range(k - 1):
        d = np.maximum(1 - x @ centres[-1], 0)
        far = d if far is None else np.minimum(far, d)
        if far.sum() <= 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=far.astype(float) / far.astype(float).sum())])
    c, labels = np.stack(centres), None
    for _ in range(rounds):
        new = (x @ c.T).argmax(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        c = _unit(np.stack([x[labels == j].sum(0) if (labels == j).any() else c[j] for j in range(len(c))]))
    return labels


def _gain(x: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """Share of the distance to the centre that k-means on one half takes away on the other half."""
    mix = rng.permutation(len(x))
    fit, held = x[mix[::2]], x[mix[1::2]]
    labels = _kmeans(fit, max(2, k), rng)
    c = _unit(np.stack([fit[labels == j].mean(0) for j in np.unique(labels)]))
    before = float((1 - held @ _unit(fit.mean(0, keepdims=True))[0]).mean())
    return 1 - float((1 - (held @ c.T).max(1)).mean()) / max(before, 1e-9)


def fit_tree(sample: np.ndarray, branching: int = 16, least: int = 100, tight: float = 0.7, gain: float = 0.15, seed: int = 7) -> Tree:
    """A tree on the unit rows of `sample`.

    A node is split while it has `least` rows or more, unless it is tight (mean cosine to its centre of `tight` or more)
    and splitting takes less than `gain` of the distance of held-out rows away: a round cloud has no bins worth visiting separately.
    """
    rng = np.random.default_rng(seed)
    centres, children, todo = [_unit(sample.mean(0, keepdims=True))[0]], [[]], [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        x = sample[rows]
        spread = float((1 - x @ centres[node]).mean()) if len(rows) else 0.0
        if len(rows) < least or spread <= 1e-6:
            continue
        labels = _kmeans(x, min(branching, len(rows) // 4), rng)
        parts = [rows[labels == j] for j in np.unique(labels)]
        cs = [_unit(sample[p].mean(0, keepdims=True))[0] for p in parts]
        if len(parts) < 2 or 1 - spread >= tight and _gain(x, min(branching, len(rows) // 8), rng) < gain:
            continue
        for p, c in zip(parts, cs, strict=True):
            children[node].append(len(centres))
            centres.append(c)
            children.append([])
            todo.append((len(centres) - 1, p))
    return Tree(np.stack(centres).astype(np.float32), children)


def best_bins(tree: Tree, x: np.ndarray, bound: float = np.inf) -> list[list[int]]:
    """The leaves that each row of x visits, best bin first: the nearest open node is opened next, whatever its level; after the first leaf only while its similarity is `bound` or more."""
    out = []
    for s in (s for at in range(0, len(x), 1024) for s in (x[at : at + 1024] @ tree.centres.T).tolist()):
        heap, found = [(0.0, 0)], []
        while heap:
            d, node = heapq.heappop(heap)
            if found and -d < bound:
                break
            if tree.children[node]:
                for c in tree.children[node]:
                    heapq.heappush(heap, (-s[c], c))
            else:
                found.append(node)
        out.append(found)
    return out


def reach(tree: Tree, x: np.ndarray) -> np.ndarray:
    """(rows, nodes): the least similarity of each row of x to the nodes on the way to a node, which best_bins has to open all."""
    out = x @ tree.centres.T
    for node, children in enumerate(tree.children):  # parents come before their children
        if node:
            for c in children:
                np.minimum(out[:, c], out[:, node], out=out[:, c])
    return out


def _matrix(values: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, dims)


def unit_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """(path, vec): the vectors that take part, as the bytes of unit float32 rows. Of a path only the rows with its greatest mtime count (null is least), then null, zero, not finite and wrongly sized vectors drop out."""
    rows = rows.where("path is not null").select("path", F.coalesce(F.col("mtime"), F.lit(float("-inf"))).alias("t"), "embedding")
    rows = rows.join(rows.groupBy("path").agg(F.max("t").alias("t")), ["path", "t"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(np.nan_to_num(x, posinf=0, neginf=0), axis=1)
                ok = np.isfinite(x).all(1) & (n > 0)
                x = (x[ok] / n[ok, None]).astype(np.float32)
                yield pd.DataFrame({"path": batch["path"][ok], "vec": [r.tobytes() for r in x]})

    whole = rows.where((F.size("embedding") == dims) & ~F.exists("embedding", lambda v: v.isNull()))
    return whole.select("path", "embedding").mapInPandas(run, "path string, vec binary")


def _calibrate(vectors: DataFrame, tree: Tree, probes: np.ndarray, ids: list[str], dims: int, k: int, least: float, recall: float) -> float:
    """The greatest bound of best_bins with which `recall` of the probes' true neighbours are met from either side, by brute force over all vectors."""
    home = [b[0] for b in best_bins(tree, probes)]
    shared = vectors.sparkSession.sparkContext.broadcast((tree, probes, ids, home))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, p, own, leaves = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["vec"], dims)
            s = p @ x.T
            s[pd.Series(own).to_numpy()[:, None] == batch["id"].to_numpy()[None, :]] = -2
            top = np.argpartition(-s, min(k, len(x)) - 1, axis=1)[:, :k]
            leaf = np.array([b[0] for b in best_bins(t, x)])
            q, c = np.repeat(np.arange(len(p)), top.shape[1]), top.ravel()
            q, c = q[s[q, c] >= least], c[s[q, c] >= least]
            homes = np.array(leaves)[q]
            there, back = reach(t, p)[q, leaf[c]], reach(t, x[c])[np.arange(len(c)), homes]
            met = np.where(leaf[c] == homes, 1.0, np.maximum(there, back))
            yield pd.DataFrame({"q": q.astype(np.int32), "s": s[q, c].astype(float), "met": met.astype(float)})

    found = vectors.select("id", "vec").mapInPandas(run, "q int, s double, met double")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= k)
    met = [r["met"] for r in found.select("met").collect()]  # at most k rows a probe
    shared.unpersist()
    return float(np.quantile(met, 1 - recall)) - 1e-6 if met else 1.0


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df`, hinted to be broadcast where it has at most `most` rows of a few bytes."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


#: Rows of a leaf that one task moves into its subtree.
MOVED = 4096


def _split(rows: DataFrame, trees: DataFrame, dims: int, bound: float) -> DataFrame:
    """(id, vec, own, leaf, subs): `rows` (id, vec, leaf, own) with those leaves of their leaf's subtree (leaf, tree, tasks) that they visit, the nearest first. Rows of a leaf are spread over its `tasks` tasks, each with the subtree; a vector is handed on once, however many leaves it visits."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "vec": [], "own": [], "leaf": [], "subs": []}, dtype=object)
        return a[["id", "vec", "own", "leaf"]].assign(subs=best_bins(pickle.loads(b["tree"].iloc[0]), _matrix(a["vec"], dims), bound))

    left = rows.join(_small(trees.select("leaf", "tasks")), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tasks")))
    right = trees.select(F.col("leaf").alias("l2"), "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("p2"))
    return left.groupBy("leaf", "part").cogroup(right.groupBy("l2", "p2")).applyInPandas(run, "id string, vec binary, own boolean, leaf string, subs array<int>")


def _draw(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000_000))


def _best(df: DataFrame, key: str, order: list, most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def _met(asked: DataFrame, k: int, least: float, dims: int, bound: float, sample: int, block: int) -> DataFrame:
    """(id, near, cosine): for each vector its k most similar ones of cosine >= least in the leaves it visits, and among their visitors. asked (id, vec, leaf, own): the leaves each visits, one of which is its own."""
    whole = None
    while True:  # a level of the tree; each leaves leaves of a block at most, or such as no split would tighten
        counts = asked.groupBy("leaf").agg(F.count_if("own").alias("count"), F.count("*").alias("asked"))
        large = cut(counts.where(F.col("count") > block))
        large = large.join(whole, "leaf", "left_anti") if whole is not None else large
        if not large.limit(1).count():
            break
        large = _small(large)
        some = asked.where("own").join(large, "leaf").where(_draw(3) < (F.lit(float(sample)) / F.col("count") * 1_000_000_000)).select("leaf", "vec")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            t = fit_tree(_matrix(pdf["vec"], dims))
            return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "tree": [pickle.dumps(t)], "n": [len(t.leaves)]})

        trees = cut(some.groupBy("leaf").applyInPandas(fit, "leaf string, tree binary, n int"))
        stay = trees.where("n < 2").select("leaf")
        whole = cut(stay if whole is None else whole.unionByName(stay))
        trees = trees.where("n >= 2").join(large.select("leaf", F.ceil(F.col("asked") / MOVED).alias("tasks")), "leaf")
        if not trees.limit(1).count():
            break
        moved = cut(_split(asked, trees, dims, bound))
        below = moved.select("id", "vec", "leaf", "own", F.posexplode("subs").alias("at", "sub")).select("id", "vec", F.concat_ws("/", "leaf", "sub").alias("leaf"), (F.col("own") & (F.col("at") == 0)).alias("own"))
        asked = asked.join(_small(trees.select("leaf")), "leaf", "left_anti").select("id", "vec", "leaf", "own").unionByName(below)
    cells = asked.groupBy("leaf").agg(F.ceil(F.count_if("own") / block).cast("int").alias("parts"), F.ceil(F.count("*") / block).cast("int").alias("turns"))
    cells = _small(cells.where("parts > 0"))
    part_of = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = asked.join(cells, "leaf").select("id", "vec", "leaf", part_of(1, "turns").alias("turn"), every("parts").alias("part"))
    right = asked.where("own").join(cells, "leaf").select(F.col("id").alias("cid"), F.col("vec").alias("cvec"), F.col("leaf").alias("cleaf"), part_of(2, "parts").alias("cpart"), every("turns").alias("cturn"))

    def match(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []

        def keep(s: np.ndarray, mine: np.ndarray, others: np.ndarray) -> None:
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
            i, j = np.repeat(np.arange(len(s)), top.shape[1]), top.ravel()
            ok = s[i, j] >= least
            out.append(pd.DataFrame({"id": mine[i[ok]], "near": others[j[ok]], "cosine": s[i[ok], j[ok]].astype(float)}))

        if len(q) and len(c):
            y, ids, qid, z = _matrix(c["cvec"], dims), c["cid"].to_numpy(), q["id"].to_numpy(), _matrix(q["vec"], dims)
            own = pd.Series(np.arange(len(ids)), index=ids).reindex(qid).fillna(-1).to_numpy().astype(int)
            for at in range(0, len(z), 1024):
                s = z[at : at + 1024] @ y.T
                r = np.flatnonzero(own[at : at + 1024] >= 0)
                s[r, own[at : at + 1024][r]] = -2
                keep(s, qid[at : at + 1024], ids)
                guests = np.flatnonzero(own[at : at + 1024] < 0)  # those that live here are asked for on their own
                if len(guests):
                    keep(np.ascontiguousarray(s[guests].T), ids, qid[at : at + 1024][guests])
        return pd.concat(out) if out else pd.DataFrame({"id": [], "near": [], "cosine": []})

    near = left.groupBy("leaf", "part", "turn").cogroup(right.groupBy("cleaf", "cpart", "cturn")).applyInPandas(match, "id string, near string, cosine double")
    return _best(near.groupBy("id", "near").agg(F.max("cosine").alias("cosine")), "id", [F.desc("cosine"), "near"], k).drop("rank")


def most_similar(
    rows: DataFrame, k: int = 10, least: float = 0.62, dims: int = 512, recall: float = 0.995, sample: int = 10_000, probes: int = 256, block: int = 8192, copies: int = 500_000
) -> DataFrame:
    """(path, other, cosine, rank): for each path of `rows` (path, mtime, embedding) its k most similar other paths of cosine >= least.

    Greatest cosine first, equal ones by smaller path. The tree is fitted on at most about `sample` vectors (subtrees on as
    many of their leaf), the bound of leaf visits on about `probes` others, against brute force over all; every vector is
    indexed and queried. Equal vectors are equally similar (1.0). Null paths and unusable vectors take no part; repeated rows
    count once; empty tables give no rows. Leaves are taken in turns of about `copies` visits, or a quarter of the vectors if
    that is more.
    """
    spark = rows.sparkSession
    named = unit_vectors(rows, dims).withColumn("id", F.md5("vec"))
    vectors = cut(named.groupBy("id").agg(F.first("vec").alias("vec")))
    members = cut(named.select("id", "path").distinct())
    n = vectors.count()
    empty = spark.createDataFrame([], "path string, other string, cosine double, rank int")
    if not n:
        return empty
    share = lambda m: int(min(1.0, m / n) * 1_000_000_000)
    probed = (_draw(1) < share(min(probes, n / 4))).alias("probed")
    chosen = vectors.where((_draw(2) < share(sample)) | probed).select("id", "vec", probed).toPandas()  # about sample + probes rows
    fitted, asked_for = chosen[~chosen["probed"]], chosen[chosen["probed"]]
    if len(fitted) < 2 or not len(asked_for):
        fitted = asked_for = vectors.select("id", "vec").orderBy("id").limit(sample).toPandas()
    fitted, asked_for = fitted.sort_values("id"), asked_for.sort_values("id")
    tree = fit_tree(_matrix(fitted["vec"], dims))
    bound = _calibrate(vectors, tree, _matrix(asked_for["vec"], dims), asked_for["id"].tolist(), dims, k, least, recall)
    del chosen, fitted
    shared = spark.sparkContext.broadcast(tree)

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaves=best_bins(shared.value, _matrix(batch["vec"], dims), bound))

    seated = cut(vectors.mapInPandas(seat, "id string, vec binary, leaves array<int>"))
    del vectors
    visits = seated.agg(F.sum(F.size("leaves"))).first()[0]
    turns = -(-visits // max(copies, n // 4))
    near = None
    for turn in range(turns):
        asked = seated.select("id", "vec", F.posexplode("leaves").alias("at", "leaf")).where(F.pmod(F.xxhash64("leaf"), F.lit(turns)) == turn)
        found = cut(_met(asked.select("id", "vec", F.col("leaf").cast("string").alias("leaf"), (F.col("at") == 0).alias("own")), k, least, dims, bound, sample, block))
        near = found if near is None else near.unionByName(found)
        if turns > 1:  # else a turn's shuffled copies stay until the driver happens to collect its garbage
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    near = _best(near.groupBy("id", "near").agg(F.max("cosine").alias("cosine")), "id", [F.desc("cosine"), "near"], k).drop("rank")
    # at most k + 1 smallest paths of each set of equal vectors, salted so that a large set is cut down in many tasks
    salt = F.pmod(F.xxhash64("path"), F.lit(64))
    tops = members.withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy("id", "salt").orderBy("path"))).where(F.col("r") <= k + 1)
    tops = tops.select("id", "path", F.row_number().over(Window.partitionBy("id").orderBy("path")).alias("r")).where(F.col("r") <= k + 1).drop("r")
    lists = tops.select("id", F.col("path").alias("other"), F.lit(1.0).alias("cosine")).unionByName(
        near.join(tops.select(F.col("id").alias("near"), F.col("path").alias("other")), "near").select("id", "other", F.least("cosine", F.lit(1.0)).alias("cosine"))
    )
    lists = _best(lists, "id", [F.desc("cosine"), "other"], k + 1)
    lists = lists.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "cosine"))).alias("near"))  # at most k + 1 entries
    own = F.slice(F.filter("near", lambda e: e["other"] != F.col("path")), 1, k)
    pairs = members.join(lists, "id").select("path", F.explode(own).alias("e")).select("path", "e.other", "e.cosine")
    pairs = pairs.groupBy("path", "other").agg(F.max("cosine").alias("cosine"))
    return _best(pairs, "path", [F.desc("cosine"), "other"], k).select("path", "other", "cosine", "rank")


def found_pairs(rows: DataFrame, **options) -> DataFrame:
    """(path_a, path_b), path_a < path_b: one of the two is among the most similar of the other (most_similar)."""
    near = most_similar(rows, **options)
    return near.select(F.least("path", "other").alias("path_a"), F.greatest("path", "other").alias("path_b")).distinct()
