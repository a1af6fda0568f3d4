"""Consolidating pairwise matches into groups.

Rake and compress: vertices of degree one are stripped round after round, chains of vertices of degree two are
replaced by one edge (list ranking by pointer doubling finds their ends), the remaining core is solved by alternating
large-star and small-star steps, and the removed vertices then take the label of the vertex they hung on, in reverse
order. One side of each join has one row a vertex (or pair), so a hub's edges, leaves and labels don't multiply; they do
share a partition of the other side, which adaptive execution cuts up where it is skewed, as no later step needs that
partitioning. Degrees and labels are aggregated before they are shuffled. Vertices are 64-bit hashes of their names, checked
for collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.session import cut, is_real


def _symmetric(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) in both directions (v, n), without a second scan."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")).select("e.v", "e.n")


def _degrees(edges: DataFrame) -> DataFrame:
    """(v, d, lo, hi): degree, smallest and largest neighbour. Partial aggregation keeps a hub's edges out of the shuffle."""
    return _symmetric(edges).groupBy("v").agg(F.count("*").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _chains(degrees: DataFrame) -> DataFrame:
    """(v, lo, hi, left, right): for every degree-two vertex on an open chain, its neighbours and the chain's two ends. Vertices of pure cycles are left out.

    List ranking on arcs: arc (v, n) leads on to (n, the other neighbour of n) while n has degree two; pointer
    doubling reaches the end of a chain of length l in log2(l) rounds.
    """
    two = degrees.where("d = 2").select("v", "lo", "hi")
    arcs = two.select("v", F.explode(F.array("lo", "hi")).alias("n"))
    nxt = two.select(F.col("v").alias("n"), F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"))
    # the arc's end: (es, ed) is the last arc followed, done once ed has another degree than two
    state = cut(arcs.join(nxt, "n", "left").select("v", "n", F.when(F.col("n_lo").isNull(), F.col("v")).otherwise(F.col("n")).alias("es"), F.when(F.col("n_lo").isNull(), F.col("n")).when(F.col("n_lo") == F.col("v"), F.col("n_hi")).otherwise(F.col("n_lo")).alias("ed"), F.col("n_lo").isNull().alias("done")))
    open_before = None
    while True:
        n_open = state.where("not done").count()
        if n_open == 0 or n_open == open_before:  # a round that ends no arc has only cycles left
            break
        open_before = n_open
        jump = state.select(F.col("v").alias("es"), F.col("n").alias("ed"), F.col("es").alias("es2"), F.col("ed").alias("ed2"), F.col("done").alias("done2"))
        ended, going = state.where("done"), state.where("not done")
        state = cut(ended.unionByName(going.drop("done").join(jump, ["es", "ed"], "left").select("v", "n", F.col("es2").alias("es"), F.col("ed2").alias("ed"), F.col("done2").alias("done"))))
    both = state.where("done").groupBy("v").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("ed").alias("left"), F.max("ed").alias("right"))
    return both.where("k = 2").drop("k")


def _core_stars(edges: DataFrame) -> DataFrame:
    """(v, root) of the core by alternating large-star and small-star until nothing changes."""
    edges = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # u > v
    mark = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == mark:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = now


def _strip(edges: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes the degree-one vertices: (v, parent) of each, and the edges that stay. Of an edge between two leaves the smaller vertex stays."""
    ones = degrees.where("d = 1").select("v", F.col("lo").alias("parent"))
    off = cut(ones.groupBy(*_pair(F.col("v"), F.col("parent"))).agg(F.count("*").alias("k"), F.max("v").alias("v"), F.max("parent").alias("p")))
    both = F.col("k") == 2
    leaves = off.select(F.when(both, F.col("b")).otherwise(F.col("v")).alias("v"), F.when(both, F.col("a")).otherwise(F.col("p")).alias("parent"))
    return leaves, edges.join(off, ["a", "b"], "left_anti")


def _compress(edges: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces each open chain by one edge between its ends: (v, parent) of the inner vertices, and the edges that stay."""
    chains = cut(_chains(degrees))
    gone = chains.select(F.explode(F.array(*[F.struct(*_pair(F.col("v"), F.col(n))) for n in ("lo", "hi")])).alias("e")).select("e.a", "e.b")
    bridges = chains.where("left <> right").select(F.col("left").alias("a"), F.col("right").alias("b"))
    return chains.select("v", F.col("left").alias("parent")), edges.join(gone, ["a", "b"], "left_anti").unionByName(bridges).distinct()


def components_of_ids(edges: DataFrame, least_gain: float = 0.1) -> DataFrame:
    """(v long, root long): one row per vertex of `edges` (a long, b long); the root is some vertex of its component.

    Repeated edges and loops are allowed, rows with a null end are ignored; a vertex that occurs only in loops gets no
    row. Stripping and compressing take turns while they remove at least `least_gain` of the edges; whatever remains is
    solved as the core, so that parameter changes the cost only.
    """
    edges = edges.where("a <> b").select(*_pair(F.col("a"), F.col("b"))).distinct()
    steps, left = [], None
    while True:
        before = left
        for kind, degree in ((_strip, 1), (_compress, 2)):
            edges = cut(edges)
            degrees = cut(_degrees(edges))
            left, some = degrees.agg(F.coalesce(F.sum("d"), F.lit(0)) / 2, F.count_if(F.col("d") == degree)).first()
            if some:
                step, edges = kind(edges, degrees)
                steps.append(step)
        if not left or before is not None and left > (1 - least_gain) * before:
            break
    edges = cut(edges)
    left = left and edges.count()
    known = _core_stars(edges) if left else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    for step in reversed(steps):
        known = cut(known.unionByName(step.join(known.select(F.col("v").alias("parent"), "root"), "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))))
    return known.unionByName(known.select(F.col("root").alias("v"), "root").distinct())


def link_groups(pairs: DataFrame, left: str = "path_a", right: str = "path_b") -> DataFrame:
    """(path, group_path): one row per string that `pairs` links to another; group_path is the smallest string connected with it.

    Null ends and strings paired with themselves link nothing, repeated pairs and either order count once, an empty
    table gives no rows; other columns are ignored. Strings compare by their bytes.
    """
    links = pairs.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    seed = 0
    while True:
        h = (lambda c: F.xxhash64(c)) if not seed else (lambda c, s=seed: F.xxhash64(F.lit(s), c))
        names = cut(links.select(F.explode(F.array("x", "y")).alias("path")).distinct().withColumn("v", h(F.col("path"))))
        if names.groupBy("v").count().where("count > 1").limit(1).count() == 0:
            break
        seed += 1  # two names share a hash: take another hash
    roots = components_of_ids(links.select(h(F.col("x")).alias("a"), h(F.col("y")).alias("b")))
    named = cut(names.join(roots, "v").select("path", "root"))
    return named.join(named.groupBy("root").agg(F.min("path").alias("group_path")), "root").select("path", "group_path")


def consolidate(scored: DataFrame, threshold: float = 70.0) -> DataFrame:
    """link_groups over the rows of `scored` (path_a, path_b, score) with score >= threshold; null and NaN scores link nothing."""
    return link_groups(scored.where(is_real(F.col("score")) & (F.col("score") >= threshold)))
