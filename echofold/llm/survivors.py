"""The best representative of each duplicate group, field by field.

Entries rank by trust, completeness and recency (found_entries). Where times are missing, recency is inferred
(current_values): from all groups with times we learn which value classes follow which; the classes that occur in a group
form a partial order by these precedences and by the group's own times, and the value that is last in it is taken.

Groups live in one row each, so ranking is a fold over the row's own array and needs no shuffle of the entries.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("file_size", "bitrate", "mtime")
#: Value classes of a field: half powers of two, 0 to 127. The learnt table has at most CLASSES**2 rows a field, whatever the input.
CLASSES = 128


def _valid(entry: Column, field: str, made: Column) -> Column:
    """The field's value as a double where it is present, else null: above 0, not NaN, and a time not after `made`."""
    x = entry[field].cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (x > 0)
    if field == "mtime":
        ok = ok & (made.isNull() | (x <= made))
    return F.when(ok, x)


def _ranked(groups: DataFrame) -> DataFrame:
    """(group_id, entries): entries as structs that sort in the order of preference, smallest first."""
    made = F.expr("try_cast(generated_at as timestamp)").cast("double")

    def entry(e: Column) -> Column:
        size, rate, time = (_valid(e, f, F.col("_made")) for f in FIELDS)
        present = sum((v.isNotNull().cast("int") for v in (size, rate, time)), F.lit(0))
        return F.struct(
            (~F.coalesce(e["is_reference"], F.lit(False))).alias("untrusted"),
            (-present).alias("absent"),
            (-F.coalesce(time, F.lit(0.0))).alias("age"),
            (-F.coalesce(size, F.lit(0.0))).alias("smallness"),
            e["path"].alias("path"),
            size.alias("file_size"),
            rate.alias("bitrate"),
            time.alias("mtime"),
        )

    own = F.filter(F.coalesce(F.col("files"), F.array()), lambda e: e.isNotNull() & e["path"].isNotNull())
    return groups.select("group_id", made.alias("_made"), own.alias("_own")).select("group_id", F.transform("_own", entry).alias("entries"))


def found_entries(groups: DataFrame) -> DataFrame:
    """(group_id, field_name, path): the group's first entry ('record') and, for each field, the first entry that has it.

    `groups` has group_id, generated_at and files. Missing values are null, NaN, not above 0, or a time after
    generated_at (a generated_at that can't be read excludes none). Entries without a path are no source; a null or
    empty array gives no rows. Ties end at the smaller path. A group given in several rows is one group.
    """
    first = lambda f: F.array_min(F.filter("entries", lambda e: e[f].isNotNull()) if f else F.col("entries"))
    names = ("record", *FIELDS)
    best = _ranked(groups).where("group_id is not null").select("group_id", *[first(None if n == "record" else n).alias(n) for n in names])
    best = best.groupBy("group_id").agg(*[F.min(n).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"{n}.path").alias("path")) for n in names])
    return best.select("group_id", F.explode(rows).alias("r")).select("group_id", "r.field_name", "r.path").where("path is not null")


def _class(c: Column) -> Column:
    return F.least(F.floor(2 * F.log2(c)).cast("int"), F.lit(CLASSES - 1))


def learn_precedence(groups: DataFrame, field: str) -> DataFrame:
    """(earlier int, later int, n long): how often a value of one class directly followed one of another in time, over all groups."""
    timed = F.array_sort(F.transform(F.filter("entries", lambda e: e["mtime"].isNotNull() & e[field].isNotNull()), lambda e: F.struct(e["mtime"].alias("t"), _class(e[field]).alias("k"))))
    steps = _ranked(groups).select(timed.alias("s")).where(F.size("s") > 1).select(F.explode(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")), lambda x, y: F.struct(x["k"].alias("earlier"), y["k"].alias("later"), (x["t"] < y["t"]).alias("apart")))).alias("x"))
    return steps.where("x.apart and x.earlier <> x.later").groupBy("x.earlier", "x.later").agg(F.count("*").alias("n"))


def net_precedence(learnt: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """(earlier, later) -> how much more often that way than the other, of the pairs of classes where one way is more frequent."""
    count: dict[tuple[int, int], int] = defaultdict(int)
    for u, v, n in learnt:
        count[u, v] += n
    return {(u, v): n - count.get((v, u), 0) for (u, v), n in count.items() if n > count.get((v, u), 0)}


def partial_order(classes: list[int], sure: list[tuple[int, int]], net: dict[tuple[int, int], int]) -> dict[int, set[int]]:
    """For each of a group's classes those that come before it, directly or not.

    The pairs of `sure` (earlier, later), which the group's own times give, are taken first, then the learnt ones between its
    classes from the strongest down; a pair that would close a cycle is left out.
    """
    before: dict[int, set[int]] = {c: set() for c in classes}
    own = sorted(((n, u, v) for u in classes for v in classes if (n := net.get((u, v), 0))), key=lambda x: (-x[0], x[1], x[2]))
    for u, v in [*sure, *((u, v) for _, u, v in own)]:
        if u != v and v not in before[u] and u not in before[v]:
            new = {u} | before[u]
            for x in classes:
                if x == v or v in before[x]:
                    before[x] |= new
    return before


def latest_classes(classes: list[int], before: dict[int, set[int]]) -> list[int]:
    """The classes before nothing else, those with most before them first: the last ones of every topological order."""
    earlier = set().union(*before.values()) if before else set()
    return sorted((c for c in classes if c not in earlier), key=lambda c: (-len(before[c]), -c))


def _pick(entries: list[dict], net: dict[tuple[int, int], int]) -> int:
    """The place of the most current of a group's entries {k: class, t: time or None}, which come in the order of found_entries.

    Only the latest time of each class and its first entry matter, so the work is bounded by the number of classes.
    """
    last: dict[int, float] = {}
    for e in entries:
        if e["t"] is not None and e["t"] > last.get(e["k"], float("-inf")):
            last[e["k"]] = e["t"]
    classes = sorted({e["k"] for e in entries})
    timed = sorted(last, key=lambda k: (last[k], k))
    before = partial_order(classes, list(zip(timed, timed[1:], strict=False)), net)
    top = latest_classes(classes, before)
    best = timed[-1] if timed and timed[-1] in top else top[0]  # nothing is known to follow the latest time
    own = [(i, e["t"]) for i, e in enumerate(entries) if e["k"] == best]
    return max(own, key=lambda x: (x[1] if x[1] is not None else float("-inf"), -x[0]))[0]


def current_values(groups: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """(group_id, field_name, path, value, inferred): each group's most current file_size and bitrate.

    The values' classes are ordered by the group's own times and, where times are missing, by the precedences learnt from
    `learn_from` (all groups unless given); the last class of that partial order gives the value, of several last ones that
    of the latest time, else the one that follows most others. inferred tells that the entry taken has no time. Within a class
    the later entry counts, then the order of found_entries. Null and empty arrays and groups without the value give no row.
    """
    parts = None
    for field in ("file_size", "bitrate"):
        net = net_precedence([tuple(r) for r in learn_precedence(groups if learn_from is None else learn_from, field).collect()])  # at most CLASSES**2 rows

        def run(batches: Iterator[pd.DataFrame], net=net) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at = [_pick(e, net) for e in batch["own"]]
                got = [e[i] for e, i in zip(batch["own"], at, strict=True)]
                yield pd.DataFrame({"group_id": batch["group_id"], "path": [e["path"] for e in got], "value": [e["value"] for e in got], "inferred": [e["t"] is None for e in got]})

        own = F.transform(F.array_sort(F.filter("entries", lambda e: e[field].isNotNull())), lambda e: F.struct(_class(e[field]).alias("k"), e["mtime"].alias("t"), e["path"].alias("path"), e[field].alias("value")))
        rows = _ranked(groups).where("group_id is not null").select("group_id", own.alias("own")).where(F.size("own") > 0)
        pick = rows.mapInPandas(run, "group_id int, path string, value double, inferred boolean").select("group_id", F.lit(field).alias("field_name"), "path", "value", "inferred")
        parts = pick if parts is None else parts.unionByName(pick)
    return parts


def hidden_times(groups: DataFrame) -> DataFrame:
    """(field_name, n, right, plain): how often current_values finds the latest value of groups whose times are hidden from it.

    Half of the groups (by hash) are learnt from; of the others those count whose entries with the value all have a time and
    whose latest value's class is not the only one. plain is the number that found_entries' order without times gets right.
    """
    half = F.pmod(F.xxhash64("group_id"), F.lit(2))
    entry = lambda e: F.struct(*[(F.lit(None).cast("double") if f == "mtime" else e[f]).alias(f) for f in ("path", "file_size", "bitrate", "mtime", "is_reference")])
    held = groups.where(half == 1)
    found = current_values(held.withColumn("files", F.transform("files", entry)), groups.where(half == 0))
    parts = None
    for field in ("file_size", "bitrate"):
        has = F.filter("entries", lambda e: e[field].isNotNull())
        timed = _ranked(held).select("group_id", has.alias("own")).where(F.size("own") > 1).where(F.forall("own", lambda e: e["mtime"].isNotNull()))
        truth = timed.select("group_id", F.array_max(F.transform("own", lambda e: F.struct(e["mtime"].alias("t"), e[field].alias("v"))))["v"].alias("v"), F.array_min(F.transform("own", lambda e: F.struct(e["untrusted"], e["absent"], e["smallness"], e["path"], e[field].alias("v"))))["v"].alias("plain"), F.array_distinct(F.transform("own", lambda e: _class(e[field]))).alias("ks")).where(F.size("ks") > 1)
        both = truth.join(found.where(F.col("field_name") == field), "group_id")
        part = both.agg(F.count("*").alias("n"), F.count_if(_class(F.col("value")) == _class(F.col("v"))).alias("right"), F.count_if(_class(F.col("plain")) == _class(F.col("v"))).alias("plain")).select(F.lit(field).alias("field_name"), "n", "right", "plain")
        parts = part if parts is None else parts.unionByName(part)
    return parts
