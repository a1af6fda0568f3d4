"""How alike two files are, one aspect at a time: Columns of 0.0 to 1.0 over the struct columns a and b, null where the aspect can't be compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echofold.functions import names


def _both(f: str) -> tuple[Column, Column]:
    return F.col(f"a.{f}"), F.col(f"b.{f}")


def _known(value: Column, *parts: Column) -> Column:
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull()
    return F.when(ok, value)


def _share(x: Column, y: Column) -> Column:
    """Smaller by larger, 0 where either is 0."""
    return _known(F.when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y).cast("double")), x, y)


def _linear(x: Column, y: Column, most: float) -> Column:
    return _known(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.lit(float(most))), x, y)


def duration() -> Column:
    return _linear(*_both("duration"), 5.0)


def resolution() -> Column:
    return _share(*[F.col(f"{s}.width").cast("long") * F.col(f"{s}.height") for s in "ab"])


def file_size() -> Column:
    return _share(*_both("file_size"))


def page_count() -> Column:
    x, y = _both("page_count")
    most = F.greatest(x, y)
    return _known(F.when(most != 0, 1 - F.abs(x - y) / most.cast("double")), x, y)


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Mean of the parts that are known, by weight; null where none is."""
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return F.when(total > 0, value / total)


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def exif() -> Column:
    equal = lambda f: _known((F.col(f"a.{f}") == F.col(f"b.{f}")).cast("double"), *_both(f))
    place = [F.col(f"{s}.exif_gps_{x}") for s in "ab" for x in ("lat", "lon")]
    near = _known(F.greatest(F.lit(0.0), 1 - metres(*place) / 1000.0), *place)
    size = [F.col(f"{s}.exif_{x}") for s in "ab" for x in ("width", "height")]
    true = [F.col(f"{s}.{x}") for s in "ab" for x in ("width", "height")]
    own = F.lit(True)
    for e, t in zip(size, true, strict=True):
        own = own & (e == t)
    same = _known((own & (size[0] == size[2]) & (size[1] == size[3])).cast("double"), *size, *true)
    return weighted([(0.35, _linear(*_both("exif_datetime"), 3600.0)), (0.20, equal("exif_camera")), (0.10, equal("exif_lens")), (0.25, near), (0.10, same)])


def tags() -> Column:
    return weighted([(w, names.ratio(*_both(f))) for w, f in ((0.45, "tag_title"), (0.35, "tag_artist"), (0.20, "tag_album"))])


def document() -> Column:
    """Title, author and date; dates of which only one has an offset aren't compared."""
    x, y = _both("doc_created")
    zone = r"(Z|[+-]\d{2}:?\d{2})$"
    day = lambda c: F.try_to_timestamp(c).cast("double")
    when = F.when(x.rlike(zone) == y.rlike(zone), _linear(day(x), day(y), 30 * 86400.0))
    return weighted([(0.45, names.ratio(*_both("doc_title"))), (0.35, names.ratio(*_both("doc_author"))), (0.20, when)])


def directories(path: Column) -> Column:
    """The folders a path lies in, from the root down, each with those above it."""
    parts = F.filter(F.split(names.parent(path), "/"), lambda x: x != "")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def directory(split: bool = False) -> Column:
    """1.0 for one directory, 0 where only the root is shared, else less by a fifth for each level of the deeper one below what is shared. `split`: a and b have their `directories` as a field."""
    p, q = (F.col(f"{s}.directories") if split else directories(F.col(f"{s}.path")) for s in "ab")
    shared = F.size(F.array_intersect(p, q))
    deep = F.greatest(F.size(p), F.size(q)) - shared
    return F.when(p == q, 1.0).when(shared == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - deep / F.lit(5.0)))


def filename_exclusion() -> Column:
    """True where two names can't be one work: an empty name, unequal numeric ids, or one wording with other numbers."""
    x, y = _both("name")
    ids = names.is_numeric_id(x) & names.is_numeric_id(y) & (names.digits(x) != names.digits(y))
    series = (names.skeleton(x) != "") & (names.skeleton(x) == names.skeleton(y)) & (names.digit_runs(x) != names.digit_runs(y))
    return (x == "") | (y == "") | ids | series


#: Ratio from which names with words of their own still count as alike.
READ_ALIKE = 0.85


def plain_word(t: Column) -> Column:
    return (F.length(t) >= 3) & t.rlike(r"^\p{L}+$")


def filename(ratio: Column) -> Column:
    """From the ratio of the sorted words: 0 where the names exclude each other, or read moderately alike and each has a word of its own."""
    x, y = (F.split(c, " ") for c in _both("name"))
    own = F.exists(F.array_except(x, y), plain_word) & F.exists(F.array_except(y, x), plain_word)
    return F.when(filename_exclusion() | ((ratio < READ_ALIKE) & own), 0.0).otherwise(ratio)
