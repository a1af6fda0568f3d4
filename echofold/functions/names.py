"""String functions on file names and tags, as Columns where Spark has the parts and as Arrow functions where it has not."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Marks of quality in file names, and what separates words.
QUALITY = (
    r"\d{3,4}p|[xh]\.?264|[xh]\.?265|hevc|avc|bluray|blu-ray|bdrip|brrip|webrip|web-dl|webdl|hdrip|dvdrip|dvdscr|hdtv|pdtv|sdtv|remux|10bit|8bit|hdr|hdr10|dv"
    r"|aac|ac3|dts|flac|mp3|atmos|5\.1|7\.1|2\.0|proper|repack"
)
SEPARATORS = r"[.\-_\[\](){}]+"


def normalize_filename(name: Column) -> Column:
    """Quality marks and separators become blanks, blanks are single, letters lower case. Null stays null."""
    plain = F.regexp_replace(name, f"(?iU)\\b({QUALITY})\\b", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(plain, SEPARATORS, " ")), r"(?U)\s+", " "))


def is_numeric_id(normalized: Column) -> Column:
    """More than half of what isn't blank are digits; false for an empty name."""
    solid = F.regexp_replace(normalized, " ", "")
    return F.coalesce(F.length(F.regexp_replace(solid, r"(?U)\D", "")) / F.nullif(F.length(solid), F.lit(0)) > 0.5, F.lit(False))


def digits(normalized: Column) -> Column:
    return F.regexp_replace(normalized, r"(?U)\D", "")


def digit_runs(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(r"(?U)(\d+)"), 1)


def skeleton(normalized: Column) -> Column:
    """The name without its digits, blanks single."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalized, r"(?U)\d+", ""), r"(?U)\s+", " "))


def sorted_tokens(normalized: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(normalized, r"(?U)\s+"), lambda t: t != "")), " ")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one machine word or big integer a row (bit-parallel)."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@lru_cache(maxsize=1 << 16)
def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions and deletions) / (length of both), 1.0 for two empty strings."""
    n = len(a) + len(b)
    return 2.0 * common_length(a, b) / n if n else 1.0


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio of two columns, null where either is null."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1.0 for two empty strings."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def stem(path: Column) -> Column:
    """Of the last part of a path, what is before its last point; a leading point belongs to the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-case suffix with its point, '' where there is none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"^$", "/")


def home_short(path: Column, home: str) -> Column:
    return F.when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


# Suffixes by kind of media.
SUFFIXES = {
    "video": ".mp4 .mkv .avi .mov .wmv .flv .webm .m4v .mpg .mpeg .ts .vob .3gp .ogv".split(),
    "image": ".jpg .jpeg .png .gif .bmp .webp .tiff .tif .heic .heif .avif .svg .ico".split(),
    "audio": ".mp3 .flac .aac .m4a .wav .ogg .opus .wma .ape .alac .aiff .aif .wv .dsf .dff".split(),
    "document": ".pdf .docx .txt .md".split(),
}


def media_type(path: Column) -> Column:
    """video, image, audio or document by the path's suffix, else null."""
    s = suffix(path)
    out = F.lit(None).cast("string")
    for kind, known in SUFFIXES.items():
        out = F.when(s.isin(known), kind).otherwise(out)
    return out
