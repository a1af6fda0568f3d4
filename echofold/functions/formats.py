"""Parsing and showing sizes, rates, resolutions, durations and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIZE = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
_RATE = {"": 1, "BPS": 1, "K": 10**3, "KBPS": 10**3, "M": 10**6, "MBPS": 10**6, "G": 10**9, "GBPS": 10**9}


def _scaled(text: str, units: dict[str, int], what: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in units:
        raise ValueError(f"not a {what}: {text!r}")
    return int(float(m[1]) * units[m[2].upper()])


def parse_size(text: str) -> int:
    """Bytes of '1.5GB' and the like, 1024-based."""
    return _scaled(text, _SIZE, "size")


def parse_bitrate(text: str) -> int:
    """Bits a second of '5M', '128kbps' and the like, 1000-based."""
    return _scaled(text, _RATE, "bitrate")


def parse_resolution(text: str) -> tuple[int, int]:
    """(width, height) of '1920x1080'."""
    m = re.fullmatch(r"\s*(\d+)\s*[xX]\s*(\d+)\s*", text)
    if not m or not int(m[1]) or not int(m[2]):
        raise ValueError(f"not a resolution: {text!r}")
    return int(m[1]), int(m[2])


def _parsed(c: Column, units: dict[str, int]) -> Column:
    number = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*[A-Za-z]*\s*$", 1)
    unit = F.upper(F.regexp_extract(c, r"([A-Za-z]*)\s*$", 1))
    factor = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    return F.when(number != "", F.floor(number.cast("double") * F.try_element_at(factor, unit)))


def size_from(c: Column) -> Column:
    """parse_size of a column; null where it is none."""
    return _parsed(c, _SIZE)


def bitrate_from(c: Column) -> Column:
    return _parsed(c, _RATE)


def resolution_from(c: Column) -> Column:
    """(width, height) of a column, null where it is none."""
    w, h = (F.regexp_extract(c, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", k) for k in (1, 2))
    return F.when((w != "") & (h != ""), F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def format_size(n: Column) -> Column:
    """In the largest unit that divides it evenly."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for unit in ("KB", "MB", "GB", "TB"):
        out = F.when((n > 0) & (n % _SIZE[unit] == 0), F.concat(F.floor(n / _SIZE[unit]).cast("string"), F.lit(unit))).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """With one decimal in the largest unit that leaves 1 or more, up to PB."""
    out = F.format_string("%.1f B", n.cast("double"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(F.abs(n) >= 1 << 10 * k, F.format_string(f"%.1f {unit}", n / float(1 << 10 * k))).otherwise(out)
    return out


def even_bitrate(n: Column) -> Column:
    """In the largest 1000-based unit that divides it evenly."""
    out = F.concat(n.cast("string"), F.lit("bps"))
    for unit, factor in (("Kbps", 10**3), ("Mbps", 10**6), ("Gbps", 10**9)):
        out = F.when((n > 0) & (n % factor == 0), F.concat(F.floor(n / factor).cast("string"), F.lit(unit))).otherwise(out)
    return out


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; n/a for null."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(seconds.isNull(), "n/a").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def show_resolution(width: Column, height: Column) -> Column:
    return F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit("n/a"))


def show_codec(c: Column) -> Column:
    """The usual name of a codec, else its own in capitals."""
    known = {"h264": "H.264", "hevc": "H.265", "vp9": "VP9", "av1": "AV1", "mpeg4": "MPEG-4"}
    out = F.upper(c)
    for name, shown in known.items():
        out = F.when(c == name, shown).otherwise(out)
    return F.coalesce(out, F.lit("n/a"))


def show_bitrate(n: Column) -> Column:
    shown = F.when(n >= 1_000_000, F.format_string("%.1f Mbps", n / 1e6)).when(n >= 1000, F.format_string("%.0f kbps", n / 1e3))
    return F.when(n.isNull(), "n/a").otherwise(F.coalesce(shown, F.concat(n.cast("string"), F.lit(" bps"))))


def show_framerate(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), "n/a").otherwise(F.concat(text, F.lit(" fps")))


def show_channels(n: Column) -> Column:
    shown = F.when(n == 1, "Mono").when(n == 2, "Stereo").when(n == 6, "5.1").when(n == 8, "7.1").otherwise(F.concat(n.cast("string"), F.lit("ch")))
    return F.coalesce(shown, F.lit("n/a"))


def score_band(score: Column) -> Column:
    """CRIT from 90, HIGH from 70, MED from 50, else LOW."""
    return F.when(score >= 90, "CRIT").when(score >= 70, "HIGH").when(score >= 50, "MED").otherwise("LOW")


def score_colour(score: Column) -> Column:
    """red from 80, yellow from 60, else green."""
    return F.when(score >= 80, "red").when(score >= 60, "yellow").otherwise("green")


def markdown_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def html_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def shell_quote(c: Column) -> Column:
    """As one word of a shell; harmless words stay as they are."""
    return F.when(c.rlike(r"^[A-Za-z0-9@%+=:,./_-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def comment_text(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", " ")
