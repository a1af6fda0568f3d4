"""Finding files and reading what other runs left behind."""

from __future__ import annotations

import io
import json
import os
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.functions import names

SCHEMA = "path string, filename string, file_size long, mtime double"


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for a whole relative path: ** crosses folders, * and ? stay within one."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = glob[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return f"^{out}$"


def parse_extensions(text: str) -> set[str]:
    """'MP4, .mkv' as suffixes with their point, lower case."""
    return {"." + p.strip().lower().lstrip(".") for p in text.split(",") if p.strip(" .")}


def scan(spark: SparkSession, roots: Iterable[str], suffixes: Iterable[str] | None = None, exclude: Iterable[str] = (), recursive: bool = True) -> DataFrame:
    """(path, filename, file_size, mtime) of the files under the roots, each once; empty files too. A missing root is an error.

    The roots' folders are listed by the tasks, one folder of the top level each; unreadable entries are passed over.
    """
    tops = []
    for r in roots:
        if not os.path.isdir(r):
            raise FileNotFoundError(r)
        r = os.path.realpath(r)
        tops.append((r, r, False))
        if recursive:
            tops += [(r, e.path, True) for e in os.scandir(r) if e.is_dir(follow_symlinks=False)]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, top, deep in batch.itertuples(index=False):
                rows = []
                for folder, _, found in os.walk(top):
                    for f in found:
                        p = os.path.realpath(os.path.join(folder, f))
                        try:
                            s = os.stat(p)
                        except OSError:
                            continue
                        rows.append((p, os.path.relpath(os.path.join(folder, f), root), s.st_size, s.st_mtime))
                    if not deep:
                        break
                yield pd.DataFrame(rows, columns=["path", "rel", "file_size", "mtime"]).astype({"file_size": "int64", "mtime": "float64"})

    found = spark.createDataFrame(tops, "root string, top string, deep boolean").repartition(max(1, min(len(tops), 64))).mapInPandas(walk, "path string, rel string, file_size long, mtime double")
    if suffixes is not None:
        found = found.where(names.suffix(F.col("path")).isin([s.lower() for s in suffixes]))
    for g in exclude:
        found = found.where(~F.col("rel").rlike(glob_pattern(g)))
    return found.select("path", names.stem(F.col("path")).alias("filename"), "file_size", "mtime").dropDuplicates(["path"])


def sorted_scan(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower(names.basename(F.col("path"))), "path")


def sidecars(files: DataFrame, inventory: DataFrame, extensions: Iterable[str] = (".xmp", ".aae", ".thm", ".json")) -> DataFrame:
    """(path, sidecars): for each file the entries of the inventory (path) beside it named stem+ext or full name+ext, or stem.lrdata; [] for none."""
    told = files.select("path", names.parent(F.col("path")).alias("_parent"), names.stem(F.col("path")).alias("_stem"), names.basename(F.col("path")).alias("_base"))
    key = lambda n, stem: F.struct(F.concat("_parent", F.lit("/"), n).alias("key"), F.lit(stem).alias("stem"))
    wanted = told.select("path", F.explode(F.array(key("_stem", True), key("_base", False))).alias("k")).select("path", "k.*", F.lit(None).cast("string").alias("side"), F.lit(True).alias("file"))
    ends = sorted({e for x in extensions for e in (x.lower(), x.upper())} | {".lrdata"})
    cut_off = F.filter(F.array(*[F.when(F.col("path").endswith(e), F.substring("path", 1, F.length("path") - len(e))) for e in ends]), lambda k: k.isNotNull())
    there = inventory.select(F.col("path").alias("side"), F.explode(cut_off).alias("key")).select(F.lit(None).cast("string").alias("path"), "key", F.lit(None).cast("boolean").alias("stem"), "side", F.lit(False).alias("file"))
    # files and sidecars meet in one window over the name, which has a side for each ending at most: a join would broadcast one of the two, both of which grow with the files
    met = wanted.unionByName(there).withColumn("sides", F.collect_set("side").over(Window.partitionBy("key"))).where("file")
    own = F.filter("sides", lambda x: (x != F.col("path")) & (F.col("stem") | ~x.endswith(".lrdata")))
    return met.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("sidecars"))


def pdf_date(c: Column) -> Column:
    """D:20240131120000+01'00' as ISO text; null where it is none."""
    m = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(Z|[+-]\d{2}'?\d{2}'?)?"
    g = lambda k, other: F.when(F.regexp_extract(c, m, k) == "", other).otherwise(F.regexp_extract(c, m, k))
    zone = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, m, 7), r"^([+-]\d{2})'?(\d{2})'?$", "$1:$2"), "^Z$", "+00:00")
    return F.when(F.regexp_extract(c, m, 1) != "", F.concat(g(1, ""), F.lit("-"), g(2, "01"), F.lit("-"), g(3, "01"), F.lit("T"), g(4, "00"), F.lit(":"), g(5, "00"), F.lit(":"), g(6, "00"), zone))


def exif_date(c: Column) -> Column:
    """'2024:01:31 12:00:00' as epoch seconds, taken as UTC."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")).cast("double")


def line_count(text: Column) -> Column:
    """Lines of a text, the unfinished last one included."""
    return F.length(F.regexp_replace(text, "[^\n]", "")) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def _docx(content: bytes) -> tuple:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
        body = z.read("word/document.xml") if "word/document.xml" in z.namelist() else b""
    get = lambda tag: next((e.text.strip() for e in core.iter() if e.tag.endswith("}" + tag) and e.text), None) if core is not None else None
    return _plain(get("title")), _plain(get("creator")), get("created"), max(1, len(re.findall(rb"<w:p[ >/]", body)) // 4)


def _plain(text: str | None) -> str | None:
    """Titles and authors compare without case and surrounding blanks; an empty one is unknown."""
    return (text or "").strip().lower() or None


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(content: bytes, key: bytes) -> str | None:
    """The text after /key, as (literal) with escapes or as <hex>, in UTF-16 where it begins with its mark."""
    m = re.search(rb"/" + key + rb"\s*(?:\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<([0-9A-Fa-f\s]*)>)", content, re.S)
    if not m:
        return None
    if m[1] is not None:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else b"" if e[1].endswith(b"\n") else _ESCAPES.get(e[1], e[1]), m[1], flags=re.S)
    else:
        digits = re.sub(rb"\s", b"", m[2])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    for mark, coding in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(coding, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _pdf(content: bytes) -> tuple:
    """Objects packed into compressed streams are looked at too."""
    if not content.startswith(b"%PDF"):
        return None, None, None, None
    parts = [content]
    for m in re.finditer(rb"/ObjStm.{0,400}?stream\r?\n", content, re.S):
        try:
            parts.append(zlib.decompressobj().decompress(content[m.end() :]))
        except zlib.error:
            continue
    whole = b"\n".join(parts)
    counts = [int(n) for n in re.findall(rb"/Count\s+(\d+)", whole)]
    pages = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", whole)) or max(counts, default=0)
    created = _pdf_string(whole, b"CreationDate")
    return _plain(_pdf_string(whole, b"Title")), _plain(_pdf_string(whole, b"Author")), created.strip() if created else None, pages or None


def documents(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, doc_title, doc_author, doc_created, page_count, text) of document files (path); unreadable ones are left out, text is null for pdf and docx."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch["path"]:
                try:
                    with open(p, "rb") as f:
                        content = f.read()
                    kind = os.path.splitext(p)[1].lower()
                    if kind in (".pdf", ".docx"):
                        rows.append((p, *(_pdf if kind == ".pdf" else _docx)(content), None))
                    else:
                        text = content.decode("utf-8", "replace")
                        rows.append((p, None, None, None, text.count("\n") + (bool(text) and not text.endswith("\n")), text))
                except (OSError, zipfile.BadZipFile, ET.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "doc_title", "doc_author", "doc_created", "page_count", "text"]).astype({"page_count": "Int32"})

    raw = paths.select("path").mapInPandas(run, "path string, doc_title string, doc_author string, doc_created string, page_count int, text string")
    return raw.withColumn("doc_created", F.coalesce(pdf_date(F.col("doc_created")), F.col("doc_created")))


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """(file_a, file_b, score) of an envelope's pairs, or of its groups' pairs, each once. A bare array is an error."""
    schema = "pairs array<struct<file_a:string,file_b:string,score:double>>, groups array<struct<group_id:int,pairs:array<struct<file_a:string,file_b:string,score:double>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path)
    if e.where("pairs is not null or groups is not null").limit(1).count() == 0:
        raise ValueError(f"no envelope: {path}")
    both = F.concat(F.coalesce("pairs", F.array()), F.flatten(F.transform(F.coalesce("groups", F.array()), lambda g: F.coalesce(g["pairs"], F.array()))))
    return e.select(F.explode(both).alias("p")).select("p.*").where("file_a is not null and file_b is not null").groupBy("file_a", "file_b").agg(F.max("score").alias("score"))


ACTION = "timestamp string, action string, path string, score double, strategy string, kept string, bytes_freed long, destination string, dry_run boolean, sidecar_of string"


def read_actions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The actions of a log (dry runs left out), and (lines, malformed): blank lines don't count, lines that are no object or lack action or path are malformed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", ACTION).alias("r"))
    good = F.col("r.action").isNotNull() & F.col("r.path").isNotNull()
    return parsed.where(good).select("r.*").where("not coalesce(dry_run, false)"), parsed.agg(F.count("*").alias("lines"), F.count_if(~good).alias("malformed"))


def read_ignored(spark: SparkSession, path: str) -> DataFrame:
    """(path_a, path_b) of an ignore list, a JSON array of pairs; a missing or broken file is an empty list."""
    try:
        with open(path, encoding="utf-8") as f:
            rows = sorted({tuple(sorted(p)) for p in json.load(f) if isinstance(p, list) and len(p) == 2})
    except (OSError, ValueError, TypeError):
        rows = []
    return spark.createDataFrame(rows, "path_a string, path_b string")


def write_ignored(pairs: DataFrame, path: str) -> None:
    """Saves an ignore list (one that people made by hand) in place of the old one."""
    rows = sorted({tuple(sorted((r.path_a, r.path_b))) for r in pairs.select("path_a", "path_b").toLocalIterator()})
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(rows, f)
    os.replace(path + ".new", path)


def read_config(path: str | None, profile: str | None = None, overrides: dict | None = None, defaults: dict | None = None) -> dict:
    """Settings: defaults, then a TOML file, then a profile file (missing: error), then overrides that aren't None. Values of another type than the default's are left out."""
    out = dict(defaults or {})
    for p, needed in ((path, False), (profile, True)):
        if p and (needed or os.path.exists(p)):
            with open(p, "rb") as f:
                out |= {k: v for k, v in tomllib.load(f).items() if k not in out or out[k] is None or isinstance(v, type(out[k]))}
    return out | {k: v for k, v in (overrides or {}).items() if v is not None}
