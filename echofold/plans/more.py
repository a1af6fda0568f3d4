"""More named queries, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.functions import fingerprints, names
from echofold.operators import comparators, filters, groups, photos, review, scoring
from echofold.plans import reports, scores_sql, sql
from echofold.plans.catalog import _attached, _files, _latest, _linked, _members
from echofold.session import table
from echofold.sources import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(twin: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


ATT = f"WITH {sql.BOTH}"
GROUPS = "envelope_groups"
#: Files of the last batch stand for those already acted on, weak pairs of batch 11 for ignored ones, strong ones for resolved ones.
ACTIONED = "SELECT DISTINCT path FROM files WHERE batch_no = 2"
IGNORED = "SELECT path_a, path_b FROM scored_pairs WHERE batch_no = 11 AND score < 60"
RESOLVED = "SELECT path_a, path_b FROM scored_pairs WHERE batch_no = 10 AND score >= 90"


def _decided(spark, d):
    p = table(spark, d, "scored_pairs").select("path_a", "path_b", "batch_no", "score")
    return _files(spark, d).where("batch_no = 2").select("path").distinct(), p.where("batch_no = 11 and score < 60"), p.where("batch_no = 10 and score >= 90")


def _keeper_sql(strategy: str, where: str = "true") -> str:
    """CTEs members and keeper of a strategy; the members here have no sidecars."""
    value = {"newest": "mtime", "oldest": "-mtime", "biggest": "file_size", "smallest": "-file_size", "longest": "duration", "highest-res": "width::BIGINT * height", "edited": "0"}[strategy]
    size = "0" if strategy in ("biggest", "smallest") else "file_size"
    return f"""{sql.MEMBERS}, c AS (SELECT group_id, path, {value} AS v, {size} AS s FROM members WHERE {value} IS NOT NULL AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY v DESC, s DESC NULLS LAST, path) AS k FROM c),
t AS (SELECT group_id, count(*) AS n, count(DISTINCT (v, s)) FILTER (WHERE s IS NOT NULL) AS d, min_by(path, k) AS path FROM r WHERE k <= 2 GROUP BY group_id), keeper AS (SELECT group_id, path FROM t WHERE n = 1 OR d = 2)"""


def _keepers(strategy: str) -> None:
    def run(spark, d):
        return groups.group_keeper(_members(spark, d), strategy)

    run.__name__ = f"keep_groups_{strategy.replace('-', '_')}"
    query(f"WITH {_keeper_sql(strategy)} SELECT group_id, path FROM keeper")(run)


for _s in ("oldest", "biggest", "smallest", "longest", "highest-res", "edited"):
    _keepers(_s)


# sorting and limits: the limit is the feature
def _sorted(by: str) -> None:
    def pairs(spark, d):
        return review.sort_pairs(_attached(spark, d), by).limit(100).select("path_a", "path_b", "score")

    def grouped(spark, d):
        return review.sort_groups(table(spark, d, GROUPS), by).limit(50).select("group_id")

    pairs.__name__, grouped.__name__ = f"o1_pairs_by_{by}", f"o2_groups_by_{by}"
    key = {"score": "score DESC,", "size": "coalesce(a.file_size, 0) + coalesce(b.file_size, 0) DESC,", "path": "", "mtime": "greatest(coalesce(a.mtime, 0.0), coalesce(b.mtime, 0.0)) DESC,"}[by]
    query(f"{ATT} SELECT path_a, path_b, score FROM att ORDER BY {key} path_a, path_b LIMIT 100")(pairs)
    key = {
        "score": "max_score DESC NULLS LAST", "size": "coalesce(list_sum(list_transform(files, lambda f: coalesce(f.file_size, 0))), 0) DESC", "path": "list_min(list_transform(files, lambda f: f.path)) ASC NULLS LAST",
        "mtime": "list_max(list_transform(files, lambda f: coalesce(f.mtime, 0.0))) DESC NULLS LAST",
    }[by]
    query(f"SELECT group_id FROM envelope_groups ORDER BY {key}, group_id LIMIT 50")(grouped)


for _b in ("score", "size", "path", "mtime"):
    _sorted(_b)

_IGNORED_AWAY = f"NOT EXISTS (SELECT 1 FROM ({IGNORED}) i WHERE least(i.path_a, i.path_b) = least(p.path_a, p.path_b) AND greatest(i.path_a, i.path_b) = greatest(p.path_a, p.path_b))"


@query(f"""WITH {sql.LATEST}, {sql.LINKED}, p AS (SELECT * FROM linked p WHERE {_IGNORED_AWAY} AND round(score, 1) >= 75)
SELECT p.path_a, p.path_b, p.score FROM p LEFT JOIN latest a ON a.path = p.path_a LEFT JOIN latest b ON b.path = p.path_b
ORDER BY coalesce(a.file_size, 0) + coalesce(b.file_size, 0) DESC, path_a, path_b LIMIT 200""")
def o5_finished_pairs(spark, d):
    """Ignored pairs off, then the least score, then sorted by size, then the limit."""
    return review.finish_pairs(_linked(spark, d), _decided(spark, d)[1], _latest(spark, d), 75.0, "size", 200).select("path_a", "path_b", "score")


# what people decided
@query(f"""WITH p AS (SELECT entry_id, path_a, path_b FROM scored_pairs p WHERE {_IGNORED_AWAY}), q AS (SELECT p.*,
EXISTS (SELECT 1 FROM ({RESOLVED}) r WHERE least(r.path_a, r.path_b) = least(p.path_a, p.path_b) AND greatest(r.path_a, r.path_b) = greatest(p.path_a, p.path_b)) AS resolved FROM p)
SELECT entry_id, resolved FROM q WHERE resolved OR NOT (path_a IN ({ACTIONED}) OR coalesce(path_b IN ({ACTIONED}), false))""")
def f13_active_pairs(spark, d):
    return review.active_pairs(table(spark, d, "scored_pairs").select("entry_id", "path_a", "path_b"), *_decided(spark, d)).select("entry_id", "resolved")


@query(f"""WITH {sql.MEMBERS}, g AS (SELECT m.group_id, count(*) AS n, count(*) FILTER (WHERE m.path IN ({ACTIONED})) AS k FROM members m JOIN envelope_groups e USING (group_id)
  WHERE coalesce(m.path <> e.keep, true) AND NOT coalesce(m.is_reference, false) GROUP BY 1),
ps AS (SELECT group_id, least(p.file_a, p.file_b) AS x, greatest(p.file_a, p.file_b) AS y FROM (SELECT group_id, unnest(pairs) AS p FROM envelope_groups)),
h AS (SELECT ps.group_id, count(*) AS n, count(i.x) AS k FROM ps LEFT JOIN (SELECT DISTINCT least(path_a, path_b) AS x, greatest(path_a, path_b) AS y FROM ({IGNORED})) i ON ps.x = i.x AND ps.y = i.y GROUP BY 1)
SELECT group_id FROM envelope_groups WHERE group_id NOT IN (SELECT group_id FROM g WHERE n = k) AND group_id NOT IN (SELECT group_id FROM h WHERE n = k)""")
def f14_active_groups(spark, d):
    actioned, ignored, _ = _decided(spark, d)
    return review.active_groups(table(spark, d, GROUPS), actioned, ignored).select("group_id")


@query("""WITH p AS (SELECT group_id, keep, files, unnest(pairs) AS p FROM envelope_groups), q AS (SELECT group_id, keep, p.file_a AS path_a, p.file_b AS path_b, p.score AS score,
list_filter(files, lambda f: f.path = p.file_a)[1] AS a, list_filter(files, lambda f: f.path = p.file_b)[1] AS b FROM p)
SELECT group_id, path_a, path_b, score, coalesce(a.file_size, 0) AS size_a, coalesce(b.file_size, 0) AS size_b, coalesce(a.is_reference, false) AS reference_a, coalesce(b.is_reference, false) AS reference_b,
CASE WHEN keep = path_a THEN 'a' WHEN keep = path_b THEN 'b' END AS keep FROM q""")
def a16_pairs_of_groups(spark, d):
    return review.pairs_of_groups(table(spark, d, GROUPS))


@query(f"""WITH {sql.MEMBERS} SELECT m.path, max(m.file_size) AS file_size FROM members m JOIN envelope_groups e USING (group_id)
WHERE m.path <> e.keep AND NOT coalesce(m.is_reference, false) AND m.path NOT IN ({ACTIONED}) GROUP BY 1""")
def a17_bulk_candidates(spark, d):
    return review.bulk_candidates(table(spark, d, GROUPS), _decided(spark, d)[0])


# totals of groups
@query(f"""WITH {_keeper_sql("newest", "NOT coalesce(is_reference, false)")} SELECT m.path, max(m.file_size) AS file_size FROM members m
WHERE NOT coalesce(is_reference, false) AND NOT EXISTS (SELECT 1 FROM keeper k WHERE k.group_id = m.group_id AND k.path = m.path) GROUP BY 1""")
def a6_recoverable_groups(spark, d):
    return review.recoverable_in_groups(_members(spark, d), "newest")


@query(f"""WITH {sql.MEMBERS}, g AS (SELECT group_id, bool_or(coalesce(is_reference, false)) AS has, max((coalesce(file_size, 0), path)) AS top FROM members GROUP BY 1),
f AS (SELECT m.path, max(coalesce(m.file_size, 0)) AS s FROM members m JOIN g USING (group_id) WHERE CASE WHEN has THEN NOT coalesce(m.is_reference, false) ELSE m.path <> top[2] END GROUP BY 1)
SELECT count(*) AS n_files, coalesce(sum(s), 0)::BIGINT AS bytes FROM f""")
def a11_space_groups(spark, d):
    return review.space_of_groups(_members(spark, d))


_BUNDLE = {
    "directory": ("a4_directory_stats", "directory", "recoverable_size"),
    "score": ("a7_score_histogram", "bin", "n"),
    "type": ("a8_filetypes", "extension", "bytes"),
    "day": ("a9_timeline", "day", "duplicate_files"),
}


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, {key}::VARCHAR AS name, {value}::BIGINT AS value FROM ({sql.SQL[q]})" for part, (q, key, value) in _BUNDLE.items()))
def a10_bundle(spark, d):
    """The four rollups in one table of (part, name, value)."""
    from echofold.plans.catalog import QUERIES as core

    parts = [core[q](spark, d).select(F.lit(part).alias("part"), F.col(key).cast("string").alias("name"), F.col(value).cast("long").alias("value")) for part, (q, key, value) in _BUNDLE.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# photo rules
def _photos(spark, d, kind):
    own = _latest(spark, d).where(names.media_type(F.col("path")) == kind)
    return own.select("path", names.normalize_filename(F.col("filename")).alias("name"), "duration", F.col("exif_datetime").alias("taken"), filters.pixels().alias("pixels"))


_LEV = "CASE WHEN greatest(length(a.words), length(b.words)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.words, b.words) / greatest(length(a.words), length(b.words)) END"
_PHOTO_NAME = f"CASE WHEN {scores_sql.EXCLUDED} OR ({_LEV} < 0.85 AND {scores_sql._OWN_WORD.format('a', 'b')} AND {scores_sql._OWN_WORD.format('b', 'a')}) THEN 0.0 ELSE {_LEV} END"
_VIDEO_KEY = "coalesce(trunc({0}.duration / 2)::BIGINT, -1)"
_IMAGE_KEY = f"coalesce(trunc(exif_datetime / 1800)::BIGINT::VARCHAR, {sql._tier(f'coalesce({sql.PIXELS}, 0)')})"


@query(f"""WITH {scores_sql.prepared("video")} SELECT a.path AS path_a, b.path AS path_b, {_VIDEO_KEY.format("a")} = {_VIDEO_KEY.format("b")} AS same_bucket FROM prep a JOIN prep b ON a.path < b.path
WHERE {_VIDEO_KEY.format("a")} = {_VIDEO_KEY.format("b")} OR {_PHOTO_NAME} >= 0.8""")
def j15_photo_video_pairs(spark, d):
    """Buckets of two seconds (J14), and across them names alike by 0.8."""
    return photos.video_pairs(_photos(spark, d, "video"))


@query(f"""WITH {scores_sql.prepared("image")}, k AS (SELECT *, {_IMAGE_KEY} AS bucket FROM prep WHERE name <> '') SELECT a.path AS path_a, b.path AS path_b FROM k a JOIN k b ON a.name = b.name AND a.path < b.path AND a.bucket <> b.bucket
WHERE a.exif_datetime IS NULL OR b.exif_datetime IS NULL OR abs(a.exif_datetime - b.exif_datetime) <= 120""")
def j16_photo_image_pairs(spark, d):
    return photos.image_pairs_across(_photos(spark, d, "image"))


_TAKEN = "CASE WHEN a.exif_datetime IS NOT NULL AND b.exif_datetime IS NOT NULL THEN CASE WHEN abs(a.exif_datetime - b.exif_datetime) <= 1 THEN 1.0 ELSE greatest(0.0, 1 - abs(a.exif_datetime - b.exif_datetime) / 3600.0) END END"


def _photo_exif() -> str:
    equal = lambda f: f"CASE WHEN a.{f} IS NOT NULL AND b.{f} IS NOT NULL THEN (a.{f} = b.{f})::INT::DOUBLE END"
    hav = "pow(sin((radians(b.exif_gps_lat) - radians(a.exif_gps_lat)) / 2), 2) + cos(radians(a.exif_gps_lat)) * cos(radians(b.exif_gps_lat)) * pow(sin(radians(b.exif_gps_lon - a.exif_gps_lon) / 2), 2)"
    near = f"CASE WHEN a.exif_gps_lat IS NOT NULL AND a.exif_gps_lon IS NOT NULL AND b.exif_gps_lat IS NOT NULL AND b.exif_gps_lon IS NOT NULL THEN greatest(0.0, 1 - 2 * 6371000.0 * asin(sqrt(least({hav}, 1.0))) / 1000.0) END"
    return scores_sql.weighted([(0.35, _TAKEN), (0.20, equal("exif_camera")), (0.10, equal("exif_lens")), (0.25, near)])


@query(f"{ATT} SELECT path_a, path_b, round({_photo_exif()}, 5) AS exif FROM att")
def c14_photo_exif(spark, d):
    return _attached(spark, d).select("path_a", "path_b", F.round(photos.exif(), 5).alias("exif"))


_WORDS_OF = "array_to_string(list_sort(list_filter(string_split(lower({0}), ' '), lambda t: t <> '')), ' ')"
_TITLE_LEV = f"CASE WHEN greatest(length({_WORDS_OF.format('a.tag_title')}), length({_WORDS_OF.format('b.tag_title')})) = 0 THEN 1.0 ELSE 1 - levenshtein({_WORDS_OF.format('a.tag_title')}, {_WORDS_OF.format('b.tag_title')}) / greatest(length({_WORDS_OF.format('a.tag_title')}), length({_WORDS_OF.format('b.tag_title')})) END"


@query(f"{ATT} SELECT path_a, path_b, round({_TITLE_LEV}, 6) AS ratio FROM att WHERE a.tag_title IS NOT NULL AND b.tag_title IS NOT NULL")
def x5_sorted_levenshtein(spark, d):
    x, y = F.lower("a.tag_title"), F.lower("b.tag_title")
    return _attached(spark, d).where("a.tag_title is not null and b.tag_title is not null").select("path_a", "path_b", F.round(photos.token_sort_levenshtein(x, y), 6).alias("ratio"))


# contents
_TFIDF = """d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)"""
_SAME_TITLE = """p AS (SELECT doc_id AS doc_a, lead(doc_id) OVER (PARTITION BY doc_title ORDER BY doc_id) AS doc_b FROM documents WHERE text IS NOT NULL AND doc_title IS NOT NULL)"""


@query(f"""WITH {_TFIDF}, {_SAME_TITLE}, s AS (SELECT doc_a, doc_b, sum(x.w / nx.n * y.w / ny.n) AS c FROM p JOIN w x ON x.doc_id = doc_a JOIN w y ON y.doc_id = doc_b AND y.term = x.term JOIN n nx ON nx.doc_id = doc_a JOIN n ny ON ny.doc_id = doc_b GROUP BY 1, 2)
SELECT p.doc_a, p.doc_b, round(coalesce(least(c, 1.0), 0.0), 5) AS cosine FROM p LEFT JOIN s USING (doc_a, doc_b) WHERE p.doc_b IS NOT NULL AND doc_a IN (SELECT doc_id FROM n) AND doc_b IN (SELECT doc_id FROM n)""")
def x9_tfidf_cosine(spark, d):
    """Each document with the next one of the same title, weights fitted on all documents."""
    docs = table(spark, d, "documents").where("text is not null")
    pairs = docs.where("doc_title is not null").select(F.col("doc_id").alias("doc_a"), F.lead("doc_id").over(Window.partitionBy("doc_title").orderBy("doc_id")).alias("doc_b")).where("doc_b is not null")
    got = fingerprints.tfidf_cosine(pairs, fingerprints.tfidf(docs, "doc_id", "text"), "doc_id", "doc_a", "doc_b")
    return got.select("doc_a", "doc_b", F.round("cosine", 5).alias("cosine"))


SQL["x9_tfidf_all"] = f"WITH {_TFIDF} SELECT doc_id, count(*) AS terms, round(sum(w / n), 5) AS total, round(max(w / n), 5) AS most FROM w JOIN n USING (doc_id) GROUP BY 1"
_POP = "list_sum(list_transform(range(1, 5), lambda k: bit_count(xor({0}[{1} + k], {2}[{3} + k]))))"
_ROT = "list_min(list_transform(range(len({1}) // 4), lambda j: " + _POP.format("{0}", "0", "{1}", "j * 4") + "))"
SQL["x8_rotated_similarity"] = f"""WITH h AS (SELECT * FROM content_hashes WHERE len(hashes) > 0), f AS (SELECT path, min(entry_id) AS e0 FROM h GROUP BY path)
SELECT h.entry_id, round(1 - least({_ROT.format("z.hashes", "h.hashes")}, {_ROT.format("h.hashes", "z.hashes")}) / 256.0, 6) AS similarity FROM h JOIN f ON h.path = f.path JOIN h z ON z.entry_id = f.e0
WHERE h.entry_id > f.e0 AND (coalesce(h.rotation_invariant, false) OR coalesce(z.rotation_invariant, false))"""


_COS = "CASE WHEN list_dot_product({0}::DOUBLE[], {0}::DOUBLE[]) > 0 AND list_dot_product({1}::DOUBLE[], {1}::DOUBLE[]) > 0 THEN list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]) ELSE 0.0 END"


@query(f"""WITH l AS (SELECT path, arg_max(embedding, (coalesce(mtime, -1), cached_at, embedding[1])) AS e, max(file_size) AS s FROM clip_embeddings WHERE len(embedding) = 512 GROUP BY 1),
p AS (SELECT path, e, lead(e) OVER w AS f, lead(e, 2) OVER w AS g FROM l WINDOW w AS (PARTITION BY s % 97 ORDER BY path))
SELECT path, round(greatest(0.0, least(1.0, greatest({_COS.format("e", "f")}, {_COS.format("e", "g")}))), 5) AS cosine FROM p WHERE f IS NOT NULL AND g IS NOT NULL""")
def x10_frames_cosine(spark, d):
    """Each cached image vector against a sequence of two frames, those of the next two paths of its size class."""
    e = table(spark, d, "clip_embeddings").where("size(embedding) = 512")
    last = e.groupBy("path").agg(F.max_by("embedding", F.struct(F.coalesce("mtime", F.lit(-1.0)), "cached_at", F.get("embedding", 0))).alias("e"), F.max("file_size").alias("s"))
    w = Window.partitionBy(F.col("s") % 97).orderBy("path")
    seq = last.select("path", "e", F.lead("e").over(w).alias("f"), F.lead("e", 2).over(w).alias("g")).where("f is not null and g is not null")
    return seq.select("path", F.round(fingerprints.frames_cosine(F.col("e"), F.concat("f", "g")), 5).alias("cosine"))


@query()
def score_image_content(spark, d):
    """Image pairs scored with perceptual hashes: the pass over similar contents and the content weights."""
    h = table(spark, d, "content_hashes").where("size(hashes) >= 4").groupBy("path").agg(F.max_by("hashes", "entry_id").alias("content_hash"))
    got = scoring.find_duplicates(_files(spark, d), "image", content=h, rotated=True)
    return got.select("path_a", "path_b", F.round("total", 6).alias("total"), "score", "identical", F.round(F.col("detail")["content"]["raw"], 6).alias("content"))


@query()
def score_audio_fingerprints(spark, d):
    h = table(spark, d, "audio_fingerprints").where("size(fingerprint) > 0").groupBy("path").agg(F.max_by("fingerprint", "entry_id").alias("audio_fingerprint"))
    got = scoring.find_duplicates(_files(spark, d), "audio", content=h)
    return got.select("path_a", "path_b", F.round("total", 6).alias("total"), "score", F.round(F.col("detail")["audio"]["raw"], 6).alias("audio"))


# caches, rates, overlap
@query("""WITH k AS (SELECT entry_id, path_a, path_b, score, detail, unnest(json_keys(detail)) AS name FROM scored_pairs WHERE score >= 50 AND NOT isnan(score) AND detail IS NOT NULL)
SELECT entry_id, name, round((detail::JSON -> name ->> 0)::DOUBLE * (detail::JSON -> name ->> 1)::DOUBLE, 6) AS part FROM k""")
def h3_cached_pairs(spark, d):
    own = review.cached_pairs(table(spark, d, "scored_pairs").where(~F.isnan("score")), digits=6)
    return own.select("entry_id", F.explode("breakdown").alias("name", "part"))


@query("""WITH b AS (SELECT config_hash, batch_no, count(*)::DOUBLE AS n FROM scored_pairs GROUP BY 1, 2), l AS (SELECT config_hash, list(n ORDER BY batch_no) AS ns FROM b GROUP BY 1)
SELECT config_hash, round(list_reduce(ns, lambda s, x: 0.3 * x + 0.7 * s), 6) AS rate FROM l""")
def w7_smoothed_rate(spark, d):
    """Moving average of rows a batch; a configuration has as many values as there are batches."""
    per = table(spark, d, "scored_pairs").groupBy("config_hash", "batch_no").agg(F.count("*").cast("double").alias("n"))
    lists = per.groupBy("config_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch_no", "n"))), lambda x: x["n"]).alias("ns"))
    return lists.select("config_hash", F.round(review.smoothed(F.col("ns")), 6).alias("rate"))


@query(f"""WITH b AS (SELECT batch_no, list(DISTINCT {sql._parent("path_a")}) AS dirs FROM scored_pairs GROUP BY 1)
SELECT x.batch_no, round(len(list_intersect(x.dirs, y.dirs)) / len(list_distinct(list_concat(x.dirs, y.dirs))), 6) AS overlap FROM b x JOIN b y ON y.batch_no = x.batch_no - 1""")
def x28_directory_overlap(spark, d):
    """How far the directories of two batches in a row are the same; their number is the directories', not the rows'."""
    per = table(spark, d, "scored_pairs").groupBy("batch_no").agg(F.collect_set(names.parent(F.col("path_a"))).alias("dirs"))
    before = per.select((F.col("batch_no") + 1).alias("batch_no"), F.col("dirs").alias("old"))
    return per.join(before, "batch_no").select("batch_no", F.round(review.overlap(F.col("dirs"), F.col("old")), 6).alias("overlap"))


# sources and reports
_BASENAME = "regexp_extract({0}, '([^/]*)$', 1)"
_EXTENSIONS = [e for x in (".xmp", ".aae", ".thm", ".json") for e in (x, x.upper())]


@query(f"""WITH {sql.LATEST}, inv AS (SELECT path FROM latest UNION SELECT unnest(sidecars) FROM latest), w AS (SELECT path, unnest([{", ".join(f"{n} || '{e}'" for n in (sql._stem("path"), _BASENAME.format("path")) for e in _EXTENSIONS)}, {sql._stem("path")} || '.lrdata']) AS side FROM latest),
g AS (SELECT path, list(DISTINCT side) AS sides FROM (SELECT w.path, {sql._parent("w.path")} || '/' || side AS side FROM w) x JOIN inv ON inv.path = x.side AND x.side <> x.path GROUP BY 1)
SELECT l.path, array_to_string(list_sort(coalesce(sides, [])), ',') AS sidecars FROM latest l LEFT JOIN g USING (path)""".replace("x JOIN inv ON inv.path = x.side AND x.side <> x.path GROUP BY 1", "x JOIN inv i ON i.path = x.side AND x.side <> x.path GROUP BY x.path").replace("g AS (SELECT path, list", "g AS (SELECT x.path AS path, list"))
def s18_found_sidecars(spark, d):
    """Sidecars found anew beside each file, in an inventory of all paths and of the sidecars known before."""
    own = _latest(spark, d)
    inventory = own.select(F.explode(F.concat(F.array("path"), F.coalesce("sidecars", F.array().cast("array<string>")))).alias("path"))
    return scan.sidecars(own, inventory).select("path", F.array_join("sidecars", ",").alias("sidecars"))


@query(f"{ATT} SELECT path_a, path_b, path_a AS file_a, score, a.file_size AS size_a, b.mtime AS mtime_b, coalesce(b.is_reference, false) AS reference_b FROM att")
def k1_pair_fields(spark, d):
    """The JSON records of k1_pair_records read back."""
    schema = "file_a string, score double, file_a_metadata struct<file_size:bigint>, file_b_metadata struct<mtime:double>, file_b_is_reference boolean"
    r = reports.pair_json(_attached(spark, d)).select("path_a", "path_b", F.from_json("record", schema).alias("r"))
    return r.select("path_a", "path_b", "r.file_a", "r.score", F.col("r.file_a_metadata.file_size").alias("size_a"), F.col("r.file_b_metadata.mtime").alias("mtime_b"), F.col("r.file_b_is_reference").alias("reference_b"))


@query(f"""{sql.REACH}, {sql.LATEST} SELECT root, count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS bytes, any_value(p.n) AS n_pairs, any_value(p.s) AS best
FROM roots LEFT JOIN latest USING (path) JOIN (SELECT root, count(*) AS n, max(score) AS s FROM linked JOIN roots ON path = path_a GROUP BY 1) p USING (root) GROUP BY root""")
def k8_group_fields(spark, d):
    """The JSON records of k8_group_records read back."""
    schema = "files array<struct<path:string,file_size:bigint>>, pairs array<struct<path_a:string,score:double>>"
    r = reports.group_json(_linked(spark, d), _latest(spark, d)).select("root", F.from_json("record", schema).alias("r"))
    size = F.aggregate("r.files", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["file_size"], F.lit(0)))
    return r.select("root", F.size("r.files").cast("long").alias("n_files"), size.alias("bytes"), F.size("r.pairs").cast("long").alias("n_pairs"), F.array_max(F.transform("r.pairs", lambda p: p["score"])).alias("best"))


SQL["k12_undo_lines"] = f"""WITH {sql.KEEPER}, n AS (SELECT group_id FROM members GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT DISTINCT m.path, k.path AS kept, '/trash/' || {_BASENAME.format("m.path")} AS destination
FROM members m JOIN keeper k USING (group_id) JOIN n USING (group_id) WHERE NOT coalesce(m.is_reference, false) AND m.path <> k.path) SELECT path, 'mv -n -- ' || {sql._QUOTE.format("destination")} || ' ' || {sql._QUOTE.format("path")} AS line, true AS reversible FROM x"""


@query("""WITH t AS (SELECT (SELECT count(*) FROM files) AS files_scanned, (SELECT count(*) FROM scored_pairs WHERE score IS NOT NULL AND NOT isnan(score)) AS total_pairs_scored,
(SELECT count(*) FROM envelope_groups) AS groups_count) SELECT * FROM t""")
def k2_envelope(spark, d):
    """The head of a run's envelope, read back from its JSON."""
    stats = _files(spark, d).agg(F.count("*").alias("files_scanned"))
    scored = table(spark, d, "scored_pairs").where(F.col("score").isNotNull() & ~F.isnan("score")).agg(F.count("*").alias("total_pairs_scored"))
    n = table(spark, d, GROUPS).agg(F.count("*").alias("groups_count"))
    made = reports.envelope(stats.crossJoin(scored).crossJoin(n), {"keep": "newest"})  # three frames of one row
    return made.select(F.from_json("envelope", "stats struct<files_scanned:bigint,total_pairs_scored:bigint,groups_count:bigint>").alias("e")).select("e.stats.*")


_DOC = "epoch(TRY_CAST(doc_created AS TIMESTAMPTZ))"


@query(f"WITH {sql.LATEST} SELECT path, strftime(make_timestamp((floor(exif_datetime) * 1000000)::BIGINT), '%Y-%m-%d') AS taken, trunc({_DOC} / 86400)::BIGINT AS created FROM latest WHERE exif_datetime IS NOT NULL OR doc_created IS NOT NULL")
def x29_dates(spark, d):
    own = _latest(spark, d).where("exif_datetime is not null or doc_created is not null")
    return own.select("path", F.date_format(F.timestamp_seconds("exif_datetime"), "yyyy-MM-dd").alias("taken"), (F.try_to_timestamp("doc_created").cast("double") / 86400).cast("long").alias("created"))


def _greedy() -> str:
    keep = sql._keep("a.file_size", "b.file_size", ">", True)
    return f"""WITH RECURSIVE {sql.BOTH}, k AS (SELECT path_a, path_b, score, {keep} AS keep, coalesce(a.is_reference, false) AS ra, coalesce(b.is_reference, false) AS rb FROM att),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, path_a, path_b) AS i, CASE keep WHEN 'a' THEN path_b ELSE path_a END AS loser, CASE keep WHEN 'a' THEN path_a ELSE path_b END AS kept FROM k
  WHERE keep IS NOT NULL AND NOT CASE keep WHEN 'a' THEN rb ELSE ra END),
s(i, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT o.i, CASE WHEN list_contains(gone, path_a) OR list_contains(gone, path_b) THEN gone ELSE list_append(gone, loser) END FROM s JOIN o ON o.i = s.i + 1)
SELECT o.loser AS path, o.kept, o.score FROM o JOIN s b ON b.i = o.i - 1 WHERE NOT list_contains(b.gone, o.path_a) AND NOT list_contains(b.gone, o.path_b)"""


SQL["delete_pairs"] = _greedy()
