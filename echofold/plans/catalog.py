"""The named queries of the core. Those with a twin in echofold.plans.sql are told in SQL there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.functions import fingerprints, formats, names
from echofold.operators import blocking, cache, comparators, filters, groups, scoring
from echofold.plans import reports, scores_sql, sql
from echofold.session import is_real, table
from echofold.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from echofold.plans import more

    return QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    from echofold.plans import more

    return {k: v for k, v in (sql.SQL | scores_sql.queries() | more.SQL).items() if k in QUERIES or k in more.QUERIES}


def _files(spark, d):
    return table(spark, d, "files")


def _latest(spark, d):
    return scoring.latest(_files(spark, d))


def _pairs(spark, d):
    """Scored pairs of two different files with a score."""
    return table(spark, d, "scored_pairs").where(is_real(F.col("score")) & (F.col("path_a") != F.col("path_b")))


def _linked(spark, d, least=70.0):
    """One row for two linked files: the best score, the smaller path first."""
    return filters.unordered(_pairs(spark, d)).where(F.col("score") >= least).groupBy("path_a", "path_b").agg(F.max("score").alias("score"))


def _attached(spark, d, least=70.0):
    side = _latest(spark, d)
    return scoring.attach(_linked(spark, d, least), side)


def _members(spark, d):
    """(group_id, path and attributes) of the duplicate groups, each entry that has a path."""
    return table(spark, d, "envelope_groups").select("group_id", F.explode("files").alias("f")).select("group_id", "f.*").where("path is not null")


# filters
@query
def f1_size(spark, d):
    return filters.metadata_filter(_files(spark, d), min_size=1_000_000, max_size=50_000_000).select("path", "file_size")


@query
def f2_duration(spark, d):
    return filters.metadata_filter(_files(spark, d), min_duration=60.0, max_duration=400.0).select("path", "duration")


@query
def f3_resolution(spark, d):
    return filters.metadata_filter(_files(spark, d), min_resolution=(1280, 720), max_resolution=(3840, 2160)).select("path", "width", "height")


@query
def f4_bitrate(spark, d):
    return filters.metadata_filter(_files(spark, d), min_bitrate=formats.parse_bitrate("100kbps"), max_bitrate=formats.parse_bitrate("5Mbps")).select("path", "bitrate")


@query
def f5_codec(spark, d):
    return filters.metadata_filter(_files(spark, d), codecs=["H264", "flac"]).select("path", "codec")


@query
def f6_all_filters(spark, d):
    return filters.metadata_filter(_files(spark, d), min_size=formats.parse_size("100KB"), min_duration=30.0, min_resolution=formats.parse_resolution("640x480"), max_bitrate=5_000_000, codecs=["h264", "hevc", "mp3", "flac", "png"]).select("path", "file_size", "duration", "codec")


@query
def f7_without_ignored(spark, d):
    p = table(spark, d, "scored_pairs")
    return filters.without_ignored(p, p.where("batch_no = 11 and score < 60")).select("entry_id")


@query
def f8_min_score(spark, d):
    return table(spark, d, "scored_pairs").where(F.round("score", 1) >= 72.5).select("entry_id", "score")


@query
def f10_touching(spark, d):
    return filters.touching(table(spark, d, "scored_pairs").select("entry_id", "path_a", "path_b"), _members(spark, d)).select("entry_id")


@query
def f11_directory(spark, d):
    p = table(spark, d, "scored_pairs")
    return p.where(filters.under(F.col("path_a"), ["/vault/old"]) | filters.under(F.col("path_b"), ["/vault/old"])).select("entry_id")


@query
def f12_search(spark, d):
    return filters.search(table(spark, d, "scored_pairs"), "Lighthouse").select("entry_id")


@query
def s8_media_counts(spark, d):
    return _files(spark, d).groupBy(names.media_type(F.col("path")).alias("media_type")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"))


@query
def s9_references(spark, d):
    return filters.tag_references(_files(spark, d), ["/vault/old", "/nas/media"]).groupBy("is_reference").agg(F.count("*").alias("n"))


@query
def s18_sidecars(spark, d):
    return _latest(spark, d).where("sidecars is not null").select("path", F.size("sidecars").alias("n"), F.array_join(F.array_sort("sidecars"), ",").alias("sidecars"))


# blocking and candidate pairs
def _audio(spark, d):
    return scoring.prepared(_latest(spark, d).where(names.media_type(F.col("path")) == "audio"))


def _audio_pairs(spark, d):
    """Pairs with what the native comparators look at, carried along by the join within buckets."""
    own = blocking.anchored_buckets(_audio(spark, d), "duration").withColumn("directories", comparators.directories(F.col("path")))
    return scoring.bucket_pairs(own, ("bucket",), carried=("duration", "file_size", "directories"))


@query
def j3_duration_buckets(spark, d):
    return blocking.anchored_buckets(_audio(spark, d), "duration").select("path", "bucket")


@query
def j4_page_buckets(spark, d):
    docs = _latest(spark, d).where(names.media_type(F.col("path")) == "document")
    return blocking.anchored_buckets(docs, "page_count").select("path", "bucket")


@query
def j5_resolution_tiers(spark, d):
    return _latest(spark, d).groupBy(blocking.resolution_tier(filters.pixels()).alias("tier")).agg(F.count("*").alias("n"))


@query
def j6_refined_buckets(spark, d):
    return blocking.refined_buckets(blocking.anchored_buckets(_audio(spark, d), "duration"), 40).select("path", "bucket", "sub")


@query
def j7_size_tiers(spark, d):
    return _latest(spark, d).groupBy(blocking.size_tier(F.col("file_size")).alias("tier")).agg(F.count("*").alias("n"))


@query
def j8_bucket_pairs(spark, d):
    return scoring.bucket_pairs(blocking.anchored_buckets(_audio(spark, d), "duration"), ("bucket",))


@query
def j9_similar_names(spark, d):
    docs = _latest(spark, d).where(names.media_type(F.col("path")) == "video")
    return scoring.similar_names(docs.select("path", names.normalize_filename(F.col("filename")).alias("name")))


@query
def j12_pair_hits(spark, d):
    return cache.pair_hits(table(spark, d, "scored_pairs"), _latest(spark, d)).select("entry_id")


@query
def j13_time_windows(spark, d):
    images = _latest(spark, d).where(names.media_type(F.col("path")) == "image")
    key = F.coalesce(blocking.time_window(F.col("exif_datetime")).cast("string"), blocking.resolution_tier(filters.pixels()))
    return images.groupBy(key.alias("bucket")).agg(F.count("*").alias("n"))


# comparators and scores
@query
def c_native_comparators(spark, d):
    shown = {"duration": comparators.duration(), "file_size": comparators.file_size(), "directory": comparators.directory(split=True)}
    return _audio_pairs(spark, d).select("path_a", "path_b", *[F.round(c, 6).alias(k) for k, c in shown.items()])


@query
def c3_resolution(spark, d):
    return _attached(spark, d).select("path_a", "path_b", F.round(comparators.resolution(), 6).alias("resolution"))


@query
def c5_exif(spark, d):
    return _attached(spark, d).select("path_a", "path_b", F.round(comparators.exif(), 5).alias("exif"))


@query
def c8_tags(spark, d):
    return _attached(spark, d).select("path_a", "path_b", F.round(comparators.tags(), 6).alias("tags"))


@query
def c10_pages_and_documents(spark, d):
    docs = scoring.prepared(_latest(spark, d).where(names.media_type(F.col("path")) == "document"))
    pairs = scoring.attach(scoring.bucket_pairs(blocking.anchored_buckets(docs, "page_count"), ("bucket",)), docs)
    return pairs.select("path_a", "path_b", F.round(comparators.page_count(), 6).alias("page_count"), F.round(comparators.document(), 6).alias("doc_meta"))


def _scored(mode):
    def run(spark, d):
        return scoring.find_duplicates(_files(spark, d), mode).select("path_a", "path_b", F.round("total", 6).alias("total"), "score", "identical")

    run.__name__ = f"score_{mode}"
    return query(run)


for _mode in ("video", "image", "audio", "document"):
    _scored(_mode)


@query
def score_auto(spark, d):
    """Video and image pairs in one list, never across the two."""
    return QUERIES["score_video"](spark, d).unionByName(QUERIES["score_image"](spark, d))


# functions
@query
def x1_normalized_names(spark, d):
    n = names.normalize_filename(F.col("filename"))
    return _latest(spark, d).select("path", n.alias("name"), names.is_numeric_id(n).alias("numeric"), names.skeleton(n).alias("skeleton"), names.sorted_tokens(n).alias("words"))


@query
def x3_ratios(spark, d):
    return _linked(spark, d).select("path_a", "path_b", F.round(names.ratio(names.basename(F.col("path_a")), names.basename(F.col("path_b"))), 6).alias("ratio"))


@query
def x5_levenshtein(spark, d):
    return _linked(spark, d).select("path_a", "path_b", F.round(names.levenshtein_ratio(names.stem(F.col("path_a")), names.stem(F.col("path_b"))), 6).alias("ratio"))


@query
def x6_simhash(spark, d):
    return fingerprints.simhash64(table(spark, d, "documents"), "doc_id", "text")


@query
def x8_hash_similarity(spark, d):
    h = table(spark, d, "content_hashes").where("size(hashes) > 0").select("entry_id", "path", "hashes", "rotation_invariant")
    first = h.groupBy("path").agg(F.min("entry_id").alias("entry_id"))
    base = h.join(first.select("entry_id"), "entry_id", "left_semi").select("path", F.col("hashes").alias("h0"), F.col("entry_id").alias("e0"))
    own = h.join(base, "path").where("entry_id > e0 and not rotation_invariant")
    return own.select("entry_id", F.round(fingerprints.hash_similarity(F.col("h0"), F.col("hashes")), 6).alias("similarity"))


@query
def x8_rotated_similarity(spark, d):
    """The rows that x8_hash_similarity leaves out, and those whose path's first row has several orientations."""
    h = table(spark, d, "content_hashes").where("size(hashes) > 0").select("entry_id", "path", "hashes", "rotation_invariant")
    first = h.groupBy("path").agg(F.min("entry_id").alias("entry_id"))
    base = h.join(first.select("entry_id"), "entry_id", "left_semi").select("path", F.col("hashes").alias("h0"), F.col("entry_id").alias("e0"), F.col("rotation_invariant").alias("r0"))
    own = h.join(base, "path").where("entry_id > e0 and (coalesce(rotation_invariant, false) or coalesce(r0, false))")
    return own.select("entry_id", F.round(fingerprints.rotated_similarity(F.col("h0"), F.col("hashes")), 6).alias("similarity"))


@query
def x9_tfidf_all(spark, d):
    """Over all documents."""
    w = fingerprints.tfidf(table(spark, d, "documents"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("most"))


@query
def x10_cosine(spark, d):
    e = table(spark, d, "embeddings")
    centre = e.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    base = e.join(centre.select("vec_id"), "vec_id", "left_semi").select("label", F.col("embedding").alias("e0"))
    return e.join(base, "label").select("vec_id", F.round(fingerprints.cosine(F.col("e0"), F.col("embedding")), 5).alias("cosine"))


@query
def x11_audio_similarity(spark, d):
    h = table(spark, d, "audio_fingerprints").where("size(fingerprint) > 0").select("entry_id", "path", "fingerprint")
    base = h.groupBy("path").agg(F.min("entry_id").alias("e0")).join(h.select(F.col("entry_id").alias("e0"), F.col("fingerprint").alias("h0")), "e0")
    return h.join(base, "path").where("entry_id > e0").select("entry_id", F.round(fingerprints.audio_similarity(F.col("h0"), F.col("fingerprint")), 6).alias("similarity"))


@query
def x20_shown_values(spark, d):
    c = F.col
    return _latest(spark, d).select(
        "path", formats.format_size(c("file_size")).alias("size"), formats.human_size(c("file_size")).alias("human"), formats.clock(c("duration")).alias("clock"), formats.show_resolution(c("width"), c("height")).alias("resolution"),
        formats.show_codec(c("codec")).alias("codec"), formats.even_bitrate(c("bitrate")).alias("even_bitrate"), formats.show_channels(c("audio_channels")).alias("channels"), formats.show_framerate(c("framerate")).alias("fps"),
    )


@query
def x25_score_bands(spark, d):
    return table(spark, d, "scored_pairs").where("score is not null").groupBy(formats.score_band(F.col("score")).alias("band"), formats.score_colour(F.col("score")).alias("colour")).agg(F.count("*").alias("n"))


@query
def x26_escapes(spark, d):
    return _latest(spark, d).select("path", formats.shell_quote(F.col("path")).alias("shell"), formats.html_text(F.col("tag_title")).alias("html"), formats.markdown_cell(F.col("tag_title")).alias("markdown"))


@query
def x27_paths(spark, d):
    p = F.col("path")
    return _latest(spark, d).select("path", names.stem(p).alias("stem"), names.suffix(p).alias("suffix"), names.parent(p).alias("parent"), names.home_short(p, "/home/shared").alias("short"))


@query
def x30_detail(spark, d):
    return cache.detail_rows(table(spark, d, "scored_pairs"))


# groups and analytics
@query
def a1_components(spark, d):
    return groups.connected(_linked(spark, d))


@query
def a2_groups(spark, d):
    return groups.group_pairs(_linked(spark, d)).withColumn("avg_score", F.round("avg_score", 6))


@query
def a3_unique_files(spark, d):
    return groups.unique_files(_linked(spark, d))


@query
def a4_directory_stats(spark, d):
    return groups.directory_stats(_attached(spark, d), _latest(spark, d)).withColumn("density", F.round("density", 6))


@query
def a5_recoverable(spark, d):
    return groups.recoverable(_attached(spark, d))


@query
def a7_score_histogram(spark, d):
    return groups.score_histogram(table(spark, d, "scored_pairs").where(is_real(F.col("score"))))


@query
def a8_filetypes(spark, d):
    return groups.filetype_breakdown(_latest(spark, d))


@query
def a9_timeline(spark, d):
    files = _latest(spark, d)
    return groups.timeline(files, files.join(groups.unique_files(_linked(spark, d)), "path", "left_semi"))


@query
def a11_space(spark, d):
    return groups.recoverable(_attached(spark, d)).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


# windows, sorts
@query
def w5_trend(spark, d):
    per = table(spark, d, "scored_pairs").groupBy("config_hash", "batch_no").agg(F.count("*").alias("n"))
    w = Window.partitionBy("config_hash").orderBy("batch_no")
    return per.withColumn("delta", F.col("n") - F.lag("n").over(w)).withColumn("percent", F.round(F.col("delta") * 100.0 / F.lag("n").over(w), 6))


@query
def w6_last_scans(spark, d):
    per = table(spark, d, "scored_pairs").groupBy("config_hash", "batch_no").agg(F.count("*").alias("n"))
    return per.withColumn("k", F.row_number().over(Window.partitionBy("config_hash").orderBy(F.desc("batch_no")))).where("k <= 10")


@query
def o1_top_pairs(spark, d):
    """The 100 best pairs: the limit is the feature."""
    return table(spark, d, "scored_pairs").where(is_real(F.col("score"))).orderBy(F.desc("score"), "path_a", F.asc_nulls_last("path_b"), "entry_id").limit(100).select("entry_id", "score")


@query
def o2_top_groups(spark, d):
    g = table(spark, d, "envelope_groups")
    size = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["file_size"], F.lit(0)))
    return g.select("group_id", "max_score", size.alias("bytes")).orderBy(F.desc_nulls_last("max_score"), F.desc("bytes"), "group_id").limit(50)


# keepers and plans
@query
def keep_pairs(spark, d):
    pairs = _attached(spark, d)
    return pairs.select("path_a", "path_b", *[groups.pick_keep(s).alias(s.replace("-", "_")) for s in ("newest", "oldest", "biggest", "smallest", "longest", "highest-res", "edited")])


@query
def keep_groups(spark, d):
    return groups.group_keeper(_members(spark, d), "newest")


@query
def delete_groups(spark, d):
    return groups.group_deletes(_members(spark, d), "newest")


@query
def delete_pairs(spark, d):
    p = _attached(spark, d).withColumn("keep", groups.pick_keep("biggest"))
    ref = lambda s: F.coalesce(F.col(f"{s}.is_reference"), F.lit(False)).alias(f"ref_{s}")
    return groups.auto_delete(p.select("path_a", "path_b", "score", "keep", ref("a"), ref("b")))


# caches
@query
def h1_cache_hits(spark, d):
    return cache.hits(_latest(spark, d), table(spark, d, "content_hashes")).select("entry_id")


@query
def h1_cache_misses(spark, d):
    images = _latest(spark, d).where(names.media_type(F.col("path")) == "image")
    return cache.misses(images, table(spark, d, "content_hashes")).select("path")


@query
def a13_cache_counts(spark, d):
    f = _latest(spark, d)
    counts = [cache.hit_counts(f, table(spark, d, t)).withColumn("cache", F.lit(t)) for t in ("content_hashes", "audio_fingerprints", "clip_embeddings")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def h4_prune(spark, d):
    return cache.prune(table(spark, d, "scored_pairs"), _files(spark, d)).select("entry_id")


# reports
@query
def k1_pair_records(spark, d):
    return reports.pair_json(_attached(spark, d))


@query
def k4_shell_lines(spark, d):
    return reports.shell_lines(_attached(spark, d).withColumn("keep", groups.pick_keep("biggest")))


@query
def k8_group_records(spark, d):
    return reports.group_json(_linked(spark, d), _latest(spark, d))


@query
def k9_group_rows(spark, d):
    return reports.group_rows(table(spark, d, "envelope_groups"))


@query
def k12_undo_lines(spark, d):
    return reports.undo_lines(reports.planned_actions(groups.group_deletes(_members(spark, d), "newest"), groups.group_keeper(_members(spark, d), "newest")))


@query
def k13_dry_run(spark, d):
    doomed = groups.group_deletes(_members(spark, d), "newest").join(_latest(spark, d).select("path", "file_size", "sidecars"), "path")
    return reports.dry_run(doomed)


@query
def s19_replay(spark, d):
    return reports.replay_groups(table(spark, d, "envelope_groups"))


@query
def t1_incremental_alerts(spark, d):
    return watch.replayed_alerts(spark, f"{d}/files.parquet", uuid.uuid4().hex)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents within a page-count bucket whose SimHashes agree in nine of ten bits."""
    docs = table(spark, d, "documents").where("text is not null")
    prints = fingerprints.simhash64(docs, "doc_id", "text").join(docs.select("doc_id", "page_count"), "doc_id")
    own = prints.where("simhash is not null").withColumn("path", F.col("doc_id"))
    pairs = scoring.bucket_pairs(blocking.anchored_buckets(own, "page_count"), ("bucket",)).toDF("doc_a", "doc_b")
    side = lambda s: prints.select(F.col("doc_id").alias(f"doc_{s}"), F.col("simhash").alias(f"h_{s}"))
    both = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b")
    return both.select("doc_a", "doc_b", fingerprints.simhash_similarity(F.col("h_a"), F.col("h_b")).alias("similarity")).where("similarity >= 0.9")
