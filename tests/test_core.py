import json
import math
import random
import zipfile
import zlib

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from echofold.functions import alike, fingerprints, formats, names
from echofold.operators import blocking, cache, comparators, filters, groups, scoring, weighed
from echofold.plans import reports
from echofold.sources import scan
from echofold.streaming import watch

FILE = (
    "path string, filename string, duration double, width int, height int, file_size long, codec string, bitrate long, mtime double, is_reference boolean, pre_hash string, exif_datetime double, exif_camera string, exif_lens string, "
    "exif_gps_lat double, exif_gps_lon double, exif_width int, exif_height int, tag_title string, tag_artist string, tag_album string, page_count int, doc_title string, doc_author string, doc_created string, sidecars array<string>, scanned_at timestamp"
)
COLUMNS = [c.split()[0] for c in FILE.split(", ")]


def files(spark, *rows):
    return spark.createDataFrame([tuple(({"file_size": 1000} | r).get(c) for c in COLUMNS) for r in rows], FILE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_common_length_equals_the_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert names.common_length(a, b) == t[-1][-1]


def test_names(spark):
    n = lambda s: one(spark, names.normalize_filename(F.lit(s)))
    assert n("My.Movie_[2020] 1080p x264") == "my movie 2020" and n("a_1080p") == "a 1080p" and n("") == ""
    assert one(spark, names.is_numeric_id(F.lit("img 12345"))) and not one(spark, names.is_numeric_id(F.lit("")))
    assert round(names.indel_ratio("kitten", "sitting"), 3) == 0.615 and names.indel_ratio("", "") == 1.0
    assert [one(spark, names.stem(F.lit(p))) for p in ("/a/.bashrc", "/a/c.tar.gz", "x")] == [".bashrc", "c.tar", "x"]
    assert one(spark, names.parent(F.lit("/a"))) == "/" and one(spark, names.suffix(F.lit("/a/B.MP4"))) == ".mp4"


def test_formats(spark):
    assert formats.parse_size("1.5GB") == 3 << 29 and formats.parse_bitrate("5Mbps") == 5_000_000 and formats.parse_resolution("640x480") == (640, 480)
    for bad, f in (("x", formats.parse_size), ("0x5", formats.parse_resolution), ("5 apples", formats.parse_bitrate)):
        with pytest.raises(ValueError):
            f(bad)
    assert one(spark, formats.human_size(F.lit(2048))) == "2.0 KB" and one(spark, formats.format_size(F.lit(10485760))) == "10MB"
    assert one(spark, formats.clock(F.lit(3661.5))) == "1:01:01" and one(spark, formats.shell_quote(F.lit("a'b"))) == "'a'\"'\"'b'"
    assert one(spark, formats.size_from(F.lit("2KB"))) == 2048 and one(spark, formats.size_from(F.lit("x"))) is None


def test_filters_let_the_unknown_pass(spark):
    df = files(spark, {"path": "a", "duration": 10.0, "codec": "H264"}, {"path": "b", "file_size": 5}, {"path": "c", "duration": 99.0}, {"path": "d", "width": 10, "height": 10})
    got = filters.metadata_filter(df, min_size=100, max_duration=50, codecs=["h264"], min_resolution=(20, 20))
    assert {r.path for r in got.collect()} == {"a"}


def test_anchored_buckets(spark):
    df = files(spark, *[{"path": f"p{i}", "duration": v} for i, v in enumerate((0.0, 1.0, 3.9, 4.0, 4.1, 8.0, 8.2, 50.0, None))])
    got = {r.path: r.bucket for r in blocking.anchored_buckets(df, "duration").collect()}
    assert got == {"p0": 0.0, "p1": 0.0, "p2": 0.0, "p3": 0.0, "p4": 4.1, "p5": 4.1, "p8": None}
    assert blocking.anchored_buckets(df.limit(0), "duration").count() == 0


def test_tiers(spark):
    tier = [one(spark, blocking.resolution_tier(F.lit(p).cast("long"))) for p in (153600, 153601, 3686401, None)]
    assert tier == ["ld", "sd", "uhd", "unknown"]
    assert [one(spark, blocking.size_tier(F.lit(s))) for s in (0, 1 << 20, 1 << 10, 5 << 20)] == [-1, 0, -3, 2]


def test_refinement_keeps_small_buckets_whole(spark):
    df = files(spark, *[{"path": f"p{i}", "duration": 1.0, "width": 100 if i % 2 else 2000, "height": 100} for i in range(6)]).withColumn("bucket", F.lit(1.0))
    assert {r["sub"] for r in blocking.refined_buckets(df, 100).collect()} == {""}
    assert {r["sub"] for r in blocking.refined_buckets(df, 5).collect()} == {"ld", "sd"}


def test_comparators(spark):
    df = files(
        spark,
        {"path": "/x/y/a.mp4", "filename": "a", "duration": 10.0, "width": 10, "height": 10, "exif_camera": "c", "page_count": 4},
        {"path": "/x/z/b.mp4", "filename": "b", "duration": 12.0, "width": 20, "height": 10, "file_size": 0, "exif_camera": "c", "exif_datetime": 5.0, "page_count": 0},
    )
    p = scoring.attach(spark.createDataFrame([("/x/y/a.mp4", "/x/z/b.mp4")], "path_a string, path_b string"), scoring.prepared(df))
    r = p.select(comparators.duration().alias("d"), comparators.resolution().alias("r"), comparators.file_size().alias("s"), comparators.exif().alias("e"), comparators.directory().alias("f"), comparators.page_count().alias("p"), comparators.tags().alias("t")).first()
    assert (round(r.d, 6), r.r, r.s, r.e, r.f, r.p, r.t) == (0.6, 0.5, 0.0, 1.0, 0.8, 0.0, None)


def test_scores_gate_identical_and_byte_equal(spark):
    rows = [
        {"path": "/a/song one.mp3", "filename": "song one", "duration": 100.0, "tag_title": "song one", "file_size": 7, "pre_hash": "h1"},
        {"path": "/b/song_one.mp3", "filename": "song_one", "duration": 101.0, "tag_title": "x", "file_size": 7, "pre_hash": "h2"},
        {"path": "/c/other name.mp3", "filename": "other name", "duration": 100.0, "tag_title": "song one", "file_size": 9, "pre_hash": "h3"},
        {"path": "/d/wholly different.mp3", "filename": "wholly different", "duration": 102.0, "file_size": 9, "pre_hash": "h3"},
        {"path": "/e/no time.mp3", "filename": "no time"},
    ]
    sums = spark.createDataFrame([("/c/other name.mp3", "s"), ("/d/wholly different.mp3", "s")], "path string, sha256 string")
    got = {(r.path_a[1], r.path_b[1]): (r.score, r.breakdown, r.detail) for r in scoring.find_duplicates(files(spark, *rows), "audio", sha256=sums).collect()}
    assert got["a", "b"][0] == 100.0 and got["c", "d"][:2] == (100.0, {"byte_identical": 100.0}) and set(got) == {("a", "b"), ("c", "d")}
    assert got["a", "b"][2]["duration"].raw == 0.8 and "tags" in got["a", "b"][2]
    plain = scoring.find_duplicates(files(spark, *rows), "audio").collect()  # one block's hash alone proves nothing
    assert {(r.path_a[1], r.path_b[1]) for r in plain} == {("a", "b")}


def test_content_pass_and_comparators(spark):
    rows = [{"path": f"/{i}/{n}.png", "filename": n, "width": w, "height": w, "exif_camera": c} for i, (n, w, c) in enumerate((("harbour", 100, "c"), ("IMG 77", 3000, "c"), ("lake", 900, "c")))]
    h = spark.createDataFrame([("/0/harbour.png", [1, 2, 3, 4]), ("/1/IMG 77.png", [1, 2, 3, 5]), ("/2/lake.png", [-1, -1, -1, -1])], "path string, content_hash array<long>")
    got = {(r.path_a, r.path_b): r for r in scoring.find_duplicates(files(spark, *rows), "image", content=h).collect()}
    assert set(got) == {("/0/harbour.png", "/1/IMG 77.png")} and round(got["/0/harbour.png", "/1/IMG 77.png"].detail["content"].raw, 6) == round(1 - 1 / 256, 6)
    assert {(r.path_a, r.path_b) for r in scoring.content_pairs(h).collect()} == {("/0/harbour.png", "/1/IMG 77.png")}
    own = scoring.find_duplicates(files(spark, *rows), "image", weights={"mine": 100}, extra={"mine": F.lit(1.0)}).collect()
    assert len(own) == 0 or all(r.score == 100.0 for r in own)
    assert scoring.content_pairs(h.limit(0)).count() == 0


def test_content_pairs_lose_none(spark):
    rnd = random.Random(3)
    base = [[rnd.getrandbits(63) for _ in range(4)] for _ in range(12)]
    near = [[v ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for v in h] for h in base]
    rows = [(f"p{i:02}", h) for i, h in enumerate(base + near)]
    d = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
    true = {(a, b) for a, x in rows for b, y in rows if a < b and d(x, y) <= 12}
    got = {(r.path_a, r.path_b) for r in scoring.content_pairs(spark.createDataFrame(rows, "path string, content_hash array<long>")).collect()}
    assert got == true and len(true) >= 12


def test_content_pairs_broadcast_nothing(spark):
    # the 13 keys of each of a file's hashes look like a few bytes to Spark, whose estimate would have them gathered in the driver
    h = spark.range(9).select(F.col("id").cast("string").alias("path"), F.array_repeat("id", 32).alias("content_hash")).checkpoint()
    plan = scoring.content_pairs(h)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_large_buckets_meet_in_blocks(spark):
    df = spark.createDataFrame([(f"p{i:03}", None if i < 70 else float(i % 3)) for i in range(100)], "path string, bucket double")
    pairs = scoring.bucket_pairs(df, ("bucket",), block=8)
    got = [(r.path_a, r.path_b) for r in pairs.collect()]
    true = {(f"p{i:03}", f"p{j:03}") for i in range(100) for j in range(i + 1, 100) if (i < 70) == (j < 70) and (i < 70 or i % 3 == j % 3)}
    assert len(got) == len(true) and set(got) == true


def test_exif_sizes_need_known_sizes(spark):
    df = files(spark, {"path": "/a.png", "filename": "a", "exif_width": 10, "exif_height": 10, "width": 10, "height": 10}, {"path": "/b.png", "filename": "b", "exif_width": 10, "exif_height": 10})
    p = scoring.attach(spark.createDataFrame([("/a.png", "/b.png")], "path_a string, path_b string"), scoring.prepared(df))
    assert p.select(comparators.exif().alias("e")).first().e is None


def test_similar_names_lose_no_pair(spark):
    words = ["movie part one", "movie part onee", "one part movie", "holiday beach", "holiday beech", "img 1234", "img 1235", "a", "ab", "the long winter story", "long winter stories", "harbour", "harbor"]
    df = spark.createDataFrame([(f"/{i}", w) for i, w in enumerate(words)], "path string, name string")
    got = {(r.path_a, r.path_b) for r in scoring.similar_names(df).collect()}
    key = lambda w: " ".join(sorted(w.split()))
    true = {tuple(sorted((f"/{i}", f"/{j}"))) for i, x in enumerate(words) for j, y in enumerate(words) if i < j and names.indel_ratio(key(x), key(y)) >= 0.8} - {("/5", "/6")}
    assert got == true


def test_gate_within_buckets_loses_no_pair(spark):
    rnd = random.Random(5)
    words = ["harbour", "harbor", "lake", "copy", "final", "img", "dsc", "ab", "été", "12", "1234", "7", "x" * 70, "y" * 300]
    rows = [(f"/{i:03}", " ".join(rnd.choice(words) + rnd.choice(["", "s", "1"]) for _ in range(rnd.randint(1, 3))), rnd.choice([None, 1.0, 2.0])) for i in range(150)] + [("/y", "", 1.0), ("/z", "", 1.0), ("/n", None, 1.0)]
    df = spark.createDataFrame(rows, "path string, name string, bucket double")
    both = scoring.attach(scoring.bucket_pairs(df, ("bucket",)), df)
    value = F.col("a.name").eqNullSafe(F.col("b.name")) & F.col("a.name").isNotNull() | (comparators.filename(names.ratio(*[names.sorted_tokens(F.col(f"{s}.name")) for s in "ab"])) >= scoring.GATE)
    true = {(r.path_a, r.path_b) for r in both.where(value).collect()}
    for block in (16, 8192):
        got = [(r.path_a, r.path_b) for r in scoring.gated_pairs(df, ("bucket",), block).collect()]
        assert true <= set(got) and len(got) == len(set(got)) < both.count() / 2 and len(true) > 100


def test_scored_buckets_shuffle_no_pairs_that_the_gate_drops(spark):
    rows = [{"path": f"/{i}/{a}{b}.png", "filename": f"{a} {b}", "width": 10, "height": 10, "exif_camera": "c"} for i, (a, b) in enumerate((a, b) for a in ("harbour", "lake", "quarry", "violin") for b in ("red", "dusk", "moth", "upper", "jigsaw"))]
    own = scoring.prepared(files(spark, *rows)).withColumn("bucket", F.lit("ld"))
    assert scoring.gated_pairs(own, ("bucket",)).count() == 0 and scoring.bucket_pairs(own, ("bucket",)).count() == 190


def test_native_comparators_carry_what_they_compare(spark):
    df = files(spark, {"path": "/a.mp3", "filename": "a", "duration": 1.0, "file_size": 5}, {"path": "/b.mp3", "filename": "b", "duration": 2.0})
    got = scoring.bucket_pairs(df.withColumn("bucket", F.lit(1.0)), ("bucket",), carried=("duration", "file_size"))
    assert [(r.path_a, r.a.duration, r.b.duration, r.a.file_size, r.b.file_size) for r in got.collect()] == [("/a.mp3", 1.0, 2.0, 5, 1000)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3  # the blocks of either side and their meeting


def test_same_answer_for_any_number_of_partitions(spark):
    rows = [{"path": f"/{i}/clip {i % 3} of many.mp3", "filename": f"clip {i % 3} of many", "duration": float(i % 5)} for i in range(30)]
    answers = []
    for n in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(sorted((r.path_a, r.path_b, r.score) for r in scoring.find_duplicates(files(spark, *rows), "audio").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert answers[0] == answers[1] == answers[2] and answers[0]


def test_simhash_of_short_texts(spark):
    df = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "a b"), (5, "a  b")], "k long, t string")
    got = {r.k: r.simhash for r in fingerprints.simhash64(df, "k", "t").collect()}
    assert got[1] is got[2] is got[3] is None and got[4] == got[5] is not None


def test_sliding_similarity(spark):
    a = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    assert one(spark, fingerprints.hash_similarity(a(1, 2, 3, 4), a(9, 9, 9, 9, 1, 2, 3, 4))) == 1.0
    assert one(spark, fingerprints.audio_similarity(a(1, 2), a(5, 1, 2))) == 1.0
    assert one(spark, fingerprints.rotated_similarity(a(1, 2, 3, 4), a(0, 0, 0, 0, 1, 2, 3, 4))) == 1.0


def test_components_chain_and_hub(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}", 1.0) for i in range(100)] + [("hub", f"x{i}", 2.0) for i in range(20)] + [("z", "z", 1.0)]
    df = spark.createDataFrame(edges, "path_a string, path_b string, score double")
    got = {r.path: r.root for r in groups.connected(df).collect()}
    assert set(got.values()) == {"c000", "hub"} and len(got) == 122
    g = groups.group_pairs(df).orderBy("group_id").collect()
    assert [(r.group_id, r.root, r.n_files) for r in g] == [(1, "hub", 21), (2, "c000", 101)]


def test_keepers(spark):
    m = "group_id int, path string, file_size long, mtime double, duration double, width int, height int, is_reference boolean, sidecars array<string>"
    rows = [(1, "a", 5, 1.0, None, 1, 1, False, []), (1, "b", 6, 1.0, None, 1, 1, True, []), (2, "c", 5, 1.0, None, 1, 1, None, []), (2, "d", 5, 1.0, None, 1, 1, None, []), (3, "e", 5, None, None, 1, 1, None, None), (4, "f", 5, 1.0, None, 1, 1, None, ["s"]), (4, "g", 5, 1.0, None, 1, 1, None, [])]
    df = spark.createDataFrame(rows, m)
    assert {r.group_id: r.path for r in groups.group_keeper(df, "newest").collect()} == {1: "b", 4: "f"}
    assert {r.group_id: r.path for r in groups.group_keeper(df, "biggest").collect()} == {1: "b", 3: "e"}
    assert {r.path for r in groups.group_deletes(df, "newest").collect()} == {"a", "g"}


def test_auto_delete_is_greedy(spark):
    rows = [("a", "b", 90.0, "a", False, False), ("b", "c", 80.0, "a", False, False), ("c", "d", 70.0, "b", False, False), ("e", "f", 60.0, "a", False, True), ("g", "h", 60.0, None, False, False)]
    df = spark.createDataFrame(rows, "path_a string, path_b string, score double, keep string, ref_a boolean, ref_b boolean")
    assert {r.path for r in groups.auto_delete(df).collect()} == {"b", "c"}


def test_histogram_puts_100_last(spark):
    df = spark.createDataFrame([(100.0,), (94.9,), (85.0,), (None,)], "score double")
    assert {r.bin: r.n for r in groups.score_histogram(df).collect()} == {85: 1, 90: 1, 95: 1}
    assert groups.score_histogram(df.limit(0)).count() == 0


def test_caches(spark):
    f = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "path string, file_size long, mtime double")
    c = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 2.0, "y"), ("z", 1, 1.0, "w")], "path string, file_size long, mtime double, v string")
    assert [r.v for r in cache.hits(f, c).collect()] == ["x"] and [r.path for r in cache.misses(f, c).collect()] == ["b"]
    assert {r.v for r in cache.prune(c, f).collect()} == {"x", "y"}
    assert cache.hit_counts(f, c).first().asDict() == {"hits": 1, "misses": 1}
    fresh = spark.createDataFrame([("b", 1, 3.0, "n")], c.schema)
    assert {r.v for r in cache.store(c, fresh).collect()} == {"x", "w", "n"}


def test_sources(spark, tmp_path):
    (tmp_path / "sub/deep").mkdir(parents=True)
    for p, text in (("a.MP4", "x"), ("sub/b.txt", "l1\nl2"), ("sub/deep/c.txt", ""), ("sub/b.xmp", ""), ("sub/skip.log", "x")):
        (tmp_path / p).write_text(text)
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("docProps/core.xml", '<c xmlns:dc="u"><dc:title>T</dc:title><dc:creator>A</dc:creator></c>')
        z.writestr("word/document.xml", "<w:p>" * 9)
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type /Pages /Title (Hi) /CreationDate (D:20240131120000Z)")
    got = scan.scan(spark, [str(tmp_path)], exclude=["**/*.log"])
    assert {r.filename for r in got.collect()} == {"a", "b", "c", "d", "e"} and got.count() == 6
    assert scan.scan(spark, [str(tmp_path)], recursive=False, suffixes=[".mp4"]).count() == 1
    with pytest.raises(FileNotFoundError):
        scan.scan(spark, [str(tmp_path / "none")])
    docs = {r.path.rsplit("/", 1)[1]: r for r in scan.documents(spark, got.where("path like '%.txt' or path like '%.docx' or path like '%.pdf'")).collect()}
    assert docs["b.txt"].page_count == 2 and docs["c.txt"].page_count == 0 and docs["d.docx"].doc_title == "t" and docs["d.docx"].page_count == 2
    assert docs["e.pdf"].page_count == 1 and docs["e.pdf"].doc_created == "2024-01-31T12:00:00+00:00"
    assert docs["e.pdf"].doc_title == "hi"
    packed = zlib.compress(b"<< /Type /Page >> << /Type /Page >> /Title <FEFF00C400620063> /Author ( A \\(b\\) \\101 )")
    title, author, _, pages = scan._pdf(b"%PDF-1.5 5 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + packed + b"\nendstream")
    assert (title, author, pages) == ("äbc", "a (b) a", 2) and scan._pdf(b"no pdf")[3] is None
    side = {r.path.rsplit("/", 1)[1]: r.sidecars for r in scan.sidecars(got.where("path like '%.txt'"), got).collect()}
    assert side["b.txt"] == [str((tmp_path / "sub/b.xmp").resolve())] and side["c.txt"] == []


def test_sidecars_need_no_join(spark):
    own = spark.createDataFrame([("/a/x.mp4",), ("/a/x.mp4.xmp",), ("/a/x.xmp",), ("/b/y.mp4",), (None,)], "path string")
    got = scan.sidecars(own, own.unionByName(spark.createDataFrame([("/a/x.xmp",), ("/a/x.lrdata",), ("/c/y.xmp",)], "path string")))
    want = ["/a/x.lrdata", "/a/x.mp4.xmp", "/a/x.xmp"]
    assert sorted(((r.path or "", r.sidecars) for r in got.collect())) == [("", []), ("/a/x.mp4", want), ("/a/x.mp4.xmp", []), ("/a/x.xmp", ["/a/x.lrdata"]), ("/b/y.mp4", [])]
    assert "Join" not in got._jdf.queryExecution().toString()  # nothing that a driver would have to broadcast


def test_logs_lists_and_envelopes(spark, tmp_path):
    (tmp_path / "log").write_text('{"action":"moved","path":"/a"}\n\nnonsense\n{"path":"/b"}\n{"action":"moved","path":"/c","dry_run":true}\n[1]\n')
    actions, counts = scan.read_actions(spark, str(tmp_path / "log"))
    assert [r.path for r in actions.collect()] == ["/a"] and counts.first().asDict() == {"lines": 5, "malformed": 3}
    scan.write_ignored(spark.createDataFrame([("b", "a")], "path_a string, path_b string"), str(tmp_path / "i"))
    assert [tuple(r) for r in scan.read_ignored(spark, str(tmp_path / "i")).collect()] == [("a", "b")] and scan.read_ignored(spark, str(tmp_path / "no")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"groups": [{"group_id": 1, "pairs": [{"file_a": "x", "file_b": "y", "score": 1.0}] * 2}]}))
    assert scan.read_envelope(spark, str(tmp_path / "e.json")).count() == 1
    (tmp_path / "bare.json").write_text("[1]")
    with pytest.raises(ValueError):
        scan.read_envelope(spark, str(tmp_path / "bare.json"))
    (tmp_path / "c.toml").write_text('threshold = 60\nmode = 5\n')
    assert scan.read_config(str(tmp_path / "c.toml"), overrides={"x": 1, "mode": None}, defaults={"threshold": 50, "mode": "video"}) == {"threshold": 60, "mode": "video", "x": 1}


def test_reports(spark):
    p = spark.createDataFrame([("/a|b", "/c d", 88.04, {"filename": 30.0, "duration": None, "tags": 40.0})], "path_a string, path_b string, score double, breakdown map<string,double>")
    assert reports.markdown_rows(p).first().row == "| /a\\|b | /c d | 88.0 | tags |"
    assert reports.pair_csv(p, ["filename", "duration"]).first().duration == ""
    a = spark.createDataFrame([("moved", "/x y", "/k", "/t/x y"), ("deleted", "/z", "/k", None), ("symlinked", "/l", "/k", None)], "action string, path string, kept string, destination string")
    assert [r.reversible for r in reports.undo_lines(a).collect()] == [True, False, True]


WATCHED = "path string, duration double, width int, height int, file_size long, mtime double"


def test_watch_finds_copies_within_and_across_batches(spark, tmp_path):
    put = lambda n, rows: spark.createDataFrame([(p, d, 10, 10, s, m) for p, d, s, m in rows], WATCHED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: watch.watch(spark.readStream.schema(WATCHED).parquet(str(tmp_path / "in")), str(tmp_path / "known"), str(tmp_path / "alerts"), str(tmp_path / "state")).awaitTermination()
    put(0, [("/a/clip.mp4", 60.0, 100, 1.0), ("/b/clip.mp4", 60.5, 100, 1.0), ("/c/other thing.mp3", 60.0, 100, 1.0)])
    run()
    put(1, [("/d/clip1.mp4", 61.0, 100, 1.0), ("/a/clip.mp4", 60.0, 100, 1.0)])
    run()
    got = {(r.path, r.match) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    assert got == {("/b/clip.mp4", "/a/clip.mp4"), ("/d/clip1.mp4", "/a/clip.mp4"), ("/d/clip1.mp4", "/b/clip.mp4")}
    (tmp_path / "known/batch=0").joinpath("broken.parquet").write_text("no parquet")
    put(2, [("/e/clip.mp4", 60.0, 100, 1.0)])
    with pytest.raises(Exception):  # noqa: B017  known files that can't be read don't count as none
        run()


def test_alerts_count_unknown_aspects_as_zero(spark):
    new = [("/a/holiday clip.mp4", None, 10, 10, 100, 1.0), ("/a/garden.png", None, None, None, 100, 1.0), ("/a/lake.png", None, 10, 10, 0, 1.0), ("/a/x.md", None, None, None, 100, 1.0)]
    known = [("/b/holiday clip.mp4", 61.0, 10, 10, 100, 1.0), ("/b/garden.png", None, 10, 10, 100, 1.0), ("/b/lake.png", None, 10, 10, 0, 1.0), ("/b/lake.mp3", None, 10, 10, 0, 1.0), ("/b/x.md", None, None, None, 80, 1.0), (None, 1.0, 1, 1, 1, 1.0)]
    df = lambda rows: spark.createDataFrame(rows, WATCHED)
    run = lambda t: {(r.path, r.match): r.score for r in watch.alerts(df(new), df(known), t).collect()}
    assert run(85.0) == {("/a/lake.png", "/b/lake.png"): 100, ("/a/x.md", "/b/x.md"): 93}
    assert run(60.0) == {("/a/holiday clip.mp4", "/b/holiday clip.mp4"): 65, ("/a/garden.png", "/b/garden.png"): 67, ("/a/lake.png", "/b/lake.png"): 100, ("/a/x.md", "/b/x.md"): 93}


def test_renames(spark):
    new = spark.createDataFrame([("n1", 5, 10), ("n2", None, 20), ("n3", None, 30), ("n4", None, 30)], "path string, inode long, file_size long")
    old = spark.createDataFrame([("o1", 5, 99), ("o2", None, 20), ("o3", None, 30)], "path string, inode long, file_size long")
    assert {(r.path, r.was) for r in watch.renames(new, old).collect()} == {("n1", "o1"), ("n2", "o2")}


def test_whole_tables_of_hashes_and_documents(spark, tmp_path):
    q = __spark_entry__.queries()
    spark.createDataFrame([(1, "p", [1, 2, 3, 4], False), (2, "p", [0, 0, 0, 0, 1, 2, 3, 4], True), (3, "p", [1, 2, 3, 4], False), (4, "q", [0, 0, 0, 0, 5, 6, 7, 8], True), (5, "q", [5, 6, 7, 8], False)], "entry_id long, path string, hashes array<long>, rotation_invariant boolean").write.parquet(str(tmp_path / "content_hashes.parquet"))
    assert {(r.entry_id, r.similarity) for r in q["x8_rotated_similarity"](spark, str(tmp_path)).collect()} == {(2, 1.0), (5, 1.0)}
    spark.createDataFrame([(1, "de", "ein haus"), (2, "en", "a house"), (3, None, "haus boot"), (4, "en", None)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.doc_id, r.terms) for r in q["x9_tfidf_all"](spark, str(tmp_path)).collect()} == {(1, 2), (2, 1), (3, 2)}


def test_entry_and_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_weights():
    assert scoring.parse_weights("filename=50, filesize=50") == {"filename": 50.0, "file_size": 50.0}
    for bad in ("filename", "a=-1", "a=1,a=2", "a=nan"):
        with pytest.raises(ValueError):
            scoring.parse_weights(bad)
    assert scoring.with_directory({"a": 100.0, "directory": 100.0}) == {"a": 50.0, "directory": 50.0}
    assert scoring.config_hash({"a": 1, "b": 2}) == scoring.config_hash({"b": 2, "a": 1})
    assert all(sum(w.values()) == 100 for w in scoring.WEIGHTS.values())


def test_alerts_without_durations_meet_in_blocks(spark, monkeypatch):
    from echofold.operators import scoring

    monkeypatch.setattr(scoring.in_blocks, "__defaults__", (16, None))
    rng = random.Random(3)
    word = lambda: rng.choice(["lake", "lakes", "lâke", "river", "rivers", "x" * 300])
    rows = [(f"/{k}/{word()} {word()}.png", rng.choice([None, None, 5.0]), rng.choice([None, 0, 10, 11]), 10, rng.choice([None, 0, 100, 110]), 1.0) for k in range(120)]
    df = spark.createDataFrame(rows, WATCHED)
    got = {(r.path, r.match): r.score for r in watch.alerts(df, None, 70.0).collect()}
    both = {(r.path, r.match): r.score for r in watch.alerts(df, df, 70.0).collect()}
    share = lambda x, y: 0.0 if x is None or y is None else 1.0 if x == y == 0 else min(x, y) / max(x, y)

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            row = [i]
            for j, q in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != q)))
            last = row
        return last[-1]

    w, want = watch.default_weights("image"), {}
    stems = [r[0].rpartition("/")[2][:-4] for r in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[0] > b[0]:
                pixels = [None if r[2] is None else r[2] * r[3] for r in (a, b)]
                most = max(len(stems[i]), len(stems[j]))
                score = (w["filename"] * (1 - edits(stems[i], stems[j]) / most) + w["resolution"] * share(*pixels) + w["file_size"] * share(a[4], b[4])) / sum(w.values()) * 100
                if (a[1] is None or b[1] is None or abs(a[1] - b[1]) <= 2) and math.floor(score + 0.5) >= 70:
                    want[a[0], b[0]] = math.floor(score + 0.5)
    assert got == want and {k: v for k, v in both.items() if k[0] > k[1]} == want and len(both) == 2 * len(want) > 0


@pytest.mark.parametrize("mode", ["image", "audio"])
def test_contents_are_measured_before_pairs_are_made(spark, monkeypatch, mode):
    rng = random.Random(5)
    some = lambda *x: rng.choice([None, *x])
    rows, content = [], []
    prints = [[rng.getrandbits(32) for _ in range(9)] for _ in range(4)]
    hashes = [[rng.getrandbits(64) - (1 << 63) for _ in range(8)] for _ in range(4)]
    for k in range(70):
        name = f"{rng.choice(['lake', 'lakes', 'deep lake', 'img 12', 'img 13'])}{rng.choice(['', ' copy'])}"
        path = f"/{k}/{name}.{'png' if mode == 'image' else 'mp3'}"
        exif = dict(exif_datetime=some(5e8, 5e8 + 900), exif_camera=some("x", "y"), exif_lens=some("l"), exif_gps_lat=some(5.0, 5.001), exif_gps_lon=some(6.0), exif_width=some(10), exif_height=10)
        tags = dict(tag_title=some("one", "ones", ""), tag_artist=some("her", "him"), tag_album=some("last"))
        rows.append(dict(path=path, filename=path.rpartition("/")[2], duration=some(60.0, 61.5), width=rng.choice([10, 12]), height=10, file_size=some(0, 100, 120), **exif, **tags))
        if mode == "image":
            own = [x ^ (1 << rng.randrange(60)) for x in rng.choice(hashes)][: rng.choice([4, 8])]
        else:
            own = rng.choice(prints)[rng.randrange(3) : rng.randrange(5, 10)]
        content.append((path, rng.choice([own, own, own, own, None, [], own[:3]])))
    table = spark.createDataFrame(content, f"path string, {'content_hash' if mode == 'image' else 'audio_fingerprint'} array<bigint>")
    df = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], FILE)
    key = lambda got: sorted((r.path_a, r.path_b, round(r.total, 9), r.identical, str(sorted(r.breakdown.items(), key=str))) for r in got.collect())
    want = key(scoring.find_duplicates(df, mode, content=table, rotated=True, sha256=spark.createDataFrame([], "path string, sha256 string")))
    monkeypatch.setattr(scoring.weighed_pairs, "__defaults__", (16,))
    monkeypatch.setattr(scoring, "bucket_pairs", None)  # no pair is made that isn't measured
    got = key(scoring.find_duplicates(df, mode, content=table, rotated=True))
    assert got == want and len(got) > 20


def test_blocks_of_large_buckets_grow(spark):
    rows = spark.range(130).select(F.when(F.col("id") < 20, "few").otherwise("many").alias("_key"), F.col("id").cast("string").alias("path"))

    def look(a, b, same):
        both = a.merge(b, how="cross", suffixes=("", "_b"))
        both = both[both["path"] < both["path_b"]] if same else both
        yield pd.DataFrame({"x": both["path"], "y": both["path_b"], "at": both["_key"] + both["_i"].astype(str)})

    got = scoring.in_blocks(rows, "path", ["path"], look, "x string, y string, at string", 4, most=8).collect()
    met = {frozenset((r.x, r.y)) for r in got}
    assert len(got) == len(met) == 20 * 19 // 2 + 110 * 109 // 2
    assert {r["at"] for r in got} <= {f"few{i}" for i in range(5)} | {f"many{i}" for i in range(14)}


@pytest.mark.parametrize("mode", ["image", "audio"])
def test_measured_pairs_come_with_their_values(spark, mode):
    # in letters alike, in their order not: what letters allow reaches the threshold, the pair does not
    kind, field = ("content", "content_hash") if mode == "image" else ("audio", "audio_fingerprint")
    base = {"duration": 60.0, "width": 10, "height": 10, "tag_title": "abcdefgh"}
    told = [base | {"path": "/a", "filename": "abcdefgh"}, base | {"path": "/b", "filename": "hgfedcba", "tag_title": "hgfedcba"}, base | {"path": "/c", "filename": "abcdefgh", "file_size": 500}, base | {"path": "/d", "filename": "x", "duration": float("nan")}]
    own = scoring.prepared(files(spark, *told)).withColumn("cell", F.lit("x"))
    print_of = {"/a": [0, 0, 0, 0], "/b": [-1 if mode == "image" else (1 << 32) - 1] * 4, "/c": [0, 0, 0, 1], "/d": [0, 0, 0, 0]}
    own = own.join(spark.createDataFrame(list(print_of.items()), f"path string, {field} array<bigint>"), "path")
    weights = {"filename": 50, "duration": 10, "resolution": 5, kind: 35} if mode == "image" else {"tags": 50, "duration": 10, "resolution": 5, kind: 35}
    met, rest = scoring.weighed_pairs(own, kind, field, weights, 50.0, True)
    got = {(r.path_a, r.path_b): r for r in met.collect()}
    assert set(got) == {("/a", "/c")} and {(r.path_a, r.path_b) for r in rest.collect()} == {("/a", "/d"), ("/b", "/d"), ("/c", "/d")}
    r = got["/a", "/c"]
    assert r.value == 1 - 1 / (256 if mode == "image" else 128) and r.raw_duration == r.raw_resolution == 1.0 and not r.identical
    assert (r.raw_filename if mode == "image" else r.raw_tags) == 1.0


def test_gate_leaves_out_pairs_that_are_measured(spark):
    df = spark.createDataFrame([(f"/{k}", "harbour", k < 3) for k in range(5)], "path string, name string, measured boolean").withColumn("bucket", F.lit(1))
    got = sorted((r.path_a, r.path_b) for r in scoring.gated_pairs(df, ("bucket",), but=F.col("measured")).collect())
    assert got == [(f"/{i}", f"/{j}") for i in range(5) for j in range(i + 1, 5) if j > 2]


def test_prints_and_hashes_equal_brute_force():
    rng, wrong = random.Random(3), lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y, strict=False))
    by_length = lambda lists: pd.Series(sorted(lists, key=len))
    for _ in range(20):
        a, b = (by_length([[rng.choice([7, rng.getrandbits(32)]) for _ in range(rng.randint(1, 9))] for _ in range(8)]) for _ in "ab")
        got = weighed.Prints(a, b).similarity(slice(2, 8), 3)
        for i, x in enumerate(a[2:]):
            for j, y in enumerate(b[3:]):
                s, long_ = sorted((x, y), key=len)
                assert got[i, j] == 1 - min(wrong(s, long_[o:]) for o in range(len(long_) - len(s) + 1)) / (len(s) * 32.0)
        a, b = (by_length([[rng.getrandbits(64) - (1 << 63) for _ in range(rng.choice([4, 8, 9, 12]))] for _ in range(8)]) for _ in "ab")
        got = weighed.Hashes(a, b).similarity(slice(2, 8), 3)
        for i, x in enumerate(a[2:]):
            for j, y in enumerate(b[3:]):
                each = [wrong(p[:4], q[k * 4 : k * 4 + 4]) for p, q in ((x, y), (y, x)) for k in range(len(q) // 4)]
                assert got[i, j] == 1 - min(each) / 256.0


def test_names_meet_by_length_and_lose_no_pair(monkeypatch):
    rng = random.Random(7)
    told = [" ".join(sorted(rng.choice(["harbour", "harbor", "lake", "lakes", "ab", "x" * 70, "x" * 69, "y" * 300]) for _ in range(rng.randint(1, 3)))) for _ in range(90)] + [""]
    a = pd.DataFrame({"name": told, "words": told, "id": False, "digits": "", "text": told, "runs": ""})
    for low in (None, 0.6):
        found = {}
        for tile, width in ((128, 1024), (4, 8)):
            monkeypatch.setattr(alike, "TILE", tile)
            monkeypatch.setattr(alike, "WIDTH", width)
            found[tile] = sorted(tuple(sorted(p)) for i, j in alike.near(a, a, True, 0.8, low) for p in zip(i.tolist(), j.tolist(), strict=True))
        must = {(i, j) for i in range(90) for j in range(i + 1, 90) if names.indel_ratio(told[i], told[j]) >= 0.8}
        assert found[128] == found[4] and must <= set(found[4]) and len(set(found[4])) == len(found[4]) and (low or must == set(found[4]))
