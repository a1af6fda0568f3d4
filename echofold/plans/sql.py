"""The same queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from echofold.functions.names import QUALITY, SUFFIXES

_REST = sorted("filename duration width height file_size codec bitrate framerate audio_channels mtime is_reference pre_hash exif_datetime exif_camera exif_lens exif_gps_lat exif_gps_lon exif_width exif_height tag_title tag_artist tag_album page_count doc_title doc_author doc_created batch_no".split())
_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ("scanned_at", *_REST))
LATEST = f"latest AS (SELECT * EXCLUDE (k_) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_ORDER}) AS k_ FROM files) WHERE k_ = 1)"
LINKED = """linked AS (SELECT least(path_a, path_b) AS path_a, greatest(path_a, path_b) AS path_b, max(score) AS score FROM scored_pairs
  WHERE score IS NOT NULL AND NOT isnan(score) AND path_a <> path_b AND score >= 70 GROUP BY 1, 2)"""
BOTH = f"{LATEST}, {LINKED}, att AS (SELECT l.path_a, l.path_b, l.score, a, b FROM linked l JOIN latest a ON l.path_a = a.path JOIN latest b ON l.path_b = b.path)"
MEMBERS = "members AS (SELECT group_id, f.* FROM (SELECT group_id, unnest(files) AS f FROM envelope_groups) WHERE f.path IS NOT NULL)"


def _suffix(p: str) -> str:
    return f"lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '.(\\.[^.]*)$', 1))"


def _kind(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {_suffix(p)} IN ({', '.join(repr(s) for s in known)}) THEN '{kind}'" for kind, known in SUFFIXES.items()) + " END"


def _parent(p: str) -> str:
    return f"regexp_replace(regexp_replace({p}, '/[^/]*$', ''), '^$', '/')"


def _stem(p: str) -> str:
    return f"regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"


def _tier(px: str) -> str:
    return f"CASE WHEN {px} IS NULL THEN 'unknown' WHEN {px} <= 153600 THEN 'ld' WHEN {px} <= 409920 THEN 'sd' WHEN {px} <= 921600 THEN 'hd' WHEN {px} <= 2073600 THEN 'fhd' WHEN {px} <= 3686400 THEN 'qhd' ELSE 'uhd' END"


PIXELS = "width::BIGINT * height"
SIZE_TIER = "CASE WHEN file_size IS NULL OR file_size <= 0 THEN -1 ELSE trunc(log2(greatest(file_size / 1048576.0, 0.1)))::INT END"
NAME = f"trim(regexp_replace(lower(regexp_replace(regexp_replace(filename, '\\b({QUALITY})\\b', ' ', 'gi'), '[.\\-_\\[\\](){{}}]+', ' ', 'g')), '\\s+', ' ', 'g'))"


def _buckets(kind: str, key: str) -> str:
    """CTEs own and bucketed: files of a kind with their anchored bucket, those of buckets of one left out."""
    return f"""{LATEST}, own AS (SELECT * FROM latest WHERE {_kind("path")} = '{kind}'),
vals AS (SELECT DISTINCT {key}::DOUBLE AS v FROM own WHERE {key} IS NOT NULL),
anch(v) AS (SELECT min(v) FROM vals UNION SELECT (SELECT min(x.v) FROM vals x WHERE x.v - anch.v > 4) FROM anch WHERE anch.v IS NOT NULL),
keyed AS (SELECT own.*, (SELECT max(a.v) FROM anch a WHERE a.v <= own.{key}) AS bucket FROM own),
bucketed AS (SELECT * EXCLUDE (n_) FROM (SELECT *, count(*) OVER (PARTITION BY bucket) AS n_ FROM keyed) WHERE n_ > 1 OR bucket IS NULL)"""


def _linear(x: str, y: str, most: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN greatest(0.0, 1 - abs({x} - {y}) / {most}) END"


def _share(x: str, y: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {x} = 0 OR {y} = 0 THEN 0.0 ELSE least({x}, {y}) / greatest({x}, {y})::DOUBLE END"


def _keep(x: str, y: str, more: str, plain: bool) -> str:
    less = {">": "<", "<": ">"}[more]
    first = f"WHEN {x} {more} {y} THEN 'a' WHEN {x} {less} {y} THEN 'b'"
    if plain:
        return f"CASE {first} END"
    ties = "WHEN a.file_size > b.file_size THEN 'a' WHEN a.file_size < b.file_size THEN 'b' WHEN coalesce(len(a.sidecars), 0) > coalesce(len(b.sidecars), 0) THEN 'a' WHEN coalesce(len(a.sidecars), 0) < coalesce(len(b.sidecars), 0) THEN 'b'"
    return f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN NULL WHEN {x} IS NULL THEN 'b' WHEN {y} IS NULL THEN 'a' {first} {ties} END"


def _popcount(x: str, y: str, bits: int) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: bit_count(xor(z[1], z[2]){' & 4294967295' if bits == 32 else ''})))"


def _slide(x: str, y: str, width: int, bits: int) -> str:
    s, t = f"(CASE WHEN len({x}) <= len({y}) THEN {x} ELSE {y} END)", f"(CASE WHEN len({x}) <= len({y}) THEN {y} ELSE {x} END)"
    return f"1 - list_min(list_transform(range(0, len({t}) - len({s}) + 1, {width}), lambda o: {_popcount(s, f'{t}[o + 1:o + len({s})]', bits)})) / (len({s}) * {bits}.0)"


def _exif() -> str:
    a = lambda f: f"a.exif_{f}"
    b = lambda f: f"b.exif_{f}"
    equal = lambda f: f"CASE WHEN {a(f)} IS NOT NULL AND {b(f)} IS NOT NULL THEN ({a(f)} = {b(f)})::INT::DOUBLE END"
    hav = "pow(sin((radians(b.exif_gps_lat) - radians(a.exif_gps_lat)) / 2), 2) + cos(radians(a.exif_gps_lat)) * cos(radians(b.exif_gps_lat)) * pow(sin(radians(b.exif_gps_lon - a.exif_gps_lon) / 2), 2)"
    near = f"CASE WHEN a.exif_gps_lat IS NOT NULL AND a.exif_gps_lon IS NOT NULL AND b.exif_gps_lat IS NOT NULL AND b.exif_gps_lon IS NOT NULL THEN greatest(0.0, 1 - 2 * 6371000.0 * asin(sqrt(least({hav}, 1.0))) / 1000.0) END"
    known = " AND ".join(f"{s}.{f} IS NOT NULL" for s in "ab" for f in ("exif_width", "exif_height", "width", "height"))
    same = f"CASE WHEN {known} THEN (a.exif_width = a.width AND a.exif_height = a.height AND b.exif_width = b.width AND b.exif_height = b.height AND a.exif_width = b.exif_width AND a.exif_height = b.exif_height)::INT::DOUBLE END"
    parts = [(0.35, _linear(a("datetime"), b("datetime"), 3600.0)), (0.20, equal("camera")), (0.10, equal("lens")), (0.25, near), (0.10, same)]
    total = " + ".join(f"CASE WHEN ({c}) IS NOT NULL THEN {w} ELSE 0 END" for w, c in parts)
    value = " + ".join(f"coalesce(({c}) * {w}, 0)" for w, c in parts)
    return f"CASE WHEN ({total}) > 0 THEN ({value}) / ({total}) END"


REACH = f"""WITH RECURSIVE {LINKED}, e AS (SELECT path_a AS x, path_b AS y FROM linked UNION SELECT path_b, path_a FROM linked),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), roots AS (SELECT x AS path, min(y) AS root FROM reach GROUP BY x)"""
KEEPER = f"""{MEMBERS}, c AS (SELECT group_id, path, mtime AS v, file_size AS s FROM members WHERE mtime IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY v DESC, s DESC NULLS LAST, path) AS k FROM c),
t AS (SELECT group_id, count(*) AS n, count(DISTINCT (v, s)) FILTER (WHERE s IS NOT NULL) AS d, min_by(path, k) AS path FROM r WHERE k <= 2 GROUP BY group_id), keeper AS (SELECT group_id, path FROM t WHERE n = 1 OR d = 2)"""
FREE = """free AS (SELECT DISTINCT p.path AS path, p.file_size AS file_size FROM (SELECT CASE WHEN coalesce(a.is_reference, false) AND coalesce(b.is_reference, false) THEN NULL
  WHEN coalesce(a.is_reference, false) THEN b WHEN coalesce(b.is_reference, false) THEN a WHEN a.file_size <= b.file_size THEN a ELSE b END AS p FROM att) WHERE p IS NOT NULL)"""
_BITRATE = "CASE WHEN bitrate > 0 AND bitrate % 1000000000 = 0 THEN (bitrate // 1000000000) || 'Gbps' WHEN bitrate > 0 AND bitrate % 1000000 = 0 THEN (bitrate // 1000000) || 'Mbps' WHEN bitrate > 0 AND bitrate % 1000 = 0 THEN (bitrate // 1000) || 'Kbps' ELSE bitrate || 'bps' END"
_SIZE = "CASE " + " ".join(f"WHEN file_size > 0 AND file_size % {1 << k} = 0 THEN (file_size // {1 << k}) || '{u}'" for u, k in (("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10))) + " ELSE file_size || 'B' END"
_HUMAN = "CASE " + " ".join(f"WHEN abs(file_size) >= {1 << k} THEN printf('%.1f {u}', file_size / {float(1 << k)})" for u, k in (("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10))) + " ELSE printf('%.1f B', file_size::DOUBLE) END"
_CLOCK = "CASE WHEN duration IS NULL THEN 'n/a' WHEN duration >= 3600 THEN printf('%d:%02d:%02d', floor(duration)::BIGINT // 3600, floor(duration)::BIGINT % 3600 // 60, floor(duration)::BIGINT % 60) ELSE printf('%d:%02d', floor(duration)::BIGINT // 60, floor(duration)::BIGINT % 60) END"
_QUOTE = "CASE WHEN regexp_matches({0}, '^[A-Za-z0-9@%+=:,./_-]+$') THEN {0} ELSE '''' || replace({0}, '''', '''\"''\"''') || '''' END"
_SPLIT = "list_filter(string_split({0}, '/'), lambda x: x <> '')"


def _directory() -> str:
    p, q = (_SPLIT.format(_parent(f"{s}.path")) for s in "ab")
    shared = f"len(list_filter(range(1, least(len({p}), len({q})) + 1), lambda i: {p}[1:i] = {q}[1:i]))"
    return f"CASE WHEN {p} = {q} THEN 1.0 WHEN {shared} = 0 THEN 0.0 ELSE greatest(0.0, 1 - (greatest(len({p}), len({q})) - {shared}) / 5.0) END"


_MINHASH = "('0x' || substr(md5(g), 1, 16))::UBIGINT"

SQL = {
    "f1_size": "SELECT path, file_size FROM files WHERE file_size BETWEEN 1000000 AND 50000000",
    "f2_duration": "SELECT path, duration FROM files WHERE duration IS NULL OR duration BETWEEN 60 AND 400",
    "f3_resolution": f"SELECT path, width, height FROM files WHERE {PIXELS} IS NULL OR {PIXELS} BETWEEN 921600 AND 8294400",
    "f4_bitrate": "SELECT path, bitrate FROM files WHERE bitrate IS NULL OR bitrate BETWEEN 100000 AND 5000000",
    "f5_codec": "SELECT path, codec FROM files WHERE codec IS NULL OR lower(codec) IN ('h264', 'flac')",
    "f6_all_filters": f"SELECT path, file_size, duration, codec FROM files WHERE file_size >= 102400 AND (duration IS NULL OR duration >= 30) AND ({PIXELS} IS NULL OR {PIXELS} >= 307200) AND (bitrate IS NULL OR bitrate <= 5000000) AND (codec IS NULL OR lower(codec) IN ('h264', 'hevc', 'mp3', 'flac', 'png'))",
    "f7_without_ignored": "SELECT entry_id FROM scored_pairs s WHERE NOT EXISTS (SELECT 1 FROM scored_pairs i WHERE i.batch_no = 11 AND i.score < 60 AND least(i.path_a, i.path_b) = least(s.path_a, s.path_b) AND greatest(i.path_a, i.path_b) = greatest(s.path_a, s.path_b))",
    "f8_min_score": "SELECT entry_id, score FROM scored_pairs WHERE round(score, 1) >= 72.5",
    "f10_touching": f"WITH {MEMBERS} SELECT entry_id FROM scored_pairs WHERE path_a IN (SELECT path FROM members) OR path_b IN (SELECT path FROM members)",
    "f11_directory": "SELECT entry_id FROM scored_pairs WHERE starts_with(path_a, '/vault/old/') OR starts_with(path_b, '/vault/old/')",
    "f12_search": "SELECT entry_id FROM scored_pairs WHERE contains(lower(path_a), 'lighthouse') OR contains(lower(path_b), 'lighthouse')",
    "s8_media_counts": f"SELECT {_kind('path')} AS media_type, count(*) AS n, count(DISTINCT path) AS n_paths FROM files GROUP BY 1",
    "s9_references": "SELECT coalesce(is_reference, false) OR starts_with(path, '/vault/old/') OR starts_with(path, '/nas/media/') AS is_reference, count(*) AS n FROM files GROUP BY 1",
    "s18_sidecars": f"WITH {LATEST} SELECT path, len(sidecars)::INT AS n, array_to_string(list_sort(sidecars), ',') AS sidecars FROM latest WHERE sidecars IS NOT NULL",
    "j3_duration_buckets": f"WITH RECURSIVE {_buckets('audio', 'duration')} SELECT path, bucket FROM bucketed",
    "j4_page_buckets": f"WITH RECURSIVE {_buckets('document', 'page_count')} SELECT path, bucket FROM bucketed",
    "j5_resolution_tiers": f"WITH {LATEST} SELECT {_tier(PIXELS)} AS tier, count(*) AS n FROM latest GROUP BY 1",
    "j6_refined_buckets": f"""WITH RECURSIVE {_buckets("audio", "duration")}, t AS (SELECT path, bucket, {_tier(PIXELS)} AS tier, ({SIZE_TIER})::VARCHAR AS st FROM bucketed),
c AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS nb, count(*) OVER (PARTITION BY bucket, tier) AS nt, count(*) OVER (PARTITION BY bucket, tier, st) AS ns FROM t),
s AS (SELECT *, CASE WHEN nb * (nb - 1) / 2 <= 40 THEN '' WHEN nt * (nt - 1) / 2 <= 40 THEN tier ELSE tier || '/' || st END AS sub FROM c)
SELECT path, bucket, sub FROM s WHERE CASE WHEN sub = '' THEN nb WHEN sub = tier THEN nt ELSE ns END > 1""",
    "j7_size_tiers": f"WITH {LATEST} SELECT {SIZE_TIER} AS tier, count(*) AS n FROM latest GROUP BY 1",
    "j8_bucket_pairs": f"WITH RECURSIVE {_buckets('audio', 'duration')} SELECT a.path AS path_a, b.path AS path_b FROM bucketed a JOIN bucketed b ON a.bucket IS NOT DISTINCT FROM b.bucket AND a.path < b.path",
    "j12_pair_hits": f"WITH {LATEST} SELECT entry_id FROM scored_pairs s WHERE EXISTS (SELECT 1 FROM latest f WHERE f.path = s.path_a AND f.mtime = s.mtime_a) AND EXISTS (SELECT 1 FROM latest f WHERE f.path = s.path_b AND f.mtime = s.mtime_b)",
    "j13_time_windows": f"WITH {LATEST} SELECT coalesce(trunc(exif_datetime / 1800)::BIGINT::VARCHAR, {_tier(PIXELS)}) AS bucket, count(*) AS n FROM latest WHERE {_kind('path')} = 'image' GROUP BY 1",
    "c_native_comparators": f"""WITH RECURSIVE {_buckets("audio", "duration")}, p AS (SELECT a, b FROM bucketed a JOIN bucketed b ON a.bucket IS NOT DISTINCT FROM b.bucket AND a.path < b.path)
SELECT a.path AS path_a, b.path AS path_b, round({_linear("a.duration", "b.duration", 5.0)}, 6) AS duration, round({_share("a.file_size", "b.file_size")}, 6) AS file_size, round({_directory()}, 6) AS directory FROM p""",
    "c3_resolution": f"WITH {BOTH} SELECT path_a, path_b, round({_share('a.width::BIGINT * a.height', 'b.width::BIGINT * b.height')}, 6) AS resolution FROM att",
    "c5_exif": f"WITH {BOTH} SELECT path_a, path_b, round({_exif()}, 5) AS exif FROM att",
    "x1_normalized_names": f"""WITH {LATEST}, n AS (SELECT path, {NAME} AS name FROM latest) SELECT path, name, coalesce(length(regexp_replace(name, '[^0-9]', '', 'g')) / nullif(length(replace(name, ' ', '')), 0) > 0.5, false) AS numeric,
trim(regexp_replace(regexp_replace(name, '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) AS skeleton, array_to_string(list_sort(list_filter(string_split(name, ' '), lambda t: t <> '')), ' ') AS words FROM n""",
    "x5_levenshtein": f"WITH {LINKED} SELECT path_a, path_b, round(CASE WHEN greatest(length({_stem('path_a')}), length({_stem('path_b')})) = 0 THEN 1.0 ELSE 1 - levenshtein({_stem('path_a')}, {_stem('path_b')}) / greatest(length({_stem('path_a')}), length({_stem('path_b')})) END, 6) AS ratio FROM linked",
    "x6_simhash": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{0b}}]+'), lambda t: t <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2), h AS (SELECT doc_id, {_MINHASH} AS h FROM g),
b AS (SELECT doc_id, b, sum(((h >> b) & 1)::INT * 2 - 1) AS v FROM h, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY 1, 2),
s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << b::INT) ELSE 0 END) AS s FROM b GROUP BY 1)
SELECT d.doc_id, (CASE WHEN s.s >= 9223372036854775808 THEN s.s - 18446744073709551616 ELSE s.s END)::BIGINT AS simhash FROM documents d LEFT JOIN s USING (doc_id)""",
    "x8_hash_similarity": f"""WITH h AS (SELECT * FROM content_hashes WHERE len(hashes) > 0), f AS (SELECT path, min(entry_id) AS e0 FROM h GROUP BY path)
SELECT h.entry_id, round({_slide("z.hashes", "h.hashes", 4, 64)}, 6) AS similarity FROM h JOIN f ON h.path = f.path JOIN h z ON z.entry_id = f.e0 WHERE h.entry_id > f.e0 AND NOT h.rotation_invariant""",
    "x9_tfidf": """WITH d AS (SELECT doc_id, text FROM documents WHERE lang = 'de' AND text IS NOT NULL), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1) SELECT doc_id, count(*) AS terms, round(sum(w / n), 5) AS total, round(max(w / n), 5) AS most FROM w JOIN n USING (doc_id) GROUP BY 1""",
    "x10_cosine": "WITH f AS (SELECT label, min(vec_id) AS v FROM embeddings WHERE label IS NOT NULL GROUP BY label) SELECT e.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(z.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 5) AS cosine FROM embeddings e JOIN f USING (label) JOIN embeddings z ON z.vec_id = f.v",
    "x11_audio_similarity": f"""WITH h AS (SELECT * FROM audio_fingerprints WHERE len(fingerprint) > 0), f AS (SELECT path, min(entry_id) AS e0 FROM h GROUP BY path)
SELECT h.entry_id, round({_slide("z.fingerprint", "h.fingerprint", 1, 32)}, 6) AS similarity FROM h JOIN f ON h.path = f.path JOIN h z ON z.entry_id = f.e0 WHERE h.entry_id > f.e0""",
    "x20_shown_values": f"""WITH {LATEST} SELECT path, {_SIZE} AS size, {_HUMAN} AS human, {_CLOCK} AS clock, coalesce(width || 'x' || height, 'n/a') AS resolution,
coalesce(CASE codec WHEN 'h264' THEN 'H.264' WHEN 'hevc' THEN 'H.265' WHEN 'vp9' THEN 'VP9' WHEN 'av1' THEN 'AV1' WHEN 'mpeg4' THEN 'MPEG-4' ELSE upper(codec) END, 'n/a') AS codec, {_BITRATE} AS even_bitrate,
coalesce(CASE audio_channels WHEN 1 THEN 'Mono' WHEN 2 THEN 'Stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE audio_channels || 'ch' END, 'n/a') AS channels,
CASE WHEN framerate IS NULL THEN 'n/a' ELSE regexp_replace(regexp_replace(printf('%.3f', framerate), '0+$', ''), '\\.$', '') || ' fps' END AS fps FROM latest""",
    "x25_score_bands": "SELECT CASE WHEN score >= 90 THEN 'CRIT' WHEN score >= 70 THEN 'HIGH' WHEN score >= 50 THEN 'MED' ELSE 'LOW' END AS band, CASE WHEN score >= 80 THEN 'red' WHEN score >= 60 THEN 'yellow' ELSE 'green' END AS colour, count(*) AS n FROM scored_pairs WHERE score IS NOT NULL GROUP BY 1, 2",
    "x26_escapes": f"WITH {LATEST} SELECT path, {_QUOTE.format('path')} AS shell, replace(replace(replace(replace(replace(tag_title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html, replace(tag_title, '|', '\\|') AS markdown FROM latest",
    "x27_paths": f"WITH {LATEST} SELECT path, {_stem('path')} AS stem, {_suffix('path')} AS suffix, {_parent('path')} AS parent, CASE WHEN starts_with(path, '/home/shared/') THEN '~' || substr(path, 13) ELSE path END AS short FROM latest",
    "x30_detail": "WITH k AS (SELECT entry_id, detail, unnest(json_keys(detail)) AS comparator FROM scored_pairs WHERE detail IS NOT NULL) SELECT entry_id, comparator, (detail::JSON -> comparator ->> 0)::DOUBLE AS raw, (detail::JSON -> comparator ->> 1)::DOUBLE AS weight FROM k",
    "a1_components": f"{REACH} SELECT path, root FROM roots",
    "a2_groups": f"""{REACH}, s AS (SELECT root, count(*) AS n_pairs, max(score) AS max_score, min(score) AS min_score, round(avg(score), 6) AS avg_score FROM linked JOIN roots ON path = path_a GROUP BY root),
n AS (SELECT root, count(*) AS n_files FROM roots GROUP BY root) SELECT row_number() OVER (ORDER BY max_score DESC, root)::INT AS group_id, root, n_files, n_pairs, max_score, min_score, avg_score FROM s JOIN n USING (root)""",
    "a3_unique_files": f"WITH {LINKED} SELECT path_a AS path FROM linked UNION SELECT path_b FROM linked",
    "a4_directory_stats": f"""WITH {BOTH}, {FREE}, u AS (SELECT a.path AS path, a.file_size AS file_size FROM att UNION SELECT b.path, b.file_size FROM att), o AS (SELECT {_parent("path")} AS directory, count(*) AS duplicate_files, sum(file_size)::BIGINT AS total_size FROM u GROUP BY 1),
r AS (SELECT {_parent("path")} AS directory, sum(file_size)::BIGINT AS recoverable_size FROM free GROUP BY 1), k AS (SELECT {_parent("path")} AS directory, count(*) AS total_files FROM latest GROUP BY 1)
SELECT directory, coalesce(total_files, duplicate_files) AS total_files, duplicate_files, total_size, coalesce(recoverable_size, 0) AS recoverable_size, round(duplicate_files / coalesce(total_files, duplicate_files), 6) AS density FROM o LEFT JOIN r USING (directory) LEFT JOIN k USING (directory)""",
    "a5_recoverable": f"WITH {BOTH}, {FREE} SELECT path, file_size FROM free",
    "a7_score_histogram": "WITH b AS (SELECT least(floor(floor(score) / 5) * 5, 95)::INT AS bin, count(*) AS n FROM scored_pairs WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1), s AS (SELECT unnest(range((SELECT min(bin) FROM b), 100, 5))::INT AS bin) SELECT bin, coalesce(n, 0) AS n FROM s LEFT JOIN b USING (bin)",
    "a8_filetypes": f"WITH {LATEST} SELECT {_suffix('path')} AS extension, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM latest GROUP BY 1",
    "a9_timeline": f"""WITH {LATEST}, {LINKED}, u AS (SELECT path_a AS path FROM linked UNION SELECT path_b FROM linked), d AS (SELECT strftime(make_timestamp((floor(mtime) * 1000000)::BIGINT), '%Y-%m-%d') AS day, path FROM latest WHERE mtime IS NOT NULL)
SELECT day, count(*) AS total_files, count(*) FILTER (WHERE path IN (SELECT path FROM u)) AS duplicate_files FROM d GROUP BY day""",
    "a11_space": f"WITH {BOTH}, {FREE} SELECT count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM free",
    "w5_trend": "WITH p AS (SELECT config_hash, batch_no, count(*) AS n FROM scored_pairs GROUP BY 1, 2) SELECT *, n - lag(n) OVER w AS delta, round((n - lag(n) OVER w) * 100.0 / lag(n) OVER w, 6) AS percent FROM p WINDOW w AS (PARTITION BY config_hash ORDER BY batch_no)",
    "w6_last_scans": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_hash ORDER BY batch_no DESC)::INT AS k FROM (SELECT config_hash, batch_no, count(*) AS n FROM scored_pairs GROUP BY 1, 2)) WHERE k <= 10",
    "o1_top_pairs": "SELECT entry_id, score FROM scored_pairs WHERE score IS NOT NULL AND NOT isnan(score) ORDER BY score DESC, path_a, path_b NULLS LAST, entry_id LIMIT 100",
    "o2_top_groups": "SELECT group_id, max_score, coalesce(list_sum(list_transform(files, lambda f: coalesce(f.file_size, 0))), 0)::BIGINT AS bytes FROM envelope_groups ORDER BY max_score DESC NULLS LAST, bytes DESC, group_id LIMIT 50",
    "keep_pairs": f"""WITH {BOTH} SELECT path_a, path_b, {_keep("a.mtime", "b.mtime", ">", False)} AS newest, {_keep("a.mtime", "b.mtime", "<", False)} AS oldest, {_keep("a.file_size", "b.file_size", ">", True)} AS biggest, {_keep("a.file_size", "b.file_size", "<", True)} AS smallest,
{_keep("a.duration", "b.duration", ">", False)} AS longest, {_keep("(a.width::BIGINT * a.height)", "(b.width::BIGINT * b.height)", ">", False)} AS highest_res,
CASE WHEN coalesce(len(a.sidecars), 0) > coalesce(len(b.sidecars), 0) THEN 'a' WHEN coalesce(len(a.sidecars), 0) < coalesce(len(b.sidecars), 0) THEN 'b' ELSE {_keep("a.mtime", "b.mtime", ">", False)} END AS edited FROM att""",
    "keep_groups": f"WITH {KEEPER} SELECT group_id, path FROM keeper",
    "delete_groups": f"WITH {KEEPER}, n AS (SELECT group_id FROM members GROUP BY 1 HAVING count(*) >= 2) SELECT m.group_id, m.path FROM members m JOIN keeper k USING (group_id) JOIN n USING (group_id) WHERE NOT coalesce(m.is_reference, false) AND m.path <> k.path",
    "h1_cache_hits": f"WITH {LATEST} SELECT entry_id FROM content_hashes h WHERE EXISTS (SELECT 1 FROM latest f WHERE f.path = h.path AND f.file_size = h.file_size AND f.mtime = h.mtime)",
    "h1_cache_misses": f"WITH {LATEST} SELECT path FROM latest f WHERE {_kind('path')} = 'image' AND NOT EXISTS (SELECT 1 FROM content_hashes h WHERE f.path = h.path AND f.file_size = h.file_size AND f.mtime = h.mtime)",
    "a13_cache_counts": "WITH " + LATEST + " " + " UNION ALL ".join(f"SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, '{t}' AS cache FROM (SELECT EXISTS (SELECT 1 FROM {t} h WHERE f.path = h.path AND f.file_size = h.file_size AND f.mtime = h.mtime) AS hit FROM latest f)" for t in ("content_hashes", "audio_fingerprints", "clip_embeddings")),
    "h4_prune": "SELECT entry_id FROM scored_pairs WHERE path_a IN (SELECT path FROM files) AND path_b IN (SELECT path FROM files)",
    "k4_shell_lines": f"""WITH {BOTH}, k AS (SELECT *, {_keep("a.file_size", "b.file_size", ">", True)} AS keep FROM att), l AS (SELECT *, CASE keep WHEN 'a' THEN path_b WHEN 'b' THEN path_a END AS loser, CASE keep WHEN 'a' THEN coalesce(b.is_reference, false) ELSE coalesce(a.is_reference, false) END AS safe FROM k)
SELECT path_a, path_b, CASE WHEN loser IS NULL THEN '# undecided: ' || path_a || ' ' || path_b WHEN safe THEN '# reference: ' || loser ELSE 'rm -- ' || {_QUOTE.format("loser")} END AS line FROM l""",
    "k9_group_rows": "WITH m AS (SELECT group_id, file_count, round(max_score, 4) AS max_score, keep, unnest(files) AS f, unnest(range(len(files)))::INT AS place FROM envelope_groups) SELECT group_id, file_count, max_score, place, f.path AS path, f.file_size AS file_size, coalesce(f.path = keep, false) AS kept FROM m",
    "k13_dry_run": f"WITH {KEEPER}, {LATEST}, n AS (SELECT group_id FROM members GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT DISTINCT m.path FROM members m JOIN keeper k USING (group_id) JOIN n USING (group_id) WHERE NOT coalesce(m.is_reference, false) AND m.path <> k.path) SELECT count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS bytes, coalesce(sum(coalesce(len(sidecars), 0)), 0)::BIGINT AS n_sidecars FROM x JOIN latest USING (path)",
    "s19_replay": "SELECT group_id, p.file_a AS file_a, p.file_b AS file_b, max(p.score) AS score FROM (SELECT group_id, unnest(pairs) AS p FROM envelope_groups) WHERE p.file_a IS NOT NULL AND p.file_b IS NOT NULL GROUP BY 1, 2, 3",
}
