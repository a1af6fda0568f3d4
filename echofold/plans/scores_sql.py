"""The queries that need indel ratios, in SQL: the longest common subsequence by one wide integer a pair (bit-parallel)."""

from __future__ import annotations

from echofold.operators.scoring import GATE, WEIGHTS
from echofold.plans import sql


def ratio(a: str, b: str) -> str:
    """Indel ratio of two strings of at most 120 characters; null where either is null."""
    masks = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(string_split({a}, ''), lambda x, i: CASE WHEN x = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)"
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    left = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    common = f"(length({a}) - bit_count({left}))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN length({a}) + length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 2.0 * {common} / (length({a}) + length({b})) END"


def weighted(parts: list[tuple[float, str]]) -> str:
    total = " + ".join(f"CASE WHEN ({c}) IS NOT NULL THEN {w} ELSE 0 END" for w, c in parts)
    value = " + ".join(f"coalesce(({c}) * {w}, 0)" for w, c in parts)
    return f"CASE WHEN ({total}) > 0 THEN ({value}) / ({total}) END"


def tags() -> str:
    return weighted([(w, ratio(f"a.{f}", f"b.{f}")) for w, f in ((0.45, "tag_title"), (0.35, "tag_artist"), (0.20, "tag_album"))])


def page_count() -> str:
    return "CASE WHEN greatest(a.page_count, b.page_count) <> 0 AND a.page_count IS NOT NULL AND b.page_count IS NOT NULL THEN 1 - abs(a.page_count - b.page_count) / greatest(a.page_count, b.page_count)::DOUBLE END"


def doc_meta() -> str:
    zone = "regexp_matches({0}.doc_created, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$')"
    day = "epoch(TRY_CAST({0}.doc_created AS TIMESTAMPTZ))"
    when = f"CASE WHEN {zone.format('a')} = {zone.format('b')} THEN {sql._linear(day.format('a'), day.format('b'), 2592000.0)} END"
    return weighted([(0.45, ratio("a.doc_title", "b.doc_title")), (0.35, ratio("a.doc_author", "b.doc_author")), (0.20, when)])


_WORDS = "array_to_string(list_sort(list_filter(string_split(name, ' '), lambda t: t <> '')), ' ')"
_OWN_WORD = "len(list_filter(string_split({0}.name, ' '), lambda t: NOT list_contains(string_split({1}.name, ' '), t) AND length(t) >= 3 AND regexp_full_match(t, '\\p{{L}}+'))) > 0"
EXCLUDED = """(a.name = '' OR b.name = '' OR (a.isid AND b.isid AND a.digits <> b.digits) OR (a.skel <> '' AND a.skel = b.skel AND a.runs <> b.runs))"""


def prepared(kind: str) -> str:
    """CTE prep: the latest files of a kind with what the name comparator looks at."""
    return f"""{sql.LATEST}, named AS (SELECT *, {sql.NAME} AS name FROM latest WHERE {sql._kind("path")} = '{kind}'),
prep AS (SELECT *, {_WORDS} AS words, coalesce(length(regexp_replace(name, '[^0-9]', '', 'g')) / nullif(length(replace(name, ' ', '')), 0) > 0.5, false) AS isid, regexp_replace(name, '[^0-9]', '', 'g') AS digits,
trim(regexp_replace(regexp_replace(name, '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) AS skel, regexp_extract_all(name, '[0-9]+') AS runs FROM named)"""


def similar(kind: str) -> str:
    """CTEs prep and cross_: the pairs with similar names."""
    r = ratio("a.words", "b.words")
    return f"""{prepared(kind)}, cross_ AS (SELECT a.path AS path_a, b.path AS path_b FROM prep a JOIN prep b ON a.path < b.path AND a.words <> '' AND b.words <> ''
  AND 2.0 * least(length(a.words), length(b.words)) >= 0.8 * (length(a.words) + length(b.words)) - 1e-9 WHERE NOT {EXCLUDED} AND CASE WHEN a.name = b.name THEN true ELSE {r} >= 0.8 END)"""


def score(kind: str) -> str:
    key = {"document": "page_count"}.get(kind, "duration")
    if kind == "image":
        bucketed = f"bk AS (SELECT path, {sql._tier(sql.PIXELS)} AS bucket FROM prep)"
    else:
        bucketed = f"""vals AS (SELECT DISTINCT {key}::DOUBLE AS v FROM prep WHERE {key} IS NOT NULL), anch(v) AS (SELECT min(v) FROM vals UNION SELECT (SELECT min(x.v) FROM vals x WHERE x.v - anch.v > 4) FROM anch WHERE anch.v IS NOT NULL),
bk AS (SELECT path, (SELECT max(a.v) FROM anch a WHERE a.v <= prep.{key}) AS bucket FROM prep)"""
    raw = {
        "duration": sql._linear("a.duration", "b.duration", 5.0), "resolution": sql._share("a.width::BIGINT * a.height", "b.width::BIGINT * b.height"), "file_size": sql._share("a.file_size", "b.file_size"),
        "page_count": page_count(), "exif": sql._exif(), "tags": tags(), "doc_meta": doc_meta(),
        "filename": f"CASE WHEN {EXCLUDED} OR (r < 0.85 AND {_OWN_WORD.format('a', 'b')} AND {_OWN_WORD.format('b', 'a')}) THEN 0.0 ELSE r END",
    }
    weights = WEIGHTS[kind]
    total = " + ".join(f"coalesce(raw_{k} * {w}, 0)" for k, w in weights.items())
    return f"""WITH RECURSIVE {similar(kind)}, {bucketed}, pairs AS (SELECT a.path AS path_a, b.path AS path_b FROM bk a JOIN bk b ON a.bucket IS NOT DISTINCT FROM b.bucket AND a.path < b.path UNION SELECT path_a, path_b FROM cross_),
rated AS (SELECT path_a, path_b, a, b, {ratio("a.words", "b.words")} AS r, coalesce(a.name = b.name AND a.file_size = b.file_size AND a.file_size > 0, false) AS identical FROM pairs JOIN prep a ON a.path = path_a JOIN prep b ON b.path = path_b),
raws AS (SELECT path_a, path_b, identical, {", ".join(f"{raw[k]} AS raw_{k}" for k in weights)} FROM rated),
totals AS (SELECT path_a, path_b, identical, CASE WHEN identical THEN 100.0 ELSE {total} END AS total FROM raws WHERE identical OR raw_filename >= {GATE})
SELECT path_a, path_b, round(total, 6) AS total, round(total, 1) AS score, identical FROM totals WHERE total >= 50"""


def alerts(threshold: int = 85) -> str:
    from echofold.streaming.watch import default_weights

    stem = lambda s: f"lower({sql._stem(f'{s}.path')})"
    share = lambda x, y: f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 0.0 WHEN {x} = 0 AND {y} = 0 THEN 1.0 ELSE least({x}, {y}) / greatest({x}, {y})::DOUBLE END"
    raw = {
        "filename": f"CASE WHEN greatest(length({stem('a')}), length({stem('b')})) = 0 THEN 1.0 ELSE 1 - levenshtein({stem('a')}, {stem('b')}) / greatest(length({stem('a')}), length({stem('b')})) END",
        "duration": "CASE WHEN a.duration IS NULL OR b.duration IS NULL THEN 0.0 WHEN a.duration = 0 AND b.duration = 0 THEN 1.0 ELSE greatest(0.0, 1 - abs(a.duration - b.duration) / (greatest(a.duration, b.duration) * 0.1)) END",
        "resolution": share("(a.width::BIGINT * a.height)", "(b.width::BIGINT * b.height)"), "file_size": share("a.file_size", "b.file_size"),
    }
    value = "CASE a.kind " + " ".join(f"WHEN '{k}' THEN (" + " + ".join(f"({raw[x]}) * {w}" for x, w in default_weights(k).items()) + f") / {sum(default_weights(k).values())}" for k in ("video", "image", "audio", "document")) + " END"
    return f"""WITH {sql.LATEST}, k AS (SELECT *, {sql._kind("path")} AS kind FROM latest), s AS (SELECT a.path AS path, b.path AS match, round({value} * 100)::INT AS score FROM k a JOIN k b ON a.kind = b.kind AND a.path > b.path
WHERE a.duration IS NULL OR b.duration IS NULL OR abs(a.duration - b.duration) <= 2) SELECT * FROM s WHERE score >= {threshold}"""


def queries() -> dict[str, str]:
    base = "regexp_extract({0}, '([^/]*)$', 1)"
    att = f"WITH {sql.BOTH}"
    out = {f"score_{k}": score(k) for k in ("video", "image", "audio", "document")}
    out["score_auto"] = f"SELECT * FROM ({out['score_video']}) UNION ALL SELECT * FROM ({out['score_image']})"
    return out | {
        "x3_ratios": f"WITH {sql.LINKED}, n AS (SELECT path_a, path_b, {base.format('path_a')} AS x, {base.format('path_b')} AS y FROM linked) SELECT path_a, path_b, round({ratio('x', 'y')}, 6) AS ratio FROM n",
        "c8_tags": f"{att} SELECT path_a, path_b, round({tags()}, 6) AS tags FROM att",
        "c10_pages_and_documents": f"WITH RECURSIVE {sql._buckets('document', 'page_count')} SELECT a.path AS path_a, b.path AS path_b, round({page_count()}, 6) AS page_count, round({doc_meta()}, 6) AS doc_meta FROM bucketed a JOIN bucketed b ON a.bucket IS NOT DISTINCT FROM b.bucket AND a.path < b.path",
        "j9_similar_names": f"WITH {similar('video')} SELECT path_a, path_b FROM cross_",
        "t1_incremental_alerts": alerts(),
    }
