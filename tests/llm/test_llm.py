import pickle
import random

import numpy as np
import pandas as pd
import pytest

from echofold.llm import arrivals, components, leakage, neighbours, packing, quality, signatures, spellings, store, survivors, words

PAIRS = "path_a string, path_b string, score double, other string"


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def linked(spark, edges):
    rows = [(a, b, 80.0, "x") for a, b in edges]
    return {r.path: r.group_path for r in components.consolidate(spark.createDataFrame(rows, PAIRS)).collect()}


def test_components_of_chains_cycles_hubs_and_noise(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 9:02}") for i in range(9)]
    hub = [("hub", f"h{i:03}") for i in range(60)] + [("h001", "h002"), ("h002", "h003")]
    clique = [(f"q{i}", f"q{j}") for i in range(6) for j in range(i)]
    bridge = [("q0", "b1"), ("b1", "b2"), ("b2", "r00")]
    edges = chain + ring + hub + clique + bridge + [("a", "b"), ("b", "a"), ("a", "b")]
    assert linked(spark, edges) == union_find(edges)


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(150)}", f"m{rnd.randrange(150)}") for _ in range(140)]
    assert linked(spark, edges) == union_find(edges)


def test_components_ignore_unusable_rows(spark):
    rows = [("a", "b", None, "x"), ("a", "b", float("nan"), "x"), ("a", None, 90.0, "x"), ("c", "c", 90.0, "x"), ("d", "e", 69.9, "x"), ("g", "f", 70.0, None)]
    got = components.consolidate(spark.createDataFrame(rows, PAIRS)).collect()
    assert {(r.path, r.group_path) for r in got} == {("f", "f"), ("g", "f")}
    assert components.consolidate(spark.createDataFrame([], PAIRS)).count() == 0


ENTRY = "struct<path:string,duration:double,file_size:bigint,bitrate:bigint,mtime:double,is_reference:boolean>"
GROUPS = f"group_id int, generated_at string, files array<{ENTRY}>, entries string"


def test_survivors_rank_and_miss(spark):
    e = lambda p, s, b, t, r=None: (p, 1.0, s, b, t, r)
    rows = [
        (1, "1970-01-02T00:00:00+00:00", [e("b", 5, 0, 90000.0), e("a", 5, None, 100.0), e("c", 9, 7, 50.0, True), None, e(None, 9, 9, 9.0)], ""),
        (2, "nonsense", [e("y", 3, 3, 5e9), e("x", 3, 3, 5e9), e("x", 3, 3, 5e9)], ""),
        (3, None, [], ""),
        (4, None, None, ""),
        (5, "2020-01-01T00:00:00Z", [e("z", 0, -1, float("nan"))], ""),
    ]
    got = {(r.group_id, r.field_name): r.path for r in survivors.found_entries(spark.createDataFrame(rows, GROUPS)).collect()}
    assert got == {(1, "record"): "c", (1, "file_size"): "c", (1, "bitrate"): "c", (1, "mtime"): "c", (2, "record"): "x", (2, "file_size"): "x", (2, "bitrate"): "x", (2, "mtime"): "x", (5, "record"): "z"}
    assert survivors.found_entries(spark.createDataFrame([], GROUPS)).count() == 0


def test_current_values_follow_the_learnt_order(spark):
    e = lambda p, b, t: (p, 1.0, 10, b, t, False)
    rows = [(k, None, [e("a", 1000, 10.0), e("b", 64000, 20.0)], "") for k in range(5)] + [(9, None, [e("new", 65000, None), e("old", 1010, None)], "")]
    got = {(r.group_id, r.field_name): (r.path, r.inferred) for r in survivors.current_values(spark.createDataFrame(rows, GROUPS)).collect()}
    assert got[0, "bitrate"] == ("b", False) and got[9, "bitrate"] == ("new", True)
    hidden = {r.field_name: r for r in survivors.hidden_times(spark.createDataFrame(rows[:-1] * 6, GROUPS).selectExpr("cast(monotonically_increasing_id() % 1000 as int) as group_id", "generated_at", "files", "entries")).collect()}
    assert hidden["bitrate"].n == hidden["bitrate"].right > 0 and hidden["file_size"].n == 0


def test_a_groups_partial_order():
    net = survivors.net_precedence([(1, 2, 5), (2, 3, 4), (3, 1, 1), (2, 1, 1)])
    assert net == {(1, 2): 4, (2, 3): 4, (3, 1): 1}
    assert survivors.partial_order([1, 2, 3], [], net) == {1: set(), 2: {1}, 3: {1, 2}}
    assert survivors.partial_order([1, 2], [(2, 1)], net) == {1: {2}, 2: set()}  # own times come first
    pick = lambda *e: survivors._pick([dict(zip("kt", x, strict=True)) for x in e], net)
    assert pick((1, 5.0), (2, None)) == 1 and pick((2, 5.0), (1, None)) == 0 and pick((9, None), (8, None)) == 0
    assert pick((2, 1.0), (1, 2.0), (3, None)) == 1 and pick((7, 1.0), (9, None)) == 0


def test_words_without_case_accents_markup_and_layout():
    assert words.words_of("<b>CAFÉ</b> pr­int fr​ame exam-\nple a_b **x**") == ["cafe", "print", "frame", "example", "a", "b", "x"]
    assert words.words_of("see [the page](http://a.b/c_d) &amp; more") == ["see", "the", "page", "more"]
    assert words.words_of(None) == [] and words.words_of("  ") == []


@pytest.mark.parametrize("joined", [False, True])
def test_leaks_need_twelve_words(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, "zz " + text.upper().replace(" ", ",\n"), ""), (2, " ".join(text.split()[:11]), ""), (3, None, ""), (4, "", ""), (5, "x " * 5000 + text, ""), (1, "other words", "")]
    items = [(7, text, ""), (8, "too short", ""), (9, None, ""), (7, text, "")]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string").drop("doc_id"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 7), (5, 7)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string, e string"), none).count() == 0


@pytest.mark.parametrize("joined", [False, True])
def test_near_leaks_by_weighted_shingles(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ado", "eki", "ilu", "opa", "uvo")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(20)]
    docs = []
    for i, text in items:
        w = text.split()
        w[20] = "changed"  # 19 windows of 12 words stay, ten hold the change
        docs.append((i, " ".join(w)))
        docs.append((100 + i, " ".join(x if k % 11 else "other" for k, x in enumerate(w))))  # no window stays
    df = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    exact = {(r.doc_id, r.item_id) for r in leakage.leaks(df(docs, "doc_id"), df(items, "item_id")).collect()}
    assert exact == {(i, i) for i in range(20)}
    near = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in leakage.leaks(df(docs, "doc_id"), df(items, "item_id"), radius=5, similarity=0.6).collect()}
    found = {p for p in near if p[0] >= 100}
    assert exact <= set(near) and len(found) >= 10 and all(d - 100 == i for d, i in found)
    test_near_leaks_by_weighted_shingles.seen = getattr(test_near_leaks_by_weighted_shingles, "seen", near)
    assert near == test_near_leaks_by_weighted_shingles.seen  # one verifier: the same answers either way


def test_simhash_windows_equal_a_plain_count():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    got = leakage.window_simhashes(h, 12)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    assert all((np.unpackbits(got[k : k + 1].view(np.uint8)) == (bits[k : k + 12].sum(0) > 6)).all() for k in range(29))


@pytest.mark.parametrize(
    "text,kind",
    [
        ("We copied the old tapes after the party, and nobody knew where the labels were. The box was in the attic.", "prose"),
        ("a,b,c\n1,2,3\n4,5,6\n7,8,9\n2,2,1\n", "table"),
        ("| a | b |\n| --- | --- |\n| 1 | x |\n| 2 | y |", "table"),
        ("- milk\n- bread\n- butter\n- cheese", "list"),
        ("title: x\nsize: 4\nowner: me\nstate: new", "list"),
        ("/a/b/one.mp3\n/a/b/two.mp3\n/a/c/three.mp3", "list"),
        ("q8Hf+/zR2kLmN0pQ9sTuVwXyZaBcDeFgHiJkLmNoPqRsTuVwXyZ0123456789+/AB\n" * 4, "junk"),
        ("We are testing this line. " * 40, "junk"),
        ("The House of the Sea\nA Night in the City\nOver the Hills and Far\nAll of It Was You\nThe One Who Is Not There\nIn the Shade of a Tree", "list"),
        ("camera\n  lens\n  body\nrecorder\n  tape\n  battery\nprojector\n  lamp\n  reel", "list"),
        ("%$#@ ^&* !!~ <<>> ||| ==== +++ %%% ### @@@", "junk"),
    ],
)
def test_kinds(text, kind):
    assert quality.kind_of(text) == kind


def test_statistics_of_blank_and_long_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "The cat sat on the mat.\n" * 3000, "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in quality.document_statistics(df).collect()}
    assert got[1].words == got[2].words == got[3].words == 0 and got[1].kind is None and got[3].kind is None
    assert got[4].words == 18000 and got[4].ended_lines == 1.0 and got[4].common_words == 0.5
    assert {(r.doc_id, r.kind) for r in quality.unnatural(df).collect()} == {(4, "junk")}


def test_alignment_and_periodicity():
    assert quality.alignment(["a\tb", "c\td", "e\tf"]) == 1.0 and quality.alignment(["one", "two"]) == 0.0
    assert quality.periodicity(["a", "  b", "a", "  b", "a", "  b", "a", "  b"]) > 0.6
    assert quality.echo(["long line here", "x"] * 6) > 0.6 and quality.echo(["same"] * 6) == quality.echo([]) == 0.0
    wrapped = "we looked at all of\nthe tapes, and then\nthe band went home,\nas it was late in\nthe day and nobody\nhad a key".split("\n")
    assert quality.fullness(wrapped) == 1.0 and not quality.entries_layout(wrapped)


def test_names_in_plain_form():
    assert spellings.plain("The_Scattered Blanket, vol. IV") == (("scattered", "blanket"), (4,))
    assert spellings.same_name(("timothy", "bekibriski"), ("bekibriski", "t")) > 0.7
    assert spellings.same_name(("danieltrostetrala",), ("daniel", "trostetrala")) > 0.9
    assert spellings.same_name(("kenneth", "gekihalo"), ("susannah", "gekihalo")) == -1.0
    assert spellings.plain("dorireze, a")[0] == ("dorireze", "a") and spellings.plain("a. dorireze")[0] == ("a", "dorireze") and spellings.plain("a song of x")[0] == ("song", "x")
    assert spellings.word_match("yth.", "youth") == 0.8 and spellings.word_match("yth.", "month") == 0.0
    assert spellings.distance("abcd", "abdc", 2) == 1


def test_spellings_found(spark):
    names = ["william brigalabo", "brigalabo, w.", "willims brigalabo", "bill brigalabo", "susannah brigalabo", "various artists", "", "Björk Gudmund", "bjork_gudmund", None]
    df = spark.createDataFrame([(n, None, "song of x, part 2" if k % 2 else "Song of X pt. II", k) for k, n in enumerate(names)], "tag_artist string, tag_title string, tag_album string, id long")
    got = {(r.field_name, r.name_a, r.name_b) for r in spellings.found_pairs(df).collect()}
    will = sorted(n for n in names if n and ("w" in n.split() or n.startswith(("will", "bill", "brigalabo, w"))))
    expected = {("tag_artist", a, b) for a in will for b in will if a < b} | {("tag_artist", "Björk Gudmund", "bjork_gudmund"), ("tag_album", "Song of X pt. II", "song of x, part 2")}
    assert got == expected
    assert spellings.found_pairs(df.limit(0)).count() == 0


def test_spellings_of_common_words_only(spark):
    given = "timothy william barbara kenneth susannah matilda stephen nicholas lawrence rebecca harold walter jennifer theodore charles daniel gregory leonard patrick raymond victoria martha".split()
    family = [f"{a}{b}lo" for a in ("beki", "trosta", "hupsu", "gafena", "zuhe") for b in ("bri", "te", "ka", "mo", "nu")][:22]
    names = [f"{g} {f}" for g in given for f in family]  # each word in 22 forms
    typed = {"timothy bekibrilo": ["timoxhy bekibrilo", "timothy bekibxilo", "t bekibrilo"], "harold trostatelo": ["harld trostatelo"], "martha gafenabrilo": ["marthagafenabrilo"]}
    rows = names + [v for vs in typed.values() for v in vs]
    df = spark.createDataFrame([(n, None, None) for n in rows], "tag_artist string, tag_title string, tag_album string")
    got = {(r.name_a, r.name_b) for r in spellings.found_pairs(df).collect()}
    assert {tuple(sorted((n, v))) for n, vs in typed.items() for v in vs} <= got


def test_average_linkage_over_all_pairs():
    v = {1: {1: 1.0}, 2: {1: 0.8, 2: 0.6}, 3: {2: 1.0}}
    got = spellings.average_linkage(v, {(1, 2): (0.8, 0.8), (2, 3): (0.7, 0.6), (1, 3): (-1.0, 0.0)}, 0.3)
    assert got[1] == got[2] != got[3]
    got = spellings.average_linkage(v, {(1, 2): (0.8, 0.8), (2, 3): (0.7, 0.6)}, 0.3)  # 1 and 3 count with their cosine, 0
    assert got[1] == got[2] == got[3]
    assert spellings.average_linkage(v, {(1, 2): (0.8, 0.8), (2, 3): (0.5, 0.6)}, 0.3)[3] == 3


def test_slips_are_put_right(spark):
    rows = [("tag_title", "warehouse", 60), ("tag_title", "warehuose", 2), ("tag_title", "watrehuse", 3), ("tag_title", "warehousing", 1), ("tag_title", "ware.", 1), ("tag_album", "warehuose", 1), ("tag_title", "wherehouse", 4)]
    got = {(r.field_name, r.word): r["head"] for r in spellings.slips(spark.createDataFrame(rows, "field_name string, word string, df long")).collect()}
    assert got == {("tag_title", "warehuose"): "warehouse", ("tag_title", "watrehuse"): "warehouse"}


def test_words_are_compared_without_walking_the_nicknames_again(monkeypatch):
    def plain(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(6)
    for _ in range(1500):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choice(["", "a", "d", "cb"])
        b, most = "".join(b), rng.randint(0, 4)
        assert min(spellings.distance(a, b, most), most + 1) == min(plain(a, b), most + 1)
    assert spellings.word_match("bobb", "roberta") == 0.7 and spellings.word_match("bobb", "stephen") == 0.0
    # the names that a short word may stand for are looked up once, not for each of its pairs
    calls, real = [], spellings.distance
    monkeypatch.setattr(spellings, "distance", lambda *x: calls.append(x) or real(*x))
    for k in range(300):
        spellings.word_match("mikke", f"w{k:03}xq")
    assert len(calls) < 3000


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([c + 0.25 * rng.normal(size=(n, 16)) for c, n in zip(centres, (120, 60, 30, 10, 4, 1), strict=True)])
    x[5:25] = x[5]  # more copies than k
    rows = [(f"p{i:03}", 1.0, [float(v) for v in r], "x") for i, r in enumerate(x.astype(np.float32))]
    rows += [("null", 1.0, None, "x"), ("zero", 1.0, [0.0] * 16, "x"), ("short", 1.0, [1.0], "x"), ("p000", 0.5, [9.0] * 16, "x"), (None, 1.0, [1.0] * 16, "x"), rows[3]]
    df = spark.createDataFrame(rows, "path string, mtime double, embedding array<float>, id string")
    got = {(r.path_a, r.path_b) for r in neighbours.found_pairs(df, dims=16, sample=150, probes=60, block=40).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = np.round(y @ y.T, 6)
    true = set()
    for i in range(len(s)):
        near = sorted((j for j in range(len(s)) if j != i), key=lambda j: (-s[i, j], j))[:10]
        true |= {tuple(sorted((f"p{i:03}", f"p{j:03}"))) for j in near if s[i, j] >= 0.62}
    assert len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.95 * len(got)
    assert neighbours.found_pairs(df.limit(0), dims=16).count() == 0
    # leaves beyond a block are split where they are, and cut into blocks where no split helps
    got = {(r.path_a, r.path_b) for r in neighbours.found_pairs(df, dims=16, sample=30, probes=30, block=8).collect()}
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.9 * len(got)


def test_neighbours_in_turns_hand_a_vector_on_once(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 16)) for c in rng.normal(size=(8, 16))]).astype(np.float32)
    df = spark.createDataFrame([(f"p{i:03}", 1.0, [float(v) for v in r]) for i, r in enumerate(x)], "path string, mtime double, embedding array<float>")
    pairs = lambda **more: sorted(neighbours.found_pairs(df, dims=16, sample=120, probes=60, block=20, **more).collect())
    assert pairs(copies=150) == pairs() and len(pairs()) > 1000
    # a vector that visits all leaves of a subtree comes out once, not once for each of them
    unit = neighbours._unit(x)
    tree = neighbours.fit_tree(unit)
    rows = spark.createDataFrame([(f"p{i:03}", bytearray(v.tobytes()), "0", True) for i, v in enumerate(unit)], "id string, vec binary, leaf string, own boolean")
    trees = spark.createDataFrame([("0", bytearray(pickle.dumps(tree)), 3)], "leaf string, tree binary, tasks long")
    out = neighbours._split(rows, trees, 16, -2.0).collect()
    assert len(out) == len(x) and all(sorted(r.subs) == sorted(tree.leaves) for r in out)
    assert {r.id: r.subs[0] for r in out} == {f"p{i:03}": b[0] for i, b in enumerate(neighbours.best_bins(tree, unit))}


def flip(v, share, rng, word):
    bits = np.unpackbits(np.asarray(v, "<i8").view(np.uint8).reshape(-1, 8)[:, : word // 8].copy(), axis=1)
    bits ^= (rng.random(bits.shape) < share).astype(np.uint8)
    b = np.packbits(bits, axis=1)
    full = np.zeros((len(b), 8), np.uint8)
    full[:, : b.shape[1]] = b
    return [int(x) for x in full.view("<i8").ravel()]


def hash_rows(seed=4):
    rng = np.random.default_rng(seed)
    fresh = lambda n: [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 4 * n, dtype=np.int64)]
    rows, cases, eid = [], set(), 0

    def put(v, batch, rot=False, case=False):
        nonlocal eid
        eid += 1
        rows.append((eid, batch, v, rot, "x"))
        if case:
            cases.add(eid)

    base = [fresh(1) for _ in range(40)]
    for v in base:
        put(v, 0)
    video, turned = fresh(8), fresh(8)
    put(video, 0)
    put(turned, 0, True)
    for v in base[:20]:
        put(flip(v, 0.08, rng, 64), 1, case=True)
    put(base[3], 1, case=True)
    put(flip(video[8:24], 0.1, rng, 64), 2, case=True)
    put(flip(video[12:16], 0.1, rng, 64), 2, case=True)
    put(flip(turned[20:24], 0.1, rng, 64), 2, case=True)
    put(None, 1)
    put([], 1)
    put(fresh(2), 2)
    put(flip(base[30], 0.45, rng, 64), 3)
    put(fresh(1)[:3], 3)
    return rows, cases


def test_repeats_of_hashes(spark):
    rows, cases = hash_rows()
    df = spark.createDataFrame(rows, "entry_id long, batch_no int, hashes array<long>, rotation_invariant boolean, id string")
    assert {r.id for r in arrivals.repeats(df, "hashes", signatures.HASHES).collect()} == cases
    assert arrivals.repeats(df.limit(0), "hashes", signatures.HASHES).count() == 0


def test_crowded_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_UNITS", 8)
    rows, cases = hash_rows(9)
    df = spark.createDataFrame(rows, "entry_id long, batch_no int, hashes array<long>, rotation_invariant boolean, id string")
    got = {r.id for r in arrivals.repeats(df, "hashes", signatures.HASHES).collect()}
    assert got <= cases and len(got) >= 0.9 * len(cases)


def test_repeats_of_prints(spark):
    rng = np.random.default_rng(8)
    base = [[int(x) for x in rng.integers(0, 1 << 32, 40)] for _ in range(10)]
    rows = [(i, 0, v) for i, v in enumerate(base)] + [(100 + i, 1, flip(v, 0.1, rng, 32)[3:36]) for i, v in enumerate(base[:6])] + [(200, 1, [int(x) for x in rng.integers(0, 1 << 32, 30)]), (201, 1, None), (202, 1, [base[0][0]])]
    df = spark.createDataFrame(rows, "entry_id long, batch_no int, fingerprint array<long>")
    got = {r.id for r in arrivals.repeats(df, "fingerprint", signatures.PRINTS).collect()}
    assert {100, 101, 102, 103, 104, 105} <= got and 200 not in got and 201 not in got


def test_repeated_pairs(spark):
    rows = [(1, 0, "a", "b", 1.0, 2.0, "AB"), (2, 1, "b", "a", 2.0, 1.0, " ab\n"), (3, 1, "a", "b", 2.0, 1.0, "ab"), (4, 0, "a", "b", 1.0, 2.0, "ab"), (5, 1, "a", None, 1.0, 2.0, "ab"), (6, 1, "a", None, 1.0, 2.0, "ab")]
    df = spark.createDataFrame(rows, "entry_id long, batch_no int, path_a string, path_b string, mtime_a double, mtime_b double, config_hash string")
    assert {r.id for r in arrivals.repeated_pairs(df).collect()} == {2}


def test_store_adds_batch_by_batch(spark, tmp_path):
    rows, cases = hash_rows(6)
    df = pd.DataFrame(rows, columns=["id", "batch", "v", "rotated", "x"])
    open_store = lambda: store.BucketStore(spark, str(tmp_path / "store"), signatures.HASHES, units=1000)
    s, got = open_store(), set()
    for number, g in df.groupby("batch"):
        part = spark.createDataFrame([(r.id, r.v if isinstance(r.v, list) else None, r.rotated) for r in g.itertuples()], "id long, v array<long>, rotated boolean").where("size(v) % 4 = 0")
        first = {r.id for r in s.add(part, number).collect()}
        assert {r.id for r in s.add(part, number).collect()} == first  # a second attempt doubles nothing
        got |= first
        s = open_store().open(s.numbers)
    assert {c for c in cases if dict((r[0], r[1]) for r in rows)[c]} == got


def test_a_small_batch_reads_few_folders_of_fine_buckets(spark, tmp_path):
    rng = np.random.default_rng(11)
    s = store.BucketStore(spark, str(tmp_path / "store"), signatures.HASHES, units=4000, each=2, most_parts=1 << 20)
    v = rng.integers(-(1 << 63), 1 << 63, (10, 4), dtype=np.int64)
    asking = signatures.units_of(spark.createDataFrame([(i, [int(x) for x in r], False) for i, r in enumerate(v)], "id long, v array<long>, rotated boolean"), s.shape, s.bits, s.bands)
    assert len(s.touched(asking)) <= 10 * s.bands <= 0.01 * s.parts


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(2)
    items = [(i, rnd.choice([rnd.randrange(1, 60), rnd.randrange(60, 400), rnd.randrange(1, 101)])) for i in range(3000)] + [(9000, 1050), (9001, 0), (9002, None), (9003, 100), (9003, 100)]
    got = packing.pack(spark.createDataFrame(items, "doc_id long, n_tokens long"), 100).toPandas()
    full = got.groupby("container")["length"].sum()
    total = sum(n or 0 for _, n in items)
    assert full.max() <= 100 and got["length"].sum() == total
    assert len(full) <= 1.02 * total / 100 + 1 and set(full.index) == set(range(len(full)))
    split = got.groupby("doc_id").size()
    big = {i for i, n in items if n and n > 100}
    assert set(split[split > 1].index) - {9003} <= big
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 100).count() == 0


def test_nnls_and_combinations():
    a, b = np.array([[1.0, 1], [0, 2], [1, 0]]), np.array([3.0, 2, 2])
    assert np.allclose(packing.nnls(a, b), [2, 1])
    assert (packing.nnls(-np.eye(2), np.ones(2)) == 0).all()
    assert all(sum(c) == 8 and list(c) == sorted(c, reverse=True) for c in packing.combinations(8)) and len(packing.combinations(8)) == len(set(packing.combinations(8))) == 10


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1
