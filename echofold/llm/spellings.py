"""Variant spellings of names typed by people.

Each distinct string gets a plain form: lower case, no accents, signs, articles or joining words, nicknames written out,
part and volume numbers apart, and words that are a slip away from one many times as frequent put right. Forms become sparse
weighted vectors of character n-grams; a distributed prefix join finds the pairs that can reach a cosine, whose exact cosine
is then computed and thresholded, and each name keeps its best partners. Words laid side by side (typos, initials,
abbreviations, missing blanks) are evidence for or against a pair. Average linkage groups what holds together, over all
pairs: those that were never compared count with their cosine, as two clusters' sums of vectors tell it.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.llm.components import components_of_ids
from echofold.session import cut

# Common short forms of given names, and the names they stand for.
NICKNAMES = {
    short: full
    for full, shorts in {
        "abigail": "abby gail", "albert": "al bert bertie", "alexander": "alex alec sandy xander", "alfred": "alf alfie", "amanda": "mandy", "andrew": "andy drew", "anthony": "tony", "archibald": "archie",
        "arthur": "art artie", "barbara": "babs barb barbie", "benjamin": "ben benny benji", "bernard": "bernie", "caroline": "caro carrie", "catherine": "cathy cath", "charles": "charlie chuck chaz", "charlotte": "lottie",
        "christine": "chrissy tina chrissie", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dorothy": "dot dottie dolly", "edward": "ed eddie eddy ned", "eleanor": "ellie nell nora",
        "elizabeth": "liz lizzie beth betty eliza libby bess", "emily": "em", "francis": "frank frankie", "frederick": "fred freddie freddy", "gabrielle": "gabby gaby", "geoffrey": "geoff", "george": "georgie", "gerald": "gerry", "gregory": "greg",
        "harold": "hal harry", "helen": "nellie", "isabella": "bella izzy belle", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "jessica": "jess jessie", "jonathan": "jon jonny", "john": "jack johnny", "joseph": "joe joey",
        "joshua": "josh", "judith": "judy", "katherine": "kate katie kathy kitty kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "louis": "lou", "lucille": "lucy", "madeleine": "maddie", "margaret": "maggie meg peggy marge peg",
        "martha": "patty", "matilda": "tilly mattie tilda", "matthew": "matt", "michael": "mike mick mikey micky", "nancy": "nan", "nathaniel": "nate nat", "nicholas": "nick nicky", "oliver": "ollie olly", "olivia": "liv livvy", "patricia": "pat trish patsy tricia",
        "patrick": "paddy", "peter": "pete", "philip": "phil", "philippa": "pippa pip", "raymond": "ray", "rebecca": "becky becca", "richard": "dick rick rich ricky richie", "robert": "bob bobby rob robbie", "ronald": "ron ronnie", "samuel": "sam sammy",
        "sarah": "sally", "stephen": "steve stevie", "susannah": "sue susie suzy", "theodore": "ted teddy theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky vicki tori", "walter": "walt wally",
        "william": "bill billy will willy willie", "zachary": "zach zack",
    }.items()
    for short in shorts.split()
}
# What stands for unknown or mixed artists.
PLACEHOLDERS = (
    "various artists, various, various artist, va, v a, v.a., unknown artist, unknown, artist unknown, unknown artists, no artist, artist, n a, none, null, anonymous, anon, untitled, untitled artist, "
    "mixed artists, mixed, several artists, divers, verschiedene, verschiedene interpreten, varios, varios artistas, artistes divers, compilation, track artist, tba, misc, miscellaneous"
).split(", ")
_ROMAN = {r: i for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}
_SPELT = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
_COUNTERS = frozenset("part pt volume vol no nr number disc disk cd book chapter episode ep season series".split())
_DROPPED = frozenset("the a an of and with feat ft".split())
_PIECE = re.compile(r"[^\W_]+\.?")
FIELDS = ("tag_artist", "tag_title", "tag_album")


def plain(name: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """The words in order (an abbreviation keeps its point) and the numbers of a name."""
    s = unicodedata.normalize("NFKD", html.unescape(name).casefold())
    s = "".join(c for c in s if not unicodedata.combining(c)).replace("_", " ").replace("w/", " with ")
    s = re.sub(r"[’'`´]", "", s)
    pieces = _PIECE.findall(s)
    words, numbers = [], []
    for k, p in enumerate(pieces):
        w = p.rstrip(".")
        before = pieces[k - 1].rstrip(".") if k else ""
        if w.isdigit():
            numbers.append(int(w))
        elif before in _COUNTERS and (w in _ROMAN or w in _SPELT):
            numbers.append(_ROMAN.get(w) or _SPELT[w])
        elif k and k == len(pieces) - 1 and len(w) > 1 and w in _ROMAN:
            numbers.append(_ROMAN[w])
        elif (m := re.fullmatch(r"(part|pt|vol|volume|no|nr|cd|disc)(\d+)", w)) is not None:
            numbers.append(int(m[2]))
        elif w in _COUNTERS and k + 1 < len(pieces) and (pieces[k + 1].rstrip(".").isdigit() or pieces[k + 1].rstrip(".") in _ROMAN or pieces[k + 1].rstrip(".") in _SPELT):
            continue
        elif w not in _DROPPED or len(pieces) == 1 or w == "a" and (p == "a." or k and k == len(pieces) - 1 or len(pieces) == 2):  # an initial
            words.append(p if p.endswith(".") and len(w) > 1 and k + 1 <= len(pieces) else w)
    return tuple(words), tuple(sorted(numbers))


def grams_of(word: str, n: int = 4) -> list[str]:
    return [word[k : k + n] for k in range(len(word) - n + 1)] or [word]


@lru_cache(maxsize=1 << 16)
def _letters(word: str) -> Counter[str]:
    return Counter(word)


@lru_cache(maxsize=1 << 16)
def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) from a to b; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) + len(b) > 12:  # an edit takes one letter of a, brings one of b, or both
        own = _letters(a)
        both = sum(min(n, own[c]) for c, n in _letters(b).items() if c in own)
        if max(len(a), len(b)) - both > most:
            return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _slack(a: str, b: str) -> int:
    n = max(len(a), len(b))
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 11 else 3


def _skeleton(short: str, full: str) -> bool:
    """Whether all letters of an abbreviation stand in the word in their order, from the first on."""
    rest = iter(full)
    return len(short) > 1 and short[0] == full[0] and all(c in rest for c in short)


@lru_cache(maxsize=1 << 16)
def _written_out(short: str) -> tuple[str, ...]:
    """What a nickname stands for, mistyped by one edit or not."""
    return tuple(f for s, f in NICKNAMES.items() if abs(len(s) - len(short)) <= 1 and s[0] == short[0] and distance(s, short, 1) <= 1)


@lru_cache(maxsize=1 << 16)
def word_match(a: str, b: str) -> float:
    """How far two words can be the same: 1.0 equal, less for nicknames, typos, abbreviations and initials, 0.0 not at all."""
    p, q = a.rstrip("."), b.rstrip(".")
    if p == q:
        return 1.0
    x, y = NICKNAMES.get(p, p), NICKNAMES.get(q, q)
    if x == y:
        return 0.95
    if len(p) > len(q):
        a, b, p, q, x, y = b, a, q, p, y, x
    if len(p) == 1:
        return 0.6 if q.startswith(p) or y.startswith(p) else 0.0
    if a.endswith(".") and (q.startswith(p) or len(p) > 3 and distance(p, q[: len(p)], 1) <= 1 or _skeleton(p, q)):
        return 0.8
    d = min(distance(p, q, _slack(p, q)), distance(x, y, _slack(x, y)))
    if x == p and y != q or x != p and y == q:  # a mistyped nickname
        d = min(d, 1 + distance(x, y, _slack(x, y)))
    for short, full in ((p, q), (q, p)):
        if 3 <= len(short) <= 6 and d > 1:
            if any(distance(f, full, 1) <= 1 for f in _written_out(short)):
                return 0.7
    return max(0.0, 1 - 0.12 * d) if d <= _slack(p, q) else 0.0


def same_name(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """How far two names without their numbers can be one entity's, up to 1.0: every word of the shorter has its own partner in the longer, and the longer has only initials besides; or both read nearly alike without blanks.

    -1.0 where they contradict each other (some words agree, others exclude each other), 0.0 where nothing can be told.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a or not b:
        return 0.0
    scores = sorted(((word_match(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a, used_b, total, strong = set(), set(), 0.0, 0
    for s, i, j in scores:
        if s > 0 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            total += s
            strong += s > 0.6 and len(a[i].rstrip(".")) > 3
    rest = [y for j, y in enumerate(b) if j not in used_b]
    if len(used_a) == len(a) and strong and all(len(y.rstrip(".")) == 1 for y in rest) and (len(a) > 1 or len(b) == 1):
        return total / len(a)
    best = 0.0
    for x, y in (("".join(a), "".join(b)), ("".join(sorted(a)), "".join(sorted(b))), ("".join(a), "".join(b[1:] + b[:1])), ("".join(a), "".join(NICKNAMES.get(w, w) for w in b))):
        x, y = x.replace(".", ""), y.replace(".", "")
        n = max(len(x), len(y))
        most = int(0.17 * n) if len(a) != len(b) else int(0.12 * n)
        d = distance(x, y, most)
        if n >= 6 and d <= most:
            best = max(best, 1 - d / n)
    return best or (-1.0 if len(a) == len(b) and strong and rest else 0.0)


def _placeholder(words: tuple[str, ...]) -> bool:
    s = " ".join(w.rstrip(".") for w in words)
    return not s or s in PLACEHOLDERS or len(s) >= 7 and any(len(p) >= 7 and distance(s, p, 2) <= 2 for p in PLACEHOLDERS)


def forms(strings: DataFrame) -> DataFrame:
    """(field_name, name, form, words, numbers): the plain form of each string of (field_name, name). Strings without words, and placeholders for artists, drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, s in zip(batch["field_name"], batch["name"], strict=True):
                words, numbers = plain(s)
                if words and not (f == "tag_artist" and _placeholder(words)):
                    rows.append((f, s, " ".join(sorted(words)), " ".join(words), " ".join(map(str, numbers))))
            yield pd.DataFrame(rows, columns=["field_name", "name", "form", "words", "numbers"])

    return strings.mapInPandas(run, "field_name string, name string, form string, words string, numbers string")


def _deletes(word: str, most: int) -> set[str]:
    """The word and what is left of it without one letter, or up to `most` letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


def slips(words: DataFrame, ratio: int = 20) -> DataFrame:
    """(field_name, word, head): words of the table (field_name, word, df) that are at most two edits away from one at least `ratio` times as frequent; the nearest, then the most frequent one.

    Two such words share what is left of them without up to two letters, so the join on these remainders finds them all.
    Words of fewer than four letters and abbreviations stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [sorted(_deletes(w, min(2, _slack(w, w + "x")))) for w in batch["word"]]
            yield batch.assign(key=keys).explode("key")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = np.array([distance(x, y, min(2, _slack(x, y))) for x, y in zip(batch["word"], batch["head"], strict=True)])
            ok = d <= np.array([min(2, _slack(x, y)) for x, y in zip(batch["word"], batch["head"], strict=True)])
            yield batch.assign(d=d)[ok]

    usable = words.where((F.length("word") >= 4) & ~F.col("word").contains("."))
    keyed = usable.mapInPandas(run, "field_name string, word string, df long, key string")
    heads = keyed.where(F.col("df") >= ratio).select("field_name", "key", F.col("word").alias("head"), F.col("df").alias("head_df"))
    met = keyed.join(heads, ["field_name", "key"]).where(F.col("head_df") >= ratio * F.col("df")).select("field_name", "word", "head", "head_df").distinct()
    near = met.mapInPandas(check, "field_name string, word string, head string, head_df long, d long")
    return near.groupBy("field_name", "word").agg(F.min_by("head", F.struct("d", -F.col("head_df"), "head")).alias("head"))


def put_right(named: DataFrame, ratio: int = 20) -> DataFrame:
    """`named` (of forms) with the words of slips() replaced, in words and form."""
    texts = named.select("field_name", "words").distinct()
    tokens = cut(texts.select("field_name", "words", F.posexplode(F.split("words", " ")).alias("at", "word")))
    counts = tokens.groupBy("field_name", "word").agg(F.count_distinct("words").alias("df"))
    heads = slips(counts, ratio)
    fixed = tokens.join(heads, ["field_name", "word"], "left").groupBy("field_name", "words").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("head", "word").alias("w")))).alias("ws"))
    fixed = fixed.select("field_name", "words", F.transform("ws", lambda x: x["w"]).alias("ws"))
    return named.drop("form").join(fixed, ["field_name", "words"]).select("field_name", "name", F.array_join(F.array_sort("ws"), " ").alias("form"), F.array_join("ws", " ").alias("words"), "numbers")


def _marked(own: DataFrame, common: float) -> DataFrame:
    """(id, block, field_name, word, common, bare, single): the words of the forms (id, block, words).

    A word is common if more than `common` of the field's forms have it (20 at least); a form is bare if all its words are, single if
    it has one word only.
    """
    tokens = own.select("id", "block", "field_name", F.explode(F.array_distinct(F.split(F.regexp_replace("words", r"\.", ""), " "))).alias("word"))
    total = own.groupBy("field_name").agg(F.count("*").alias("n"))  # as many rows as fields
    frequent = tokens.groupBy("field_name", "word").count().join(F.broadcast(total), "field_name").where((F.col("count") > F.col("n") * common) & (F.col("count") > 20)).select("field_name", "word", F.lit(True).alias("common"))
    form = Window.partitionBy("id")
    marked = tokens.join(frequent, ["field_name", "word"], "left").withColumn("common", F.coalesce("common", F.lit(False)))
    return marked.withColumn("bare", F.min("common").over(form)).withColumn("single", F.count("*").over(form) == 1)


def _ngrams(word):
    return F.when(F.length(word) > 4, F.transform(F.sequence(F.lit(1), F.length(word) - 3), lambda k: F.substring(word, k, F.lit(4)))).otherwise(F.array(word))


def _features(own: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, block, field_name, gram, word, bare, single, df, w): vectors of the forms: n-grams of rare words, common words whole; of bare forms n-grams too.

    Weights fall with the number of forms that have the gram, and stop growing where fewer than one in a thousand has it.
    """
    total = own.groupBy("field_name").agg(F.count("*").alias("n"))  # as many rows as fields
    whole = F.array(F.concat(F.lit("="), "word"))
    parts = F.when(F.col("bare"), F.concat(whole, _ngrams(F.col("word")))).when(F.col("common"), whole).otherwise(_ngrams(F.col("word")))
    grams = marked.select("id", "block", "field_name", "word", "bare", "single", F.explode(parts).alias("gram")).groupBy("id", "block", "field_name", "bare", "single", "gram").agg(F.min("word").alias("word"))
    df = grams.groupBy("field_name", "gram").agg(F.count("*").alias("df"))
    w = grams.join(df, ["field_name", "gram"]).join(F.broadcast(total), "field_name").withColumn("w", F.log1p(F.col("n") / (F.col("df") + F.col("n") / 1000)))
    return w.select("id", "block", "field_name", "gram", "word", "bare", "single", "df", "w")


def _odd_words(marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three lists of (id, key) for forms that differ in one word while their other words are common, so that no rare n-gram leads from one to the other.

    Of the first, equal keys meet: the odd word (seven letters at most; longer ones keep an n-gram) less one letter, with
    the other words. The second, of mistyped, shortened or initial words, meets the third, of bare forms: the odd
    word's first letter with the other words, and an initial with the n-grams of each other word.
    """
    forms = marked.groupBy("id", "block", "bare").agg(F.array_sort(F.collect_list(F.struct("word", "common"))).alias("ws"))
    each = forms.select("id", "block", "bare", "ws", F.explode("ws").alias("c")).select("id", "block", "bare", "c.word", "c.common", F.filter("ws", lambda x: (x["word"] != F.col("c.word")) & (F.length(x["word"]) > 1)).alias("others"))
    each = each.withColumn("rest", F.array_join(F.transform("others", lambda x: x["word"]), " ")).where("rest != ''")
    odd = each.where(F.forall("others", lambda x: x["common"]) & (F.col("bare") | ~F.col("common")))
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substring(F.col("word"), F.lit(1), k - 1), F.substring(F.col("word"), k + 1, F.length("word"))))
    near = odd.where(F.length("word").between(2, 7)).select("id", F.explode(F.array_distinct(F.concat(F.array("word"), less))).alias("v"), "block", "rest").select("id", F.xxhash64(F.lit("~"), "block", "v", "rest").alias("key"))
    first = odd.select("id", "bare", (~F.col("common") | (F.length("word") == 1)).alias("short"), F.xxhash64(F.lit("^"), "block", F.substring("word", 1, 1), "rest").alias("key"))
    grams = each.where(F.col("bare") | (F.length("word") == 1)).select("id", "block", "bare", "word", F.explode(F.array_distinct(F.flatten(F.transform("others", lambda x: _ngrams(x["word"]))))).alias("gram"))
    grams = grams.select("id", "bare", (F.length("word") == 1).alias("short"), F.xxhash64(F.lit("^"), "block", F.substring("word", 1, 1), F.lit(""), "gram").alias("key"))
    both = first.unionByName(grams)
    return near, both.where("short").select("id", "key"), both.where("bare").select("id", "key")


def candidates(own: DataFrame, cosine: float = 0.4, common: float = 0.0005) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, and the vectors (id, grams array<long>, weights array<float>) of length 1: the forms (id, block, field_name, words) of one block whose cosine can reach `cosine`, and those of common words that differ in one.

    Prefix join: with each vector's grams in one order, rarest first, a pair of that cosine shares a gram of both
    prefixes, a prefix ending where the rest of the vector is shorter than `cosine`.
    """
    marked = cut(_marked(own, common))
    order = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("gram"))
    f = cut(_features(own, marked)).withColumn("rest", F.sum(F.col("w") * F.col("w")).over(order)).withColumn("norm2", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    # past its prefix a vector keeps only its common words: they tell nothing alone, but narrow a gram down
    vectors = f.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), (F.col("w") / F.sqrt("norm2")).cast("float").alias("w")))).alias("v"))  # a name's own grams
    vectors = vectors.select("id", F.transform("v", lambda x: x["g"]).alias("grams"), F.transform("v", lambda x: x["w"]).alias("weights"))
    kept = (F.col("rest") >= cosine * cosine * F.col("norm2")) | F.col("gram").startswith("=") | F.col("bare")
    prefix = f.where(kept).select("id", "block", "field_name", "bare", "single", "gram", "word", (F.col("w") / F.sqrt("norm2")).alias("w"))
    # one shared gram is chance where names are made of few syllables: the join is on two at once, of which one belongs to
    # a rare word, or to another word where a form has common ones only; grams that overlap count as two for artists and
    # single words only, which may have nothing else in common
    own = prefix.groupBy("id", "block", "field_name", "bare", "single").agg(F.array_sort(F.collect_list(F.struct("gram", "word", "w"))).alias("g"))  # a name's own grams
    at = lambda k: F.element_at("g", k)
    word = lambda c: c.startswith("=")
    chained = lambda x, y: (F.substring(x, 2, 3) == F.substring(y, 1, 3)) | (F.substring(y, 2, 3) == F.substring(x, 1, 3))
    rare = lambda x, y: ~(word(x) & word(y)) & ((F.col("field_name") == "tag_artist") | ~chained(x, y))
    useful = lambda x, y: F.when(F.col("single"), True).when(F.col("bare"), x["word"] != y["word"]).otherwise(rare(x["gram"], y["gram"]))
    pair = lambda i, j: F.when(useful(at(i), at(j)), F.struct(F.xxhash64("block", at(i)["gram"], at(j)["gram"]).alias("key"), (at(i)["w"] * at(j)["w"]).alias("w")))
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.size("g") - 1), lambda i: F.filter(F.transform(F.sequence(i + 1, F.size("g")), lambda j: pair(i, j)), lambda e: e.isNotNull())))
    keys = own.where(F.size("g") > 1).select("id", F.explode(two).alias("e")).select("id", "e.key", "e.w")
    lone = own.where(F.size("g") == 1).select("id", F.xxhash64("block", at(1)["gram"]).alias("key"), F.lit(1.0).alias("w"))
    near, short, full = _odd_words(marked)
    keys = keys.unionByName(lone).unionByName(near.withColumn("w", F.lit(1.0)))
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, F.expr("a.key = b.key and a.id < b.id")).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("two"))
    # sums over pairs of shared grams are at most half the square of the cosine; a twelfth of that is asked for, as prefixes and overlaps leave some out
    met = met.where(F.col("two") >= cosine * cosine / 24).select("a", "b")
    a, b = short.alias("a"), full.alias("b")
    return met.unionByName(a.join(b, F.expr("a.key = b.key and a.id != b.id")).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))).distinct(), vectors


def dot(x: dict[int, float], y: dict[int, float]) -> float:
    if len(x) > len(y):
        x, y = y, x
    return sum(w * y[g] for g, w in x.items() if g in y)


def average_linkage(vectors: dict[int, dict[int, float]], edges: dict[tuple, tuple[float, float]], least: float) -> dict:
    """A cluster (its first id) for each id of `vectors` (of length 1): the two clusters of greatest average score join while that is `least` or more.

    edges: (a, b) -> (score, cosine) of the pairs that were compared. The average runs over all pairs of members; a pair that
    was not compared counts with its cosine, so two clusters' sums of vectors and of score less cosine are all it takes.
    """
    members = {i: [i] for i in vectors}
    sums = {i: dict(v) for i, v in vectors.items()}
    more: dict[int, dict[int, float]] = {i: {} for i in vectors}
    for (a, b), (s, c) in edges.items():
        more[a][b] = more[b][a] = s - c
    average = lambda a, b: (dot(sums[a], sums[b]) + more[a][b]) / (len(members[a]) * len(members[b]))
    now = {(a, b): s for (a, b), (s, _) in edges.items()}
    heap = [(-s, a, b) for (a, b), s in now.items() if s >= least]
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if a not in members or b not in members or now.get((a, b)) != -s:
            continue
        members[a] += members.pop(b)
        for g, w in sums.pop(b).items():
            sums[a][g] = sums[a].get(g, 0.0) + w
        for c, v in more.pop(b).items():
            more[c].pop(b)
            if c != a:
                more[a][c] = more[c][a] = more[a].get(c, 0.0) + v
        for c in more[a]:
            pair = (min(a, c), max(a, c))
            now[pair] = average(a, c)
            if now[pair] >= least:
                heapq.heappush(heap, (-now[pair], *pair))
    return {i: c for c, m in members.items() for i in m}


def entities(files: DataFrame, cosine: float = 0.4, least: float = 0.3, best: int = 32, ratio: int = 20) -> DataFrame:
    """(field_name, name, entity long): every distinct string of the fields with the entity it names; forms of no variant are their own entity.

    Numbers (parts, volumes) must be equal. Null strings, strings without letters and placeholders for artists name
    none. Pairs need a cosine of `cosine`, or words that agree; of these links each form keeps its `best` ones (either side
    is enough), while contradictions all count, and so do in the average the pairs left out. The number of spellings of one
    entity is what one task holds; the number of strings of one spelling isn't.
    """
    strings = files.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("name")) for f in FIELDS])).alias("x")).select("x.*").where("name is not null").distinct()
    named = put_right(cut(forms(strings)), ratio)
    named = cut(named.withColumn("id", F.xxhash64("field_name", "form", "numbers")).withColumn("block", F.xxhash64("field_name", "numbers")))
    own = named.groupBy("id").agg(F.first("block").alias("block"), F.first("field_name").alias("field_name"), F.min("words").alias("words"))

    def nicked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(words=[" ".join(NICKNAMES.get(w, w) for w in s.split(" ")) for s in batch["words"]])

    pairs, vectors = candidates(cut(own.mapInPandas(nicked, own.schema)), cosine)
    vectors = cut(vectors)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rule = np.array([same_name(tuple(x.split(" ")), tuple(y.split(" "))) for x, y in zip(batch["x"], batch["y"], strict=True)], float)
            c = np.array([_cosine(*v) for v in zip(batch["g"], batch["w"], batch["h"], batch["u"], strict=True)], float)
            # words that agree raise the cosine, words that exclude each other forbid the pair; where words can't tell, a high cosine does
            s = np.where(rule < 0, -1.0, np.where(rule > 0, np.maximum(rule, c), np.where(c >= SURE, c, 0.0)))
            yield batch.assign(s=s, c=c)[["a", "b", "s", "c"]][(s != 0) & ((c >= cosine) | (s > 0))]

    side = own.join(vectors, "id")
    left = side.select(F.col("id").alias("a"), F.col("words").alias("x"), F.col("grams").alias("g"), F.col("weights").alias("w"))
    right = side.select(F.col("id").alias("b"), F.col("words").alias("y"), F.col("grams").alias("h"), F.col("weights").alias("u"))
    scored = cut(pairs.join(left, "a").join(right, "b").mapInPandas(compare, "a long, b long, s double, c double"))
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("s"), F.desc("c"), "a", "b"))
    links = scored.where("s > 0").withColumn("ra", rank("a")).withColumn("rb", rank("b")).where((F.col("ra") <= best) | (F.col("rb") <= best)).select("a", "b", "s", "c")
    links = cut(links.unionByName(scored.where("s < 0")))
    roots = cut(components_of_ids(links.where("s > 0").select("a", "b")))
    linked = links.join(roots.select(F.col("v").alias("a"), "root"), "a").join(roots.select(F.col("v").alias("b"), F.col("root").alias("other")), "b").where("root = other")
    buckets = max(64, links.count() // 4000)  # follows the data: a task takes a few thousand links, or one entity's
    bucket = F.pmod(F.xxhash64("root"), F.lit(buckets))
    own_vectors = roots.select(F.col("v").alias("id"), F.col("root").alias("top")).join(vectors, "id")
    own_vectors = own_vectors.select(F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("part"), "top", "id", "grams", "weights")

    def cluster(edges: pd.DataFrame, vecs: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_root = dict(list(edges.groupby("root", sort=False)))
        for root, g in vecs.groupby("top", sort=False):
            own = {i: dict(zip(x.tolist(), w.tolist(), strict=True)) for i, x, w in zip(g["id"].tolist(), g["grams"], g["weights"], strict=True)}
            e = by_root[root]
            links = {(min(a, b), max(a, b)): (s, c) for a, b, s, c in zip(e["a"].tolist(), e["b"].tolist(), e["s"].tolist(), e["c"].tolist(), strict=True)}
            out += average_linkage(own, links, least).items()
        return pd.DataFrame(out, columns=["id", "entity"]).astype("int64")

    grouped = linked.withColumn("bucket", bucket).select("bucket", "root", "a", "b", "s", "c").groupBy("bucket").cogroup(own_vectors.groupBy("part")).applyInPandas(cluster, "id long, entity long")
    return named.join(grouped, "id", "left").select("field_name", "name", F.coalesce("entity", "id").alias("entity"))


#: Cosine from which a pair counts although its words can't tell.
SURE = 0.8


def _cosine(g: np.ndarray, w: np.ndarray, h: np.ndarray, u: np.ndarray) -> float:
    """Of two vectors given as ascending grams and their weights."""
    at = np.searchsorted(h, g)
    ok = at < len(h)
    ok[ok] = h[at[ok]] == g[ok]
    return float((w[ok] * u[at[ok]]).sum())


def found_pairs(files: DataFrame, **options) -> DataFrame:
    """(field_name, name_a, name_b), name_a < name_b: the different strings of one field that name the same entity."""
    e = cut(entities(files, **options))
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.expr("a.field_name = b.field_name and a.entity = b.entity and a.name < b.name")).select("a.field_name", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
