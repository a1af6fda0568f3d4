"""Per-document text quality statistics, and the kind of a document that is not natural prose.

A text is cut into blocks of adjacent lines of one layout. Tables show in delimiters at the same place of every line
(vertical alignment); lists in lines of one shape (marker, key) or laid out as entries: not filled like wrapped text, while
indents (periodicity) or line lengths (autocorrelation) come again in a period. Word, symbol and punctuation ratios then tell
prose from junk. A document is of the kind that holds most of its characters.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Frequent words of English, German, French and Spanish.
COMMON = frozenset(
    """the of and to in a is that for it was on with as be at by this are from or an not but have has had they you we she he
    his her its their my your our which what who when where if so no all can will would there then than one only
    before after until without because every about into over under up out off more some any how do been were said
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr wenn wir ich
    le la les de des du et un une en que qui dans pour pas sur au aux est par plus ne se ce il elle nous vous sont avec ont
    son sa ses mais ou où cette ces leur après sans si tout on y
    el los las del y que por con para una su al lo como más pero sus está este esta sin sobre entre muy desde
    también ya o fue era se en es un""".split()
)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_END = re.compile(r"[.!?…:;][\"'”»)\]*_]*\s*$")
_STOP = re.compile(r"[.!?…][\"'”»)\]*_]*(?:\s|$)")
_MARKER = re.compile(r"^\s*(?:[-*•·–‣◦▪+>]|\(?\d{1,4}[.)\]:]|\(?[a-zA-Z][.)]|\[[ xX✓]?\]|[☐☑✓✗])\s+")
_KEY = re.compile(r"^\s*[^\W\d_][\w .'’/-]{0,32}\s*(?:[:=]|->|=>|→|\.{3,})\s*\S")
_PATH = re.compile(r"(?:[A-Za-z]:\\|~?/|\./)?(?:[\w .()&'-]+[\\/])*[\w .()&'-]+\.[A-Za-z0-9]{2,4}")
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_ROW = re.compile(r"<tr\b", re.I)
_ITEM = re.compile(r"<li\b", re.I)
_RULE = re.compile(r"^[\s|+:=_-]+$")
_HASHLIKE = re.compile(r"^[A-Za-z0-9+/=_-]{20,}$")
_VOWELLESS = re.compile(r"\b[^\W\d_aeiouyAEIOUYÀ-ÿŒœ]{3,}\b")
_PLAIN = re.compile(r"[\t|{<]| {3,}|^\s*(?:[-*•+>]|\d+[.)]|\[)\s", re.M)
_DELIMITERS = "\t|;,"
#: Autocorrelation from which indents and line lengths count as coming again.
PERIODIC, ECHOING = 0.5, 0.6


def autocorrelation(x: np.ndarray, lag: int = 1) -> float:
    """Of a series with itself `lag` places on, in -1..1; 1.0 for a constant series, 0.0 for one too short."""
    if len(x) <= lag + 1:
        return 0.0
    d = x - x.mean()
    total = float((d * d).sum())
    return 1.0 if total == 0 else float((d[lag:] * d[:-lag]).sum() / total)


def alignment(lines: list[str]) -> float:
    """Share of lines with the same number (two columns or more) of the delimiter that fits best: tab, bar, semicolon, comma, or columns of blanks that start at the same places."""
    n, best = len(lines), 0.0
    if n < 2:
        return 0.0
    for d in _DELIMITERS:
        counts = Counter(s.count(d) for s in lines)
        for k, c in counts.most_common(2):
            if k and (d != "," or k > 1 or all(len(s) < 60 for s in lines)):
                cells = [p for s in lines if s.count(d) == k for p in s.split(d)]
                if d == "," and (np.mean([len(p) for p in cells]) > 14 or sum(p.startswith(" ") for p in cells) > 0.3 * len(cells)):
                    continue  # commas of sentences and enumerations
                best = max(best, c / n)
    starts = Counter()
    for s in lines:
        starts.update({m.end() for m in re.finditer(r"(?:^|\S) {2,}(?=\S)", s)})
    if starts:
        wide = [p for p, c in starts.items() if c >= 0.5 * n]
        if wide:
            rows = sum(any(len(s) > p and s[p - 1 : p] == " " for p in wide) for s in lines)
            best = max(best, rows / n)
    return best


def periodicity(lines: list[str]) -> float:
    """How regular the indentation is: the best autocorrelation of the lines' indents at a lag of 1 to 4."""
    x = np.array([len(s) - len(s.lstrip()) for s in lines], float)
    return max((autocorrelation(x, k) for k in range(1, 5)), default=0.0) if x.any() else 0.0


def echo(lines: list[str]) -> float:
    """How regularly line lengths come again: their best autocorrelation at a lag of 1 to 6; 0.0 where all are equal, as nothing can be told then."""
    x = np.array([len(s) for s in lines], float)
    return max((autocorrelation(x, k) for k in range(1, 7) if len(x) > 2 * k), default=0.0) if len(x) and np.ptp(x) else 0.0


def fullness(lines: list[str]) -> float:
    """Share of lines that the next line's first word would have made longer than the longest: near 1 in wrapped text, low in entries of their own."""
    if len(lines) < 2:
        return 1.0
    width = max(map(len, lines))
    return sum(len(a) + 1 + len(b.split(maxsplit=1)[0]) > width for a, b in zip(lines, lines[1:], strict=False)) / (len(lines) - 1)


def entries_layout(lines: list[str]) -> bool:
    """Whether short lines (shown ones) are laid out as entries: not filled like wrapped text nor ended like sentences, while indents or line lengths come again in a period, or no sentence ends at all."""
    n = len(lines)
    if n < 6 or sum(map(len, lines)) > 60 * n:
        return False
    if fullness(lines) >= 0.5 or sum(bool(_END.search(s)) for s in lines) >= 0.4 * n:
        return False
    return periodicity(lines) >= PERIODIC or echo(lines) >= ECHOING or sum(map(len, lines)) < 45 * n and len(_STOP.findall("\n".join(lines))) < 0.2 * n


def statistics(text: str) -> dict[str, float]:
    """The ratios of one text; all are 0 where there is nothing to count."""
    words = _TOKEN.findall(text)
    lines = [s for s in text.splitlines() if s.strip()]
    solid = sum(not c.isspace() for c in text) or 1
    alpha = [w for w in words if not w[0].isdigit()]
    lengths = np.array([len(s) for s in lines], float)
    return {
        "words": len(words),
        "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "symbol_ratio": sum(not (c.isalnum() or c.isspace()) for c in text) / solid,
        "digit_ratio": sum(c.isdigit() for c in text) / solid,
        "ended_lines": sum(bool(_END.search(s)) for s in lines) / len(lines) if lines else 0.0,
        "common_words": sum(w.lower() in COMMON for w in alpha) / len(alpha) if alpha else 0.0,
        "line_autocorrelation": autocorrelation(lengths),
        "alignment": alignment(lines),
        "periodicity": periodicity(lines),
    }


def _readable(text: str) -> bool:
    """Whether most of it is made of words that could be a language's: letters, vowels, ordinary lengths, no digits or signs inside."""
    chunks = text.split()
    if not chunks or len(_VOWELLESS.findall(text)) > 0.3 * len(chunks):
        return False
    good = total = 0
    for c in chunks:
        core = c.strip(".,;:!?\"'“”„«»()[]{}*_~`<>…–—-¿¡|#")
        total += len(c)
        if not core:
            continue
        if core.isalpha() or all(p.isalpha() for p in re.split(r"['’‘./&@-]", core) if p):
            if len(core) <= 24 and (core.islower() or core.isupper() or core[0].isupper() or any(x in core for x in "'’-./&@")) and sum(ord(x) > 0x24F for x in core) == 0 or ord(core[0]) > 0x2FF:
                good += len(c)
        elif re.fullmatch(r"[\d.,:/%×x€$£°+-]+(?:st|nd|rd|th|er|e|º|ª|h|s|ms|km|mm|cm|kb|mb|gb|p|k|dpi|fps)?", core, re.I):
            good += len(c)
    return good >= 0.7 * total


def _repeats(text: str) -> bool:
    """Whether it is filler: the same words or lines over and over."""
    squeezed = len(zlib.compress(text.encode("utf-8", "replace"), 6)) / len(text.encode("utf-8", "replace"))
    words = text.lower().split()
    if len(words) >= 20:
        sentences = [s.strip() for s in re.split(r"[.!?\n]+", text.lower()) if s.strip()]
        same = Counter(sentences).most_common(1)[0][1] / len(sentences)
        if len(sentences) >= 4 and same >= 0.5 or len(set(zip(words, words[1:], words[2:], strict=False))) < 0.25 * (len(words) - 2):
            return True
    return squeezed < 0.1


def _prose_like(text: str) -> bool:
    """Whether running text: sentences, or enough function words between the others."""
    words = [w.lower() for w in _TOKEN.findall(text) if not w[0].isdigit()]
    if not words:
        return False
    common = sum(w in COMMON for w in words) / len(words)
    return len(words) >= 4 and common >= 0.2 or len(words) >= 8 and common >= 0.12 and bool(_STOP.search(text))


def _one_line(s: str) -> str:
    """The kind of a single line on its own."""
    t = s.strip()
    if _RULE.match(t):
        return "rule"
    if not _readable(t):
        return "odd"
    return "prose" if _prose_like(t) else "short"


def _records(t: str) -> bool:
    """Whether the block is machine records in one line a record: JSON objects or key=value with the same keys."""
    lines = [s.strip() for s in t.splitlines() if s.strip()]
    keys = [tuple(re.findall(r"[\"']?([A-Za-z_][\w ]*)[\"']?\s*[:=]", s)) for s in lines]
    return len(lines) >= 3 and Counter(keys).most_common(1)[0][1] >= 0.7 * len(lines) and len(Counter(keys).most_common(1)[0][0]) >= 2


def _plainly_prose(text: str) -> bool:
    """The quick answer for most prose: function words are as frequent as only prose has them, in varied sentences without any mark of tables, lists or markup."""
    if _PLAIN.search(text):
        return False
    words = text.lower().split()
    if len(words) < 12 or sum(w in COMMON for w in words) < 0.3 * len(words):
        return False
    return len(set(words)) >= 0.3 * len(words) and len(set(zip(words, words[1:], words[2:], strict=False))) >= 0.6 * (len(words) - 2)


def block_kind(lines: list[str]) -> str:
    """prose, list, table or junk: the kind of a block of lines."""
    t = "\n".join(lines)
    shown = [s for s in lines if s.strip()]
    entries = entries_layout(shown)
    if not shown or not entries and _plainly_prose(t):
        return "prose"
    tags = _TAG.findall(t)
    if tags and sum(map(len, tags)) > 0.3 * len(t):
        inner = html.unescape(_TAG.sub(" ", t))
        if len(_ROW.findall(t)) >= 2:
            return "table"
        if len(_ITEM.findall(t)) >= 2:
            return "list"
        return block_kind(re.sub(r"[ \t]+", " ", inner).split("\n")) if len(inner.split()) >= 5 else "junk"
    n, total = len(shown), sum(map(len, shown))
    marked = sum(bool(_MARKER.match(s)) for s in shown)
    prose = _prose_like(t)
    aligned = alignment(shown) if n >= 2 else 0.0
    if aligned >= 0.7 and (not prose or aligned >= 0.9 and n >= 3 or "\t" in t or "|" in t):
        return "table"
    if t.lstrip()[:1] in "{[" and t.count('"') >= 4 and not prose:
        return "table" if _records(t) else "junk"
    if n >= 3 and not prose and _records(t):
        return "table"
    hashlike = [s for s in shown if _HASHLIKE.match(s.strip()) and not _PATH.fullmatch(s.strip())]
    if sum(map(len, hashlike)) > 0.5 * total:
        return "junk"
    paths = sum(bool(_PATH.fullmatch(_MARKER.sub("", s).strip())) for s in shown)
    if paths >= 0.6 * n and (n >= 2 or marked):
        return "list"
    keyed = sum(len(s) < 90 and bool(_KEY.match(s)) for s in shown)
    if not prose and n >= 2 and (marked >= 0.8 * n or keyed >= 0.8 * n or entries) and _readable(t):
        return "list"
    solid = len(t) - sum(map(str.isspace, t))
    letters = sum(map(str.isalpha, t)) / solid
    if letters < 0.3 and sum(map(str.isdigit, t)) < 0.3 * solid and not _TOKEN.search(t) or _repeats(t):
        return "junk"
    kinds = Counter()
    for s in shown:
        kinds[_one_line(_MARKER.sub("", s))] += len(s)
    flowing = prose and kinds["odd"] < 0.5 * total
    short = (marked >= 0.7 * n or entries) and n >= 3 and total / n < 45
    if flowing and not short and kinds["prose"] + (kinds["short"] if kinds["prose"] > kinds["short"] else 0) > 0.5 * total:
        return "prose"
    if n >= 2 and (marked >= 0.6 * n or keyed >= 0.6 * n or entries and short and kinds["odd"] < 0.5 * total):
        return "list"
    if flowing:
        return "prose"
    if kinds["odd"] > 0.5 * total and not paths:
        return "junk"
    words, commas = _TOKEN.findall(t), t.count(",") + t.count(";")
    if n <= 3 and commas >= 3 and len(words) / (commas + 1) <= 4.5:
        return "list"
    if n >= 3 and len(words) <= 7 * n:
        return "list"
    if marked or keyed or paths:
        return "list"
    return "prose" if _readable(t) else "junk"


def blocks(text: str) -> list[list[str]]:
    """The text's lines in blocks: cut at blank lines and where the shape of the lines changes for good."""
    out: list[list[str]] = []
    last = None
    for s in text.splitlines():
        if not s.strip():
            last = None
            continue
        if _MARKER.match(s):
            shape = "m"
        elif "\t" in s.strip() or s.count("|") >= 2 or s.count(";") >= 2 and '"' in s or re.search(r"\S {3,}\S", s):
            shape = "t"
        elif _KEY.match(s) and len(s) < 50 and not _END.search(s):
            shape = "k"
        elif _PATH.fullmatch(s.strip()):
            shape = "p"
        else:
            shape = "x"
        if shape != last:
            out.append([])
        out[-1].append(s)
        last = shape
    return out


def kind_of(text: str) -> str:
    """prose, list, table or junk, by most characters; blank texts are prose."""
    if not entries_layout([s for s in text.splitlines() if s.strip()]) and _plainly_prose(text):
        return "prose"
    whole = Counter()
    parts = blocks(text)
    runs: list[list[str]] = []
    for b in parts:  # single short lines in a row (blank lines between the entries) are judged together
        if runs and len(b) == 1 and len(runs[-1][-1]) < 60 and len(b[0]) < 60 and not _prose_like(b[0]) and not _prose_like(runs[-1][-1]) and bool(_MARKER.match(b[0])) == bool(_MARKER.match(runs[-1][-1])):
            runs[-1] = [*runs[-1], *b]
        else:
            runs.append(list(b))
    for b in runs:
        whole[block_kind(b)] += sum(len(s.strip()) for s in b)
    total = sum(whole.values())
    if not total:
        return "prose"
    if _repeats(text) and whole["prose"] >= 0.5 * total:
        return "junk"
    if whole["prose"] * 2 >= total:
        return "prose"
    return max(("list", "table", "junk"), key=lambda k: whole[k])


STATISTICS = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "line_autocorrelation", "alignment", "periodicity")


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, the STATISTICS, kind) for each row of `documents` (doc_id, text), over whole texts.

    kind is prose, list, table or junk; null for null and blank texts, whose numbers are 0. Rows are kept as they come;
    other columns are ignored.
    """
    schema = "doc_id long, " + ", ".join(f"{c} {'long' if c == 'words' else 'double'}" for c in STATISTICS) + ", kind string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = statistics(text or "")
                rows.append((d, *(s[c] for c in STATISTICS), kind_of(text) if text and text.strip() else None))
            yield pd.DataFrame(rows, columns=["doc_id", *STATISTICS, "kind"]).astype({"words": "int64"})

    return documents.select("doc_id", "text").mapInPandas(run, schema)


def unnatural(documents: DataFrame) -> DataFrame:
    """(doc_id, kind): the documents most of whose characters are not natural prose. A doc_id of several rows may have several kinds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [kind_of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "kind": kinds})[[k != "prose" for k in kinds]]

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, kind string").distinct()
