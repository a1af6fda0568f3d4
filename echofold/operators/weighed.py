"""Pairs of a bucket whose contents both are known: contents are compared in blocks, what the other aspects can add at most decides which pairs are looked at one by one, and those are valued here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from echofold.functions import alike

#: Rows of the left side, and of the right, compared at once: few enough to stay in a core's cache.
TILE, WIDTH = 256, 256
#: Metres of a degree of latitude, on the sphere of comparators.metres.
RADIUS = 6_371_000.0
DEGREE = RADIUS * np.pi / 180
TAGS = {"tag_title": 0.45, "tag_artist": 0.35, "tag_album": 0.20}
EXIF = {"exif_datetime": 0.35, "exif_camera": 0.20, "exif_lens": 0.10, "exif_gps": 0.25, "exif_size": 0.10}
#: Aspects that `within_reach` values as comparators do.
VALUED = ("filename", "duration", "resolution", "file_size", "exif", "tags")
NUMBERS = "duration pixels file_size exif_datetime exif_gps_lat exif_gps_lon".split()
SEEN = "path name words plain id digits text runs duration pixels file_size exif_datetime exif_camera exif_lens exif_gps_lat exif_gps_lon exif_size tag_title tag_artist tag_album measured".split()
OUT = "path_a string, path_b string, value double, identical boolean, " + ", ".join(f"raw_{k} double" for k in VALUED)


def _signs(x: np.ndarray) -> np.ndarray:
    """The bits of each row of integers as -1.0 and 1.0."""
    out = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1).astype(np.float32)
    out *= 2
    out -= 1
    return out


class Hashes:
    """fingerprints.rotated_similarity (for single hashes hash_similarity too) of two sides whose rows come by length."""

    def __init__(self, a: pd.Series, b: pd.Series):
        self.sides = []
        for side in (a, b):
            n = np.array([len(x) // 4 for x in side])
            rows = np.concatenate([np.asarray(x, np.int64)[: len(x) // 4 * 4].reshape(-1, 4) for x in side])
            at = np.cumsum(n) - n
            # the k-th hash of each row that has one: those are the last rows, as they come by length
            first = [int(np.searchsorted(n, k, "right")) for k in range(n.max())]
            self.sides.append([(lo, _signs(rows[at[lo:] + k])) for k, lo in enumerate(first)])

    def similarity(self, rows: slice, lo: int) -> np.ndarray:
        x, y = self.sides
        own, other = x[0][1][rows], y[0][1][lo:]
        out = own @ other.T
        for start, h in y[1:]:
            at = max(start, lo)
            part = out[:, at - lo :]
            np.maximum(part, own @ h[at - start :].T, out=part)
        for start, h in x[1:]:
            at = max(start, rows.start)
            if at < rows.stop:
                part = out[at - rows.start :]
                np.maximum(part, h[at - start : rows.stop - start] @ other.T, out=part)
        out += 256
        out /= 512
        return out


class Prints:
    """fingerprints.audio_similarity of two sides whose rows come by length."""

    def __init__(self, a: pd.Series, b: pd.Series):
        self.sides = []
        for side in (a, b):
            n = np.array([len(x) for x in side])
            x = np.zeros((len(n), max(1, n.max(initial=0))), np.uint32)
            for k, v in enumerate(side):
                x[k, : len(v)] = np.asarray(v, np.int64).astype(np.uint32)
            x = _signs(x)
            for k, m in enumerate(n):
                x[k, m * 32 :] = 0  # adds nothing, wherever it comes to lie
            self.sides.append((x, n))

    def similarity(self, rows: slice, lo: int) -> np.ndarray:
        (x, n), (y, m) = self.sides
        y, m = y[lo:], m[lo:]
        own, n = x[rows], n[rows]
        out = np.full((len(n), len(m)), -np.inf, np.float32)
        each = [(int(la), int(np.searchsorted(n, la)), int(np.searchsorted(n, la, "right"))) for la in np.unique(n)]
        least, most = each[0][0], each[-1][0]
        # one product for all rows, of which each takes what it fits: what is behind an end is 0
        for o in range(int(m[-1]) - least + 1):  # within those that are longer by o at least
            first = int(np.searchsorted(m, least + o))
            wide = min(most * 32, y.shape[1] - o * 32)
            s = own[:, :wide] @ y[first:, o * 32 : o * 32 + wide].T
            for la, p, q in each:
                at = int(np.searchsorted(m, la + o))
                part = out[p:q, at:]
                np.maximum(part, s[p:q, at - first :], out=part)
        for o in range(most - int(m[0]) + 1):  # those that are shorter by o at least, within it
            last = int(np.searchsorted(m, most - o, "right"))
            wide = int(m[last - 1]) * 32
            s = own[:, o * 32 : o * 32 + wide] @ y[:last, :wide].T
            for la, p, q in each:
                at = int(np.searchsorted(m, la - o, "right"))
                part = out[p:q, :at]
                np.maximum(part, s[p:q, :at], out=part)
        bits = np.minimum(n[:, None], m[None, :]) * 32.0
        return 1 - (bits - out) / 2 / bits


class _Letters:
    """Ratios of two lists of strings, and bounds of them from above; what is null has none (0)."""

    def __init__(self, a: pd.Series, b: pd.Series):
        self.known = [s.notna().to_numpy() for s in (a, b)]
        self.bags = alike.Bags(*[["" if x is None or x != x else x for x in s] for s in (a, b)])
        self.lengths = [n.astype(np.float32) for n in self.bags.lengths]
        self.blank = [known & (n == 0) for known, n in zip(self.known, self.lengths, strict=True)]
        self.wide = [n > alike.WIDE for n in self.lengths]

    def bound(self, rows: slice, cols: slice) -> np.ndarray:
        la, lb = self.lengths[0][rows, None], self.lengths[1][None, cols]
        common = self.bags.common(rows, cols)
        wide = self.wide[0][rows], self.wide[1][cols]
        if wide[0].any() or wide[1].any():
            common = np.where(wide[0][:, None] | wide[1][None, :], np.minimum(la, lb), common)
        n = la + lb
        common *= 2
        common /= np.maximum(n, 1, out=n)
        blank = self.blank[0][rows], self.blank[1][cols]
        if blank[0].any() and blank[1].any():
            common[np.ix_(blank[0], blank[1])] = 1
        return common


def _share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As comparators have it; nan where either is unknown."""
    return np.where(np.isnan(x) | np.isnan(y), np.nan, np.where((x == 0) | (y == 0), 0.0, np.minimum(x, y) / np.maximum(x, y)))


def _linear(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x - y) / most)


def _weighted(parts: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """comparators.weighted of what isn't nan."""
    up = down = 0.0
    for w, c in parts:
        known = ~np.isnan(c)
        up, down = up + np.where(known, c * w, 0.0), down + np.where(known, w, 0.0)
    return np.where(down > 0, up / np.where(down > 0, down, 1.0), np.nan)


def _equal(codes: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x, y = codes[0][i], codes[1][j]
    return np.where((x >= 0) & (y >= 0), (x == y).astype(float), np.nan)


class _Sides:
    """Two sides of a block and all that is made of them once."""

    def __init__(self, a: pd.DataFrame, b: pd.DataFrame, weights: dict[str, float], read_alike: float):
        self.weights, self.read_alike = weights, read_alike
        self.numbers = {c: [x[c].to_numpy(np.float64, na_value=np.nan) for x in (a, b)] for c in NUMBERS}
        self.codes = {c: alike._joint(a[c], b[c]) for c in ("name", "digits", "text", "runs", "exif_camera", "exif_lens", "exif_size")}
        self.words, self.tags = _Letters(a["words"], b["words"]), {c: _Letters(a[c], b[c]) for c in TAGS} if "tags" in weights else {}
        texts = [["" if x is None or x != x else x for x in s["name"]] for s in (a, b)]
        self.plain = [[frozenset(x) if x is not None else frozenset() for x in s["plain"]] for s in (a, b)]
        self.split = [[frozenset(t.split(" ")) for t in side] for side in texts]
        (xa, self.na, yb), (xb, self.nb, ya) = alike._own_words(texts[0], texts[1]), alike._own_words(texts[1], texts[0])
        self.slots = xa, xb, ya, yb
        self.id = [s["id"].to_numpy(bool) for s in (a, b)]
        self.blank = [np.array([t == "" for t in side]) for side in texts]
        self.told = [(s["text"].notna() & (s["text"] != "")).to_numpy() for s in (a, b)]
        # what of exif is known on either side, and what the parts come to; the same for tags
        gps = [self.numbers["exif_gps_lat"][s] + self.numbers["exif_gps_lon"][s] for s in (0, 1)]
        known = lambda s: [~np.isnan(self.numbers["exif_datetime"][s]), self.codes["exif_camera"][s] >= 0, self.codes["exif_lens"][s] >= 0, ~np.isnan(gps[s]), self.codes["exif_size"][s] >= 0]
        bits = lambda parts: sum((p.astype(np.uint16) << k for k, p in enumerate(parts)), np.zeros(1, np.uint16))
        self.exif_known = [bits(known(s)) for s in (0, 1)]
        self.tags_known = [bits([t.known[s] for t in self.tags.values()]) for s in (0, 1)]
        part = np.array(list(EXIF.values()))
        of = (np.arange(32)[:, None] >> np.arange(5) & 1) @ part
        self.exif_table = np.where(of[:, None] > 0, np.minimum(1, of[None, :] / np.maximum(of[:, None], 1e-9)), 0).astype(np.float32).ravel()
        down = (np.arange(8)[:, None] >> np.arange(3) & 1) @ np.array(list(TAGS.values()))
        self.tags_table = np.where(down > 0, 1 / np.maximum(down, 1e-9), 0).astype(np.float32)
        self.small = {c: [x.astype(np.float32) for x in self.numbers[c]] for c in ("pixels", "file_size")}

    def most(self, aspect: str, rows: slice, cols: slice) -> np.ndarray | float:
        """What an aspect is at most."""
        pair = lambda x: (x[0][rows, None], x[1][None, cols])
        if aspect == "filename":
            out = self.words.bound(rows, cols)
            xa, xb, ya, yb = self.slots
            bare = xa[rows] @ yb[cols].T >= self.na[rows, None]
            bare |= ya[rows] @ xb[cols].T >= self.nb[None, cols]
            bare |= out >= self.read_alike - 1e-3
            out *= bare
            return out
        if aspect == "duration":
            out = np.subtract(*pair(self.numbers["duration"])).astype(np.float32)
            np.abs(out, out=out)
            out *= -0.2
            out += 1
            return np.fmax(out, 0, out=out)  # 0 where unknown
        if aspect in ("resolution", "file_size"):
            x, y = pair(self.small["pixels" if aspect == "resolution" else aspect])
            out = np.minimum(x, y)
            out /= np.maximum(x, y)
            return np.fmax(out, 0, out=out)
        if aspect == "exif":
            known = self.exif_known[0][rows, None] & self.exif_known[1][None, cols]
            near = np.zeros(known.shape, np.uint16)
            for k, (c, most) in enumerate({"exif_datetime": 3600.0, "exif_camera": 0, "exif_lens": 0, "exif_gps_lat": 1001.0 / DEGREE, "exif_size": 0}.items()):
                ok = np.abs(np.subtract(*pair(self.numbers[c]))) < most if most else np.equal(*pair(self.codes[c]))
                near |= ok.astype(np.uint16) << np.uint16(k)
            near &= known
            known <<= 5
            known |= near
            return self.exif_table[known]
        if aspect == "tags":
            out = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
            for c, w in TAGS.items():
                part = self.tags[c].bound(rows, cols)
                part *= np.float32(w)
                out += part
            out *= self.tags_table[np.bitwise_and(*pair(self.tags_known))]
            return np.minimum(out, 1, out=out)
        return 1.0

    def value(self, aspect: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """An aspect of pairs, as comparators have it; nan where it is unknown."""
        pair = lambda c: (self.numbers[c][0][i], self.numbers[c][1][j])
        if aspect == "filename":
            same = lambda c: self.codes[c][0][i] == self.codes[c][1][j]
            known = self.words.known[0][i] & self.words.known[1][j]
            out = self.words.bags.ratios(i, j)
            excluded = self.blank[0][i] | self.blank[1][j] | (self.id[0][i] & self.id[1][j] & ~same("digits")) | (self.told[0][i] & self.told[1][j] & same("text") & ~same("runs"))
            for k in np.flatnonzero(known & ~excluded & (out < self.read_alike)).tolist():
                p, q = i[k], j[k]
                excluded[k] = not (self.plain[0][p] <= self.split[1][q] or self.plain[1][q] <= self.split[0][p])
            return np.where(known, np.where(excluded, 0.0, out), np.nan)
        if aspect == "duration":
            return _linear(*pair("duration"), 5.0)
        if aspect in ("resolution", "file_size"):
            return _share(*pair("pixels" if aspect == "resolution" else aspect))
        if aspect == "exif":
            (p, q), (s, t) = (map(np.radians, pair(f"exif_gps_{c}")) for c in ("lat", "lon"))
            h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((t - s) / 2) ** 2
            near = np.maximum(0.0, 1 - 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0))) / 1000.0)
            codes = {c: _equal(self.codes[c], i, j) for c in ("exif_camera", "exif_lens", "exif_size")}
            return _weighted([(EXIF[c], v) for c, v in {"exif_datetime": _linear(*pair("exif_datetime"), 3600.0), "exif_camera": codes["exif_camera"], "exif_lens": codes["exif_lens"], "exif_gps": near, "exif_size": codes["exif_size"]}.items()])
        parts = []
        for c, w in TAGS.items():
            known = np.flatnonzero(self.tags[c].known[0][i] & self.tags[c].known[1][j])
            part = np.full(len(i), np.nan)
            part[known] = self.tags[c].bags.ratios(i[known], j[known])
            parts.append((w, part))
        return _weighted(parts)


def within_reach(a: pd.DataFrame, b: pd.DataFrame, same: bool, weights: dict[str, float], threshold: float, aspect: str, read_alike: float) -> Iterator[pd.DataFrame]:
    """Of the pairs of rows (SEEN) those that reach `threshold`, and those of equal name and size: OUT. `aspect`: content or audio, which `measured` holds.

    Where weights name what isn't in VALUED, all pairs come that can reach it, and that aspect has no value.
    """
    a, b = (x.iloc[np.argsort(x["measured"].str.len().to_numpy(), kind="stable")].reset_index(drop=True) for x in (a, b))  # contents are taken by length
    measure = (Hashes if aspect == "content" else Prints)(a["measured"], b["measured"])
    sides = _Sides(a, b, weights, read_alike)
    name, size = sides.codes["name"], sides.numbers["file_size"]
    paths = a["path"].to_numpy(), b["path"].to_numpy()
    others = [k for k in weights if k != aspect]
    open_weight = sum(weights[k] for k in others if k not in VALUED)

    def valued(i: np.ndarray, j: np.ndarray, v: np.ndarray, most: np.ndarray) -> pd.DataFrame:
        raw = {}
        # what tells most for its price comes first; pairs that fall short of the threshold are dropped on the way
        for k in [k for k in VALUED if k in others and k not in ("filename", "tags")] + [k for k in ("tags", "filename") if k in others]:
            if k == "filename":  # most pairs have names that can add nothing
                some = np.flatnonzero(most[k] > 0)
                raw[k] = np.where(sides.words.known[0][i] & sides.words.known[1][j], 0.0, np.nan)
                raw[k][some] = sides.value(k, i[some], j[some])
            else:
                raw[k] = sides.value(k, i, j)
            known = sum((np.nan_to_num(x) * weights[c] for c, x in raw.items()), v * weights[aspect] + open_weight)
            rest = [most[c] for c in others if c in VALUED and c not in raw]
            equal = (name[0][i] == name[1][j]) & (name[0][i] >= 0) & (size[0][i] == size[1][j])
            ok = equal | (sum(rest, known) >= threshold - (0.01 if rest else 1e-6))
            ok = np.flatnonzero(ok)
            i, j, v, raw, most = i[ok], j[ok], v[ok], {c: x[ok] for c, x in raw.items()}, {c: x[ok] for c, x in most.items()}
        identical = (name[0][i] == name[1][j]) & (name[0][i] >= 0) & (size[0][i] == size[1][j]) & (size[0][i] > 0)
        x, y = paths[0][i], paths[1][j]
        up = x > y
        none = np.full(len(i), np.nan)
        return pd.DataFrame({"path_a": np.where(up, y, x), "path_b": np.where(up, x, y), "value": v, "identical": identical} | {f"raw_{k}": raw.get(k, none) for k in VALUED})

    for at in range(0, len(a), TILE):
        rows = slice(at, min(at + TILE, len(a)))
        lo = at if same else 0
        value = measure.similarity(rows, lo)
        found = []
        for left in range(lo, len(b), WIDTH):
            cols = slice(left, min(left + WIDTH, len(b)))
            v = value[:, cols.start - lo : cols.stop - lo]
            total = (v * weights[aspect] + open_weight).astype(np.float32)
            most = {}
            with np.errstate(all="ignore"):
                for k in others:
                    if k in VALUED:
                        most[k] = sides.most(k, rows, cols) * np.float32(max(weights[k], 1e-9))
                        total += most[k]
                ok = total >= threshold - 0.01
                equal = name[0][rows, None] == name[1][None, cols]
                equal &= name[0][rows, None] >= 0
                if equal.any():
                    ok |= equal & (size[0][rows, None] == size[1][None, cols])
                at_once = np.flatnonzero(ok)
                i, j = at_once // ok.shape[1], at_once % ok.shape[1]
                if same:
                    p = i + rows.start < j + cols.start
                    i, j = i[p], j[p]
                if len(i):
                    found.append((i + rows.start, j + cols.start, v[i, j].astype(np.float64), {k: m[i, j] for k, m in most.items()}))
        if found:
            i, j, v = (np.concatenate([x[k] for x in found]) for k in range(3))
            with np.errstate(all="ignore"):
                yield valued(i, j, v, {k: np.concatenate([x[3][k] for x in found]) for k in found[0][3]})
