"""Names compared all with all, block by block: what two bags of letters have in common bounds their ratio, and only what that leaves is compared letter by letter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from echofold.functions import names

#: Letters up to which a string is held in a matrix; longer ones are compared one by one.
WIDE = 256
#: Rows of the left side, and of the right, compared at once: few enough to stay in a core's cache.
TILE, WIDTH = 128, 1024
_SLOTS = 96


def _letters(strings: list[str]) -> np.ndarray:
    """(n, width): code points, 0 behind the end; rows of strings that are too long are empty."""
    x = np.array([s if len(s) <= WIDE else "" for s in strings], dtype="U") if strings else np.zeros(0, "U1")
    return np.ascontiguousarray(x).view(np.uint32).reshape(len(x), -1)


class Bags:
    """Two lists of strings with their letters; `common` bounds the length of the longest common subsequence from above."""

    def __init__(self, left: list[str], right: list[str]):
        self.left, self.right = left, right
        self.lengths = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
        raw = [_letters(left), _letters(right)]
        known = np.unique(np.concatenate([r.ravel() for r in raw] + [np.zeros(1, np.uint32)]))
        self.codes = [np.searchsorted(known, r) for r in raw]  # 0 stands for the end
        self.n_codes = len(known)
        slots = min(_SLOTS, max(1, self.n_codes - 1))
        counts = []
        for c in self.codes:
            flat = np.repeat(np.arange(len(c)), c.shape[1]) * slots + ((c - 1) % slots).ravel()
            counts.append(np.bincount(flat[c.ravel() > 0], minlength=len(c) * slots).reshape(len(c), slots))
        most = np.minimum(*[c.max(0, initial=0) for c in counts])
        levels = range(1, int(most.max(initial=0)) + 1)
        self.bags = [np.concatenate([c[:, most >= k] >= k for k in levels] or [np.zeros((len(c), 1))], axis=1).astype(np.float32) for c in counts]

    def common(self, rows: slice, cols: slice = slice(None)) -> np.ndarray:
        return self.bags[0][rows] @ self.bags[1][cols].T

    def ratios(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """indel_ratio of the pairs: bit-parallel, a word of 64 bits for each pair; longer strings one by one."""
        out = np.ones(len(i))
        n = self.lengths[0][i] + self.lengths[1][j]
        short = (self.lengths[0][i] <= 64) & (self.lengths[1][j] <= WIDE)
        for k in np.flatnonzero(~short).tolist():
            out[k] = names.indel_ratio(self.left[i[k]], self.right[j[k]])
        at = np.flatnonzero(short)
        if len(at):
            used, row = np.unique(i[at], return_inverse=True)
            masks = np.zeros((len(used), self.n_codes), np.uint64)
            own = self.codes[0][used][:, :64]
            for p in range(own.shape[1]):
                masks[np.arange(len(used)), own[:, p]] |= np.uint64(1 << p)
            masks[:, 0] = 0
            masks = masks.ravel()
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                base, other = row[lo : lo + (1 << 16)] * self.n_codes, self.codes[1][j[part]]
                v = np.full(len(part), ~np.uint64(0))
                for p in range(int(self.lengths[1][j[part]].max(initial=0))):
                    u = v & masks[base + other[:, p]]
                    v = (v + u) | (v - u)
                la = self.lengths[0][i[part]].astype(np.uint64)
                full = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(la, np.uint64(63))) - np.uint64(1))
                out[part] = np.where(n[part] > 0, 2.0 * np.bitwise_count(~v & full) / np.maximum(n[part], 1), 1.0)
        return out


def _joint(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes = pd.factorize(pd.concat([a, b], ignore_index=True))[0]
    return codes[: len(a)], codes[len(a) :]


def _own_words(a: list[str], b: list[str], slots: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain words of each of `a`, by slot, their number, and the slots of all words of each of `b`."""
    x, n, y = np.zeros((len(a), slots), np.float32), np.zeros(len(a), np.float32), np.zeros((len(b), slots), np.float32)
    place = lambda w: int.from_bytes(w.encode()[-6:], "little") * 2654435761 % 2**61 % slots
    for k, s in enumerate(a):
        for w in {t for t in s.split(" ") if len(t) >= 3 and t.isascii() and t.isalpha()}:
            x[k, place(w)] += 1
            n[k] += 1
    for k, s in enumerate(b):
        y[k, [place(w) for w in s.split(" ")]] = 1
    return x, n, y


def near(a: pd.DataFrame, b: pd.DataFrame, same: bool, least: float, low: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of rows (name, words, id, digits, text, runs) whose words are alike by `least` and whose names don't exclude each other.

    With `low`, also those alike by `low` of which one may have no plain word of its own, and equal names. Nothing that
    counts is left out; with `low`, more than that may come out. `same`: a and b are one block, and each two rows come once.
    """
    # by length, so that a tile meets only those that are long or short enough
    order = [np.argsort(x["words"].str.len().to_numpy(), kind="stable") for x in (a, b)]
    a, b = a.iloc[order[0]], b.iloc[order[1]]
    bags = Bags(a["words"].tolist(), b["words"].tolist())
    (la, lb), (name_a, name_b), (text_a, text_b) = bags.lengths, _joint(a["name"], b["name"]), _joint(a["text"], b["text"])
    (runs_a, runs_b), (digits_a, digits_b) = _joint(a["runs"], b["runs"]), _joint(a["digits"], b["digits"])
    id_a, id_b, told, blank = a["id"].to_numpy(bool), b["id"].to_numpy(bool), (a["text"] != "").to_numpy(), (a["words"] == "").to_numpy()
    long_a, long_b = la > WIDE, lb > WIDE
    if low is not None:
        (xa, na, yb), (xb, nb, ya) = _own_words(a["name"].tolist(), b["name"].tolist()), _own_words(b["name"].tolist(), a["name"].tolist())
    floor = (least if low is None else low) / 2
    # what two bags have in common, less what they need
    need = [np.concatenate([bags.bags[0], (la * -floor)[:, None], np.ones((len(la), 1))], axis=1).astype(np.float32), np.concatenate([bags.bags[1], np.ones((len(lb), 1)), (lb * -floor)[:, None]], axis=1).astype(np.float32)]
    any_long = long_a.any() or long_b.any()
    for at in range(0, len(a), TILE):
        rows = slice(at, min(at + TILE, len(a)))
        first = int(np.searchsorted(lb, la[rows.start] * floor / (1 - floor) - 1e-6))
        last = int(np.searchsorted(lb, la[rows.stop - 1] * (1 - floor) / floor + 1e-6, "right"))
        for start in range(max(first, at) if same else first, last, WIDTH):
            cols = slice(start, min(start + WIDTH, last))
            over = need[0][rows] @ need[1][cols].T
            if any_long and (long_a[rows].any() or long_b[cols].any()):
                x, y = la[rows, None], lb[None, cols]
                over = np.where(long_a[rows, None] | long_b[None, cols], np.minimum(x, y) - (x + y) * floor, over)
            bare = None
            if low is None:
                ok = over >= -1e-3
            else:
                bare = xa[rows] @ yb[cols].T >= na[rows, None]
                bare |= ya[rows] @ xb[cols].T >= nb[None, cols]
                ok = over >= (least / 2 - floor) * (la[rows, None] + lb[None, cols]).astype(np.float32) - np.float32(1e-3)
                ok |= bare & (over >= -1e-3)
            at_once = np.flatnonzero(ok)
            i, j = at_once // ok.shape[1] + rows.start, at_once % ok.shape[1] + cols.start
            if same:
                i, j = i[i < j], j[i < j]
            equal = name_a[i] == name_b[j]
            excluded = (id_a[i] & id_b[j] & (digits_a[i] != digits_b[j])) | (told[i] & (text_a[i] == text_b[j]) & (runs_a[i] != runs_b[j])) | (blank[i] & ~equal)
            keep = ~excluded if low is None else equal | ~excluded
            i, j, equal = i[keep], j[keep], equal[keep]
            if not len(i):
                continue
            r = bags.ratios(i, j)
            keep = r >= least
            if low is not None:
                keep |= equal | ((r >= low - 1e-9) & bare[i - rows.start, j - cols.start])
            yield order[0][i[keep]], order[1][j[keep]]
