"""Edit metrics: batched Levenshtein distances, a BK-tree, and a typing-error cost.

The Levenshtein distance is a true metric, so the triangle inequality may prune with it. Many
strings are compared with one at a time, bit-parallel (Myers, Hyyrö), each string in its own
lane of a numpy vector.
"""

from __future__ import annotations

import sys

import numpy as np

_WORD_BITS = 64
_TABLE: np.ndarray | None = None


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as columns (longest length x strings, padded with 0), and the lengths."""
    lens = np.array([len(s) for s in strings], np.int64)
    width = int(lens.max()) if len(strings) else 0
    flat = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(flat.reshape(len(strings), width).T), lens


def distances(pattern: str, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Levenshtein distance of ``pattern`` to each encoded string."""
    global _TABLE
    m, n = len(pattern), len(lens)
    if m == 0 or n == 0:
        return lens.copy()
    if m > _WORD_BITS:
        return _long_distances(pattern, codes, lens)
    if _TABLE is None:
        _TABLE = np.zeros(sys.maxunicode + 1, np.uint64)
    one, top = np.uint64(1), np.uint64(m - 1)
    for i, c in enumerate(pattern):
        _TABLE[ord(c)] |= one << np.uint64(i)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    for j in range(int(lens.max())):
        eq = _TABLE[codes[j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += np.where(j < lens, ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64), 0)
        ph = (ph << one) | one
        mh <<= one
        pv = mh | ~(xv | ph)
        mv = ph & xv
    for c in pattern:
        _TABLE[ord(c)] = 0
    return score


def _long_distances(pattern: str, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Row by row for patterns of more characters than a machine word has bits."""
    p = np.array([ord(c) for c in pattern], np.int64)
    row = np.repeat(np.arange(len(p) + 1)[:, None], len(lens), axis=1)
    out = np.where(lens == 0, len(p), 0)
    for j in range(codes.shape[0]):
        new = np.empty_like(row)
        new[0] = j + 1
        for i in range(len(p)):
            new[i + 1] = np.minimum(np.minimum(row[i + 1], new[i]) + 1, row[i] + (codes[j] != p[i]))
        row = new
        out = np.where(lens == j + 1, row[-1], out)
    return out


def pair_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distance of each string to the one beside it, each pair in its own lane."""
    if not left:
        return np.zeros(0, np.int64)
    a, m = encode(left)
    b, n = encode(right)
    if a.shape[0] > _WORD_BITS:
        return np.array([levenshtein(x, y) for x, y in zip(left, right, strict=True)], np.int64)
    one, top = np.uint64(1), np.maximum(m - 1, 0).astype(np.uint64)
    pv, mv, score = np.full(len(left), ~np.uint64(0)), np.zeros(len(left), np.uint64), m.copy()
    for j in range(b.shape[0]):
        eq = np.zeros(len(left), np.uint64)
        for i in range(a.shape[0]):
            eq |= (a[i] == b[j]).astype(np.uint64) << np.uint64(i)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += np.where(j < n, ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64), 0)
        ph = (ph << one) | one
        pv = (mh << one) | ~(xv | ph)
        mv = ph & xv
    return np.where(m == 0, n, score)


def levenshtein(a: str, b: str) -> int:
    """Distance of two strings."""
    return int(distances(a, *encode([b]))[0]) if a and b else max(len(a), len(b))


def typing_cost(typed: str, meant: str) -> tuple[int, float]:
    """(edits, cost) to get ``typed`` from ``meant``; swapped neighbours are one edit.

    The cost ranks meanings that are equally many edits away: a doubled or swapped letter is
    the likeliest slip, then a dropped one, a wrong one, and an added foreign one.
    """
    big = (10**6, 1e9)
    prev2: list = []
    prev = [(j, 1.2 * j) for j in range(len(typed) + 1)]
    for i in range(1, len(meant) + 1):
        cur = [(i, 0.9 * i)]
        for j in range(1, len(typed) + 1):
            same = meant[i - 1] == typed[j - 1]
            d = prev[j - 1]
            best = d if same else (d[0] + 1, d[1] + 1.0)
            d = prev[j]
            best = min(best, (d[0] + 1, d[1] + 0.9))
            d = cur[j - 1]
            best = min(best, (d[0] + 1, d[1] + (0.8 if j > 1 and typed[j - 1] == typed[j - 2] else 1.2)))
            if i > 1 and j > 1 and meant[i - 1] == typed[j - 2] and meant[i - 2] == typed[j - 1] and not same:
                d = prev2[j - 2]
                best = min(best, (d[0] + 1, d[1] + 0.8))
            cur.append(best)
        prev2, prev = prev, cur
    return prev[-1] if prev else big


def typing_costs(typed: list[str], meant: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``typing_cost`` of each string to the one beside it; costs in tenths."""
    if not typed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, m = encode(typed)
    b, n = encode(meant)
    edit, none = 1 << 16, np.zeros(a.shape[1], bool)  # edits above costs: the lesser number has fewer edits, then costs less
    doubled = [none, *(a[j] == a[j - 1] for j in range(1, len(a)))]
    added = [np.where(d, edit + 8, edit + 12) for d in doubled]
    prev2: list = []
    prev = [np.full(len(m), j * (edit + 12), np.int64) for j in range(len(a) + 1)]
    last = np.stack(prev)[m, np.arange(len(m))]  # where nothing is meant
    before: list = []
    for i in range(1, len(b) + 1):
        cur = [np.full(len(m), i * (edit + 9), np.int64)]
        equal = [b[i - 1] == a[j] for j in range(len(a))]
        for j in range(1, len(a) + 1):
            same = equal[j - 1]
            best = np.minimum(prev[j - 1] + np.where(same, 0, edit + 10), np.minimum(prev[j] + (edit + 9), cur[j - 1] + added[j - 1]))
            if i > 1 and j > 1:
                swap = equal[j - 2] & before[j - 1] & ~same
                best = np.where(swap, np.minimum(best, prev2[j - 2] + (edit + 8)), best)
            cur.append(best)
        prev2, prev, before = prev, cur, equal
        ends = np.flatnonzero(n == i)
        if len(ends):
            last[ends] = np.stack(cur)[m[ends], ends]
    return last >> 16, last & 0xFFFF


class BKTree:
    """A Burkhard-Keller tree over distinct strings under the Levenshtein distance."""

    def __init__(self, entries: list[str]):
        self.entries = sorted(set(entries))
        self.children: list[dict[int, int]] = [{} for _ in self.entries]
        for new in range(1, len(self.entries)):
            at = 0
            while True:
                d = levenshtein(self.entries[at], self.entries[new])
                if d not in self.children[at]:
                    self.children[at][d] = new
                    break
                at = self.children[at][d]

    def within(self, queries: list[str], radius: np.ndarray) -> list[list[str]]:
        """For each query every entry within its radius; whole batches descend together."""
        found: list[list[str]] = [[] for _ in queries]
        if not self.entries or not queries:
            return found
        codes, lens = encode(queries)
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, who = stack.pop()
            d = distances(self.entries[node], codes[:, who], lens[who])
            for q in who[d <= radius[who]]:
                found[q].append(self.entries[node])
            for edge, child in self.children[node].items():
                keep = who[np.abs(d - edge) <= radius[who]]  # the triangle inequality
                if len(keep):
                    stack.append((child, keep))
        return found
