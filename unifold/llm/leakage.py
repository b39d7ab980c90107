"""Evaluation passages that stand, fully or partly, in a corpus.

A document leaks an item if it holds ``min_words`` or more consecutive words of the item in the
item's order, of which at most one in ``one_in`` is exchanged for another word.

Filter: of letters and digits only, in lower case, item and document share character q-grams. Of
a passage that qualifies one half qualifies too while it has twice ``min_words`` or more, so
passages of ``min_words`` to twice that are looked for. Two bounds hold for each of them, of
whatever length the exchanged words are:

* each exchanged word of n characters destroys at most n + q - 1 of the passage's q-grams (the
  q-gram lemma). What is left is counted by overlapping blocks of the item and of the document's
  words on all diagonals, since a word exchanged for a longer or shorter one moves all that
  follows to another diagonal;
* between exchanged words the passage keeps its diagonal, so the q-grams of its longest unbroken
  run stand together in one of the overlapping bands of diagonals.

Only regions that reach both go on. Verification: the document's words around the band, as far
as a passage may reach, are aligned with the item's, diagonal by diagonal.

The corpus is read once and never shuffled. The items are a stated query set: they go to the
executors in blocks whose size is checked, so any number of them can be searched.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 1 << 20
BAND = 64
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|&[A-Za-z]{2,8};|&#\d{1,6};", re.S)
_WORD = re.compile(r"[^\W_]+")
_BITS = 22


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 20, one_in: int = 8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of every leaked pair.

    ``docs`` has doc_id and text, ``items`` has item_id and text; other columns are not read.
    Null and empty texts leak nothing, as do items of fewer than ``min_words`` words. Repeated
    rows give one pair. Rows with a null id are left out. Markup (tags, entities), case,
    punctuation and line breaks don't count; a word divided by a line's end counts as one.
    """
    spark = docs.sparkSession
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        index = build_index([(r.item_id, r.text) for r in block], min_words, one_in)
        shared = spark.sparkContext.broadcast(index)
        found = docs.mapInPandas(_search(shared), "doc_id bigint, item_id bigint")
        out = found if out is None else out.union(found)
    return out.distinct()


def words(text: str) -> list[str]:
    """Words in lower case; tags and entities are no words."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.replace("­", "").lower())


@dataclass
class Index:
    min_words: int
    one_in: int
    q: int
    least: np.ndarray  # by item, shift and block: q-grams a passage there shares, at least
    unbroken: np.ndarray  # by item: q-grams of a passage's longest unbroken run, at least
    stretch: int  # most characters of a passage to look for; a block of an item is twice that
    ids: list[int]
    words: list[list[str]]
    hashes: np.ndarray
    starts: np.ndarray
    item_of: np.ndarray
    place_of: np.ndarray
    bitmap: np.ndarray


def build_index(items: list[tuple[int, str]], min_words: int, one_in: int, largest_q: int = 16) -> Index:
    """The q-gram index of one block of items."""
    kept = [(i, w) for i, t in items if len(w := words(t)) >= min_words]
    # A longer passage that qualifies has a half that does, so lengths below twice the least are all.
    sizes = [n for n in range(min_words, 2 * min_words) if n == min_words or n % one_in == 0]
    run = min(-(-(n - n // one_in) // (n // one_in + 1)) for n in sizes)  # words in the longest unbroken run, at least
    spans = [sum(map(len, w[p : p + run])) for _, w in kept for p in range(len(w) - run + 1)]
    q = max(1, min([largest_q, *spans]))
    bounds, stretch, unbroken = [], 1, []
    for i, (_, w) in enumerate(kept):
        length = np.array([len(x) for x in w])
        ends = np.concatenate([[0], np.cumsum(length)])
        unbroken.append(int(min(ends[run:] - ends[:-run])) - q + 1)
        whole = min(2 * min_words - 1, len(w))
        stretch = max(stretch, int((ends[whole:] - ends[:-whole]).max()))
        for n in sizes:
            if n > len(w):
                break
            m = n // one_in
            first, last = ends[:-n], ends[n:]
            lost = np.array([sum(sorted(length[p : p + n])[-m:]) for p in range(len(w) - n + 1)]) if m else 0
            bounds.append((i, first, last, np.maximum(unbroken[-1], last - first - q + 1 - lost - m * (q - 1))))
    blocks = 1 + max((int(e.max()) for _, _, e, _ in bounds), default=0) // stretch
    least = np.full((len(kept), 2, blocks + 1), 1 << 30, np.int64)
    for i, first, last, bound in bounds:
        for half in (0, 1):
            block = (first + half * stretch) // (2 * stretch)
            inside = (last - 1 + half * stretch) // (2 * stretch) == block
            np.minimum.at(least[i, half], block[inside], bound[inside])
    texts = ["".join(w) for _, w in kept]
    grams = [_hashes(_codes(t)[0], q) for t in texts]
    h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(grams), dtype=np.int64), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(g), dtype=np.int64) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    uniq, starts = np.unique(h[order], return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(uniq >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(min_words, one_in, q, least, np.array(unbroken, np.int64), stretch, [i for i, _ in kept], [w for _, w in kept], uniq, np.append(starts, len(h)), item[order], place[order], bitmap)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case code, and whether it is a letter or digit."""
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    alnum = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalnum():
            alnum[c] = True
            if len(low := s.lower()) == 1:
                lower[c] = ord(low)
    return lower, alnum


_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters and digits, in lower case, and the number of the word each is in."""
    global _TABLES
    if _TABLES is None:
        _TABLES = _tables()
    lower, alnum = _TABLES
    raw = np.frombuffer(text.replace("\xad", "").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = alnum[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    return lower[raw[inside]], np.cumsum(begins)[inside]


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q-gram, by doubling, mixed so that its upper bits are spread."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    power, width, whole, have = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    need, n = q, len(codes) - q + 1
    while need:
        if need & 1:
            part = power[have : have + n]
            whole = part.copy() if whole is None else whole * np.uint64(pow(base, width, mask + 1)) + part
            have += width
        need >>= 1
        if need:
            power = power[:-width] * np.uint64(pow(base, width, mask + 1)) + power[width:]
            width *= 2
    whole ^= whole >> np.uint64(31)
    return whole * np.uint64(0xBF58476D1CE4E5B9)


def _search(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for batch in batches:
            out, chunk, size = [], [], 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                chunk.append((doc, text))
                size += len(text)
                if size >= CHUNK_CHARS:
                    out.extend(_leaks(chunk, index))
                    chunk, size = [], 0
            out.extend(_leaks(chunk, index))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    return run


def _leaks(docs: list[tuple[int, str]], index: Index) -> list[tuple[int, int]]:
    """Filter and verify a chunk of documents."""
    if not docs or not len(index.hashes):
        return []
    gap = np.zeros(index.q, np.uint32)
    parts, places, begin, at = [], [], [], 0
    for _, text in docs:
        codes, numbers = _codes(_TAG.sub(" ", text) if "<" in text or "&" in text else text)
        begin.append(at)
        parts += [codes, gap]
        places += [numbers, gap]
        at += len(codes) + index.q
    h = _hashes(np.concatenate(parts), index.q)
    hit = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(hit):
        return []
    slot = np.searchsorted(index.hashes, h[hit])
    slot[slot == len(index.hashes)] = 0
    same = index.hashes[slot] == h[hit]
    hit, slot = hit[same], slot[same]
    count = index.starts[slot + 1] - index.starts[slot]
    if not len(hit):
        return []
    doc_of_hit = np.searchsorted(np.array(begin), hit, side="right") - 1
    rows = np.repeat(np.arange(len(hit)), count)
    posting = np.repeat(index.starts[slot] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(rows))
    item, place = index.item_of[posting], index.place_of[posting]
    doc = doc_of_hit[rows]
    at = hit[rows] - np.array(begin)[doc]
    pairs, pair = np.unique(doc.astype(np.int64) * len(index.ids) + item, return_inverse=True)
    lowest = index.least.min(axis=(1, 2))
    some = np.flatnonzero((np.bincount(pair) >= lowest[pairs % len(index.ids)])[pair])
    if not len(some):
        return []
    rows, place, at, pair = rows[some], place[some], at[some], pair[some]
    # The lemma's bound, by block of the item and block of the document's words, on all diagonals.
    reach = 4 * index.min_words  # words of a passage, each of them divided by a line's end
    number = np.concatenate(places)[hit[rows]].astype(np.int64)
    kept = np.zeros(len(rows), bool)
    blocks, pages = index.least.shape[2], int(number.max()) // (2 * reach) + 2
    for half in (0, 1):
        block = (place + half * index.stretch) // (2 * index.stretch)
        for lag in (0, 1):
            cells, cell = np.unique((pair * blocks + block) * pages + (number + lag * reach) // (2 * reach), return_inverse=True)
            once = np.sort(cell * (int(place.max()) + 1) + place)  # a place counts once
            n = np.bincount(once[np.append(True, once[1:] != once[:-1])] // (int(place.max()) + 1), minlength=len(cells))
            at_block = cells // pages
            kept |= (n >= index.least[pairs[at_block // blocks] % len(index.ids), half, at_block % blocks])[cell]
    some = np.flatnonzero(kept)
    if not len(some):
        return []
    # The unbroken run's bound, by band of diagonals; a band is given by its hits in the document.
    pair, at, diagonal = pair[some], at[some], (at - place)[some]
    low = int(diagonal.min())
    width = (int(diagonal.max()) - low) // BAND + 2
    regions: dict[int, list[tuple[int, int]]] = {}
    for shift in (0, BAND // 2):
        keys, inverse, n = np.unique(pair * width + (diagonal - low + shift) // BAND, return_inverse=True, return_counts=True)
        first, last = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
        np.minimum.at(first, inverse, at)
        np.maximum.at(last, inverse, at)
        enough = n >= index.unbroken[pairs[keys // width] % len(index.ids)]
        for p, f, t in zip(pairs[keys[enough] // width].tolist(), first[enough].tolist(), last[enough].tolist(), strict=True):
            regions.setdefault(p, []).append((f, t))
    out, seen, own, ends = [], -1, [], None
    for p in sorted(regions):
        d, i = divmod(p, len(index.ids))
        if d != seen:
            seen, own = d, words(docs[d][1])
            ends = np.cumsum([len(w) for w in own])
        spans: list[list[int]] = []
        for f, t in sorted(regions[p]):
            f, t = max(0, int(np.searchsorted(ends, f, side="right")) - reach), int(np.searchsorted(ends, t + index.q)) + reach
            if spans and f <= spans[-1][1]:
                spans[-1][1] = max(t, spans[-1][1])
            else:
                spans.append([f, t])
        if any(_aligned(own[f:t], index.words[i], index.min_words, index.one_in) for f, t in spans):
            out.append((docs[d][0], index.ids[i]))
    return out


def _aligned(doc: list[str], item: list[str], min_words: int, one_in: int) -> bool:
    """Whether some stretch on one diagonal is long enough with few enough exchanged words."""
    places: dict[str, list[int]] = {}
    for k, w in enumerate(item):
        places.setdefault(w, []).append(k)
    pairs = {a + b: (a, b) for a, b in zip(item, item[1:])}
    joined, k = [], 0
    while k < len(doc):
        w = doc[k]
        if w not in places and k + 1 < len(doc) and w + doc[k + 1] in places:
            joined.append(w + doc[k + 1])
            k += 2
            continue
        joined.extend(pairs[w] if w not in places and w in pairs else (w,))
        k += 1
    matches: dict[int, list[int]] = {}
    for k, w in enumerate(joined):
        for p in places.get(w, ()):
            matches.setdefault(k - p, []).append(p)
    least = min_words - min_words // one_in
    for diagonal, at in matches.items():
        if len(at) < least - 1:
            continue
        low, high = max(0, -diagonal), min(len(item), len(joined) - diagonal)
        if high - low < min_words:
            continue
        step = np.full(high - low, 1 - one_in)
        step[np.array(at) - low] = 1
        total = np.concatenate([[0], np.cumsum(step)])
        if (total[min_words:] >= np.minimum.accumulate(total)[: len(total) - min_words]).any():
            return True
    return False
