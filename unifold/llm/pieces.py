"""Splitting oversized texts at natural boundaries, by packing a structure tree.

A text is read as a tree: sections below their headings (``#`` marks, underlined and numbered
headings, lines in capitals or ending in a colon), in these paragraphs, in these lines and list
items, in these sentences, words and, where even a word is too large, tokens. Only a node that is
too large is opened. From the bottom up sibling subtrees are merged to the limit: the children
of an opened node, those left over from children that had to be opened themselves included, come
to as few pieces as possible and among these to the most even ones. Pieces are slices of the
text: without their overlaps they join to the whole text again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unifold.llm.tokens import DEFAULT_VOCABULARY, boundaries, clean, count

LIMIT = 512
OVERLAP = 64

_HASH = re.compile(r"(#{1,6})\s+\S")
_UNDERLINE = re.compile(r"(=+|-{3,}|~{3,})\s*")
_NUMBERED = re.compile(r"(\d{1,2}(?:\.\d{1,2}){0,4})[.)]?\s+[^\W\d].{0,70}")
_ITEM = re.compile(r"\s*(?:[-*+•–—▪◦●‣]|\d{1,3}[.)]|[a-zA-Z][.)])\s")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])|(?<=;)\s+")
_TAG_HEADING = re.compile(r"\s*<h([1-6])[^>]*>", re.I)

SCHEMA = "doc_id bigint, piece_no int, begin int, overlap_begin int, end int, n_tokens int, piece string"


def heading_level(line: str, following: str) -> int:
    """1 to 7 for a heading line (1 is the highest), 0 for others."""
    s = line.strip()
    if not s or len(s) > 90:
        return 0
    if m := _HASH.match(s):
        return len(m.group(1))
    if m := _TAG_HEADING.match(line):
        return int(m.group(1))
    if _UNDERLINE.fullmatch(following.strip()) and not _UNDERLINE.fullmatch(s) and not _ITEM.match(line):
        return 1 if following.strip()[0] == "=" else 2
    if (m := _NUMBERED.fullmatch(s)) and "." in m.group(1) and not s.endswith((".", ";", ",")):
        return 2 + m.group(1).count(".")
    if len(s) <= 60 and s.isupper() and not s.endswith((".", ",", ";")):
        letters = [c for c in s if c.isalpha()]
        if len(letters) >= 4 and all(c.isupper() for c in letters):
            return 3
    if s.endswith((":", "：")) and len(s) <= 50 and not _ITEM.match(line) and len(s.split()) <= 6:
        return 6
    return 0


def outline(text: str) -> tuple[list[int], list[int]]:
    """Where each line begins, and its level: 1 to 7 a heading, 8 a paragraph's first line, 9 others."""
    begins, levels, at, blank = [], [], 0, False
    lines = text.splitlines(keepends=True)
    for line, following in zip(lines, [*lines[1:], ""]):
        begins.append(at)
        levels.append(heading_level(line, following) or (8 if blank and line.strip() else 9))
        blank = not line.strip()
        at += len(line)
    return begins, levels


_WHITE = re.compile(r"\s+")


def _cuts(text: str, begin: int, end: int, level: int, tree: tuple[list[int], list[int]]) -> list[int]:
    """Boundaries inside a slice at one level, without its ends.

    Levels 1 to 7 are headings, 8 paragraphs, 9 list items and lines, 10 sentences, 11 words.
    """
    if level <= 9:
        begins, levels = tree
        return [begins[k] for k in range(bisect_right(begins, begin), bisect_left(begins, end)) if levels[k] <= level]
    pattern = _SENTENCE if level == 10 else _WHITE
    part = text[begin:end]
    return [begin + m.end() for m in pattern.finditer(part) if 0 < m.end() < len(part)]


def split_core(text: str, limit: int, bounds, begin: int = 0, end: int | None = None, tree: tuple | None = None) -> list[tuple[int, int]]:
    """Slices (begin, end) of at most ``limit`` tokens by the whole text's token boundaries."""
    end = len(text) if end is None else end
    if begin >= end:
        return []
    bounds = bounds.tolist() if hasattr(bounds, "tolist") else bounds
    edges = _opened(text, begin, end, 1, limit, bounds, tree or outline(text)) if _size(bounds, begin, end) > limit else [begin, end]
    return list(zip(edges, edges[1:]))


def _size(bounds: list[int], b: int, e: int) -> int:
    return max(1, bisect_left(bounds, e) - bisect_right(bounds, b) + 1)


def _opened(text: str, b: int, e: int, level: int, limit: int, bounds: list[int], tree: tuple) -> list[int]:
    """Edges of the pieces of a node that is too large: its children's, merged."""
    cuts: list[int] = []
    while level <= 11 and not (cuts := _cuts(text, b, e, level, tree)):
        level += 1
    if level > 11:
        first, last = bisect_right(bounds, b), bisect_left(bounds, e)
        n = -(-(last - first + 1) // limit)
        inner = (bounds[first - 1 + (last - first + 1) * k // n] for k in range(1, n))
        return [b, *sorted({x for x in inner if b < x < e}), e]
    units = [b]
    for x, y in zip([b, *cuts], [*cuts, e]):
        units += _opened(text, x, y, level + 1, limit, bounds, tree)[1:] if _size(bounds, x, y) > limit else [y]
    return _merged(units, limit, bounds)


def _merged(edges: list[int], limit: int, bounds: list[int]) -> list[int]:
    """Edges that are left when neighbours are merged to as few and as even pieces as possible.

    Where very many children fit one piece, those are first joined to runs of a share of it.
    """
    share = limit // 16
    if len(edges) > 64 and _size(bounds, edges[0], edges[-1]) < (len(edges) - 1) * share:
        runs = [edges[0]]
        for x, y in zip(edges[1:], edges[2:]):
            if _size(bounds, runs[-1], y) > share:
                runs.append(x)
        edges = [*runs, edges[-1]]
    left, right = [bisect_left(bounds, x) for x in edges], [bisect_right(bounds, x) for x in edges]
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # pieces, sum of squares, place of the last piece's begin
    for j in range(1, len(edges)):
        found = None
        for i in range(j - 1, -1, -1):
            n = left[j] - right[i] + 1
            if n > limit and i < j - 1:
                break
            option = (best[i][0] + 1, best[i][1] + n * n, i)
            found = option if found is None or option < found else found
        best.append(found)
    out, j = [edges[-1]], len(edges) - 1
    while j:
        j = best[j][2]
        out.append(edges[j])
    return out[::-1]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = DEFAULT_VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(begin, overlap_begin, end, tokens) of a text's pieces, in order.

    Each piece but the first begins with the last ``overlap`` tokens before ``begin`` (all there
    are, if fewer). Every piece, its overlap included, has at most ``limit`` tokens when
    tokenized by itself; a piece whose own tokens are more than the whole text's there is divided
    again. Limit must exceed overlap by 8 or more.
    """
    if limit < overlap + 8:
        raise ValueError("the limit must exceed the overlap by 8 or more tokens")
    starts = boundaries(text, path).tolist()
    if len(starts) - 1 <= limit:
        return [(0, 0, len(text), len(starts) - 1)]
    out, tree = [], outline(text)
    todo = split_core(text, limit - overlap, starts, tree=tree)[::-1]
    while todo:
        b, e = todo.pop()
        ob = min(b, starts[max(0, bisect_left(starts, b) - overlap)])
        n = count(text[ob:e], path)
        if n > limit and e - b > 1:
            half = split_core(text, max(1, _size(starts, b, e) // 2), starts, b, e, tree)
            todo += (half if len(half) > 1 else [(b, (b + e) // 2), ((b + e) // 2, e)])[::-1]
        else:
            out.append((b, ob, e, n))
    return out


def split_documents(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Pieces of every document above the limit: SCHEMA, one row per piece.

    Documents of at most ``limit`` tokens, null and empty texts and null ids give no rows. ``begin`` and
    ``end`` are character offsets, ``overlap_begin`` is where the piece with its overlap starts,
    ``piece`` is text[overlap_begin:end]. Rows are handled alone, without a shuffle; repeated
    rows give repeated pieces. Other columns aren't read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not text or len(text.encode("utf-8", "replace")) <= limit:
                    continue
                text = clean(text)
                parts = split_text(text, limit, overlap, path)
                if len(parts) > 1:
                    rows += [(doc, i, b, ob, e, n, text[ob:e]) for i, (b, ob, e, n) in enumerate(parts)]
                    size += len(text)
                if size > 4_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, SCHEMA)
