"""Repair of text that went through a scanner.

Three kinds of damage are found and repaired: running headers, footers and page numbers between
the lines (``page_line``), words divided by a line's end (``split_word``) and words with
misread characters (``wrong_char``).

The corpus's own words, with their counts, say what a word should look like; all of them are
counted and none is cut off by its share, so a word is judged alike in a corpus of any size. The
lexicon stays a distributed table. A symmetric-delete index over it gives a rare word's
candidates: from a frequent word each piece that a scanner misreads is deleted, one or two at a
time or all of a kind, from a rare word each piece that a misreading leaves, and words with the
same remainder meet in a join. Words of up to four letters have one confusion at most. A remainder and the fixed list of pieces determine the word, so no key has more
words than there are pairs of pieces, and every original within the cost limit is found. Cost is
a weighted edit distance in which the usual confusions (rn for m, 0 for o) are cheap and all else
is dearer than the limit; counts of word pairs decide between candidates of equal cost. A word is
a misreading only if its candidate is many times more frequent than the word itself.

Running headers are learned by their repetition: a line that stands in several contexts where it
interrupts a sentence, and whose first and last words don't follow on its neighbours' anywhere
in the corpus. Page numbers and usual titles are recognised by their form.

What is learned comes down to a table of keys and repairs, of the size of the damaged
vocabulary. It is broadcast while it has at most ``TABLE_ROWS`` rows, else each text's keys are
joined with it; the results are the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unifold.runtime import cut_lineage

MIN_COUNT = 3
RATIO = 8
SHORT_RATIO = 60
CONFUSION_COST = 0.4
PLAIN_COST = 1.5
MAX_WORD = 64  # a longer unbroken string is no word
MIN_CONTEXTS = 3
LINE_CHARS = 80
TABLE_ROWS = 300_000

# What a scanner reads (right) for what stands there (left).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"), ("n", "ri"), ("ri", "n"), ("o", "0"), ("t", "f"), ("f", "t"), ("a", "@"),
    ("l", "1"), ("i", "1"), ("d", "cl"), ("cl", "d"), ("s", "5"), ("u", "ii"), ("ii", "u"), ("g", "9"), ("h", "b"), ("b", "h"),
    ("m", "rn"), ("rn", "m"), ("li", "h"), ("h", "li"), ("w", "vv"), ("vv", "w"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("b", "6"),
    ("b", "8"), ("z", "2"), ("q", "9"), ("g", "q"), ("l", "|"), ("i", "|"), ("i", "!"), ("l", "!"), ("s", "$"), ("e", "€"), ("c", "€"),
    ("nn", "m"), ("m", "nn"), ("in", "m"), ("m", "in"), ("o", "c"), ("u", "v"), ("v", "u"), ("g", "6"), ("a", "o"), ("t", "1"), ("y", "v"),
    ("c", "("), ("k", "lc"), ("h", "ii"), ("d", "ci"), ("e", "o"), ("n", "u"), ("u", "n"),
]

_HYPHENS = "-‐­¬"
_BREAK = re.compile(rf"(?<=[^\W_])([{_HYPHENS}])[ \t]*(?:\r\n|\r|\n|\f)\s*(?=[^\W_])")
_NUMBER = re.compile(r"[-–—\[(|]?\s?(?:page|pg\.?|seite|p\.|s\.|pagina|página|blatt|sheet|folio)?\s?\d{1,4}(?:\s?(?:of|von|de|sur|/)\s?\d{1,4})?\s?[-–—\])|.]?", re.I)
_TITLE = re.compile(r"(?:curriculum\s+vit(?:ae|æ)|c\.?v\.?|r[ée]sum[ée]|lebenslauf|(?:strictly\s+|private\s+and\s+)?confidential|vertraulich|draft)", re.I)
_DIGIT = re.compile(r"\d")
_DIVIDER = re.compile(r"\s*[|·–—]\s*|\s+-\s+|\s{3,}")
# Small words inside names.
_PARTICLES = frozenset(("de", "del", "della", "der", "den", "di", "da", "do", "dos", "du", "la", "le", "van", "von", "zu", "zur", "af", "av", "al", "el", "bin", "ibn", "ben", "y", "e", "of"))
_NAME_WORD = re.compile(r"[^\W\d_][\w.'’-]{0,40}")
_LINES = re.compile(r"\r\n|\r|\n|\f")
_BULLET = re.compile(r"\s*(?:[-–—•·*▪◦●‣⁃]|\d{1,3}[.)]|[a-z][.)])\s")
_TOKEN = re.compile(r"[^\s/–—]+")
_EDGE = "".join(c for c in ".,;:?()[]{}\"'“”‘’«»…*•|!")


def is_page_line(line: str) -> bool:
    """Whether a whole line is a running header, a footer or a page number."""
    s = line.strip()
    if not s or len(s) > LINE_CHARS:
        return False
    if not _DIGIT.search(s) and not _TITLE.search(s):
        return False
    if _NUMBER.fullmatch(s):
        return True
    titles = numbers = others = 0
    for piece in (p for p in _DIVIDER.split(s) if p):
        title = _TITLE.match(piece)
        if title and (title.end() == len(piece) or _is_name(piece[title.end() :])):
            titles += 1
        elif _NUMBER.fullmatch(piece):
            numbers += 1
        elif _is_name(piece):
            others += 1
        else:
            return False
    return titles > 0 or (numbers > 0 and others == 1)


def _is_name(text: str) -> bool:
    """One to six words that begin with a capital, name particles aside."""
    words = [w for w in text.split() if w not in _PARTICLES]
    return 0 < len(words) <= 6 and all(w[0].isupper() and _NAME_WORD.fullmatch(w.rstrip(",")) for w in words)


def line_key(line: str) -> str:
    """A line in the form in which repetitions are counted: digits don't tell them apart."""
    return re.sub(r"\d+", "#", " ".join(line.lower().split()))


def drop_page_lines(text: str, learned: Callable[[str], bool] = lambda key: False) -> tuple[str, bool]:
    """The text without page lines; a text of a single line has none."""
    if not _LINES.search(text):
        return text, False
    lines, ends = _LINES.split(text), [*_LINES.findall(text), ""]
    bad = [is_page_line(x) or (0 < len(x.strip()) <= LINE_CHARS and learned(line_key(x))) for x in lines]
    if not any(bad) or all(bad):
        return text, False
    kept = [x + e for x, e, b in zip(lines, ends, bad, strict=True) if not b]
    return "".join(kept).rstrip("\r\n\f") if bad[-1] else "".join(kept), True


def join_split_words(text: str, kept: Callable[[str], bool]) -> tuple[str, bool]:
    """Put words divided by a line's end together; a compound that is ``kept`` keeps its hyphen."""
    out, at, found = [], 0, False
    for m, compound in _divided(text):
        keep = m.group(1) in "-‐" and kept(compound)
        found |= not keep
        out += [text[at : m.start()], "-" if keep else ""]
        at = m.end()
    return "".join([*out, text[at:]]), found


def _divided(text: str) -> Iterator[tuple[re.Match, str]]:
    """Each place where a line's end divides a word, with the word as a compound."""
    at = 0
    for m in _BREAK.finditer(text):
        begin, end = m.start(), m.end()
        while begin > at and text[begin - 1].isalnum():
            begin -= 1
        while end < len(text) and text[end].isalnum():
            end += 1
        at = m.end()
        yield m, f"{text[begin : m.start()]}-{text[m.end() : end]}".lower()


@lru_cache(maxsize=200_000)
def _parts(raw: str) -> tuple[tuple[int, str], ...]:
    """(place, lower-case word) of the words in an unbroken string; compounds in parts."""
    word = raw.strip(_EDGE)
    out, at = [], len(raw) - len(raw.lstrip(_EDGE))
    for part in word.split("-"):
        if 1 < len(part) <= MAX_WORD and any(c.isalpha() for c in part):
            out.append((at, part.lower()))
        at += len(part) + 1
    return tuple(out)


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, lower-case word) of the words that hold a letter; compounds in parts."""
    return [(m.start() + at, m.start() + at + len(w), w) for m in _TOKEN.finditer(text) for at, w in _parts(m.group())]


_BY_READ: dict[str, list[str]] = defaultdict(list)
for _true, _read in CONFUSIONS:
    _BY_READ[_read].append(_true)


def misread_cost(original: str, read: str, limit: float = 10.0) -> float:
    """Weighted edit distance from a word to what was read; confusions are cheap."""
    n, m = len(original), len(read)
    if abs(n - m) > 6:
        return 99.0
    inf = 99.0
    best = [[inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        low = inf
        for j in range(m + 1):
            c = best[i][j]
            if i and j and original[i - 1] == read[j - 1]:
                c = min(c, best[i - 1][j - 1])
            if i and j:
                c = min(c, best[i - 1][j - 1] + PLAIN_COST)
            if i:
                c = min(c, best[i - 1][j] + PLAIN_COST)
            if j:
                c = min(c, best[i][j - 1] + PLAIN_COST)
                for k in (1, 2):
                    if j >= k:
                        for true in _BY_READ.get(read[j - k : j], ()):
                            t = len(true)
                            if i >= t and original[i - t : i] == true:
                                c = min(c, best[i - t][j - k] + CONFUSION_COST)
            best[i][j] = c
            low = min(low, c)
        if low > limit and i > 1 and min(best[i - 1]) > limit:
            return inf
    return best[n][m]


def inspect(text: str, repairs: dict[str, str]) -> tuple[str, list[str]]:
    """The repaired text and the kinds of damage found; an undamaged text is returned as it is.

    ``repairs`` has learned page lines (``l:line``), compounds that keep their hyphen
    (``k:left-right``), misread words with their originals (``w:word``; empty where the context
    decides) and those in context (``t:before|word|after``).
    """
    damage = []
    clean, found = drop_page_lines(text, lambda key: f"l:{key}" in repairs)
    if found:
        damage.append("page_line")
    clean, found = join_split_words(clean, lambda key: f"k:{key}" in repairs)
    if found:
        damage.append("split_word")
    fixed, at, misread = [], 0, False
    if any(f"w:{w}" in repairs for raw in set(_TOKEN.findall(clean)) for _, w in _parts(raw)):
        words = tokens(clean)
        for k, (begin, end, word) in enumerate(words):
            original = repairs.get(f"w:{word}")
            if original == "":
                original = repairs.get(_triple(words, k))
            if original:
                misread = True
                seen = clean[begin:end]
                cased = original.upper() if seen.isupper() and len(seen) > 1 else original.capitalize() if seen[:1].isupper() else original
                fixed += [clean[at:begin], cased]
                at = end
    if misread:
        damage.append("wrong_char")
    if not damage:
        return text, damage
    return flow("".join([*fixed, clean[at:]])), damage


def _triple(words: list[tuple[int, int, str]], k: int) -> str:
    before, after = words[k - 1][2] if k else "", words[k + 1][2] if k + 1 < len(words) else ""
    return f"t:{before}|{words[k][2]}|{after}"


class _Asked(dict):
    """Known repairs that remember what was asked."""

    def __init__(self, known: dict[str, str]):
        super().__init__(known)
        self.keys_asked: set[str] = set()

    def __contains__(self, key: object) -> bool:
        self.keys_asked.add(key)
        return super().__contains__(key)

    def get(self, key: str, default: str | None = None) -> str | None:
        self.keys_asked.add(key)
        return super().get(key, default)


def repair_keys(text: str, known: dict[str, str]) -> set[str]:
    """The keys that ``inspect`` looks up for a text where ``known`` is all that is known."""
    asked = _Asked(known)
    inspect(text, asked)
    return asked.keys_asked


def flow(text: str) -> str:
    """Lines of a paragraph become one; list items and blank lines stay apart."""
    out: list[str] = []
    for line in _LINES.split(text):
        s = line.strip()
        if out and out[-1] and s and not _BULLET.match(line):
            out[-1] += " " + s
        else:
            out.append(s)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


PLACEHOLDER = "*"
_TRUE, _READ = frozenset(t for t, _ in CONFUSIONS), frozenset(r for _, r in CONFUSIONS)


def total_cost(original: str, read: str) -> float:
    """The weighted distance, or that of one confusion if it is the same one all over the word."""
    return CONFUSION_COST if any(t in original and original.replace(t, r) == read for t, r in CONFUSIONS) else misread_cost(original, read)


def remainders(word: str, pieces: frozenset[str]) -> list[tuple[str, str, str]]:
    """(remainder, piece, other piece) of a word without one or two of its pieces, or all of a kind."""
    spans = [(i, i + n) for i in range(len(word)) for n in (1, 2) if word[i : i + n] in pieces and i + n <= len(word)]
    out = [(word[:i] + PLACEHOLDER + word[j:], word[i:j], "") for i, j in spans]
    out += [(word.replace(p, PLACEHOLDER), p, "") for p in {word[i:j] for i, j in spans} if word.count(p) > 2]
    for a, (i, j) in enumerate(spans):
        for k, m in spans[a + 1 :]:
            if k >= j:
                out.append((word[:i] + PLACEHOLDER + word[j:k] + PLACEHOLDER + word[m:], word[i:j], word[k:m]))
    return out


def count_corpus(texts: DataFrame) -> DataFrame:
    """(kind, a, b, n, into, over) of a column ``text``, over all rows.

    Kind ``w``: words and compounds ``a``, with their count. Kind ``p``: pairs of neighbouring
    words of one line. Kind ``l``: lines ``a`` that interrupt a sentence, once for each pair of
    neighbouring lines ``b``, with the word pairs at their beginning and end. Counts are added up
    per batch and before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws, pairs, lines = Counter(), Counter(), {}
            for text in batch["text"]:
                if not text:
                    continue
                if _LINES.search(text):
                    lines.update(_interruptions(text))
                    text = _BREAK.sub("", drop_page_lines(text)[0])
                for line in _LINES.split(text):
                    found = _TOKEN.findall(line)
                    raws.update(found)
                    pairs.update(zip(found, found[1:]))
            words, doubles = Counter(), Counter()
            for raw, n in raws.items():
                parts = [w for _, w in _parts(raw)]
                for w in parts:
                    words[w] += n
                for pair in zip(parts, parts[1:]):
                    doubles[pair] += n
                w = raw.strip(_EDGE).lower()
                if "-" in w and w[0].isalpha() and w[-1].isalpha() and len(w) <= MAX_WORD:
                    words[w] += n
            for (x, y), n in pairs.items():
                if (a := _parts(x)) and (b := _parts(y)):
                    doubles[a[-1][1], b[0][1]] += n
            rows = [("w", w, "", n, "", "") for w, n in words.items()] + [("p", a, b, n, "", "") for (a, b), n in doubles.items()]
            yield pd.DataFrame(rows + [("l", *k, 1, *v) for k, v in lines.items()], columns=["kind", "a", "b", "n", "into", "over"])

    counted = texts.select("text").mapInPandas(count, "kind string, a string, b string, n bigint, into string, over string")
    return counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.min("into").alias("into"), F.min("over").alias("over"))


def _interruptions(text: str) -> Iterator[tuple[tuple[str, str], tuple[str, str]]]:
    """Lines that begin with a capital or digit and stand in the middle of a sentence.

    Yields (line, its neighbours), (pair of words at its beginning, pair of words at its end).
    """
    lines = [x.strip() for x in _LINES.split(text)]
    lines = [x for x in lines if x]
    for before, line, after in zip(lines, lines[1:], lines[2:]):
        if len(line) > LINE_CHARS or not (line[0].isupper() or line[0].isdigit()) or not after[0].islower() or before[-1] in ".!?:;" + _HYPHENS:
            continue
        last, own, following = tokens(before)[-1:], tokens(line), tokens(after)[:1]
        if last and own and following:
            yield (line_key(line), f"{before}|{after}"), (f"{last[0][2]}|{own[0][2]}", f"{own[-1][2]}|{following[0][2]}")


def learned_lines(counts: DataFrame) -> DataFrame:
    """(key, value): lines that interrupt sentences in several contexts and never continue them."""
    known = counts.where("kind = 'p'").select(F.concat_ws("|", "a", "b").alias("pair"), F.lit(1).alias("known"))
    lines = counts.where("kind = 'l'").select("a", "into", "over")
    often = lines.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_CONTEXTS).select("a")
    borders = lines.join(often, "a").select("a", F.explode(F.array("into", "over")).alias("pair"))
    told = borders.join(known, "pair", "left").groupBy("a").agg((F.count("known") / F.count(F.lit(1))).alias("share"))
    return told.where("share <= 0.2").select(F.concat(F.lit("l:"), "a").alias("key"), F.lit("").alias("value"))


def misreadings(words: DataFrame) -> DataFrame:
    """(word, original, n): every frequent word that explains a rarer one at the least cost.

    ``words`` has (a, n). A ligature or other compatibility form is explained by its plain form.
    """
    def explode(pieces: frozenset[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for w, n in zip(batch["a"].tolist(), batch["n"].tolist()):
                    rows += [(key, w, n, x, y) for key, x, y in remainders(w, pieces)]
                    if len(rows) > 50_000:
                        yield pd.DataFrame(rows, columns=["key", "w", "n", "x", "y"])
                        rows = []
                yield pd.DataFrame(rows, columns=["key", "w", "n", "x", "y"])

        return run

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, p) for w in batch["a"] if not w.isascii() and (p := unicodedata.normalize("NFKC", w)) != w]
            yield pd.DataFrame(rows, columns=["word", "a"])

    single = words.where(~F.contains("a", F.lit("-")))
    schema = "key string, w string, n bigint, x string, y string"
    true = single.where(F.col("n") >= RATIO).mapInPandas(explode(_TRUE), schema).select("key", F.col("w").alias("original"), F.col("n").alias("m"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    read = single.mapInPandas(explode(_READ), schema)
    usual = F.array(*(F.lit(f"{t}>{r}") for t, r in CONFUSIONS))

    def confused(t: str, r: str):
        return F.array_contains(usual, F.concat_ws(">", t, r))

    ratio = F.when(F.length("w") <= 3, SHORT_RATIO).otherwise(RATIO)
    met = read.join(true, "key").where((F.col("w") != F.col("original")) & (F.col("m") >= ratio * F.col("n")) & confused("tx", "x"))
    met = met.where(((F.col("y") == "") & (F.col("ty") == "")) | ((F.length("w") > 4) & (F.col("y") != "") & (F.col("ty") != "") & confused("ty", "y")))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cost=[total_cost(t, r) for t, r in zip(batch["original"], batch["word"])])

    found = met.groupBy(F.col("w").alias("word"), "original").agg(F.max("m").alias("n")).mapInPandas(weigh, "word string, original string, n bigint, cost double")
    forms = words.mapInPandas(plain, "word string, a string").join(words.where(F.col("n") >= MIN_COUNT), "a").select("word", F.col("a").alias("original"), "n", F.lit(0.0).alias("cost"))
    every = found.union(forms)
    least = every.groupBy("word").agg(F.min("cost").alias("least"))
    return every.join(least, "word").where("cost < least + 0.01").select("word", "original", "n")


def kept_compounds(words: DataFrame) -> DataFrame:
    """(key, value): compounds that are commoner with their hyphen than as one word."""
    hyphened = words.where(F.contains("a", F.lit("-")) & (F.col("n") >= MIN_COUNT)).select(F.col("a").alias("whole"), "n", F.regexp_replace("a", "-", "").alias("a"))
    joined = hyphened.join(words.select("a", F.col("n").alias("m")), "a", "left")
    return joined.where("n > coalesce(m, 0)").select(F.concat(F.lit("k:"), "whole").alias("key"), F.lit("").alias("value"))


def in_context(texts: DataFrame, pairs: DataFrame, contested: DataFrame, table_rows: int) -> DataFrame:
    """(key, value): the original of each misread word that has several, by its neighbours.

    The candidate that is more often seen beside the word before and the word after, then the
    more frequent one. ``contested`` has (word, original, n).
    """
    reads = contested.select("word").distinct()
    few = reads.limit(table_rows + 1).collect()
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(r.word for r in few)) if len(few) <= table_rows else None

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch["text"]:
                if text:
                    clean = _BREAK.sub("", drop_page_lines(text)[0])
                    if shared is None or any(w in shared.value for raw in set(_TOKEN.findall(clean)) for _, w in _parts(raw)):
                        words = tokens(clean)
                        rows |= {(_triple(words, k), words[k - 1][2] if k else "", w, words[k + 1][2] if k + 1 < len(words) else "") for k, (_, _, w) in enumerate(words) if shared is None or w in shared.value}
            yield pd.DataFrame(list(rows), columns=["key", "before", "word", "after"])

    seen = texts.select("text").mapInPandas(places, "key string, before string, word string, after string").distinct()
    asked = seen.join(contested, "word")
    first = pairs.select(F.col("a").alias("before"), F.col("b").alias("original"), F.col("n").alias("n1"))
    second = pairs.select(F.col("a").alias("original"), F.col("b").alias("after"), F.col("n").alias("n2"))
    told = asked.join(first, ["before", "original"], "left").join(second, ["original", "after"], "left")
    context = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
    best = told.groupBy("key").agg(F.min(F.struct((-context).alias("c"), (-F.col("n")).alias("m"), "original")).alias("b"))
    return best.select("key", F.col("b.original").alias("value"))


def build_repairs(texts: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """The table (key, value) of what ``inspect`` looks up, learned from all rows of ``text``."""
    counts = cut_lineage(count_corpus(texts))
    words, pairs = counts.where("kind = 'w'").select("a", "n"), counts.where((F.col("kind") == "p") & (F.col("n") >= MIN_COUNT)).select("a", "b", "n")
    found = cut_lineage(misreadings(words))
    number = found.groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.min("original").alias("value"))
    direct = number.select(F.concat(F.lit("w:"), "word").alias("key"), F.when(F.col("k") == 1, F.col("value")).otherwise("").alias("value"))
    out = direct.union(kept_compounds(words)).union(learned_lines(counts))
    contested = found.join(number.where("k > 1").select("word"), "word").select("word", "original", "n")
    if not contested.isEmpty():
        out = out.union(in_context(texts, pairs, contested, table_rows))
    return cut_lineage(out)


def inspect_texts(texts: DataFrame, repairs: DataFrame | None = None, table_rows: int = TABLE_ROWS) -> DataFrame:
    """Add ``repaired`` and ``damage`` (array) to rows with a column ``text``.

    The repairs are learned from the same rows unless they are given. Null and blank texts have
    no damage and stay as they are. Whole texts are read, of any length; equal rows get equal
    results. Columns named repaired or damage are replaced. At most ``table_rows`` repairs are
    broadcast; with more, the keys of the distinct texts are joined with them.
    """
    texts = texts.drop("repaired", "damage")
    table = build_repairs(texts, table_rows) if repairs is None else repairs
    few = table.limit(table_rows + 1).collect()
    schema = f"{texts.schema.simpleString()[7:-1]},repaired string,damage array<string>"
    if len(few) <= table_rows:
        shared = texts.sparkSession.sparkContext.broadcast({r.key: r.value for r in few})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                results = [inspect(t, shared.value) if isinstance(t, str) and t.strip() else (t, []) for t in batch["text"]]
                yield batch.assign(repaired=[r for r, _ in results], damage=[d for _, d in results])

        return texts.mapInPandas(run, schema)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, key) for h, t, k, v in zip(batch["_h"], batch["text"], batch["_keys"], batch["_values"]) for key in repair_keys(t, _facts(k, v))]
            yield pd.DataFrame(rows, columns=["_h", "key"])

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [inspect(t, _facts(k, v)) if isinstance(t, str) and t.strip() else (t, []) for t, k, v in zip(batch["text"], batch["_keys"], batch["_values"])]
            yield batch.drop(columns=["_h", "_keys", "_values"]).assign(repaired=[r for r, _ in results], damage=[d for _, d in results])

    told = texts.withColumn("_h", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    once = told.select("_h", "text").where("text is not null").distinct()
    none = F.lit(None).cast("array<string>")
    known = once.select("*", none.alias("_keys"), none.alias("_values"))
    for _ in range(4):  # lines, then compounds, then words, then words in context
        found = known.mapInPandas(keys, "_h string, key string").join(table, "key")
        facts = cut_lineage(found.groupBy("_h").agg(F.collect_list("key").alias("_keys"), F.collect_list("value").alias("_values")))
        known = once.join(facts, "_h", "left")
    return told.join(facts, "_h", "left").mapInPandas(run_joined, schema)


def _facts(keys: list[str] | None, values: list[str] | None) -> dict[str, str]:
    return {} if keys is None else dict(zip(keys, values))
