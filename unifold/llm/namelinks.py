"""Variant spellings of one person's name, linked by metric-space partitioning.

The pivots are given names. Formal ones come from a table of short forms, common ones are
learned from the corpus as words that stand beside very many different others; every other given
name is a pivot of its own. A name belongs to the cell of each pivot its given name may stand
for: by being it, being a short form of it, or lying within one slip; a name with only an initial
is replicated to the pivots with that initial. Which word of a name is the given one is open
where neither is known, so such a name has both readings. Within a pivot, cells are bands of the
family name's length, which is its distance from the empty name; by the triangle inequality two
names within ``RADIUS`` slips differ by at most ``RADIUS`` in length, so names near a band's
boundary are replicated into the next. Inside each cell an exact radius join on the family names
finds the rarer spellings' originals: words within one or two slips have a form in common that
lacks as many letters, so only words that share one are compared, and a cell's cost grows with
its names, not with their pairs. A cell of more than ``CELL`` names is shared by several tasks,
each of which looks for the originals of a part of the names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unifold.functions.text import strip
from unifold.llm.metric import distances, encode, typing_cost, typing_costs
from unifold.llm.personnames import GivenNames, readings, segments, without_umlauts
from unifold.runtime import cut_lineage

RADIUS = 2  # slips; a swap of neighbours is one slip and two Levenshtein edits
BAND = 4
LEARN_SHARE = 5e-4
LEARN_PARTNERS = 20
CELL = 500_000
CHUNK = 100_000  # rows of cells that are looked at together
FORMS = 8_000_000  # shortened words that are sorted together
BLOCK = 2_000_000  # pairs that are held before they are compared
PAIRS = 20_000  # pairs that are compared together
LONG = 40  # longer words have too many shortened forms
_BASE = 0x5851F42D4C957F2D


def learn_given_names(names: DataFrame, share: float = LEARN_SHARE, partners: int = LEARN_PARTNERS) -> list[str]:
    """Words in at least ``share`` of all names that stand beside ``partners`` different words.

    ``names`` has a column ``name`` of distinct strings. At most the mean number of words in a
    name, doubled, over ``share`` words come to the driver. A rarer word one slip from a much
    commoner one is its misspelling and isn't kept. Words that aren't learned are still pivots,
    only not known ones.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                words = [t for p in segments(name) for t in p if len(t) > 1]
                rows += [(a, b) for x, y in zip(words, words[1:]) for a, b in ((x, y), (y, x)) if a != b]
            yield pd.DataFrame(rows, columns=["a", "b"])

    total = names.count()
    found = (
        names.mapInPandas(pairs, "a string, b string").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("a").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("partners"))
        .where((F.col("n") >= share * total) & (F.col("partners") >= partners)).collect()
    )
    count = {r.a: r.partners for r in found}
    kept: list[str] = []
    for word in sorted(count, key=lambda w: (-count[w], w)):
        if not any(abs(len(word) - len(k)) <= 1 and count[k] >= 4 * count[word] and typing_cost(word, k)[0] <= 1 for k in kept):
            kept.append(word)
    return kept


def distinct_names(columns: list[DataFrame]) -> DataFrame:
    """Distinct non-blank strings, outer blanks removed, of one-column frames; column ``name``."""
    every = columns[0].toDF("name")
    for c in columns[1:]:
        every = every.union(c.toDF("name"))
    return every.select(strip(F.col("name")).alias("name")).where("name <> ''").distinct()


def read_names(names: DataFrame, givens: GivenNames) -> DataFrame:
    """(name, pivot, family, slips, initial_only): one row per reading of each name.

    An initial gives a row for each pivot with that initial and one for the initial itself.
    """
    shared = names.sparkSession.sparkContext.broadcast(sorted({p for ps in givens.formal.values() for p in ps} - set(GivenNames().formal)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = GivenNames(shared.value)
        for batch in batches:
            rows = []
            for name in batch["name"]:
                for r in readings(name, known):
                    pivots = [r.pivot, *known.beginning_with(r.pivot[2:])] if r.initial_only else [r.pivot]
                    rows += [(name, p, r.family, r.slips, r.initial_only) for p in pivots]
            yield pd.DataFrame(rows, columns=["name", "pivot", "family", "slips", "initial_only"]).astype({"slips": "int32", "initial_only": bool})

    return names.mapInPandas(run, "name string, pivot string, family string, slips int, initial_only boolean")


def _shortened(word: str) -> set[str]:
    """The word without up to one letter, or two if it is long; words within as many slips share one."""
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
    if len(word) >= 8 - RADIUS:
        out |= {w[:i] + w[i + 1 :] for w in list(out) for i in range(len(w))}
    return out


def _meet(left: DataFrame, right: DataFrame, word: str, keys: list[str]) -> DataFrame:
    """Rows of both sides (which share no other column name) with equal ``keys`` and words that may be spellings of each other.

    ``right`` has its word in ``other``. A shortened word determines all words it may come from
    up to one or two letters, so no key is hot that isn't one word.
    """
    def explode(column: str, names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(*r, k) for r in batch[names].itertuples(index=False, name=None) for k in _shortened(r[names.index(column)])]
                yield pd.DataFrame(rows, columns=[*names, "_short"])

        return run

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[_spelling(a, b) for a, b in zip(batch[word], batch["other"])]]

    def opened(df: DataFrame, column: str) -> DataFrame:
        return df.mapInPandas(explode(column, df.columns), f"{df.schema.simpleString()[7:-1]},_short string")

    met = opened(left, word).join(opened(right, "other"), [*keys, "_short"]).drop("_short").distinct()
    return met.mapInPandas(near, met.schema)


def _spelling(a: str, b: str) -> bool:
    slips, _ = typing_cost(a, b)
    return slips <= 1 or (slips == 2 and len(a) >= 8)


def with_rare_pivots(read: DataFrame) -> DataFrame:
    """Readings, and those of names near a pivot that isn't a known given name.

    A given name within one slip of one that at least as many names have (twice as many for each
    beyond its first) is replicated to its pivot. An initial is replicated to the pivots with that
    initial whose names have a family name within the radius.
    """
    unknown = read.where(F.startswith("pivot", F.lit("?")))
    given = F.expr("substring(pivot, 2)")
    counts = cut_lineage(unknown.groupBy("pivot").agg(F.countDistinct("name").alias("n")).select(given.alias("given"), "n"))
    others = counts.select(F.col("given").alias("other"), F.col("n").alias("m"))
    near = _meet(counts, others, "given", []).where((F.col("given") != F.col("other")) & (F.col("m") >= 2 * (F.col("n") - 1)) & ((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("given")))))
    moved = unknown.withColumn("given", given).join(near.select("given", "other"), "given").select("name", F.concat(F.lit("?"), "other").alias("pivot"), "family", F.lit(1).alias("slips"), "initial_only")
    initials = read.where(F.col("initial_only") & F.startswith("pivot", F.lit("i:"))).select("name", F.expr("substring(pivot, 3)").alias("initial"), "family")
    rare = unknown.select("pivot", F.col("family").alias("other"), F.expr("substring(pivot, 2, 1)").alias("initial")).distinct()
    meant = _meet(initials, rare, "family", ["initial"]).select("name", "pivot", "family", F.lit(0).alias("slips"), F.lit(True).alias("initial_only"))
    return read.union(moved).union(meant)


def _chunks(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = CHUNK) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """The columns of whole runs of rows with equal keys, about ``rows`` rows together, and where each run begins.

    Runs may go on from batch to batch; one of more rows comes alone.
    """
    held: list[dict[str, np.ndarray]] = []
    size, least = 0, rows

    def begins(columns: dict[str, np.ndarray]) -> np.ndarray:
        change = np.zeros(len(columns[keys[0]]), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        return np.flatnonzero(change)

    for batch in batches:
        held.append({c: batch[c].to_numpy() for c in batch.columns})
        size += len(batch)
        if size < least:
            continue
        every = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        starts = begins(every)
        last = int(starts[-1])
        if last:
            yield {c: v[:last] for c, v in every.items()}, starts[:-1]
        held, size = [{c: v[last:] for c, v in every.items()}], size - last
        least = max(rows, 2 * size)  # a run that outgrows its batches isn't looked at batch by batch
    if size:
        every = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        yield every, begins(every)


def _deletions(codes: np.ndarray, salt: np.ndarray, deep: bool) -> Iterator[np.ndarray]:
    """Hashes of words of one length (a column each) without up to one letter, or up to two."""
    size = len(codes)
    back, power, begun = pow(_BASE, -1, 1 << 64), 1, [np.zeros(codes.shape[1], np.uint64)]
    for row in codes:
        z = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        begun.append(begun[-1] + (z ^ (z >> np.uint64(32))) * np.uint64(power))
        power = power * _BASE & (1 << 64) - 1
    one, two = np.uint64(back), np.uint64(back * back & (1 << 64) - 1)

    def mixed(h: np.ndarray, left: int) -> np.ndarray:
        h = (h ^ salt) + np.uint64(left)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(30))

    yield mixed(begun[size], size)
    for i in range(size):
        head = begun[i] - begun[i + 1] * one
        yield mixed(head + begun[size] * one, size - 1)
        if deep:
            for j in range(i + 1, size):
                yield mixed(head + begun[j] * one + (begun[size] - begun[j + 1]) * two, size - 2)


def _meeting(words: list[str], cell: np.ndarray, lens: np.ndarray, rows: np.ndarray, deep: bool, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``rows`` (later, earlier) of one cell whose words without up to one or two letters have a form in common, the later one ``wanted``.

    Words within as many slips have such a form in common, so none is missed; equal hashes of
    different forms only give needless pairs. Hashes are sorted in shares of ``FORMS``.
    """
    if not len(rows):
        return
    bits = np.uint64(max(1, int(rows.max()).bit_length()))
    salt = (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    groups = [rows[lens[rows] == size] for size in np.unique(lens[rows]).tolist()]
    coded = [(g, encode([words[i] for i in g.tolist()])[0]) for g in groups]
    forms = sum(len(g) * (1 + len(c) + (len(c) * (len(c) - 1) // 2 if deep else 0)) for g, c in coded)
    shares = -(-forms // FORMS)
    for share in range(shares):
        found = []
        for g, codes in coded:
            index = g.astype(np.uint64)
            for h in _deletions(codes, salt[g], deep):
                if shares == 1:
                    found.append((h << bits) | index)
                else:
                    mine = (h >> np.uint64(40)) % np.uint64(shares) == share
                    found.append((h[mine] << bits) | index[mine])
        every = np.concatenate(found)
        every.sort()
        every = every[np.append(True, every[1:] != every[:-1])]
        form, row = every >> bits, (every & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        same = form[1:] == form[:-1]
        place = np.arange(len(row))
        start = np.maximum.accumulate(np.where(np.append(True, ~same), place, 0))
        at = np.flatnonzero((place > start) & wanted[row])
        step = 1
        while len(at):  # with the row before, then the one before that, to the run's first
            yield row[at], row[at - step]
            step += 1
            at = at[at - step >= start[at]]


def _nearest(words: list[str], cell: np.ndarray, n: np.ndarray, lens: np.ndarray, rows: np.ndarray, wanted: np.ndarray, slips: int, best: dict[int, tuple]) -> None:
    """Put into ``best`` for each wanted row its original within ``slips`` slips, if it has one."""
    held, size = [], 0

    def settle() -> None:
        pairs = np.unique(np.concatenate(held))
        for at in range(0, len(pairs), PAIRS):
            i, j = pairs[at : at + PAIRS] // len(words), pairs[at : at + PAIRS] % len(words)
            edits, cost = typing_costs([words[k] for k in i.tolist()], [words[k] for k in j.tolist()])
            for k in np.flatnonzero(edits <= slips).tolist():
                x, y = int(i[k]), int(j[k])
                found = (int(edits[k]), -int(n[y]), int(cost[k]), words[y], y)
                if x not in best or found < best[x]:
                    best[x] = found

    for i, j in _meeting(words, cell, lens, rows, slips > 1, wanted):
        keep = (cell[i] == cell[j]) & (n[j] >= 2 * (n[i] - 1)) & (np.abs(lens[i] - lens[j]) <= slips)
        held.append(i[keep] * len(words) + j[keep])
        size += len(held[-1])
        if size > BLOCK:
            settle()
            held, size = [], 0
    if held:
        settle()


def _long_pairs(lens: np.ndarray, starts: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (later, earlier) of one cell of which the later is ``own`` and above ``LONG`` letters, the lengths within the radius."""
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(lens)]):
        long = lo + np.flatnonzero(lens[lo:hi] > LONG - RADIUS)
        for x in long[own[long] & (lens[long] > LONG)].tolist():
            y = long[(long < x) & (np.abs(lens[long] - lens[x]) <= RADIUS)]
            if len(y):
                yield np.full(len(y), x), y


def _parents(families: list[str], n: np.ndarray, own: np.ndarray, starts: np.ndarray) -> list[str]:
    """The original of each row's family name, or itself; rows that aren't ``own`` have themselves.

    Each cell begins at one of ``starts``; in it commoner names stand before rarer ones. A name
    within one slip of an original is settled before those that need two are looked for.
    """
    size = len(families)
    begin = np.zeros(size, np.int64)
    begin[starts[1:]] = 1
    cell = np.cumsum(begin)
    lens = np.array([len(f) for f in families], np.int64)
    parents, plain, open_ = list(families), {}, own.copy()
    for i, (f, c) in enumerate(zip(families, cell.tolist())):
        first = plain.setdefault((c, without_umlauts(f)), f)
        if own[i] and first != f:
            parents[i], open_[i] = first, False
    best: dict[int, tuple] = {}
    rows = np.flatnonzero(lens <= LONG)
    _nearest(families, cell, n, lens, rows, open_ & (lens <= LONG), 1, best)
    open_[list(best)] = False
    far = open_ & (lens >= 8) & (lens <= LONG)
    if far.any():
        _nearest(families, cell, n, lens, rows[lens[rows] >= 8 - RADIUS], far, RADIUS, best)
    for i, j in _long_pairs(lens, starts, open_) if int(lens.max(initial=0)) > LONG else ():
        x, j = int(i[0]), j[n[j] >= 2 * (n[i] - 1)]
        near = distances(families[x], *encode([families[y] for y in j.tolist()])) <= 2 * RADIUS
        for y in j[near].tolist():
            edits, cost = typing_cost(families[x], families[y])
            if edits <= RADIUS:
                best[x] = min(best.get(x, (9,)), (edits, -int(n[y]), round(10 * cost), families[y], y))
    for i, b in best.items():
        parents[i] = b[3]
    return parents


def family_roots(read: DataFrame) -> DataFrame:
    """(pivot, family, root): the commonest spelling within its pivot of each family name that isn't its own.

    A family name is a spelling of another, commoner one (by the number of names that have it)
    within one slip, or within two if it is long. Beyond its first name a spelling needs twice
    as many names of the other for each of its own, at any size.
    """
    counts = read.select("name", "family").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    entries = read.select("pivot", "family").distinct().join(counts, "family")
    size = F.length("family")
    reach = F.sequence(F.floor(F.greatest(size - RADIUS, F.lit(0)) / BAND), F.floor((size + RADIUS) / BAND))
    cells = cut_lineage(entries.withColumn("own", F.floor(size / BAND)).withColumn("band", F.explode(reach)))
    large = cells.groupBy("pivot", "band").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CELL)
    spread = cells.join(F.broadcast(large), ["pivot", "band"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("k") / CELL), F.lit(1).cast("bigint"))).drop("k")
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("family"), F.col("parts"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells, starts in _chunks(batches, ["pivot", "band", "part"]):
            mine = (cells["own"] == cells["band"]) & (cells["mine"] == cells["part"])
            parents = np.array(_parents(cells["family"].tolist(), cells["n"], mine, starts), object)
            mine &= parents != cells["family"]
            yield pd.DataFrame({"pivot": cells["pivot"][mine], "family": cells["family"][mine], "parent": parents[mine]})

    cell = ["pivot", "band", "part"]
    ordered = spread.select(*cell, "own", "mine", "family", "n").repartition(*cell).sortWithinPartitions(*cell, F.desc("n"), "family")
    joined = ordered.mapInPandas(join, "pivot string, family string, parent string")
    links = cut_lineage(joined)
    for _ in range(2):
        up = links.select("pivot", F.col("family").alias("parent"), F.col("parent").alias("up"))
        links = links.join(up, ["pivot", "parent"], "left").select("pivot", "family", F.coalesce("up", "parent").alias("parent"))
    return links.withColumnRenamed("parent", "root")


def name_clusters(names: DataFrame, givens: GivenNames | None = None) -> DataFrame:
    """(name, pivot, root): the persons' names each string may be a spelling of.

    ``names`` has a column ``name`` of distinct strings. A string with only an initial counts as
    a spelling of every full name in its family with that initial, so equal initials always go
    together; where there is none it goes with equal initials only.
    """
    givens = givens or GivenNames(learn_given_names(names))
    read = cut_lineage(with_rare_pivots(cut_lineage(read_names(names, givens))))
    member = cut_lineage(read.join(family_roots(read), ["pivot", "family"], "left").select("name", "pivot", F.coalesce("root", "family").alias("root"), "initial_only"))
    full = cut_lineage(_likeliest(member.where("not initial_only")))
    persons = full.select("pivot", "root").distinct()
    short = member.where("initial_only")
    meant = short.join(persons, ["pivot", "root"]).distinct()
    resolved = meant.select("name", "pivot", "root")
    alone = short.where(F.startswith("pivot", F.lit("i:"))).join(resolved.select("name").distinct(), "name", "left_anti").select("name", "pivot", "root").distinct()
    return full.union(resolved).union(alone)


def _likeliest(full: DataFrame) -> DataFrame:
    """Of a name that may mean several full names, the meanings some unequivocal name confirms.

    "Alex" may be two names; beside an "Alexander" of the family it is that one. Where no
    meaning is confirmed all stay.
    """
    meaning = F.struct("pivot", "root")
    told = cut_lineage(full.groupBy("name").agg(F.collect_set(meaning).alias("meanings")))
    one = told.where(F.size("meanings") == 1).select("name", F.inline("meanings"))
    sure = one.select("pivot", "root").distinct().withColumn("sure", F.lit(1))
    open_ = told.where(F.size("meanings") > 1).select("name", F.inline("meanings")).join(sure, ["pivot", "root"], "left")
    judged = open_.groupBy("name").agg(F.max("sure").alias("has"), F.collect_list(F.struct("pivot", "root", "sure")).alias("meanings"))
    kept = judged.select("name", "has", F.inline("meanings")).where("has is null or sure = 1")
    return one.union(kept.select("name", "pivot", "root"))


def linked_names(names: DataFrame) -> DataFrame:
    """Every pair (name_a, name_b), name_a < name_b, of strings that spell one person's name.

    Pairs arise only within one person's distinct spellings, never from repeated rows. Null,
    blank and stand-in values and single words are no spellings. An empty input gives no pairs.
    """
    clusters = cut_lineage(name_clusters(names))
    left = clusters.withColumnRenamed("name", "name_a")
    right = clusters.withColumnRenamed("name", "name_b")
    return left.join(right, ["pivot", "root"]).where("name_a < name_b").select("name_a", "name_b").distinct()
