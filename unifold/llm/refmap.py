"""Free-entered values to the closest entry of a reference list, or to none.

Reference entries and their aliases, in every rotation of their words ("Analyst, Data"), stand
in a BK-tree. A value is brought to a compact form (case, accents, punctuation and spaces don't
count), and the tree returns every entry within the value's radius; the triangle inequality
skips the rest. Among these the entry with the fewest slips wins.

The reference goes to the executors in shards of checked size in bytes, so a list of any length
works. With one shard the values are never shuffled. With more, the distinct values are matched
with each shard, the shards' winners are merged by the same order that decides within a shard,
and every row gets its value's winner, so the number of shards changes no result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unifold.llm.metric import BKTree, typing_cost
from unifold.runtime import cut_lineage

NO_MATCH = -1
SHARD_BYTES = 1_000_000  # characters of entries and aliases, each in all its rotations
CACHE_VALUES = 200_000
SALTS = 8
NONE = (9, 0, 0, 99, 99.0, NO_MATCH)

# Qualifiers that say nothing about which entry is meant.
_QUALIFIERS = re.compile(
    r"""(?ix)
    \s* [-–—/,@|:;]+ \s* (?:part[ -]?time|full[ -]?time|remote|hybrid|on[ -]?site|onsite|freelance|contract(?:or)?|client\ site|emea|apac|latam|amer|dach|global|worldwide|interim|m/f/d|f/m/d|m/w/d|w/m/d|all\ genders)\.? \s* $
    | \s* [-–—,:;/]* \s* \d+ \s* \+? \s* (?:years?|yrs?|jahre|months?|mos?)\.? (?:\s+(?:of\s+)?experience)? \s* $
    | \s+ (?:i{1,3}|iv|v) \s* $                                 # "Data Scientist II"
    | ^ \s* (?:the) \s+
    | ^ [\s•·*▪◦●‣⁃–—-]+ | [\s*.,;:!•·–—-]+ $
    """
)
# Usual short forms of words.
_SHORT = {
    "sr": "senior", "snr": "senior", "jr": "junior", "eng": "engineer", "engr": "engineer", "engnr": "engineer", "mgr": "manager",
    "mngr": "manager", "mgmt": "management", "dev": "developer", "devel": "developer", "admin": "administrator", "adm": "administrator",
    "anlst": "analyst", "anl": "analyst", "arch": "architect", "assoc": "associate", "asst": "assistant", "dir": "director",
    "sci": "scientist", "tech": "technical", "sw": "software", "softw": "software", "integr": "integration", "db": "database", "sys": "systems", "svc": "services", "svcs": "services",
    "srv": "services", "bus": "business", "prod": "product", "proj": "project", "prog": "program", "qual": "quality", "assur": "assurance",
    "res": "research", "sec": "security", "net": "network", "emb": "embedded", "reliab": "reliability", "ops": "operations", "rep": "republic",
    "utd": "united", "s": "south", "n": "north", "e": "east", "w": "west", "st": "saint", "natl": "national", "lang": "language",
    "proc": "processing", "vis": "vision", "viz": "visualization", "ml": "machine learning", "ux": "user experience", "qa": "quality assurance",
    "mach": "machine", "learn": "learning", "comp": "computer", "cont": "continuous", "integ": "integration", "nat": "natural", "plat": "platform",
    "pen": "penetration", "rec": "recruiter", "sol": "solutions", "soln": "solutions", "solns": "solutions",
}


_TAIL = 80  # longer than any match of _QUALIFIERS; white space is squeezed before


def _cut(text: str) -> str:
    """The text without one qualifier at either end, in time linear in its length."""
    if text.endswith(")") and (at := text.rfind("(")) >= 0 and ")" not in text[at:-1]:
        return text[:at].strip()
    if len(text) <= 2 * _TAIL:
        return _QUALIFIERS.sub("", text).strip()
    head = _QUALIFIERS.sub("", text[:_TAIL] + "\0").rstrip("\0")
    tail = _QUALIFIERS.sub("", "\0" + text[-_TAIL:]).lstrip("\0")
    return (head + text[_TAIL:-_TAIL] + tail).strip()


def compact(text: str) -> str:
    """Letters, digits, ``+`` and ``#`` in lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ß", "ss").replace("ł", "l"))
    return "".join(c for c in plain if c.isalnum() or c in "+#")


def tokens(text: str) -> list[str]:
    """Words in compact form; a text without any divider is divided at its capitals."""
    split = text if re.search(r"[\s_,/&-]", text.strip()) else re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    return [t for t in (compact(x) for x in re.split(r"[\s_,/&-]+", split)) if t]


def forms(value: str) -> list[str]:
    """Compact forms of a value, the plainest first: as typed, without qualifiers, spelled out."""
    text = " ".join(unicodedata.normalize("NFKC", value).split())
    out = [compact(text)]
    if len(text) > 1 and text[0] in "([{" and text[-1] in ")]}":
        text = text[1:-1].strip()
        out.append(compact(text))
    bare = text
    while (cut := _cut(bare)) != bare and cut:
        bare = cut
        if len(out) < 8:  # of a long row of qualifiers the first cuts and the barest form count
            out.append(compact(bare))
    text = bare
    out.append(compact(text))
    words = [_SHORT.get(t, t) for t in tokens(text)]
    out.append(compact("".join(words)))
    return [f for f in dict.fromkeys(out) if f]


def slips(length: int) -> int:
    """Slips allowed in a form of this many characters."""
    return 0 if length <= 3 else 1 if length <= 6 else 2 if length <= 13 else 3


def reference_entries(rows: list[tuple[int, str, list[str] | None]]) -> dict[str, list[tuple[int, int]]]:
    """Compact entry to its (rank, ref_id); rank 0 is a canonical form, 1 an alias, 2 a rotation."""
    out: dict[str, list[tuple[int, int]]] = {}
    for ref_id, canonical, aliases in rows:
        for rank, text in [(0, canonical), *((1, a) for a in aliases or [])]:
            if not text or not compact(text):
                continue
            out.setdefault(compact(text), []).append((rank, ref_id))
            words = tokens(text)
            for k in range(1, len(words)):
                out.setdefault("".join(words[k:] + words[:k]), []).append((2, ref_id))
    return out


class Matcher:
    """Closest entry of one kind's reference list; remembers the values it has seen."""

    def __init__(self, entries: dict[str, list[tuple[int, int]]]):
        self.entries, self.tree = entries, BKTree(list(entries))
        self.seen: dict[str, tuple] = {}

    def match(self, values: list[str]) -> list[tuple]:
        """The winner for each value, as a tuple whose order is that of preference.

        (0, place of the form, rank, 0, 0.0, ref_id) for an entry that is a form of the value,
        (1, 0, 0, edits, cost, ref_id) for one within the radius, NONE without any.
        """
        new = [v for v in dict.fromkeys(values) if v not in self.seen]
        if len(self.seen) + len(new) > CACHE_VALUES:
            self.seen.clear()
            new = list(dict.fromkeys(values))
        todo: list[tuple[str, str]] = []
        for v in new:
            fs = forms(v)
            exact = next(((i, f) for i, f in enumerate(fs) if f in self.entries), None)
            if exact is not None:
                rank, ref_id = min(self.entries[exact[1]])
                self.seen[v] = (0, exact[0], rank, 0, 0.0, ref_id)
            else:
                self.seen[v] = NONE
                todo.extend((v, f) for f in fs if slips(len(f)))
        radius = np.array([2 * slips(len(f)) for _, f in todo], np.int64)
        for (v, f), near in zip(todo, self.tree.within([f for _, f in todo], radius), strict=True):
            for entry in near:
                edits, cost = typing_cost(f, entry)
                if edits <= min(slips(len(f)), slips(len(entry))):
                    rank, ref_id = min(self.entries[entry])
                    self.seen[v] = min(self.seen[v], (1, 0, 0, edits, round(cost + rank * 0.01, 6), ref_id))
        return [self.seen[v] for v in values]


def map_values(values: DataFrame, reference: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``ref_id`` to rows with columns ``kind`` and ``value``; -1 where the list has no entry.

    ``reference`` has ref_id, ref_kind, canonical, aliases; other columns and rows with a null
    id or kind are ignored. Null and blank values get -1, as do all values of a kind without
    entries. A column named ref_id is replaced. Repeated rows stay. A value that is an entry in
    some form takes it, the plainest form first, then canonical forms before aliases; else the
    entry with fewest slips, then the likelier slips wins; ties go to the smaller ref_id.
    """
    spark = values.sparkSession
    values = values.drop("ref_id")
    reference = reference.where("ref_id is not null and ref_kind is not null").select("ref_id", "ref_kind", "canonical", "aliases")
    texts = F.filter(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    size = F.aggregate(texts, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x) * (1 + F.length(F.regexp_replace(x, r"[^\s_,/&-]", ""))))
    shards = max(1, -(-(reference.agg(F.sum(size)).first()[0] or 0) // shard_bytes))

    def shard(s: int):
        by_kind: dict[str, list] = {}
        for r in reference.where(F.pmod(F.xxhash64("ref_id"), F.lit(shards)) == s).collect():
            by_kind.setdefault(r.ref_kind, []).append((r.ref_id, r.canonical, r.aliases))
        return spark.sparkContext.broadcast({k: reference_entries(v) for k, v in by_kind.items()})

    if shards == 1:
        return values.mapInPandas(_match_batches(shard(0), ids_only=True), f"{values.schema.simpleString()[7:-1]},ref_id bigint")
    # Rows of a hot value are spread over salts, to each of which its winner goes.
    distinct = cut_lineage(values.select("kind", "value").where("kind is not null and value is not null").distinct())
    schema = "kind string, value string, level int, place int, rank int, edits int, cost double, ref_id bigint"
    best = None
    for s in range(shards):
        found = distinct.mapInPandas(_match_batches(shard(s)), schema)
        best = found if best is None else best.union(found)
    winner = best.groupBy("kind", "value").agg(F.min(F.struct("level", "place", "rank", "edits", "cost", "ref_id")).alias("b"))
    salted = winner.select("kind", "value", F.col("b.ref_id").alias("ref_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = values.withColumn("_salt", F.pmod(F.xxhash64(*values.columns), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["kind", "value", "_salt"], "left").select(*values.columns, F.coalesce("ref_id", F.lit(NO_MATCH).cast("bigint")).alias("ref_id"))


def _match_batches(shared, ids_only: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers: dict[str, Matcher] = {}
        for batch in batches:
            won = [NONE] * len(batch)
            for kind, at in batch.groupby("kind").indices.items():
                if kind not in shared.value:
                    continue
                if kind not in matchers:
                    matchers[kind] = Matcher(shared.value[kind])
                texts = batch["value"].to_numpy()[at]
                given = np.array([isinstance(t, str) and bool(t.strip()) for t in texts], bool)
                for i, w in zip(at[given].tolist(), matchers[kind].match(list(texts[given])), strict=True):
                    won[i] = w
            ref_id = np.array([w[5] for w in won], np.int64)
            if ids_only:
                yield batch.assign(ref_id=ref_id)
            else:
                told = pd.DataFrame([w[:5] for w in won], columns=["level", "place", "rank", "edits", "cost"], index=batch.index)
                yield pd.concat([batch[["kind", "value"]], told], axis=1).assign(ref_id=ref_id).astype({"level": "int32", "place": "int32", "rank": "int32", "edits": "int32", "cost": "float64"})

    return run
