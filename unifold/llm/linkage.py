"""Matching entities across sources without a shared key, by soft logic.

Mentions of people come from several tables. Hard evidence first: two mentions whose names may
mean the same person and that share an e-mail address, phone, handle or firm are tied. Ties run
over composite keys (identifier and name), so an identifier that many people share ties nobody
by itself and a hot one is spread over its names. Ties are closed to components, within each name
by its task, then over the mentions that may have several names.

What remains is soft: components of one name that share no identifier. Each pair of them is a
variable in [0, 1], 1 meaning "the same person". Weighted rules become hinge losses:

* the same name speaks for, the same town speaks for;
* different firms, different towns, different handles or phones speak against;
* exclusivity: a component cannot be two people that exclude each other;
* transitivity: if a = b and b = c then a = c.

Their sum is convex; it is minimised by consensus ADMM, in which every potential solves its own
small problem in closed form and the copies are averaged, for all names of a batch at once. The
variables' values are the confidences. A name's variables are independent of other names', so
partitions work in parallel. Components of one name with the same evidence are interchangeable,
and so are towns with the same components: the minimum has equal values for all pairs of a kind,
so one variable stands for them and a potential counts as often as it occurs. That is the same
minimum, whatever the number of components.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement, permutations
from math import comb, perm

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unifold.functions.identifiers import array_of, email_key, handle_key, phone_keys
from unifold.functions.text import squeeze
from unifold.llm.components import connected_components, edges_from_keys
from unifold.llm.namelinks import distinct_names, name_clusters
from unifold.runtime import cut_lineage

MATCH = 0.5
TIE = 1e-3
SLACK = 1e-4
ROUNDS = 200_000
TOLERANCE = 1e-6
RHO = 1.0
TOGETHER = 100_000  # rows of whole names that are tied together

# Weights of the rules.
W_NAME, W_TOWN = 1.0, 1.2
W_OTHER_FIRM, W_OTHER_TOWN, W_OTHER_HANDLE, W_OTHER_PHONE = 1.7, 1.3, 0.25, 0.1
W_EXCLUSIVE, W_TRANSITIVE = 1.0, 1.5

# Words of firms' names that don't tell firms apart.
_FIRM_WORDS = r"\b(ltd|limited|gmbh|inc|incorporated|llc|llp|corp|corporation|co|company|ag|kg|ohg|se|plc|sa|sas|sarl|bv|nv|ab|oy|as|pty|group|holding|holdings|labs?|systems?|software|works|consulting|analytics|solutions|services|technologies|technology|partners|international|the)\b"


def firm_key(c: Column) -> Column:
    """A firm's telling words in lower case, without legal forms and general words."""
    plain = _plain_firm(c)
    return _telling(plain, _firm_core(plain))


def firm_keys(arr: Column) -> Column:
    """``firm_key`` of each element; inside a lambda nothing is shared, so each step is an array of its own."""
    told = F.transform(F.transform(arr, _plain_firm), lambda p: F.struct(p.alias("plain"), _firm_core(p).alias("core")))
    return F.transform(told, lambda x: _telling(x["plain"], x["core"]))


def _plain_firm(c: Column) -> Column:
    return F.regexp_replace(F.lower(squeeze(c)), r"[^\p{L}\p{N}]+", " ")


def _firm_core(plain: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain, _FIRM_WORDS, " "), r"\s+", "")


def _telling(plain: Column, core: Column) -> Column:
    return F.when(core != "", core).otherwise(F.when(F.trim(plain) != "", F.regexp_replace(plain, " ", "")))


def mentions(sheet: DataFrame, hosts: DataFrame, profiles: DataFrame) -> DataFrame:
    """All mentions in one form: (mid, src_table, src_id, name, keys, firms, towns).

    ``mid`` is unique over the tables. Null structs and arrays count as empty. Rows with a null
    id are left out.
    """
    def form(df: DataFrame, table: str, code: int, key: Column, name: Column, emails: Column, phones: Column, handles: Column, firms: Column, town: Column) -> DataFrame:
        def keyed(kind: str, arr: Column, fn) -> Column:
            return F.transform(F.filter(F.transform(array_of(arr), fn), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(kind), x))

        phone = F.filter(phone_keys(array_of(phones)), lambda x: x.isNotNull())
        keys = F.array_distinct(F.concat(
            keyed("e:", emails, email_key),
            F.flatten(F.transform(phone, lambda x: F.array(F.concat(F.lit("p:"), x), F.concat(F.lit("s:"), F.substring(F.regexp_replace(x, r"\D", ""), -7, 7))))),
            keyed("h:", handles, handle_key),
        ))
        return df.where(key.isNotNull()).select(
            (key * 4 + code).alias("mid"), F.lit(table).alias("src_table"), key.alias("src_id"), squeeze(name).alias("name"), keys.alias("keys"),
            F.array_distinct(F.filter(firm_keys(array_of(firms)), lambda x: x.isNotNull())).alias("firms"),
            F.array_distinct(F.filter(F.array(F.lower(squeeze(town))), lambda x: x.isNotNull() & (x != ""))).alias("towns"),
        )

    none = F.array().cast("array<string>")
    bio = F.col("user_profile.bio")
    employer = F.when(F.contains(bio, F.lit(" @ ")), F.substring_index(bio, " @ ", -1))
    return (
        form(sheet, "sample_csv", 1, F.col("csv_row_id"), F.col("name"), F.array("email"), F.array("phone"), none, F.array("current_company"), F.lit(None).cast("string"))
        .unionByName(form(hosts, "github_mock", 2, F.col("profile_id"), F.col("user_profile.name"), F.array("user_profile.email"), none, F.array("user_profile.login"), F.array(employer), F.substring_index(F.col("user_profile.location"), ",", 1)))
        .unionByName(form(profiles, "output_default", 0, F.col("record_no"), F.col("full_name"), F.col("emails"), F.col("phones"), F.array("links.github"), F.transform(F.col("experience"), lambda x: x["company"]), F.col("location.city")))
    )


def _roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest node of each node's component under the edges (a, b)."""
    root = np.arange(size)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # every root hangs from its smallest neighbour
        while len(up := root[root]) and (up != root).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _tied(rows: pa.Table) -> pa.Table:
    """Rows of whole names, sorted by name and mention, with ``label``, the smallest mention tied to each within its name, and ``many``, whether its name has several."""
    mid = rows["mid"].to_numpy()
    who = rows["who"].combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.arange(len(mid))
    node = np.maximum.accumulate(np.where(np.append(True, (mid[1:] != mid[:-1]) | (who[1:] != who[:-1])), place, 0))
    keys = rows["keys"].combine_chunks()
    owner = np.repeat(place, np.diff(keys.offsets.to_numpy()))
    with np.errstate(over="ignore"):
        told = keys.flatten().to_numpy().astype(np.uint64) + who[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, item = np.unique(told, return_inverse=True)
    root = _roots(node[owner], len(mid) + item, len(mid) + int(item.max(initial=-1)) + 1)[node]
    several = np.zeros(int(who.max(initial=-1)) + 1, bool)
    first = np.full(len(several), len(mid))
    np.minimum.at(first, who, root)
    several[who[root != first[who]]] = True
    return rows.drop_columns(["keys"]).append_column("label", pa.array(mid[root])).append_column("many", pa.array(several[who]))


def _by_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_tied`` over rows sorted by name, some whole names at a time."""
    held: list[pa.RecordBatch] = []
    size, least = 0, TOGETHER
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        rows = pa.Table.from_batches(held)
        begins = pc.index(rows["who"], rows["who"][-1]).as_py()
        if begins:
            yield from _tied(rows.slice(0, begins)).to_batches()
        held, size = rows.slice(begins).to_batches(), size - begins
        least = max(TOGETHER, 2 * size)
    if size:
        yield from _tied(pa.Table.from_batches(held)).to_batches()


def tie_mentions(people: DataFrame, meant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions tied by an identifier or firm and a common meaning of their names.

    ``meant`` has (mid, who). A mention without a readable name is tied by an address, a handle
    or a phone together with a firm, if all named mentions that hold it may mean one person or
    none holds it.

    A tie holds within one name, so each name's ties are closed by its task, and only mentions
    with several names connect what the tasks found. Returns (mid, comp) for all that may be
    tied, and the named mentions of names with several components: (who, comp, towns, firms,
    phones, handles). Identifiers are told apart by 64-bit hashes within a name.
    """
    both = F.flatten(F.transform(F.filter("keys", lambda k: F.startswith(k, F.lit("p:"))), lambda p: F.transform("firms", lambda f: F.concat_ws("|", F.lit("x"), p, f))))
    proof = F.concat(F.filter("keys", lambda k: F.substring(k, 1, 2).isin("e:", "h:")), "both")
    every = F.concat("keys", F.transform("firms", lambda f: F.concat(F.lit("f:"), f)), "both")

    def held(kind: str) -> Column:
        return F.exists("keys", lambda k: F.startswith(k, F.lit(kind))).cast("int")

    facts = people.withColumn("both", both).select(
        "mid", proof.alias("proof"), F.transform(every, lambda k: F.xxhash64(k)).alias("keys"), "towns",
        (F.size("firms") > 0).cast("int").alias("firms"), held("p:").alias("phones"), held("h:").alias("handles"),
    )
    told = cut_lineage(facts.join(meant, "mid", "left").withColumn("multi", F.count(F.lit(1)).over(Window.partitionBy("mid")) > 1))
    strong = told.where("who is null").select("mid", F.explode("proof").alias("key")).distinct()
    owners = told.where("who is not null").select(F.explode("proof").alias("key"), "who").join(strong.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("who").alias("who"), F.max("who").alias("other"))
    nameless = cut_lineage(strong.join(owners, "key", "left").where("who is null or who = other").select("mid", "key", "who"))
    columns = ["who", "mid", "keys", "towns", "firms", "phones", "handles", "multi"]
    named = told.where("who is not null").select(*columns, F.lit(True).alias("named"))
    owned = nameless.where("who is not null").select("who", "mid", F.array(F.xxhash64("key")).alias("keys"), F.array().cast("array<string>").alias("towns"), *(F.lit(0).alias(c) for c in columns[4:7]), F.lit(True).alias("multi"), F.lit(False).alias("named"))
    lone = nameless.where("who is null").select(F.col("mid").alias("id"), "key")
    rows = named.union(owned).repartition("who").sortWithinPartitions("who", "mid")
    tied = cut_lineage(rows.mapInArrow(_by_names, "who string, mid bigint, towns array<string>, firms int, phones int, handles int, multi boolean, named boolean, label bigint, many boolean"))
    shared = tied.where("multi")
    ends = shared.select(F.col("mid").alias("id")).union(shared.select("label")).union(lone.select("id"))
    top = cut_lineage(connected_components(ends, edges_from_keys(lone).union(shared.select("mid", "label"))))
    above = top.select(F.col("id").alias("label"), "group_no")
    comp = F.coalesce("group_no", "label").alias("comp")
    single = tied.where("not multi").select("mid", "label").join(above, "label", "left").select("mid", comp)
    several = shared.select("mid").union(lone.select("id")).distinct().join(top.withColumnRenamed("id", "mid"), "mid").select("mid", F.col("group_no").alias("comp"))
    found = tied.where("many and named").join(above, "label", "left").select("who", comp, "towns", "firms", "phones", "handles")
    return single.union(several), found


def component_nodes(found: DataFrame) -> DataFrame:
    """(who, comp, towns, firms, phones, handles): the components of each name with their evidence."""
    return found.groupBy("who", "comp").agg(
        *(F.max(c).alias(c) for c in ("firms", "phones", "handles")), F.array_distinct(F.flatten(F.collect_set("towns"))).alias("towns")
    ).select("who", "comp", "towns", "firms", "phones", "handles")


def soft_matches(nodes: DataFrame) -> DataFrame:
    """(comp, person, confidence): components of one name that soft logic joins, and whom to.

    ``person`` is the smallest of the joined components. A component of several names goes with
    the name it is most confident of, so it never makes two names' people one. A name comes to
    its task as kinds of evidence with counts, not as components.
    """
    kind = ["who", "towns", "firms", "phones", "handles"]
    told = nodes.select("who", "comp", F.array_sort("towns").alias("towns"), *((F.col(c) > 0).cast("int").alias(c) for c in kind[2:]))
    size = nodes.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("who")
    kinds = told.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("comp")).join(size, "who")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _solve(batch["who"].tolist(), batch["kinds"].tolist())

    grouped = kinds.groupBy("who").agg(F.array_sort(F.collect_list(F.struct("comp", "n", *kind[1:]))).alias("kinds"))
    solved = grouped.mapInPandas(solve, "who string, towns array<string>, firms int, phones int, handles int, person bigint, confidence double")
    joined = told.join(solved, kind)
    best = F.max_by(F.struct("person", "confidence"), F.struct("confidence", -F.col("person")))
    return joined.groupBy("comp").agg(best.alias("b")).select("comp", "b.person", "b.confidence")


class Network:
    """Variables and potentials of one name over kinds of components.

    A kind is a dict of towns, firms, phones, handles, its number ``n`` of components and the
    smallest of them. Of towns that hold equal kinds, three stand for all (``alike``): no
    potential has more than three components. ``pairs`` are the variables as pairs of kinds,
    ``pots`` the potentials (variables, coefficients, constant, weight), ``counts`` how often
    each occurs; ``rivals`` are (variable, variable, variable of the excluding pair).
    """

    def __init__(self, kinds: list, alike: bool = True):
        self.kinds = kinds
        self.towns = [frozenset(x["towns"]) for x in kinds]
        self.size = sum(x.get("n", 1) for x in kinds)
        self.group: dict[int, tuple] = {}  # kind -> (its towns' profile, label of its town, kind within the town)
        self.labels: dict[tuple, list[dict]] = {}  # profile -> by town: kind within the town -> kind
        if alike:
            self._group_towns()
        slots = [i for i in range(len(kinds)) if i not in self.group or self.group[i][1] < 3]
        self.pairs: list[tuple[int, int]] = []
        self.at: dict[tuple, int] = {}
        self.pots: list[tuple] = []
        self.counts: list[int] = []
        self.rivals: list[tuple[int, int, int]] = []
        self.slots, self.excluded, self.triples = slots, [], set()
        for p in combinations_with_replacement(slots, 2):
            if self._canonical(p) == p and (count := self._count(p)):
                self.at[p] = len(self.pairs)
                self.excluded.append(self._pair(self.at[p], *p, count))
                self.pairs.append(p)

    def add(self, triples: Iterator[tuple[int, int, int]]) -> bool:
        """Add the potentials of triples of kinds; whether any is new."""
        before = len(self.triples)
        for t in triples:
            if (t := self._canonical(t)) in self.triples or not (count := self._count(t)):
                continue
            self.triples.add(t)
            i, j, k = t
            a, b, c = (self.at[self._canonical(p)] for p in ((i, j), (j, k), (i, k)))
            for one, two, third in ((a, b, c), (a, c, b), (b, c, a)):
                self._add(((one, two, third), (1.0, 1.0, -1.0), -1.0, W_TRANSITIVE), count)
                if self.excluded[third]:
                    self._add(((one, two), (1.0, 1.0), -1.0, W_EXCLUSIVE), count)
                    self.rivals.append((one, two, third))
        return len(self.triples) > before

    def broken(self, y: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The triples of kinds that cost anything at ``y``; without the others the minimum is the same."""
        if len(self.slots) == 1 and self.size < 3:
            return
        where = np.array([[self.at.get(self._canonical((i, j)), -1) for j in self.slots] for i in self.slots])
        value = np.where(where < 0, -9.0, y[where])
        bound = np.where(where < 0, 9.0, np.where(np.array(self.excluded)[where], 0.0, value))
        for j, row in enumerate(value):
            for i, k in zip(*np.nonzero(np.triu(row[:, None] + row[None, :] - 1 - bound > SLACK))):
                yield self.slots[i], self.slots[j], self.slots[k]

    def _group_towns(self) -> None:
        inner: dict[str, dict] = {}
        mixed = {t for ts in self.towns if len(ts) > 1 for t in ts}
        for i, (x, ts) in enumerate(zip(self.kinds, self.towns)):
            if len(ts) == 1 and not ts & mixed:
                inner.setdefault(next(iter(ts)), {})[bool(x["firms"]), bool(x["phones"]), bool(x["handles"]), x.get("n", 1)] = i
        for by in inner.values():
            self.labels.setdefault(tuple(sorted(by)), []).append(by)
        self.labels = {p: towns for p, towns in self.labels.items() if len(towns) > 3}
        for p, towns in self.labels.items():
            for label, by in enumerate(towns):
                for k, i in by.items():
                    self.group[i] = (p, label, k)

    def _alike(self, t: tuple[int, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
        """By profile in ``t``: its (label, kind within the town)."""
        held: dict[tuple, list] = {}
        for i in t:
            if i in self.group:
                p, label, k = self.group[i]
                held.setdefault(p, []).append((label, k))
        return iter(held.items())

    def _canonical(self, t: tuple[int, ...]) -> tuple[int, ...]:
        """The first of the equivalent tuples of kinds."""
        out = [i for i in t if i not in self.group]
        for p, held in self._alike(t):
            out += min(sorted(self.labels[p][order[label]][k] for label, k in held) for order in permutations(range(3)))
        return tuple(sorted(out))

    def _count(self, t: tuple[int, ...]) -> int:
        """How many sets of components a tuple of kinds stands for."""
        count = 1
        for i, times in Counter(t).items():
            count *= comb(self.kinds[i].get("n", 1), times)
        for p, held in self._alike(t):
            used = sorted({label for label, _ in held})
            same = sum(sorted((dict(zip(used, order))[label], k) for label, k in held) == sorted(held) for order in permutations(used))
            count = count * perm(len(self.labels[p]), len(used)) // same
        return count

    def _add(self, pot: tuple, count: int) -> None:
        self.pots.append(pot)
        self.counts.append(count)

    def _pair(self, v: int, i: int, j: int, count: int) -> bool:
        """Add a pair's own potentials; whether its components exclude each other."""
        x, y, tx, ty = self.kinds[i], self.kinds[j], self.towns[i], self.towns[j]
        self._add(((v,), (-1.0,), 1.0, W_NAME), count)
        against = bool(tx and ty and not tx & ty)
        if tx and ty:
            self._add(((v,), (1.0,), 0.0, W_OTHER_TOWN) if against else ((v,), (-1.0,), 1.0, W_TOWN), count)
        for what, w in (("firms", W_OTHER_FIRM), ("handles", W_OTHER_HANDLE), ("phones", W_OTHER_PHONE)):
            if x[what] and y[what]:
                self._add(((v,), (1.0,), 0.0, w), count)
        return against or bool(x["firms"] and y["firms"])

    def joined(self, y: list[float]) -> list[tuple[dict, int, float]]:
        """(kind, smallest component, confidence) of each kind whose components are joined.

        A component that fits two excluding ones equally is joined to neither, else to the better.
        The surest joins come first, and none is made that would unite components that exclude
        each other.
        """
        drop = set()
        for one, two, apart in self.rivals:
            if y[apart] <= MATCH < min(y[one], y[two]):
                drop |= {a for a, b in ((one, two), (two, one)) if y[b] >= y[a] - TIE}
        root, sure = list(range(len(self.kinds))), {}
        held = {i: [i] for i in root}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def every(i: int) -> list[int]:
            return [by[self.group[i][2]] for by in self.labels[self.group[i][0]]] if i in self.group else [i]

        def apart(i: int, j: int) -> bool:
            v = self.at.get(self._canonical((i, j)))
            return v is not None and self.excluded[v] and y[v] <= MATCH

        for v, (i, j) in sorted(enumerate(self.pairs), key=lambda p: (-round(y[p[0]], 4), p[0])):
            if y[v] <= MATCH or v in drop:
                continue
            same_town = i in self.group and j in self.group and self.group[i][:2] == self.group[j][:2]
            for together in zip(every(i), every(j)) if same_town else [every(i) + every(j)]:
                for m in together:
                    a, b = find(together[0]), find(m)
                    if a != b and any(apart(p, q) for p in held[a] for q in held[b]):
                        continue  # a chain of joins never brings together what excludes each other
                    if a != b:
                        root[b] = a
                        held[a] += held.pop(b)
                    sure[m] = max(sure.get(m, 0.0), y[v])
                    sure[together[0]] = max(sure.get(together[0], 0.0), y[v])
        least: dict[int, int] = {}
        for m in sure:
            least[find(m)] = min(least.get(find(m), self.kinds[m]["comp"]), self.kinds[m]["comp"])
        return [(self.kinds[m], least[find(m)], c) for m, c in sure.items()]


def ground(nodes: list) -> tuple[list[tuple], list[tuple[tuple[int, ...], tuple[float, ...], float, float]]]:
    """Variables (pairs of components) of one name, and its potentials, each component by itself.

    A potential (variables, coefficients, constant, weight) costs weight * max(0, sum + constant)²;
    squared hinges let rules that disagree meet between 0 and 1.
    """
    order = sorted(nodes, key=lambda x: x["comp"])
    net = Network([{**{c: x[c] for c in ("comp", "towns", "firms", "phones", "handles")}, "n": 1} for x in order], alike=False)
    net.add(combinations(range(len(order)), 3))
    return [(order[j]["comp"], order[i]["comp"]) for i, j in net.pairs], net.pots


def admm(n_vars: int, pots: list[tuple[tuple[int, ...], tuple[float, ...], float, float]], rounds: int = ROUNDS, rho: float = RHO, counts: list[float] | None = None, ease: list[float] | None = None, begins: list[int] | None = None) -> np.ndarray:
    """Minimise the potentials' sum over [0, 1]^n by consensus ADMM, all potentials at once.

    ``counts`` says how often each potential occurs, ``ease`` scales its penalty ``rho``, which
    changes the way to the minimum only. ``begins`` are the first variables of networks that
    share no potential: each of them ends by itself, as soon as its own variables rest, so its
    values don't depend on what it is solved together with. Raises if one doesn't rest within
    ``rounds``.
    """
    if not n_vars:
        return np.zeros(0)
    width = max((len(v) for v, *_ in pots), default=1)
    var = np.full((len(pots), width), n_vars)  # column n_vars is a dummy
    coef = np.zeros((len(pots), width))
    for r, (v, c, _, _) in enumerate(pots):
        var[r, : len(v)] = v
        coef[r, : len(c)] = c
    const, weight = np.array([p[2] for p in pots]), np.array([p[3] for p in pots])
    rho = np.full(len(pots), rho) * (1.0 if ease is None else np.asarray(ease, float))
    share = rho * (1.0 if counts is None else np.asarray(counts, float))
    net = np.zeros(n_vars, np.int64)
    net[[b for b in begins or [] if 0 < b < n_vars]] = 1
    net = np.cumsum(net)
    owner = net[var[:, 0]] if len(pots) else np.zeros(0, np.int64)
    result, x, dual = np.full(n_vars, 0.5), np.full(n_vars, 0.5), np.zeros_like(coef)
    live = np.arange(n_vars)  # the variables that still move
    number = net[live]
    for done in range(rounds):
        if not done % 50:  # what rests needs no more work
            keep = np.isin(owner, number)
            var, coef, const, weight, rho, share, dual, owner = (z[keep] for z in (var, coef, const, weight, rho, share, dual, owner))
            at = np.full(n_vars + 1, len(live))
            at[live] = np.arange(len(live))
            local_var, x_live = at[var], np.append(x[live], 0.0)
            step_scale = 2 * weight / (rho + 2 * weight * (coef**2).sum(axis=1))
            shares = np.repeat(share, width)
            copies = np.bincount(local_var.ravel(), shares, minlength=len(live) + 1)
            copies[copies == 0] = 1
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            rests = np.zeros(len(starts), bool)
        v = x_live[local_var] - dual
        value = (coef * v).sum(axis=1) + const
        local = v - (step_scale * np.maximum(value, 0))[:, None] * coef  # closed form of a squared hinge
        total = np.bincount(local_var.ravel(), shares * (local + dual).ravel(), minlength=len(live) + 1)
        new = np.clip(total / copies, 0.0, 1.0)
        dual += local - new[local_var]
        calm = (np.maximum.reduceat(np.abs(new - x_live)[:-1], starts) < TOLERANCE) & ~rests
        x_live = new
        if calm.any():
            rests |= calm
            own = np.isin(number, number[starts[calm]])
            result[live[own]] = new[:-1][own]
            if rests.all():
                return result
        if done % 50 == 49:
            x[live] = x_live[:-1]
            live = live[~np.isin(number, number[starts[rests]])]
            number = net[live]
    raise RuntimeError(f"the confidences still change after {rounds} rounds")


def _solve(names: list[str], groups: list) -> pd.DataFrame:
    """Solve the names of a batch together; join what is likelier one person than not."""
    nets = [Network(list(g)) for g in groups]
    values: list = [None] * len(nets)
    work = list(range(len(nets)))
    while work:
        pots, counts, ease, ends = [], [], [], [0]
        for net in (nets[w] for w in work):
            pots += [(tuple(ends[-1] + v for v in p[0]), *p[1:]) for p in net.pots]
            counts += [float(c) for c in net.counts]
            ease += [1.0 if len(p[0]) == 1 else 1 / max(1, net.size - 2) for p in net.pots]  # a pair is in size - 2 triples
            ends.append(ends[-1] + len(net.pairs))
        y = admm(ends[-1], pots, counts=counts, ease=ease, begins=ends)
        for w, lo, hi in zip(work, ends, ends[1:]):
            values[w] = y[lo:hi]
        work = [w for w in work if nets[w].add(nets[w].broken(values[w]))]
    rows = [
        (who, list(x["towns"]), x["firms"], x["phones"], x["handles"], person, sure)
        for who, net, y in zip(names, nets, values) for x, person, sure in net.joined(y.tolist())
    ]
    return pd.DataFrame(rows, columns=["who", "towns", "firms", "phones", "handles", "person", "confidence"]).astype({"firms": "int32", "phones": "int32", "handles": "int32", "person": "int64", "confidence": "float64"})


def link_people(sheet: DataFrame, hosts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(src_table, src_id, record_no, confidence) for each pair of rows of one person.

    Pairs within a tied component have confidence 1; others the lesser of the confidences with
    which their components were joined. Rows that no evidence ties to a record give no pair;
    empty tables give none. Repeated rows pair with every record of the person.
    """
    people = cut_lineage(mentions(sheet, hosts, profiles))
    names = cut_lineage(distinct_names([people.select("name")]))
    meant = people.select("mid", "name").join(name_clusters(names), "name").select("mid", F.concat_ws("|", "pivot", "root").alias("who"))
    meant = cut_lineage(meant)
    comps, found = tie_mentions(people, meant)
    soft = soft_matches(cut_lineage(component_nodes(found)))
    placed = cut_lineage(comps.join(soft, "comp", "left").select("mid", "comp", F.coalesce("person", "comp").alias("person"), F.coalesce("confidence", F.lit(1.0)).alias("sure")))
    table = F.pmod("mid", F.lit(4))
    src_id = F.shiftright("mid", 2)
    left = placed.where(table != 0).select(F.when(table == 1, "sample_csv").otherwise("github_mock").alias("src_table"), src_id.alias("src_id"), "person", F.col("sure").alias("sa"), F.col("comp").alias("ca"))
    right = placed.where(table == 0).select(src_id.alias("record_no"), "person", F.col("sure").alias("sb"), F.col("comp").alias("cb"))
    confidence = F.when(F.col("ca") == F.col("cb"), F.lit(1.0)).otherwise(F.round(F.least("sa", "sb"), 4))
    return left.join(right, "person").select("src_table", "src_id", "record_no", confidence.alias("confidence"))  # each mention is placed once
