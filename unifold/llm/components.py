"""Consolidating pairwise matches into groups: minimum labels, pointer jumping, edge contraction.

The pairs are never listed. Records that share a key hang from the smallest record of that key,
so a key with n records gives at most 2n edges instead of n(n-1)/2; a key is first split into
``salts`` sub-keys whose smallest records then hang from the key's smallest one, so a key held
by a third of all records is spread over as many tasks.

Each round every node takes the smallest label among itself and its neighbours, the labels are
shortened by pointer jumping, and the edges are rewritten to their labels; edges inside one
group vanish. The edge set shrinks geometrically and the round's labels are checkpointed. When
no edge is left no label can change, and the rounds' label maps are composed from the smallest
to the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unifold.runtime import cut_lineage

DEFAULT_SALTS = 32
MAX_ROUNDS = 60


def edges_from_keys(keyed: DataFrame, salts: int = DEFAULT_SALTS) -> DataFrame:
    """(id, key) rows to edges (a, b) with b < a that connect all ids of one key.

    Null ids or keys give no edge. Repeated rows are harmless.
    """
    pairs = cut_lineage(
        keyed.where(F.col("id").isNotNull() & F.col("key").isNotNull())
        .select("id", "key", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    )
    subs = cut_lineage(pairs.groupBy("key", "salt").agg(F.min("id").alias("sub")))
    tops = subs.groupBy("key").agg(F.min("sub").alias("top"), F.count(F.lit(1)).alias("n"))
    low = pairs.join(subs, ["key", "salt"]).select(F.col("id").alias("a"), F.col("sub").alias("b"))
    high = subs.join(tops.where("n > 1"), "key").select(F.col("sub").alias("a"), F.col("top").alias("b"))
    return low.union(high).where("a <> b").distinct()


def connected_components(ids: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Smallest id of each id's group, directly or through any chain of edges.

    ``ids`` has a column ``id`` (bigint; one row per id or more), ``edges`` the columns ``a``,
    ``b``. Returns (id, group_no) with one row per distinct non-null id; an id without edges is
    its own group. Edges with a null end and self-loops are ignored; an end that isn't in
    ``ids`` still connects its neighbours. Raises if ``max_rounds`` rounds don't suffice, which
    cannot happen under 2**max_rounds nodes in a chain.
    """
    live = cut_lineage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    maps: list[DataFrame] = []
    while not live.isEmpty():
        if len(maps) >= max_rounds:
            raise RuntimeError(f"labels still change after {max_rounds} rounds")
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
        label = _jump_to_roots(cut_lineage(label))
        maps.append(label)
        la = label.select(F.col("id").alias("a"), F.col("label").alias("la"))
        lb = label.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        live = cut_lineage(
            live.join(la, "a").join(lb, "b").where("la <> lb")
            .select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b"))
            .distinct()
        )
    nodes = ids.select("id").where("id is not null").distinct()
    if not maps:
        return nodes.select("id", F.col("id").alias("group_no"))
    total = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = total.select(F.col("id").alias("label"), F.col("label").alias("next"))
        total = earlier.join(later, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return nodes.join(total, "id", "left").select("id", F.coalesce("label", "id").alias("group_no"))


def _jump_to_roots(label: DataFrame) -> DataFrame:
    """Replace each label by its own label until none changes; every pass doubles the reach."""
    while True:
        up = label.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = label.join(up, "label", "left").select("id", F.col("label").alias("was"), F.coalesce("up", "label").alias("label"))
        new = cut_lineage(new)
        label = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            return label
