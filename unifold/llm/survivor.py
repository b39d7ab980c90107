"""Best representative of each duplicate group, field by field.

Bayesian fusion with copy detection: the accuracy of each source and the probability that one
source copies another are estimated in turns from how often sources agree on values that are
likely false; copied votes are discounted, and the value with the largest posterior survives.

A prior order over the records may be given. It is the limit of a prior so strong that no number
of votes outweighs it: of two values the one whose best record is higher in the order survives,
and the votes decide between equals. With the order trust weight, recency, record number this
gives the strict choice that the project's problem statement asks for.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unifold.functions.text import squeeze
from unifold.functions.trust import DEFAULT_TRUST, TRUST_WEIGHTS, trust_weight
from unifold.llm.standins import is_stand_in
from unifold.runtime import cut_lineage

FIELDS = ("full_name", "headline")
RANKED_METHOD = "source_trust_hierarchy"
OTHER_SOURCE = "other"


def _field_entries(field: str) -> Column:
    return F.filter(
        F.coalesce(F.col("provenance"), F.array().cast("array<struct<field:string,source:string,method:string>>")),
        lambda p: (p["field"] == field) & (p["method"] == RANKED_METHOD),
    )


def field_candidates(profiles: DataFrame, groups: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per record and field that has a value, within groups of two or more records.

    Columns: group_no, record_no, field_name, value, source, weight, updated_at. Null, blank and
    stand-in values aren't candidates. ``source`` is the record's most trusted one for the field.
    """
    sized = groups.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_no")
    members = groups.join(sized, "group_no")
    each = F.array(
        *(
            F.struct(
                F.lit(f).alias("field_name"),
                F.col(f).alias("value"),
                F.coalesce(F.array_max(F.transform(_field_entries(f), lambda p: F.struct(trust_weight(p["source"]).alias("weight"), F.coalesce(p["source"], F.lit(OTHER_SOURCE)).alias("source")))), F.struct(F.lit(DEFAULT_TRUST).alias("weight"), F.lit(OTHER_SOURCE).alias("source"))).alias("best"),
            )
            for f in fields
        )
    )
    rows = profiles.select("record_no", "updated_at", F.explode(each).alias("x")).select("record_no", "updated_at", "x.field_name", "x.value", "x.best.source", "x.best.weight")
    return members.join(rows.where(~is_stand_in(F.col("value"))), "record_no").select("group_no", "record_no", "field_name", "value", "source", "weight", "updated_at")


def stated_order() -> Column:
    """Highest weight, then latest (a null ``updated_at`` is older than any), then smallest number."""
    return F.struct("weight", F.col("updated_at").isNotNull().alias("dated"), "updated_at", (-F.col("record_no")).alias("first"))


def _source_map(values: dict[str, float], default: float) -> tuple[Column, Column]:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in values.items()))
    return table, F.lit(default)


def fused_survivors(candidates: DataFrame, prior: Column | None = None, rounds: int = 4, copy_rate: float = 0.8, copy_prior: float = 0.1, false_values: int = 20) -> DataFrame:
    """Bayesian fusion with copy detection: (group_no, field_name, value, record_no, posterior, support).

    A source has one vote per group and field, split over all its values by their numbers of
    records; values are compared in lower case with white space squeezed. Every source name is a
    source of its own, records without one count as one more source. Records are added up to one
    row per value, which lists its sources; what comes to the driver is one row per source or
    pair of sources that meet, and field. No task holds all values of a group.

    ``support`` is the number of claiming sources, ``posterior`` is what the votes alone give.
    Without ``prior`` ``record_no`` is the latest record with the surviving value, and ties in
    the posterior go to the latest value, then to the alphabetically first. With ``prior``, an
    orderable column of the candidates, the value of the record highest in it survives.
    ``copy_rate`` is the share of its values that a copier copies, ``copy_prior`` the prior
    probability that of two sources one copies, ``false_values`` the number of false values per
    object.
    """
    key = F.lower(squeeze(F.col("value")))
    newest = F.struct(F.col("updated_at").isNotNull().alias("dated"), "updated_at", (-F.col("record_no")).alias("first"))
    order = newest if prior is None else prior
    named = candidates.withColumn("v", key).withColumn("source", F.coalesce("source", F.lit(OTHER_SOURCE)))
    claims = named.groupBy("group_no", "field_name", "v", "source").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(order.alias("order"), "record_no", "value", "updated_at")).alias("top"))
    claims = cut_lineage(claims)
    each = claims.groupBy("group_no", "field_name", "v").agg(F.collect_list(F.struct("source", "n")).alias("by"), F.max("top").alias("top"))
    votes = claims.groupBy("group_no", "field_name", "source").agg(F.sum("n").alias("n"))
    objects = votes.groupBy("group_no", "field_name").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("cast"))
    share = F.transform("by", lambda x: F.struct(x["source"].alias("source"), (x["n"] / F.element_at("cast", x["source"])).alias("share")))
    values = cut_lineage(each.join(objects, ["group_no", "field_name"]).withColumn("by", share).withColumn("present", F.map_keys("cast")).drop("cast"))

    met = _meetings(values)
    accuracy = {(r.field_name, r.source): TRUST_WEIGHTS.get(r.source, DEFAULT_TRUST) for r in claims.select("field_name", "source").distinct().collect()}
    depends: dict[str, float] = {}
    for step in range(rounds - 1):
        scored = cut_lineage(_posteriors(values, accuracy, depends, copy_rate, false_values))
        if step:  # copies must be known before votes may say how accurate a source is
            by = scored.select("field_name", "posterior", F.explode("by").alias("b"))
            means = by.groupBy("field_name", "b.source").agg((F.sum(F.col("posterior") * F.col("b.share")) / F.sum("b.share")).alias("a")).collect()
            accuracy |= {(r.field_name, r.source): min(0.99, max(0.05, r.a)) for r in means}
        depends = _dependence(scored, met, accuracy, copy_rate, copy_prior, false_values)
    scored = _posteriors(values, accuracy, depends, copy_rate, false_values)
    likeliest = F.struct(F.round("posterior", 9).alias("p"), F.col("top.updated_at").isNotNull().alias("dated"), F.col("top.updated_at").alias("at"))
    rank = likeliest if prior is None else F.struct(F.col("top.order").alias("order"), F.round("posterior", 9).alias("p"))
    best = scored.groupBy("group_no", "field_name", rank.alias("rank")).agg(F.min(F.struct("v", "top", "posterior", F.size("by").alias("support"))).alias("b"))
    best = best.groupBy("group_no", "field_name").agg(F.max_by("b", "rank").alias("b"))
    return best.select("group_no", "field_name", "b.top.value", "b.top.record_no", F.round("b.posterior", 6).alias("posterior"), "b.support")


def _posteriors(values: DataFrame, accuracy: dict, depends: dict[str, float], copy_rate: float, false_values: int) -> DataFrame:
    """Values with their posterior: softmax over the discounted votes of an object."""
    table, default = _source_map({f"{f}|{s}": a for (f, s), a in accuracy.items()}, DEFAULT_TRUST)
    pairs, zero = _source_map(depends or {"": 0.0}, 0.0)

    def known(source: Column) -> Column:
        return F.coalesce(F.try_element_at(table, F.concat_ws("|", F.col("field_name"), source)), default)

    def copied(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_element_at(pairs, F.concat_ws("|", F.col("field_name"), F.least(x["source"], y["source"]), F.greatest(x["source"], y["source"]))), zero)

    def vote(x: Column) -> Column:
        better = F.filter("told", lambda y: (y["a"] > x["a"]) | ((y["a"] == x["a"]) & (y["source"] < x["source"])))
        keep = F.aggregate(better, F.lit(1.0), lambda acc, y: acc * (1 - copy_rate * copied(x, y)))
        return x["share"] * F.log(F.lit(float(false_values)) * x["a"] / (1 - x["a"])) * keep

    told = values.withColumn("told", F.transform("by", lambda x: F.struct(x["source"].alias("source"), x["share"].alias("share"), known(x["source"]).alias("a"))))
    weighed = told.withColumn("weight", F.exp(F.aggregate(F.transform("told", vote), F.lit(0.0), lambda acc, x: acc + x))).drop("told")
    whole = weighed.groupBy("group_no", "field_name").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("k"))
    unseen = F.greatest(F.lit(false_values + 1.0) - F.col("k"), F.lit(0.0))
    return weighed.join(whole, ["group_no", "field_name"]).withColumn("posterior", F.col("weight") / (F.col("total") + unseen)).drop("weight", "total", "k")


def _pairs(sources: Column) -> Column:
    """Ordered pairs of the elements of an array of structs with a source."""
    return F.flatten(F.transform(sources, lambda x: F.transform(F.filter(sources, lambda y: x["source"] < y["source"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _meetings(values: DataFrame) -> DataFrame:
    """(field_name, s1, s2, n): how many objects both sources have a value for."""
    present = values.groupBy("group_no", "field_name").agg(F.first("present").alias("p"))
    sources = F.transform("p", lambda s: F.struct(s.alias("source")))
    pairs = present.select("field_name", F.explode(_pairs(sources)).alias("p"))
    return cut_lineage(pairs.groupBy("field_name", F.col("p.x.source").alias("s1"), F.col("p.y.source").alias("s2")).agg(F.count(F.lit(1)).alias("n")))


def _dependence(scored: DataFrame, met: DataFrame, accuracy: dict, copy_rate: float, copy_prior: float, false_values: int) -> dict[str, float]:
    """Probability of copying for each pair of sources and field, from shared false values."""
    both = scored.where(F.size("by") > 1).select("field_name", "posterior", F.explode(_pairs(F.col("by"))).alias("p"))
    w = F.col("p.x.share") * F.col("p.y.share")
    agreed = both.groupBy("field_name", F.col("p.x.source").alias("s1"), F.col("p.y.source").alias("s2")).agg(F.sum(w * F.col("posterior")).alias("t"), F.sum(w * (1 - F.col("posterior"))).alias("f"))
    counts = met.join(agreed, ["field_name", "s1", "s2"], "left").select("field_name", "s1", "s2", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("f", F.lit(0.0)).alias("f"), "n")
    counts = counts.withColumn("d", F.greatest(F.col("n") - F.col("t") - F.col("f"), F.lit(0.0)))
    out = {}
    for r in counts.collect():
        a1, a2 = accuracy[r.field_name, r.s1], accuracy[r.field_name, r.s2]
        pt, pf = a1 * a2, (1 - a1) * (1 - a2) / false_values
        pd = max(1e-9, 1 - pt - pf)
        a = (a1 + a2) / 2
        ct, cf, cd = copy_rate * a + (1 - copy_rate) * pt, copy_rate * (1 - a) + (1 - copy_rate) * pf, (1 - copy_rate) * pd
        odds = math.log((1 - copy_prior) / copy_prior) + r.t * math.log(pt / ct) + r.f * math.log(pf / cf) + r.d * math.log(pd / cd)
        out[f"{r.field_name}|{r.s1}|{r.s2}"] = 1 / (1 + math.exp(min(700.0, max(-700.0, odds))))
    return out
