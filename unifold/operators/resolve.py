"""Entity resolution: records that share an e-mail, a phone or a handle, directly or in a chain.

Records are never compared in pairs. Each identifier hangs its records from the smallest of
them; each round every record takes the smallest label it is tied to, labels follow their own
labels to the end, and the ties are rewritten to labels, where most of them vanish. A hot
identifier costs one pre-aggregated row a task, and its records lose their ties to it in the
first round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unifold.functions.normalize import github_handle, normalize_phone
from unifold.functions.text import strip
from unifold.runtime import cut_lineage

MAX_ROUNDS = 100


def email_keys(emails: Column) -> Column:
    """E-mail keys: stripped, lower case, without empty ones."""
    given = F.filter(F.coalesce(emails, F.array().cast("array<string>")), lambda e: e.isNotNull())
    return F.filter(F.transform(given, lambda e: F.lower(strip(e))), lambda e: e != "")


def phone_keys(phones: Column) -> Column:
    """E.164 numbers, without what is no number."""
    given = F.coalesce(phones, F.array().cast("array<string>"))
    return F.filter(F.transform(given, normalize_phone), lambda p: p.isNotNull())


def identifiers(records: DataFrame, handle=github_handle) -> DataFrame:
    """(ingest_idx, kind, key) of every identifier; kinds never mix, names aren't used."""
    def each(kind: str, keys: Column) -> Column:
        return F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    handles = F.filter(F.array(handle(F.col("links.github"))), lambda h: h.isNotNull())
    every = F.concat(each("email", email_keys(F.col("emails"))), each("phone", phone_keys(F.col("phones"))), each("github", handles))
    return records.select("ingest_idx", F.explode(every).alias("x")).select("ingest_idx", "x.kind", "x.key")


def resolve_entities(records: DataFrame, handle=github_handle, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Add ``component_id``, the smallest ``ingest_idx`` of the record's group.

    A record without identifiers is its own group. Raises if ties are left after ``max_rounds``
    rounds; the number of groups at least halves in each.
    """
    hubs = cut_lineage(identifiers(records, handle))
    lowest = hubs.groupBy("kind", "key").agg(F.min("ingest_idx").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = cut_lineage(hubs.join(lowest, ["kind", "key"]).where("ingest_idx <> low").select(F.col("ingest_idx").alias("hi"), F.col("low").alias("lo")).distinct())
    told: DataFrame | None = None
    for _ in range(max_rounds):
        if ties.isEmpty():
            break
        both = ties.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")), F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")))).alias("t"))
        label = _followed(cut_lineage(both.groupBy("t.node").agg(F.min("t.other").alias("other")).select("node", F.least("node", "other").alias("label"))))
        high, low = label.select(F.col("node").alias("hi"), F.col("label").alias("h")), label.select(F.col("node").alias("lo"), F.col("label").alias("l"))
        left = ties.join(high, "hi").join(low, "lo").where("h <> l").select(F.greatest("h", "l").alias("hi"), F.least("h", "l").alias("lo")).distinct()
        ties = cut_lineage(left, (ties,))
        if told is None:
            told = label
        else:
            later = label.select(F.col("node").alias("label"), F.col("label").alias("now"))
            told = cut_lineage(told.join(later, "label", "left").select("node", F.coalesce("now", "label").alias("label")), (told, label))
    else:
        raise RuntimeError(f"ties are left after {max_rounds} rounds")
    if told is None:
        return records.withColumn("component_id", F.col("ingest_idx"))
    found = told.select(F.col("node").alias("ingest_idx"), "label")
    return records.join(found, "ingest_idx", "left").withColumn("component_id", F.coalesce("label", "ingest_idx")).drop("label")


def _followed(label: DataFrame) -> DataFrame:
    """Labels replaced by their labels, twice a pass, until each is its own."""
    while True:
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        once = label.join(up, "label").select("node", F.col("label").alias("was"), F.col("up").alias("label"))
        new = cut_lineage(once.join(up, "label").select("node", "was", F.col("up").alias("label")), (label,))
        label = new.select("node", "label")
        label._checkpoint_file = new._checkpoint_file
        if new.where("label <> was").isEmpty():
            return label
