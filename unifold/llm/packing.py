"""Filling fixed-capacity containers with texts, by packing patterns of their lengths.

Only the histogram of lengths, in ``capacity / unit`` buckets, is looked at on the driver: its
size doesn't depend on the corpus. Patterns of a few lengths that fill a container are
enumerated, how often each is used is fitted to the histogram by non-negative least squares and
rounded down, and what is left is packed by patterns that take the longest lengths first, each
repeated as often as its lengths last. The plan covers every text. Texts then get numbers within
their bucket, partition by partition, and the plan turns a number into a container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unifold.llm.tokens import DEFAULT_VOCABULARY, count
from unifold.runtime import cut_lineage

CAPACITY = 2048
BUCKETS = 512
DEPTH = 3


def item_sizes(docs: DataFrame, capacity: int = CAPACITY, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, part_no, first_token, n_tokens): each text, or the parts of one above the capacity.

    Parts are as large as the capacity but for the last. An empty text is one item of no tokens;
    a null text or a null id is none. Repeated rows are items of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                n = count(text, path)
                rows += [(doc, i, i * capacity, min(capacity, n - i * capacity)) for i in range(max(1, -(-n // capacity)))]
            yield pd.DataFrame(rows, columns=["doc_id", "part_no", "first_token", "n_tokens"])

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return texts.mapInPandas(run, "doc_id bigint, part_no int, first_token bigint, n_tokens int")


def enumerate_patterns(buckets: int, present: list[int], depth: int = DEPTH, slack: int = 1) -> np.ndarray:
    """Patterns (rows of multiplicities by length) of at most ``depth`` lengths that fill a container.

    Also the containers that one length alone fills. Lengths that no text has are left out.
    """
    have = sorted(set(present), reverse=True)
    rows: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], room: int) -> None:
        if room <= slack:
            rows.append(parts)
            return
        if len(parts) == depth:
            return
        last = len(parts) == depth - 1
        for h in have:
            if h > room or (parts and h > parts[-1]):
                continue
            if last and h < room - slack:
                break
            extend((*parts, h), room - h)

    extend((), buckets)
    rows += [(h,) * (buckets // h) for h in have if buckets % h <= slack]
    rows = sorted(set(rows))
    out = np.zeros((len(rows), buckets + 1), np.int16)
    for r, parts in enumerate(rows):
        for h in parts:
            out[r, h] += 1
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0, by accelerated projected gradients."""
    x = np.zeros(a.shape[1], a.dtype)
    if not x.size:
        return x
    v = np.ones(a.shape[1], a.dtype)
    for _ in range(30):  # largest eigenvalue of a'a
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / max(1e-9, float(v @ (a.T @ (a @ v))))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - a.dtype.type(step) * (a.T @ (a @ y - b)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + a.dtype.type((t - 1) / t_new) * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, buckets: int = BUCKETS, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """[(pattern, repeats)] that takes each length exactly as often as the histogram has it.

    ``histogram[h]`` is the number of items of length h (1 to ``buckets``).
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: np.ndarray, times: int) -> None:
        out.append(({int(h): int(pattern[h]) for h in np.flatnonzero(pattern)}, int(times)))
        left[:] -= pattern * times

    present = np.flatnonzero(left[1:]) + 1
    if len(present):
        patterns = enumerate_patterns(buckets, present.tolist(), depth)
        weights = nonnegative_least_squares(np.ascontiguousarray(patterns[:, 1:].T, np.float32), left[1:].astype(np.float32))
        for r in np.argsort(-weights, kind="stable"):
            used = patterns[r] > 0
            times = min(int(weights[r]), int((left[used] // patterns[r][used]).min()))
            if times > 0:
                take(patterns[r], times)
    while left[1:].any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        pattern = fullest(left, buckets - longest)
        left[longest] += 1
        pattern[longest] += 1
        used = pattern > 0
        take(pattern, int((left[used] // pattern[used]).min()))
    return out


def fullest(left: np.ndarray, room: int, copies: int = 3) -> np.ndarray:
    """The lengths, of those left, that fill ``room`` best, with as few items as possible.

    Up to ``copies`` of a length are tried, and any number if that leaves a gap. Few items means long ones, so the short ones
    stay for later gaps.
    """
    lens = [int(h) for h in np.flatnonzero(left[: room + 1])[::-1] if h]
    best = np.full(room + 1, 10**6, np.int64)
    best[0] = 0
    taken = []
    for h in lens:
        new, took = best.copy(), np.zeros(room + 1, np.int16)
        for c in range(1, min(copies, int(left[h]), room // h) + 1):
            cand = best[: room + 1 - c * h] + c
            better = cand < new[c * h :]
            new[c * h :][better] = cand[better]
            took[c * h :][better] = c
        best = new
        taken.append(took)
    r = int(np.flatnonzero(best < 10**6)[-1])
    if r < room and copies < room:
        return fullest(left, room, room)
    pattern = np.zeros(len(left), np.int64)
    for h, took in zip(reversed(lens), reversed(taken)):
        pattern[h] = took[r]
        r -= int(took[r]) * h
    return pattern


def pack(items: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, depth: int = DEPTH) -> DataFrame:
    """Add ``container_no`` to rows with ``n_tokens`` (0 to ``capacity``); no container overflows.

    A length is rounded up to a multiple of capacity / buckets for the plan. Items of no tokens go
    to container 0. The numbering follows the written partitions, so a lost executor changes
    nothing. An empty input gives no rows. Columns named like the result's or the plan's own
    (container_no, bucket, pid, k, before, rank) are replaced.
    """
    if capacity % buckets:
        raise ValueError("the capacity must be a multiple of the number of buckets")
    items = items.drop("container_no", "bucket", "pid", "k", "before", "rank")
    unit = capacity // buckets
    rows = cut_lineage(items.withColumn("bucket", F.ceil(F.col("n_tokens") / unit).cast("int")))
    placed = rows.withColumn("pid", F.spark_partition_id())
    counts = cut_lineage(placed.groupBy("pid", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(buckets + 1, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        histogram[r.bucket] = r.n
    histogram[0] = 0
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(_slots(plan(histogram, buckets, depth), buckets))
    earlier = Window.partitionBy("bucket").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("pid", "bucket").orderBy(*items.columns)
    ranked = placed.withColumn("k", F.row_number().over(within)).join(offsets, ["pid", "bucket"])
    ranked = ranked.select(*items.columns, "bucket", (F.col("before") + F.col("k") - 1).alias("rank"))
    schema = f"{items.schema.simpleString()[7:-1]},container_no bigint"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        for batch in batches:
            bucket, rank = batch["bucket"].to_numpy(), batch["rank"].to_numpy()
            container = np.zeros(len(batch), np.int64)
            for b in np.unique(bucket):
                if b:
                    at = bucket == b
                    upto, base, each = slots[b]
                    k = np.searchsorted(upto, rank[at], side="right")
                    inside = rank[at] - np.concatenate([[0], upto])[k]
                    container[at] = base[k] + inside // each[k]
            yield batch.drop(columns=["bucket", "rank"]).assign(container_no=container)

    return ranked.mapInPandas(assign, schema)


def _slots(patterns: list[tuple[dict[int, int], int]], buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: how many items the patterns take so far, their first container, items in each."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for pattern, times in patterns:
        for h, each in pattern.items():
            out.setdefault(h, []).append((each * times, base, each))
        base += times
    return {h: (np.cumsum([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for h, v in out.items()}
