"""Filling containers of fixed capacity by harmonic packing.

Lengths fall into reciprocal classes: class j holds the lengths of which just
j fit into a container. A container of class j gets j documents of its class,
and what is left of it is topped up with the longest shorter documents that
fit. Lengths are whole tokens up to the capacity, so the number of documents
of every length (at most ``capacity`` numbers) describes the whole corpus: from
it the driver makes a plan of runs of equal containers, and every document
finds its container from its rank among the documents of its length, on
whatever worker it is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.encoding import encode_corpus
from quillspan.plans.lineage import stored

CAPACITY = 2048


def harmonic_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, documents in a container, first container).

    The documents of one length with ranks in the range fill consecutive
    containers from the first one, so many in each.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("lengths must be in 1..capacity")
    used = dict.fromkeys(left, 0)
    sizes = sorted(left)
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def give(size: int, per: int, number: int, first: int) -> None:
        amount = per * number
        plan.append((size, used[size], used[size] + amount, per, first))
        used[size] += amount
        left[size] -= amount
        if not left[size]:
            sizes.remove(size)

    def top_up(first: int, number: int, room: int) -> None:
        # runs of equal containers; a run splits where a length runs out
        runs = [(first, number, room)]
        while runs:
            at, n, r = runs.pop()
            i = bisect_right(sizes, r)
            if not i or not n:
                continue
            size = sizes[i - 1]
            per = r // size
            if left[size] >= n * per:
                give(size, per, n, at)
                runs.append((at + n, 0, 0))
                runs.append((at, n, r - size * per))
                continue
            full, rest = divmod(left[size], per)
            if full:
                give(size, per, full, at)
                runs.append((at, full, r - size * per))
            if rest:
                give(size, rest, 1, at + full)
                runs.append((at + full, 1, r - size * rest))
            tail = full + (1 if rest else 0)
            runs.append((at + tail, n - tail, r))

    while sizes:
        size = sizes[-1]
        klass = capacity // size
        full = left[size] // klass
        if full:
            first = bins
            bins += full
            give(size, klass, full, first)
            top_up(first, full, capacity - klass * size)
        if left.get(size):
            # the last documents of this length share a container with the next ones of the class
            first, rest = bins, left[size]
            bins += 1
            give(size, rest, 1, first)
            room, places = capacity - rest * size, klass - rest
            while places and sizes:
                i = bisect_right(sizes, room)
                if not i or capacity // sizes[i - 1] != klass:
                    break
                take = min(places, left[sizes[i - 1]])
                room -= take * sizes[i - 1]
                places -= take
                give(sizes[i - 1], take, 1, first)
            top_up(first, 1, room)
    return plan


def pack_lengths(items: DataFrame, key: str, length: str, capacity: int = CAPACITY, shares: int | None = None) -> DataFrame:
    """Every item, in pieces if it is longer than ``capacity``, with its container.

    Gives key, part (from 0), start_token, n_tokens and container_id. Items
    without a positive length (null included) go nowhere. Only lengths above the
    capacity are divided: into full pieces and a rest.
    """
    spark = items.sparkSession
    shares = shares or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.col("__n")
    cut = (
        items.select(F.col(key).alias("__key"), F.col(length).cast("long").alias("__n"))
        .filter(n > 0)
        .select("__key", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity))).alias("part"))
        .select("__key", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("start_token"), F.least(F.lit(capacity), n - F.col("part") * capacity).cast("int").alias("n_tokens"))
        .withColumn("share", F.pmod(F.xxhash64("__key", "part"), F.lit(shares)).cast("int"))
    )
    table = cut.groupBy("n_tokens", "share").agg(F.count(F.lit(1)).alias("c"))
    counts = {r.n_tokens: r.c for r in table.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}
    plan = harmonic_plan(counts, capacity)
    # ranks: the shares before, then the place within the share
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n_tokens").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = table.select("n_tokens", "share", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("n_tokens", "share").orderBy("__key", "part")) - 1
    ranked = cut.withColumn("inner", inner).join(offsets, ["n_tokens", "share"]).withColumn("rank", F.col("before") + F.col("inner"))
    steps = sorted(plan)
    sizes = np.array([p[0] for p in steps], dtype=np.int64)
    lows = np.array([p[1] for p in steps], dtype=np.int64)
    pers = np.array([p[3] for p in steps], dtype=np.int64)
    firsts = np.array([p[4] for p in steps], dtype=np.int64)
    span = int(max((p[2] for p in steps), default=0)) + 1
    starts = sizes * span + lows
    sent = spark.sparkContext.broadcast((starts, lows, pers, firsts, span))

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        begins, low, per, first, width = sent.value
        for size, rank in batches:
            at = np.searchsorted(begins, size.to_numpy(np.int64) * width + rank.to_numpy(np.int64), side="right") - 1
            yield pd.Series(first[at] + (rank.to_numpy(np.int64) - low[at]) // per[at])

    return ranked.select(F.col("__key").alias(key), "part", "start_token", "n_tokens", F.pandas_udf(place, "long")(F.col("n_tokens"), F.col("rank")).alias("container_id"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Containers of ``capacity`` tokens for all documents that have a text.

    A null or empty text has no token and goes nowhere; copies under other ids
    are documents of their own.
    """
    sized = encode_corpus(documents.select("doc_id", "text"), vocabulary=vocabulary).select("doc_id", F.size("ids").alias("n"))
    return pack_lengths(stored(sized, "sizes"), "doc_id", "n", capacity)
