"""Near-duplicate texts by mergeable, locality-sensitive SetSketches.

Texts with the same shingles form a class, and one class is handled once
however many copies it has. Bands of register values yield candidate pairs of
classes, the joint likelihood estimate of the whole sketches drops the
unlikely ones, and the shingles of the remaining pairs are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import sketches as S
from quillspan.plans.lineage import stored

SHINGLE, SIMILARITY = 5, 0.8
BAND_ROWS = 5
#: Registers that the joint estimate reads, and by how many of its standard errors a pair may fall short.
ESTIMATE_REGISTERS, TOLERANCE = 64, 4.0
#: Classes of a band that are compared in one piece; a band with more is compared block against block.
HUB = 2_048
#: A class with more copies is given by links to its representative instead of by all pairs.
EXPANDED_COPIES = 64
#: Shares into which the copies of such a class are divided; each of them has more copies than that.
SALTS = 64


def _long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def sketched(rows: DataFrame, key: str, text: str, shingle: int, least_words: int) -> DataFrame:
    """(key, class_id, n, sketch) of every text with enough words.

    class_id is a hash of the set of shingles. The sketch comes once per class
    and input partition and is null in its other rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                if not t:
                    continue
                tokens = S.words(t)
                if len(tokens) < max(least_words, shingle):
                    continue
                h = S.shingles(tokens, shingle)
                c = xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63
                if c in seen:
                    out.append((k, c, len(h), None))
                else:
                    if len(seen) < 2_000_000:
                        seen.add(c)
                    out.append((k, c, len(h), S.sketch(h).tobytes()))
            yield pd.DataFrame(out, columns=["key", "class_id", "n", "sketch"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"key {kind}, class_id bigint, n int, sketch binary")


def _band_hashes(sketches: np.ndarray) -> np.ndarray:
    """sketches x bands: a hash of the registers of each band."""
    k = sketches.astype(np.uint64)
    bands = k.shape[1] // BAND_ROWS
    out = np.empty((len(k), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(k), b + 1, np.uint64)
        for i in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
            h = S._mixed(h * S._STEP + k[:, i])
        out[:, b] = h
    return out


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int16).reshape(len(column), -1)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            out = _band_hashes(_registers(batch["sketch"]))
            yield pd.DataFrame({"band": _long(out).ravel(), "class_id": np.repeat(batch["class_id"].to_numpy(), out.shape[1])})


def _estimates(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, na, nb in columns:
        if not len(a):
            yield pd.Series([], dtype="float64")
            continue
        x = np.frombuffer(b"".join(a), np.int16).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.int16).reshape(len(b), -1)
        yield pd.Series(S.jaccard_estimate((x > y).sum(1), (x < y).sum(1), na.to_numpy(float), nb.to_numpy(float), x.shape[1]))


def _exact(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in columns:
        yield pd.Series([_jaccard(x, y) for x, y in zip(a, b)], dtype="float64")


def _jaccard(x: bytes, y: bytes) -> float:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / (len(p) + len(q) - both)


def _compared_blocks(similarity: float, least_estimate: float):
    """Compares the classes of one block of a large band with those of another, or with one another."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        first, second = part[part["of"] == part["i"]], part[part["of"] == part["j"]]
        band = np.int64(part["band"].iloc[0]).astype(np.uint64)
        x, y = _registers(first["sketch"]), _registers(second["sketch"])
        hx, hy = _band_hashes(x), _band_hashes(y)
        x, y = x[:, :ESTIMATE_REGISTERS], y[:, :ESTIMATE_REGISTERS]
        a, b, n, m = first["class_id"].to_numpy(), second["class_id"].to_numpy(), first["n"].to_numpy(float), second["n"].to_numpy(float)
        sets_a, sets_b = first["h"].to_numpy(), second["h"].to_numpy()
        out = []
        for k in range(len(first)):
            # a pair is compared in the first band that both are in, and once
            common = hy == hx[k]
            fit = (hy[np.arange(len(hy)), common.argmax(1)] == band) & (np.minimum(m, n[k]) >= similarity * np.maximum(m, n[k]) - 1e-9)
            fit &= b > a[k] if part["i"].iloc[0] == part["j"].iloc[0] else True
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            estimate = S.jaccard_estimate((x[k] > y[at]).sum(1), (x[k] < y[at]).sum(1), np.full(len(at), n[k]), m[at], x.shape[1])
            for c in at[estimate >= least_estimate]:
                j = _jaccard(sets_a[k], sets_b[c])
                if j >= similarity - 1e-12:
                    out.append((min(a[k], b[c]), max(a[k], b[c]), j))
        return pd.DataFrame(out, columns=["class_a", "class_b", "jaccard"])

    return compare


def similar_classes(table: DataFrame, rows: DataFrame, key: str, text: str, shingle: int, similarity: float, hub: int = HUB) -> DataFrame:
    """(class_a, class_b, jaccard), a below b: pairs of classes at least ``similarity`` alike.

    Classes that share a band are compared. In bands of more than ``hub``
    classes that is done block against block, each pair of blocks by itself, with
    the estimate and the exact comparison on the spot, so that neither a task
    nor a shuffle has all pairs of a large band.
    """
    first = table.filter(F.col("sketch").isNotNull())
    bands = first.select("class_id", "sketch").mapInPandas(_bands, "band bigint, class_id bigint")
    # a class has as many sketches as partitions had it first
    of_band = Window.partitionBy("band")
    several = bands.withColumn("rank", F.dense_rank().over(of_band.orderBy("class_id"))).withColumn("size", F.max("rank").over(of_band)).filter("size > 1")
    several = stored(several.distinct(), "bands")
    error = (similarity * (1 - similarity) / ESTIMATE_REGISTERS) ** 0.5
    least_estimate = similarity - TOLERANCE * error

    small = several.filter(F.col("size") <= hub)
    a = small.select("band", F.col("class_id").alias("class_a"))
    b = small.select("band", F.col("class_id").alias("class_b"))
    pairs = a.join(b, "band").filter(F.col("class_a") < F.col("class_b")).select("class_a", "class_b").distinct()
    brief = first.groupBy("class_id").agg(F.first("n").alias("n"), F.first(F.expr(f"substring(sketch, 1, {2 * ESTIMATE_REGISTERS})")).alias("k"))
    met = pairs.join(brief.select(F.col("class_id").alias("class_a"), F.col("n").alias("na"), F.col("k").alias("ka")), "class_a").join(
        brief.select(F.col("class_id").alias("class_b"), F.col("n").alias("nb"), F.col("k").alias("kb")), "class_b"
    )
    # sets of very different size can't be similar enough
    met = met.filter(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9)
    likely = met.withColumn("estimate", F.pandas_udf(_estimates, "double")("ka", "kb", "na", "nb")).filter(F.col("estimate") >= least_estimate)
    likely = stored(likely.select("class_a", "class_b"), "likely")
    large = several.filter(F.col("size") > hub)
    hubs = not large.isEmpty()

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"class_id": batch["class_id"], "h": [S.shingles(S.words(t), shingle).tobytes() for t in batch["text"]]})

    needed = likely.select(F.col("class_a").alias("class_id")).union(likely.select("class_b"))
    needed = (needed.union(large.select("class_id")) if hubs else needed).distinct()
    representative = table.join(needed, "class_id", "left_semi").groupBy("class_id").agg(F.min("key").alias("key"))
    texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).join(representative, "key").select("class_id", "text").dropDuplicates(["class_id"])
    sets = texts.mapInPandas(shingled, "class_id bigint, h binary")
    compared = likely.join(sets.select(F.col("class_id").alias("class_a"), F.col("h").alias("ha")), "class_a").join(
        sets.select(F.col("class_id").alias("class_b"), F.col("h").alias("hb")), "class_b"
    )
    found = compared.select("class_a", "class_b", F.pandas_udf(_exact, "double")("ha", "hb").alias("jaccard")).filter(F.col("jaccard") >= similarity - 1e-12)
    if not hubs:
        return found
    whole = first.groupBy("class_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    members = large.select("band", "class_id", F.floor((F.col("rank") - 1) / hub).cast("int").alias("of"), F.floor((F.col("size") - 1) / hub).cast("int").alias("last"))
    members = members.join(whole, "class_id").join(sets, "class_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("i", F.least("of", "other")).withColumn("j", F.greatest("of", "other"))
    blocks = members.groupBy("band", "i", "j").applyInPandas(_compared_blocks(similarity, least_estimate), "class_a bigint, class_b bigint, jaccard double")
    return found.unionByName(blocks).dropDuplicates(["class_a", "class_b"])


def near_duplicates(rows: DataFrame, key: str = "chunk_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, least_words: int = 0, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Membership (key, class_id) and the similar pairs of classes (class_a, class_b, jaccard).

    Texts of fewer than ``least_words`` (or than ``shingle``) words, null and
    empty ones included, take no part. Rows of the same key are one record, of
    the same text one class.
    """
    if not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("similarity must be in (0, 1] and shingle positive")
    table = stored(sketched(rows, key, text, shingle, least_words), "sketches")
    members = table.select(F.col("key").alias(key), "class_id").distinct()
    return members, similar_classes(table, rows, key, text, shingle, similarity, hub)


def duplicate_pairs(members: DataFrame, pairs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key_a, key_b), a before b: the pairs of rows behind pairs of classes.

    All pairs of copies are given too; of a class with more than
    EXPANDED_COPIES copies only its links to its representative (its first key),
    and only the representative in links with other classes, so that a text that
    makes up a third of all rows costs a row a copy.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first"))
    sizes = stored(sizes, "classes")
    linked = sizes.filter(F.col("size") <= EXPANDED_COPIES)
    small = members.join(linked.select("class_id"), "class_id", "left_semi")
    shown = small.select("class_id", key).unionByName(sizes.filter(F.col("size") > EXPANDED_COPIES).select("class_id", F.col("first").alias(key)))
    a = shown.select(F.col("class_id").alias("class_a"), F.col(key).alias("x"))
    b = shown.select(F.col("class_id").alias("class_b"), F.col(key).alias("y"))
    between = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("x", "y")
    several = small.join(sizes.filter(F.col("size") > 1).select("class_id"), "class_id", "left_semi")
    within = several.select("class_id", F.col(key).alias("x")).join(several.select("class_id", F.col(key).alias("y")), "class_id").filter("x < y").select("x", "y")
    large = sizes.filter(F.col("size") > EXPANDED_COPIES).select("class_id", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = members.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(large, ["class_id", "salt"])
    stars = copies.filter(F.col(key) != F.col("first")).select(F.col("first").alias("x"), F.col(key).alias("y"))
    every = between.unionByName(within).unionByName(stars)
    return every.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def connected_classes(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(class_id, group_id) of all classes in ``pairs``: connected components.

    Alternating large-star and small-star steps; the links stay distributed and
    each round is written to the shared folder. group_id is the least class.
    """
    edges = stored(pairs.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).distinct(), "edges")

    def star(links: DataFrame, larger: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not larger:
            both = both.filter("v < u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if larger:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    state = None
    for _ in range(most_rounds):
        edges = stored(star(star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("class_id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("class_id"), F.col("v").alias("group_id"))).distinct()


def near_duplicate_groups(members: DataFrame, pairs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, class_id, group_id, n_links): every row with the group of texts it belongs to.

    A class without a similar one is a group of itself; n_links counts the
    similar classes of the row's class.
    """
    links = pairs.select(F.col("class_a").alias("class_id")).unionAll(pairs.select("class_b")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    info = connected_classes(pairs).join(links, "class_id")
    return members.join(info, "class_id", "left").select(key, "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
