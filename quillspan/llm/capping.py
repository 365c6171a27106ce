"""Capping the records of each dominant contributor.

The cutoff of every contributor is found by parallel bisection. All
contributors keep bounds on the score of their last kept record; one pass
counts the records above many midpoints of all of them together, which
narrows every interval at once. Records whose side is decided leave the next
pass, so the work shrinks to the records around the cutoffs. Equal scores are
resolved by the identifier, with the same bisection on the identifier.

No contributor's records are ever gathered in one task: counts are combined
before the shuffle, and a record only ever meets its contributor's bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.filenames import stated_name, with_file_key
from quillspan.plans.lineage import stored

MIDPOINTS = 64
SALTS = 8


def _rank_key(score: str) -> F.Column:
    """A double that orders scores; null and NaN come after all numbers."""
    s = F.col(score).cast("double")
    return F.when(s.isNull() | F.isnan(s), F.lit(float("-inf"))).otherwise(F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), s + F.lit(0.0))))


def _salted(per_group: DataFrame) -> DataFrame:
    """One row per group and share, so that a group's rows may be spread over tasks."""
    return per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def over_cap(rows: DataFrame, group: list[str], identifier: str, score: str, cap: int, midpoints: int = MIDPOINTS) -> DataFrame:
    """(group..., identifier) of the rows beyond the ``cap`` best of their group.

    Higher scores are better, null and NaN rank last, and of equal scores the
    smaller identifier is better. Identifiers are integers and unique in a
    group. Null group values form a group of their own. ``cap`` 0 drops all.
    """
    if cap < 0 or midpoints < 2:
        raise ValueError("cap must not be negative and midpoints at least 2")
    spark = rows.sparkSession
    base = rows.select(F.struct(*group).alias("g"), F.col(identifier).cast("long").alias("id"), _rank_key(score).alias("s"))
    if cap == 0:
        return base.select(*[F.col(f"g.{c}").alias(c) for c in group], F.col("id").alias(identifier))
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)
    active = stored(base.join(sizes.select("g"), "g", "left_semi").withColumn("left", F.lit(cap).cast("long")), "cap-active")
    dropped: list[DataFrame] = []
    rounds = 0
    while True:
        # per group: how many rows are still undecided, and between which bounds
        bounds = active.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("s").alias("s_lo"),
            F.max("s").alias("s_hi"),
            F.min(F.when(F.col("s") > float("-inf"), F.col("s"))).alias("s_min"),
            F.min("id").alias("i_lo"),
            F.max("id").alias("i_hi"),
        )
        rows_now = active.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(_salted(bounds), ["g", "salt"])
        flat = F.col("s_lo") == F.col("s_hi")
        width = F.col("s_hi") / 2 - F.col("s_min") / 2
        # cell 0 holds the best rows; the highest score is alone in it only if nothing equals it
        by_score = (
            F.when(F.col("s") == float("-inf"), F.lit(midpoints + 1))
            .when(F.coalesce(width, F.lit(0.0)) <= 0, F.lit(0))
            .otherwise(F.least(F.lit(midpoints - 1), F.floor((F.col("s_hi") / 2 - F.col("s") / 2) / width * midpoints)) + F.when(F.col("s") == F.col("s_min"), 1).otherwise(0))
        )
        by_id = F.least(F.lit(midpoints - 1), F.floor((F.col("id") - F.col("i_lo")).cast("double") / F.greatest(F.lit(1), F.col("i_hi") - F.col("i_lo")) * midpoints))
        cells = rows_now.select("g", "salt", "id", "s", "left", F.when(flat, by_id).otherwise(by_score).cast("int").alias("cell"))
        counts = cells.groupBy("g", "cell", "left").agg(F.count(F.lit(1)).alias("c"))
        # the cell of the cutoff: a group has at most midpoints + 2 counts
        per_group = counts.groupBy("g", "left").agg(F.array_sort(F.collect_list(F.struct("cell", "c"))).alias("cs"))
        cut = per_group.select(
            "g",
            F.expr(
                "aggregate(cs, struct(left as rest, -1 as cell, 0L as c), (a, x) -> "
                "if(a.cell >= 0, a, if(a.rest >= x.c, struct(a.rest - x.c as rest, -1 as cell, 0L as c), struct(a.rest as rest, x.cell as cell, x.c as c))))"
            ).alias("b"),
        )
        judged = stored(
            cells.drop("left").join(_salted(cut), ["g", "salt"]).select(
                "g", "id", "s", F.col("b.rest").alias("left"),
                F.when(F.col("cell") > F.col("b.cell"), "drop").when(F.col("cell") < F.col("b.cell"), "keep").when(F.col("b.rest") == 0, "drop").otherwise("open").alias("side"),
            ),
            f"cap-{rounds}",
        )
        dropped.append(judged.filter(F.col("side") == "drop").select("g", "id"))
        active = judged.filter(F.col("side") == "open").select("g", "id", "s", "left")
        rounds += 1
        if active.isEmpty():
            break
        if rounds > 200:
            raise RuntimeError("the bisection did not converge")
    out = dropped[0]
    for d in dropped[1:]:
        out = out.unionAll(d)
    return out.select(*[F.col(f"g.{c}").alias(c) for c in group], F.col("id").alias(identifier))


def results_over_cap(results: DataFrame, manifest: DataFrame, cap: int = 3) -> DataFrame:
    """(query_id, result_id) of the results beyond the ``cap`` best of their file in a query.

    A file counts under every name of a copy or other spelling; without a
    file_name the last component of relative_path, then of source_path, counts.
    A result sent twice is one result. A name that no file of the manifest has
    stands for itself.
    """
    slim = results.select("query_id", "result_id", "file_name", "relative_path", "source_path", "relevance").dropDuplicates(["result_id"])
    named = slim.select("result_id", "query_id", "relevance", stated_name().alias("name"))
    keyed = with_file_key(named, manifest, "name")
    found = over_cap(keyed, ["query_id", "file_key"], "result_id", "relevance", cap)
    return found.select("query_id", "result_id")


def capped_results(results: DataFrame, manifest: DataFrame, cap: int = 3) -> DataFrame:
    """The results that stay, each once, with all their columns."""
    gone = results_over_cap(results, manifest, cap).select(F.col("result_id").alias("__gone"))
    rows = results.dropDuplicates(["result_id"])
    return rows.join(gone, F.col("result_id") == F.col("__gone"), "left_anti")
