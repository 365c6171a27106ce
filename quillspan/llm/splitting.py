"""Splitting oversized texts at natural boundaries.

A text above the limit is cut into atomic units (sentences, headings, list
items, paragraphs; clauses, words and at last single characters where a unit
alone is too long). Pieces grow by agglomerative merging: adjacent units are
held in a heap by the strength of the boundary between them, and the weakest
boundary is merged first while the combined size plus the overlap still fits.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.boundaries import Boundary, boundaries
from quillspan.plans.lineage import stored

LIMIT, OVERLAP = 1050, 180

_CLAUSE = re.compile(r"(?<=[;:,])\s+")
_SPACE = re.compile(r"\s+")
_CLAUSE_STRENGTH, _WORD_STRENGTH, _CHAR_STRENGTH = -1, -2, -3

_PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("start_pos", T.IntegerType()),
            T.StructField("body_pos", T.IntegerType()),
            T.StructField("end_pos", T.IntegerType()),
        ]
    )
)


def _refined(text: str, cuts: list[Boundary], room: int) -> list[Boundary]:
    """Cuts so dense that no unit exceeds ``room``."""
    out: list[Boundary] = []
    ends = [c.position for c in cuts[1:]] + [len(text)]
    for cut, end in zip(cuts, ends):
        out.append(cut)
        if end - cut.position <= room:
            continue
        start = cut.position
        for pattern, strength in ((_CLAUSE, _CLAUSE_STRENGTH), (_SPACE, _WORD_STRENGTH)):
            inner = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
            if inner:
                out.extend(Boundary(p, strength) for p in inner)
        marks = sorted({start, end, *(b.position for b in out if start < b.position < end)})
        for a, b in zip(marks, marks[1:]):
            out.extend(Boundary(p, _CHAR_STRENGTH) for p in range(a + room, b, room))
    strongest: dict[int, int] = {}
    for b in out:
        strongest[b.position] = max(strongest.get(b.position, _CHAR_STRENGTH), b.strength)
    return [Boundary(p, s) for p, s in sorted(strongest.items())]


def _overlap_start(text: str, start: int, floor: int, overlap: int, cuts: list[int]) -> int:
    """Where the shared context before ``start`` begins: a cut if one is in reach, else a word."""
    lowest = max(floor, start - overlap)
    if lowest >= start:
        return start
    inside = [c for c in cuts if lowest <= c < start]
    if inside:
        return inside[0]
    space = _SPACE.search(text, lowest, start)
    return space.end() if space else start


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(part, start, body start, end) of every piece of ``text``.

    ``start`` to ``body start`` is shared with the piece before. A null or blank
    text has no piece; a text within the limit has one.
    """
    return units_and_pieces(text, limit, overlap)[1]


def units_and_pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """The starts of the natural units of a text, and the pieces into which they are merged."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap in [0, limit)")
    if not text or not text.strip():
        return [], []
    first, last = len(text) - len(text.lstrip()), len(text.rstrip())
    if last - first <= limit:
        return [b.position for b in boundaries(text)], [(1, first, first, last)]
    room = limit - overlap
    natural = boundaries(text)
    cuts = _refined(text[:last], natural, room)
    position = [c.position for c in cuts]
    n = len(cuts)
    # unit i spans position[i] to end[i]; left and right are the living neighbours
    end = position[1:] + [last]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    version = [0] * n

    def entry(i: int, j: int) -> tuple[int, int, int, int, int, int]:
        return (cuts[j].strength, end[j] - position[i], position[j], i, version[i], version[j])

    heap = [entry(i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, at, i, vi, vj = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or not alive[i] or version[i] != vi or version[j] != vj or position[j] != at:
            continue
        allowed = limit if i == 0 else room
        if end[j] - position[i] > allowed:
            continue
        end[i], alive[j], right[i] = end[j], False, right[j]
        version[i] += 1
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, entry(i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, entry(left[i], i))
    out = []
    floor = first
    starts = [c.position for c in cuts if c.strength > 0]
    for part, i in enumerate((i for i in range(n) if alive[i]), 1):
        body = position[i]
        stop = body + len(text[body : end[i]].rstrip())
        shared = body if part == 1 else max(_overlap_start(text, body, floor, overlap, starts), stop - limit)
        out.append((part, shared, body, stop))
        floor = body
    return [b.position for b in natural], out


_SPLIT = T.StructType([T.StructField("units", T.ArrayType(T.IntegerType())), T.StructField("pieces", _PIECE)])


def _split_udf(limit: int, overlap: int):
    """The natural units of texts and their pieces, from one pass of the merging."""

    @F.pandas_udf(_SPLIT)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [units_and_pieces(t, limit, overlap) for t in texts]
            yield pd.DataFrame({
                "units": pd.Series([units for units, _ in made], dtype=object),
                "pieces": pd.Series([[dict(zip(("part", "start_pos", "body_pos", "end_pos"), p)) for p in found] for _, found in made], dtype=object),
            })

    return cut


def trimmed_length(column: str | F.Column) -> F.Column:
    """Code points of a text without the blanks around it."""
    return F.length(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"(?U)^\s+|\s+$", ""))


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows whose text without the blanks around it exceeds ``limit``.

    The plain length is compared first, so that the regular expression runs only
    on the few long rows.
    """
    return chunks.filter(F.length("text") > limit).filter(F.when(F.length("text") > limit, trimmed_length("text") > limit))


def natural_starts(chunks: DataFrame, key: str = "chunk_id", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, start_pos): the natural units of every oversized text, as the merging begins with them; copies of a row once."""
    long = oversized(chunks.select(key, "text"), limit).dropDuplicates([key])
    return long.select(key, F.explode(_split_udf(limit, min(overlap, limit - 1))("text")["units"]).alias("start_pos"))


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, bucket: int = 1024) -> DataFrame:
    """All chunks, the oversized ones in pieces, numbered anew.

    Takes base_id, source_id, chunk_id, chunk_index, text and location; further
    columns stay as they are. Adds chunk_part (from 1, in place of a column of
    that name) and the piece's text, its location (``..., parte i`` if there are several
    parts; a null location gives ``parte i``) and chunk_index from 0 within
    source and base. Rows sent twice count once. A null or blank text stays one
    row with its text unchanged; an empty table gives an empty table.

    The rows are shuffled once, by source, base and blocks of ``bucket`` old
    numbers (those without a number in as many blocks by a hash), and numbered
    within them; only the blocks' sums are added up along a source. So no task
    sees a whole source however large it is. Rows of one chunk_id, source,
    base and chunk_index are one that was sent twice.
    """
    group = ["source_id", "base_id"]
    # those without a number come before all others
    place = F.coalesce(F.floor(F.col("chunk_index") / bucket), F.pmod(F.xxhash64("chunk_id"), F.lit(bucket)) - (1 << 40))
    within = Window.partitionBy(*group, "__block").orderBy("chunk_index", "chunk_id")
    rows = chunks.withColumn("__block", place)
    # copies stand next to one another
    same = F.lag("chunk_id").over(within).eqNullSafe(F.col("chunk_id")) & F.lag("chunk_index").over(within).eqNullSafe(F.col("chunk_index"))
    rows = rows.withColumn("__copy", (F.row_number().over(within) > 1) & same)
    once = rows.filter(~F.col("__copy")).drop("__copy")
    # only the long texts go to the workers' Python
    once = once.withColumn("__pieces", _split_udf(limit, overlap)(F.when(F.length("text") > limit, F.col("text")))["pieces"])
    once = once.withColumn("__parts", F.greatest(F.lit(1), F.size("__pieces")))
    once = stored(once.withColumn("__first", F.sum("__parts").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__parts")), "pieces")
    sums = once.groupBy(*group, "__block").agg(F.sum("__parts").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*group, "__block", before.alias("__before"))
    placed = once.alias("c").join(sums.alias("s"), F.expr("c.source_id <=> s.source_id and c.base_id <=> s.base_id and c.__block = s.__block")).select("c.*", "s.__before")
    several = F.col("__parts") > 1
    cut = placed.select("*", F.posexplode_outer("__pieces").alias("__pos", "__piece"))
    made = {
        "chunk_part": F.coalesce(F.col("__pos") + 1, F.lit(1)),
        "text": F.when(several, F.expr("substring(text, __piece.start_pos + 1, __piece.end_pos - __piece.start_pos)")).otherwise(F.col("text")),
        "location": F.when(several, F.concat_ws(", ", "location", F.concat(F.lit("parte "), (F.col("__pos") + 1).cast("string")))).otherwise(F.col("location")),
        "chunk_index": (F.col("__before") + F.col("__first") + F.coalesce("__pos", F.lit(0))).cast("int"),
    }
    kept = [made.get(c, F.col(f"`{c}`")).alias(c) for c in chunks.columns if c not in ("chunk_index", "chunk_part")]
    return cut.select(*kept, made["chunk_part"].alias("chunk_part"), made["chunk_index"].alias("chunk_index"))
