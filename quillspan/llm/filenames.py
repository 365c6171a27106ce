"""The file that a result means, whatever copy or spelling its name gives."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.folding import without_marks

SALTS = 8
LONGEST_NAME = 1_024

_BLANKS = re.compile(r"[\s_]+")
_EXTENSION = re.compile(r"^(.*?)\s*(\.[a-z0-9]{1,5})$")
# What copying programs put before or after a name.
_PREFIX = re.compile(r"^(?:copia de|copia di|copie de|cópia de|copia|copy of|copy)(?:\s*\(\d+\))?\s+(?:-\s+)?")
_SUFFIXES = (
    re.compile(r"\s*[-–]\s*(?:copia|copy|copie)(?:\s*\(?\d+\)?)?$"),
    re.compile(r"\s*\(\s*(?:copia|copy)?\s*\d*\s*\)$"),
    re.compile(r"\s+(?:copia|copy)$"),
    re.compile(r"\s+\d{1,2}$"),
)


def spelling_key(name: str) -> str:
    """A name without case, accents, blanks' number and underscores."""
    folded = without_marks(name.lower())
    folded = _BLANKS.sub(" ", folded).strip()
    match = _EXTENSION.match(folded)
    return match.group(1).strip() + match.group(2) if match else folded


def candidate_keys(name: str | None) -> list[str]:
    """The name's key, then the keys of what it may be a copy of, least stripped first; what is longer than LONGEST_NAME is no copy."""
    if name is None or not name.strip():
        return []
    key = spelling_key(name)
    if len(key) > LONGEST_NAME:
        return [key]
    match = _EXTENSION.match(key)
    base, extension = (match.group(1), match.group(2)) if match else (key, "")
    seen, frontier = [base], [base]
    while frontier:  # every step makes names shorter
        grown = []
        for b in frontier:
            for pattern in (_PREFIX, *_SUFFIXES):
                shorter = pattern.sub("", b, count=1).strip()
                if shorter and shorter not in seen:
                    seen.append(shorter)
                    grown.append(shorter)
        frontier = grown
    return [s + extension for s in seen]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in batches:
        yield names.map(candidate_keys)


def stated_name() -> F.Column:
    """file_name, else the last component of relative_path, else of source_path; blank is missing."""
    last = lambda c: F.element_at(F.split(F.col(c), r"[/\\]"), -1)
    named = [F.when(F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0, c) for c in (F.col("file_name"), last("relative_path"), last("source_path"))]
    return F.coalesce(*named)


def with_file_key(rows: DataFrame, manifest: DataFrame, name: str, out: str = "file_key") -> DataFrame:
    """``rows`` with the key of the manifest's file that column ``name`` means.

    Each distinct name is resolved once: of its candidate keys the least
    stripped one that the manifest has, else its own spelling key. Rows meet
    the resolved names in ``SALTS`` shares, so that a name with a large part of
    all rows doesn't go to one task. A missing name gives a null key.
    """
    names = rows.select(F.col(name).alias("__name")).filter(F.col("__name").isNotNull()).distinct()
    tried = names.select("__name", F.posexplode(_candidates("__name")).alias("__pos", "__key"))
    known = manifest.select(F.explode(F.slice(_candidates("source_name"), 1, 1)).alias("__key")).distinct().withColumn("__known", F.lit(True))
    resolved = (
        tried.join(known, "__key", "left")
        .groupBy("__name")
        .agg(F.min(F.struct(F.when(F.col("__known"), F.col("__pos")).otherwise(F.col("__pos") + LONGEST_NAME * LONGEST_NAME), F.col("__key").alias("key"))).alias("__best"))
        .select("__name", F.col("__best.key").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(SALTS)).cast("int"))
    return salted.join(resolved, (F.col(name) == F.col("__name")) & (salted["__salt"] == resolved["__salt"]), "left").select(*[salted[c] for c in rows.columns], out)
