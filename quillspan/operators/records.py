"""Nested values and tabular records as text segments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
MOST_METADATA = 18


def number_text(value: int | float) -> str:
    """A number as JSON tools print it: no point for whole numbers."""
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "Infinity" if value > 0 else "-Infinity"
        if value == int(value) and abs(value) < 1e21:
            return str(int(value))
    return str(value)


def scalar_text(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return number_text(value) if isinstance(value, (int, float)) else str(value)


def _object_items(value: dict) -> list[tuple[str, object]]:
    """Whole-number keys first, in order, as JSON objects have it where they come from."""
    whole = [k for k in value if re.fullmatch(r"0|[1-9]\d{0,8}", k)]
    return [(k, value[k]) for k in sorted(whole, key=int)] + [(k, v) for k, v in value.items() if k not in set(whole)]


def flatten(value, prefix: str = "") -> list[tuple[str, str]]:
    """Dotted keys and texts of a JSON value, in order; nulls are left out."""
    out: dict[str, str] = {}

    def visit(v, path: str) -> None:
        if v is None:
            return
        if isinstance(v, list):
            if any(isinstance(x, (dict, list)) for x in v):
                for i, x in enumerate(v):
                    visit(x, f"{path or 'item'}[{i}]")
            else:
                out[path or "valor"] = "; ".join(map(scalar_text, v))
        elif isinstance(v, dict):
            for k, x in _object_items(v):
                visit(x, f"{path}.{k}" if path else k)
        else:
            out[path or "valor"] = scalar_text(v)

    visit(value, prefix)
    return list(out.items())


@F.pandas_udf(ENTRIES)
def flatten_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The entries of JSON texts; null for what is no JSON."""

    def one(text):
        try:
            return None if text is None else [{"key": k, "value": v} for k, v in flatten(json.loads(text))]
        except (ValueError, RecursionError):
            return None

    for texts in batches:
        yield pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _number_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for numbers in batches:
        yield numbers.map(lambda x: number_text(float(x)))


def entries_of(columns: list[str], types: dict[str, str] | None = None) -> Column:
    """The entries of a row's columns without those that are null or blank.

    Columns that ``types`` names as double print as JSON tools print numbers;
    dates and times print as yyyy-MM-dd[ HH:mm:ss].
    """

    def value(c: str) -> Column:
        if (types or {}).get(c) == "double":
            return F.when(F.col(c).isNotNull(), _number_texts(F.col(c)))
        return F.col(c).cast("string")

    made = [F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in columns]
    return F.filter(F.array(*made), lambda e: e["value"].isNotNull() & (F.length(F.regexp_replace(e["value"], r"(?U)\s+", "")) > 0))


def record_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def record_metadata(entries: Column) -> Column:
    return F.map_from_entries(F.slice(entries, 1, MOST_METADATA))


def record_url(entries: Column) -> Column:
    fits = lambda e: F.lower(e["key"]).rlike("url|link|enlace") & e["value"].rlike("(?i)^https?://")
    return F.get(F.filter(entries, fits), F.lit(0))["value"]


def records_to_segments(rows: DataFrame, entries: str, row_number: str, offset: int = 2) -> DataFrame:
    """Text, place, metadata and address of every record that has an entry; the others still count as rows."""
    e = F.col(entries)
    keep = [c for c in rows.columns if c != entries]
    return rows.filter(F.size(e) > 0).select(
        *keep, record_text(e).alias("text"), F.concat(F.lit("fila "), (F.col(row_number) + offset).cast("string")).alias("location"), record_metadata(e).alias("metadata"), record_url(e).alias("url")
    )
