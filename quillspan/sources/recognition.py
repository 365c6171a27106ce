"""Recognition of page images through a pluggable engine."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("spa", "eng", "por")
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.IntegerType()), T.StructField("error", T.StringType())])


class Recogniser(ABC):
    """``prepare`` loads the engine once per worker, ``recognise`` reads one image."""

    @abstractmethod
    def prepare(self, language: str) -> None: ...

    @abstractmethod
    def recognise(self, image: bytes) -> tuple[str, float]: ...


def recognised(pages: DataFrame, recogniser: Recogniser, language: str = "spa", image: str = "image") -> DataFrame:
    """The pages with text, whole-number confidence and error. A page that fails doesn't stop the others.

    Filter the pages that need it before: the filter runs below the engine.
    """
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}")

    @F.pandas_udf(PAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        recogniser.prepare(language)
        for images in batches:
            out = []
            for x in images:
                try:
                    text, confidence = ("", 0.0) if x is None else recogniser.recognise(x)
                    out.append((text, round(confidence), None))
                except Exception as e:
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "confidence", "error"]).astype({"confidence": "Int32"})

    made = pages.withColumn("__page", run(F.col(image)))
    return made.select(*[c for c in pages.columns if c not in (image, "text", "confidence", "error")], "__page.*")
