"""Questions from search to answer."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import js_stripped
from quillspan.operators import answers as A
from quillspan.operators.retrieval import search_desktop, search_web
from quillspan.plans.lineage import stored
from quillspan.profiles import DESKTOP, MODES, NOTHING_FOUND, NOTICE_BLANK, NOTICE_FAILED, NOTICE_WORDS, WEB
from quillspan.sources.embedder import Embedder, embedded

Model = Callable[[str, list[str]], str | None]


class Answer(NamedTuple):
    text: str
    sources: list[dict]
    mode: str
    concept: str | None = None


def is_local(url: str) -> bool:
    """Whether an address is on this machine and of the web's schemes."""
    try:
        parsed = urlparse(url)
        return parsed.scheme in ("http", "https") and parsed.hostname in ("127.0.0.1", "::1", "localhost")
    except ValueError:
        return False


def local_model(url: str, name: str, seconds: float = 35.0) -> Model:
    """A model behind a chat address of this machine; None when it doesn't answer or answers nothing."""
    if not is_local(url):
        raise ValueError("only a model on this machine is asked")

    def ask(query: str, snippets: list[str]) -> str | None:
        body = {"model": name, "temperature": 0.15, "max_tokens": 900, "messages": [{"role": "user", "content": A.llm_prompt(query, snippets)}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=seconds) as reply:
                return json.load(reply)["choices"][0]["message"]["content"].strip() or None
        except (urllib.error.URLError, TimeoutError, OSError, ValueError, KeyError, IndexError):
            return None

    return ask


def answer_questions(
    queries: DataFrame, chunks: DataFrame, k: int = DESKTOP.top_k, least: float = DESKTOP.least_score, model: Model | None = None, embed: Callable[[str], list[float]] | None = None
) -> DataFrame:
    """(query_id, text, mode, concept, sources): an answer to each of ``queries`` (query_id, query_text, embedding).

    A concept question searches with its variants, more candidates and a lower
    threshold; ``embed`` gives the vector of the longer query if there is one.
    The model, optional and off by default, is asked by the workers, one call a
    query. A query without hits is told so.
    """
    asked = queries.select("query_id", F.col("query_text").alias("query"), "embedding", A.concept_of("query_text").alias("concept"))
    plain = asked.filter("concept is null").select("query_id", F.col("query").alias("query_text"), "embedding")
    about = asked.filter("concept is not null").select("query_id", A.expanded_query("concept", "query").alias("query_text"), "embedding")
    if embed is not None:

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: list(embed(t)))

        about = about.withColumn("embedding", vectors("query_text"))
    found = search_desktop(plain, chunks, k, max(8 * k, 40), least).unionByName(search_desktop(about, chunks, k, max(10 * k, 60), min(least, 0.24)))
    hits = stored(found.drop("query").join(asked.select("query_id", "query", "concept"), "query_id"), "hits")
    source = F.struct(
        F.col("rank").alias("index"), F.col("file_name").alias("file"), "relative_path", "location", "relevance", F.col("snippet").alias("excerpt")
    )
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    essays = A.concept_answers(hits.filter("concept is not null")).select("query_id", F.col("text").alias("essay"))
    extracts = A.extractive_answers(hits.filter("concept is null")).select("query_id", F.col("text").alias("extract"))
    every = asked.select("query_id", "query", "concept").join(listed, "query_id", "left")
    if model is None:
        told = every.select("query_id", F.lit(None).cast("string").alias("told"))
    else:

        def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"query_id": batch["query_id"], "told": [model(q, list(s)) for q, s in zip(batch["request"], batch["snippets"])]})

        request = F.when(F.col("concept").isNotNull(), A.concept_request("concept", "query")).otherwise(F.col("query"))
        kind = queries.schema["query_id"].dataType.simpleString()
        told = every.filter("sources is not null").select("query_id", request.alias("request"), F.col("sources.excerpt").alias("snippets")).mapInPandas(tell, f"query_id {kind}, told string")
    x = every.join(told, "query_id", "left").join(essays, "query_id", "left").join(extracts, "query_id", "left")
    x = x.withColumn("text", F.coalesce("told", "essay", "extract", F.lit(NOTHING_FOUND)))
    mode = F.when(F.col("told").isNotNull(), MODES[1]).when(F.col("essay").isNotNull(), MODES[2]).when(F.col("extract").isNotNull(), MODES[3]).otherwise(MODES[0])
    none = F.expr(f"cast(array() as {x.schema['sources'].dataType.simpleString()})")
    return x.select("query_id", "text", mode.alias("mode"), "concept", F.coalesce(A.sources_for_text(F.col("text"), F.col("sources")), none).alias("sources"))


def answer_question(queries: DataFrame, chunks: DataFrame, k: int = DESKTOP.top_k, least: float = DESKTOP.least_score, model: Model | None = None, embed: Callable[[str], list[float]] | None = None) -> Answer:
    """The answer to the one query of ``queries``."""
    row = answer_questions(queries, chunks, k, least, model, embed).first()
    return Answer(row.text, [s.asDict() for s in row.sources], row.mode, row.concept)


def search_or_words(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", embedder: Embedder | None = None, k: int = WEB.top_k) -> tuple[DataFrame, str]:
    """The hits of a search, and what the user is told of it.

    Blank queries are refused. Without vectors of the chunks, or if the embedder
    fails, the search goes by words alone.
    """
    asked = queries.withColumn("query_text", js_stripped("query_text")).filter("query_text <> ''")
    if asked.isEmpty():
        return search_web(asked, chunks, "literal", k), NOTICE_BLANK
    if mode == "literal":
        return search_web(asked, chunks, mode, k), ""
    if chunks.filter(F.size("embedding") > 0).isEmpty():
        return search_web(asked, chunks, "literal", k), NOTICE_WORDS
    try:
        if embedder is not None:
            asked = stored(embedded(asked, "query_text", embedder), "asked")
        return search_web(asked, chunks, mode, k), ""
    except Exception as e:  # whatever the engine fails of, words are still searched
        reason = (str(e).strip() or type(e).__name__).splitlines()[0]
        return search_web(asked, chunks, "literal", k), f"{NOTICE_FAILED} {reason}"


def model_from_environment() -> Model | None:
    """The model that QUILLSPAN_LLM_URL and QUILLSPAN_LLM_MODEL name, if they do."""
    url, name = os.environ.get("QUILLSPAN_LLM_URL"), os.environ.get("QUILLSPAN_LLM_MODEL")
    return local_model(url, name) if url and name else None
