"""python -m quillspan.cli index|search|answer|warmup ..."""

from __future__ import annotations

import argparse
import importlib
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.plans.sync import CHUNKS, Catalog, sync_index
from quillspan.profiles import DESKTOP
from quillspan.sources.embedder import Embedder, embedded

QUERY = "query_id bigint, query_text string, embedding array<float>"


def named_embedder(name: str | None) -> Embedder | None:
    """The embedder that ``module:Class`` names; None without a name."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def searchable(catalog: Catalog, embedder: Embedder | None) -> DataFrame:
    """The chunks of an index with the columns that searching reads, and with vectors if there is an embedder."""
    chunks = catalog.read("chunks", CHUNKS).withColumn("source_id", F.col("source_path")).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    if embedder is None:
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    return embedded(chunks, "text", embedder)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspan")
    parser.add_argument("--index", default="quillspan-index")
    parser.add_argument("--embedder", default=os.environ.get("QUILLSPAN_EMBEDDER"), help="module:Class of an Embedder")
    verbs = parser.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index")
    index.add_argument("--root", required=True)
    index.add_argument("--reindex", action="store_true")
    for name in ("search", "answer"):
        v = verbs.add_parser(name)
        v.add_argument("query")
        v.add_argument("--top-k", type=int, default=DESKTOP.top_k)
        v.add_argument("--min-relevance", type=float, default=DESKTOP.least_score)
    verbs.add_parser("warmup")
    known = parser.parse_args(args)
    embedder = named_embedder(known.embedder)
    if known.verb == "warmup":
        if embedder is None:
            print("no embedder is named; searches go by words")
            return 1
        began = time.time()
        embedder.prepare()
        print({"dimensions": int(len(embedder.embed(["prueba"])[0])), "seconds": round(time.time() - began, 3)})
        return 0
    spark = SparkSession.builder.appName("quillspan").getOrCreate()
    if known.verb == "index":
        print(sync_index(spark, known.root, known.index, known.reindex))
        return 0
    from quillspan.operators.answers import evidence_answers
    from quillspan.plans import answering

    chunks = searchable(Catalog(spark, known.index), embedder)
    queries = spark.createDataFrame([(0, known.query, None)], QUERY)
    if known.verb == "answer" and embedder is not None:
        embedder.prepare()
        asked = embedded(queries, "query_text", embedder)
        answer = answering.answer_question(asked, chunks, known.top_k, known.min_relevance, answering.model_from_environment(), lambda t: embedder.embed([t])[0])
        print(answer.text)
        for s in answer.sources:
            print(f"[{s['index']}] {s['file']}, {s['location']} ({s['relevance']:.2f})")
        return 0
    hits, notice = answering.search_or_words(queries, chunks, "hybrid", embedder, known.top_k)
    if notice:
        print(notice)
    if known.verb == "search":
        hits.select("rank", "source_name", "location", F.round("score", 3).alias("score"), "evidence").orderBy("rank").show(known.top_k, truncate=120)
    else:
        answer = evidence_answers(hits, queries=queries).first()
        for p in answer.passages:
            print(f"- {p.text} ({p.reason})")
        print(answer.caveat)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
