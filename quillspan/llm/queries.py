"""The queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import capping, encoding, mojibake, near_duplicates, neighbours, packing, scans, splitting, subjects
from quillspan.plans.lineage import stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.natural_starts(_table(spark, d, "source_chunks"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = _table(spark, d, "source_chunks").select("base_id", "source_id", "chunk_id", "chunk_index", "text", "location")
    return splitting.split_oversized(chunks)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_rows(_table(spark, d, "segments"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_texts(_table(spark, d, "segments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.results_over_cap(_table(spark, d, "search_results"), _table(spark, d, "manifest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.page_noise(_table(spark, d, "ocr_pages"))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.page_paragraphs(_table(spark, d, "ocr_pages"))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(_table(spark, d, "source_chunks"), shingle=3, similarity=0.7, least_words=20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(*_near(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = _near(spark, d)
    return near_duplicates.near_duplicate_groups(members, stored(pairs, "pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.similar_rows(_table(spark, d, "source_chunks")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(_table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(_table(spark, d, "documents"), _table(spark, d, "subjects"), _table(spark, d, "subject_labels"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_composition(_table(spark, d, "documents"), p9_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_restored, p3_found, p4_found, p4_paragraphs, p5_found, p5_groups, p6_found, p7_ids, p8_containers, p9_found, p9_composition)
}
ORACLE: dict[str, str] = {}
