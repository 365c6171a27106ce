"""Searching and answering on small hand-made bases."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import answers as A
from quillspan.operators import retrieval as R

CHUNKS = "chunk_id string, source_id string, source_name string, relative_path string, location string, text string, metadata map<string,string>, embedding array<float>"
QUERIES = "query_id bigint, query_text string, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("1", "a", "bandura.txt", "m/bandura.txt", "p1", "El 15 de diciembre de 1973 se presentó el estudio. Albert Bandura dirigió el equipo y mostró el aprendizaje por observación e imitación.", None, [1.0, 0.0]),
        ("2", "b", "otro.txt", "m/otro.txt", "p2", "Las neuronas conectan regiones de la corteza.", {"tema": "cerebro"}, [0.0, 1.0]),
        ("3", "a", "bandura.txt", "m/bandura.txt", "p3", "El aprendizaje por observación requiere atención.", None, None),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def test_hybrid_order(spark, chunks):
    q = spark.createDataFrame([(7, "aprendizaje por observación e imitación", [0.98, 0.02]), (8, "  ", None)], QUERIES)
    hits = R.search_web(q, chunks, "hybrid").orderBy("rank").collect()
    assert {h.query_id for h in hits} == {7}
    assert hits[0].chunk_id == "1" and hits[0].semantic > 0.9 and hits[0].match_kind == "frase"


def test_a_bad_mode_is_refused(spark, chunks):
    with pytest.raises(ValueError):
        R.search_web(spark.createDataFrame([], QUERIES), chunks, "other")


def test_evidence_answer_has_date_and_person(spark, chunks):
    q = spark.createDataFrame([(1, "¿Cuándo presentó Bandura el estudio y quién dirigió el equipo?", None)], QUERIES)
    a = A.evidence_answers(R.search_web(q, chunks, "literal")).first()
    assert a.passages[0].reason == "fecha o momento" and "15 de diciembre de 1973" in a.passages[0].text
    assert any("Bandura" in p.text for p in a.passages)


def test_evidence_window_keeps_the_dated_sentence(spark):
    filler = "Una oración de relleno que no dice nada del asunto. " * 30
    df = spark.createDataFrame([(filler + "El 3 de mayo de 1990 cambió la norma. " + filler, "cuando fecha norma", ["norma"])], "t string, q string, k array<string>")
    assert "3 de mayo de 1990" in R.with_evidence(df, "t", "q", "k").first().evidence


def test_diversity_defers_and_drops_nothing(spark):
    df = spark.createDataFrame([(1, i, "a" if i < 5 else "b") for i in range(7)], "q int, r int, s string")
    got = R.diversified(df, ["q"], F.col("s"), [F.asc("r")], 3).orderBy("place").collect()
    assert [x.r for x in got] == [0, 1, 2, 5, 6, 3, 4]
    assert [x.r for x in R.diversified(df, ["q"], F.col("s"), [F.asc("r")], 0).orderBy("place").collect()] == list(range(7))


def test_threshold_falls_back_to_all(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.9), (2, 0.1)], "q int, s double")
    got = sorted((r.q, r.s) for r in R.above_threshold(df, ["q"], "s", 0.32).collect())
    assert got == [(1, 0.1), (1, 0.2), (2, 0.9)]


def test_desktop_search_and_claims(spark, chunks):
    q = spark.createDataFrame([(1, "aprendizaje por observación", [1.0, 0.0])], QUERIES)
    hits = R.search_desktop(q, chunks)
    assert hits.orderBy("rank").first().chunk_id == "1"
    text = A.extractive_answers(hits).first().text
    assert text.startswith("Con lo que aparece") and "[1]" in text


def test_claims_put_the_dated_answer_first(spark):
    rows = [
        (1, "¿Cuándo se retiró y quién lo retiró?", 1, "El 15 de diciembre de 1973 la asociación presidida por Alfred Freedman retiró el término de su manual de diagnóstico general.", 0.63),
        (1, "¿Cuándo se retiró y quién lo retiró?", 2, "El manual describe muchos otros términos que se usan en la clínica contemporánea y en la enseñanza universitaria.", 0.67),
    ]
    hits = spark.createDataFrame(rows, "query_id int, query string, rank int, snippet string, relevance double")
    got = A.claims(hits).first().claims
    assert "15 de diciembre de 1973" in got[0].claim and got[0].source == 1
    assert "[1]" in A.extractive_answers(hits).first().text


@pytest.mark.parametrize(("q", "want"), [("¿Qué es territorio?", "¿que territorio"), ("construcción de la demanda social", "construccion de la demanda"), ("definición de intervención", "intervencion"), ("cuales son los efectos de la memoria en el aula", None), ("", None)])
def test_concepts(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(A.concept_of("q")).first()[0] == want


def test_what_a_concept_is_called(spark):
    df = spark.createDataFrame([("definición de intervención",), ("el concepto de subjetividad",), ("territori",), ("memoria",)], "q string")
    got = [r.asDict() for r in df.select(A.anchors_of("q").alias("a"), A.concept_variants(A.concept_of("q")).alias("v"), A.expanded_query(A.concept_of("q"), "q").alias("e")).collect()]
    assert got[0]["v"] == ["intervencion", "intervenciones", "intervencional"] and got[0]["e"] == "intervencion intervencion intervenciones intervencional intervencion definición de intervención"
    assert got[1]["v"] == ["subjetividad", "subjetivides"]
    assert got[2]["v"][:2] == ["territorio", "territorial"] and {"territori", "barrio"} <= set(got[2]["a"])
    assert got[3]["a"] == ["memori", "memoria"]


def test_a_query_without_hits_is_told(spark, chunks):
    q = spark.createDataFrame([(1, "corteza", None), (2, "zzz", None)], QUERIES)
    got = {r.query_id: r for r in A.evidence_answers(R.search_web(q, chunks, "literal"), queries=q).collect()}
    assert len(got[1].passages) == 1 and got[2].passages == [] and got[2].caveat.startswith("No apareció evidencia suficiente")


def test_concept_essay(spark):
    rows = [(1, "territorio", 1, "El territorio es un espacio social que los vecinos construyen en la historia del barrio y sus instituciones cercanas.", 0.6)]
    hits = spark.createDataFrame(rows, "query_id int, query string, rank int, snippet string, relevance double")
    text = A.concept_answers(hits).first().text
    assert text.startswith("**Concepto: territorio**") and "espacio social y material" in text and "[1]" in text


def test_cited_sources(spark):
    df = spark.createDataFrame([("ver [2] y [2]",), ("sin citas",)], "t string")
    s = F.array(*[F.struct(F.lit(i).alias("index")) for i in (1, 2)])
    assert [[x[0] for x in r[0]] for r in df.select(A.sources_for_text(F.col("t"), s)).collect()] == [[2], [1, 2]]
