"""Knowledge bases, recognition, whole answers."""

import pytest
from pyspark.sql import functions as F

from quillspan.plans import answering, bases
from quillspan.plans.sync import Catalog
from quillspan.sources.files import pasted_source
from quillspan.sources.recognition import Recogniser, recognised


def test_a_base_from_pasted_text(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    key = bases.create_base(catalog, " Psicología ")
    from pyspark.sql import functions as F

    pasted = pasted_source(spark, " ", "Primer bloque\nen dos líneas.\n\nSegundo bloque.")
    segments = pasted.select(
        F.lit("s").alias("source_id"), "source_name", "source_type", "seg_idx", "text", "location", F.lit(None).cast("string").alias("url"), F.lit(None).cast("map<string,string>").alias("metadata")
    )
    for _ in range(2):
        bases.append_segments(catalog, key, segments)
    rows = catalog.read("base_chunks", bases.CHUNKS).orderBy("location").collect()
    assert [(r.source_name, r.location) for r in rows] == [("Texto pegado", "línea 1"), ("Texto pegado", "línea 4")]
    bases.set_vectors(catalog, key, spark.createDataFrame([(rows[0].chunk_id, [1.0])], "chunk_id string, embedding array<float>"), "m")
    assert bases.list_bases(catalog).first().semantic_model == "m"
    assert sorted(r.embedding is None for r in catalog.read("base_chunks", bases.CHUNKS).collect()) == [False, True]
    bases.delete_base(catalog, key)
    assert [r.name for r in bases.list_bases(catalog).collect()] == [bases.DEFAULT_NAME]


def test_the_first_start_and_the_last_base(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    demo = bases.initialize(catalog)
    assert bases.list_bases(catalog).first().name == bases.DEMO_NAME and catalog.read("base_chunks", bases.CHUNKS).count() == 4
    other = bases.create_base(catalog, "otra")
    assert bases.initialize(catalog) == other
    bases.select_base(catalog, demo)
    assert bases.initialize(catalog) == demo
    with pytest.raises(KeyError):
        bases.select_base(catalog, "none")


def test_recognition_isolates_errors(spark):
    class Echo(Recogniser):
        def prepare(self, language):
            self.language = language

        def recognise(self, image):
            return image.decode(), 91.6

    df = spark.createDataFrame([(1, b"hola"), (2, b"\xff"), (3, None)], "page_number int, image binary")
    got = {r.page_number: r for r in recognised(df, Echo()).collect()}
    assert (got[1].text, got[1].confidence) == ("hola", 92) and "UnicodeDecodeError" in got[2].error and got[3].text == ""
    with pytest.raises(ValueError):
        recognised(df, Echo(), "xx")


CHUNKS = "chunk_id string, source_name string, relative_path string, location string, text string, embedding array<float>"
TEXT = "El territorio es un espacio social que los vecinos construyen en la historia del barrio y sus instituciones cercanas."


def test_whole_answers(spark):
    chunks = spark.createDataFrame([("1", "a.txt", "m/a.txt", "p1", TEXT, [1.0, 0.0]), ("2", "b.txt", "m/b.txt", "p1", "La memoria de trabajo guarda durante la tarea aquella información que el lector necesita para entender lo que sigue.", [0.0, 1.0])], CHUNKS)
    ask = lambda q, v: spark.createDataFrame([(1, q, v)], "query_id bigint, query_text string, embedding array<float>")
    concept = answering.answer_question(ask("territorio", [1.0, 0.0]), chunks)
    assert (concept.mode, concept.concept) == ("concepto local con fuentes", "territorio") and concept.sources[0]["file"] == "a.txt"
    plain = answering.answer_question(ask("cómo guarda la memoria de trabajo aquella información del lector", [0.0, 1.0]), chunks)
    assert plain.mode == "síntesis local extractiva" and plain.sources[0]["file"] == "b.txt"
    told = answering.answer_question(ask("territorio", [1.0, 0.0]), chunks, model=lambda q, s: "Dicho [1].")
    assert (told.text, told.mode, len(told.sources)) == ("Dicho [1].", "modelo local", 1)
    assert answering.answer_question(ask("territorio", [1.0, 0.0]), chunks.limit(0)).mode == "sin resultados"


def test_a_batch_of_questions(spark):
    chunks = spark.createDataFrame([("1", "a.txt", "m/a.txt", "p1", TEXT, [1.0, 0.0])], CHUNKS)
    asked = spark.createDataFrame([(1, "territorio", [1.0, 0.0]), (2, "qué construyen los vecinos en la historia del barrio", [1.0, 0.1]), (3, " ", None), (4, "algo sin vector que sirva para buscar", None)], "query_id bigint, query_text string, embedding array<float>")
    got = {r.query_id: r for r in answering.answer_questions(asked, chunks).collect()}
    assert [got[i].mode for i in (1, 2, 3, 4)] == ["concepto local con fuentes", "síntesis local extractiva", "sin resultados", "sin resultados"]
    assert got[2].sources[0].file == "a.txt" and got[4].sources == []
    told = {r.query_id: r.text for r in answering.answer_questions(asked, chunks, model=lambda q, s: f"{q[:20]} [{len(s)}]").collect()}
    assert told[1] == "Defini conceptualmen [1]" and told[2] == "qué construyen los v [1]"


def test_search_falls_back_to_words(spark):
    from quillspan.sources.embedder import Embedder

    class Broken(Embedder):
        def prepare(self):
            raise RuntimeError("no model")

        def embed(self, texts):
            return []

    rows = [("1", "s", "a.txt", "p1", TEXT, None, [1.0, 0.0])]
    schema = "chunk_id string, source_id string, source_name string, location string, text string, metadata map<string,string>, embedding array<float>"
    chunks, bare = spark.createDataFrame(rows, schema), spark.createDataFrame([(*rows[0][:6], None)], schema)
    asked = spark.createDataFrame([(1, " territorio ", [1.0, 0.0])], "query_id bigint, query_text string, embedding array<float>")
    hits, notice = answering.search_or_words(asked, chunks)
    assert notice == "" and hits.first().semantic == 1.0
    for base, embedder, said in ((bare, None, "La búsqueda se resolvió por palabras"), (chunks, Broken(), "No pude usar el motor conceptual")):
        hits, notice = answering.search_or_words(asked, base, "semantic", embedder)
        assert notice.startswith(said) and hits.first().semantic == 0.0 and hits.first().lexical > 0
    hits, notice = answering.search_or_words(asked.withColumn("query_text", F.lit("  ")), chunks)
    assert notice.startswith("Escribí") and hits.count() == 0


def test_only_a_local_model_is_asked():
    assert answering.is_local("http://[::1]:1234/v1") and not answering.is_local("http://localhost.example.com")
    with pytest.raises(ValueError):
        answering.local_model("http://example.com", "m")
    assert answering.local_model("http://127.0.0.1:9/v1", "m", 0.5)("q", ["s"]) is None
