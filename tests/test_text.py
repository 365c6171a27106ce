"""Scalar functions against stated cases and plain-Python models."""

import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from quillspan.functions import scoring as S
from quillspan.functions import text as X
from quillspan.functions.tokens import stem_desktop, stem_web, tokens_desktop, tokens_web
from quillspan.profiles import DESKTOP_STOP_WORDS


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_folding_of_both_profiles(spark):
    assert column(spark, ["Psicología—COMUNITARIA", "a·b", "straße ½ ﬁn", None, ""], X.normalize_desktop) == ["psicologia comunitaria", "a b", "stra e 1 2 fin", None, ""]
    assert column(spark, ["Psicología—COMUNITARIA", "a·b", "straße", "память"], X.normalize_web) == ["psicologia comunitaria", "ab", "straße", "память"]


def test_folding_equals_a_plain_model(spark):
    rng = random.Random(3)
    letters = "aZ9 _-.ñÑáéíóúüçãõàâêôöøœß½…“”«»ÁÉπд\n\t éñﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(200)]

    def model(t):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return re.sub(r"[^a-zA-Z0-9]+", " ", plain).lower().strip()

    assert column(spark, texts, X.normalize_desktop) == [model(t) for t in texts]


def test_stems(spark):
    words = ["intervenciones", "intervencion", "demandas", "actores", "mes", "tres"]
    assert column(spark, words, stem_desktop) == ["intervenccion", "intervencion", "demanda", "actor", "mes", "tres"]
    assert column(spark, ["claramente"], stem_web) == ["clara"]


def test_tokens_drop_stop_words_before_stemming(spark):
    got = column(spark, ["¿Qué es el territorio y cómo se construyen las demandas?"], tokens_desktop)[0]
    assert got == ["territorio", "construyen", "demanda"]
    assert "este" in DESKTOP_STOP_WORDS
    assert column(spark, ["la el los", None], tokens_web)[0] == []


def test_clean_text_and_blocks(spark):
    assert column(spark, ["  a  b \r\n\n c d e "], X.clean_text) == ["a b\nc\nd e"]


def test_snippets(spark):
    long = "x" * 1500
    got = column(spark, [long, " corto "], X.trim_snippet)
    assert got == ["x" * 1399 + "...", "corto"]


def test_source_keys(spark):
    df = spark.createDataFrame([("Materia/Copia de Territorio 1.pdf",), ("Materia/Territorio.pdf",), ("",)], "p string")
    keys = [r.k for r in df.select(X.canonical_source_key("p", F.lit(""), F.lit("f.txt")).alias("k")).collect()]
    assert keys[0] == keys[1] == "materia territorio pdf"
    assert keys[2] == "f txt"


def test_chunk_uuid_equals_the_standard_one(spark):
    df = spark.createDataFrame([("/a/ñ.pdf", "abc", 3)], "p string, h string, i int")
    got = df.select(X.chunk_uuid("p", "h", "i")).first()[0]
    assert got == uuid.uuid5(uuid.NAMESPACE_URL, "/a/ñ.pdf::abc::3").hex


def test_local_urls(spark):
    urls = ["http://127.0.0.1:1234/v1", "http://localhost", "https://[::1]:8080/x", "http://example.com", "file:///etc", "http://localhost.example.com", None, "nonsense"]
    assert column(spark, urls, X.is_local_url) == [True, True, True, False, False, False, False, False]


def test_ocr_text(spark):
    assert column(spark, ["Primera   línea\r\n\r\n\r\nSegunda línea  "], X.normalize_ocr) == ["Primera línea\n\nSegunda línea"]
    assert column(spark, ["12", "palabra " * 12, None], X.page_needs_ocr) == [True, False, True]


def test_rtf_and_markup(spark):
    assert column(spark, [r"{\rtf1\b Hola\'e1 mundo\}}"], X.strip_rtf_web) == ["Hola mundo\\"]
    assert column(spark, ["<html><head><title>t</title></head><body><p>a &amp; b</p></body></html>"], X.html_text) == ["a & b"]


def test_markup_of_all_documents_equals_a_parser(spark, tmp_path):
    from html.parser import HTMLParser

    class Body(HTMLParser):
        def __init__(self, inside):
            super().__init__()
            self.text, self.inside = "", inside

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "body"

        def handle_endtag(self, tag):
            self.inside &= tag != "body"

        def handle_data(self, data):
            self.text += data if self.inside else ""

    texts = [
        "<html><head><title>t</title></head><body class='x'><p>caf&eacute; &#243; &#xF1; &amp;lt; &lt;b&gt;</p></body></html>", "<HTML><title>t</title><BODY>uno<br>dos &nbsp;&hellip;\n", "<title>t</title><body></body>",
        "AT&T &copy; R&D a<!-- <b>x</b> & --> b", "sin marcas", "", "2 < 3 & 4 > 1", "&Ntilde;and&uacute; &iquest;qu&eacute;? &euro; &ldquo;s&iacute;&rdquo;",
    ]
    rows = [*enumerate(texts), (99, None)]
    got = {r.doc_id: r.plain for r in spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", X.html_text("text").alias("plain")).collect()}
    want = {99: None}
    for i, text in enumerate(texts):
        parser = Body("<body" not in text.lower())
        parser.feed(text)
        parser.close()
        want[i] = parser.text
    assert got == want


def test_highlighting_escapes_first(spark):
    got = column(spark, ["<b>Memoria</b> y memorias"], lambda c: X.highlighted(c, ["memoria"]))[0]
    assert got == "&lt;b&gt;<mark>Memoria</mark>&lt;/b&gt; y memorias"


def test_paths_and_names(spark):
    df = spark.createDataFrame([("/r/materia/nota.md",), ("/root2/x.md",), ("/r",)], "p string")
    got = df.select(X.safe_relative("p", F.lit("/r")).alias("a"), X.path_is_inside("p", F.lit("/r")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("materia/nota.md", True), ("x.md", False), (".", True)]
    assert column(spark, ["Psicología: Año 1", "¿?"], X.safe_file_name) == ["psicologia-ano-1", "base"]


@pytest.mark.parametrize("profile", ["desktop", "web"])
def test_coverage_orders_texts(spark, profile):
    q = "psicología comunitaria" if profile == "desktop" else "práctica memoria"
    texts = ["La psicología comunitaria estudia", "La psicología clínica"] if profile == "desktop" else ["La práctica distribuida favorece la memoria de largo plazo.", "Revisión clínica."]
    df = spark.createDataFrame([(q, t) for t in texts], "q string, t string")
    if profile == "desktop":
        n, m = X.normalize_desktop("q"), X.normalize_desktop("t")
        score = S.keyword_overlap(n, tokens_desktop("q", n), m, tokens_desktop("t", m))
        want = [1.0, 0.5]
    else:
        n, m = X.normalize_web("q"), X.normalize_web("t")
        score = S.lexical_score(n, tokens_web("q", n), m, tokens_web("t", m))
        want = [0.72 + 0.28 * 2 / 6, 0.0]
    assert [r[0] for r in df.select(score).collect()] == pytest.approx(want)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([-1.0, 0.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(S.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_intents_and_dates(spark):
    texts = ["El 15 de diciembre de 1973 Albert Bandura acepta.", "En 1973 pasó", "nada"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(S.date_precision(F.col("t")).alias("d"), S.named_persons(F.col("t")).alias("p"), S.evidence_intent_bonus(F.lit("cuando y quien cambio"), F.col("t"), X.normalize_web("t")).alias("b")).collect()
    assert [r.d for r in got] == [2, 1, 0]
    assert [r.p for r in got] == [1, 0, 0]
    assert [r.b for r in got] == pytest.approx([0.34, 0.08, 0.0])
