"""Wrong encodings, scanned pages, subjects."""

import random

import pytest

from quillspan.llm import mojibake as M
from quillspan.llm import scans, subjects

SENTENCES = [
    "La situación económica de la región cambió según el informe técnico.", "El niño pequeño pidió más información sobre el árbol.", "También señaló que la acción política fue rápida y única.",
    "La canción del compás ternario sonó en la función de la tarde.", "«¿Qué pasó?», preguntó la señora con atención.", "El análisis lingüístico resultó útil para la comisión.",
]
SEGMENTS = "segment_id bigint, text string, damaged boolean"


@pytest.fixture(scope="module")
def repaired(spark):
    rng = random.Random(1)
    whole = [" ".join(rng.sample(SENTENCES, 3)) for _ in range(300)]
    rows = {i: t for i, t in enumerate(whole)}
    truth = {}
    for i, (true, wrong) in enumerate([("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1253"), ("utf-8", "latin-1")] * 3):
        k, text = 1000 + i, SENTENCES[i % 5]
        truth[k] = text
        rows[k] = text.encode(true).decode(wrong, errors="replace" if wrong == "cp1252" else "strict")
    rows[2000] = SENTENCES[0].encode().decode("cp1252").encode().decode("cp1252")
    truth[2000] = SENTENCES[0]
    rows[2001] = "Revisi�n de la edici�n"
    sound = {3000: "El original ruso dice «память и обучение» (pág. 5).", 3001: "Précio 28 € ½ beca ± 9 α ≈ β", 3002: None, 3003: "", 3004: "plain text", 3005: "├──┤ │ La │", 3006: "La situación"}
    rows |= sound
    listed = [(k, t, True) for k, t in rows.items()] + [(3006, rows[3006], False)]
    got = {r.segment_id: r for r in M.restored_texts(spark.createDataFrame(listed, SEGMENTS)).collect()}
    return rows, truth, sound, got


def test_damage_is_found_and_undone(repaired):
    rows, truth, _, got = repaired
    assert all(got[k].damaged for k in truth if rows[k] != truth[k])
    right = sum(got[k].text == truth[k] for k in truth)
    assert right >= 0.9 * len(truth)


def test_sound_texts_stay(repaired):
    rows, truth, sound, got = repaired
    assert [k for k in rows if k not in truth and k != 2001 and (got[k].damaged or got[k].text != rows[k])] == []
    assert got[2001].damaged and len(got) == len(rows)


def test_nothing_to_restore(spark):
    assert M.damaged_rows(spark.createDataFrame([], SEGMENTS)).count() == 0
    assert M.damaged_rows(spark.createDataFrame([(1, None, None), (2, "x" * 100_000, None), (3, "漢字か" * 30_000, None)], SEGMENTS)).count() == 0


def test_runs_are_maximal_segments():
    model = M.PairModel({"ab": 50, "ba": 50, " a": 20, "b ": 20, "aé": 30, "éb": 30})
    assert M.improbable_runs("abaéb", model) == []
    (start, end), *more = M.improbable_runs("abÃ©b", model)
    assert start <= 2 and end >= 4 and not more


def test_words_of_any_length_are_restored_whole():
    import time

    counts = {}
    for t in SENTENCES * 50:
        for x, y in zip(f" {t}", f"{t} "):
            counts[x + y] = counts.get(x + y, 0) + 1
    restorer = M.Restorer(M.PairModel(counts))
    for shift in range(8):
        true = "x" * (250 + shift) + "situación" + "-" * 300 + "región"
        assert restorer.restored(true.encode().decode("cp1252")) == (true, True)
    began = time.process_time()
    for word in ("Ã³n" * 20_000, "aé" * 30_000, "漢字か" * 20_000, "éa漢" * 20_000):
        restorer.restored(word)
    assert time.process_time() - began < 60


PAGES = "page_id bigint, scan_id string, page_number int, text string, confidence double, state string"
WORDS = "the committee reviewed information about regional development and approved several important measures during the annual meeting".split()


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(4)
    rows, page = [], 0
    for scan in range(6):
        for number in range(1, 8):
            body = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(14)]
            if number == 3:
                body[4] = "The meeting was about the infor-"
                body[5] = "mation and the long-"
                body[6] = "term comm1ttee in the meeting of today."
            if number == 4:
                body[-1] = "It ended with the annual develop-"
            if number == 5:
                body[0] = "ment and the long-term measures of the committee."
            if number == 6:
                body[7] = "1959"
                body[6] = body[8] = ""
            text = "\n".join([f"ANNUAL REPORT {scan}", "", *body[:7], "", *body[7:], "", f"- {number + 10} -"])
            rows.append((page, f"s{scan}", number, text, None, "x"))
            page += 1
    rows += [rows[0], (900, "s0", 8, None, 1.0, "x"), (901, "s0", 9, "", None, "x"), (902, None, None, "lone page\nwith text.", None, None)]
    df = spark.createDataFrame(rows, PAGES)
    return df, {(r.page_id, r.line_no, r.noise) for r in scans.page_noise(df).collect()}


def test_headers_and_page_numbers(noisy):
    _, found = noisy
    assert all((p, 1, "header") in found for p in range(42))
    last = {p: max(line for q, line, n in found if q == p and n == "page_number") for p in range(42)}
    assert set(last.values()) == {19}
    assert not [x for x in found if x[2] == "page_number" and x[1] != 19]


def test_divided_and_misread_words(noisy):
    _, found = noisy
    for scan in range(6):
        p = scan * 7 + 2
        assert (p, 7, "hyphen") in found and (p, 8, "hyphen") not in found
        assert (p, 9, "misread") in found
        assert (scan * 7 + 3, 17, "hyphen") in found
    assert sum(n == "misread" for _, _, n in found) == 6


def test_paragraphs_read_on(noisy):
    df, _ = noisy
    got = [r for r in scans.page_paragraphs(df).orderBy("scan_id", "paragraph_no").collect() if r.scan_id == "s1"]
    text = "\n".join(r.text for r in got)
    assert "about the information and the long-term committee in" in text
    assert "annual development and the long-term measures" in text
    assert "ANNUAL REPORT" not in text and "- 12 -" not in text


def test_paragraphs_read_on_from_one_run_of_pages_to_the_next(spark):
    rng = random.Random(5)
    rows = []
    for number in (*range(60, 68), *range(190, 194)):
        body = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(12)]
        if number in (63, 191):
            body[-1] = "It ended with the annual develop-"
        if number in (64, 192):
            body[0] = "ment and the regional measures of the committee."
        if number == 66:
            body[-1] = "The committee approved"
        if number == 67:
            body[0] = "several measures during the meeting."
        rows.append((number, "long", number, "\n".join([*body[:6], "", *body[6:]]), None, None))
    got = sorted(scans.page_paragraphs(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r.paragraph_no)
    assert [r.paragraph_no for r in got] == list(range(1, len(got) + 1))
    assert [r.page_id for r in got if "annual development and the regional measures" in r.text] == [63, 191]
    assert [r.page_id for r in got if "committee approved several measures" in r.text] == [66]
    assert len(got) == 2 * len(rows) - 3


def test_every_header_of_a_long_scan_is_known(spark):
    rng = random.Random(6)
    chapters = ["Aguas del Norte", "Biblioteca y Museo", "Codigo Minero", "Derechos Humanos", "Economia Rural", "Fiestas Patrias", "Gremios Textiles", "Historia Oral", "Industria Naval", "Jardines Publicos", "Kioscos y Prensa", "Lenguas Vivas", "Quechua Zonal", "Oficios Viejos"]
    rows = []
    for number in range(1, 141):
        chapter = (number - 1) // 10
        header = chapters[chapter]
        if number % 10 == 5:
            header = header[:3] + "!" + header[4:]
        # the page numbers begin anew with each chapter
        body = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(12)]
        rows.append((number, "long", number, "\n".join([header, "", *body, "", f"{(number - 1) % 10 + 1 + 17 * chapter % 5}"]), None, None))
    found = {(r.page_id, r.line_no, r.noise) for r in scans.page_noise(spark.createDataFrame(rows, PAGES)).collect()}
    assert [p for p in range(1, 141) if (p, 1, "header") not in found] == []
    assert [p for p in range(1, 141) if (p, 16, "page_number") not in found] == []


def test_words_divided_after_an_accented_letter_at_a_page_end(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    halves = {2: ("subsí-", "dio"), 4: ("antibió-", "ticos"), 6: ("PRÓ-", "ximo"), 8: ("informa\u00adção¬", "zinha")}
    rows = []
    for number in range(1, 11):
        body = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(12)]
        if number in halves:
            body[-1] = f"It ended with the annual {halves[number][0]}"
        if number - 1 in halves:
            body[0] = f"{halves[number - 1][1]} and the long measures of the committee."
        rows.append((number, "s", number, "\n".join(body), None, None))
    df = spark.createDataFrame(rows, PAGES)
    found = {(r.page_id, r.line_no) for r in scans.page_noise(df).collect() if r.noise == "hyphen"}
    assert found == {(p, 12) for p in halves}
    assert any("the annual subsídio and the long" in r.text for r in scans.page_paragraphs(df).collect())
    # both patterns take the same lines
    lines = ["subsí-", "a-", "ñ¬ \t", "é-\r", "é-\u00a0", "é-\u2028", "5-", "_-", "½-", "Ж‐", "漢‑", "-", "é - ", "", "é-x"]
    seen = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.col("x").rlike(scans._HYPHEN_JAVA).alias("hit")).collect()
    assert {r.x: r.hit for r in seen} == {x: bool(scans._HYPHEN.search(x)) for x in lines}


def test_divided_words_go_on_after_many_empty_pages(spark):
    rng = random.Random(8)
    rows = []
    for number in (1, 2, 3, 4, 9, 10, 60, 61, 62, 300, 301):
        body = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(12)]
        if number in (4, 10, 62):
            body[-1] = "It ended with the annual develop-"
        if number in (9, 60, 300):
            body[0] = "ment and the regional measures of the committee."
        rows.append((number, "s", number, "\n".join(body), None, None))
    rows += [(1000 + n, "s", n, text, None, None) for n, text in ((5, ""), (6, None), (7, "  "), (8, ""), (63, None), (64, ""), (200, None))]
    df = spark.createDataFrame(rows, PAGES)
    found = {(r.page_id, r.line_no) for r in scans.page_noise(df).collect() if r.noise == "hyphen"}
    assert found == {(4, 12), (10, 12), (62, 12)}
    assert sum("annual development and the regional" in r.text for r in scans.page_paragraphs(df).collect()) == 3


def test_a_very_long_page_among_short_ones():
    rng = random.Random(0)
    import numpy as np

    pages = [np.array([[rng.randrange(n) for n in scans._SIZES] for _ in range(k)], np.uint8).reshape(-1, 6) for k in (3, 30_000, 0, 1, 12)]
    model = scans.initial_tables()
    together = scans.best_paths(pages, model)
    assert [len(p) for p in together] == [3, 30_000, 0, 1, 12]
    for page, path in zip(pages, together):
        assert (scans.best_paths([page], model)[0] == path).all()


def test_pages_without_text(spark):
    assert scans.page_noise(spark.createDataFrame([], PAGES)).count() == 0
    assert scans.page_noise(spark.createDataFrame([(1, "s", None, None, None, None), (2, None, 3, "", None, None)], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("line", "numbers"),
    [("12", (12,)), ("- l9 -", (19,)), ("[3]", (3,)), ("Pág. 7", (7,)), ("Page 88", (88,)), ("213).", ()), ("(B99).", ()), ("palabra", ()), ("12 LA GUERRA", ()), ("vii", (7,)), ("- xiv -", (14,)), ("XL", (40,)), ("I", (1,)), ("iiii", ()), ("mil", ()), ("Vi", ()), ("p. ix", (9,)), ("II", (2, 11)), ("", ())],
)
def test_page_numbers(line, numbers):
    assert scans.page_numbers(line) == numbers


def test_confusions_are_learnt_from_the_corpus(spark):
    rng = random.Random(9)
    syllables = ["ma", "te", "ri", "so", "lu", "ca", "do", "ne", "pa", "vi"]
    known = {"".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))): rng.randint(100, 900) for _ in range(150)}
    counts = dict(known)
    for w, n in known.items():
        for i, c in enumerate(w):
            if c == "e" and n > 200:  # e is read as c wherever it stands
                counts.setdefault(w[:i] + "c" + w[i + 1 :], rng.randint(1, 3))
        if w.endswith("o") and n > 850:  # a few words have a rare form of their own
            counts.setdefault(w[:-1] + "a", 40)
    some = max(w for w in known if "a" in w and len(w) > 5)
    counts[some.replace("a", "@", 1)] = 1
    df = spark.createDataFrame([*counts.items(), ("12", 900), ("x" * 500, 800), ("y", 1000)], "word string, n bigint")
    learnt = scans.learnt_confusions(df)
    assert ("e", False) in learnt["c"] and ("a", False) in learnt["@"]
    assert "o" not in [r for r, _ in learnt.get("a", [])]
    wrong = {r.word: r.right for r in scans.misread_words(df).collect()}
    assert wrong[some.replace("a", "@", 1)] == some and not set(known) & set(wrong)
    assert scans.learnt_confusions(df.limit(0)) == {}


def test_pages_with_roman_numbers(spark):
    rng = random.Random(10)
    rows = []
    for number, numeral in enumerate(("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"), 1):
        body = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(12)]
        if number == 4:
            body[-1] = "It ended with the annual develop-"
        if number == 5:
            body[0] = "ment and the regional measures of the committee."
        rows.append((number, "s", number, "\n".join([*body, "", numeral]), None, None))
    found = {(r.page_id, r.line_no, r.noise) for r in scans.page_noise(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {(p, 14, "page_number") for p in range(1, 11)} | {(4, 12, "hyphen")}


def test_pages_without_scan_or_number_stand_alone(spark):
    body = "The committee reviewed information about regional development and approved"
    rows = [(1, None, None, body, None, None), (2, None, None, "several measures.", None, None), (3, None, 5, body, None, None), (4, None, 6, "other measures.", None, None), (5, "s", None, body, None, None), (6, "s", None, "more measures.", None, None), (7, "s", 1, "During the annual meeting several measures were", None, None), (8, "s", 2, "last measures.", None, None)]
    got = sorted((r.page_id, r.paragraph_no, r.text.split()[-1]) for r in scans.page_paragraphs(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(1, 1, "approved"), (2, 1, "measures."), (3, 1, "approved"), (4, 1, "measures."), (5, 1, "approved"), (6, 1, "measures."), (7, 1, "measures.")]


SUBJECTS = {"law": "juez contrato sentencia demanda tribunal embargo", "sport": "arquero gol pelota cancha torneo equipo", "music": "sonata compas arpegio acorde oboe cadencia"}


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(2)

    def sentence(s):
        own = [rng.choice(SUBJECTS[s].split()) for _ in range(4)] if s else ["aviso", "cartelera", "aula", "lunes"]
        return "El " + " de la ".join(own) + " en la sede."

    docs, truth, labels = [], {}, []
    for i in range(600):
        kinds = rng.choice([["law"], ["sport"], ["music"], ["law", "music"], [None]])
        docs.append((i, " ".join(sentence(rng.choice(kinds)) for _ in range(8)), "x"))
        seen = [k for k in kinds if k]
        truth[i] = set(seen)
        if i % 5 == 0:
            labels += [(i, s.upper() + " ", "a") for s in seen]
    docs += [(900, None, "x"), (901, "", "x"), (902, "   ", None), (903, sentence("sport") * 30_000, "x")]
    truth[903] = {"sport"}
    labels += [(0, "astrology", "b"), (3, None, "b")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    s = spark.createDataFrame([(k, k) for k in SUBJECTS] + [(None, "x")], "subject string, description string")
    got = {}
    for r in subjects.document_subjects(d, s, spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in range(600) if i % 5]
    assert sum(got.get(i, set()) == truth[i] for i in held) >= 0.93 * len(held)
    assert not {900, 901, 902} & set(got) and got[903] == {"sport"}


def test_subjects_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    s = spark.createDataFrame([("law",)], "subject string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects.document_subjects(d, s, labels).count() == 0
    assert subjects.document_subjects(spark.createDataFrame([(1, "algo de texto aqui"), (2, "algo de texto aqui")], "doc_id bigint, text string"), s, labels).count() == 0
