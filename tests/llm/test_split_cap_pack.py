"""Splitting, capping, packing and encoding."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import capping, encoding, packing, splitting
from quillspan.llm.boundaries import boundaries
from quillspan.llm.filenames import candidate_keys, spelling_key
from quillspan.llm.lexicon import Lexicon, compile_lexicon

TEXT = (
    "3.4 Un nicho\n\nSegún Pérez (1902), el ciclo p. ej. de la Dra. Gómez\npolariza el cultivo… rara vez ocurre. «¿Por qué?», pregunta G. Ruiz.\n"
    "- Uno, dos, etc\n- Tres\n\n¿Sí? No. «Cita.» Fin (cf. cap. 19, fig. 17.309). Otra vez"
)


def starts(text):
    return [text[b.position :].split("\n")[0][:6] for b in boundaries(text)]


def test_natural_boundaries():
    assert starts(TEXT) == ["3.4 Un", "Según ", "«¿Por ", "- Uno,", "- Tres", "¿Sí? N", "No. «C", "«Cita.", "Fin (c", "Otra v"]
    assert boundaries(None) == boundaries("  \n ") == []
    assert [b.position for b in boundaries("  uno solo")] == [2]


def test_a_break_inside_a_sentence_begins_nothing():
    assert len(boundaries("La tabla\n278 resume (véase pág.\n213). Según Pérez\n(1990) todo")) == 2


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abC. \n¿?-;", max_size=900), st.integers(20, 120), st.integers(0, 60))
def test_pieces_fit_and_cover(text, limit, overlap):
    overlap = min(overlap, limit // 2)
    got = splitting.pieces(text, limit, overlap)
    bare = text.strip()
    if not bare:
        assert got == []
        return
    first = len(text) - len(text.lstrip())
    assert got[0][2] == first and got[-1][3] == len(text.rstrip())
    for (_, s, b, e), following in zip(got, [*got[1:], None]):
        assert s <= b <= e and e - s <= limit
        if following:
            assert text[e : following[2]].strip() == "" and following[1] >= b and following[2] - following[1] <= overlap


def test_pieces_of_a_text_without_any_boundary():
    got = splitting.pieces("x" * 5000)
    assert max(e - s for _, s, _, e in got) <= 1050 and sum(e - b for _, _, b, e in got) == 5000
    with pytest.raises(ValueError):
        splitting.pieces("x", 10, 10)


CHUNKS = "base_id string, source_id string, chunk_id string, chunk_index int, text string, location string, chunk_part string"


def test_split_oversized_renumbers(spark):
    long = "La frase número uno dice algo largo y claro. " * 60
    rows = [("b", "s", "c2", 5, long, "p5", "x"), ("b", "s", "c1", 1, "corto", None, "x"), ("b", "s", "c1", 1, "corto", None, "x"), ("b", "s", "c3", None, None, "p", "x"), ("b", None, "c4", 3, long, None, "x"), ("b", "s", "c5", 2000, "", "q", "x")]
    got = splitting.split_oversized(spark.createDataFrame(rows, CHUNKS)).orderBy("source_id", "chunk_index").collect()
    mine = [r for r in got if r.source_id == "s"]
    assert [r.chunk_index for r in mine] == list(range(len(mine)))
    assert [r.chunk_id for r in mine][:2] == ["c3", "c1"] and mine[-1].chunk_id == "c5"
    parts = [r for r in got if r.chunk_id == "c2"]
    assert [r.location for r in parts] == [f"p5, parte {i}" for i in range(1, len(parts) + 1)]
    assert all(len(r.text) <= 1050 for r in parts) and len(parts) in (3, 4)
    assert [r.location for r in got if r.source_id is None][0] == "parte 1"
    assert splitting.split_oversized(spark.createDataFrame([], CHUNKS)).count() == 0


def test_natural_starts(spark):
    rows = [("a", "x. Y " * 300), ("a", "x. Y " * 300), ("b", " " * 2000 + "corto"), ("c", None)]
    got = splitting.natural_starts(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    assert {r.chunk_id for r in got} == {"a"} and len(got) == 301


def brute_over_cap(rows, cap):
    groups = {}
    for g, i, s in rows:
        groups.setdefault(g, []).append((-s if s is not None and s == s else float("inf"), i))
    return sorted((g, i) for g, xs in groups.items() for _, i in sorted(xs)[cap:])


@pytest.mark.parametrize("cap", [0, 1, 3])
def test_capping_equals_brute_force(spark, cap):
    rng = random.Random(cap)
    scores = [None, float("nan"), 0.5, 0.5, 0.25, 0.7, 0.70001, -3.0, 1e300, float("inf"), float("-inf")]
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.choice([*scores, rng.random()])) for i in range(400)]
    df = spark.createDataFrame([(g, i, s, "x") for g, i, s in rows], "g int, id bigint, s double, salt string")
    got = sorted(((r.g, r.id) for r in capping.over_cap(df, ["g"], "id", "s", cap, 4).collect()), key=repr)
    # the two infinities are the outermost numbers
    want = brute_over_cap([(g if g is not None else 0, i, max(-1.7e308, min(1.7e308, s)) if s is not None and s == s else None) for g, i, s in rows], cap)
    assert got == sorted(((g or None, i) for g, i in want), key=repr)


def test_capping_one_hot_group_of_equal_scores(spark):
    df = spark.range(5000).select(F.lit("q").alias("g"), "id", F.lit(1.0).alias("s"))
    assert sorted(r.id for r in capping.over_cap(df, ["g"], "id", "s", 3).collect()) == list(range(3, 5000))
    empty = spark.createDataFrame([], "g string, id bigint, s double")
    assert capping.over_cap(empty, ["g"], "id", "s", 3).count() == 0


def test_names_of_copies():
    manifest = {spelling_key(n) for n in ("La cadena trófica - Unidad 2.pdf", "Compendio general.pdf")}
    for name in ("Copia de La cadena trófica - Unidad 2.pdf", "la_cadena_trofica_-_unidad_2 (1).PDF", "LA CADENA TRÓFICA - UNIDAD 2 1.pdf", "La  cadena trófica - Unidad 2 - copia .pdf", "Copy of La cadena trófica - Unidad 2 (2) 1.pdf"):
        assert next(k for k in candidate_keys(name) if k in manifest) == "la cadena trofica - unidad 2.pdf"
    assert candidate_keys(None) == candidate_keys("  ") == []


def test_results_over_cap_reads_copies_and_paths(spark):
    names = ["a b.pdf", "Copia de a b.pdf", None, " ", "A B (1).pdf", "otro.pdf"]
    rows = [(i, 1, n, "x/a_b.pdf" if i in (2, 3) else None, None, 0.5, "c") for i, n in enumerate(names)] + [(4, 1, "A B (1).pdf", None, None, 0.5, "c")]
    df = spark.createDataFrame(rows, "result_id bigint, query_id bigint, file_name string, relative_path string, source_path string, relevance double, file_key string")
    m = spark.createDataFrame([("a b.pdf",), ("otro.pdf",), (None,)], "source_name string")
    assert sorted(r.result_id for r in capping.results_over_cap(df, m).collect()) == [3, 4]
    assert sorted(r.result_id for r in capping.capped_results(df, m).collect()) == [0, 1, 2, 5]


@pytest.fixture(scope="module")
def ranks():
    return encoding.read_ranks(encoding.vocabulary_path())


def reference_encoder(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encoding.split_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(word=st.text(max_size=60))
def test_merging_equals_the_library(ranks, word):
    import regex

    got = [i for w in regex.findall(encoding.split_pattern(), word) for i in encoding.merge(w.encode(), ranks)]
    assert got == reference_encoder(ranks).encode_ordinary(word)


def test_merging_a_very_long_word(ranks):
    word = "ñaab9" * 4000
    assert encoding.merge(word.encode(), ranks) and b"".join({v: k for k, v in ranks.items()}[i] for i in encoding.merge(word.encode(), ranks)) == word.encode()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 60000), max_size=4), max_size=60), st.binary(max_size=6))
def test_lexicon_round_trip(entries, other):
    lexicon = Lexicon(compile_lexicon(sorted(entries.items())))
    assert all(lexicon.ids(w) == list(ids) for w, ids in entries.items())
    assert len(lexicon) == len(entries)
    assert (lexicon.ids(other) is not None) == (other in entries)


def test_lexicon_shares_suffixes():
    few = compile_lexicon([(w, [1]) for w in sorted([b"canto", b"pinto", b"tanto"])])
    assert Lexicon(few)._states < 12
    with pytest.raises(ValueError):
        compile_lexicon([(b"b", [1]), (b"a", [1])])


def test_encoding_a_table(spark, ranks):
    texts = ["hola hola mundo", "", None, "<|endoftext|> raro ñandú 日本", "hola " * 3000, "  \n\t "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df, most=3).collect()}
    enc = reference_encoder(ranks)
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encoding.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_item_once(counts):
    plan = packing.harmonic_plan(counts, 64)
    fill, placed = {}, {}
    for size, low, high, per, first in plan:
        assert (high - low) % per == 0
        placed.setdefault(size, []).extend(range(low, high))
        for k in range((high - low) // per):
            fill[first + k] = fill.get(first + k, 0) + per * size
    assert all(sorted(placed.get(s, [])) == list(range(n)) for s, n in counts.items())
    assert all(v <= 64 for v in fill.values()) and sorted(fill) == list(range(len(fill)))


def test_packing_a_table(spark):
    lengths = [0, None, 1, 5, 5, 3, 10, 11, 25, 7, 3, 3, 3]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(lengths)], "doc_id bigint, n int, part int")
    got = packing.pack_lengths(df, "doc_id", "n", 10).collect()
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 10 and sum(fill.values()) == sum(n or 0 for n in lengths)
    assert sorted((r.part, r.n_tokens) for r in got if r.doc_id == 8) == [(0, 10), (1, 10), (2, 5)]
    assert len(fill) <= 9 and not {0, 1} & {r.doc_id for r in got}
    assert packing.pack_lengths(df.limit(0), "doc_id", "n", 10).count() == 0


def test_units_and_pieces_come_from_one_pass(spark):
    from quillspan.llm import splitting

    text = " ".join(f"Oración número {i} sobre la región y su historia." for i in range(300))
    units, found = splitting.units_and_pieces(text)
    assert found == splitting.pieces(text) and len(found) > 1
    assert {p[2] for p in found} <= set(units)
    df = spark.createDataFrame([(1, text), (1, text), (2, "corto"), (3, None)], "chunk_id bigint, text string")
    assert sorted((r.chunk_id, r.start_pos) for r in splitting.natural_starts(df).collect()) == [(1, u) for u in units]


def test_copies_of_copies_of_a_file():
    from quillspan.llm import filenames

    name = "copia de " * 9 + "Informe final" + " (1)" * 9 + " - copia" * 9 + ".pdf"
    assert "informe final.pdf" in filenames.candidate_keys(name)
    long = "a 1" * 2_000
    assert filenames.candidate_keys(long) == [filenames.spelling_key(long)]
