"""Near duplicates and nearest vectors against brute force."""

import random

import numpy as np
import pytest

from quillspan.llm import near_duplicates as D
from quillspan.llm import neighbours as N
from quillspan.llm import sketches as S


def jaccard(a, b, size):
    x, y = (set(zip(*[S.words(t)[i:] for i in range(size)])) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out = {}
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for v in range(4):
            words = list(base)
            for _ in range(v * 2):
                words[rng.randrange(60)] = rng.choice(vocabulary)
            out[f"d{g:02}{v}"] = " ".join(words)
    out |= {"copia1": out["d000"].upper(), "copia2": out["d000"] + " !", "nulo": None, "vacio": "", "corto": "uno dos", "largo": "palabra " * 20_000}
    return out


def test_pairs_equal_brute_force(spark, texts):
    rows = [*((k, t, 1) for k, t in texts.items()), ("d000", texts["d000"], 2)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, class_id int")
    members, pairs = D.near_duplicates(df, shingle=3, similarity=0.7, least_words=20)
    got = {(r.chunk_id_a, r.chunk_id_b) for r in D.duplicate_pairs(members, pairs).collect()}
    used = sorted(k for k, t in texts.items() if t and len(S.words(t)) >= 20)
    want = {(a, b) for i, a in enumerate(used) for b in used[i + 1 :] if jaccard(texts[a], texts[b], 3) >= 0.7}
    assert got <= want and len(got & want) >= 0.99 * len(want)
    assert ("copia1", "copia2") in got
    groups = {r.chunk_id: r for r in D.near_duplicate_groups(members, pairs).collect()}
    assert set(groups) == set(used)
    assert len({groups[k].group_id for k in ("d000", "copia1", "copia2")}) == 1


def test_large_bands_give_the_same_pairs(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    whole, blocks = ({(r.class_a, r.class_b, round(r.jaccard, 9)) for r in D.near_duplicates(df, shingle=3, similarity=0.7, least_words=20, hub=hub)[1].collect()} for hub in (1_000, 2))
    assert whole == blocks and len(whole) > 50


def test_a_template_with_many_variants(spark):
    rng = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    rows = [(f"v{i:04}", " ".join([*base[: i % 110], f"nombre{i}", f"fecha{i}", *base[i % 110 :]]), 0) for i in range(700)]
    rows += [(f"x{i}", " ".join(f"z{rng.randrange(10**6)}" for _ in range(60)), 0) for i in range(50)]
    members, pairs = D.near_duplicates(spark.createDataFrame(rows, "chunk_id string, text string, n int"), hub=128)
    groups = {r.chunk_id: r for r in D.near_duplicate_groups(members, pairs).collect()}
    assert len({groups[f"v{i:04}"].group_id for i in range(700)}) == 1
    assert all(groups[f"v{i:04}"].n_links == 699 for i in range(700)) and all(groups[f"x{i}"].n_links == 0 for i in range(50))


def test_a_text_with_very_many_copies_costs_a_row_each(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as chunk_id", "'uno dos tres cuatro cinco seis siete ocho' as text")
    members, pairs = D.near_duplicates(df)
    got = D.duplicate_pairs(members, pairs).collect()
    assert len(got) == 999 and {r.chunk_id_a for r in got} == {"0"}


def test_no_texts(spark):
    members, pairs = D.near_duplicates(spark.createDataFrame([], "chunk_id string, text string"))
    assert members.count() == pairs.count() == D.near_duplicate_groups(members, pairs).count() == 0
    with pytest.raises(ValueError):
        D.near_duplicates(members, similarity=0)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "class_a bigint, class_b bigint")
    got = {r.class_id: r.group_id for r in D.connected_classes(chain).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    b[:300] = a[:300]
    x, y = S.sketch(np.unique(a)), S.sketch(np.unique(b))
    assert (S.sketch(np.unique(np.concatenate([a, b]))) == np.maximum(x, y)).all()
    estimate = S.jaccard_estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([400.0]), np.array([400.0]))[0]
    assert abs(estimate - 300 / 500) < 0.15
    assert S.sketch(np.zeros(0, np.uint64)).sum() == 0


def brute_neighbours(rows, k):
    ids = sorted({i for i, _ in rows})
    v = np.array([dict(rows)[i] for i in ids], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    np.fill_diagonal(sims, -9)
    return {ids[i]: {ids[j] for j in np.argsort(-sims[i].round(6), kind="stable")[:k]} for i in range(len(ids))}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 64))
    rows = [(f"c{i:04}", (centres[i % 12] + 0.4 * rng.standard_normal(64)).astype("float32").tolist()) for i in range(1500)]
    odd = [("nulo", None), ("corto", [1.0] * 32), ("cero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64), rows[0]]
    df = spark.createDataFrame([(k, v, 0) for k, v in [*rows, *odd]], "chunk_id string, embedding array<float>, vid int")
    old = N.FEWEST_ROWS
    N.FEWEST_ROWS = 400  # several cells
    try:
        got = {}
        for r in N.similar_rows(df).collect():
            got.setdefault(r.chunk_id, set()).add(r.neighbour)
    finally:
        N.FEWEST_ROWS = old
    want = brute_neighbours(rows, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len(got[i] & want[i]) for i in want) >= 0.95 * 5 * len(want)


def test_few_vectors_leave_their_cell(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [900, *[60] * 50]  # one group is larger than a cell
    v = np.concatenate([c + 0.35 * rng.standard_normal((m, 64)) for c, m in zip(rng.standard_normal((len(sizes), 64)), sizes)])
    rows = [(f"c{i:04}", x.astype("float32").tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    tables = []
    whole = N.stored
    monkeypatch.setattr(N, "stored", lambda t, name: tables.append(whole(t, name)) or tables[-1])
    for name, value in {"CELL_ROWS": 500, "FEWEST_ROWS": 500}.items():
        monkeypatch.setattr(N, name, value)
    got = {}
    for r in N.similar_rows(df).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour)
    want = brute_neighbours(rows, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len(got[i] & want[i]) for i in want) >= 0.99 * 5 * len(want)
    gone = [r for t in tables if "visits" in t.columns for r in t.select("visits").collect()]
    small = sum(len(r.visits) for r in gone) - 900 * 7  # of the large group each may visit all others
    assert small < 0.2 * len(rows)


def test_equal_vectors_and_few_rows(spark):
    v = [1.0] + [0.0] * 63
    w = [0.0, 1.0] + [0.0] * 62
    df = spark.createDataFrame([(f"a{i}", v) for i in range(9)] + [("b", w), ("c", [2.0] + [0.0] * 63)], "chunk_id string, embedding array<float>")
    got = {}
    for r in N.similar_rows(df).orderBy("chunk_id", "place").collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour)
    assert got["a8"] == ["a0", "a1", "a2", "a3", "a4"] and got["a0"] == ["a1", "a2", "a3", "a4", "a5"]
    assert got["b"] == ["a0", "a1", "a2", "a3", "a4"]
    assert N.similar_rows(df.limit(0)).count() == 0
    assert N.similar_rows(df.filter("chunk_id = 'b'")).count() == 0
    two = N.neighbour_pairs(N.similar_rows(df.filter("chunk_id in ('b', 'c')"))).collect()
    assert [(r.chunk_id_a, r.chunk_id_b) for r in two] == [("b", "c")]


def test_chi_square():
    assert N.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    with pytest.raises(ValueError):
        N.chi_square_quantile(0.5, 3)


def test_tree_with_equal_points():
    tree = N.build_tree(np.zeros((50, 6), np.float32), 8)
    assert tree.leaves == 1 and set(tree.leaf_of(np.ones((3, 6), np.float32))) == {0}


def test_folding_is_that_of_the_whole_text():
    import unicodedata

    from quillspan.llm.folding import without_marks

    every = "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x20000)]))
    for text in (every, "ẹ́ñ ﬁ 각 ẛ̣ ½ ™"):
        assert without_marks(text) == "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
