"""Batch retrieval: every query of a DataFrame against all chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import scoring as S
from quillspan.functions.text import canonical_source_key, clamp01, folded, js_squeezed, normalize_desktop, normalize_query, normalize_web, trim_snippet
from quillspan.functions.tokens import tokens_desktop, tokens_web
from quillspan.profiles import DESKTOP, WEB, WEB_ASKS

MODES = ("literal", "semantic", "hybrid")
EVIDENCE = 760
#: Queries are held in memory by every worker in blocks of at most so many, and of at most so many bytes.
BLOCK, BLOCK_BYTES = 2_000, 32 << 20
#: Pairs of chunks and queries that are scored at once.
_AT_ONCE = 2_000_000
#: Up to so many queries are looked for in a text one by one.
_FEW = 64


def query_blocks(queries: DataFrame, size: Column, key: str = "query_id") -> list[DataFrame]:
    """The queries in blocks of which each is small enough for a worker's memory; their number and their bytes are counted."""
    counted = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-counted["n"] // BLOCK), -(-counted["bytes"] // BLOCK_BYTES))
    if blocks == 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) for i in range(blocks)]


def metadata_lines(metadata: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")


def searchable_web(name: str = "source_name", location: str = "location", text: str = "text", metadata: str = "metadata") -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (name, location, text)]
    return F.concat_ws("\n", *parts, F.coalesce(metadata_lines(metadata), F.lit("")))


def asked_web(queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.col("query_text").alias("query"), F.col("embedding").alias("q_embedding"))
    q = q.filter(F.length(F.regexp_replace(F.coalesce("query", F.lit("")), r"(?U)\s+", "")) > 0)
    return q.withColumn("q_normal", normalize_web("query")).withColumn("q_tokens", tokens_web("query", F.col("q_normal")))


def with_evidence(rows: DataFrame, text: str, q_normal: str, q_tokens: str, most: int = EVIDENCE, out: str = "evidence") -> DataFrame:
    """Rows with the evidence in their text: all of it if it is short, else its best sentence with the neighbours that fit.

    Sentences are normalised together, with a mark between them, so that folding
    runs once for a text.
    """
    mark = "\u0001"
    x = rows.withColumn("__whole", js_squeezed(text))
    x = x.withColumn("__marked", F.when(F.length("__whole") > most, F.regexp_replace(F.replace("__whole", F.lit(mark), F.lit(" ")), r"(?<=[.!?])\s+", mark)))
    x = x.withColumn("__s", F.split("__marked", mark)).withColumn("__folded", F.lower(F.regexp_replace(folded(F.regexp_replace("__marked", "[\\^`¨¯´·¸ʰ-˿]", "")), f"[^\\p{{L}}\\p{{N}}{mark}]+", " ")))
    x = x.withColumn("__n", F.transform(F.split("__folded", mark), lambda n: F.trim(n)))
    q, t = F.col(q_normal), F.col(q_tokens)

    def score(pair: Column) -> Column:
        n = pair["__n"]
        return S.lexical_score(q, t, n, tokens_web("", n)) + S.evidence_intent_bonus(q, pair["__s"], n)

    x = x.withColumn("__scores", F.transform(F.arrays_zip("__s", "__n"), score))
    x = x.withColumn("__best", (F.array_position("__scores", F.array_max("__scores")) - 1).cast("int"))
    x = x.withColumn("__picked", F.get("__s", F.col("__best"))).withColumn("__before", F.when(F.col("__best") > 0, F.get("__s", F.col("__best") - 1))).withColumn("__after", F.get("__s", F.col("__best") + 1))
    with_before = F.coalesce(F.length("__picked") + F.length("__before") + 1 <= most, F.lit(False))
    so_far = F.length("__picked") + F.when(with_before, F.length("__before") + 1).otherwise(0)
    with_after = F.coalesce(so_far + F.length("__after") + 1 <= most, F.lit(False))
    chosen = F.concat_ws(" ", F.when(with_before, F.col("__before")), "__picked", F.when(with_after, F.col("__after")))
    x = x.withColumn(out, F.when(F.length("__whole") <= most, F.col("__whole")).otherwise(chosen))
    return x.select(*[c for c in rows.columns if c != out], out)


def _units(vectors: Iterable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the usable vectors of that length, and these as rows of length one."""
    by_size: dict[int, list[int]] = {}
    given = list(vectors)
    for i, v in enumerate(given):
        if v is not None and len(v):
            by_size.setdefault(len(v), []).append(i)
    out = {}
    for size, places in by_size.items():
        m = np.array([given[i] for i in places], np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((m * m).sum(1))
            good = np.isfinite(m).all(1) & (length > 0) & np.isfinite(length)
        if good.any():
            out[size] = np.array(places)[good], m[good] / length[good][:, None]
    return out


def _similarities(chunks: dict[int, tuple[np.ndarray, np.ndarray]], queries: dict[int, tuple[np.ndarray, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """Chunks x queries: the cosine of their vectors; NaN where there are none of the same length. Equal vectors give equal numbers."""
    out = np.full(shape, np.nan)
    for size in chunks.keys() & queries.keys():
        (rows, x), (columns, y) = chunks[size], queries[size]
        out[np.ix_(rows, columns)] = np.round(x @ y.T, 12)
    return out


class _Asked:
    """A block of queries, laid out for scoring many chunks at once."""

    def __init__(self, rows: list) -> None:
        self.ids = [r["query_id"] for r in rows]
        self.normal = [r["q_normal"] for r in rows]
        self.units = _units(r["q_embedding"] for r in rows)
        tokens = [list(dict.fromkeys(r["q_tokens"])) for r in rows]
        self.wanted = np.array([len(t) for t in tokens], np.float64)
        self.long = np.array([len(n) >= 8 for n in self.normal])
        self.asks = {what: np.array([any(w in n for w in words) for n in self.normal]) for what, words in WEB_ASKS.items()}
        places: dict[str, list[int]] = {}
        for q, ts in enumerate(tokens):
            for t in ts:
                places.setdefault(t, []).append(q)
        self.token = {t: i for i, t in enumerate(places)}
        self.starts = np.cumsum([0, *map(len, places.values())])
        self.queries = np.array([q for qs in places.values() for q in qs], np.int64)
        self.finder = None

    def words(self, tokens: list) -> tuple[np.ndarray, np.ndarray]:
        """Chunks x queries: how many of the query's words a chunk has, and how often, each at most three times."""
        shape = (len(tokens), len(self.ids))
        found = [(i, self.token[t], min(3, n)) for i, ts in enumerate(tokens) for t, n in Counter(t for t in ts if t in self.token).items()]
        if not found:
            return np.zeros(shape), np.zeros(shape)
        row, token, often = np.array(found, np.int64).T
        sizes = self.starts[token + 1] - self.starts[token]
        # the queries of every token found, one after another
        ends = np.cumsum(sizes)
        query = self.queries[np.arange(ends[-1]) - np.repeat(ends - sizes - self.starts[token], sizes)]
        at = np.repeat(row, sizes) * shape[1] + query
        flat = shape[0] * shape[1]
        return np.bincount(at, minlength=flat).reshape(shape).astype(np.float64), np.bincount(at, np.repeat(often, sizes), flat).reshape(shape)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Chunks x queries: whether the whole query is in the text."""
        out = np.zeros((len(texts), len(self.ids)), bool)
        if len(self.ids) > _FEW and self.finder is None:
            try:
                import ahocorasick

                self.finder = ahocorasick.Automaton()
                same: dict[str, list[int]] = {}
                for q, n in enumerate(self.normal):
                    if n:
                        same.setdefault(n, []).append(q)
                for n, qs in same.items():
                    self.finder.add_word(n, qs)
                self.finder.make_automaton()
            except ImportError:
                self.finder = False
        if self.finder and len(self.finder):
            for i, text in enumerate(texts):
                for _, qs in self.finder.iter(text):
                    out[i, qs] = True
            return out
        for q, n in enumerate(self.normal):
            if n:
                out[:, q] = [n in text for text in texts]
        return out


_KINDS = np.array(["palabras", "idea", "mixta", "frase"], dtype=object)


def _web_scores(asked: _Asked, batch: pd.DataFrame, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks x queries: score, lexical and semantic score, and the kind of the match."""
    covered, often = asked.words(list(batch["tokens"]))
    phrase = asked.phrases(list(batch["normal"]))
    n = np.maximum(asked.wanted, 1)
    lexical = np.clip(covered / n * 0.72 + often / (3 * n) * 0.28 + np.where(phrase & asked.long, 0.25, 0.0), 0, 1)
    lexical *= (asked.wanted > 0) & np.array([len(t) > 0 for t in batch["tokens"]])[:, None]
    if mode == "literal":
        semantic, blend = np.zeros(lexical.shape), lexical
    else:
        cosine = _similarities(_units(batch["embedding"]), asked.units, lexical.shape)
        semantic = np.clip(np.nan_to_num(cosine), 0, 1)
        a, b = (0.88, 0.12) if mode == "semantic" else (0.58, 0.42)
        blend = np.where(np.isnan(cosine), lexical, a * semantic + b * lexical)
    asks = asked.asks
    intent = asks["date"] * batch["dated"].to_numpy()[:, None] + asks["person"] * batch["named"].to_numpy()[:, None] + asks["change"] * batch["changed"].to_numpy()[:, None]
    kind = np.where(phrase, 3, np.where(semantic >= 0.5, np.where(lexical >= 0.2, 2, 1), 0))
    return np.round(np.clip(blend + intent, 0, 1), 12), lexical, semantic, kind


def _first_of(score: np.ndarray, place: np.ndarray, source: np.ndarray, least: float, k: int, per_source: int) -> list[int]:
    """Of one query the chunks of a batch that may be among its best ``k`` of all batches.

    What comes before a chunk here, or as much in its place, comes before it
    overall: a source's first hits here have at least as many as good ones
    of that source overall. So k hits that aren't deferred here are enough, and
    deferred ones count only if there are fewer.
    """
    hits = np.flatnonzero(score >= least)
    order = hits[np.lexsort((place[hits], -score[hits]))]
    if per_source <= 0:
        return order[:k].tolist()
    first: list[int] = []
    deferred: list[int] = []
    seen: Counter = Counter()
    for i in order.tolist():
        seen[source[i]] += 1
        if seen[source[i]] <= per_source:
            first.append(i)
            if len(first) == k:
                return first
        elif len(deferred) < k:
            deferred.append(i)
    return first + deferred


def search_web(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", k: int = WEB.top_k, per_source: int = WEB.per_source, least: float = WEB.least_score, evidence: bool = True) -> DataFrame:
    """The best ``k`` chunks of every query, with evidence: what one source has beyond ``per_source`` comes last.

    Every chunk is scored: a chunk without a word of the query may pass by its
    vector, by a part of a word or by what the question asks for. Workers go
    through the chunks once for each block of queries, whose size is counted:
    words are looked up in the queries' postings, vectors multiplied as
    matrices, and of every batch only what may be among a query's best leaves
    the worker. Literal search doesn't read the vectors. Blank queries have no
    hits; equal scores go by chunk_id.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    asked = asked_web(queries)
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema, *chunks.schema]}
    shown = ["chunk_id", "source_id", "source_name", "location", "text"]
    table = chunks.select(*shown, "metadata", *([] if mode == "literal" else ["embedding"])).withColumn("normal", normalize_web(searchable_web())).withColumn("tokens", tokens_web("text", F.col("normal")))
    vectors = F.lit(None).cast(types["q_embedding"]) if mode == "literal" else F.col("q_embedding")
    asked = asked.withColumn("q_embedding", vectors)
    schema = ", ".join([f"query_id {types['query_id']}", *(f"{c} {types[c]}" for c in shown), "score double, lexical double, semantic double, match_kind string"])
    found = None
    bytes_of = F.length("query") * 8 + F.coalesce(F.greatest(F.size("q_embedding"), F.lit(0)), F.lit(0)) * 8
    for block in query_blocks(asked, bytes_of):
        rows = block.select("query_id", "q_normal", "q_tokens", "q_embedding").collect()  # a block of counted size
        laid = _Asked(rows)
        sent = queries.sparkSession.sparkContext.broadcast(laid)

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            asked = sent.value
            step = max(1, _AT_ONCE // max(1, len(asked.ids)))
            for whole in batches:
                for start in range(0, len(whole), step):
                    batch = whole.iloc[start : start + step]
                    scores, lexical, semantic, kind = _web_scores(asked, batch, mode)
                    place = np.argsort(np.argsort(batch["chunk_id"].fillna("").to_numpy(), kind="stable"), kind="stable")
                    source = batch["source_id"].to_numpy()
                    kept = [(i, q) for q in range(len(asked.ids)) for i in _first_of(scores[:, q], place, source, least, k, per_source)]
                    i, q = (np.array(x, np.int64) for x in (zip(*kept) if kept else ((), ())))
                    out = batch.iloc[i][shown].reset_index(drop=True)
                    out.insert(0, "query_id", [asked.ids[x] for x in q])
                    out["score"], out["lexical"], out["semantic"], out["match_kind"] = scores[i, q], lexical[i, q], semantic[i, q], _KINDS[kind[i, q]]
                    yield out

        # what no query of the block asks for isn't looked for
        text, normal, zero = F.col("text"), F.col("normal"), F.lit(0.0)
        looked = table.select(
            *shown, "normal", "tokens", *([] if mode == "literal" else ["embedding"]),
            (S.date_bonus(text) if laid.asks["date"].any() else zero).alias("dated"),
            (S.person_bonus(text) if laid.asks["person"].any() else zero).alias("named"),
            (S.change_bonus(normal) if laid.asks["change"].any() else zero).alias("changed"),
        )
        hits = looked.mapInPandas(score, schema)
        found = hits if found is None else found.unionByName(hits)
    order = [F.desc("score"), F.asc("chunk_id")]
    # of a source only its first per_source hits come before the others: a bound of k + k per query is enough
    ranked = found.withColumn("of_source", F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy(*order))).filter(F.col("of_source") <= k)
    late = F.col("of_source") > per_source if per_source > 0 else F.lit(False)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(late, *order))).filter(F.col("rank") <= k)
    out = ranked.join(asked.select("query_id", "q_normal", "q_tokens", "query"), "query_id").select(
        "query_id", "rank", "chunk_id", "source_id", "source_name", "location", "text", "score", "lexical", "semantic", "match_kind", "q_normal", "q_tokens", "query"
    )
    if evidence:
        out = with_evidence(out, "text", "q_normal", "q_tokens")
    return out


def vector_candidates(queries: DataFrame, chunks: DataFrame, candidates: int) -> DataFrame:
    """The ``candidates`` chunks nearest to every query by cosine distance, ties by chunk_id.

    Every chunk is compared with every query of a block as a product of
    matrices; a batch gives at most its ``candidates`` nearest of a query. The chunks'
    other columns are read for these alone.
    """
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *chunks.schema]}
    found = None
    for block in query_blocks(queries, F.coalesce(F.greatest(F.size("q_embedding"), F.lit(0)), F.lit(0)) * 8):
        rows = block.select("query_id", "q_embedding").collect()  # a block of counted size
        sent = queries.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], _units(r["q_embedding"] for r in rows)))

        def nearest(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, asked = sent.value
            step = max(1, _AT_ONCE // max(1, len(ids)))
            for whole in batches:
                for start in range(0, len(whole), step):
                    batch = whole.iloc[start : start + step]
                    key = batch["chunk_id"].to_numpy()
                    far = 1 - _similarities(_units(batch["embedding"]), asked, (len(batch), len(ids)))
                    place = np.argsort(np.argsort(batch["chunk_id"].fillna("").to_numpy(), kind="stable"), kind="stable")
                    out = []
                    for q, query in enumerate(ids):
                        usable = np.flatnonzero(~np.isnan(far[:, q]))
                        out += [(query, key[i], far[i, q]) for i in usable[np.lexsort((place[usable], far[usable, q]))][:candidates]]
                    yield pd.DataFrame(out, columns=["query_id", "chunk_id", "distance"])

        near = chunks.select("chunk_id", "embedding").filter("embedding is not null").mapInPandas(nearest, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, distance double")
        found = near if found is None else found.unionByName(near)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc("distance"), F.asc("chunk_id")))
    best = found.withColumn("candidate", place).filter(F.col("candidate") <= candidates)
    return best.join(queries.drop("q_embedding"), "query_id").join(chunks.drop("embedding"), "chunk_id")


def rerank_desktop(rows: DataFrame, prefer_specific: bool = True) -> DataFrame:
    """Relevance from distance, words and title of candidate rows."""
    title = F.concat_ws(" ", F.col("source_name"), F.col("relative_path"))
    x = rows.withColumn("t_normal", normalize_desktop(title)).withColumn("d_normal", normalize_desktop(F.concat_ws(" ", title, F.col("text"))))
    q_tokens = tokens_desktop("query", F.col("q_normal"))
    x = x.withColumn("q_tokens", q_tokens)
    keyword = S.keyword_overlap(F.col("q_normal"), F.col("q_tokens"), F.col("d_normal"), tokens_desktop("text", F.col("d_normal")))
    titled = S.keyword_overlap(F.col("q_normal"), F.col("q_tokens"), F.col("t_normal"), tokens_desktop("text", F.col("t_normal")))
    penalty = S.low_signal_penalty("text", "relative_path") if prefer_specific else F.lit(0.0)
    x = x.withColumn("semantic_relevance", clamp01(1 - F.col("distance"))).withColumn("keyword_score", keyword).withColumn("title_score", titled).withColumn("low_signal_penalty", penalty)
    base = 0.74 * F.col("semantic_relevance") + 0.18 * F.col("keyword_score") + 0.08 * F.col("title_score")
    bonus = F.when(F.col("title_score") >= 0.34, 0.04).otherwise(0.0)
    doubt = F.when((F.col("keyword_score") == 0) & (F.col("title_score") == 0) & (F.col("semantic_relevance") < 0.62), 0.05).otherwise(0.0)
    return x.withColumn("relevance", clamp01(base + bonus - F.col("low_signal_penalty") - doubt))


def diversified(rows: DataFrame, group: list[str], key: Column, order: list[Column], per_key: int) -> DataFrame:
    """Rows with ``place``: the first ``per_key`` of every key in order, then the others; none is dropped."""
    if per_key <= 0:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    seen = F.row_number().over(Window.partitionBy(*group, "__key").orderBy(*order))
    x = rows.withColumn("__key", key).withColumn("__seen", seen)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__seen") > per_key, *order))
    return x.withColumn("place", place).drop("__key", "__seen")


def above_threshold(rows: DataFrame, group: list[str], score: str, least: float) -> DataFrame:
    """Rows that reach the threshold; all rows of a group in which none does."""
    best = F.max(score).over(Window.partitionBy(*group))
    return rows.withColumn("__best", best).filter((F.col("__best") < least) | (F.col(score) >= least) | F.col("__best").isNull()).drop("__best")


def search_desktop(
    queries: DataFrame, chunks: DataFrame, k: int = DESKTOP.top_k, candidates: int | None = None, least: float = DESKTOP.least_score, per_file: int = DESKTOP.per_source, prefer_specific: bool = True
) -> DataFrame:
    """Vector candidates, re-ranked, spread over files, cut at the threshold (unless nothing reaches it), the best ``k``."""
    asked = queries.select("query_id", F.col("query_text").alias("query"), F.col("embedding").alias("q_embedding"))
    asked = asked.filter(F.length(F.regexp_replace(F.coalesce("query", F.lit("")), r"(?U)\s+", "")) > 0).withColumn("q_normal", normalize_desktop("query"))
    table = chunks.select("chunk_id", "source_name", "relative_path", "location", "text", "embedding")
    near = vector_candidates(asked, table, max(k, candidates or 6 * k))
    x = rerank_desktop(near, prefer_specific).withColumn("snippet", trim_snippet("text"))
    order = [F.desc("relevance"), F.asc("distance"), F.asc("chunk_id")]
    x = diversified(x, ["query_id"], canonical_source_key("relative_path", F.lit(""), "source_name"), order, per_file)
    x = above_threshold(x, ["query_id"], "relevance", least)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter(F.col("rank") <= k)
    return x.select(
        "query_id", "rank", "chunk_id", F.col("source_name").alias("file_name"), "relative_path", "location", "snippet", "relevance",
        "semantic_relevance", "keyword_score", "title_score", "distance", "low_signal_penalty", "query",
    )


__all__ = ["above_threshold", "diversified", "normalize_query", "search_desktop", "search_web", "vector_candidates", "with_evidence"]
