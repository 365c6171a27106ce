"""All core queries by name, and the SQL that they are checked against.

Each query runs over its whole tables. Searches take every query whose id is
divisible by 50 against all chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan import oracle as O
from quillspan import profiles as P
from quillspan.functions import scoring as S
from quillspan.functions import text as X
from quillspan.functions.tokens import stem_desktop, stem_web, tokens_desktop, tokens_web
from quillspan.operators import answers, chunking, records, retrieval
from quillspan.plans import sync
from quillspan.sources import files
from quillspan.sources.files import merged_ocr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table without rows sent twice; only the named columns are read."""
    return table(spark, folder, name).select(key, *[c for c in columns if c != key]).dropDuplicates([key])


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queries").filter("query_id % 50 = 0")


def r6(c) -> F.Column:
    return F.round(c, 6)


def words(c) -> F.Column:
    return F.array_join(c, " ")


def big(c) -> F.Column:
    return c.cast("bigint")


@query(f"SELECT doc_id, {O.norm_desktop('text')} AS normal FROM documents")
def normalize_desktop(s, d):
    return table(s, d, "documents").select("doc_id", X.normalize_desktop("text").alias("normal"))


@query(f"SELECT doc_id, {O.norm_web('text')} AS normal FROM documents")
def normalize_web(s, d):
    return table(s, d, "documents").select("doc_id", X.normalize_web("text").alias("normal"))


@query(f"SELECT doc_id, array_to_string({O.tokens_desktop('text')}, ' ') AS tokens FROM documents")
def tokenize_desktop(s, d):
    return table(s, d, "documents").select("doc_id", words(tokens_desktop("text")).alias("tokens"))


@query(f"SELECT doc_id, array_to_string({O.tokens_web('text')}, ' ') AS tokens FROM documents")
def tokenize_web(s, d):
    return table(s, d, "documents").select("doc_id", words(tokens_web("text")).alias("tokens"))


_VOCABULARY = "SELECT DISTINCT w FROM (SELECT unnest(string_split({}, ' ')) AS w FROM documents) WHERE w <> ''"


@query(f"SELECT w AS token, {O.stem_desktop('w')} AS stem FROM ({_VOCABULARY.format(O.norm_desktop('text'))})")
def stems_desktop(s, d):
    v = table(s, d, "documents").select(F.explode(F.split(X.normalize_desktop("text"), " ")).alias("token")).filter("token <> ''").distinct()
    return v.select("token", stem_desktop(F.col("token")).alias("stem"))


@query(f"SELECT w AS token, {O.stem_web('w')} AS stem FROM ({_VOCABULARY.format(O.norm_web('text'))})")
def stems_web(s, d):
    v = table(s, d, "documents").select(F.explode(F.split(X.normalize_web("text"), " ")).alias("token")).filter("token <> ''").distinct()
    return v.select("token", stem_web(F.col("token")).alias("stem"))


@query(f"SELECT chunk_id, t AS token, count(*)::BIGINT AS n, least(3, count(*))::BIGINT AS capped FROM (SELECT chunk_id, unnest({O.tokens_web('text')}) AS t FROM {O.CHUNKS} c) GROUP BY ALL")
def term_frequency(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "text")
    t = c.select("chunk_id", F.explode(tokens_web("text")).alias("token"))
    return t.groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("n")).withColumn("capped", F.least(F.lit(3).cast("bigint"), "n"))


@query(
    f"SELECT base_id, count(DISTINCT source_id)::BIGINT AS sources, count(*)::BIGINT AS chunks, (count(*) FILTER (len(embedding) > 0))::BIGINT AS embedded, bool_and(coalesce(len(embedding) > 0, false)) AS semantic_ready FROM {O.CHUNKS} c GROUP BY base_id"
)
def corpus_stats(s, d):
    return sync.base_stats(once(s, d, "source_chunks", "chunk_id", "base_id", "source_id", "embedding"))


@query("SELECT coalesce(status, '') AS status, count(*)::BIGINT AS n, (count(*) FILTER (error IS NOT NULL))::BIGINT AS with_error FROM manifest GROUP BY 1")
def status_counts(s, d):
    return table(s, d, "manifest").groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("with_error"))


def _asked_results(s, d, *columns):
    r = once(s, d, "search_results", "result_id", "query_id", "snippet", *columns)
    return r.join(table(s, d, "queries").select("query_id", "query_text"), "query_id")


@query(f"SELECT result_id, round({O.keyword_overlap('query_text', 'snippet')}, 6) AS score FROM {O.RESULTS} r JOIN queries USING (query_id)")
def coverage_score(s, d):
    x = _asked_results(s, d).withColumn("q", X.normalize_desktop("query_text")).withColumn("t", X.normalize_desktop("snippet"))
    x = x.withColumn("qt", tokens_desktop("", F.col("q"))).withColumn("tt", tokens_desktop("", F.col("t")))
    return x.select("result_id", r6(S.keyword_overlap(F.col("q"), F.col("qt"), F.col("t"), F.col("tt"))).alias("score"))


@query(f"SELECT result_id, round({O.lexical('query_text', 'snippet')}, 6) AS score FROM {O.RESULTS} r JOIN queries USING (query_id)")
def lexical_score(s, d):
    x = _asked_results(s, d).withColumn("q", X.normalize_web("query_text")).withColumn("t", X.normalize_web("snippet"))
    x = x.withColumn("qt", tokens_web("", F.col("q"))).withColumn("tt", tokens_web("", F.col("t")))
    return x.select("result_id", r6(S.lexical_score(F.col("q"), F.col("qt"), F.col("t"), F.col("tt"))).alias("score"))


@query(f"SELECT result_id, query_id FROM {O.RESULTS} r JOIN queries USING (query_id) WHERE length({O.norm_web('query_text')}) >= 8 AND contains({O.norm_web('snippet')}, {O.norm_web('query_text')})")
def phrase_search(s, d):
    q, t = X.normalize_web("query_text"), X.normalize_web("snippet")
    return _asked_results(s, d).filter((F.length(q) >= 8) & F.contains(t, q)).select("result_id", "query_id")


@query(f"SELECT result_id, {O.SOURCE_KEY} AS source_key FROM {O.RESULTS} r")
def source_dedupe_key(s, d):
    r = once(s, d, "search_results", "result_id", "relative_path", "source_path", "file_name")
    return r.select("result_id", X.canonical_source_key("relative_path", "source_path", "file_name").alias("source_key"))


@query(f"SELECT result_id, {O.intents('query_text')}, (CASE WHEN {O.ANY_DATE_PRECISE} THEN 2 WHEN {O.ANY_YEAR} THEN 1 ELSE 0 END)::BIGINT AS precision FROM {O.RESULTS} r JOIN queries USING (query_id)")
def intent_flags(s, d):
    q = X.normalize_web("query_text")
    flags = [S.any_of(q, P.WEB_ASKS[k]).alias(f"asks_{k}") for k in ("date", "person", "change")]
    return _asked_results(s, d).select("result_id", *flags, big(F.coalesce(S.date_precision(F.col("snippet")), F.lit(0))).alias("precision"))


@query(f"SELECT result_id, coalesce({O.person_count('snippet')}, 0)::BIGINT AS persons FROM {O.RESULTS} r")
def person_count(s, d):
    r = once(s, d, "search_results", "result_id", "snippet")
    return r.select("result_id", big(F.coalesce(S.named_persons(F.col("snippet")), F.lit(0))).alias("persons"))


@query(f"SELECT chunk_id, round({O.LOW_SIGNAL}, 6) AS penalty FROM {O.CHUNKS} c")
def low_signal_penalty(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "text", "relative_path")
    return c.select("chunk_id", r6(S.low_signal_penalty("text", "relative_path")).alias("penalty"))


@query(
    f"WITH q AS (SELECT query_id, {O.unit('embedding')} AS q FROM queries WHERE query_id % 50 = 0), "
    f"c AS (SELECT chunk_id, {O.unit('embedding')} AS v FROM {O.CHUNKS} c WHERE {O.usable('embedding')}) "
    "SELECT query_id, chunk_id, place::BIGINT AS place, round(d, 6) AS distance FROM (SELECT query_id, chunk_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS place "
    "FROM (SELECT query_id, chunk_id, 1 - list_dot_product(q, v) AS d FROM q, c WHERE len(q) = len(v))) WHERE place <= 48"
)
def cosine_topk(s, d):
    q = asked(s, d).select("query_id", F.col("embedding").alias("q_embedding"))
    near = retrieval.vector_candidates(q, once(s, d, "source_chunks", "chunk_id", "embedding"), 48)
    return near.select("query_id", "chunk_id", big(F.col("candidate")).alias("place"), r6("distance").alias("distance"))


def _search(mode):
    def run(s, d):
        columns = ("source_id", "source_name", "location", "text", "metadata", *(() if mode == "literal" else ("embedding",)))
        hits = retrieval.search_web(asked(s, d), once(s, d, "source_chunks", "chunk_id", *columns), mode)
        return hits.select("query_id", big(F.col("rank")).alias("rank"), "chunk_id", r6("score").alias("score"), "match_kind", "evidence")

    run.__name__ = f"search_{mode}"
    return run


for _mode in retrieval.MODES:
    query(O.searched(_mode))(_search(_mode))


@query(O.SEARCH_DESKTOP)
def search_desktop_rerank(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "source_name", "relative_path", "location", "text", "embedding")
    hits = retrieval.search_desktop(asked(s, d), c)
    return hits.select("query_id", big(F.col("rank")).alias("rank"), "chunk_id", r6("relevance").alias("relevance"), r6("keyword_score").alias("keyword_score"), r6("title_score").alias("title_score"))


def _ordered_results(s, d):
    r = once(s, d, "search_results", "result_id", "query_id", "file_name", "relative_path", "source_path", "relevance")
    return r.withColumn("score", F.coalesce(F.nanvl("relevance", F.lit(None).cast("double")), F.lit(-1.0)))


@query(
    f"WITH r AS (SELECT query_id, result_id, {O.SCORE} AS score, {O.SOURCE_KEY} AS k FROM {O.RESULTS} r), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, result_id) AS n FROM r) "
    "SELECT query_id, result_id, (row_number() OVER (PARTITION BY query_id ORDER BY n > 3, score DESC, result_id))::BIGINT AS place FROM s"
)
def diversify_files(s, d):
    key = X.canonical_source_key("relative_path", "source_path", "file_name")
    x = retrieval.diversified(_ordered_results(s, d), ["query_id"], key, [F.desc("score"), F.asc("result_id")], P.DESKTOP.per_source)
    return x.select("query_id", "result_id", big(F.col("place")).alias("place"))


@query(
    f"WITH r AS (SELECT query_id, result_id, {O.SCORE} AS score FROM {O.RESULTS} r), b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r) "
    "SELECT query_id, result_id FROM b WHERE best < 0.8 OR score >= 0.8"
)
def threshold_fallback(s, d):
    return retrieval.above_threshold(_ordered_results(s, d), ["query_id"], "score", 0.8).select("query_id", "result_id")


@query(O.TEXT_BLOCKS_DESKTOP)
def text_blocks_desktop(s, d):
    return chunking.text_segments(table(s, d, "documents"), "doc_id", "text", "desktop")


@query(O.TEXT_BLOCKS_WEB)
def text_blocks_web(s, d):
    return chunking.text_segments(table(s, d, "documents"), "doc_id", "text", "web")


@query(O.SPLIT_DESKTOP)
def split_window_desktop(s, d):
    x = table(s, d, "documents").filter(F.length("text") > 0)
    return x.select("doc_id", F.posexplode(chunking.windows_udf("desktop", P.DESKTOP.chunk_size, P.DESKTOP.chunk_overlap)(F.col("text"))).alias("part", "chunk"))


@query(O.SPLIT_WEB)
def split_window_web(s, d):
    return chunking.chunks_web(chunking.text_segments(table(s, d, "documents"), "doc_id", "text", "web"))


@query(O.PACK_SEGMENTS)
def pack_segments(s, d):
    x = once(s, d, "segments", "segment_id", "base_id", "source_id", "seg_idx", "text", "location")
    return chunking.pack_segments(x, ["base_id", "source_id"], ["seg_idx", "segment_id"])


@query(f"SELECT doc_id, pos::INT AS pos, u AS unit, {O.fragment('u')} AS fragment, {O.dedupe_key(O.clean_unit('u'))} AS key FROM (SELECT doc_id, unnest({O.units('text')}) AS u, unnest(range(len({O.units('text')}))) AS pos FROM documents WHERE text IS NOT NULL)")
def sentence_units(s, d):
    u = table(s, d, "documents").select("doc_id", F.posexplode(chunking.split_units("text")).alias("pos", "unit"))
    return u.select("doc_id", "pos", "unit", S.looks_fragmentary(F.col("unit")).alias("fragment"), X.dedupe_key(X.clean_unit("unit")).alias("key"))


@query(O.SELECT_EVIDENCE)
def select_evidence(s, d):
    """The evidence in every document for one of the queries."""
    q = table(s, d, "queries").select("query_id", X.normalize_web("query_text").alias("q_normal"), tokens_web("query_text").alias("q_tokens"))
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", "text").join(F.broadcast(q.agg(F.count(F.lit(1)).alias("n"))))  # one row
    r = docs.withColumn("query_id", F.col("doc_id") % F.col("n")).join(q, "query_id")
    return retrieval.with_evidence(r, "text", "q_normal", "q_tokens").select("doc_id", "evidence")


@query(O.EVIDENCE_ANSWER)
def evidence_answer(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "source_id", "source_name", "location", "text", "metadata", "embedding")
    a = answers.evidence_answers(retrieval.search_web(asked(s, d), c, "hybrid"))
    return a.select("query_id", F.posexplode("passages").alias("pos", "p")).select("query_id", big(F.col("pos")).alias("pos"), "p.*")


def _stored_hits(s, d):
    """The eight best stored results of every query, as a search gives them."""
    r = once(s, d, "search_results", "result_id", "query_id", "snippet", "relevance").filter("relevance is not null and not isnan(relevance) and snippet is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "result_id"))
    hits = r.withColumn("rank", rank).filter(F.col("rank") <= P.DESKTOP.top_k)
    return hits.join(table(s, d, "queries").select("query_id", F.col("query_text").alias("query")), "query_id")


@query(O.CONCEPTS)
def concept_names(s, d):
    """Of every query the concept that it asks for, what else that is called, the words that show it, and the longer query."""
    q = table(s, d, "queries").select("query_id", "query_text", answers.concept_of("query_text").alias("concept"), answers.anchors_of("query_text").alias("a"))
    v = F.array_join(F.array_sort(answers.concept_variants("concept")), "|")
    longer = F.when(F.col("concept").isNotNull(), answers.expanded_query("concept", "query_text"))
    return q.select("query_id", "concept", v.alias("variants"), F.array_join("a", "|").alias("anchors"), longer.alias("longer"))


@query(O.CLAIMS)
def claims_greedy(s, d):
    return answers.claims(_stored_hits(s, d)).select("query_id", F.posexplode("claims").alias("pos", "c")).select("query_id", "pos", "c.*")


@query(O.EXTRACTIVE)
def extractive_answer(s, d):
    return answers.extractive_answers(_stored_hits(s, d))


@query(O.CONCEPT_ANSWERS)
def concept_answer(s, d):
    return answers.concept_answers(_stored_hits(s, d))


@query(r"SELECT result_id, CASE WHEN len(c) = 0 THEN 3 ELSE len(list_filter([1, 2, 3], lambda i: list_contains(c, i))) END::BIGINT AS sources FROM (SELECT result_id, list_transform(regexp_extract_all(coalesce(location, '') || ' [' || (result_id % 5)::VARCHAR || ']', '\[(\d{1,9})\]', 1), lambda x: x::INT) AS c FROM " + O.RESULTS + " r)")
def citations_used(s, d):
    r = once(s, d, "search_results", "result_id", "location")
    text = F.concat(F.coalesce("location", F.lit("")), F.lit(" ["), (F.col("result_id") % 5).cast("string"), F.lit("]"))
    sources = F.array(*[F.struct(F.lit(i).alias("index")) for i in (1, 2, 3)])
    return r.select("result_id", big(F.size(answers.sources_for_text(text, sources))).alias("sources"))


@query(O.FLATTEN_ORDERS)
def flatten_records_orders(s, d):
    o = table(s, d, "orders")
    e = records.entries_of(o.columns, dict(o.dtypes))
    return o.select("o_orderkey", e.alias("e")).select("o_orderkey", records.record_text(F.col("e")).alias("text"), big(F.size("e")).alias("entries"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten_events(s, d):
    e = table(s, d, "events").select("event_id", F.explode(records.flatten_json("props")).alias("e"))
    return e.select("event_id", "e.key", "e.value")


@query(
    f"SELECT chunk_id, url_ AS url FROM (SELECT chunk_id, url AS url_ FROM {O.CHUNKS} c) WHERE regexp_matches(url_, '^https?://')"
)
def record_metadata_url(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "source_name", "url")
    e = records.entries_of(["source_name", "url"])
    return c.select("chunk_id", records.record_url(e).alias("url")).filter("url is not null")


_PAGE = ("<html><head><title>x</title></head><BODY class=\"a\"><!-- <p> --><p>", "</p>\n&lt;b&gt; &amp;amp; &#243;&#xe9;&ntilde; &nada;</body><p>y</p></html>")


@query(O.html_text(_PAGE, "& v"))
def html_text(s, d):
    """Every document as the body of a page that has a head, a comment and entities."""
    page = F.concat(F.lit(_PAGE[0]), F.col("text"), F.lit(_PAGE[1]))
    return table(s, d, "documents").select("doc_id", X.html_text(page).alias("plain"))


@query(O.RTF_TEXT)
def rtf_text(s, d):
    return table(s, d, "documents").select("doc_id", X.strip_rtf_web("text").alias("web"), X.strip_rtf_desktop("text").alias("desktop"))


def _listing(s, d):
    """The library as it would be listed now: some files gone, some new under other names, some touched."""
    m = table(s, d, "manifest").filter("mtime_ns % 7 <> 0")
    moved = m.filter("mtime_ns % 5 = 0").withColumn("source_path", F.concat("source_path", F.lit(".md")))
    touched = F.when(F.col("size") % 3 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns"))
    return m.unionByName(moved).withColumn("mtime_ns", touched)


@query(
    f"WITH l AS ({O.LISTING}) SELECT coalesce(l.source_path, m.source_path) AS source_path, CASE WHEN l.source_path IS NULL THEN 'removed' WHEN m.source_path IS NULL THEN 'new' "
    "WHEN l.size IS NOT DISTINCT FROM m.size AND l.mtime_ns IS NOT DISTINCT FROM m.mtime_ns THEN 'unchanged' ELSE 'candidate' END AS action FROM l FULL JOIN manifest m ON l.source_path = m.source_path"
)
def manifest_diff(s, d):
    return sync.manifest_diff(_listing(s, d), table(s, d, "manifest"))


@query(f"WITH l AS ({O.LISTING}) SELECT source_path FROM manifest m WHERE starts_with(source_path, '/srv/materiales/General/') AND NOT EXISTS (SELECT 1 FROM l WHERE l.source_path = m.source_path) OR starts_with(source_path, '/srv/materiales/') AND NOT EXISTS (SELECT 1 FROM l WHERE l.source_path = m.source_path)")
def removed_files(s, d):
    return sync.removed_files(table(s, d, "manifest"), _listing(s, d), "/srv/materiales").select("source_path")


@query(
    f"WITH c AS (SELECT chunk_id, text, updated_at FROM {O.CHUNKS} c), n AS (SELECT chunk_id, upper(text) AS text FROM c WHERE year(updated_at) = 2025) "
    "SELECT chunk_id, text FROM n UNION ALL SELECT chunk_id, text FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM n)"
)
def upsert_chunks(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "text", "updated_at")
    new = c.filter(F.year("updated_at") == 2025).select("chunk_id", F.upper("text").alias("text"))
    return sync.upsert(c.select("chunk_id", "text"), new, "chunk_id")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(
    "WITH h AS (SELECT chunk_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(coalesce(relative_path, '') || '::' || sha256(coalesce(text, '')) || '::' || chunk_index)) AS h FROM " + O.CHUNKS + " c) "
    "SELECT chunk_id, substring(h, 1, 12) || '5' || substring(h, 14, 3) || substring('89ab', (('0x' || substring(h, 17, 1))::INT & 3) + 1, 1) || substring(h, 18, 15) AS uuid FROM h"
)
def chunk_id(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "relative_path", "chunk_index", "text")
    return c.select("chunk_id", X.chunk_uuid(F.coalesce("relative_path", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256), "chunk_index").alias("uuid"))


@query(r"SELECT page_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]')) < 40 AS needed FROM " + O.PAGES + " p")
def ocr_needed_pages(s, d):
    p = once(s, d, "ocr_pages", "page_id", "text")
    return p.select("page_id", X.page_needs_ocr("text").alias("needed"))


@query(O.OCR_MERGE)
def ocr_merge(s, d):
    p = once(s, d, "ocr_pages", "page_id", "scan_id", "page_number", "text", "confidence")
    pages = p.select("scan_id", "page_number", F.when((F.col("confidence") >= 95) & ~F.isnan("confidence"), F.col("text")).alias("text"))
    return merged_ocr(pages, p.select("scan_id", "page_number", "text", "confidence"), "scan_id").select("scan_id", "page_number", "text", "location")


@query(O.OCR_TEXT)
def ocr_text(s, d):
    p = once(s, d, "ocr_pages", "page_id", "text")
    return p.select("page_id", X.normalize_ocr("text").alias("normal"))


@query(f"SELECT chunk_id, length(t)::BIGINT AS characters, t AS text FROM (SELECT chunk_id, substring(concat_ws('\n', nullif(source_name, ''), nullif(location, ''), nullif(text, ''), nullif(array_to_string(list_transform(list_sort(map_entries(metadata)), lambda e: e.key || ': ' || e.value), '\n'), '')), 1, 2400) AS t FROM {O.CHUNKS} c)")
def embedding_text(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "source_name", "location", "text", "metadata")
    t = X.embedding_text("source_name", "location", "text", "metadata")
    return c.select("chunk_id", big(F.length(t)).alias("characters"), t.alias("text"))


@query(O.TRIM_SNIPPET)
def trim_snippet(s, d):
    return table(s, d, "documents").select("doc_id", X.trim_snippet("text").alias("snippet"))


@query(f"SELECT source_id, trim(lower(regexp_replace({O.fold('source_name')}, '[^a-zA-Z0-9]+', '-', 'g')), '-') AS name FROM manifest")
def safe_file_name(s, d):
    return table(s, d, "manifest").select("source_id", X.safe_file_name("source_name").alias("name"))


@query("SELECT source_id, CASE WHEN starts_with(source_path, '/srv/materiales/') THEN substring(source_path, 17) ELSE list_last(string_split(source_path, '/')) END AS relative FROM manifest")
def safe_relative(s, d):
    return table(s, d, "manifest").select("source_id", X.safe_relative("source_path", F.lit("/srv/materiales")).alias("relative"))


@query(f"SELECT result_id, regexp_replace(replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;'), '(?i)(^|[^\\p{{L}}\\p{{N}}])(informe|tabla)($|[^\\p{{L}}\\p{{N}}])', '\\1<mark>\\2</mark>\\3', 'g') AS html FROM {O.RESULTS} r")
def highlight(s, d):
    return once(s, d, "search_results", "result_id", "snippet").select("result_id", X.highlighted("snippet", ["informe", "tabla", "de"]).alias("html"))


@query(O.RELEVANCE_SUMMARY)
def relevance_summary(s, d):
    """Per query: stored results, how many are shown, and their mean relevance."""
    r = _ordered_results(s, d)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("result_id")))
    ranked = r.withColumn("place", place)
    return ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("place") <= 12).alias("shown"), F.round(F.avg(F.when(F.col("place") <= 12, F.col("score"))), 4).alias("mean_score"))


@query(f"SELECT doc_id, {O.query_norm('text')} AS normal FROM documents")
def normalize_query(s, d):
    return table(s, d, "documents").select("doc_id", X.normalize_query("text").alias("normal"))


@query(f"SELECT chunk_id, u AS address, coalesce(regexp_matches(u, '^(?i:https?)://(?:127\\.0\\.0\\.1|\\[::1\\]|(?i:localhost))(?::\\d+)?(?:[/?#]|$)'), false) AS local FROM (SELECT chunk_id, {O.ADDRESS} AS u FROM {O.CHUNKS} c)")
def local_addresses(s, d):
    c = once(s, d, "source_chunks", "chunk_id", "url", "chunk_index").withColumn("k", F.col("chunk_index") % 8)
    made = [F.concat(F.lit(a), F.col("chunk_id"), F.lit(b)) for a, b in O.ADDRESSES]
    u = F.coalesce(*[F.when(F.col("k") == i, m) for i, m in enumerate(made)], F.col("url"))
    return c.select("chunk_id", u.alias("address"), X.is_local_url(u).alias("local"))


@query(f"SELECT page_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, '') || ' [' || page_number || '] [x] [' || page_id % 7 || ']', '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INT::VARCHAR), ',') AS numbers FROM {O.PAGES} p")
def cited_numbers(s, d):
    p = once(s, d, "ocr_pages", "page_id", "page_number", "text")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("page_number").cast("string"), F.lit("] [x] ["), (F.col("page_id") % 7).cast("string"), F.lit("]"))
    return p.select("page_id", F.array_join(F.transform(X.cited(text), lambda n: n.cast("string")), ",").alias("numbers"))


def _files(rows: DataFrame, name: F.Column, text: F.Column) -> DataFrame:
    return rows.select(name.alias("source_path"), F.encode(text, "UTF-8").alias("content")).filter("content is not null")


@query(O.READ_TEXT)
def read_text_files(s, d):
    """Every document as a file: of plain text, of Markdown, and of bytes that aren't UTF-8 where Latin-1 has its letters."""
    x = table(s, d, "documents").filter("text is not null")
    latin = F.col("text").rlike("^[\\x00-\\x7f\\xa1-\\xff]*[\\xe0-\\xff][a-z][\\x00-\\x7f\\xa1-\\xff]*$") & ~F.col("text").rlike("[\\xc2-\\xf4][\\xa1-\\xbf]")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    f = x.select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".MD")).alias("source_path"), raw.alias("content"))
    return files.content_segments(f).select("source_path", "seg_idx", "text", "location", "error")


@query(O.READ_WEB)
def read_web_files(s, d):
    """Every document as a text file of the web profile, or as the body of a page; the rest of the names aren't known."""
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".html", ".xml", ".pages"))), (F.col("doc_id") % 4 + 1).cast("int"))
    safe = X.escape_html("text")
    text = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<html><head>x</head><body>"), safe, F.lit("</body></html>"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<a b='c'>"), safe, F.lit("</a>"))).otherwise(F.col("text"))
    f = _files(table(s, d, "documents"), F.concat(F.col("doc_id").cast("string"), ending), text)
    return files.content_segments(f, "web").select("source_path", "seg_idx", "text", "location", "error")


def _segments_of(f: DataFrame) -> DataFrame:
    m = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return files.content_segments(f, "web").select("source_path", "text", "location", m.alias("metadata"), "url", "error")


@query(O.READ_TABLES)
def read_tables(s, d):
    """The suppliers of every nation as a table of comma- or tab-separated values, with a blank line and a column without a name."""
    x = table(s, d, "supplier")
    for_tab = F.col("s_nationkey") % 2 == 0
    sep = F.when(for_tab, "\t").otherwise(",")
    line = F.concat_ws("|", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit(' ""x"""')), F.concat(F.lit("https://s.invalid/"), F.col("s_suppkey").cast("string")), F.lit(" "))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))), lambda r: r["l"]), "\n")
    t = x.groupBy("s_nationkey").agg(lines.alias("l")).withColumn("t", F.concat(F.lit(" s_suppkey |s_name|enlace|\n | ||\n"), "l"))
    return _segments_of(_files(t, F.concat(F.col("s_nationkey").cast("string"), F.when(for_tab, ".tsv").otherwise(".csv")), F.replace("t", F.lit("|"), sep)))


@query(O.READ_JSON)
def read_json_files(s, d):
    """The events of every kind as lines of JSON, and all regions as one JSON object with an array; a broken file gives its error."""
    e = table(s, d, "events")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda r: r["props"]), "\n\n")
    f = _files(e.filter("props is not null").groupBy("event_type").agg(lines.alias("t")), F.concat("event_type", F.lit(".jsonl")), F.col("t"))
    r = table(s, d, "region").select(F.struct("r_regionkey", F.struct(F.col("r_name").alias("name"), F.array(F.lit(1), F.lit(2)).alias("codes")).alias("r")).alias("x"))
    one = r.agg(F.array_sort(F.collect_list("x")).alias("items")).select(F.to_json(F.struct(F.lit(7).alias("n"), "items")).alias("t"))
    broken = s.range(1).select(F.lit('{"a":1}\n{').alias("t"))
    return _segments_of(f.unionByName(_files(one, F.lit("regions.json"), F.col("t"))).unionByName(_files(broken, F.lit("broken.ndjson"), F.col("t"))))


@query(O.SYNC_ACTIONS)
def sync_actions(s, d):
    """The actions of manifest_diff with candidates settled by content."""
    m = table(s, d, "manifest")
    listing = _listing(s, d)
    hashes = listing.join(m.select("source_path", F.col("sha256").alias("was")), "source_path", "left").select("source_path", F.when(F.col("size") % 2 == 0, F.col("was")).otherwise(F.sha2("source_path", 256)).alias("sha256"))
    return sync.judged_candidates(sync.manifest_diff(listing, m), hashes, m)


@query(O.SYNC_COUNTS)
def sync_counts(s, d):
    """The counts of a run over these actions, as if every third file that is read had an error."""
    a = sync_actions(s, d)
    read = a.filter(F.col("action").isin("new", "changed"))
    broken = F.length("source_path") % 3 == 0
    made = read.filter(~broken).select("source_path", F.explode(F.sequence(F.lit(1), F.length("source_path") % 4 + 1)))
    return sync.sync_summary(a, made, read.filter(broken))


_PORTABLE = "chunk_id string, source_id string, source_name string, source_type string, location string, text string, url string"


@query(O.BASE_ROUND_TRIP)
def base_round_trip(s, d):
    """The chunks of one base, exported and imported under another id."""
    c = once(s, d, "source_chunks", "chunk_id", "base_id", "source_id", "source_name", "source_type", "location", "text", "url", "embedding")
    base = c.agg(F.min("base_id").alias("first"))  # one row
    own = c.join(F.broadcast(base), F.col("base_id") == F.col("first")).drop("first").filter("location is not null and text is not null and source_name is not null and source_type is not null")
    lines = sync.export_base(own.withColumn("base_id", F.lit("one")), "one", "mi base")
    return sync.import_base(lines, _PORTABLE, "two").select("base_id", "chunk_id", "source_id", "source_name", "source_type", "location", "text", "url", F.col("embedding").isNull().alias("bare"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid passage search for all queries that ask something, with evidence."""
    chunks = once(spark, folder, "source_chunks", "chunk_id", "source_id", "source_name", "location", "text", "metadata", "embedding")
    hits = retrieval.search_web(table(spark, folder, "queries"), chunks, "hybrid")
    return hits.select("query_id", "rank", "chunk_id", "source_name", "location", r6("score").alias("score"), "match_kind", "evidence")
