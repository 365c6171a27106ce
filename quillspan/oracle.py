"""SQL fragments of the checks. They say the same as the expressions, in another dialect."""

from __future__ import annotations

from quillspan import profiles as P

CHUNKS = "(SELECT * FROM source_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"
RESULTS = "(SELECT * FROM search_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY retrieved_at) = 1)"
PAGES = "(SELECT * FROM ocr_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY recognised_at) = 1)"
SCORE = "CASE WHEN relevance IS NULL OR isnan(relevance) THEN -1.0 ELSE relevance END"
LISTING = (
    "SELECT source_path, size, CASE WHEN size % 3 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns FROM (SELECT source_path, size, mtime_ns FROM manifest WHERE mtime_ns % 7 <> 0 "
    "UNION ALL SELECT source_path || '.md', size, mtime_ns FROM manifest WHERE mtime_ns % 7 <> 0 AND mtime_ns % 5 = 0)"
)

# Signs that stand for other letters, as far as the tables have them.
_SPELT = (("²", "2"), ("³", "3"), ("ᵢ", "i"), ("½", "1⁄2"), ("…", "..."), ("º", "o"), ("ª", "a"), ("™", "TM"))


def fold(c: str) -> str:
    for sign, letters in _SPELT:
        c = f"replace({c}, '{sign}', '{letters}')"
    return f"strip_accents(nfc_normalize({c}))"


def norm_desktop(c: str) -> str:
    return f"trim(lower(regexp_replace({fold(c)}, '[^a-zA-Z0-9]+', ' ', 'g')))"


def norm_web(c: str) -> str:
    inner = f"regexp_replace({c}, '[\\^`¨¯´·¸]', '', 'g')"
    return f"trim(lower(regexp_replace({fold(inner)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


def stem_desktop(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 6 AND ends_with({t}, 'ciones') THEN left({t}, length({t}) - 5) || 'cion' WHEN length({t}) > 5 AND ends_with({t}, 'cion') THEN {t} "
        f"WHEN length({t}) > 5 AND ends_with({t}, 'es') THEN left({t}, length({t}) - 2) WHEN length({t}) > 4 AND ends_with({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def stem_web(t: str) -> str:
    cases = " ".join(f"WHEN length({t}) > {len(e) + 3} AND ends_with({t}, '{e}') THEN left({t}, length({t}) - {len(e)})" for e in P.WEB_ENDINGS)
    return f"CASE {cases} WHEN length({t}) > 6 AND ends_with({t}, 'es') THEN left({t}, length({t}) - 2) WHEN length({t}) > 5 AND ends_with({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"


def _tokens(normal: str, stop: tuple[str, ...], stem: str) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"list_transform(list_filter(string_split({normal}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({words})), lambda t: {stem})"


def tokens_desktop(c: str) -> str:
    return _tokens(norm_desktop(c), P.DESKTOP_STOP_WORDS, stem_desktop("t"))


def tokens_web(c: str) -> str:
    return _tokens(norm_web(c), P.WEB_STOP_WORDS, stem_web("t"))


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _overlap(qn: str, qt: str, tn: str, tt: str) -> str:
    share = f"len(list_intersect(list_distinct({qt}), list_distinct({tt})))::DOUBLE / len(list_distinct({qt}))"
    phrase = f"CASE WHEN length({qn}) >= 8 AND contains({tn}, {qn}) THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END"
    return f"CASE WHEN len({qt}) > 0 AND len({tt}) > 0 THEN {clamp(f'{share} + {phrase}')} ELSE 0.0::DOUBLE END"


def keyword_overlap(q: str, t: str) -> str:
    return _overlap(norm_desktop(q), tokens_desktop(q), norm_desktop(t), tokens_desktop(t))


def _lexical(qn: str, qt: str, tn: str, tt: str) -> str:
    q = f"list_distinct({qt})"
    often = f"list_sum(list_transform({q}, lambda w: least(3, len(list_filter({tt}, lambda t: t = w)))))::DOUBLE"
    phrase = f"CASE WHEN length({qn}) >= 8 AND contains({tn}, {qn}) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END"
    score = f"len(list_intersect({q}, list_distinct({tt})))::DOUBLE / len({q}) * 0.72::DOUBLE + {often} / (3 * len({q})) * 0.28::DOUBLE + {phrase}"
    return f"CASE WHEN len({qt}) > 0 AND len({tt}) > 0 THEN {clamp(score)} ELSE 0.0::DOUBLE END"


def lexical(q: str, t: str) -> str:
    return _lexical(norm_web(q), tokens_web(q), norm_web(t), tokens_web(t))


_RAW_KEY = "coalesce(nullif(relative_path, ''), nullif(source_path, ''), nullif(file_name, ''))"
_KEY = f"regexp_replace({norm_desktop(_RAW_KEY)}, '\\b(?:copia de|copy of)\\b', ' ', 'g')"
_KEY = f"regexp_replace({_KEY}, '\\b1\\b(\\s*(?:pdf|docx|txt)?)$', ' \\1')"
SOURCE_KEY = f"coalesce(nullif(trim(regexp_replace({_KEY}, '\\s+', ' ', 'g')), ''), file_name, '')"

_BEFORE, _AFTER = "(?:^|[^0-9A-Za-z_])", "(?:$|[^0-9A-Za-z_])"
ANY_YEAR = f"coalesce(regexp_matches(snippet, '{_BEFORE}(?:18|19|20)\\d\\d{_AFTER}'), false)"
ANY_DATE_PRECISE = f"coalesce(regexp_matches(snippet, '(?i){_BEFORE}\\d{{1,2}}(?:\\s+y\\s+\\d{{1,2}})?\\s+de\\s+\\p{{L}}+\\s+de\\s+(?:18|19|20)\\d\\d{_AFTER}'), false)"


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def intents(q: str) -> str:
    return ", ".join(f"{_any(norm_web(q), P.WEB_ASKS[k])} AS asks_{k}" for k in ("date", "person", "change"))


_LOW_TEXT = norm_desktop("concat_ws(' ', relative_path, substring(text, 1, 2200))")
_LOW_HITS = "(" + " + ".join(f"contains({_LOW_TEXT}, '{p}')::INT" for p in P.LOW_SIGNAL_PHRASES) + ")"
_NUMBERED = "len(regexp_extract_all(' ' || substring(coalesce(text, ''), 1, 1600), '[^\\p{L}\\p{N}_]\\d{2,4}\\.'))"
LOW_SIGNAL = f"CASE WHEN {_LOW_HITS} >= 2 THEN 0.14::DOUBLE WHEN {_LOW_HITS} >= 1 AND {_NUMBERED} >= 2 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END"


def usable(v: str) -> str:
    return f"({v} IS NOT NULL AND len({v}) > 0 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


def unit(v: str) -> str:
    d = f"list_transform({v}, lambda x: x::DOUBLE)"
    return f"CASE WHEN {usable(v)} THEN list_transform({d}, lambda x: x / sqrt(list_dot_product({d}, {d}))) END"


def _evidence_bonus(q: str, text: str, normal: str) -> str:
    year = f"regexp_matches({text}, '{_BEFORE}(?:18|19|20)\\d\\d{_AFTER}')"
    full = f"regexp_matches({text}, '(?i){_BEFORE}\\d{{1,2}}\\s+de\\s+\\p{{L}}+\\s+de\\s+(?:18|19|20)\\d\\d{_AFTER}')"
    # a name may begin after anything that isn't an ASCII letter or digit if its first letter is one, and the other way round
    person = f"regexp_matches({text}, '(?:(?:^|[^0-9A-Za-z_])[A-Z]|[0-9A-Za-z_][À-ÖØ-Þ])\\p{{Ll}}+(?:\\s+(?:[A-Z]\\.\\s+)?\\p{{Lu}}\\p{{Ll}}+)*\\s+(?:[A-Z]\\.\\s+)?\\p{{Lu}}\\p{{Ll}}*(?:[a-z](?:$|[^0-9A-Za-z_])|[ß-ÿ][0-9A-Za-z_])')"
    return (
        f"coalesce(CASE WHEN {_any(q, P.WEB_ASKS['date'])} AND {year} THEN CASE WHEN {full} THEN 0.18 ELSE 0.08 END ELSE 0.0 END::DOUBLE "
        f"+ CASE WHEN {_any(q, P.WEB_ASKS['person'])} AND {person} THEN 0.08 ELSE 0.0 END::DOUBLE "
        f"+ CASE WHEN {_any(q, P.WEB_ASKS['change'])} AND {_any(normal, P.WEB_CHANGES)} THEN 0.08 ELSE 0.0 END::DOUBLE, 0.0::DOUBLE)"
    )


def search_web(mode: str) -> str:
    text = "concat_ws('\n', coalesce(source_name, ''), coalesce(location, ''), coalesce(text, ''), coalesce(array_to_string(list_transform(list_sort(map_entries(metadata)), lambda e: e.key || ': ' || e.value), ' '), ''))"
    both = "(v IS NOT NULL AND qv IS NOT NULL AND len(v) = len(qv))"
    semantic = "0.0::DOUBLE" if mode == "literal" else f"CASE WHEN {both} THEN {clamp('list_dot_product(v, qv)')} ELSE 0.0::DOUBLE END"
    a, b = {"literal": (0, 1), "semantic": (0.88, 0.12), "hybrid": (0.58, 0.42)}[mode]
    blend = "lex" if mode == "literal" else f"CASE WHEN {both} THEN {a}::DOUBLE * sem + {b}::DOUBLE * lex ELSE lex END"
    return (
        f"WITH q AS MATERIALIZED (SELECT query_id, {norm_web('query_text')} AS qn, {tokens_web('query_text')} AS qt, {unit('embedding')} AS qv FROM queries WHERE query_id % 50 = 0 AND length(trim(query_text)) > 0), "
        f"c0 AS (SELECT chunk_id, source_id, text, {unit('embedding')} AS v, {norm_web(text)} AS n FROM {CHUNKS} c), "
        f"c AS MATERIALIZED (SELECT *, {_tokens('n', P.WEB_STOP_WORDS, stem_web('t'))} AS tt FROM c0), "
        f"p AS (SELECT query_id, chunk_id, source_id, qn, text, n, v, qv, {_lexical('qn', 'qt', 'n', 'tt')} AS lex, {semantic} AS sem FROM q, c), "
        f"s AS (SELECT *, {clamp(f'{blend} + {_evidence_bonus("qn", "text", "n")}')} AS score, CASE WHEN contains(n, qn) AND qn <> '' THEN 'frase' WHEN sem >= 0.5 AND lex >= 0.2 THEN 'mixta' WHEN sem >= 0.5 THEN 'idea' ELSE 'palabras' END AS match_kind FROM p), "
        "f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, chunk_id) AS k FROM s WHERE score >= 0.08), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k > 2, score DESC, chunk_id) AS rank FROM f) "
        "SELECT query_id, rank::BIGINT AS rank, chunk_id, round(score, 6) AS score, match_kind FROM r WHERE rank <= 12"
    )


_TITLE = "concat_ws(' ', source_name, relative_path)"
SEARCH_DESKTOP = (
    f"WITH q AS MATERIALIZED (SELECT query_id, {norm_desktop('query_text')} AS qn, {tokens_desktop('query_text')} AS qt, {unit('embedding')} AS qv FROM queries WHERE query_id % 50 = 0 AND length(trim(query_text)) > 0), "
    f"c AS MATERIALIZED (SELECT chunk_id, source_name, relative_path, text, {unit('embedding')} AS v FROM {CHUNKS} c WHERE {usable('embedding')}), "
    "p AS (SELECT q.*, c.* EXCLUDE (v), 1 - list_dot_product(qv, v) AS d FROM q, c WHERE len(qv) = len(v)), "
    "n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) <= 48), "
    f"t AS (SELECT *, {norm_desktop(_TITLE)} AS tn, {norm_desktop(f'concat_ws(chr(32), {_TITLE}, text)')} AS dn, {LOW_SIGNAL} AS low FROM n), "
    f"w AS (SELECT *, {_tokens('tn', P.DESKTOP_STOP_WORDS, stem_desktop('t'))} AS tt, {_tokens('dn', P.DESKTOP_STOP_WORDS, stem_desktop('t'))} AS dt FROM t), "
    f"x AS (SELECT *, {clamp('1 - d')} AS sem, {_overlap('qn', 'qt', 'dn', 'dt')} AS kw, {_overlap('qn', 'qt', 'tn', 'tt')} AS ti FROM w), "
    f"y AS (SELECT *, {clamp('0.74::DOUBLE * sem + 0.18::DOUBLE * kw + 0.08::DOUBLE * ti + CASE WHEN ti >= 0.34 THEN 0.04 ELSE 0.0 END::DOUBLE - low - CASE WHEN kw = 0 AND ti = 0 AND sem < 0.62 THEN 0.05 ELSE 0.0 END::DOUBLE')} AS rel FROM x), "
    f"z AS (SELECT *, {SOURCE_KEY.replace('source_path', chr(39) * 2).replace('file_name', 'source_name')} AS k FROM y), "
    "u AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY rel DESC, d, chunk_id) AS kn, max(rel) OVER (PARTITION BY query_id) AS best FROM z), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kn > 3, rel DESC, d, chunk_id) AS place FROM u), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM o WHERE best < 0.32 OR rel >= 0.32) "
    "SELECT query_id, rank::BIGINT AS rank, chunk_id, round(rel, 6) AS relevance, round(kw, 6) AS keyword_score, round(ti, 6) AS title_score FROM l WHERE rank <= 8"
)

_UNIT = "regexp_replace(u, '^[ \\-\\t\\r\\n]+|[ \\-\\t\\r\\n]+$', '', 'g')"
SENTENCE_UNITS = (
    "WITH s AS (SELECT result_id, unnest(string_split(regexp_replace(trim(regexp_replace(snippet, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS u FROM " + RESULTS + " r), "
    f"t AS (SELECT result_id, {_UNIT} AS u FROM s) SELECT result_id, count(*)::BIGINT AS units, sum(length(u))::BIGINT AS characters, "
    "(count(*) FILTER (len(list_filter(regexp_split_to_array(u, '\\s+'), lambda w: w <> '')) < 8 OR regexp_matches(u, '^\\p{Ll}') OR left(u, 1) IN ('(', ')', ',', ';', ':') OR length(regexp_replace(u, '[^(]', '', 'g')) > length(regexp_replace(u, '[^)]', '', 'g'))))::BIGINT AS fragments "
    "FROM t WHERE length(u) BETWEEN 70 AND 520 GROUP BY result_id"
)

RELEVANCE_SUMMARY = (
    f"WITH r AS (SELECT query_id, {SCORE} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {SCORE} DESC, result_id) AS place FROM {RESULTS} r) "
    "SELECT query_id, count(*)::BIGINT AS results, (count(*) FILTER (place <= 12))::BIGINT AS shown, round(avg(score) FILTER (place <= 12), 4) AS mean_score FROM r GROUP BY query_id"
)

_JS = "[\\s\\x0b\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_PY = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_PY_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def _squeezed(c: str, blank: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{blank}+', ' ', 'g'), '^ | $', '', 'g')"


def _blocks(text: str, separator: str, body: str, word: str) -> str:
    return (
        f"WITH d AS (SELECT doc_id, regexp_split_to_array({text}, '{separator}') AS b FROM documents WHERE text IS NOT NULL), "
        "u AS (SELECT doc_id, unnest(b) AS raw, unnest(range(len(b))) AS i FROM d), "
        "l AS (SELECT doc_id, i, raw, 1 + coalesce(sum(length(raw) - length(replace(raw, chr(10), '')) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM u), "
        f"t AS (SELECT doc_id, i, line, {body} AS text FROM l) "
        f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS seg_idx, text, '{word}' || line::BIGINT AS location FROM t WHERE text <> ''"
    )


TEXT_BLOCKS_WEB = _blocks(f"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^{_JS}+|{_JS}+$', '', 'g')", "\\n[\\s\\x{a0}\\x{feff}]*\\n", _squeezed("raw", _JS), "línea ")
TEXT_BLOCKS_DESKTOP = _blocks(
    "regexp_replace(text, '\\r\\n?', chr(10), 'g')", "\\n\\n", f"array_to_string(list_filter(list_transform(regexp_split_to_array(raw, '{_PY_BREAK}'), lambda x: {_squeezed('x', _PY)}), lambda x: x <> ''), chr(10))", "linea "
)

_RTF = "regexp_replace(regexp_replace(text, '\\\\''[0-9a-fA-F]{2}', ' ', 'g'), '\\\\[a-zA-Z]+-?\\d* ?', ' ', 'g')"
RTF_TEXT = (
    f"SELECT doc_id, {_squeezed(f'regexp_replace({_RTF}, {chr(39)}[{{}}]{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})', _JS)} AS web, "
    f"regexp_replace(replace(replace(replace({_RTF}, '\\{{', '{{'), '\\}}', '}}'), '\\\\', '\\'), '[{{}}]', ' ', 'g') AS desktop FROM documents"
)
OCR_TEXT = (
    f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\\t\\x0b\\f\\r ]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_JS}+|{_JS}+$', '', 'g') AS normal FROM {PAGES} p"
)
_NORMAL_OCR = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\\t\\x0b\\f\\r ]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^" + _JS + "+|" + _JS + "+$', '', 'g')"
OCR_MERGE = (
    f"WITH p AS (SELECT scan_id, page_number, text, {_NORMAL_OCR} AS o, confidence >= 95 AND NOT isnan(confidence) AS own FROM {PAGES} p), "
    "q AS (SELECT *, CASE WHEN own THEN text END AS t FROM p), r AS (SELECT *, len(regexp_extract_all(coalesce(t, ''), '[\\p{L}\\p{N}]')) < 40 AS poor FROM q), "
    f"m AS (SELECT scan_id, page_number, CASE WHEN poor THEN nullif(o, '') ELSE {_squeezed('t', _JS)} END AS text, 'página ' || page_number || CASE WHEN poor THEN ' · OCR' ELSE '' END AS location FROM r) SELECT * FROM m WHERE text IS NOT NULL"
)

# --- windows and packing: one row a step of the recursion


def _last_mark(text: str, start: str, bound: str, marks: tuple[str, ...]) -> str:
    """The place before which the last mark within ``text``'s first ``bound`` characters stands, counted from 0; -1 if there is none."""
    # a line end of two characters would be turned round as one
    head = f"substring({text}, 1, ({bound})::INT)"
    found = [f"CASE WHEN contains({head}, {m}) THEN length({head}) - instr(reverse(replace({head}, chr(13), chr(1))), reverse({m})) - length({m}) + 1 ELSE -1 END" for m in marks]
    return f"greatest({', '.join(found)})"


def windows(key: str, source: str, profile: str) -> str:
    """(key, part, chunk) of the rows (key, t) of ``source``, t being tidy."""
    p = P.DESKTOP if profile == "desktop" else P.WEB
    marks = ("'. '", "chr(10)") if profile == "desktop" else ("'. '", "'; '")
    beyond = 0 if profile == "desktop" else 2
    least = p.chunk_size // 2 if profile == "desktop" else p.chunk_size * 0.55
    mark = _last_mark("t", "s", f"s + {p.chunk_size + beyond}", marks)
    end = f"CASE WHEN s + {p.chunk_size} >= length(t) THEN length(t) WHEN {mark} > s + {least} THEN {mark} + 1 ELSE s + {p.chunk_size} END"
    strip = f"regexp_replace(substring(t, (s + 1)::INT, (e - s)::INT), '^{_PY}+|{_PY}+$', '', 'g')"
    return (
        f"WITH RECURSIVE t0 AS (SELECT {key}, t FROM ({source}) WHERE length(t) > 0), "
        f"w AS (SELECT {key}, t, 0::BIGINT AS s, (SELECT {end} FROM (SELECT 0 AS s)) AS e, 0 AS i FROM t0 "
        f"UNION ALL SELECT {key}, t, s, {end} AS e, i FROM (SELECT {key}, t, greatest(s + 1, e - {p.chunk_overlap}) AS s, i + 1 AS i FROM w WHERE e < length(t))), "
        f"c AS (SELECT {key}, i, {strip} AS chunk FROM w)"
    )


SPLIT_DESKTOP = windows("doc_id", f"SELECT doc_id, regexp_replace(text, '^{_PY}+|{_PY}+$', '', 'g') AS t FROM documents", "desktop") + (
    " SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS part, chunk FROM c WHERE chunk <> ''"
)
_WEB_TIDY = _squeezed("text", "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]")
SPLIT_WEB = (
    windows("k", f"SELECT doc_id || ':' || seg_idx AS k, {_WEB_TIDY} AS t FROM ({TEXT_BLOCKS_WEB})", "web")
    + f", b AS (SELECT doc_id || ':' || seg_idx AS k, doc_id, seg_idx, location FROM ({TEXT_BLOCKS_WEB})), n AS (SELECT k, count(*) AS n FROM c GROUP BY k) "
    "SELECT doc_id, seg_idx, CASE WHEN n > 1 THEN location || ', parte ' || (i + 1) ELSE location END AS location, chunk AS text, i::INT AS part FROM c JOIN b USING (k) JOIN n USING (k)"
)
_SEGMENTS = "(SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY ingested_at) = 1)"
_STRIPPED = f"regexp_replace(text, '^{_PY}+|{_PY}+$', '', 'g')"
_SIZE = P.DESKTOP.chunk_size
#: Every source in its order, a step a segment; a step closes the open chunk or adds to it.
PACK_SEGMENTS = (
    windows("segment_id", f"SELECT segment_id, {_STRIPPED} AS t FROM {_SEGMENTS} WHERE length({_STRIPPED}) > {_SIZE}", "desktop")
    + f", x AS (SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY i) AS j, chunk FROM c WHERE chunk <> ''), k AS (SELECT segment_id, count(*)::INT AS parts FROM x GROUP BY segment_id), "
    f"g AS (SELECT base_id, source_id, segment_id, {_STRIPPED} AS t, coalesce(location, '') AS l, row_number() OVER (PARTITION BY base_id, source_id ORDER BY seg_idx NULLS FIRST, segment_id) AS r FROM {_SEGMENTS} s WHERE {_STRIPPED} <> ''), "
    "h AS (SELECT g.*, coalesce(parts, 0) AS parts FROM g LEFT JOIN k USING (segment_id)), "
    # n: the number of the chunk that the segment is in or begins; held: what the open chunk holds after it
    "p AS (SELECT base_id, source_id, segment_id, r, t, l, parts, 0 AS n, CASE WHEN parts > 0 THEN parts ELSE 1 END AS upto, CASE WHEN parts > 0 THEN 0 ELSE length(t) + 1 END AS held FROM h WHERE r = 1 "
    "UNION ALL SELECT h.base_id, h.source_id, h.segment_id, h.r, h.t, h.l, h.parts, CASE WHEN joins THEN p.upto - 1 ELSE p.upto END, "
    "CASE WHEN h.parts > 0 THEN p.upto + h.parts WHEN joins THEN p.upto ELSE p.upto + 1 END, CASE WHEN h.parts > 0 THEN 0 WHEN joins THEN p.held + length(h.t) + 1 ELSE length(h.t) + 1 END "
    f"FROM (SELECT p.*, h.segment_id AS next_id, p.held > 0 AND h.parts = 0 AND p.held + length(h.t) + 1 <= {_SIZE} AS joins FROM p JOIN h ON h.base_id IS NOT DISTINCT FROM p.base_id AND h.source_id IS NOT DISTINCT FROM p.source_id AND h.r = p.r + 1) p JOIN h ON h.segment_id = next_id), "
    "o AS (SELECT base_id, source_id, n AS chunk_index, string_agg(t, chr(10) ORDER BY r) AS text, coalesce(nullif(min_by(l, r), ''), 'ubicacion aproximada desconocida') AS location FROM p WHERE parts = 0 GROUP BY base_id, source_id, n "
    "UNION ALL SELECT base_id, source_id, n + j - 1, chunk, l || ', parte ' || j FROM p JOIN x USING (segment_id)) "
    "SELECT base_id, source_id, chunk_index::INT AS chunk_index, text, location FROM o"
)

# --- names of persons: the edges of ASCII words are marked, twice, so that two names may share one
_MARKED = "regexp_replace({}, '([0-9A-Za-z_]+)', chr(1) || chr(1) || '\\1' || chr(1) || chr(1), 'g')"
_M = "\\x01*"
_NAME = f"\\p{{Lu}}(?:{_M}\\p{{Ll}})+"
_PERSONS = f"\\x01+{_NAME}(?:{_M}\\s+{_M}(?:[A-Z]{_M}\\.{_M}\\s+{_M})?{_NAME})+\\x01"


def person_count(c: str) -> str:
    return f"len(regexp_extract_all({_MARKED.format(c)}, '{_PERSONS}'))"


# --- sentences, concepts, statements


def query_norm(c: str) -> str:
    return f"regexp_replace(translate(lower({c}), 'áéíóúüñ', 'aeiouun'), '^{_PY}+|{_PY}+$', '', 'g')"


def units(c: str) -> str:
    """The list of a text's sentences of 70 to 520 characters, longer ones in runs of words."""
    sentences = f"string_split(regexp_replace({_squeezed(c, _PY)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    tidy = f"list_transform({sentences}, lambda s: regexp_replace(s, '^[ \\-\\t\\r\\n]+|[ \\-\\t\\r\\n]+$', '', 'g'))"
    runs = "string_split(list_reduce(string_split(s, ' '), lambda a, w: CASE WHEN length(list_last(string_split(a, chr(1)))) >= 360 THEN a || chr(1) || w ELSE a || ' ' || w END), chr(1))"
    return f"flatten(list_transform(list_filter({tidy}, lambda s: length(s) >= 70), lambda s: CASE WHEN length(s) <= 520 THEN [s] ELSE {runs} END))"


def fragment(u: str) -> str:
    return (
        f"(len(list_filter(regexp_split_to_array({u}, '\\s+'), lambda w: w <> '')) < 8 OR regexp_matches({u}, '^\\p{{Ll}}') OR left({u}, 1) IN ('(', ')', ',', ';', ':') "
        f"OR length(regexp_replace({u}, '[^(]', '', 'g')) > length(regexp_replace({u}, '[^)]', '', 'g')))"
    )


def clean_unit(c: str) -> str:
    return f"regexp_replace(substring({_squeezed(c, _PY)}, 1, 520), '{_PY}+$', '')"


def dedupe_key(c: str) -> str:
    return f"substring(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), 1, 160)"


def similar(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"(len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) >= 0.72)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_text(w) for w in words) + "]::VARCHAR[]"


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in table.items()) + f" ELSE {key} END"


def concept_label(plain: str) -> str:
    bare = f"regexp_replace({_squeezed(f'regexp_replace({plain}, {_text(chr(92) + "b(?:" + "|".join(P.CONCEPT_FILLERS) + ")" + chr(92) + "b")}, {_text(" ")}, {_text("g")})', _PY)}, '^[ ?.,;:]+|[ ?.,;:]+$', '', 'g')"
    words = f"array_to_string(list_transform(string_split(b, ' '), lambda w: {_case(P.CONCEPT_ALIASES, 'w')}), ' ')"
    return f"(SELECT CASE WHEN {_case(P.CONCEPT_ALIASES, 'b')} <> b THEN {_case(P.CONCEPT_ALIASES, 'b')} WHEN length({words}) > 6 AND ends_with({words}, 'i') THEN {words} || 'o' ELSE {words} END FROM (SELECT {bare} AS b))"


def concept_of(q: str) -> str:
    """Of a query that is normalised already."""
    asked = " ".join(f"WHEN regexp_matches({q}, {_text(p)}) THEN {concept_label(f'regexp_extract({q}, {_text(p)}, 1)')}" for p in P.CONCEPT_PATTERNS)
    words = f"list_filter(string_split({_squeezed(q, _PY)}, ' '), lambda w: length(w) >= 3)"
    return (
        f"CASE WHEN contains({q}, 'construccion') AND contains({q}, 'demanda') THEN 'construccion de la demanda' {asked} "
        f"WHEN len({words}) BETWEEN 1 AND 3 THEN {concept_label(f'array_to_string({words}, chr(32))')} END"
    )


def variants(c: str) -> str:
    known = " ".join(f"WHEN {c} = {_text(k)} THEN {_list(v)}" for k, v in P.CONCEPT_VARIANTS.items())
    return f"list_concat([{c}], CASE {known} WHEN ends_with({c}, 'cion') THEN [{c} || 'es', replace({c}, 'cion', 'cional')] WHEN ends_with({c}, 'dad') THEN [left({c}, length({c}) - 3) || 'des'] ELSE []::VARCHAR[] END)"


def anchors(concept: str) -> str:
    stem = f"CASE WHEN right({concept}, 1) IN ('o', 'a') THEN [left({concept}, length({concept}) - 1)] ELSE []::VARCHAR[] END"
    return f"list_sort(list_distinct(list_transform(list_filter(list_concat({variants(concept)}, {stem}), lambda w: length(w) >= 4), lambda w: {query_norm('w')})))"


CONCEPTS = (
    f"WITH q AS (SELECT query_id, {query_norm('query_text')} AS q, query_text FROM queries), c AS (SELECT query_id, query_text, {concept_of('q')} AS concept, {concept_label('q')} AS label FROM q) "
    f"SELECT query_id, concept, array_to_string(list_sort(list_distinct({variants('concept')})), '|') AS variants, array_to_string({anchors('label')}, '|') AS anchors, "
    f"CASE WHEN concept IS NOT NULL THEN array_to_string(list_concat([concept], {variants('concept')}, [concept, query_text]), ' ') END AS longer FROM c"
)

HITS = f"SELECT query_id, query_text AS query, snippet, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, result_id)::INT AS rank FROM {RESULTS} r JOIN queries USING (query_id) WHERE relevance IS NOT NULL AND NOT isnan(relevance) AND snippet IS NOT NULL QUALIFY rank <= 8"
_WORD_EDGE = "[^\\p{L}\\p{N}_]"


def _question_bonus(q: str, text: str, plain: str) -> str:
    date = f"regexp_matches({text}, '(?i)(?:^|{_WORD_EDGE})\\d{{1,2}}\\s+de\\s+[a-záéíóúñ]+\\s+de\\s+(?:18|19|20)\\d\\d(?:$|{_WORD_EDGE})')"
    year = f"regexp_matches({text}, '(?:^|{_WORD_EDGE})(?:18|19|20)\\d\\d(?:$|{_WORD_EDGE})')"
    name = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"
    person = f"regexp_matches({text}, '(?:^|{_WORD_EDGE}){name}(?:\\s+{name})+(?:$|{_WORD_EDGE})')"
    return (
        f"(CASE WHEN {_any(q, P.DESKTOP_ASKS['date'])} THEN CASE WHEN {date} THEN 0.48 WHEN {year} THEN 0.28 ELSE 0.0 END ELSE 0.0 END::DOUBLE "
        f"+ CASE WHEN {_any(q, P.DESKTOP_ASKS['person'])} AND {person} THEN 0.16 ELSE 0.0 END::DOUBLE + CASE WHEN {_any(q, P.DESKTOP_ASKS['change'])} AND {_any(plain, P.DESKTOP_CHANGES)} THEN 0.18 ELSE 0.0 END::DOUBLE)"
    )


def claims(hits: str, name: str, require_anchor: bool = False) -> str:
    """Common tables, the last of them ``name`` (query_id, claims list of claim and source)."""
    n = name
    return (
        f"{n}0 AS (SELECT query_id, rank, relevance, query, unnest({units('snippet')}) AS u, unnest(range(len({units('snippet')}))) AS pos FROM {hits}), "
        f"{n}1 AS MATERIALIZED (SELECT query_id, {concept_label(query_norm('query'))} AS label, {norm_desktop('query')} AS qn, {tokens_desktop('query')} AS qt, {query_norm('query')} AS qq FROM (SELECT DISTINCT query_id, query FROM {hits})), "
        f"{n}2 AS (SELECT query_id, qn, qt, qq, {anchors('label')} AS anchors FROM {n}1), "
        f"{n}3 AS (SELECT *, {norm_desktop('u')} AS un, {tokens_desktop('u')} AS ut, {query_norm('u')} AS up FROM {n}0 JOIN {n}2 USING (query_id) WHERE NOT {fragment('u')}), "
        f"{n}4 AS (SELECT *, len(list_filter(anchors, lambda a: contains(up, a))) > 0 AS anchored FROM {n}3), "
        f"{n}5 AS (SELECT *, 0.52::DOUBLE * ({_overlap('qn', 'qt', 'un', 'ut')}) + 0.30::DOUBLE * relevance + {_question_bonus('qq', 'u', 'up')} + CASE WHEN anchored THEN 0.18 ELSE 0.0 END::DOUBLE AS score FROM {n}4{' WHERE anchored' if require_anchor else ''}), "
        f"{n}6 AS (SELECT query_id, rank, {clean_unit('u')} AS claim, {dedupe_key(clean_unit('u'))} AS key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS i FROM {n}5 WHERE score >= 0.18), "
        f"{n}7 AS (SELECT query_id, 1::BIGINT AS i, CASE WHEN key <> '' THEN [key] ELSE []::VARCHAR[] END AS keys, CASE WHEN key <> '' THEN [{{'claim': claim, 'source': rank}}] ELSE [] END AS claims FROM {n}6 WHERE i = 1 "
        f"UNION ALL SELECT query_id, i, CASE WHEN good THEN list_append(keys, key) ELSE keys END, CASE WHEN good THEN list_append(claims, {{'claim': claim, 'source': rank}}) ELSE claims END "
        f"FROM (SELECT e.*, keys, claims, len(keys) < 8 AND key <> '' AND NOT list_contains(keys, key) AND len(list_filter(keys, lambda k: {similar('key', 'k')})) = 0 AS good FROM {n}7 g JOIN {n}6 e ON e.query_id = g.query_id AND e.i = g.i + 1)), "
        f"{n} AS (SELECT query_id, max_by(claims, i) AS claims FROM {n}7 GROUP BY query_id)"
    )


CLAIMS = f"WITH RECURSIVE h AS MATERIALIZED ({HITS}), {claims('h', 'k')} SELECT query_id, pos::INT AS pos, c.claim AS claim, c.source AS source FROM (SELECT query_id, unnest(claims) AS c, unnest(range(len(claims))) AS pos FROM k)"
_LINES = "list_transform({}[1:6], lambda c: '- ' || c.claim || ' [' || c.source || ']')"
EXTRACTIVE = (
    f"WITH RECURSIVE h AS MATERIALIZED ({HITS}), {claims('h', 'k')}, b AS (SELECT query_id, count(*) AS n, list({{'claim': trim(substring(snippet, 1, 360)), 'source': rank}} ORDER BY rank) FILTER (rank <= 4 AND trim(substring(snippet, 1, 360)) <> '') AS b FROM h GROUP BY query_id), "
    "x AS (SELECT query_id, n, CASE WHEN len(claims) > 0 THEN claims ELSE b END AS cs FROM b LEFT JOIN k USING (query_id)) "
    f"SELECT query_id, array_to_string(list_concat([{_text(P.EXTRACTIVE_HEAD)}, ''], {_LINES.format('cs')}, CASE WHEN n >= 2 THEN ['', {_text(P.EXTRACTIVE_TAIL)}] ELSE []::VARCHAR[] END), chr(10)) AS text FROM x"
)


def _themes(concept: str) -> str:
    def listed(themes) -> str:
        return "[" + ", ".join(f"{{'label': {_text(label)}, 'words': {_list(words) if words else f'[{concept}]'}}}" for label, words in themes) + "]"

    known = " ".join(f"WHEN {query_norm(concept)} = {_text(k)} THEN {listed(v)}" for k, v in P.CONCEPT_THEMES.items())
    return f"CASE {known} ELSE {listed(P.GENERAL_THEMES)} END"


_CITES = "array_to_string(list_transform({}, lambda s: '[' || s || ']'), '')"
#: Sources are cited once each, in the order in which they come.
_ONCE = "list_filter({0}, lambda s, i: list_position({0}, s) = i)"
_FOUR = "list_transform(parts[1:4], lambda p: p.source)"
_SOURCES = f"CASE WHEN len(parts) > 0 THEN {_FOUR} ELSE list_transform(cs[1:3], lambda c: c.source) END"
CONCEPT_ANSWERS = (
    f"WITH RECURSIVE h0 AS MATERIALIZED ({HITS}), q AS MATERIALIZED (SELECT query_id, {concept_of('q')} AS concept FROM (SELECT DISTINCT query_id, {query_norm('query')} AS q FROM h0)), "
    "h AS MATERIALIZED (SELECT query_id, concept AS query, snippet, relevance, rank FROM h0 JOIN q USING (query_id) WHERE concept IS NOT NULL), "
    f"{claims('h', 'k', True)}, {claims('h', 'm')}, "
    f"u AS (SELECT query_id, query, rank, {query_norm('snippet')} AS t, {clean_unit(f'list_filter({units("snippet")}, lambda u: NOT {fragment("u")})[1]')} AS u FROM h), "
    "r AS (SELECT query_id, query AS concept, list({'rank': rank, 't': t, 'u': u} ORDER BY rank) AS r FROM u GROUP BY query_id, query), "
    f"p AS (SELECT query_id, concept, r, list_filter(list_transform({_themes('concept')}, lambda t: {{'label': t.label, 'source': list_filter(r, lambda s: len(list_filter(t.words, lambda w: contains(s.t, w))) > 0)[1].rank}}), lambda p: p.source IS NOT NULL) AS parts FROM r), "
    "c AS (SELECT p.*, CASE WHEN len(k.claims) > 0 THEN k.claims WHEN len(m.claims) > 0 THEN m.claims ELSE list_transform(list_filter(r[1:5], lambda s: s.u IS NOT NULL), lambda s: {'claim': s.u, 'source': s.rank}) END AS cs FROM p LEFT JOIN k USING (query_id) LEFT JOIN m USING (query_id)), "
    f"d AS (SELECT query_id, concept, parts, cs, array_to_string(list_transform(parts[1:4], lambda p: p.label), ', ') AS labels, {_CITES.format(_ONCE.format('src'))} AS cites FROM (SELECT *, {_SOURCES} AS src FROM c)) "
    "SELECT query_id, concept, CASE WHEN len(parts) = 0 AND coalesce(len(cs), 0) = 0 THEN 'sin resultados' ELSE array_to_string(list_concat(['**Concepto: ' || concept || '**', '', "
    "CASE WHEN len(parts) > 0 THEN 'En tus materiales, **' || concept || '** no queda como una palabra aislada: aparece como una noción que articula ' || labels || '. ' || cites "
    "ELSE 'En tus materiales, **' || concept || '** se reconstruye a partir de varios usos y ejemplos, más que como una definición única cerrada. [' || cs[1].source || ']' END, '', '**Rasgos principales en tus fuentes:**'], "
    f"{_LINES.format('cs')}, ['', '**Definición de trabajo:**', CASE WHEN len(parts) > 0 THEN 'Para usarlo en una tarea, podés tomar **' || concept || '** como una categoría de lectura que permite ordenar ' || labels || ', siempre apoyándote en las fuentes recuperadas. ' || cites "
    "ELSE 'Para usarlo en una tarea, conviene presentar **' || concept || '** como una categoría que se define por los rasgos repetidos en las fuentes recuperadas. ' || cites END]), chr(10)) END AS text FROM d"
)


# --- evidence


def evidence(key: str, source: str, name: str, most: int = 760) -> str:
    """Common tables, the last of them ``name`` (key, evidence), of the rows (key, t, qn, qt) of ``source``, t being squeezed."""
    lex = _lexical("qn", "qt", "n", "tt")
    return (
        f"{name}0 AS (SELECT {key}, t, qn, qt, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM {source} WHERE length(t) > {most}), "
        f"{name}1 AS (SELECT {key}, qn, qt, ss, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM {name}0), {name}2 AS (SELECT *, {norm_web('s')} AS n FROM {name}1), {name}3 AS (SELECT *, {_tokens('n', P.WEB_STOP_WORDS, stem_web('t'))} AS tt FROM {name}2), "
        f"{name}4 AS (SELECT {key}, ss, i, {lex} + {_evidence_bonus('qn', 's', 'n')} AS score FROM {name}3), "
        f"{name}5 AS (SELECT {key}, ss, i, ss[i + 1] AS s, CASE WHEN i > 0 THEN ss[i] END AS before, ss[i + 2] AS after FROM {name}4 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, i) = 1), "
        f"{name}6 AS (SELECT *, coalesce(length(s) + length(before) + 1 <= {most}, false) AS wb FROM {name}5), "
        f"{name}7 AS (SELECT *, coalesce(length(s) + CASE WHEN wb THEN length(before) + 1 ELSE 0 END + length(after) + 1 <= {most}, false) AS wa FROM {name}6), "
        f"{name} AS (SELECT {key}, concat_ws(' ', CASE WHEN wb THEN before END, s, CASE WHEN wa THEN after END) AS evidence FROM {name}7 UNION ALL SELECT {key}, t FROM {source} WHERE length(t) <= {most})"
    )


_ASKED = f"SELECT query_id, {norm_web('query_text')} AS qn, {tokens_web('query_text')} AS qt FROM queries"
SELECT_EVIDENCE = (
    f"WITH q AS MATERIALIZED ({_ASKED}), z AS (SELECT count(*) AS n FROM queries), d AS MATERIALIZED (SELECT doc_id, {_squeezed('text', _JS)} AS t, qn, qt FROM documents, z JOIN q ON q.query_id = doc_id % z.n WHERE text IS NOT NULL), "
    f"{evidence('doc_id', 'd', 'e')} SELECT doc_id, evidence FROM e"
)


def search_hits(mode: str) -> str:
    """Common tables, the last of them ``hit`` with every hit of the searches and its evidence."""
    found = search_web(mode)
    return (
        f"r0 AS MATERIALIZED ({found}), qa AS MATERIALIZED ({_ASKED} WHERE query_id % 50 = 0), "
        f"rt AS MATERIALIZED (SELECT r0.query_id || ':' || rank AS k, r0.*, source_id, {_squeezed('text', _JS)} AS t, qn, qt FROM r0 JOIN {CHUNKS} c USING (chunk_id) JOIN qa USING (query_id)), "
        f"{evidence('k', 'rt', 'e')}, hit AS (SELECT rt.*, evidence FROM rt LEFT JOIN e USING (k))"
    )


def searched(mode: str) -> str:
    return f"WITH {search_hits(mode)} SELECT query_id, rank, chunk_id, score, match_kind, evidence FROM hit"


_HAS_YEAR = f"coalesce(regexp_matches(evidence, '{_BEFORE}(?:18|19|20)\\d\\d{_AFTER}'), false)"
_PRECISE = ANY_DATE_PRECISE.replace("snippet", "evidence")
EVIDENCE_ANSWER = (
    f"WITH RECURSIVE {search_hits('hybrid')}, v AS (SELECT *, {_HAS_YEAR} AS dated, CASE WHEN {_PRECISE} THEN 2 WHEN {_HAS_YEAR} THEN 1 ELSE 0 END AS precise, {person_count('evidence')} AS persons, substring({norm_web('evidence')}, 1, 180) AS key FROM hit), "
    f"c AS (SELECT query_id, 0 AS turn, 4.0::DOUBLE AS p, rank, {_text(P.REASON_DATE)} AS reason, key, chunk_id, source_id, evidence FROM v WHERE dated AND {_any('qn', P.WEB_ASKS['date'])} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY precise + score DESC, rank) = 1 "
    f"UNION ALL SELECT query_id, 1, 3.0, rank, {_text(P.REASON_PERSON)}, key, chunk_id, source_id, evidence FROM v WHERE persons > 0 AND {_any('qn', P.WEB_ASKS['person'])} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY persons + score DESC, rank) = 1 "
    f"UNION ALL SELECT query_id, 2, score, rank, CASE WHEN match_kind = 'idea' THEN {_text(P.REASON_CONCEPT)} ELSE {_text(P.REASON_PASSAGE)} END, key, chunk_id, source_id, evidence FROM v), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, turn, rank) AS i FROM c), "
    "g AS (SELECT query_id, 0::BIGINT AS i, []::VARCHAR[] AS keys, []::VARCHAR[] AS sources, []::BIGINT[] AS taken FROM (SELECT DISTINCT query_id FROM o) "
    "UNION ALL SELECT query_id, i, CASE WHEN good THEN list_append(keys, key) ELSE keys END, CASE WHEN good THEN list_append(sources, coalesce(source_id, '')) ELSE sources END, CASE WHEN good THEN list_append(taken, i) ELSE taken END "
    "FROM (SELECT o.*, keys, sources, taken, len(keys) < 3 AND key <> '' AND NOT list_contains(keys, key) AND len(list_filter(sources, lambda s: s = coalesce(source_id, ''))) < 2 AS good FROM g JOIN o ON o.query_id = g.query_id AND o.i = g.i + 1)), "
    "f AS (SELECT query_id, max_by(taken, i) AS taken FROM g GROUP BY query_id) "
    "SELECT query_id, (list_position(taken, i) - 1)::BIGINT AS pos, evidence AS text, chunk_id, reason FROM f JOIN o USING (query_id) WHERE list_contains(taken, i)"
)


TRIM_SNIPPET = f"SELECT doc_id, CASE WHEN length(t) <= 1400 THEN t ELSE regexp_replace(substring(t, 1, 1399), '{_PY}+$', '') || '...' END AS snippet FROM (SELECT doc_id, {_STRIPPED} AS t FROM documents)"
FLATTEN_ORDERS = (
    "WITH e AS (SELECT o_orderkey, list_filter(['o_orderkey: ' || o_orderkey, 'o_custkey: ' || o_custkey, 'o_orderstatus: ' || nullif(trim(o_orderstatus), ''), "
    "'o_totalprice: ' || CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END, "
    "'o_orderdate: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'o_orderpriority: ' || nullif(trim(o_orderpriority), '')], lambda x: x IS NOT NULL) AS e FROM orders) "
    "SELECT o_orderkey, array_to_string(e, chr(10)) AS text, len(e)::BIGINT AS entries FROM e"
)


def html_text(page: tuple[str, str], _: str) -> str:
    """What the body of the planted page says; documents have no entity of their own, and no tag reaches over their ends."""
    inner = "regexp_replace(regexp_replace(text || '</p>', '(?s)<!--.*?-->', '', 'g'), '(?s)</?[A-Za-z!][^<>]*>', '', 'g')"
    return f"SELECT doc_id, {inner} || chr(10) || '<b> &amp; óéñ &nada;' AS plain FROM documents"


#: Addresses around a chunk's id.
ADDRESSES = (("http://localhost:8080/", ""), ("HTTPS://127.0.0.1/", "?a=b"), ("http://[::1]:9/", ""), ("http://localhost.example.com/", ""), ("ftp://localhost/", ""), ("file:///", ""))
ADDRESS = "CASE chunk_index % 8 " + " ".join(f"WHEN {i} THEN '{a}' || chunk_id || '{b}'" for i, (a, b) in enumerate(ADDRESSES)) + " ELSE url END"
READ_TEXT = f"SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.MD' END AS source_path, seg_idx, text, location, NULL::VARCHAR AS error FROM ({TEXT_BLOCKS_DESKTOP})"
_PY_BLANKS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_READ_BLOCKS = _blocks(f"regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^{_PY_BLANKS}+|{_PY_BLANKS}+$', '', 'g')", f"\\n{_PY_BLANKS}*\\n", _squeezed("raw", _PY), "línea ")
READ_WEB = (
    f"SELECT doc_id || ['.txt', '.html', '.xml', '.pages'][doc_id % 4 + 1] AS source_path, seg_idx, text, location, NULL::VARCHAR AS error FROM ({_READ_BLOCKS}) WHERE doc_id % 4 <> 3 "
    "UNION ALL SELECT doc_id || '.pages', NULL, NULL, NULL, 'unsupported file' FROM documents WHERE doc_id % 4 = 3 AND text IS NOT NULL"
)
READ_TABLES = (
    "SELECT s_nationkey || CASE WHEN s_nationkey % 2 = 0 THEN '.tsv' ELSE '.csv' END AS source_path, 's_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || s_name || ' \"x\"' || chr(10) || 'enlace: https://s.invalid/' || s_suppkey AS text, "
    "'fila ' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1) AS location, 'enlace=https://s.invalid/' || s_suppkey || ';s_name=' || s_name || ' \"x\";s_suppkey=' || s_suppkey AS metadata, 'https://s.invalid/' || s_suppkey AS url, NULL::VARCHAR AS error FROM supplier"
)
READ_JSON = (
    "SELECT event_type || '.jsonl' AS source_path, 'k: ' || json_extract_string(props, '$.k') AS text, 'fila ' || row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS location, 'k=' || json_extract_string(props, '$.k') AS metadata, NULL::VARCHAR AS url, NULL::VARCHAR AS error FROM events WHERE props IS NOT NULL "
    "UNION ALL SELECT 'regions.json', 'r_regionkey: ' || r_regionkey || chr(10) || 'r.name: ' || r_name || chr(10) || 'r.codes: 1; 2', 'fila ' || row_number() OVER (ORDER BY r_regionkey), 'r.codes=1; 2;r.name=' || r_name || ';r_regionkey=' || r_regionkey, NULL, NULL FROM region "
    "UNION ALL SELECT 'broken.ndjson', NULL, NULL, NULL, NULL, 'ValueError: line 2 is no JSON'"
)
_ACTIONS = (
    f"WITH l AS ({LISTING}), a AS (SELECT coalesce(l.source_path, m.source_path) AS source_path, l.source_path IS NULL AS gone, m.source_path IS NULL AS fresh, l.size IS NOT DISTINCT FROM m.size AND l.mtime_ns IS NOT DISTINCT FROM m.mtime_ns AS same, "
    "CASE WHEN l.size % 2 = 0 THEN m.sha256 ELSE sha256(l.source_path) END AS now, m.sha256 AS was FROM l FULL JOIN manifest m ON l.source_path = m.source_path), "
    "c AS (SELECT source_path, CASE WHEN gone THEN 'removed' WHEN fresh THEN 'new' WHEN same THEN 'unchanged' WHEN now = was THEN 'touched' ELSE 'changed' END AS action FROM a) "
)
SYNC_ACTIONS = _ACTIONS + "SELECT source_path, action FROM c"
SYNC_COUNTS = _ACTIONS + (
    "SELECT (count(*) FILTER (action <> 'removed'))::BIGINT AS scanned, (count(*) FILTER (action IN ('new', 'changed')))::BIGINT AS processed, (count(*) FILTER (action IN ('unchanged', 'touched')))::BIGINT AS skipped, (count(*) FILTER (action = 'removed'))::BIGINT AS removed, "
    "(sum(length(source_path) % 4 + 1) FILTER (action IN ('new', 'changed') AND length(source_path) % 3 <> 0))::BIGINT AS chunks_added, (count(*) FILTER (action IN ('new', 'changed') AND length(source_path) % 3 <> 0))::BIGINT AS with_text, "
    "(count(*) FILTER (action IN ('new', 'changed') AND length(source_path) % 3 = 0))::BIGINT AS errors FROM c"
)
BASE_ROUND_TRIP = (
    f"SELECT 'two' AS base_id, substring(sha256('two' || chr(1) || chunk_id), 1, 24) AS chunk_id, source_id, source_name, source_type, location, text, url, true AS bare FROM {CHUNKS} c WHERE base_id = (SELECT min(base_id) FROM source_chunks) AND location IS NOT NULL AND text IS NOT NULL AND source_name IS NOT NULL AND source_type IS NOT NULL"
)
