"""Text functions as Catalyst expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# most characters are printable ASCII, which the first half of a class refuses at once
_PY_BLANK = r"[[^!-~]&&[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_JS_BLANK = r"[[^!-~]&&[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
_PY_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: str | Column, blank: str = _PY_BLANK) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), blank + "+", " "))


def stripped(c: str | Column, blank: str = _PY_BLANK) -> Column:
    return F.regexp_replace(col(c), f"^{blank}+|{blank}+$", "")


def js_squeezed(c: str | Column) -> Column:
    return squeezed(c, _JS_BLANK)


def js_stripped(c: str | Column) -> Column:
    return stripped(c, _JS_BLANK)


@cache
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decompositions without combining marks: letter by letter, and those that give several."""
    source, target, several = [], [], []
    for code in range(0xA0, 0xFFFE):
        if 0xAC00 <= code <= 0xD7FF or 0xD800 <= code <= 0xF8FF:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c or unicodedata.combining(c):
            continue
        if len(plain) == 1:
            source.append(c)
            target.append(plain)
        elif any(x.isalnum() for x in plain) and (code < 0x250 or 0x2000 <= code < 0x2190 or 0xFB00 <= code <= 0xFB06):
            several.append((c, plain))
    return "".join(source), "".join(target), tuple(several)


@cache
def _several_class() -> str:
    """A regular expression for the signs that stand for several letters, in ranges, which match much faster than single signs."""
    codes = sorted(ord(sign) for sign, _ in _folding()[2])
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def folded(c: str | Column) -> Column:
    """Letters without marks (NFKD). Signs that stand for several letters or digits are spelt out in the Latin blocks."""
    source, target, several = _folding()
    # the one that is common in texts goes first, so that few have another
    x = F.replace(F.translate(col(c), source, target), F.lit("…"), F.lit("..."))
    spelt = x
    for sign, letters in several:
        spelt = F.replace(spelt, F.lit(sign), F.lit(letters))
    x = F.when(x.rlike(_several_class()), spelt).otherwise(x)
    return F.regexp_replace(x, r"\p{M}+", "")


def normalize_desktop(c: str | Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(folded(c), r"\P{Alnum}+", " ")))


def normalize_web(c: str | Column) -> Column:
    """Keeps letters and digits of all scripts; marks that stand alone vanish instead of parting words."""
    x = F.regexp_replace(col(c), "[\\^`¨¯´·¸ʰ-˿]", "")
    return F.trim(F.lower(F.regexp_replace(folded(x), r"[^\p{L}\p{N}]+", " ")))


def normalize_query(c: str | Column) -> Column:
    return stripped(F.translate(F.lower(col(c)), "áéíóúüñ", "aeiouun"))


def clean_text(c: str | Column) -> Column:
    """Lines with single blanks, without the empty ones."""
    return F.array_join(F.filter(F.transform(F.split(col(c), _PY_BREAK), lambda x: squeezed(x)), lambda x: x != ""), "\n")


def strip_rtf_desktop(c: str | Column) -> Column:
    x = F.regexp_replace(col(c), r"\\'[0-9a-fA-F]{2}", " ")
    x = F.regexp_replace(x, r"\\[a-zA-Z]+-?\d* ?", " ")
    for escaped, plain in ((r"\{", "{"), (r"\}", "}"), ("\\\\", "\\")):
        x = F.replace(x, F.lit(escaped), F.lit(plain))
    return F.regexp_replace(x, r"[{}]", " ")


def strip_rtf_web(c: str | Column) -> Column:
    x = F.regexp_replace(col(c), r"\\'[0-9a-fA-F]{2}", " ")
    x = F.regexp_replace(x, r"\\[a-zA-Z]+-?\d* ?", " ")
    return js_squeezed(F.regexp_replace(x, r"[{}]", " "))


@F.pandas_udf(T.StringType())
def _entities_decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def html_text(c: str | Column) -> Column:
    """The text of a page's body, as it stands between the tags."""
    body = F.when(F.rlike(col(c), F.lit(r"(?i)<body[^>]*>")), F.regexp_extract(col(c), r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)).otherwise(col(c))
    x = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"(?s)</?[A-Za-z!][^<>]*>", "")
    return _entities_decoded(x)


def normalize_ocr(c: str | Column) -> Column:
    x = F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
    x = F.regexp_replace(x, r"[^\S\n]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return js_stripped(x)


def page_needs_ocr(c: str | Column) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"[\p{L}\p{N}]")) < 40


def trim_snippet(c: str | Column, most: int = 1400) -> Column:
    x = stripped(c)
    cut = F.concat(F.regexp_replace(F.substring(x, 1, most - 1), _PY_BLANK + "+$", ""), F.lit("..."))
    return F.when(F.length(x) <= most, x).otherwise(cut)


def clean_unit(c: str | Column) -> Column:
    return F.regexp_replace(F.substring(squeezed(c), 1, 520), _PY_BLANK + "+$", "")


def dedupe_key(c: str | Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " ")), 1, 160)


def canonical_source_key(relative_path: str | Column, source_path: str | Column, file_name: str | Column) -> Column:
    """One key for a file and its copies."""
    raw = F.coalesce(*[F.nullif(col(c), F.lit("")) for c in (relative_path, source_path, file_name)])
    key = normalize_desktop(raw)
    key = F.regexp_replace(key, r"\b(?:copia de|copy of)\b", " ")
    key = F.regexp_replace(key, r"\b1\b(?=\s*(?:pdf|docx|txt)?$)", " ")
    key = F.trim(F.regexp_replace(key, r"\s+", " "))
    return F.when(key != "", key).otherwise(F.coalesce(col(file_name), F.lit("")))


def short_file_name(path: str | Column) -> Column:
    """What follows the last slash; the path itself if that is nothing."""
    last = F.element_at(F.split(col(path), "/"), -1)
    return F.when(last != "", last).otherwise(col(path))


def safe_relative(path: str | Column, root: str | Column) -> Column:
    p, r = col(path), F.regexp_replace(col(root), "/+$", "")
    return F.when(p == r, ".").when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2)).otherwise(F.element_at(F.split(p, "/"), -1))


def path_is_inside(path: str | Column, root: str | Column) -> Column:
    p, r = col(path), F.regexp_replace(col(root), "/+$", "")
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def escape_html(c: str | Column) -> Column:
    x = col(c)
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def safe_file_name(c: str | Column) -> Column:
    x = F.lower(F.regexp_replace(F.regexp_replace(folded(c), r"\P{Alnum}+", "-"), "^-+|-+$", ""))
    return F.when(x == "", "base").otherwise(x)


def embedding_text(name: str | Column, location: str | Column, text: str | Column, metadata: str | Column) -> Column:
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(col(metadata))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    parts = [F.nullif(col(x), F.lit("")) if not isinstance(x, Column) else F.nullif(x, F.lit("")) for x in (name, location, text, lines)]
    return F.substring(F.concat_ws("\n", *parts), 1, 2400)


def is_local_url(c: str | Column) -> Column:
    host = F.lower(F.regexp_replace(F.try_parse_url(col(c), F.lit("HOST")), r"^\[|\]$", ""))
    scheme = F.lower(F.try_parse_url(col(c), F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & host.isin("127.0.0.1", "::1", "localhost"), F.lit(False))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def citation_list(indexes: Column) -> Column:
    return F.array_join(F.transform(F.array_distinct(indexes), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")


def cited(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))


def chunk_uuid(path: str | Column, file_hash: str | Column, index: str | Column) -> Column:
    """The name-based (version 5, URL namespace) UUID of a chunk, in hexadecimal digits."""
    name = F.concat(col(path), F.lit("::"), col(file_hash), F.lit("::"), col(index).cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def highlighted(text: str | Column, terms: list[str]) -> Column:
    """HTML with the given words marked, longest first; letters with marks differ from those without."""
    import re

    x = escape_html(text)
    words = sorted({t for t in terms if len(t) >= 3}, key=lambda t: (-len(t), t))
    if not words:
        return x
    either = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(x, rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", "<mark>$1</mark>")
