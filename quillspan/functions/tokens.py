"""Stemming and tokens of both profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import normalize_desktop, normalize_web
from quillspan.profiles import DESKTOP_STOP_WORDS, WEB_ENDINGS, WEB_STOP_WORDS


def stem_desktop(token: Column) -> Column:
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when((n > 6) & token.endswith("ciones"), F.concat(cut(5), F.lit("cion")))
        .when((n > 5) & token.endswith("cion"), token)
        .when((n > 5) & token.endswith("es"), cut(2))
        .when((n > 4) & token.endswith("s"), cut(1))
        .otherwise(token)
    )


def stem_web(token: Column) -> Column:
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    out = None
    for ending in WEB_ENDINGS:
        fits = (n > len(ending) + 3) & token.endswith(ending)
        out = F.when(fits, cut(len(ending))) if out is None else out.when(fits, cut(len(ending)))
    return out.when((n > 6) & token.endswith("es"), cut(2)).when((n > 5) & token.endswith("s"), cut(1)).otherwise(token)


def _tokens(normal: Column, stop_words: tuple[str, ...], stem) -> Column:
    kept = F.filter(F.split(normal, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*stop_words))
    return F.transform(kept, stem)


def tokens_desktop(c: str | Column, normal: Column | None = None) -> Column:
    return _tokens(normalize_desktop(c) if normal is None else normal, DESKTOP_STOP_WORDS, stem_desktop)


def tokens_web(c: str | Column, normal: Column | None = None) -> Column:
    return _tokens(normalize_web(c) if normal is None else normal, WEB_STOP_WORDS, stem_web)
