"""Scores and predicates of both profiles. Arguments are columns with normalised text and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan import profiles as P
from quillspan.functions.text import clamp01, col, normalize_desktop


def any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def keyword_overlap(q_normal: Column, q_tokens: Column, t_normal: Column, t_tokens: Column) -> Column:
    """Share of the query's tokens in the text, and more if the whole query is in it."""
    wanted = F.size(F.array_distinct(q_tokens))
    share = F.size(F.array_intersect(q_tokens, t_tokens)) / F.nullif(wanted, F.lit(0))
    phrase = F.when((F.length(q_normal) >= 8) & F.contains(t_normal, q_normal), 0.22).otherwise(0.0)
    return F.when((F.size(q_tokens) > 0) & (F.size(t_tokens) > 0), clamp01(share + phrase)).otherwise(0.0)


def lexical_score(q_normal: Column, q_tokens: Column, t_normal: Column, t_tokens: Column) -> Column:
    """Coverage, density and the whole phrase."""
    q = F.array_distinct(q_tokens)
    n = F.nullif(F.size(q), F.lit(0))
    covered = F.size(F.array_intersect(q, t_tokens))
    often = F.aggregate(q, F.lit(0), lambda acc, w: acc + F.least(F.lit(3), F.size(F.filter(t_tokens, lambda t: t == w))))
    phrase = F.when((F.length(q_normal) >= 8) & F.contains(t_normal, q_normal), 0.25).otherwise(0.0)
    score = covered / n * 0.72 + often / (3 * n) * 0.28 + phrase
    return F.when((F.size(q_tokens) > 0) & (F.size(t_tokens) > 0), clamp01(score)).otherwise(0.0)


def usable(vector: str | Column) -> Column:
    """Not null or empty, all numbers finite, not all zero."""
    v = col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vector: str | Column) -> Column:
    """The vector in double precision and of length one; null if it isn't usable."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(usable(vector), F.transform(v, lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Of two vectors, clamped to 0..1; 0 if one is missing, unusable or of another length."""
    x, y = unit(a), unit(b)
    return F.when(x.isNotNull() & y.isNotNull() & (F.size(x) == F.size(y)), clamp01(dot(x, y))).otherwise(0.0)


def low_signal_penalty(document: str | Column, relative_path: str | Column) -> Column:
    text = normalize_desktop(F.concat_ws(" ", col(relative_path), F.substring(col(document), 1, 2200)))
    hits = sum((F.contains(text, F.lit(p)).cast("int") for p in P.LOW_SIGNAL_PHRASES), F.lit(0))
    numbered = F.regexp_count(F.substring(F.coalesce(col(document), F.lit("")), 1, 1600), F.lit(r"(?U)\b\d{2,4}\."))
    return F.when(hits >= 2, 0.14).when((hits >= 1) & (numbered >= 2), 0.10).otherwise(0.0)


def has_year(text: Column) -> Column:
    return F.coalesce(text.rlike(P.WEB_YEAR), F.lit(False))


def named_persons(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.WEB_PERSON))


def date_precision(text: Column) -> Column:
    return F.when(text.rlike("(?i)" + P.WEB_DATE_PRECISE), 2).when(has_year(text), 1).otherwise(0)


def date_bonus(text: Column) -> Column:
    """What a text with a date adds where a date is asked for."""
    return F.when(has_year(text), F.when(text.rlike("(?i)" + P.WEB_DATE), 0.18).otherwise(0.08)).otherwise(0.0)


def person_bonus(text: Column) -> Column:
    return F.when(text.rlike(P.WEB_PERSON), 0.08).otherwise(0.0)


def change_bonus(t_normal: Column) -> Column:
    return F.when(any_of(t_normal, P.WEB_CHANGES), 0.08).otherwise(0.0)


def evidence_intent_bonus(q_normal: Column, text: Column, t_normal: Column) -> Column:
    """Of the web profile: what the question asks for is there."""
    given = (("date", date_bonus(text)), ("person", person_bonus(text)), ("change", change_bonus(t_normal)))
    return sum((F.when(any_of(q_normal, P.WEB_ASKS[what]), bonus).otherwise(0.0) for what, bonus in given), F.lit(0.0))


def question_intent_bonus(q_normal: Column, text: Column, t_normal: Column) -> Column:
    """Of the desktop profile."""
    year = text.rlike(rf"(?U)\b{P.YEAR}\b")
    date = F.when(any_of(q_normal, P.DESKTOP_ASKS["date"]), F.when(text.rlike(P.DESKTOP_DATE), 0.48).when(year, 0.28).otherwise(0.0)).otherwise(0.0)
    person = F.when(any_of(q_normal, P.DESKTOP_ASKS["person"]) & text.rlike(P.DESKTOP_PERSON), 0.16).otherwise(0.0)
    change = F.when(any_of(q_normal, P.DESKTOP_ASKS["change"]) & any_of(t_normal, P.DESKTOP_CHANGES), 0.18).otherwise(0.0)
    return F.coalesce(date + person + change, F.lit(0.0))


def looks_fragmentary(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    first = F.substring(F.ltrim(text), 1, 1)
    opened = F.length(F.regexp_replace(text, r"[^(]", "")) > F.length(F.regexp_replace(text, r"[^)]", ""))
    return F.coalesce((words < 8) | first.rlike(r"^\p{Ll}") | first.isin("(", ")", ",", ";", ":") | opened, F.lit(True))


def too_similar(a_tokens: Column, b_tokens: Column) -> Column:
    x, y = F.array_distinct(a_tokens), F.array_distinct(b_tokens)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least >= 0.72).otherwise(False)
