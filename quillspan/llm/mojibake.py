"""Text that was decoded with the wrong encoding.

Adjacent characters are scored by their mutual information in the corpus.
Maximum-scoring segments of improbable pairs are the suspicious runs of a
word, and only inside those runs the inverses of wrong decodings are tried: a
run is damaged if undoing one of them makes it far more probable under the
corpus' own pairs. The corpus contains damaged text itself, so the pairs are
counted twice: over all texts, and then over those in which the first count
finds no damage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.plans.lineage import stored

#: What is broadcast has at most so many pairs of characters; more are refused, not cut. Rarer pairs than LEAST_COUNT count as unseen.
MOST_PAIRS, LEAST_COUNT = 2_000_000, 1
_BLANKS = np.array([32, 9, 13, 10])
#: By how much (natural logarithm) the restored run must be more probable.
GAIN_FIRST, GAIN = 2.0, 2.5

# Fixed values: (what the bytes were, what they were read as).
WRONG_READINGS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"),
    ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "cp1253"), ("utf-8", "cp1254"), ("utf-8", "koi8_r"),
    ("cp1252", "latin-1"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"),
    ("cp1252", "cp1253"), ("cp1252", "cp1250"), ("cp1252", "iso8859_7"), ("cp1252", "iso8859_5"), ("cp1252", "koi8_r"),
    ("cp1252", "cp866"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "mac_roman"), ("mac_roman", "cp850"),
    ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp866", "cp1251"),
)

#: Words are taken whole, however long they are; all that is done to one takes time in proportion to its length.
_TOKEN = re.compile(r"[^ \t\r\n]+")
#: Longer words aren't remembered.
_MOST_REMEMBERED = 256
_HIGH = re.compile(r"[^\x00-\x7f]")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each character; bytes without one stand for the control character."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@cache
def _single(true: str, wrong: str) -> dict[int, str]:
    table = {}
    for char, b in _bytes_of(wrong).items():
        try:
            right = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
        if right != char and not "\x80" <= right <= "\x9f":
            table[ord(char)] = right
    return table


def _undo_utf8(run: str, wrong: str) -> str | None:
    """Whatever sequences of the run are UTF-8 read as ``wrong``, restored; None if there are none."""
    known = _bytes_of(wrong)
    if sum(c in known for c in run) < 2:
        return None
    raw = bytes(known.get(c, 0x00) for c in run)
    out, at = [], 0
    for match in _SEQUENCE.finditer(raw):
        try:
            char = match.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out.append(run[at : match.start()])
        out.append(char)
        at = match.end()
    if not out:
        return None
    return "".join(out) + run[at:]


class PairModel:
    """Probabilities of adjacent characters from counts of pairs."""

    def __init__(self, pairs: dict[str, int]) -> None:
        self.pairs = pairs
        self.first: Counter[str] = Counter()
        self.second: Counter[str] = Counter()
        for p, c in pairs.items():
            self.first[p[0]] += c
            self.second[p[1]] += c
        self.total = max(1, sum(pairs.values()))
        self.kinds = max(1, len(self.second))

    def log_probability(self, x: str, y: str) -> float:
        """Of y after x; an unseen pair backs off to y's own frequency, at a cost."""
        n = self.first.get(x, 0)
        back = (self.second.get(y, 0) + 0.05) / (self.total + 0.05 * self.kinds)
        return log((self.pairs.get(x + y, 0) + 0.3 * back) / (n + 0.3))

    def information(self, x: str, y: str) -> float:
        """Pointwise mutual information, drawn towards what an improbable pair would have when there is little evidence."""
        c = self.pairs.get(x + y, 0)
        expected = self.first.get(x, 0) * self.second.get(y, 0) / self.total
        return log((c + 0.05) / (expected + 0.5))

    def text(self, s: str) -> float:
        return sum(self.log_probability(a, b) for a, b in zip(s, s[1:]))


def improbable_runs(token: str, model: PairModel) -> list[tuple[int, int]]:
    """All maximal segments (Ruzzo and Tompa) of the token whose pairs are improbable, as character ranges.

    A pair's score is its mutual information turned round; pairs of ASCII
    characters only end a run. Runs grow over adjoining characters beyond ASCII.
    """
    padded = f" {token} "
    scores = []
    for x, y in zip(padded, padded[1:]):
        if x < "\x80" and y < "\x80":
            scores.append(-4.0)
        else:
            scores.append(max(-4.0, min(6.0, -model.information(x, y))))
    segments: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last earlier one with a lower sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, high = i, before, total
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= low:
                j = segments[j][4]
            if j < 0 or segments[j][3] >= high:
                segments.append((start, i + 1, low, high, j))
                break
            start, low = segments[j][0], segments[j][2]
            del segments[j:]
    runs = []
    for start, end, *_ in segments:
        a, b = max(0, start - 1), min(len(token), end)  # pairs to characters of the token
        floor = runs[-1][1] if runs else 0
        if floor > b:
            continue  # inside the run before
        while a > floor and token[a - 1] >= "\x80":
            a -= 1
        while b < len(token) and token[b] >= "\x80":
            b += 1
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        elif a < b:
            runs.append((a, b))
    return runs


#: How much more frequent than a pair what it stood for must be for it to be left out of the first count: a character of two bytes, another pair.
OUTWEIGHED, OUTWEIGHED_PAIR = 0.5, 20


@cache
def _origins(x: str, y: str) -> tuple[str, ...]:
    """What a pair of characters may have been before a wrong decoding: a character of two bytes, or another pair."""
    found = []
    for true, wrong in WRONG_READINGS:
        known = _bytes_of(wrong)
        if true == "utf-8":
            if x in known and y in known and _SEQUENCE.fullmatch(raw := bytes((known[x], known[y]))):
                found.append(raw.decode("utf-8"))
        else:
            table = _single(true, wrong)
            pair = table.get(ord(x), x) + table.get(ord(y), y)
            # of a sign by itself nothing can be said, nor of a capital inside a word
            if pair != x + y and pair.isalpha() and not (pair[0].islower() and pair[1].isupper()) and not (x.isupper() and y.islower()):
                found.append(pair)
    return tuple(dict.fromkeys(found))


def _begins_sequence(x: str, y: str) -> bool:
    """Whether a pair is the beginning of a character of three or four bytes, read as one of the encodings."""
    return any(0xE0 <= _bytes_of(wrong).get(x, 0) <= 0xF4 and 0x80 <= _bytes_of(wrong).get(y, 0) <= 0xBF for true, wrong in WRONG_READINGS if true == "utf-8")


def undamaged_pairs(pairs: dict[str, int]) -> dict[str, int]:
    """The pairs without those that wrong decodings seem to have made.

    Damage repeats itself like a language does, so its pairs have high mutual
    information in a corpus that contains it. But what a damaged pair stood
    for is far more frequent than the pair itself. A character most of whose
    pairs with others beyond ASCII are left out goes with all its pairs.
    """
    characters: Counter[str] = Counter()
    for p, n in pairs.items():
        characters[p[1]] += n

    def made(p: str, n: int) -> bool:
        if _begins_sequence(p[0], p[1]):
            return True
        return any(characters.get(o, 0) >= OUTWEIGHED * n if len(o) == 1 else pairs.get(o, 0) >= OUTWEIGHED_PAIR * n for o in _origins(p[0], p[1]))

    bad = {p for p, n in pairs.items() if not p.isascii() and made(p, n)}
    lost: Counter[str] = Counter()
    seen: Counter[str] = Counter()
    for p, n in pairs.items():
        for c in set(p):
            if c >= "\x80":
                seen[c] += n
                lost[c] += n * (p in bad)
    gone = {c for c, n in lost.items() if 2 * n > seen[c]}
    return {p: n for p, n in pairs.items() if p not in bad and not gone & set(p)}


def _best_of_run(before: str, run: str, after: str, model: PairModel) -> tuple[float, str]:
    """The most probable undoing of UTF-8 sequences inside a run between two characters: gain and text."""
    old = model.text(before + run + after)
    best, found = 0.0, run
    for true, wrong in WRONG_READINGS:
        if true != "utf-8":
            continue
        new = _undo_utf8(run, wrong)
        if new is None or new == run:
            continue
        gain = model.text(before + new + after) - old + 1.0  # such sequences hardly arise by chance
        if gain > best:
            best, found = gain, new
    return best, found


def _best_of_runs(token: str, runs: list[tuple[int, int]], model: PairModel) -> tuple[float, str]:
    """The most probable undoing of a single-byte reading inside the runs: gain and text.

    One byte a character leaves no trace such as that of UTF-8, so every
    character of the token beyond ASCII must have been read in the same wrong
    way; those outside the runs stay as they are only if that reading keeps them.
    """
    high = {c for c in token if c >= "\x80"}
    outside = {c for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(token)]) for c in token[a:b] if c >= "\x80"}
    old = model.text(f" {token} ")
    best, found = 0.0, token
    for true, wrong in WRONG_READINGS:
        if true == "utf-8" or not high <= _bytes_of(wrong).keys():
            continue
        table = _single(true, wrong)
        if any(ord(c) in table for c in outside):
            continue
        out, at = [], 0
        for a, b in runs:
            out += [token[at:a], token[a:b].translate(table)]
            at = b
        new = "".join(out) + token[at:]
        if new == token:
            continue
        gain = model.text(f" {new} ") - old
        if gain > best:
            best, found = gain, new
    return best, found


def restore_token(token: str, model: PairModel, least_gain: float = GAIN) -> tuple[str, bool]:
    """The token with its damaged runs restored, and whether it has damage."""
    damaged = bool(_LOST.search(token))
    while _HIGH.search(token):
        out, at, changed = [], 0, False
        runs = improbable_runs(token, model)
        of_runs = _best_of_runs(token, runs, model) if runs else (0.0, token)
        for a, b in runs:
            before = token[a - 1] if a else " "
            after = token[b] if b < len(token) else " "
            gain, new = _best_of_run(before, token[a:b], after, model)
            if max(gain, of_runs[0]) < least_gain:
                continue
            changed = True
            if of_runs[0] > gain:
                out, at = [of_runs[1]], len(token)
                break
            out += [token[at:a], new]
            at = b
        if not changed:
            break
        # each layer that is undone makes the token more probable, so this comes to an end
        token, damaged = "".join(out) + token[at:], True
    return token, damaged


class Restorer:
    """Restores texts word by word and remembers the words."""

    def __init__(self, model: PairModel, least_gain: float = GAIN) -> None:
        self._model, self._gain = model, least_gain
        self._known: dict[str, tuple[str, bool]] = {}

    def token(self, token: str) -> tuple[str, bool]:
        got = self._known.get(token)
        if got is None:
            got = restore_token(token, self._model, self._gain)
            if len(token) > _MOST_REMEMBERED:
                return got
            if len(self._known) >= 200_000:
                self._known.clear()
            self._known[token] = got
        return got

    def damaged(self, text: str | None) -> bool:
        return bool(text) and bool(_HIGH.search(text)) and any(self.token(t)[1] for t in _TOKEN.findall(text) if not t.isascii())

    def restored(self, text: str | None) -> tuple[str | None, bool]:
        if not text or text.isascii():
            return text, False
        hit = False

        def swap(match: re.Match[str]) -> str:
            nonlocal hit
            t = match.group()
            if t.isascii():
                return t
            new, bad = self.token(t)
            hit = hit or bad
            return new

        new = _TOKEN.sub(swap, text)
        return new, hit


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of adjacent characters of texts, as two code points in one number, and how often each occurs. A run of blanks counts as one."""
    points = np.frombuffer(" ".join(texts).join("  ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[np.isin(points, _BLANKS)] = 32
    points = points[~((points == 32) & np.append(False, points[:-1] == 32))]
    return np.unique(points[:-1] << 21 | points[1:], return_counts=True)


def _pair_counts(texts: DataFrame) -> dict[str, int]:
    """All pairs of adjacent characters in the texts of the one column, with their numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs, n = _pairs([t for t in batch.iloc[:, 0] if t])
            yield pd.DataFrame({"pair": pairs, "n": n})

    counted = texts.mapInPandas(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    kept = counted.filter(F.col("n") >= LEAST_COUNT) if LEAST_COUNT > 1 else counted
    rows = kept.limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"the texts have more than {MOST_PAIRS} pairs of characters; raise LEAST_COUNT or MOST_PAIRS")
    return {chr(r.pair >> 21) + chr(r.pair & 0x1FFFFF): r.n for r in rows}


_RESTORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("damaged", T.BooleanType())])


def restored_texts(rows: DataFrame, key: str = "segment_id", text: str = "text") -> DataFrame:
    """(key, text, damaged): every row once, its text as it was before the wrong decoding.

    damaged says that the text has characters from a wrong decoding; what can't
    be recovered (replacement characters) stays as it is. Null, empty and ASCII
    texts stay. Rows sent twice are one.
    """
    spark = rows.sparkSession
    once = stored(rows.select(key, text).dropDuplicates([key]), "texts")
    first = spark.sparkContext.broadcast(undamaged_pairs(_pair_counts(once.select(text))))

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(PairModel(first.value), GAIN_FIRST)
        for texts in batches:
            yield texts.map(lambda t: not restorer.damaged(t)).astype(bool)

    sound = once.filter(F.pandas_udf(clean, T.BooleanType())(F.col(text)))
    second = spark.sparkContext.broadcast(_pair_counts(sound.select(text)))

    def restore(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(PairModel(second.value))
        for texts in batches:
            yield pd.DataFrame([restorer.restored(t) for t in texts], columns=["text", "damaged"])

    return once.select(key, F.pandas_udf(restore, _RESTORED)(F.col(text)).alias("r")).select(key, F.col("r.text").alias(text), F.col("r.damaged").alias("damaged"))


def damaged_rows(rows: DataFrame, key: str = "segment_id", text: str = "text") -> DataFrame:
    """(key): the rows whose text has characters from a wrong decoding."""
    return restored_texts(rows, key, text).filter("damaged").select(key)
