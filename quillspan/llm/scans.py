"""Repair of text from scanned pages.

The lines of a page are labelled by a hidden Markov model with the states
running header, page number, heading and body; blank lines are breaks. It sees
layout only: place on the page, neighbouring breaks, shape of the line, whether
the scan repeats it on other pages, and whether its number runs with the pages.
Its tables are re-estimated on the whole corpus from the best paths (Viterbi
training). Words are then judged with the corpus' own word counts: a divided
word by the word that its halves make, a wrongly read word by a frequent word
from which usual confusions of characters lead to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.folding import without_marks
from quillspan.plans.lineage import stored

STATES = ("header", "number", "heading", "body")
ROUNDS = 2
SALTS = 8
#: Pages of a scan that are looked at in one piece.
_PAGES_TOGETHER = 64
#: Misread words are broadcast up to this number, else joined by a shuffle.
MOST_BROADCAST = 100_000

_ODD = re.compile(r"[a-zà-ÿ][0-9!€@|$£][a-zà-ÿ]|^[0-9!€@|$£][a-zà-ÿ]{2,}|[a-zà-ÿ]{2,}[0-9€@|$£]$")
_FORMULA = re.compile(r"^(?:[A-Z][a-z]?\d*)+$|^\d+[A-Za-z]{1,2}$|^[a-z]\d+$|^\d+(?:[.,:/-]\d+)*\w?$|^[A-Z]+\d+$")

_LABEL = r"(?:(?:p[aáà]g(?:in[ae])?s?\.?|p[aá]g\.|page|p\.|pg\.|fol\.|hoja|página)\s*)?"
_DIGIT_RUN = r"([\dlIOoSBZ|!]{1,4})"
_NUMBER = re.compile(
    rf"^(?:{_LABEL}{_DIGIT_RUN}|[-–—]\s*{_LABEL}{_DIGIT_RUN}\s*[-–—]|\[\s*{_LABEL}{_DIGIT_RUN}\s*\]|\(\s*{_LABEL}{_DIGIT_RUN}\s*\))$", re.IGNORECASE
)
_DIGITS = str.maketrans("lIOoSBZ|!", "110058211")
_ROMAN = re.compile(rf"^(?:{_LABEL}|[-–—\[(]\s*{_LABEL})((?=[ivxlc])c{{0,3}}(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}}))(?:\s*[-–—\])])?$", re.IGNORECASE)
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_HYPHEN = re.compile(r"([^\W\d_])([-­¬‐‑])[ \t\r]*$")
#: The same lines for Java, whose classes are those of ASCII.
_HYPHEN_JAVA = r"[\p{L}\p{Nl}\p{No}]([-­¬‐‑])[ \t\r]*\z"
_BLANKS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_EDGE_IN_WORD = re.compile(r"^[^\w!€@|$£]+|[^\w€@|$£]+$")
_LOWER_START = re.compile(r"^[a-zà-öø-ÿ]")


def fold(text: str) -> str:
    return without_marks(text.lower())


def line_key(line: str) -> str:
    """The letters of a line, by which a running header is known again."""
    return re.sub(r"[^a-z]+", " ", fold(line)).strip()


def page_numbers(line: str) -> tuple[int, ...]:
    """What the number may be of a line that holds only a page number: in Roman numerals, or in digits, misread ones included."""
    bare = line.strip()
    found = []
    roman = _ROMAN.match(bare) if len(bare) <= 24 else None
    if roman and (roman.group(1).islower() or roman.group(1).isupper()):
        values = [_ROMAN_VALUES[c] for c in roman.group(1).lower()]
        found.append(sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0])))
    match = _NUMBER.match(bare)
    if match:
        digits = next(g for g in match.groups() if g)
        if any(c.isdigit() for c in digits) or digits != bare or len(bare) <= 2:
            try:
                found.append(int(digits.translate(_DIGITS)))
            except ValueError:
                pass
    return tuple(dict.fromkeys(found))


def _may_run(line: str) -> bool:
    """Whether a line has the shape of a running header: short, no part of a sentence."""
    return len(line) <= 90 and not _LOWER_START.match(line) and not re.search(r"[.!?…:;,\-­¬‐][»”\"')\]]*$", line)


def _edge_lines(lines: list[str]) -> list[int]:
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*filled[:2], *filled[-2:]})


def _features(lines: list[str], number: int | None, headers: dict[str, int], shifts: set[int]) -> tuple[list[int], list[tuple[int, ...]]]:
    """The filled lines and of each the values of its layout features."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    n = len(filled)
    width = max((len(lines[i].strip()) for i in filled), default=1)
    out = []
    for k, i in enumerate(filled):
        line = lines[i].strip()
        place = 0 if k == 0 else 4 if k == n - 1 else 1 if k == 1 else 3 if k == n - 2 else 2
        shown = page_numbers(line)
        numeric = 0 if not shown else 2 if number is not None and any(x - number in shifts for x in shown) else 1
        repeated = 0
        if place != 2 and _may_run(line):
            repeated = headers.get(line_key(line), 0)
        letters = [c for c in line if c.isalpha()]
        if letters and sum(c.isupper() for c in letters) >= 0.75 * len(letters) and len(letters) > 3:
            shape = 0
        elif _LOWER_START.match(line):
            shape = 1
        elif re.match(r"^\d{1,2}[.)]\s+\S", line):
            shape = 2
        elif re.search(r"[.!?…:;,][»”\"')\]]*$", line) or _HYPHEN.search(lines[i]):
            shape = 3
        else:
            shape = 4
        length = 0 if len(line) < 0.45 * width else 1 if len(line) < 0.75 * width else 2
        above = i == 0 or not lines[i - 1].strip()
        below = i == len(lines) - 1 or not lines[i + 1].strip()
        out.append((place, numeric, repeated, shape, length, int(above) + 2 * int(below)))
    return filled, out


_SIZES = (5, 3, 3, 5, 3, 4)


def initial_tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start, transition and feature log-probabilities from which the training sets out."""
    start = np.full(4, 0.25)  # the place on the page says what stands first
    move = np.array([[0.05, 0.1, 0.1, 0.75], [0.1, 0.01, 0.1, 0.79], [0.02, 0.02, 0.06, 0.9], [0.02, 0.02, 0.02, 0.94]])
    tables = [
        np.array([[0.55, 0.05, 1e-9, 0.1, 0.3], [0.12, 0.03, 1e-9, 0.05, 0.8], [0.03, 0.1, 0.77, 0.08, 0.02], [0.03, 0.06, 0.82, 0.06, 0.03]]),
        np.array([[0.96, 0.02, 0.02], [0.01, 0.24, 0.75], [0.998, 0.001, 0.001], [0.9985, 0.001, 0.0005]]),
        np.array([[0.005, 0.05, 0.945], [0.9, 0.05, 0.05], [0.97, 0.02, 0.01], [0.97, 0.02, 0.01]]),
        np.array([[0.42, 0.02, 0.01, 0.05, 0.5], [0.05, 0.1, 0.05, 0.1, 0.7], [0.1, 0.001, 0.7, 0.02, 0.179], [0.002, 0.6, 0.003, 0.15, 0.245]]),
        np.array([[0.5, 0.4, 0.1], [0.95, 0.04, 0.01], [0.65, 0.3, 0.05], [0.1, 0.1, 0.8]]),
        np.array([[0.05, 0.45, 0.3, 0.2], [0.1, 0.3, 0.4, 0.2], [0.02, 0.04, 0.04, 0.9], [0.66, 0.16, 0.16, 0.02]]),
    ]
    return np.log(start), np.log(move), [np.log(t / t.sum(1, keepdims=True)) for t in tables]


#: Lines, counted with the padding to the longest page, that are decoded at once.
_AT_ONCE = 200_000


def best_paths(pages: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, list[np.ndarray]]) -> list[np.ndarray]:
    """The most probable states of the lines of each page (Viterbi), pages of like length side by side.

    A page is an array of lines x features.
    """
    order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
    at = 0
    while at < len(order):
        together = order[at : at + max(1, _AT_ONCE // max(1, len(pages[order[at]])))]
        for i, path in zip(together, _side_by_side([pages[i] for i in together], model)):
            out[i] = path
        at += len(together)
    return out


def _side_by_side(pages: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, list[np.ndarray]]) -> list[np.ndarray]:
    start, move, tables = model
    counts = np.array([len(p) for p in pages], np.int64)
    if not len(pages) or not counts.max():
        return [np.zeros(0, np.int64) for _ in pages]
    longest = int(counts.max())
    padded = np.zeros((len(pages), longest, len(tables)), np.int64)
    padded[np.arange(longest)[None, :] < counts[:, None]] = np.concatenate([p for p in pages if len(p)])
    emit = sum(t.T[padded[:, :, i]] for i, t in enumerate(tables))
    score = start + emit[:, 0]
    back = np.zeros((len(pages), longest, len(start)), np.int8)
    for k in range(1, longest):
        step = score[:, :, None] + move[None]
        back[:, k] = step.argmax(1)
        # a page that has ended keeps its score and its states
        live = (k < counts)[:, None]
        score = np.where(live, step.max(1) + emit[:, k], score)
        back[:, k] = np.where(live, back[:, k], np.arange(len(start), dtype=np.int8))
    path = np.zeros((len(pages), longest), np.int64)
    path[:, -1] = score.argmax(1)
    rows = np.arange(len(pages))
    for k in range(longest - 1, 0, -1):
        path[:, k - 1] = back[rows, k, path[:, k]]
    return [path[i, :n] for i, n in enumerate(counts)]


_EDGES = "array<struct<kind:string,key:string>>"


def _with_edges(pages: DataFrame) -> DataFrame:
    """Pages with what may run through their scan: ``h`` the keys of edge lines, ``n`` shifts of page numbers at the edges, ``m`` shifts amid the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number, text in zip(batch["page_number"], batch["text"]):
                lines = (text or "").split("\n")
                at_edge, found = set(_edge_lines(lines)), set()
                for i, x in enumerate(lines):
                    line = x.strip()
                    if pd.notna(number):
                        found.update(("n" if i in at_edge else "m", str(shown - int(number))) for shown in page_numbers(line))
                    if i in at_edge and _may_run(line):
                        key = line_key(line)
                        if len(key) >= 3:
                            found.add(("h", key))
                out.append([{"kind": kind, "key": key} for kind, key in sorted(found)])
            made = batch[["page_id", "scan_id", "page_number", "text"]].copy()
            made["page_number"] = made["page_number"].astype("Int32")
            made["edges"] = pd.Series(out, dtype=object, index=made.index)
            yield made

    return pages.mapInPandas(run, f"page_id bigint, scan_id string, page_number int, text string, edges {_EDGES}")


#: How alike an edge line must be to one that the scan repeats, to be taken for it or for a likely one.
_SAME, _LIKE = 0.8, 0.65


def _letters(keys: list[str]) -> np.ndarray:
    """How often each letter, and the blank, is in each key."""
    return np.array([[k.count(c) for c in " abcdefghijklmnopqrstuvwxyz"] for k in keys], np.int16).reshape(len(keys), 27)


def _likeness(key: str, letters: np.ndarray, headers: list[str], header_letters: np.ndarray) -> int:
    """2 if the key is that of one of the headers but for misread characters, 1 if it may be, else 0."""
    # no pair is more alike than the letters that both have; only the headers that can reach the limit are compared in full
    most = 2 * np.minimum(letters, header_letters).sum(1) / (letters.sum() + header_letters.sum(1))
    found = 0
    for i in np.argsort(-most, kind="stable"):
        if most[i] < (_SAME if found else _LIKE) - 1e-9:
            break
        # in this order, as the likeness isn't symmetric
        best = SequenceMatcher(None, key, headers[i], autojunk=False).ratio()
        if best >= _SAME:
            return 2
        found = max(found, int(best >= _LIKE))
    return found


def _with_scan_layout(pages: DataFrame) -> DataFrame:
    """Pages with what their scan repeats of them: ``headers`` are the keys of edge lines with their likeness, ``shifts`` those of its page numbers.

    Every line and shift that stands at the edges of two pages counts. Lines that
    stand there once are compared with all repeated ones of the scan, in blocks
    of _PAGES_TOGETHER pages with the repeated lines first seen in 16 such blocks.
    """
    edged = stored(_with_edges(pages), "edges")
    run = F.floor(F.coalesce("page_number", "page_id") / _PAGES_TOGETHER)
    seen = edged.filter("scan_id is not null").select("page_id", "scan_id", run.alias("run"), F.explode("edges").alias("e")).select("page_id", "scan_id", "run", F.when(F.col("e.kind") == "h", "h").otherwise("n").alias("kind"), "e.key", (F.col("e.kind") != "m").alias("edge"))
    counted = seen.filter("edge").groupBy("scan_id", "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("run"), F.min("page_id").alias("page_id"))
    counted = stored(counted, "edge_lines")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    def salted(df: DataFrame, by: str) -> DataFrame:
        return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))

    repeated = counted.filter("n >= 2")
    exact = salted(seen, "page_id").join(repeated.select("scan_id", "kind", "key", salts), ["scan_id", "kind", "key", "salt"]).select("page_id", "kind", "key", F.lit(2).alias("likeness"))
    ones = counted.filter("n = 1 and kind = 'h'").groupBy("scan_id", "run").agg(F.collect_list(F.struct("page_id", "key")).alias("ones"))
    headers = repeated.filter("kind = 'h'").groupBy("scan_id", F.floor(F.col("run") / 16)).agg(F.collect_list("key").alias("headers"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ones, headers in zip(batch["ones"], batch["headers"]):
                headers = list(headers)
                theirs, mine = _letters(headers), _letters([x["key"] for x in ones])
                for x, letters in zip(ones, mine):
                    likeness = _likeness(x["key"], letters, headers, theirs)
                    if likeness:
                        out.append((x["page_id"], "h", x["key"], likeness))
            yield pd.DataFrame(out, columns=["page_id", "kind", "key", "likeness"])

    blocks = salted(ones, "run").join(headers.select("scan_id", "headers", salts), ["scan_id", "salt"]).select("ones", "headers")
    alike = blocks.mapInPandas(compare, "page_id bigint, kind string, key string, likeness int")
    found = exact.unionByName(alike).groupBy("page_id").agg(
        F.collect_list(F.when(F.col("kind") == "h", F.struct("key", "likeness"))).alias("headers"),
        F.collect_set(F.when(F.col("kind") == "n", F.col("key").cast("int"))).alias("shifts"),
    )
    return edged.drop("edges").join(found, "page_id", "left")


_WIDTH = len(_SIZES)


def _unpacked(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).reshape(-1, _WIDTH) for x in column]


def _featured(pages: DataFrame) -> DataFrame:
    """Pages with the places and the features of their filled lines, which the training reads again and again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            filled, values = [], []
            for text, number, headers, shifts in zip(batch["text"], batch["page_number"], batch["headers"], batch["shifts"]):
                alike: dict[str, int] = {}
                for x in () if headers is None else headers:
                    alike[x["key"]] = max(x["likeness"], alike.get(x["key"], 0))
                where, found = _features((text or "").split("\n"), None if pd.isna(number) else int(number), alike, set() if shifts is None else set(shifts))
                filled.append(np.array(where, np.int32).tobytes())
                values.append(np.array(found, np.uint8).tobytes())
            out = batch[["page_id", "scan_id", "page_number", "text"]].copy()
            out["page_number"] = out["page_number"].astype("Int32")
            out["filled"], out["features"] = pd.Series(filled, dtype=object, index=out.index), pd.Series(values, dtype=object, index=out.index)
            yield out

    return pages.mapInPandas(run, "page_id bigint, scan_id string, page_number int, text string, filled binary, features binary")


def _retrained(pages: DataFrame, model):
    """The tables re-estimated from the best paths of all pages; only their counts leave the workers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = np.zeros((len(STATES), len(STATES)), np.int64)
        seen = [np.zeros((len(STATES), n), np.int64) for n in _SIZES]
        for batch in batches:
            features = _unpacked(batch["features"])
            for f, path in zip(features, best_paths(features, model)):
                np.add.at(steps, (path[:-1], path[1:]), 1)
                for i in range(_WIDTH):
                    np.add.at(seen[i], (path, f[:, i]), 1)
        out = [(what, int(a), int(b), int(t[a, b])) for what, t in ((-1, steps), *enumerate(seen)) for a, b in np.argwhere(t)]
        yield pd.DataFrame(out, columns=["what", "state", "value", "n"]).astype("int64")

    rows = pages.select("features").mapInPandas(count, "what bigint, state bigint, value bigint, n bigint")
    sums = rows.groupBy("what", "state", "value").agg(F.sum("n").alias("n")).collect()  # the cells of the tables
    first, steps, tables = initial_tables()
    # the given tables count as 200 observations of each state
    move, emit = 200 * np.exp(steps), [200 * np.exp(t) for t in tables]
    for r in sums:
        target = move[r.state] if r.what == -1 else emit[r.what][r.state]
        if r.what == 0 and r.value == 2 and r.state < 2:
            continue  # what stands amid a page is no running line
        if r.what == 2 and r.state == 0:
            continue  # that the scan repeats it is what makes a header, and isn't learnt away
        target[r.value] += r.n
    return first, np.log(move / move.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in emit]


_LINES = "page_id bigint, scan_id string, page_number int, lines array<struct<no:int,state:string,text:string>>"


def labelled_pages(pages: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, scan_id, page_number, lines): every page once, its lines with their label.

    Labels are header, number, heading, body and break (a blank line). A null
    text has no lines, an empty one a break. Pages without a scan are labelled
    from themselves alone.
    """
    once = pages.select("page_id", "scan_id", "page_number", "text").dropDuplicates(["page_id"])
    known = stored(_featured(_with_scan_layout(once)), "pages")
    model = initial_tables()
    for _ in range(rounds):
        model = _retrained(known, model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for text, filled, path in zip(batch["text"], batch["filled"], best_paths(_unpacked(batch["features"]), model)):
                state = dict(zip(np.frombuffer(filled, np.int32).tolist(), path.tolist()))
                found = [] if text is None else text.split("\n")
                lines.append([{"no": i + 1, "state": STATES[state[i]] if i in state else "break", "text": x} for i, x in enumerate(found)])
            out = batch[["page_id", "scan_id", "page_number"]].copy()
            out["page_number"] = out["page_number"].astype("Int32")
            out["lines"] = pd.Series(lines, dtype=object, index=out.index)
            yield out

    return stored(known.mapInPandas(label, _LINES), "labelled")


def word_of(token: str) -> str:
    """A token without the marks around it, in the case in which words are counted."""
    word = _EDGE_IN_WORD.sub("", token)
    if word[:1] == "!" and not _LOWER_START.match(word[1:2] or ""):
        word = word.lstrip("!")
    inner = word[1:]
    if any(c.isdigit() for c in word) and word == word.upper():
        return word
    if inner and any(c.isupper() for c in inner) and any(c.islower() for c in inner):
        return word
    return word.lower()


def with_next_line(labelled: DataFrame) -> DataFrame:
    """Pages that end in a divided word with the first body line of the next page of the scan that has one, however far on.

    Within runs of _PAGES_TOGETHER page numbers that is the next filled page, at
    a run's end the first one of the next run that has any. ``continued`` marks the pages whose first body line is such a next line.
    """
    body = F.filter("lines", lambda x: x["state"].isin("body", "heading"))
    first = F.get(body, F.lit(0))
    last = F.get(body, F.size(body) - 1)
    filled = labelled.filter((F.size(body) > 0) & F.col("scan_id").isNotNull() & F.col("page_number").isNotNull())
    begun = filled.select("scan_id", "page_number", F.struct(F.col("page_id").alias("next_page"), first["no"].alias("next_no"), first["text"].alias("next_text")).alias("begin"))
    # one page stands for those that have the same number
    begun = begun.groupBy("scan_id", "page_number").agg(F.min_by("begin", "begin.next_page").alias("begin")).withColumn("run", F.floor(F.col("page_number") / _PAGES_TOGETHER))
    heads = begun.groupBy("scan_id", "run").agg(F.min_by("begin", "page_number").alias("head"))
    heads = heads.select("scan_id", "run", F.lead("head").over(Window.partitionBy("scan_id").orderBy("run")).alias("ahead"))
    following = begun.withColumn("next", F.lead("begin").over(Window.partitionBy("scan_id", "run").orderBy("page_number"))).join(heads, ["scan_id", "run"])
    following = following.select("scan_id", "page_number", F.coalesce("next", "ahead").alias("next")).filter("next is not null")
    open_pages = filled.filter(last["text"].rlike(_HYPHEN_JAVA)).select("page_id", "scan_id", "page_number")
    following = open_pages.join(following, ["scan_id", "page_number"]).select("page_id", "next")
    continued = following.select(F.col("next.next_page").alias("page_id"), F.lit(True).alias("continued")).distinct()
    return labelled.join(following, "page_id", "left").join(continued, "page_id", "left")


#: The beginning of a line that may be the second half of a word, for Java.
_GOES_ON = rf"^{_BLANKS[:-1]}*+(?:[a-zà-öø-ÿ]|[!€@|$£0-9][a-zà-ÿ])"


def _body_lines(labelled: DataFrame) -> DataFrame:
    """The body lines of all pages with their tokens, without the halves of divided words; ``joined`` has these halves.

    (page_id, line_no, tokens, joined struct<page_b, line_b, a, b, mark>); the two
    halves are tokens of two lines that follow one another, on the page or
    over its end.
    """
    body = F.filter("lines", lambda x: x["state"].isin("body", "heading"))
    over = F.struct(F.col("next.next_page").alias("page_id"), F.col("next.next_no").alias("no"), F.col("next.next_text").alias("text"))

    def with_neighbours(x: F.Column, i: F.Column) -> F.Column:
        y = F.get("body", i + 1)
        after = F.when(y.isNotNull(), F.struct(F.col("page_id"), y["no"].alias("no"), y["text"].alias("text"))).when(F.col("next").isNotNull(), over)
        return F.struct(x["no"].alias("no"), x["text"].alias("text"), i.alias("place"), F.when(i > 0, F.get("body", i - 1)["text"]).alias("before"), after.alias("after"))

    x = labelled.withColumn("body", body).select("page_id", "continued", F.explode(F.transform("body", with_neighbours)).alias("line"))
    x = x.select("page_id", "continued", "line.*")

    def goes_on(text: F.Column) -> F.Column:
        return text.rlike(_GOES_ON)

    def divided(text: F.Column, following: F.Column) -> F.Column:
        return F.coalesce(text.rlike(_HYPHEN_JAVA) & goes_on(following), F.lit(False))

    text = F.col("text")
    # the rest of a word from the line or page before is no word of its own
    rest = F.when(F.col("place") > 0, divided(F.col("before"), text)).otherwise(F.coalesce(F.col("continued") & goes_on(text), F.lit(False)))
    x = x.select("page_id", F.col("no").alias("line_no"), "text", F.array_remove(F.split(F.regexp_replace(text, _BLANKS, " "), " "), "").alias("tokens"), rest.cast("int").alias("rest"), divided(text, F.col("after.text")).alias("divided"), "after")
    x = x.withColumn("divided", F.col("divided") & (F.size("tokens") > F.col("rest")))
    half = F.regexp_replace(F.regexp_replace(F.element_at("tokens", -1), "[-­¬‐‑]$", ""), r"(?U)^[^\w!€@|$£]+", "")
    other = F.regexp_replace(F.regexp_extract("after.text", rf"^{_BLANKS[:-1]}*(.*?)(?:{_BLANKS[:-1]}|\z)", 1), r"(?U)[^\w€@|$£]+$", "")
    mark = F.regexp_extract("text", _HYPHEN_JAVA, 1)
    joined = F.when(F.col("divided"), F.struct(F.col("after.page_id").alias("page_b"), F.col("after.no").alias("line_b"), half.alias("a"), other.alias("b"), mark.alias("mark")))
    whole = F.slice("tokens", F.col("rest") + 1, F.greatest(F.lit(0), F.size("tokens") - F.col("rest") - F.col("divided").cast("int")))
    return x.select("page_id", "line_no", whole.alias("tokens"), joined.alias("joined"))


_HALVES = "page_id bigint, line_no int, page_b bigint, line_b int, mark string, cut int, word string, compound string, half string, rest string"


def _halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words that two halves make, with and without the hyphen."""
    for batch in batches:
        pairs = list(zip(batch["a"], batch["b"]))
        out = batch[["page_id", "line_no", "page_b", "line_b", "mark"]].copy()
        out["cut"] = [len(a) for a, _ in pairs]
        out["word"], out["compound"] = [word_of(a + b) for a, b in pairs], [word_of(f"{a}-{b}") for a, b in pairs]
        out["half"], out["rest"] = [word_of(a) for a, _ in pairs], [word_of(b) for _, b in pairs]
        yield out


@F.pandas_udf(T.StringType())
def _word_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for tokens in batches:
        yield tokens.map(word_of)


#: A word of which misreadings are sought occurs so often, the right one of a misread word that has no odd sign so often, and by so much more often.
LEAST_KNOWN, LEAST_RIGHT, TIMES = 72, 6, 12
#: Pairs of words that show a confusion, and which share of those that its rate lets expect.
LEAST_PAIRS, SHARE_OF_EXPECTED = 4, 0.5
#: What is longer counts as no word of a language.
LONGEST_WORD = 64
_SIGN = re.compile(r"[0-9!€@|$£]")

Confusions = dict[str, list[tuple[str, bool]]]


def _holes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word with one or two characters taken out, at each place: the hash of what is left, and what was taken."""
    for batch in batches:
        out = []
        for word, n in zip(batch["word"], batch["n"]):
            size = len(word)
            for i in range(size):
                for j in (i + 1, i + 2):
                    if j <= size:
                        out.append((xxhash.xxh3_64_intdigest(f"{word[:i]}\0{word[j:]}") - 2**63, word[i:j], i == 0, word, n))
        yield pd.DataFrame(out, columns=["hole", "part", "first", "word", "n"])


def learnt_confusions(counts: DataFrame) -> Confusions:
    """What the scans of this corpus have misread: read characters, and for these the right ones and whether only at the beginning of words.

    A rare word that differs from a much more frequent one by one or two
    characters shows a possible confusion. Misreading strikes all words alike:
    given how often it happens, one can tell in how many frequent words it
    should have been seen by now. A difference between words of the language
    is found in far fewer and doesn't count, unless it puts a sign or a digit
    inside a word, which no language does. Only the accepted confusions, pairs of
    one or two characters, come to the driver.
    """
    letters = F.length(F.regexp_replace("word", r"\P{L}", ""))
    words = counts.filter((letters >= 2) & F.length("word").between(3, LONGEST_WORD))
    holes = stored(words.mapInPandas(_holes, "hole bigint, part string, first boolean, word string, n bigint"), "holes")
    known = holes.filter((F.col("n") >= LEAST_KNOWN) & ~F.col("word").rlike(_SIGN.pattern)).select("hole", F.col("part").alias("right"), F.col("first").alias("at_first"), F.col("word").alias("known"), F.col("n").alias("n_known"))
    x, y = F.col("part"), F.col("right")
    ends_alike = (F.substring(x, 1, 1) == F.substring(y, 1, 1)) | (F.substring(x, -1, 1) == F.substring(y, -1, 1))
    shortest = ~(ends_alike & ((F.length(x) > 1) | (F.length(y) > 1)) & (F.greatest(F.length(x), F.length(y)) > 1))
    met = holes.join(known, "hole").filter((x != y) & (F.col("n_known") >= TIMES * F.col("n")) & shortest)
    shown = met.groupBy("part", "right", "first").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("often"))
    level = F.floor(F.log2("n_known"))
    sites = known.groupBy("right", F.col("at_first").alias("first"), level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n_known").alias("mass"))
    rate = shown.join(sites.groupBy("right", "first").agg(F.sum("mass").alias("mass")), ["right", "first"]).withColumn("rate", F.col("often") / F.col("mass")).drop("mass")
    hoped = F.sum(F.col("words") * (1 - F.exp(-F.col("rate") * F.col("mass") / F.col("words"))))
    judged = rate.join(sites, ["right", "first"]).groupBy("part", "right", "first", "pairs").agg(hoped.alias("expected"))
    good = judged.filter(F.col("part").rlike(_SIGN.pattern) | ((F.col("pairs") >= LEAST_PAIRS) & (F.col("pairs") >= SHARE_OF_EXPECTED * F.col("expected"))))
    found: Confusions = {}
    for r in good.groupBy("part", "right").agg(F.bool_and("first").alias("first")).orderBy("part", "right").collect():
        found.setdefault(r["part"], []).append((r["right"], r["first"]))
    return found


def corrections(word: str, confusions: Confusions) -> list[tuple[str, int]]:
    """Words from which confusions lead to ``word``, with the place of the first one."""
    found: dict[str, int] = {}
    frontier = {word: 99}
    for _ in range(2):
        grown: dict[str, int] = {}
        for w, first in frontier.items():
            for at in range(len(w)):
                for part in (w[at : at + 1], w[at : at + 2]):
                    for right, only_first in confusions.get(part, ()):
                        v = w[:at] + right + w[at + len(part) :]
                        if (at == 0 or not only_first) and v.lower() != word.lower() and v not in found:
                            found[v] = grown[v] = min(first, at)
        # a second confusion only where the first one was plain to see
        frontier = {v: at for v, at in grown.items() if _SIGN.search(v)} if _SIGN.search(word) else {}
    return [(v.lower(), at) for v, at in found.items() if not re.search(r"[!€@|$£]|[a-zà-ÿ][0-9]|[0-9][a-zà-ÿ]", v)]


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, right, place) of the words that are wrongly read.

    A frequent word must lead to it by confusions that the corpus shows, and be
    so much more frequent that the other can't be a word of its own. Signs and
    digits inside small letters are no spelling at all, whatever the word.
    """
    sent = counts.sparkSession.sparkContext.broadcast(learnt_confusions(counts))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        confusions = sent.value
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"]):
                letters = sum(c.isalpha() for c in word)
                if letters < 1 or not 2 <= len(word) <= LONGEST_WORD:
                    continue
                odd = bool(_ODD.search(word)) and not _FORMULA.match(word) and letters >= 2
                if odd:
                    out.append((word, n, None, _SIGN.search(word).start(), True))
                out += [(word, n, v, at, odd) for v, at in corrections(word, confusions)]
            frame = pd.DataFrame(out, columns=["word", "n", "right", "place", "odd"])
            frame["odd"] = frame["odd"].astype(bool)
            yield frame

    tried = counts.mapInPandas(judge, "word string, n bigint, right string, place int, odd boolean")
    known = counts.select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    met = tried.filter("right is not null").join(known, "right")
    enough = F.when(F.col("odd"), F.col("n_right") >= 1).otherwise((F.col("n_right") >= LEAST_RIGHT) & (F.col("n_right") >= TIMES * F.col("n")) & (F.length("word") > 2))
    good = met.filter(enough).groupBy("word").agg(F.max_by(F.struct("right", "place"), F.struct("n_right", "right")).alias("b"))
    good = good.select("word", F.col("b.right").alias("right"), F.col("b.place").alias("place"))
    plain = tried.filter("right is null and odd").select("word", "place").join(good.select("word"), "word", "left_anti")
    return good.unionByName(plain.select("word", F.lit(None).cast("string").alias("right"), "place"))


def judged_words(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The divided words (page_id, line_no, word, ..., divided) and the misread ones (page_id, line_no, word, right)."""
    lines = stored(_body_lines(with_next_line(labelled)), "body_lines")
    plain = lines.select("page_id", "line_no", F.explode("tokens").alias("token"))
    # each spelling is looked at once, however often it occurs
    spelt = plain.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("word", _word_udf("token"))
    # stored before it is filtered: a filter would be moved to where the tokens aren't counted yet
    spelt = stored(spelt, "spelt").filter(F.length("word") > 1)
    counts = stored(spelt.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    split = lines.filter("joined is not null").select("page_id", "line_no", "joined.*").mapInPandas(_halves, _HALVES)

    def count_of(column: str) -> DataFrame:
        return counts.select(F.col("word").alias(column), F.col("n").alias(f"n_{column}"))

    tested = split
    for c in ("word", "compound", "half", "rest"):
        tested = tested.join(count_of(c), c, "left")
    n = {c: F.coalesce(f"n_{c}", F.lit(0)) for c in ("word", "compound", "half", "rest")}
    own_hyphen = F.when(n["compound"] + n["word"] > 0, n["compound"] > n["word"]).otherwise((F.col("mark").isin("-", "‐", "‑")) & (n["half"] >= 4) & (n["rest"] >= 4) & (F.length("half") > 3) & (F.length("rest") > 3))
    tested = stored(tested.withColumn("divided", ~own_hyphen), "divided")
    # what a divided word is when put together counts as a word too
    together = tested.select(F.when(F.col("divided"), F.col("word")).otherwise(F.col("compound")).alias("word"), "page_id", "line_no", F.when(F.col("divided"), F.col("cut")).otherwise(F.col("cut") + 1).alias("cut"), "page_b", "line_b")
    every = counts.unionByName(together.groupBy("word").agg(F.count(F.lit(1)).alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    wrong = stored(misread_words(every), "misread")
    tokens = stored(spelt.join(wrong, "word").select("token", "word", "right"), "misread_tokens")
    few = tokens.count() <= MOST_BROADCAST
    misread = plain.join(F.broadcast(tokens) if few else tokens, "token").select("page_id", "line_no", "word", "right")
    halves = together.join(F.broadcast(wrong) if few else wrong, "word")
    second = F.col("place") >= F.col("cut")
    of_half = halves.select(F.when(second, F.col("page_b")).otherwise(F.col("page_id")).alias("page_id"), F.when(second, F.col("line_b")).otherwise(F.col("line_no")).cast("int").alias("line_no"), "word", "right")
    return tested, misread.unionByName(of_half)


def page_noise(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, noise): every line with each noise that it has."""
    labelled = labelled_pages(pages)
    divided, misread = judged_words(labelled)
    line = labelled.select("page_id", F.explode("lines").alias("x")).select("page_id", F.col("x.no").alias("line_no"), F.col("x.state").alias("state"))
    edges = line.filter(F.col("state").isin("header", "number")).select("page_id", "line_no", F.when(F.col("state") == "number", "page_number").otherwise("header").alias("noise"))
    hyphens = divided.filter("divided").select("page_id", "line_no", F.lit("hyphen").alias("noise"))
    wrong = misread.select("page_id", "line_no", F.lit("misread").alias("noise")).distinct()
    return edges.unionByName(hyphens).unionByName(wrong)


_PARAGRAPHS = "scan_id string, page_id bigint, page_number int, place int, text string, begins boolean, ends boolean"


def _corrected(line: str, fixes: dict[str, str]) -> str:
    """A line with its misread words put right; the first letter keeps its case."""

    def swap(match: re.Match[str]) -> str:
        token = match.group()
        word = word_of(token)
        right = fixes.get(word)
        if right is None:
            return token
        core = _EDGE_IN_WORD.sub("", token)
        if word != core and word != core.lower():
            return token
        if core[:1].isupper() or core.isupper() and len(core) > 1:
            right = right.upper() if sum(c.isupper() for c in core) > 1 and not any(c.islower() for c in core) else right[:1].upper() + right[1:]
        return token.replace(core, right, 1)

    return re.sub(r"\S+", swap, line)


def _page_paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            fixes = {f["word"]: f["right"] for f in (row.fixes if row.fixes is not None else ())}
            joins = set(row.joins if row.joins is not None else ())
            parts: list[list] = []  # text, whether the next line follows without a blank
            new = True
            for line in row.lines:
                if line["state"] == "break":
                    new = True
                    continue
                if line["state"] not in ("body", "heading"):
                    continue
                text = " ".join(line["text"].split())
                if line["state"] == "heading" or re.match(r"[-*•]\s", text):
                    new = True
                divided = line["no"] in joins
                if divided:
                    text = re.sub(r"[-­¬‐‑]\s*$", "", text)
                elif re.search(r"[^\W\d_][-‐‑]$", text):
                    divided = True  # a compound broken at its own hyphen, which stays
                # a break after half a word is none
                if new and not (parts and parts[-1][1]):
                    parts.append([text, divided])
                else:
                    parts[-1] = [parts[-1][0] + ("" if parts[-1][1] else " ") + text, divided]
                new = line["state"] == "heading"
            for i, (text, divided) in enumerate(parts):
                text = _corrected(text, fixes)
                first = text.lstrip("«“\"'(¿¡")[:1]
                done = bool(re.search(r"[.!?…:][»”\"')\]]*$", text)) and not divided
                out.append((row.scan_id, row.page_id, row.page_number, i, text + ("\x02" if divided else ""), i > 0 or not first.islower(), done))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PARAGRAPHS.split(", ")])
        frame["page_number"] = frame["page_number"].astype("Int32")
        for c in ("begins", "ends"):
            frame[c] = frame[c].astype(bool)
        yield frame


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(scan_id, paragraph_no, page_id, text): the scans as continuous paragraphs, each with the page it begins on.

    Headers, footers and page numbers are gone, divided words whole, misread
    words put right where a corpus word is known; a paragraph goes on over the
    page end if its sentence does. Blank and null pages have none. A page
    without a scan or a page number stands alone: its paragraphs are numbered
    from 1, within the page. Order and numbers come from sums over runs of _PAGES_TOGETHER pages, and each run takes
    from the one before whether its sentence has ended: never a whole scan in
    one task.
    """
    labelled = labelled_pages(pages)
    divided, misread = judged_words(labelled)
    fixes = misread.filter("right is not null").groupBy("page_id").agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
    joins = divided.filter("divided").groupBy("page_id").agg(F.collect_set("line_no").alias("joins"))
    full = labelled.join(fixes, "page_id", "left").join(joins, "page_id", "left")
    parts = stored(full.select("page_id", "scan_id", "page_number", "lines", "fixes", "joins").mapInPandas(_page_paragraphs, _PARAGRAPHS), "paragraphs")
    # a page without a scan or a number is followed by none
    alone = F.col("scan_id").isNull() | F.col("page_number").isNull()
    parts = parts.withColumn("alone", F.when(alone, F.col("page_id"))).withColumn("run", F.when(alone, 0).otherwise(F.floor(F.col("page_number") / _PAGES_TOGETHER)))
    unit = ["scan_id", "alone"]
    within = Window.partitionBy(*unit, "run").orderBy("page_number", "page_id", "place")
    before = F.lag("ends").over(within)
    # whether a run's first row begins a paragraph is known from the run before; until then it counts as none
    begins = F.when(before.isNull(), False).otherwise((F.col("place") > 0) | before)
    marked = parts.withColumn("b", begins.cast("int")).withColumn("inner", F.sum("b").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    totals = marked.groupBy(*unit, "run").agg(F.sum("b").alias("n"), F.max_by("ends", F.struct("page_number", "page_id", "place")).alias("ends"))
    runs = Window.partitionBy(*unit).orderBy("run")
    totals = totals.withColumn("first", F.coalesce(F.lag("ends").over(runs), F.lit(True)).cast("int"))
    ahead = F.sum(F.col("n") + F.col("first")).over(runs.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = totals.select(F.col("scan_id").alias("s"), F.col("alone").alias("a"), F.col("run").alias("r"), ahead.alias("ahead"))
    same = F.col("scan_id").eqNullSafe(F.col("s")) & F.col("alone").eqNullSafe(F.col("a")) & (F.col("run") == F.col("r"))
    numbered = marked.join(offsets, same).withColumn("paragraph_no", (F.col("ahead") + F.col("inner")).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("page_number", "page_id", "place", "text")))
    made = numbered.groupBy(*unit, "paragraph_no").agg(pieces.alias("p"))
    text = F.replace(F.replace(F.array_join(F.transform("p", lambda x: x["text"]), " "), F.lit("\x02 "), F.lit("")), F.lit("\x02"), F.lit(""))
    return made.select("scan_id", "paragraph_no", F.get("p", F.lit(0))["page_id"].alias("page_id"), text.alias("text"))
