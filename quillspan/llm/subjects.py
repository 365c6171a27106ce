"""The subject areas of documents by a latent Dirichlet topic model.

Sentences are the model's documents, since a document may have several
subjects. The topics are fitted on all documents: workers hold the topics,
spread every sentence's words over them, and only the summed topic-word counts
come back. Labelled documents give the topics their prior; each topic is then
mapped to the subject that its top terms belong to, or to none. A document has
the subjects whose topics have a large enough proportion in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.boundaries import HEADING, boundaries
from quillspan.llm.folding import without_marks
from quillspan.plans.lineage import stored

#: The vocabulary's bound, the labelled documents that give the prior, the terms by which a topic is inspected, the subjects that are accepted, and the letters of a word.
MOST_WORDS, MOST_LABELLED, TOP_TERMS, MOST_SUBJECTS, LONGEST_WORD = 40_000, 20_000, 40, 1_000, 40
COMMON_TOPICS = 4
PASSES = 3
SHARE = 0.25
#: Expected words of a subject that a sentence about it has at least.
LEAST_WORDS = 1.5
_ALPHA_SUBJECT, _ALPHA_COMMON, _ROUNDS = 0.05, 0.6, 5

_WORD = re.compile(r"[^\W\d_]{3,}")
_LOOKALIKE = str.maketrans("асеорхуіјѕԁһВМНКТАСЕОРХУІαορνικτ", "aceopxyijsdhbmhktaceopxyiaopvikt")


def terms(text: str) -> list[str]:
    """Folded words of three letters or more; Cyrillic and Greek letters inside Latin words as what they look like."""
    if text.isascii():
        return _WORD.findall(text.lower())
    folded = without_marks(text.lower())
    out = _WORD.findall(folded)
    if not folded.isascii():
        out = [w.translate(_LOOKALIKE) if not w.isascii() and re.search("[a-z]", w) else w for w in out]
    return out


@lru_cache(maxsize=200_000)
def _term_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; headings are none."""
    if not text:
        return []
    units = boundaries(text)
    ends = [u.position for u in units[1:]] + [len(text)]
    found = [text[u.position : e] for u, e in zip(units, ends) if u.strength != HEADING]
    return found or [text[u.position : e] for u, e in zip(units, ends)]


def _parsed(documents: DataFrame) -> DataFrame:
    """(doc_id, sizes, terms): the terms of each document's sentences one after another, as hashes. The one pass over the texts."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                found = [[_term_hash(w) for w in terms(s) if len(w) <= LONGEST_WORD] for s in sentences(text)]
                out.append((key, np.array([len(x) for x in found], np.int32).tobytes(), np.array([h for x in found for h in x], np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "sizes", "terms"])

    return documents.select("doc_id", "text").mapInPandas(parse, "doc_id bigint, sizes binary, terms binary")


def _vocabulary(parsed: DataFrame) -> np.ndarray:
    """The hashes, sorted, of the terms in most documents, at most MOST_WORDS and each in two at least; every document counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [np.unique(np.frombuffer(x, np.int64)) for x in batch["terms"]]
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_counts=True)
            yield pd.DataFrame({"term": hashes, "n": n})

    counted = parsed.select("terms").mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.term for r in counted.filter("n > 1").orderBy(F.desc("n"), "term").limit(MOST_WORDS).collect()], np.int64))


def _encoded(parsed: DataFrame, words: np.ndarray) -> DataFrame:
    """(doc_id, sizes, ids): the known terms of each document's sentences one after another."""
    sent = parsed.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            out = []
            for key, sizes, found in zip(batch["doc_id"], batch["sizes"], batch["terms"]):
                sizes, found = np.frombuffer(sizes, np.int32), np.frombuffer(found, np.int64)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[at] == found
                sentence = np.repeat(np.arange(len(sizes)), sizes)
                out.append((key, np.bincount(sentence[hit], minlength=len(sizes)).astype(np.int32).tobytes(), at[hit].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "sizes", "ids"])

    return parsed.mapInPandas(encode, "doc_id bigint, sizes binary, ids binary")


class _Batch(NamedTuple):
    ids: np.ndarray
    starts: np.ndarray  # of the sentences with words
    filled: np.ndarray  # which sentences these are
    document: np.ndarray  # the row of each sentence
    rows: int


#: Words whose topic shares are held at once, but for a document that has more.
_AT_ONCE = 200_000


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches in slices of at most so many words."""
    for batch in batches:
        words = np.cumsum([len(x) // 4 for x in batch["ids"]])
        start = 0
        while start < len(batch):
            before = words[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(words, before + _AT_ONCE, side="right")))
            yield batch.iloc[start:end].reset_index(drop=True)
            start = end


def _unpacked(batch: pd.DataFrame) -> _Batch:
    sizes = np.frombuffer(b"".join(batch["sizes"]), np.int32)
    ids = np.frombuffer(b"".join(batch["ids"]), np.int32)
    document = np.repeat(np.arange(len(batch)), [len(x) // 4 for x in batch["sizes"]])
    filled = np.flatnonzero(sizes > 0)
    starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]]).astype(np.int64) if len(filled) else np.zeros(0, np.int64)
    return _Batch(ids, starts, filled, document, len(batch))


def _spread(b: _Batch, topics: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's topic shares, and each sentence's expected words by topic."""
    like = topics[b.ids]
    lengths = np.diff(np.append(b.starts, len(b.ids)))
    shares = like * alpha
    for _ in range(_ROUNDS):
        shares /= np.maximum(shares.sum(1, keepdims=True), 1e-30)
        per = np.add.reduceat(shares, b.starts, axis=0)
        # a word doesn't vote for itself
        shares = like * (np.repeat(per, lengths, axis=0) - shares + alpha)
    shares /= np.maximum(shares.sum(1, keepdims=True), 1e-30)
    return shares, np.add.reduceat(shares, b.starts, axis=0)


class TopicModel(NamedTuple):
    topics: np.ndarray  # words x topics, each topic sums to 1
    alpha: np.ndarray
    subject: list[str | None]  # of each topic


def clean_subject(column: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def _labelled_counts(encoded: DataFrame, labels: DataFrame, names: list[str], size: int) -> np.ndarray:
    """Words x subjects: in how many labelled documents of a subject a word occurs; of a bounded sample of labels."""
    tidy = labels.select("doc_id", clean_subject(F.col("subject")).alias("s")).filter(F.col("s").isin(names)).distinct()
    per = tidy.groupBy("doc_id").agg(F.collect_set("s").alias("s")).orderBy(F.xxhash64("doc_id")).limit(MOST_LABELLED)
    met = encoded.join(per, "doc_id")
    index = {s: i for i, s in enumerate(names)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, len(names)))
        for batch in batches:
            for ids, ss in zip(batch["ids"], batch["s"]):
                w = np.unique(np.frombuffer(ids, np.int32))
                for s in ss:
                    total[w, index[s]] += 1 / len(ss)
        used = np.flatnonzero(total.sum(1))
        yield pd.DataFrame({"word": used, "c": pd.Series([x.tolist() for x in total[used]], dtype=object)})

    rows = met.select("ids", "s").mapInPandas(count, "word int, c array<double>")
    sums = rows.groupBy("word").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(len(names))]).collect()
    out = np.zeros((size, len(names)))
    for r in sums:
        out[r["word"]] = r[1:]
    return out


def fit_topics(encoded: DataFrame, subjects: list[str], labels: DataFrame, words: int, passes: int = PASSES) -> TopicModel:
    """Topics fitted on all documents, one for each subject and some for what all subjects share."""
    names = [s.lower() for s in subjects]
    k, v = len(names) + COMMON_TOPICS, words
    found = _labelled_counts(encoded, labels, names, max(1, v))
    share = (found + 0.05) / (found + 0.05).sum(1, keepdims=True)
    # words that mostly occur with one subject are its prior, the rest is common to all
    own = np.where((share > 0.45) & (found.sum(1, keepdims=True) >= 2), found * share**2, 0)
    prior = np.full((max(1, v), k), 0.01)
    prior[:, : len(names)] += own
    shared = found.sum(1) * np.clip(1.2 - share.max(1), 0.02, 1) ** 2
    noise = np.random.default_rng(5).random((max(1, v), COMMON_TOPICS)) + 0.5
    prior[:, len(names) :] += shared[:, None] * noise
    alpha = np.array([_ALPHA_SUBJECT] * len(names) + [_ALPHA_COMMON] * COMMON_TOPICS)
    topics = prior / prior.sum(0)
    spark = encoded.sparkSession
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(topics.astype(np.float32))

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = sent.value  # noqa: B023
            total = np.zeros((v, k))
            for batch in _slices(batches):
                b = _unpacked(batch)
                if len(b.ids):
                    shares, _ = _spread(b, t, alpha.astype(np.float32))
                    for i in range(k):
                        total[:, i] += np.bincount(b.ids, shares[:, i], v)
            used = np.flatnonzero(total.sum(1))
            yield pd.DataFrame({"word": used, "c": pd.Series([x.tolist() for x in total[used]], dtype=object)})

        rows = encoded.select("sizes", "ids").mapInPandas(step, "word int, c array<double>")
        sums = rows.groupBy("word").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(k)]).collect()  # the topics: words x topics numbers
        counts = np.zeros((max(1, v), k))
        for r in sums:
            counts[r["word"]] = r[1:]
        # the prior weighs as much as a tenth of what the documents say
        weight = 0.1 * counts.sum() / max(1e-9, prior.sum())
        grown = counts + weight * prior
        topics = grown / grown.sum(0)
    return TopicModel(topics, alpha, inspected(topics, share, found, subjects))


def inspected(topics: np.ndarray, share: np.ndarray, found: np.ndarray, subjects: list[str]) -> list[str | None]:
    """The subject of each topic by its top terms: that of which most of their labelled occurrences are, if they agree."""
    out: list[str | None] = []
    lift = topics / np.maximum(topics.sum(1, keepdims=True), 1e-30)
    for i in range(topics.shape[1]):
        top = np.argsort(-topics[:, i] * lift[:, i] ** 2)[:TOP_TERMS]
        seen = found[top].sum(1) > 0
        vote = (share[top][seen] * topics[top][seen, i : i + 1]).sum(0)
        out.append(subjects[int(vote.argmax())] if seen.any() and vote.max() >= 0.5 * vote.sum() else None)
    return out


def _document_proportions(b: _Batch, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Documents x subjects: the proportions of the subjects' topics in each document.

    A topic's proportion in a document is the share of its sentences that it
    generated; a sentence with too few expected words of any subject was
    generated by the common topics.
    """
    topics, alpha, mapping = model
    out = np.zeros((b.rows, mapping.shape[1]))
    if not len(b.ids):
        return out
    _, per = _spread(b, topics, alpha)
    amount = per @ mapping
    best = amount.argmax(1)
    about = amount[np.arange(len(best)), best] >= LEAST_WORDS
    np.add.at(out, (b.document[b.filled[about]], best[about]), 1)
    return out / np.maximum(1, np.bincount(b.document, minlength=b.rows))[:, None]


def document_proportions(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, proportion): the subjects' topics in each document, without those that it has none of.

    Subjects are spelt as in ``subjects``; more than MOST_SUBJECTS are refused.
    Labels may be spelt unevenly, wrong or repeated. Without labels no topic can
    be named and there are no rows.
    """
    spark = documents.sparkSession
    names = [r.subject for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"there are more than {MOST_SUBJECTS} subjects")
    nothing = spark.createDataFrame([], "doc_id bigint, subject string, proportion double")
    if not names:
        return nothing
    parsed = stored(_parsed(documents), "terms")
    words = _vocabulary(parsed)
    if not len(words):
        return nothing
    encoded = stored(_encoded(parsed, words), "sentences")
    model = fit_topics(encoded, names, labels, len(words))
    used = sorted({s for s in model.subject if s is not None})
    if not used:
        return nothing
    column = {s: i for i, s in enumerate(used)}
    into = np.zeros((len(model.subject), len(used)), np.float32)
    for i, s in enumerate(model.subject):
        if s is not None:
            into[i, column[s]] = 1
    sent = spark.sparkContext.broadcast((model.topics.astype(np.float32), model.alpha.astype(np.float32), into))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            theta = _document_proportions(_unpacked(batch), sent.value)
            row, col = np.nonzero(theta)
            keys = batch["doc_id"].to_numpy()
            yield pd.DataFrame({"doc_id": pd.Series(keys[row], dtype="int64"), "subject": pd.Series([used[c] for c in col], dtype=object), "proportion": theta[row, col]})

    return encoded.mapInPandas(assign, "doc_id bigint, subject string, proportion double")


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): each document with each subject whose topics make up at least ``share`` of it.

    Documents without a text or on no subject give no row, and copies under
    other ids have subjects of their own.
    """
    return document_proportions(documents, subjects, labels).filter(F.col("proportion") >= share - 1e-9).select("doc_id", "subject")


def corpus_composition(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(subject, source, lang, n): the make-up of the corpus; documents on no subject count under a null one."""
    d = documents.select("doc_id", "source", "lang")
    return d.join(found, "doc_id", "left").groupBy("subject", "source", "lang").agg(F.count(F.lit(1)).alias("n"))
