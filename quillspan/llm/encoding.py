"""Encoding a whole corpus with a public byte-level BPE vocabulary.

The corpus' frequent words are counted, encoded once on the driver and
compiled into a minimal acyclic transducer (``lexicon``) that the workers map
into memory. Words that it lacks are merged exactly by rank.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.lexicon import Lexicon, compile_lexicon
from quillspan.plans.lineage import written

FREQUENT_WORDS = 32_768
LONGEST_WORD = 48
REMEMBERED = 100_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the adjacent pair of lowest rank is merged, the left one first, until none is known.

    Pairs wait in a heap, so a word of n bytes takes n log n steps.
    """
    if not word:
        return []
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\x01" * n)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or middle >= n or end[middle] != stop:
            continue
        end[i] = stop
        alive[middle] = 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop, end[stop]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(word[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def frequent_words(texts: DataFrame, column: str, pattern: str, most: int = FREQUENT_WORDS) -> list[str]:
    """The corpus' most frequent words, at most ``most`` of them.

    Every text is counted; counts are combined in the workers before the
    shuffle, and only the winners reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        find = regex.compile(pattern).findall
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.iloc[:, 0]:
                if text:
                    seen.update(find(text))
            if len(seen) > 200_000:
                yield pd.DataFrame(seen.items(), columns=["word", "n"])
                seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["word", "n"])

    counted = texts.select(column).mapInPandas(count, "word string, n bigint").filter(F.length("word") <= LONGEST_WORD)
    totals = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    return [r.word for r in totals.orderBy(F.desc("n"), "word").limit(most).collect()]


def publish_lexicon(spark: SparkSession, words: list[str], ranks: dict[bytes, int]):
    """A function that gives a worker the lexicon of ``words``.

    The tables, bounded by FREQUENT_WORDS words of LONGEST_WORD characters, are
    one file in the shared folder. Spark hands it to every executor, one that
    starts later too, and the workers of a machine map the same copy.
    """
    entries = sorted({w.encode() for w in words})
    tables = compile_lexicon([(w, merge(w, ranks)) for w in entries])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(written(spark, name, tables))
    return lambda: Lexicon.map_file(SparkFiles.get(name))


def encode_corpus(
    texts: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str | None = None, pattern: str | None = None, most: int = FREQUENT_WORDS
) -> DataFrame:
    """(key, ids): the token ids of every row, without special tokens.

    A null and an empty text both give an empty list. Strings that look like
    special tokens are ordinary text. Rows aren't deduplicated or reordered, and
    further columns are ignored; an empty table gives an empty table.
    """
    spark = texts.sparkSession
    ranks = read_ranks(vocabulary or vocabulary_path())
    pattern = pattern or split_pattern()
    lexicon_of = publish_lexicon(spark, frequent_words(texts, column, pattern, most), ranks)
    sent = spark.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        find = regex.compile(pattern).findall
        lexicon, known = lexicon_of(), sent.value
        remembered: dict[str, list[int]] = {}

        def ids(text: str | None) -> list[int]:
            out: list[int] = []
            if not text:
                return out
            for word in find(text):
                got = remembered.get(word)
                if got is None:
                    raw = word.encode()
                    got = lexicon.ids(raw)
                    if got is None:
                        got = merge(raw, known)
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    remembered[word] = got
                out.extend(got)
            return out

        for batch in batches:
            yield batch.map(ids, na_action=None)

    return texts.select(F.col(key), F.pandas_udf(encode, "array<int>")(F.col(column)).alias("ids"))
