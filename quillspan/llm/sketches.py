"""SetSketch registers of word-shingle sets.

A register is the exponentially spaced, truncated logarithm of the least of
the set's hash values, which are exponentially distributed. Registers merge by
their maximum, equal sets have equal registers, and two registers agree about
as often as their sets overlap, so bands of registers find similar sets and the
numbers of larger, equal and smaller registers give a joint estimate.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

from quillspan.llm.folding import without_marks

REGISTERS = 200
BASE = 1.02
_MOST = 2**15 - 2

_WORD = re.compile(r"[a-z0-9]+")
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S29 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(29)


def words(text: str) -> list[str]:
    """Runs of ASCII letters and digits after lower-casing and dropping combining marks (NFKD)."""
    return _WORD.findall(without_marks(text.lower()))


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _MIX_A
    x = (x ^ (x >> _S27)) * _MIX_B
    return x ^ (x >> _S31)


def shingles(tokens: list[str], size: int) -> np.ndarray:
    """The distinct 64-bit hashes, sorted, of the runs of ``size`` consecutive words."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash, tokens), np.uint64, len(tokens))
    out = h[:n]
    for i in range(1, size):
        out = _mixed(out * _STEP + h[i : i + n])
    return np.unique(_mixed(out))


def _multipliers(registers: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS = _multipliers(REGISTERS)


def sketch(hashes: np.ndarray, registers: int = REGISTERS, base: float = BASE) -> np.ndarray:
    """The registers of a set of 64-bit hashes; of the empty set they are 0."""
    if not len(hashes):
        return np.zeros(registers, np.int16)
    factors = _FACTORS if registers == REGISTERS else _multipliers(registers)
    least = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        y = hashes[start : start + 2048, None] * factors[None, :]
        y ^= y >> _S29
        y *= _MIX_B
        np.minimum(least, y.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16))
    return np.clip(np.floor(1 - np.log(exponential) / np.log(base)), 0, _MOST).astype(np.int16)


def _p(x: np.ndarray, base: float) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)


def jaccard_estimate(larger: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, registers: int = REGISTERS, base: float = BASE, steps: int = 28) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sets.

    ``larger`` and ``smaller`` count the registers in which the first sketch is
    above and below the second; the sets' sizes are known. The log-likelihood is
    concave, so golden-section steps find its maximum.
    """
    u = size_a / (size_a + size_b)
    v = 1 - u
    equal = registers - larger - smaller
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        above, below = _p(u - v * j, base), _p(v - u * j, base)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = [np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0) for k, p in ((larger, above), (smaller, below), (equal, 1 - above - below))]
        return terms[0] + terms[1] + terms[2]

    golden = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        left, right = high - golden * (high - low), low + golden * (high - low)
        better = likelihood(left) >= likelihood(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2
