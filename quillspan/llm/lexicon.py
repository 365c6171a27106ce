"""A minimal acyclic transducer from words to token ids.

Words (byte strings) are compiled into a minimal automaton that shares
prefixes and suffixes. Every edge carries the number of words that sort before
the words below it, so the sum along an accepting path is the word's rank, and
the rank points at its ids. The tables are flat and can be mapped into memory.
"""

from __future__ import annotations

import mmap
import struct
from array import array
from bisect import bisect_left
from collections.abc import Sequence

_MAGIC = b"QSLX0001"


class _Node:
    __slots__ = ("edges", "final", "number")

    def __init__(self) -> None:
        self.edges: dict[int, _Node] = {}
        self.final = False
        self.number = -1

    def signature(self) -> tuple:
        return (self.final, *((b, n.number) for b, n in self.edges.items()))


def compile_lexicon(entries: Sequence[tuple[bytes, Sequence[int]]]) -> bytes:
    """The flat tables of ``entries``, which must be sorted by word and unique."""
    register: dict[tuple, _Node] = {}
    order: list[_Node] = []
    root = _Node()
    path: list[tuple[_Node, int, _Node]] = []

    def freeze(depth: int) -> None:
        # a finished node is replaced by an equal one that is known already
        while len(path) > depth:
            parent, byte, node = path.pop()
            key = node.signature()
            same = register.get(key)
            if same is None:
                node.number = len(order)
                register[key] = node
                order.append(node)
            else:
                parent.edges[byte] = same

    before = b""
    for word, _ in entries:
        if word <= before and before:
            raise ValueError("words must be sorted and unique")
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        freeze(common)
        node = path[-1][2] if path else root
        for byte in word[common:]:
            child = _Node()
            node.edges[byte] = child
            path.append((node, byte, child))
            node = child
        node.final = True
        before = word
    freeze(0)
    root.number = len(order)
    order.append(root)

    words_below = [0] * len(order)
    first, labels, targets, skips, finals = array("i"), bytearray(), array("i"), array("i"), bytearray()
    for node in order:  # children come before their parents
        first.append(len(labels))
        finals.append(node.final)
        total = int(node.final)
        for byte in sorted(node.edges):
            child = node.edges[byte]
            labels.append(byte)
            targets.append(child.number)
            skips.append(total)
            total += words_below[child.number]
        words_below[node.number] = total
    first.append(len(labels))
    offsets, ids = array("i", [0]), array("i")
    for _, word_ids in entries:
        ids.extend(word_ids)
        offsets.append(len(ids))
    parts = [first.tobytes(), targets.tobytes(), skips.tobytes(), offsets.tobytes(), ids.tobytes(), bytes(finals), bytes(labels)]
    head = _MAGIC + struct.pack("<8q", len(order), *(len(p) for p in parts))
    return head + b"".join(parts)


class Lexicon:
    """Looks words up in compiled tables, which may be bytes or a mapped file."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a compiled lexicon")
        self._states, *sizes = struct.unpack("<8q", view[8:72])
        at, parts = 72, []
        for size in sizes:
            parts.append(view[at : at + size])
            at += size
        self._first, self._targets, self._skips, self._offsets, self._ids = (p.cast("i") for p in parts[:5])
        self._finals, self._labels = parts[5], parts[6]

    @classmethod
    def map_file(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __len__(self) -> int:
        return len(self._offsets) - 1

    def rank(self, word: bytes) -> int:
        """The word's place in sorted order; -1 if it isn't in the lexicon."""
        state, rank = self._states - 1, 0
        first, labels, targets, skips = self._first, self._labels, self._targets, self._skips
        for byte in word:
            lo, hi = first[state], first[state + 1]
            edge = bisect_left(labels, byte, lo, hi)
            if edge == hi or labels[edge] != byte:
                return -1
            rank += skips[edge]
            state = targets[edge]
        return rank if self._finals[state] else -1

    def ids(self, word: bytes) -> list[int] | None:
        rank = self.rank(word)
        if rank < 0:
            return None
        return self._ids[self._offsets[rank] : self._offsets[rank + 1]].tolist()
