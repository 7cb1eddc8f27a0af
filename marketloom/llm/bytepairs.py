"""Byte-pair merging with a heap and a linked list, for words the callers keep short or rare."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

#: Entries a worker remembers. The first words met stay; later ones are worked out again each batch.
MEMO = 400_000


def merge(symbols: list, rank: Callable[[object, object], tuple | None]) -> list:
    """The symbols left after merging the lowest-ranked adjacent pair, leftmost first, while there is one.

    rank gives a pair's (rank, merged symbol) or None. The heap holds (rank, place); an entry
    counts only if the pair now at its place still has that rank. Pops and pushes are at most three
    a symbol, so that a word of n symbols takes n log n steps.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1]))]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n:
            continue
        now = rank(symbols[i], symbols[j])
        if now is None or now[0] != r:
            continue
        symbols[i], symbols[j] = now[1], None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if x := rank(now[1], symbols[k]):
                heapq.heappush(heap, (x[0], i))
        if (h := before[i]) >= 0 and (x := rank(symbols[h], now[1])):
            heapq.heappush(heap, (x[0], h))
    return [s for s in symbols if s is not None]


def merges(symbols: list, rank: Callable[[object, object], tuple | None]) -> int:
    return len(symbols) - len(merge(symbols, rank))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class JsonPairs:
    """Pair ranks of a tokenizers file with a byte-level BPE model, over its ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, pairs = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
        self.pairs = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.bytes = [vocab[c] for c in byte_letters()]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def count(self, word: bytes) -> int:
        pairs = self.pairs
        return len(word) - merges([self.bytes[b] for b in word], lambda a, b: pairs.get((a, b)))
