"""Token counts: byte-pair merges are counted, no token is named.

A text's count is its symbols, one a byte, less the merges made in each of its pretokens. Worked out
for the stretches between blanks, which recur, and remembered up to a bound in each worker.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, functions as F

from .bytepairs import MEMO, JsonPairs
from .common import map_lists

#: Fixed value: the pattern that splits text before the merges, as in the vocabulary's library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Spaced:
    """Splits a text into stretches whose pretokens don't depend on what stands around them.

    If all blanks are single spaces or newlines between words, a space belongs to the word that
    follows and a newline is a pretoken of its own. Other texts are split by the pattern at once.
    """

    pattern = regex.compile(PATTERN)

    @classmethod
    def split(cls, text: str) -> list[str]:
        words = text.split()
        blanks = len(words) - 1
        if text.count(" ") + text.count("\n") != blanks or len(text) != blanks + sum(map(len, words)):
            return cls.pattern.findall(text)
        out = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            out += line.replace(" ", "\0 ").split("\0") if "\0" not in line else cls.pattern.findall(line)
        return out


class Counter:
    def __init__(self, path: str):
        self.pairs = JsonPairs(path)
        self.known: dict[str, int] = {}

    def of(self, stretch: str) -> int:
        got = self.known.get(stretch)
        if got is None:
            got = sum(self.pairs.count(p.encode()) for p in Spaced.pattern.findall(stretch))
            if len(self.known) < MEMO and len(stretch) < 64:
                self.known[stretch] = got
        return got

    def count(self, text: str) -> int:
        """Special strings are one token each; what stands between them is split on its own."""
        total, parts = 0, [text]
        for s in self.pairs.special:
            if s in text:
                total += text.count(s)
                parts = [y for x in parts for y in x.split(s)]
        for part in parts:
            if part:
                total += sum(map(self.of, Spaced.split(part)))
        return total


_made: dict[str, Counter] = {}


def token_counts(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) a row of df, by the byte-level BPE file at `vocabulary`.

    Null and empty texts have no tokens. One narrow pass: no shuffle, and memory bounded by the memo
    and a batch, however long the texts. Repeated rows and null ids each give their row.
    """

    def batch(ids: list, texts: list) -> tuple:
        if vocabulary not in _made:
            _made[vocabulary] = Counter(vocabulary)
        counter = _made[vocabulary]
        texts = [t or "" for t in texts]
        counts = [counter.count(t) for t in texts]
        return ids, [len(t.encode()) for t in texts], counts, [n > limit for n in counts]

    kind = df.select(F.col(id_col)).dtypes[0][1]
    return map_lists(df.select(id_col, text), batch, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
