"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

A word's bytes are an array of hexadecimal strings; a merge joins two of them, and a pair's rank is
that of the joined bytes, looked up in a literal map which is cut into small ones so that a look-up
is short. The most common words are folded once, on the cluster, and workers hold their ids. The words
beyond that bound, a few in a hundred tokens, are merged where they stand, pair by pair or, if long, by
a heap: folding each of them in Spark takes more CPU seconds than allowed (see README). Nothing is
shuffled but the counts of distinct words.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bytepairs import merge
from .common import Tables, map_lists
from .quality import let
from .tokencount import PATTERN, Spaced

#: Words that workers hold, distinct words that a task adds up, bytes of a word that is folded in Spark, small maps.
HELD, ADDED, FOLDED, MAPS = 1 << 18, 400_000, 64, 8192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Ranks:
    """The rank map as a literal: MAPS small maps, chosen by the key's CRC-32."""

    def __init__(self, ranks: dict[bytes, int]):
        parts: list[dict[str, int]] = [{} for _ in range(MAPS)]
        for token, rank in ranks.items():
            key = token.hex().upper()
            parts[zlib.crc32(key.encode()) % MAPS][key] = rank
        self.literal = F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")

    @staticmethod
    def of(maps: Column, key: Column) -> Column:
        return F.element_at(F.get(maps, (F.crc32(key.cast("binary")) % MAPS).cast("int")), key)


def fold(maps: Column, word: Column) -> Column:
    """Ids of a word: merges of the lowest-ranked pair, leftmost first, until no pair has a rank.

    The state is the parts and the ranks of neighbours. A step joins one pair and looks up two ranks.
    """
    none, at_most = F.array().cast("array<int>"), 1 << 12

    def split(digits: Column) -> Column:
        size = (F.length(digits) / 2).cast("int")
        return F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(digits, i * 2 - 1, F.lit(2)))

    def start(parts: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: Ranks.of(maps, F.concat(F.get(parts, i), F.get(parts, i + 1))))
        return F.struct(parts.alias("parts"), F.when(F.size(parts) > 1, ranks).otherwise(none).alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        parts, ranks = state.parts, state.ranks

        def join(i: Column) -> Column:
            """The state with the parts at i and i + 1, from 0, joined."""
            n = F.size(parts)

            def put(new: Column) -> Column:
                left = F.when(i > 0, F.concat(F.slice(ranks, 1, i - 1), F.array(Ranks.of(maps, F.concat(F.get(parts, i - 1), new))))).otherwise(none)
                right = F.when(i + 2 < n, F.concat(F.array(Ranks.of(maps, F.concat(new, F.get(parts, i + 2)))), F.slice(ranks, i + 3, n - i - 3))).otherwise(none)
                own = F.concat(F.slice(parts, 1, i), F.array(new), F.slice(parts, i + 3, n - i - 2))
                return F.struct(own.alias("parts"), F.concat(left, right).alias("ranks"))

            return let(F.concat(F.get(parts, i), F.get(parts, i + 1)), put)

        first = F.array_min(F.transform(ranks, lambda r, i: r.cast("long") * at_most + i))
        return let(first, lambda x: F.when(x.isNull(), state).otherwise(let((x % at_most).cast("int"), join)))

    def run(parts: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(parts)), start(parts), step, lambda s: F.transform(s.parts, lambda p: Ranks.of(maps, p)))

    return let(F.hex(F.encode(word, "utf-8")), lambda digits: let(split(digits), run))


def encode_words(pretokens: Column, ranks: Ranks) -> Column:
    """Ids of the pretokens in an array, one after another."""
    return let(ranks.literal, lambda maps: F.flatten(F.transform(pretokens, lambda p: fold(maps, p))))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the stretches of docs' texts that Spark may fold, of up to FOLDED bytes, added up in tasks first.

    They choose the words that are folded beforehand, and nothing else hangs on them: a task whose words
    outgrow ADDED forgets those that it has met once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        least = 1

        def passed_on() -> pa.RecordBatch:
            kept = {w: n for w, n in seen.items() if n >= least and len(w) <= FOLDED}
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                seen.update(Spaced.split(text.as_py() or ""))
                if len(seen) > ADDED:
                    least = 2
                    seen = Counter({w: n for w, n in seen.items() if n > 1})
                    if len(seen) > ADDED // 2:
                        yield passed_on()
                        seen = Counter()
        yield passed_on()

    return docs.select("text").mapInArrow(run, "word string, n long").where(F.octet_length("word") <= FOLDED).groupBy("word").agg(F.sum("n").alias("n"))


class Codec:
    """What a worker holds: the ids of common words as decimal text, and the bytes that such a run of ids stands for."""

    def __init__(self, ranks: dict[bytes, int], words: list[str], ids: list[list[int]]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.text = [str(i) for i in range(len(self.pieces))]
        self.bytes = [bytes([i]) for i in range(256)]
        self.known: dict[str, str] = {}
        self.runs: dict[str, bytes] = {}
        for w, own in zip(words, ids):
            run = self.known[w] = ",".join(map(self.text.__getitem__, own))
            self.runs[run] = self.decode(run)

    def merged(self, word: str) -> str:
        """Ids of a word that isn't held: the lowest-ranked pair is joined, leftmost first, until none has a rank."""
        ranks, out = self.ranks, []
        for p in [word] if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) else Spaced.pattern.findall(word):
            raw = p.encode()
            if raw in ranks:
                out.append(raw)
            elif len(raw) > FOLDED:
                out += merge([self.bytes[x] for x in raw], lambda a, b: (r, a + b) if (r := ranks.get(a + b)) is not None else None)
            else:
                out += self.join(raw)
        return ",".join([self.text[ranks[x]] for x in out])

    def join(self, raw: bytes) -> list[bytes]:
        """The parts of a short pretoken, held by where they start."""
        none, get = len(self.pieces), self.ranks.get
        starts = list(range(len(raw) + 1))
        near = [get(raw[i : i + 2], none) for i in starts[:-2]]
        while near and (low := min(near)) != none:
            i = near.index(low)
            del near[i], starts[i + 1]
            if i < len(near):
                near[i] = get(raw[starts[i] : starts[i + 2]], none)
            if i:
                near[i - 1] = get(raw[starts[i - 1] : starts[i + 1]], none)
        return [raw[a:b] for a, b in zip(starts, starts[1:])]

    def encode(self, text: str) -> list[str]:
        """A run of ids for each stretch of the text."""
        words = Spaced.split(text) if text else []
        runs = list(map(self.known.get, words))
        return [self.merged(w) if r is None else r for w, r in zip(words, runs)] if None in runs else runs

    def decode(self, run: str) -> bytes:
        return b"".join([self.pieces[int(i)] for i in run.split(",")]) if run else b""

    def decode_runs(self, runs: list[str]) -> bytes:
        found = list(map(self.runs.get, runs))
        return b"".join([self.decode(r) if b is None else b for r, b in zip(runs, found)] if None in found else found)


def bpe(spark: SparkSession, df: DataFrame, ranks_path: str, held: int = HELD, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) a row of df, as the vocabulary's library encodes it.

    Special strings are ordinary text. Null and empty texts have no ids. Repeated rows and null ids
    each give their row. decoded comes from the ids alone.
    """
    tables = Tables(spark)
    table = load_ranks(ranks_path)
    ranks = Ranks(table)
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = tables.save(word_counts(docs), "words")
    bounds = sorted({round(2 ** (i / 4)) for i in range(200)})
    over = counts.agg(*(F.count(F.when(F.col("n") >= b, 1)) for b in bounds)).first()
    bound = next(b for b, n in zip(bounds, over) if n <= held)
    common = counts.where(F.col("n") >= bound).select("word").repartition(4 * spark.sparkContext.defaultParallelism)
    split = map_lists(common, lambda words: (words, [Spaced.pattern.findall(w) for w in words]), "word string, pretokens array<string>", rows=4096)
    words = split.select("word", encode_words(F.col("pretokens"), ranks).alias("ids")).toArrow()
    tables.drop(counts)
    sent = spark.sparkContext.broadcast(Codec(table, words["word"].to_pylist(), words["ids"].to_pylist()))
    kind = docs.dtypes[0][1]

    def finish(keys: list, texts: list) -> tuple:
        codec, out = sent.value, [[] for _ in range(6)]
        for key, t in zip(keys, texts):
            runs = codec.encode(t)
            ids, back = ",".join(runs), codec.decode_runs(runs)
            row = key, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), [int(i) for i in ids.split(",")] if with_ids and ids else [], back
            for col, v in zip(out, row):
                col.append(v)
        return tuple(out[: 6 if with_ids else 4])

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return map_lists(docs, finish, schema)
