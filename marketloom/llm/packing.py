"""Best-fit packing by a plan over the histogram of lengths.

Documents become pieces of at most `size` tokens. The plan is best-fit-decreasing over counts: it never
sees a document, and its length depends on `size` alone. Pieces take the planned slots by their rank
within their length. Ranks come from counts by task and length, so that no task gathers a length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bytepairs import byte_letters
from .common import Tables, map_lists

#: More than any count of pieces of one length.
RANKS = 1 << 44
#: Stands for the end of a word; no UTF-8 text holds it.
END_BYTE = b"\xff"
#: Stretches whose ids a worker remembers, the first ones met.
KNOWN = 300_000
_made: dict[str, "Words"] = {}


class Words:
    """Token ids of stretches between ASCII blanks, as little-endian unsigned 32-bit bytes.

    The vocabulary's pretokens never hold a blank and its normaliser works within stretches, so that
    a text's ids are those of its stretches in order. A-Z are lowered first, as the normaliser does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        raw = lambda t: b"".join(letter[c] for c in t.removesuffix(end)) + (END_BYTE if t.endswith(end) else b"")
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        names = [c + end for c in byte_letters()] + made + byte_letters()
        ranks = {raw(t): i for i, t in enumerate(names) if raw(t) != END_BYTE}
        ranks.setdefault(END_BYTE, len(names))
        self.ids = {r: vocab.get(names[r]) if r < len(names) else None for r in ranks.values()}
        self.merges = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.marks = {m: array("I", self.tokenizer.encode(m.decode(), add_special_tokens=False).ids).tobytes() for m in (b".", b",")}

    def split(self, text: str) -> list[bytes]:
        if any(s in text for s in self.special):  # a special string is a stretch of its own, and parts what is around it
            parts = self.specials.split(text)
            return [y for i, x in enumerate(parts) for y in ([x.encode()] if i % 2 else x.encode().lower().split())]
        return text.encode().lower().split()

    def letters(self, word: str) -> bytes | None:
        """Ids of a word of letters alone, a pretoken of its own; None for others, and for sigma, whose lower case Python picks by its place.

        The merges run on bytes, with END_BYTE, which no text holds, for the end of a word: it joins the
        last byte before any other merge, as the vocabulary's last symbols have the end in them.
        """
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).lower() if "\u03a3" not in word else ""
        if not word.isalpha():
            return None
        return array("I", [self.ids[r] for r in self.merges.encode_single_piece(word.encode() + END_BYTE)]).tobytes()

    def look_up(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of stretches: letters, and letters with a comma or stop after them, by merges; others by the library."""
        got: dict[bytes, bytes] = {}
        others = []
        for w in new:
            mark = self.marks.get(w[-1:], b"")
            own = self.letters((w[:-1] if mark else w).decode())
            if own is None:
                others.append(w)
            else:
                got[w] = own + mark
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            got.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)))
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        new = {w for p in parts for w in p if w not in self.known}
        if new:
            found = self.look_up(new)
            room = KNOWN - len(self.known)
            if len(found) <= room:
                self.known.update(found)
                return [b"".join(map(self.known.__getitem__, p)) for p in parts]
            for w in list(found)[: max(0, room)]:
                self.known[w] = found[w]
            known = self.known
            return [b"".join([known.get(w) or found.get(w, b"") for w in p]) for p in parts]
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


def pieces(df: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, ranks: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, local_rank][, ids]) a piece: ids of the whole text and then end_id, cut at each `size`-th.

    local_rank counts the earlier pieces of the task that have the same length.
    """
    end, step = np.array([end_id], "<u4").tobytes(), 4 * size

    def task() -> Callable[..., tuple]:
        seen: Counter = Counter()
        return lambda keys, texts: batch(seen, keys, texts)

    def batch(seen: Counter, keys: list, texts: list) -> tuple:
        if vocabulary not in _made:
            _made[vocabulary] = Words(vocabulary)
        out: list[list] = [[] for _ in range(5 + ranks + with_ids)]
        for key, ids in zip(keys, _made[vocabulary].encode([t or "" for t in texts])):
            ids += end
            for k in range(0, len(ids), step):
                part = ids[k : k + step]
                length = len(part) // 4
                row = (key, k // step, k // 4, length, zlib.crc32(part), *([seen[length]] * ranks), *([np.frombuffer(part, "<u4").tolist()] * with_ids))
                seen[length] += 1
                for col, v in zip(out, row):
                    col.append(v)
        return tuple(out)

    kind = df.select(F.col(id_col)).dtypes[0][1]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", local_rank long" * ranks + ", ids array<long>" * with_ids
    return map_lists(df.select(id_col, text), task, schema, rows=512, per_task=True)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, offset, pieces a sequence) for each length, longest first.

    Sequences with the same room left are alike and kept as ranges by that room. Each length fills
    the ranges with the least room it fits into, as many a sequence as fit, then opens new ones.
    """
    open_ranges: dict[int, list[tuple[int, int]]] = {}
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in open_ranges if r >= length), default=0)
            if room:
                first, count = open_ranges[room].pop()
                if not open_ranges[room]:
                    del open_ranges[room]
            else:
                room, first = size, sequences
                count = -(-left // (size // length))
                sequences += count
            each = room // length
            full = min(count, left // each)
            steps = [(first, full, each)] if full else []
            if full < count and left - full * each:
                steps.append((first + full, 1, left - full * each))
            used = 0
            for at, many, k in steps:
                slots.append((length, rank, rank + many * k, at, size - room, k))
                rank, left, used = rank + many * k, left - many * k, used + many
                if room - k * length:
                    open_ranges.setdefault(room - k * length, []).append((at, many))
            if used < count:
                open_ranges.setdefault(room, []).append((first + used, count - used))
    return slots


def pack(spark: SparkSession, df: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) a piece of df's texts (null: empty).

    An empty text is a piece of the end id alone; repeated rows are packed each. The pieces are saved
    with the task that made them, so that a task run again cannot change ranks. To the driver come at
    most `size` counts, and the plan goes back at a few rows a length.
    """
    tables = Tables(spark)
    made = tables.save(pieces(df, vocabulary, size, end_id, id_col, text, ranks=True).withColumn("task", F.spark_partition_id()), "pieces")
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(sorted(plan(histogram, size)), dtype=np.int64).reshape(-1, 6)
    lead = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(lead, F.lit(0)).alias("base"))
    ranked = made.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return place(ranked, slots)


def place(ranked: DataFrame, slots: np.ndarray) -> DataFrame:
    """Each piece's slot, by its length and rank; slots are sorted by length and first rank."""
    keys = slots[:, 0] * RANKS + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length * RANKS + rank, "right") - 1]
            nth, each = rank - slot[:, 1], slot[:, 5]
            cols = [*b.columns[:5], pa.array(slot[:, 3] + nth // each), pa.array(slot[:, 4] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.dtypes[0][1]
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
