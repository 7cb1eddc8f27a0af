"""Language identification by interpolated Kneser-Ney models over characters, one a language.

Spark counts the n-grams of all training texts and derives the lower orders' continuation counts from them.
What is kept of the models is bounded: each language keeps its most frequent n-grams, and what the others
would have had goes to the shorter context, so that probabilities still add up to one. The orders lie in
arrays sorted by hash that all languages share, with one row of log probabilities for each n-gram. A text takes the
language of the lowest cross-entropy a character. How far a lead can be trusted, and which entropy
is out of a language's range, is calibrated on training texts that the counts leave out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Tables

#: Characters of an n-gram, bits of a character, and what stands for everything but letters.
ORDER, BITS, SPACE = 4, 12, 32
#: n-grams that the models of all languages keep together: a bound on what is collected and broadcast.
ENTRIES = 1 << 19
#: Code points that are worked on at once, n-grams that a task holds before it passes them on.
CHUNK, HELD = 1 << 20, 1 << 21
#: Of each FOLDS documents by crc32 the one of HELD_OUT is not learnt from; of each CALIBRATED others one calibrates.
FOLDS, HELD_OUT, CALIBRATED = 4, 2, 16
#: The share of a language's texts whose entropy is held to be in its range, by how much a text may exceed theirs, and bins of the lead.
IN_RANGE, SLACK, BINS = 0.999, 1.1, 64
UNKNOWN = "und"
MASKS = [(1 << BITS * n) - 1 for n in range(ORDER + 1)]
#: An odd number, by which keys are multiplied: a hash without collisions.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def alphabet() -> np.ndarray:
    """The character of each code point: itself below U+0800, one of 2048 classes above it, SPACE for what is no letter."""
    point = np.arange(sys.maxunicode + 1, dtype=np.uint64)
    folded = np.where(point < 0x800, point, 0x800 | (point * np.uint64(2654435761) >> np.uint64(16) & np.uint64(0x7FF)))
    letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(letter, folded, SPACE).astype(np.uint16)


class Reader:
    """Texts as n-gram keys: lower case, runs of other characters than letters one SPACE, spaces before the text."""

    def __init__(self) -> None:
        self.alphabet = alphabet()

    def characters(self, text: str, before: np.ndarray) -> np.ndarray:
        """`before`, ORDER - 1 characters, and the text's."""
        own = np.concatenate([before, self.alphabet[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]])
        kept = own != SPACE
        kept[1:] |= kept[:-1]
        kept[: len(before)] = True
        return own[kept]

    def keys(self, text: str) -> Iterator[np.ndarray]:
        """Of each character the key of the ORDER characters that end in it, the last one in its lowest bits; a part for each CHUNK code points."""
        before = np.full(ORDER - 1, SPACE, dtype=np.uint16)
        for at in range(0, len(text), CHUNK):
            own = self.characters(text[at : at + CHUNK], before).astype(np.uint64)
            n = len(own) - len(before)
            key = np.zeros(n, dtype=np.uint64)
            for k in range(ORDER):
                key = key << np.uint64(BITS) | own[k : k + n]
            yield key
            before = own[n:].astype(np.uint16)


def fold_of(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(id_col: str) -> F.Column:
    """Whether the id's crc32 leaves HELD_OUT by FOLDS; a null id is neither held out nor learnt from."""
    return F.coalesce(fold_of(id_col) % FOLDS == HELD_OUT, F.lit(False))


def calibrates(id_col: str) -> F.Column:
    return F.coalesce((fold_of(id_col) % FOLDS != HELD_OUT) & (F.floor(fold_of(id_col) / FOLDS) % CALIBRATED == 0), F.lit(False))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of all of texts (lang, text), added up by task before they are shuffled."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, loose, sums, size = Reader(), {}, {}, 0

        def merged(lang: str) -> None:
            parts = [np.unique(np.concatenate(loose.pop(lang)), return_counts=True)] if lang in loose else []
            parts += [sums[lang]] if lang in sums else []
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums[lang] = keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(loose):
                merged(lang)
            for lang, (keys, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], schema=schema)
            sums.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for key in read.keys(text):
                    loose.setdefault(lang, []).append(key)
                    size += len(key)
                if size > CHUNK * 4:
                    for x in list(loose):
                        merged(x)
                    size = 0
                    if sum(len(s[0]) for s in sums.values()) > HELD:
                        yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """(lang, m, gram, n) of each order: counts of the longest, of shorter ones how many different characters stand before them."""
    out = now = counts.select("lang", F.lit(ORDER).alias("m"), "gram", "n")
    for m in range(ORDER - 1, 0, -1):
        now = now.groupBy("lang", F.col("gram").bitwiseAND(F.lit(MASKS[m])).alias("gram")).agg(F.count("*").alias("n")).select("lang", F.lit(m).alias("m"), "gram", "n")
        out = out.union(now)
    return out


def shares(every: DataFrame) -> DataFrame:
    """(lang, m, gram, n, share): what absolute discounting leaves an n-gram of its context's total. The discount is n1 / (n1 + 2 n2), three quarters without such counts."""
    once, twice = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
    off = every.groupBy("lang", "m").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.75).alias("off"))
    total = F.sum("n").over(Window.partitionBy("lang", "m", F.shiftright("gram", BITS)))  # at most as many rows as there are characters
    return every.withColumn("total", total).join(F.broadcast(off), ["lang", "m"]).select("lang", "m", "gram", "n", ((F.col("n") - F.col("off")) / F.col("total")).alias("share"))


def most_frequent(every: DataFrame, entries: int) -> DataFrame:
    """Of each language and order the most frequent n-grams, whole steps of an eighth of a power of two, at most entries in all."""
    step = F.floor(8 * F.log2("n")).cast("int").alias("step")
    bars = every.groupBy("lang", "m", step).agg(F.count("*").alias("grams")).collect()  # some hundred steps a language and order
    least, kinds = {}, {(r.lang, r.m) for r in bars}
    for kind in kinds:
        room, cut = entries // len(kinds), None
        for r in sorted((r for r in bars if (r.lang, r.m) == kind), key=lambda r: -r.step):
            room -= r.grams
            if room < 0:
                break
            cut = r.step
        if cut is not None:
            least[kind] = cut
    cuts = every.sparkSession.createDataFrame([(*k, v) for k, v in least.items()], "lang string, m int, cut int")
    return every.join(F.broadcast(cuts), ["lang", "m"]).where(step >= F.col("cut")).drop("cut")


class Sorted:
    """Rows of a matrix by key: keys are hashed, sorted, and found from where their first bits begin."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        hashed = keys * SPREAD
        by = np.argsort(hashed)
        self.hashed, self.rows = hashed[by], np.ascontiguousarray(rows[by], dtype=np.float32)
        self.shift = np.uint64(64 - max(1, math.ceil(math.log2(len(keys) + 1))))
        bucket = (self.hashed >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(bucket, np.arange(int(np.uint64(2**64 - 1) >> self.shift) + 1)).astype(np.int32)
        self.reach = int(np.bincount(bucket).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 without one."""
        hashed = keys * SPREAD
        at = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.hashed):
            return at
        first = self.begin[(hashed >> self.shift).astype(np.int64)].astype(np.int64)
        left = np.arange(len(keys))
        for k in range(self.reach):
            place = np.minimum(first[left] + k, len(self.hashed) - 1)
            hit = self.hashed[place] == hashed[left]
            at[left[hit]] = place[hit]
            left = left[~hit & (self.hashed[place] < hashed[left])]
            if not len(left):
                break
        return at


@dataclass
class Models:
    """The languages, and by order log probabilities of n-grams and of falling back from their contexts, a column a language."""

    langs: list[str]
    grams: list[Sorted]
    back: list[Sorted]

    def log2(self, keys: np.ndarray, m: int = ORDER) -> np.ndarray:
        """Of each key the logarithm of its last character's probability after those before it."""
        if m == 0:
            return np.full((len(keys), len(self.langs)), -float(BITS), dtype=np.float32)
        at = self.grams[m].find(keys & np.uint64(MASKS[m]))
        out = self.grams[m].rows[at] if len(self.grams[m].rows) else np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            rest = keys[miss]
            out[miss] = self.log2(rest, m - 1)
            context = self.back[m].find(rest >> np.uint64(BITS) & np.uint64(MASKS[m - 1]))
            known = context >= 0
            out[miss[known]] += self.back[m].rows[context[known]]
        return out

    def bits(self, read: Reader, text: str) -> tuple[np.ndarray, int]:
        """Cross-entropy a character by language, and the characters."""
        total, n, step = np.zeros(len(self.langs)), 0, max(1024, (1 << 20) // max(1, len(self.langs)))
        for keys in read.keys(text):
            n += len(keys)
            for at in range(0, len(keys), step):
                total -= self.log2(keys[at : at + step]).sum(axis=0, dtype=np.float64)
        return total / max(n, 1), n


def assembled(kept: DataFrame) -> Models:
    """The models of (lang, m, gram, share), of which there are at most ENTRIES: interpolated from the shortest order up."""
    own = kept.select("lang", F.col("m").cast("int").alias("m"), "gram", "share").toPandas()
    langs = sorted(own["lang"].unique())
    column = {x: i for i, x in enumerate(langs)}
    none = Sorted(np.zeros(0, dtype=np.uint64), np.zeros((0, len(langs))))
    models = Models(langs, [none], [none])
    for m in range(1, ORDER + 1):
        part = own[own["m"] == m]
        keys, at = np.unique(part["gram"].to_numpy().astype(np.uint64), return_inverse=True)
        share = np.zeros((len(keys), len(langs)))
        share[at, part["lang"].map(column).to_numpy(dtype=np.int64)] = part["share"]
        contexts, of = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        left = np.ones((len(contexts), len(langs)))
        np.subtract.at(left, of, share)
        left = np.clip(left, 1e-9, 1)
        models.grams.append(none)
        lower = np.exp2(models.log2(keys, m - 1).astype(np.float64))
        models.grams[m] = Sorted(keys, np.log2(share + left[of] * lower)) if len(keys) else none
        models.back.append(Sorted(contexts, np.log2(left)) if len(keys) else none)
    return models


def learn(texts: DataFrame, tables: Tables, entries: int = ENTRIES) -> Models:
    """The models of texts (lang, text) without nulls; counts cover all of them."""
    counts = tables.save(gram_counts(texts), "grams")
    every = tables.save(shares(orders(counts)), "shares")
    models = assembled(most_frequent(every, entries))
    tables.drop(counts, every)
    return models


def pooled(right: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Shares that never fall from one bin to the next: neighbours that do are put together."""
    stack: list[list[float]] = []
    for r, n in zip(right, of):
        stack.append([r, n, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            r2, n2, k2 = stack.pop()
            stack[-1] = [stack[-1][0] + r2, stack[-1][1] + n2, stack[-1][2] + k2]
    return np.concatenate([np.full(int(k), r / n) for r, n, k in stack])


def bin_of(lead: F.Column, n: F.Column) -> F.Column:
    """The lead in bits a character, which chance makes smaller the longer a text is, by its logarithm."""
    return F.least(F.floor(8 * F.log2(1 + lead * F.sqrt(n))), F.lit(BINS - 1)).cast("int")


def language_id(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", entries: int = ENTRIES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits, rejected) a row of df.

    A text's language is that of the lowest cross-entropy a character, ties by name; one without a letter,
    and any where nothing can be learnt, is `und` with score 0 and rejected. score is the share of
    calibrating texts with such a lead over the second language that were right; a text is rejected, with
    score at most a half, where its entropy is beyond that of nearly all the language's calibrating texts.
    Rows without an id, a text or a language teach nothing; ids and languages are no input of a prediction.
    Repeated rows count as often as they occur. Other columns are not read.
    """
    tables = Tables(spark)
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    taught = own.where(~held_out("doc_id") & ~calibrates("doc_id") & F.expr("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"))
    sent = spark.sparkContext.broadcast(learn(taught.select("lang", "text"), tables, entries))
    kind = own.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, read = sent.value, Reader()
        for batch in batches:
            found: list[tuple] = []
            for x in batch.column(1).to_pylist():
                bits, n = models.bits(read, x) if x and models.langs else (None, 0)
                if not n:
                    found.append((None, None, None, 0))
                    continue
                by = np.argsort(bits, kind="stable")
                second = float(bits[by[1]]) if len(by) > 1 else float(BITS)
                found.append((models.langs[by[0]], float(bits[by[0]]), max(0.0, second - float(bits[by[0]])), n))
            cols = zip(*found) if found else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.int64())))], names=["doc_id", "lang", "pred", "bits", "lead", "n"])

    scored = tables.save(own.mapInArrow(run, f"doc_id {kind}, lang string, pred string, bits double, lead double, n long"), "scored")
    told = scored.where(calibrates("doc_id") & F.expr("lang IS NOT NULL AND pred IS NOT NULL"))
    right, of = 0.5 + np.arange(BINS) / BINS / 2, np.ones(BINS)  # as if one text a bin had been seen
    for r in told.groupBy(bin_of(F.col("lead"), F.col("n")).alias("bin")).agg(F.count("*").alias("n"), F.count(F.when(F.col("pred") == F.col("lang"), 1)).alias("hit")).collect():
        right[r.bin] += r.hit
        of[r.bin] += r.n
    trust = F.array(*(F.lit(float(x)) for x in pooled(right, of)))
    limit = told.where("pred = lang").groupBy("pred").agg(F.percentile_approx("bits", IN_RANGE, 10_000).alias("limit")).withColumnRenamed("pred", "_of")
    out = scored.join(F.broadcast(limit), F.col("pred") == F.col("_of"), "left")
    score = F.element_at(trust, bin_of(F.col("lead"), F.col("n")) + 1)
    beyond = F.coalesce(F.col("bits") > SLACK * F.col("limit"), F.lit(False))
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.coalesce("pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("pred").isNull(), 0.0).when(beyond, F.least(score, F.lit(0.5))).otherwise(score).alias("score"), "bits", (F.col("pred").isNull() | beyond | (score < 0.5)).alias("rejected"),
    )
