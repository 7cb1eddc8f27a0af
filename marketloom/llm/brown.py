"""Language-model scoring with a Brown class-based bigram model.

Exchange clustering moves the most common words among classes while that raises the likelihood of
the training text's class bigrams. Every other word of the training text then joins the class that
raises it most, judged by its neighbours' classes over the whole text. A token's probability is that of its
class after the class before, times that of the word in its class, mixed with the add-one unigram:

    P(w | v) = (1 - MIX) T(class w | class v) c(w) / (c(class w) + 1) + MIX (c(w) + 1) / (N + V + 1)

A class leaves room for one more token, an unknown word, which any class may emit; the end is the one word
of its class. So both parts sum to one over the V known words and one unknown. Workers hold the classes of
common words; a join brings those of the others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Tables, map_lists

#: Words that exchange starts with, classes, words whose counts workers hold, weight of the unigram, rounds of exchange.
CLUSTERED, CLASSES, HELD, MIX, ROUNDS = 2048, 64, 1 << 19, 0.05, 6
#: Distinct words or pairs that a task adds up before it passes them on.
ADDED = 400_000
FOLDS, HELD_OUT = 7, 2
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII blanks with A-Z lowered, and one end."""
    return [*(text or "").encode().lower().split(), END]


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text leaves HELD_OUT by FOLDS; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of docs' text, added up in tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > ADDED:
                    yield passed_on()
                    seen = Counter()
        yield passed_on()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int) -> int:
    """A bound, the lowest power of sqrt 2 that at most `most` words' counts reach."""
    bounds = sorted({round(2 ** (i / 2)) for i in range(100)})
    over = counts.agg(*(F.count(F.when(F.col("n") >= b, 1)) for b in bounds)).first()
    return next(b for b, n in zip(bounds, over) if n <= most)


def bigrams(docs: DataFrame, places: dict[bytes, int], size: int) -> DataFrame:
    """(pair, n): neighbours among the clustered words, the rest (place size) and the end (size + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        many = 0

        def passed_on() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(waiting or [np.zeros(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for text in b.column(0):
                words = tokens(text.as_py())
                at = np.fromiter((places.get(w, size) for w in words), np.int64, len(words))
                waiting.append(np.concatenate([[size + 1], at[:-1]]) * (size + 2) + at)
                many += len(words)
                if many > 10 * ADDED:
                    yield passed_on()
                    waiting, many = [], 0
        yield passed_on()

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Each clustered word's class. pairs: counts of neighbours, whose last two places, the rest and the end, keep classes of their own.

    A word moves where the sum of n log n over class pairs, less that over classes on either side,
    grows most. It starts in a class by its frequency's rank.
    """
    size = len(pairs) - 2
    of = np.append(np.arange(size) % classes, [classes, classes + 1])
    k = classes + 2
    one = np.zeros((size + 2, k))
    one[np.arange(size + 2), of] = 1
    after, before = pairs @ one, pairs.T @ one  # each word's neighbours by class
    table = one.T @ after
    total_out, total_in = pairs.sum(1), pairs.sum(0)
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(rounds):
        moved = 0
        for w in range(size):
            own, self_n = of[w], pairs[w, w]
            a, b = after[w].copy(), before[w].copy()
            a[own] -= self_n
            b[own] -= self_n
            table[own] -= a
            table[:, own] -= b
            table[own, own] -= self_n
            out, into = table.sum(1) + b, table.sum(0) + a  # pairs with the word count for the other classes wherever it goes
            gain = (f(table + a[None, :]) - f(table)).sum(1) + (f(table + b[:, None]) - f(table)).sum(0)
            d = np.arange(k)
            t = table[d, d]
            gain += f(t + a + b + self_n) - f(t + a) - f(t + b) + f(t)
            gain -= f(out + total_out[w]) - f(out) + f(into + total_in[w]) - f(into)
            new = int(np.argmax(gain[:classes]))
            table[new] += a
            table[:, new] += b
            table[new, new] += self_n
            if new != own:
                moved += 1
                of[w] = new
                after[:, own] -= pairs[:, w]
                after[:, new] += pairs[:, w]
                before[:, own] -= pairs[w]
                before[:, new] += pairs[w]
        if moved <= size // 100:
            break
    return of


class Model:
    """Tables that workers score with; bounded by the words held and the classes. Made of the words that exchange clusters, until learn()."""

    def __init__(self, total: int, kinds: int, held: list[tuple[bytes, int]], pairs: np.ndarray, clustered: int, classes: int):
        self.total, self.kinds, self.rest, self.end = total, max(1, kinds), classes, classes + 1
        self.base = total + kinds + 1  # without training rows no word is known to the base, and to the model the end alone
        of = exchange(pairs, classes, ROUNDS)
        one = np.zeros((clustered + 2, classes + 2))
        one[np.arange(clustered + 2), of] = 1
        own = np.array([self.rest if w != END else self.end for w, _ in held])
        own[self.words(held, clustered)] = of[:clustered]
        self.learn(np.array([n for _, n in held], np.float64), own, one.T @ pairs @ one)

    def learn(self, counts: np.ndarray, of: np.ndarray, table: np.ndarray) -> None:
        """Counts and classes of the words held, and the counts of class bigrams."""
        into = table.sum(0)
        prior = (into + 1) / (into.sum() + len(table))
        self.table = table
        self.to = (table + prior[None, :]) / (table.sum(1, keepdims=True) + 1)
        self.into = into + 1
        self.log1 = np.append(np.log10(counts + 1), 0.0)
        self.of = np.append(of, self.rest).astype(np.int64)
        emit, base = self.parts(counts, of)
        emit[of == self.end] = 1 - MIX
        self.emit, self.floor = np.append(emit, 0.0), np.append(base, MIX / (self.total + self.kinds + 1))
        open_to = np.where(np.arange(len(table)) == self.end, 0.0, 1 / self.into)
        self.other = np.log10((1 - MIX) * (self.to @ open_to) + MIX / (self.total + self.kinds + 1))

    def parts(self, counts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words: (1 - MIX) times the probability in their class, and MIX times the add-one unigram."""
        return (1 - MIX) * counts / self.into[of], (counts + 1) * MIX / (self.total + self.kinds + 1)

    def affinity(self) -> np.ndarray:
        """What a neighbour, of each class before and then of each class after, adds for each class a word may join.

        Moving a word with few tokens into a class changes the sum of n log n over class pairs, less
        that over classes on either side, by this sum over its neighbours, to first order.
        """
        whole = self.table + self.table.T
        prior = (whole.sum(0) + 1) / (whole.sum() + len(whole))
        before = (self.table + prior[:, None]) / (self.table.sum(0, keepdims=True) + 1)
        after = (self.table + prior[None, :]) / (self.table.sum(1, keepdims=True) + 1)
        return np.log(np.concatenate([before, after.T]))[:, : self.rest]

    @staticmethod
    def words(held: list[tuple[bytes, int]], clustered: int) -> list[int]:
        """Places of the words that exchange clusters: the most common ones but for the end."""
        return [i for i, (w, _) in enumerate(held) if w != END][:clustered]

    def classes_of(self, at: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """Each token's class, of its place among held words and what the join found (places in the text, classes, counts)."""
        cls = self.of[at]
        cls[found[0]] = found[1]
        return cls

    def score(self, at: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[int, int, float, float]:
        """Tokens, those known, base and model score."""
        cls = self.classes_of(at, found)
        before = np.concatenate([[self.end], cls[:-1]])
        emit, base, log1 = self.emit[at], self.floor[at], self.log1[at]
        emit[found[0]], base[found[0]] = self.parts(found[2], found[1])
        log1[found[0]] = np.log10(found[2] + 1)
        unknown = cls == self.rest
        p = np.where(unknown, 1.0, self.to[before, cls] * emit + base)
        score = np.where(unknown, self.other[before], np.log10(p)).sum()
        return len(at), int((log1 > 0).sum()), float(log1.sum() - len(at) * math.log10(self.base)), float(score)


#: A class before, or the number of classes and a class after, and how often it was met.
MET = np.dtype([("code", "<u2"), ("n", "<u4")])


def neighbours(docs: DataFrame, of: dict[bytes, int], rest: int) -> DataFrame:
    """(word, met): for words without a class in `of`, the classes beside them, added up in tasks. Their own is `rest`, the end's the next."""
    end, k = rest + 1, rest + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        waiting: list[np.ndarray] = []
        many = 0

        def passed_on() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(waiting or [np.zeros(0, np.int64)]), return_counts=True)
            met = np.empty(len(keys), MET)
            met["code"], met["n"] = keys % (2 * k), n
            offsets = np.searchsorted(keys, np.arange(len(ids) + 1) * 2 * k) * MET.itemsize
            column = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(met.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), column], names=["word", "met"])

        for b in batches:
            for text in b.column(0):
                words = tokens(text.as_py())
                cls = np.fromiter((of.get(w, rest) for w in words), np.int64, len(words))
                at = np.flatnonzero(cls == rest)
                own = np.fromiter((ids.setdefault(words[i], len(ids)) for i in at.tolist()), np.int64, len(at)) * (2 * k)
                waiting += [own + np.concatenate([[end], cls])[at], own + k + cls[at + 1]]
                many += len(at)
                if len(ids) > ADDED or many > 5 * ADDED:
                    yield passed_on()
                    ids, waiting, many = {}, [], 0
        yield passed_on()

    return docs.select("text").mapInArrow(run, "word binary, met binary")


def place_words(met: DataFrame, affinity: np.ndarray) -> DataFrame:
    """(word, n, cls): each word's count, and the class that all its neighbours together speak for."""
    width = len(affinity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(width)  # a word's rows are one after another, but may go on in the next batch

        def placed(words: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
            cls = np.round(sums @ affinity, 6).argmax(1)
            n = sums[:, width // 2 :].sum(1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(cls.astype(np.int32))], names=["word", "n", "cls"])

        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                coded = whole.column(0).slice(start, 4096).dictionary_encode()
                words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                rows = whole.column(1).slice(start, 4096).to_pylist()
                met = np.frombuffer(b"".join(rows), MET)
                each = np.repeat(ids.astype(np.int64), [len(r) // MET.itemsize for r in rows])
                sums = np.bincount(each * width + met["code"], weights=met["n"], minlength=len(words) * width).reshape(-1, width)
                if words[0] == last:
                    sums[0] += carried
                elif last is not None:
                    yield placed([last], carried[None])
                last, carried = words[-1], sums[-1].copy()
                if len(words) > 1:
                    yield placed(words[:-1], sums[:-1])
        if last is not None:
            yield placed([last], carried[None])

    return met.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, cls int")


def class_bigrams(docs: DataFrame, classes_of: Callable[[np.ndarray, tuple], np.ndarray], rest: int) -> np.ndarray:
    """Counts of neighbours by class over located docs."""
    end, k = rest + 1, rest + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k * k, np.int64)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                cls = classes_of(*opened(*row))
                n += np.bincount(np.concatenate([[end], cls[:-1]]) * k + cls, minlength=k * k)
        pairs = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n[pairs])], names=["pair", "n"])

    got = docs.select("at", "pos", "cls", "n").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k)
    table[got["pair"].to_numpy()] = got["n"].to_numpy()
    return table.reshape(k, k)


def opened(at: bytes, *found: list[int] | None) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    return np.frombuffer(at, "<i4"), tuple(np.array(x or [], np.int64) for x in found)


def locate(tables: Tables, docs: DataFrame, places: dict[bytes, int], others: DataFrame) -> DataFrame:
    """(doc_id, held_out, at, pos, cls, n): tokens' places among held words, and of the `others` among them the places in the text, classes and counts."""
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def task() -> Callable[..., tuple]:
        base, done = TaskContext.get().partitionId() << 33, [0]

        def batch(ids: list, out: list, texts: list) -> tuple:
            keys = list(range(base + done[0], base + done[0] + len(ids)))
            done[0] += len(ids)
            at, rare, pos = [], [], []
            for t in texts:
                words, n = tokens(t), len(sent.value)
                own = np.fromiter((sent.value.get(w, n) for w in words), np.int32, len(words))
                at.append(own.astype("<i4").tobytes())
                pos.append(np.flatnonzero(own == n).tolist())
                rare.append([words[i] for i in pos[-1]])
            return keys, ids, out, at, rare, pos

        return batch

    schema = f"row long, doc_id {docs.dtypes[0][1]}, held_out boolean, at binary, word array<binary>, pos array<int>"
    read = tables.save(map_lists(docs.select("doc_id", "held_out", "text"), task, schema, per_task=True), "read")
    found = read.select("row", F.inline(F.arrays_zip("word", "pos"))).join(others, "word").groupBy("row").agg(F.collect_list(F.struct("pos", "cls", "n")).alias("found"))
    located = tables.save(read.drop("word", "pos").join(found, "row", "left").select("doc_id", "held_out", "at", "found.pos", "found.cls", "found.n"), "located")
    tables.drop(read)
    return located


def fit(tables: Tables, docs: DataFrame, classes: int, clustered: int, held: int) -> tuple[Model, DataFrame]:
    """The model of the rows not held out, and all rows with their tokens located in it."""
    train = docs.where(~F.col("held_out"))
    counts = tables.save(word_counts(train), "words")
    total, kinds, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n")))).first()
    total = total or 0
    first = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(clustered).select("word", "n").collect()
    words = [(bytes(w), n) for w, n in first] + [(END, ends or 0)]
    size = len(first)
    pairs = bigrams(train, {w: i for i, (w, _) in enumerate(words[:size])} | {END: size + 1}, size).toArrow()
    matrix = np.zeros((size + 2) ** 2)
    matrix[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    model = Model(total, kinds, words, matrix.reshape(size + 2, size + 2), size, min(classes, max(1, size)))

    own = {w: int(c) for (w, _), c in zip(words, model.of)}
    placed = tables.save(place_words(neighbours(train, own, model.rest), model.affinity()), "placed")
    bound = common_words(placed, max(0, held - size - 1))
    common = placed.where(F.col("n") >= bound).toArrow()
    places = {w: i for i, w in enumerate([w for w, _ in words] + common["word"].to_pylist())}
    n = np.concatenate([np.array([n for _, n in words], np.float64), common["n"].to_numpy()])
    model.of = np.concatenate([model.of[:-1], common["cls"].to_numpy(), [model.rest]]).astype(np.int64)
    located = locate(tables, docs, places, placed.where(F.col("n") < bound))
    table = class_bigrams(located.where(~F.col("held_out")), model.classes_of, model.rest)
    model.learn(n, model.of[:-1], table)
    return model, located


def lm_scores(spark: SparkSession, df: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, held: int = HELD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) a row of df.

    Learns from the rows not held out. Null and empty texts are one end token. Repeated rows count and
    are scored each. Without training rows no token is known, and each has a base of 0. Null ids learn
    and are scored; other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), held_out(id_col).alias("held_out"))
    model, located = fit(Tables(spark), docs, classes, clustered, held)
    sent, total = spark.sparkContext.broadcast(model), model.total

    def batch(ids: list, out: list, *located: list) -> tuple:
        made = [sent.value.score(*opened(*row)) for row in zip(*located)]
        return ids, out, [m[0] for m in made], [m[1] for m in made], [total] * len(ids), [m[2] for m in made], [m[3] for m in made]

    schema = f"doc_id {docs.dtypes[0][1]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return map_lists(located, batch, schema)
