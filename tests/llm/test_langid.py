"""Language models against a brute-force version with dictionaries, and the operator on odd tables and held-out texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import langid, queries
from marketloom.sources.tables import Tables

SYLLABLES = {"aa": ["ba", "be", "lo", "li", "ra"], "bb": ["shu", "kla", "mor", "é", "ßen"], "cc": ["мо", "ра", "li", "та", "字"]}


def sentence(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(x, sentence(x, rng, rng.randrange(1, 30))) for x in rng.choices(sorted(SYLLABLES), k=n)]


def characters(text):
    """The text as the models see it, by a plain loop."""
    out = [32] * (langid.ORDER - 1)
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c) if ord(c) < 0x800 else 0x800 | (ord(c) * 2654435761 >> 16 & 0x7FF))
        elif out[-1] != 32:
            out.append(32)
    return out


class Brute:
    """Interpolated Kneser-Ney of one language, from the definition."""

    def __init__(self, texts):
        self.counts = {langid.ORDER: Counter()}
        for t in texts:
            c = characters(t)
            self.counts[langid.ORDER].update(tuple(c[i : i + langid.ORDER]) for i in range(len(c) - langid.ORDER + 1))
        for m in range(langid.ORDER - 1, 0, -1):
            self.counts[m] = Counter(g[1:] for g in self.counts[m + 1])
        self.off, self.of = {}, {}
        for m, counts in self.counts.items():
            once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
            self.off[m] = once / (once + 2 * twice) if once and twice else 0.75
            self.of[m] = defaultdict(list)
            for g, n in counts.items():
                self.of[m][g[:-1]].append(n)

    def p(self, gram):
        m = len(gram)
        if m == 0:
            return 2.0**-langid.BITS
        own = self.of[m].get(gram[:-1])
        if not own:
            return self.p(gram[1:])
        got = max(self.counts[m].get(gram, 0) - self.off[m], 0) / sum(own)
        return got + self.off[m] * len(own) / sum(own) * self.p(gram[1:])

    def bits(self, text):
        c = characters(text)
        n = len(c) - langid.ORDER + 1
        return sum(-math.log2(self.p(tuple(c[i : i + langid.ORDER]))) for i in range(n)) / n


def test_models_are_those_of_the_definition(spark, monkeypatch):
    rows = corpus(120)
    models = langid.learn(spark.createDataFrame(rows, "lang string, text string").repartition(5), Tables(spark), 10**6)
    assert models.langs == sorted(SYLLABLES)
    read = langid.Reader()
    for text in [t for _, t in corpus(12, 9)] + ["x", "ba", "!! 42 ba", "ZZZ qqq", "字字 Ба"]:
        got, n = models.bits(read, text)
        assert n == len(characters(text)) - langid.ORDER + 1
        for i, lang in enumerate(models.langs):
            assert got[i] == pytest.approx(Brute([t for x, t in rows if x == lang]).bits(text), rel=1e-4)
        monkeypatch.setattr(langid, "CHUNK", 7)
        assert np.allclose(models.bits(read, text)[0], got, rtol=1e-6)
        monkeypatch.undo()


@pytest.mark.parametrize("entries", [60, 300, 10**6])
def test_probabilities_add_up_to_one_however_few_are_kept(spark, entries):
    models = langid.learn(spark.createDataFrame(corpus(120), "lang string, text string"), Tables(spark), entries)
    assert sum(len(s.hashed) for s in models.grams) <= entries
    for context in ([32, 32, 32], [32, ord("b"), ord("a")], [ord("z"), ord("l"), ord("o")], [ord("q")] * 3):
        start = sum(c << langid.BITS * (langid.ORDER - 1 - i) for i, c in enumerate(context))
        keys = np.arange(1 << langid.BITS, dtype=np.uint64) + np.uint64(start)
        assert np.allclose(np.exp2(models.log2(keys)).sum(axis=0), 1, atol=2e-4)


def test_sorted_arrays_find_what_they_hold():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 48, size).astype(np.uint64))
        s = langid.Sorted(keys, np.arange(len(keys), dtype=float)[:, None])
        asked = np.concatenate([keys, rng.integers(0, 1 << 48, 100).astype(np.uint64)])
        at = s.find(asked)
        assert all((a >= 0) == (k in set(keys.tolist())) for k, a in zip(asked[-100:].tolist(), at[-100:]))
        assert len(keys) == 0 or (s.rows[at[: len(keys)], 0] == np.arange(len(keys))).all()


def test_pooled_shares_never_fall():
    assert langid.pooled(np.array([1.0, 0.0, 3.0]), np.array([2.0, 2.0, 3.0])).tolist() == [0.25, 0.25, 1.0]
    rng = np.random.default_rng(1)
    of = rng.integers(1, 9, 64).astype(float)
    got = langid.pooled(rng.random(64) * of, of)
    assert (np.diff(got) >= 0).all() and len(got) == 64


def test_odd_rows(spark):
    rows = [(i, t, x, "clash", True) for i, (x, t) in enumerate(corpus(300, 4))]
    rows += [(1000, None, "aa", "c", False), (1001, "", "bb", "c", False), (1002, " 42 !? ", None, "c", False), (1003, "ba" * 300_000, None, "c", None), (1004, "lo" + " 7" * 400_000, "aa", "c", None)]
    rows += [(None, "shu kla mor", "bb", None, None), (3, "shu kla mor", None, None, None), (3, "shu kla mor", "bb", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, held_out boolean")
    out = langid.language_id(spark, df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "bits", "rejected"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in range(1000, 1005)] == ["und", "und", "und", "aa", "aa"]
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "cc", "und") for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.lang_pred for r in got if r.doc_id is None} == {"bb"}
    truth = {i: x for i, (x, _) in enumerate(corpus(300, 4))}
    apart = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert sum(r.lang_pred == truth[r.doc_id] for r in apart) >= 0.95 * len(apart)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, t, x) for i, (x, t) in enumerate(corpus(200, 5))]
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    a, b = (sorted(map(tuple, langid.language_id(spark, spark.createDataFrame(r, "doc_id long, text string, lang string")).collect())) for r in (rows, other))
    assert a == b


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ba be", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.language_id(spark, df).collect()] == [("und", 0.0, None, True)] * 2
    assert langid.language_id(spark, df.where("false")).count() == 0


def test_query_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    told = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("d"), "lang", "text")
    got = queries.op11_language_id(spark, data).where("held_out").join(told, F.col("doc_id") == F.col("d")).toPandas()
    right = got["lang_pred"] == got["lang"]
    assert right.mean() >= 0.98
    assert got["rejected"].mean() < 0.05 and got["score"].between(0, 1).all()
