"""Each operator against brute force, a public library or an exact round trip, on small and odd tables."""

import base64
import hashlib
import io
import itertools
import zlib
from pathlib import Path

import numpy as np
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from marketloom.llm import bpe, brown, chat, jaccard, neardup, packing, pii, quality, queries, tokencount, warc
from marketloom.llm.common import likely_in, vocabulary

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edited(text, seed, times):
    w, rng = text.split(" "), np.random.default_rng(seed)
    for _ in range(times):
        w[rng.integers(len(w))] = f"edit{rng.integers(10**6)}"
    return " ".join(w)


BASE = prose(1, 200)
TEXTS = [None, "", "  \n", "one", "One", "two words", BASE, BASE, BASE.upper(), *(edited(BASE, s, s % 5 + 1) for s in range(40)), *(prose(s, 60) for s in range(2, 12)),
         "x" * 5000, "Wörter ohne Zweck <|endoftext|> it's\t done  \n\n ok ", "repeat me now " * 40, prose(99, 6000), prose(3, 9), prose(3, 9) + " z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", True, "extra") for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None), (6, BASE, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept boolean, n_words string")


def empty(docs):
    return docs.where("doc_id < -1")


def sets_of(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute_components(texts, k, top, bottom):
    sets = sets_of(texts, k)
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and bottom * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    return sets, root


@pytest.mark.parametrize(("k", "top"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, k, top):
    got = jaccard.jaccard_join(spark, docs, jaccard.Join(k, top, 100)).collect()
    sets, root = brute_components(TEXTS, k, top, 100)
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])
    assert jaccard.jaccard_join(spark, empty(docs)).count() == 0


def test_jaccard_large_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 5)  # cuts and pairs of blocks
    texts = [edited(BASE, s, s % 9) for s in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == brute_components(texts, 3, 90, 100)[1]


def test_jaccard_ring_of_two_points(spark):
    """Two texts that meet only in the cell of a third, far from both, link all the same."""
    pool, start = iter(f"v{i}" for i in range(10**6)), ["a", "b"]

    def grow(words, classes):
        for c in classes:
            words = [*words, next(w for w in pool if jaccard.shingles(" ".join([*words[-2:], w]), 3)[0] % 2 == c)]
        return words

    common = grow(start, [0] * 4)
    pivot, x = grow(common, [1] * 5), grow(common, [1] * 5)
    texts = [" ".join(w) for w in (pivot, x, grow(x, [1]))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(3)] == brute_components(texts, 3, 90, 100)[1] == [0, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(0, 12), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]))
def test_linked_sets_share_a_cell(n, differ, seed, bound):
    join, rng = jaccard.Join(3, *bound), np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    keep = a[: max(1, len(a) - int(rng.integers(0, differ + 1)))]
    b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(rng.integers(0, differ + 1))).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    if join.links(np.int64(both), np.int64(len(a) + len(b) - both)):
        assert set(jaccard.cells(a, join)) & set(jaccard.cells(b, join))


@pytest.mark.parametrize(("join", "sizes"), [(jaccard.Join(), (9, 12, 15, 16, 18)), (jaccard.Join(5, 80), (4, 5, 7, 8, 12, 16))])
def test_unlike_short_sets_share_no_cell(join, sizes):
    rng = np.random.default_rng(6)
    for n in sizes:
        seen: dict = {}
        for _ in range(4000):
            for c in jaccard.cells(np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)), join):
                seen[c] = seen.get(c, 0) + 1
        assert max(seen.values()) == 1


def test_block_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(25)] + [np.array([10**9], np.uint64)]
    want = [[len(np.intersect1d(a, b)) if a is not b else len(a) for b in sets] for a in sets]
    got = jaccard.overlaps(sets, 64)
    np.testing.assert_array_equal(got[~np.eye(26, dtype=bool)], np.array(want)[~np.eye(26, dtype=bool)])


def test_jaccard_of_heavy_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WEIGHT", 500)  # blocks by their shingles
    texts = [edited(BASE, s, s % 9) for s in range(40)]
    rows = list(enumerate(texts)) + [(0, "another text of the same id"), (7, texts[7])]
    got = jaccard.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    root = brute_components(texts, 3, 90, 100)[1]
    assert {r.doc_id: r.component_id for r in got.where("n_shingles > 10").collect()} == dict(enumerate(root))
    assert sorted(r.asDict()["component_id"] for r in got.collect()) == sorted(r.asDict()["component_id"] for r in got.collect())


def test_jaccard_of_many_short_texts(spark):
    """Thousands of texts of 9 to 15 shingles, some of which are copies with a word more."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"q{x}" for x in rng.integers(0, 10**6, rng.integers(11, 18))) for _ in range(4000)]
    texts += [f"{texts[i]} more" for i in range(0, 4000, 10)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = [len(t.split()) - 2 for t in texts]
    assert got == {i: (i - 4000) * 10 if i >= 4000 and 100 * n[(i - 4000) * 10] >= 90 * n[i] else i for i in range(len(texts))}


def test_likely_rows(spark):
    keys = spark.range(-500, 40_000, 7)
    got = {r[0] for r in likely_in(spark.range(-500, 40_000), "id", keys, 24).select("id").collect()}
    assert set(range(-500, 40_000, 7)) <= got and len(got) < 6200
    assert likely_in(keys, "id", keys.limit(0)).count() == 0


def embedded(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")


def brute_cosines(rows, threshold=0.95):
    """(links, component, kept) a row: all pairs, component ids by repeated merging."""
    units = [neardup.unit(None if v is None else [None if c is None else float(c) for c in v]) for _, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = units[a], units[b]
        if x is not None and y is not None and len(x) == len(y) and float(x @ y) >= threshold:
            n[a], n[b] = n[a] + 1, n[b] + 1
            root = [root[a] if r == root[b] else r for r in root]
    least = {r: min((rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None), default=None) for r in set(root)}
    return [(n[j], least[root[j]], rows[j][0] is not None and rows[j][0] == least[root[j]]) for j in range(len(rows))]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    centre, twin = rng.normal(size=16), rng.normal(size=16)
    vectors = [rng.normal(size=16) for _ in range(150)] + [centre + 0.12 * rng.normal(size=16) for _ in range(60)] + [centre] * 5
    rows = [*enumerate(vectors), (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (905, []), (906, [float("inf")] * 16),
            (907, [1, 2, 3]), (908, [1, 2, 3.01]), (909, [3, -2, 1]), (None, centre), (None, twin), (None, 2 * twin), (910, [2.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark, embedded(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, brute_cosines(rows))), key=str)
    assert neardup.near_duplicates(spark, embedded(spark, [])).count() == 0


def test_embeddings_of_rows_that_share_an_id(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (1, [0, 1]), (2, [0, 1]), (3, [1, 0.001])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(spark, embedded(spark, rows)).collect())
    assert got == [(1, 2, 1)] * 3 + [(2, 2, 1), (3, 2, 1)]


@pytest.mark.parametrize(("cell", "block"), [(10, 2048), (10, 7), (60, 16)])
def test_embeddings_across_many_cells(spark, monkeypatch, cell, block):
    for name, value in {"CELL": cell, "BLOCK": block, "VISITORS": 3 * block, "DEALT": 50, "CENTRES": 8}.items():  # parted at two levels and more, with visits across borders
        monkeypatch.setattr(neardup, name, value)
    rng = np.random.default_rng(3)
    centres = {n: rng.normal(size=(12, n)) for n in (16, 24)}
    rows = list(enumerate(c + 0.18 * rng.normal(size=n) for n in centres for c in centres[n] for _ in range(30)))
    rows += [(1000 + i, centres[16][0] + 1e-4 * rng.normal(size=16)) for i in range(90)]  # a cell that centres do not part
    got = {r.vec_id: r for r in neardup.near_duplicates(spark, embedded(spark, rows)).collect()}
    want = brute_cosines(rows)
    links, found = sum(n for n, _, _ in want), sum(r.n_links for r in got.values())
    assert 0.9 * links <= found <= links and all(got[i].n_links <= n for (i, _), (n, _, _) in zip(rows, want))
    assert sum(got[i].component_id == c for (i, _), (_, c, _) in zip(rows, want)) >= 0.9 * len(rows)
    tables = neardup.Tables(spark)
    entries = tables.save(embedded(spark, rows).selectExpr("vec_id id", "1L copies", "embedding").toDF("id", "copies", "v"), "v")
    units = neardup.map_lists(entries, lambda i, c, v: (i, c, [neardup.unit(x).tobytes() for x in v]), "id long, copies long, unit binary")
    placed = neardup.Cells(tables, 0.95, neardup.REACH).parted(tables.save(units, "units"))
    assert placed.where("home").count() == len(rows) and placed.select("cell").distinct().count() >= 8


def test_embeddings_take_disk_by_their_bytes_and_not_by_their_visits(spark, monkeypatch):
    for name, value in {"CELL": 40, "CENTRES": 16, "SHARE": 1 << 19, "BLOCK": 64, "VISITORS": 256, "WIDE": 200}.items():  # many visits, many shares, large cells too, wide vectors
        monkeypatch.setattr(neardup, name, value, raising=False)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[2900:] = x[:100] + 0.15 * rng.normal(size=(100, 64))
    x[2800:2900] = x[0] + 0.01 * rng.normal(size=(100, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    peak, save = [0], neardup.Tables.save

    def weighed(self, table, name):
        out = save(self, table, name)
        peak[0] = max(peak[0], sum(p.stat().st_size for p in Path(self.root.removeprefix("file://")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(neardup.Tables, "save", weighed)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(spark, df).collect()}
    assert peak[0] < 4 * x.nbytes and spark.conf.get(setting) == before
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = near.sum(1) - 1
    assert 0.9 * want.sum() <= sum(got.values()) <= want.sum() and all(got[i] <= n for i, n in enumerate(want.tolist()))


def test_warc_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (5, "u\r\n", "same"), (3, "v", None), (4, "v", ""), (6, None, "é" * 9000), (None, "w", "null id"), (8, "x", "twice"), (8, "x", "twice")]
    got = [r.asDict() for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for p, _, h in rows if p == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        last = {1: 5, 2: 5, 3: 4}.get(r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("revisit", last) if last else ("response", None))
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_of_a_payload_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 10)  # the most frequent payloads are broadcast
    rows = [(i, "u", "hot" if i % 3 else f"p{i % 7}", "x", 1) for i in range(300)] + [(400 + i, None, f"once {i}", "y", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, key string, last long")
    last: dict = {}
    for p, _, h, *_ in rows:
        last[h] = max(p, last.get(h, -1))
    for r in warc.round_trip(spark, docs.repartition(5)).collect():
        html = next(h for p, _, h, *_ in rows if p == r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if last[html] == r.page_id else ("revisit", last[html]))


def test_warc_rejects_damage():
    out = io.BytesIO()
    w = warc.Writer(out, warc.make_dictionary([b"abc"]))
    w.add(warc.record(1, "u", b"abc", warc.digest(b"abc"), 3, None, False))
    raw = out.getvalue()
    assert warc.parse(next(warc.read_archive(io.BytesIO(raw))))["payload"] == b"abc"
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[4:])))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abd", warc.digest(b"abc"), 3, None, False))
    packed = zstandard.ZstdCompressor().compress(b"dictionary" * 9)
    head = warc.struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed
    assert list(warc.read_archive(io.BytesIO(head))) == []


def test_language_model(spark):
    rows = [(i, prose(i, 80) + (f" rare{i}" if i % 3 else "")) for i in range(150)] + [(200, None), (None, "w1 unseen")]
    got = {r.doc_id: r for r in brown.lm_scores(spark, spark.createDataFrame(rows, "doc_id long, text string"), classes=8, clustered=50, held=200).collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c: dict = {}
    for i, t in rows:
        for w in brown.tokens(t) if not out(i) else []:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for i, t in rows:
        words, r = brown.tokens(t), got[i]
        base = sum(np.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(words), sum(w in c for w in words), n)
        assert r.base_score == pytest.approx(base)
        gain += r.score - r.base_score
    assert gain > -0.01 * n
    assert brown.lm_scores(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_scores(model, located, rows):
    """Scores by the formula of the model's words: classes, class bigrams and counts are taken from its tokens, one at a time."""
    cls, n = {}, {}
    seq = {}
    for r in located.collect():
        c = model.classes_of(*brown.opened(r.at, r.pos, r.cls, r.n))
        seq.setdefault((r.doc_id, len(c)), []).append((c, r.held_out))
    for i, t in rows:
        words, (c, out) = brown.tokens(t), seq[i, len(brown.tokens(t))][0]
        for w, k in zip(words, c):
            cls[w] = int(k)
            if not out:
                n[w] = n.get(w, 0) + 1
    k = model.rest + 2
    pair, into = np.zeros((k, k)), np.zeros(k)
    for i, t in rows:
        words, (c, out) = brown.tokens(t), seq[i, len(brown.tokens(t))][0]
        before = model.end
        for w in words if not out else []:
            pair[before, cls[w]] += 1
            into[cls[w]] += 1
            before = cls[w]
    prior = (into + 1) / (into.sum() + k)
    to = (pair + prior) / (pair.sum(1, keepdims=True) + 1)
    total, v = sum(n.values()), len(n)

    def p(before, w):
        if w not in n:  # the unknown word, which any class but the end's may emit
            return (1 - brown.MIX) * sum(to[before, c] / (into[c] + 1) for c in range(k) if c != model.end) + brown.MIX / (total + v + 1)
        emit = 1.0 if w == brown.END else n[w] / (into[cls[w]] + 1)
        return (1 - brown.MIX) * to[before, cls[w]] * emit + brown.MIX * (n[w] + 1) / (total + v + 1)

    for before in range(k):
        assert sum(p(before, w) for w in n) + p(before, None) == pytest.approx(1)
    out = {}
    for i, t in rows:
        before, score = model.end, 0.0
        for w in brown.tokens(t):
            score += np.log10(p(before, w))
            before = cls[w] if w in n else model.rest
        out[i] = score
    return out


def test_scores_are_those_of_a_distribution(spark):
    rng = np.random.default_rng(8)
    weights = 1 / np.arange(1, 81)
    rows = [(i, " ".join(rng.choice(WORDS[:80], 40, p=weights / weights.sum())) + (f" only{i}" if i % 4 == 0 else "")) for i in range(90)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", brown.held_out("doc_id"))
    got = {r.doc_id: r.score for r in brown.lm_scores(spark, docs, classes=5, clustered=20, held=40).collect()}
    model, located = brown.fit(brown.Tables(spark), docs, 5, 20, 40)
    assert got == pytest.approx(brute_scores(model, located, rows))


def test_language_model_without_training_rows(spark):
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    for r in brown.lm_scores(spark, spark.createDataFrame([(i, "two words") for i in out], "doc_id long, text string")).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and -20 < r.score < 0


def test_every_training_word_has_a_class(spark):
    """Words that exchange does not see are placed by their neighbours, held by workers or joined; P sums to one."""
    rng = np.random.default_rng(5)
    kinds = [[f"{c}{i}" for i in range(60)] for c in "ab"]  # a word of one kind always follows one of the other
    weights = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(kinds[j % 2], p=weights / weights.sum()) for j in range(60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", brown.held_out("doc_id"))
    seen = {w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()}
    scores = []
    for held in (1 << 19, 30):
        model, located = brown.fit(brown.Tables(spark), docs, 2, 16, held)
        got = located.where("not held_out").collect()
        n_class = {}
        for r in got:
            cls = model.classes_of(*brown.opened(r.at, r.pos, r.cls, r.n))
            assert model.rest not in cls  # none is left out
            for j, c in enumerate(cls[:-1]):
                n_class.setdefault(j % 2, []).append(int(c))
        assert len({c for cs in n_class.values() for c in set(cs)}) == 2 and all(len(set(cs)) == 1 for cs in n_class.values())
        into = model.into[: model.rest] - 1
        assert into.sum() + len(got) == model.total and model.kinds == len(seen) + 1
        floor = brown.MIX / (model.total + model.kinds + 1)
        for before in range(model.rest + 2):
            known = (1 - brown.MIX) * (model.to[before, : model.rest] @ (into / (into + 1)) + model.to[before, model.end]) + floor * (model.total + model.kinds)
            assert known + 10 ** model.other[before] == pytest.approx(1)
        scores.append({r.doc_id: r.score for r in brown.lm_scores(spark, docs, 2, 16, held).collect()})
    assert scores[0] == pytest.approx(scores[1])


def test_bpe_matches_library(spark, docs):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for held in (1 << 18, 5):
        for r in bpe.bpe(spark, docs, path, held=held, with_ids=True).collect():
            text = BASE if r.doc_id is None else TEXTS[r.doc_id] or ""
            want = lib.encode_ordinary(text)
            assert r.ids == want and r.decoded == text.encode() and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert bpe.bpe(spark, empty(docs), path).count() == 0


def test_bpe_long_words_of_many_bytes(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = ["数据" * 20, "слово" * 8, "ภาษา" * 16, "x" * 64, "é" * 32, "é" * 33, "ok " + "数" * 21 + " " + "数" * 22]
    got = bpe.bpe(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {i: lib.encode_ordinary(t) for i, t in enumerate(texts)}


def test_token_counts_match_library(spark, docs):
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for r in tokencount.token_counts(docs, vocabulary("byte_bpe_50k.json")).collect():
        text = BASE if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' ,.\n\t\u00a0\u2003\x1cé漢1²\0<|>")), max_size=30))
def test_split_is_safe(text):
    whole = tokencount.Spaced.pattern.findall(text)
    assert [p for s in tokencount.Spaced.split(text) for p in tokencount.Spaced.pattern.findall(s)] == whole


def test_packing(spark, docs):
    path = vocabulary("word_bpe_49k.json")
    lib, got = Tokenizer.from_file(path), packing.pack(spark, docs, path).toPandas()
    want = []
    for i, t in [*enumerate(TEXTS), (-1, BASE), (6, BASE)]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32)) == sorted(want)
    check_packed(got.sequence_id, got.offset, got.length, 4096)
    assert packing.pack(spark, empty(docs), path).count() == 0


def check_packed(sequences, offsets, lengths, size):
    by: dict = {}
    for s, o, n in zip(sequences, offsets, lengths):
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(by)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan(histogram):
    rows = [(s + (r - a) // k, o + (r - a) % k * n, n) for n, a, b, s, o, k in packing.plan(histogram, 64) for r in range(a, b)]
    assert sorted(n for _, _, n in rows) == sorted(n for n, c in histogram.items() for _ in range(c))
    used = check_packed(*zip(*rows), 64) if rows else 0
    # Best fit leaves no sequence that a later one's first piece would have fitted into, so that two sequences hold more than one's size.
    assert used <= 2 * -(-sum(n * c for n, c in histogram.items()) // 64)


def test_plan_is_tight_on_texts_of_usual_lengths():
    lengths = np.random.default_rng(3).lognormal(6, 1, 5000).clip(1, 4096).astype(int)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    rows = [(s + (r - a) // k, o + (r - a) % k * n, n) for n, a, b, s, o, k in packing.plan(histogram, 4096) for r in range(a, b)]
    assert check_packed(*zip(*rows), 4096) <= -(-lengths.sum() // 4096) + 1  # the least that any packing needs, and one


TRICKY = "\\### Assistant: </turn> ok"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "### x"]), st.text(alphabet=st.sampled_from(list("\\#</turn> :\nhec")))), max_size=5))
def test_chat_reads_back(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_layouts(spark):
    one = [("user", "q"), ("assistant", TRICKY)]
    frames = [
        spark.createDataFrame([(1, 1, "assistant", TRICKY, "x"), (1, 0, "user", "q", "y")], "conv_id long, turn long, role string, text string, turns string"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", TRICKY)])], "conv_id long, messages array<struct<role: string, content: string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", TRICKY)])], "conv_id long, conversations array<struct<`from`: string, value: string>>"),
        spark.createDataFrame([(1, "q", TRICKY)], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, "q", "", TRICKY)], "conv_id long, instruction string, input string, output string"),
    ]
    for f in frames:
        turns = chat.canonical_turns(f)
        assert [(t.role, t.text) for t in turns.first().turns] == one
        r = chat.digests(chat.format_chats(turns)).first()
        assert (r.n_turns, r.loss_chars) == (2, len(TRICKY)) and r.loss_sha256 == hashlib.sha256(TRICKY.encode()).hexdigest()
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "q")], "conv_id long, other string"))
    nulls = spark.createDataFrame([(None, 0, None, None), (None, 0, "user", "x"), (3, 1, None, "y")], "conv_id long, turn long, role string, text string")
    assert sorted(str(r.conv_id) + str(r.n_turns) for r in chat.digests(chat.format_chats(chat.canonical_turns(nulls))).collect()) == ["31", "None1", "None1"]
    assert chat.canonical_turns(nulls.where("false")).count() == 0


def test_chat_layouts_mixed_in_one_frame(spark):
    schema = "conv_id long, prompt string, response string, instruction string, input string, output string, messages array<struct<role: string, content: string>>, lang string"
    rows = [(1, "q", "a", None, None, None, None, "en"), (2, None, None, "do", "this", "done", None, None), (3, None, None, "do", None, "done", None, "x"),
            (4, None, None, None, None, None, [("user", "q"), ("assistant", "a")], None), (5, None, None, None, None, None, None, "x"), (6, "q", "a", "do", None, "done", None, None)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "do\nthis"), ("assistant", "done")], 3: [("user", "do"), ("assistant", "done")], 4: [("user", "q"), ("assistant", "a")], 5: [], 6: []}


def test_chat_digests_against_the_contract(spark):
    rows = [(1, 2, "assistant", "b ### x: </turn>"), (1, 0, "user", "a\\h"), (1, 1, "assistant", "é\n"), (2, 0, "system", None), (-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in (1, 2, -7):
        turns = [(r, t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len("### ") + len(chat.escape(r)) + len(": ") + len(chat.escape(t)) + len("</turn>\n") for r, t in turns)
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == (len(loss), sha(loss), size)


@pytest.mark.parametrize("text", [" (dot) " * 100_000, "a (at) " * 50_000, "jo@" * 50_000, "1 one, " * 50_000, "\uff141 " * 60_000, "one two " * 50_000, "+1 " * 60_000])
def test_pii_takes_a_long_text_once(text):
    import time

    began = time.process_time()
    pii.spans_of(text)
    assert time.process_time() - began < 4  # a text of that length took minutes where a scan starts anew at each place


def test_pii_of_very_long_texts_and_nulls(spark):
    text = "word " * 300_000 + "jo(at)ex.com " + "filler " * 1000 + "+1 415 555 0199"
    rows = [(1, text), (None, None), (None, ""), (1, text)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    at = text.index("jo(at)")
    assert [r.spans for r in got if r.doc_id] == [f"email:{at}:{at + 12},phone:{len(text) - 15}:{len(text)}"] * 2 and got[0].redacted == text.replace("jo(at)ex.com", "<EMAIL>").replace("+1 415 555 0199", "<PHONE>")


def test_pii_disguises_and_clean_text(spark, docs):
    cases = {"jo.x (at) ex (dot) org": "email", "jane at ex dot org": "email", "ｊo@ехample.com": "email", "plus one five five five one two three four five six seven": "phone", "192.168.1.１": "ip"}
    for text, kind in cases.items():
        base, every = pii.spans_of(f"see {text} there")
        assert not base and [s[0] for s in every] == [kind] and f"see {text} there"[every[0][1] : every[0][2]] == text
    for text in ("meet me at example.com", "one two three and four", "x @ y . z", BASE):
        assert pii.spans_of(text) == ([], [])
    assert len(pii.find_pii(docs).collect()) == len(TEXTS) + 2
    assert pii.redact("a b@c.de f", [("email", 2, 8)]) == "a <EMAIL> f"


@pytest.mark.parametrize("sign", [a + b + w + b + z for a, z in ("()", "[]", "{}", "<>") for b in ("", " ") for w in ("at", "AT", "@")])
def test_pii_bracketed_at_signs(sign):
    for text in (f"jo{sign}ex.com", f"jo {sign} ex.com", f"jo{sign}ex[.]com", f"jo {sign} ex{{dot}}com"):
        for around in ("see {} there", "see {} in İzmir"):
            base, every = pii.spans_of(around.format(text))
            assert not base and every == [("email", 4, 4 + len(text))]


def test_pii_digits_spelled_in_part():
    cases = {"+1 four one five 555 0199": "phone", "+1 (four one five) 555-0199": "phone", "plus 1 415 555 01 nine nine": "phone", "4111 1111 1111 111 one": "card",
             "4111-1111-one one-11 1111": "card", "192.168.one.1": "ip", "one nine two.168.0.seven": "ip"}
    for text, kind in cases.items():
        base, every = pii.spans_of(f"see {text} there")
        assert not base and every == [(kind, 4, 4 + len(text))], text
    for text in ("call +1 415 555 0199 one of us will answer", "4111 1111 1111 1111 two times", "10.0.0.1 one", "oh two.x@ex.com and 5551234567, one"):
        base, every = pii.spans_of(text)
        assert base and every == base
    assert pii.spans_of("in 1999 one of 12 or two. one. 3 of 4, six") == ([], [])


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def brute_spans(text):
    """The contract's patterns as they stand there."""
    import re

    def luhn(digits):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (EMAIL, lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


NUMBERS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "411111111111111", "37828224631000 5", "+1 415 555 0199", "+44 (20) 7946.0958", "+12", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "a@b.c", "é ", " ", ".", "-", "+", "@", "x"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=st.sampled_from(list("ab1.@-+ %256()")), max_size=40), st.lists(st.sampled_from(NUMBERS), max_size=8).map("".join), st.text(alphabet=st.sampled_from(list("0123456789 -+")), max_size=45)))
def test_pii_base_matches_patterns(text):
    assert pii.detect(text) == brute_spans(text)


def test_pii_query_digests(spark):
    texts = [None, "", "call +1 415 555 0199 or a@b.co", "4111 1111 1111 1111 é 10.0.0.1", "jo (at) ex.com 5500-0000-0000-0004"]
    for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        base = brute_spans(texts[r.doc_id] or "")
        n = lambda kind: sum(k == kind for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(n, ("email", "ip", "card", "phone")))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(","))  or not base


def brute_quality(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs):
    for r in quality.quality(docs).collect():
        want = brute_quality(BASE if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.quality(empty(docs)).count() == 0


def test_quality_asks_stop_words_of_every_length(spark):
    prose_of = {
        "en": "The harbour was quiet in the morning and the boats lay by the wall, with nets that had been left on deck for days.",
        "de": "Der Hafen war am Morgen still und die Boote lagen an der Mauer, mit Netzen, die auf dem Deck nicht bewegt wurden, bis es dunkel war.",
        "fr": "Le port était calme et les bateaux dormaient dans la baie, pour une heure, avant que le vent ne se lève sur la mer et les quais.",
        "es": "El puerto estaba en calma por la mañana y los barcos dormían en la bahía, con las redes que se dejaron para el día siguiente.",
    }
    junk = {n: " ".join(f"q{i}x{i * i}" for i in range(n)) for n in (30, 120, 499, 500, 3000)}
    rows = [(t, True) for p in prose_of.values() for t in (p, p.upper())] + [(t, False) for t in junk.values()] + [(junk[n] + " the of and", False) for n in (120, 499)]
    got = quality.quality(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in got} == {i: (False, keep) for i, (_, keep) in enumerate(rows)}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    fine = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert sorted(kept.collect()) == sorted(r for r in docs.collect() if r.doc_id in fine)
    near = corpus_pipeline.near_duplicates(spark, kept, sf)
    rows = kept.orderBy("doc_id").collect()
    root = brute_components([r.text for r in rows], 5, 80, 100)[1]
    assert sorted(near.collect()) == [r for i, r in enumerate(rows) if root[i] == i]
    clean = corpus_pipeline.personal_data(spark, near, sf)
    want = {r.doc_id: pii.redact(r.text, pii.spans_of(r.text)[1]) for r in near.collect()}
    got = clean.collect()
    assert {r.doc_id: r.text for r in got} == want and any("<EMAIL>" in t for t in want.values()) and clean.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got if "<EMAIL>" in r.text)
    assert not any(brute_spans(r.text) for r in got)
    packed = corpus_pipeline.run(spark, sf).collect()
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert {(r.doc_id, r.start): r.length for r in packed} == {(i, k): min(4096, n - k) for i, t in want.items() for n in [len(lib.encode(t, add_special_tokens=False).ids) + 1] for k in range(0, n, 4096)}
    check_packed([r.sequence_id for r in packed], [r.offset for r in packed], [r.length for r in packed], 4096)


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls, repeated rows and ids, clashing extra columns, a very long text; and no rows."""
    good = "The harbour was quiet in the morning and the boats lay by the wall, with nets that had been left on deck for days, write to jo(at)ex.com."
    long = " ".join(f"the w{i}" for i in range(20_000))
    rows = [(1, good, "en", "a", len(good)), (1, good, "en", "a", len(good)), (2, good + " More", None, None, None), (None, good, "en", None, 1), (None, good, "en", None, 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, long, "en", "a", None), (6, good.upper() + " and now for something else that is quite unlike the others in it", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 7, True, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, _likely boolean, component_id string, _bucket int, n_words int")
    for frame in (docs, docs.where("false")):
        out = [frame]
        for _, stage in corpus_pipeline.STAGES:
            out.append(stage(spark, out[-1], "").cache())
            assert all(f.columns == list(corpus_pipeline.COLUMNS) for f in out[1:4])
        if frame is docs:
            assert sorted((r.doc_id or -1) for r in out[1].collect()) == [-1, -1, 1, 1, 2, 5, 6]
            assert sorted((r.doc_id or -1) for r in out[2].collect()) == [-1, -1, 1, 5, 6]  # equal rows of one id are one
            assert {r.text.count("<EMAIL>") for r in out[3].where("doc_id = 1 OR doc_id IS NULL").collect()} == {1}
            assert {(r.doc_id or -1) for r in out[4].collect()} == {-1, 1, 5, 6}
        else:
            assert out[-1].count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    import os

    import duckdb

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    got = queries.queries()[name](spark, data).select(*(c[0] for c in con.description))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
