"""Cases that once gave wrong results: special strings beside NUL, few effective dimensions, mixed layouts, prices as addresses."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from marketloom.llm import chat, neardup, packing, pii, warc
from marketloom.llm.common import vocabulary
from marketloom.sources import tables


def test_special_strings_beside_any_character():
    """Fifteen thousand texts of special strings, NULs and odd blanks, against the library."""
    path = vocabulary("word_bpe_49k.json")
    words, library = packing.Words(path), Tokenizer.from_file(path)
    specials = words.special
    rng = random.Random(8)
    bits = [*specials, *specials, "\0", "\0", "a", "b c", " ", "\n", " ", " ", "\x0b", "\x1c", "<|endof", "text|>", "It's", "9", "é", ",", "<", "|"]
    texts = ["a <|endoftext|> b\0c", *("".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(15_000))]
    got = words.encode(texts)
    for text, ids, e in zip(texts, got, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text)


@pytest.mark.parametrize(("length", "few"), [(768, 6), (768, 10), (768, 20), (1536, 10)])
def test_recall_where_vectors_have_few_effective_dimensions(length, few, monkeypatch):
    """Pairs at a cosine of 0.955 to 0.975 in a space of few dimensions, over two levels of cells."""
    rng = np.random.default_rng(few + length)
    base = np.linalg.qr(rng.normal(size=(length, few)))[0]
    n = 4000
    low = rng.normal(size=(n, few))
    low /= np.linalg.norm(low, axis=1, keepdims=True)
    turn = rng.normal(size=(n, few))
    turn -= (turn * low).sum(1, keepdims=True) * low
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cos = rng.uniform(0.955, 0.975, (n, 1))
    x = np.concatenate([low, cos * low + np.sqrt(1 - cos**2) * turn]) @ base.T
    x += 1e-3 * rng.normal(size=x.shape) / np.sqrt(length)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planted = {i for i in range(n) if x[i] @ x[n + i] >= 0.95}
    met = [(np.arange(2 * n), np.ones(2 * n, dtype=bool))]
    for _ in range(2):  # each level parts every cell of the last
        parted = []
        for rows, home in met:
            if home.sum() < 60:
                parted.append((rows, home))
                continue
            k = max(2, int(home.sum()) // 150)
            centres = neardup.fit_centres(x[rows[home]], k, 4)
            to: dict[int, list] = {}
            for at, cells, stays in neardup.places(x[rows], home, centres, neardup.dimensions_of(x[rows[home]], centres), neardup.REACH, 0.95):
                for a, c in zip(at, cells):
                    to.setdefault(int(c), []).append((rows[a], stays))
            parted += [(np.array([r for r, _ in v]), np.array([s for _, s in v])) for v in to.values()]
        met = parted
    found = set()
    for rows, home in met:
        at = dict(zip(rows.tolist(), home.tolist()))
        found |= {i for i in planted if i in at and n + i in at and (at[i] or at[n + i])}
    assert len(met) > 30 and len(found) >= 0.9 * len(planted)


def test_spread_is_the_number_of_even_dimensions():
    rng = np.random.default_rng(0)
    for few in (1, 5, 40):
        x = np.concatenate([rng.normal(size=(20_000, few)), np.zeros((20_000, 3))], axis=1)
        assert neardup.dimensions_of(x, np.zeros((1, few + 3))) == pytest.approx(few, rel=0.05)
    assert neardup.dimensions_of(np.ones((4, 3)), np.ones((1, 3))) == 1


def test_turn_rows_beside_other_layouts(spark):
    schema = "conv_id long, turn int, role string, text string, prompt string, response string, messages array<struct<role: string, content: string>>"
    rows = [(1, 0, "user", "hi", None, None, None), (1, 1, "assistant", "yo", None, None, None), (2, None, None, None, "q", "a", None), (3, None, None, None, "q", None, None),
            (4, None, None, None, None, None, [("user", None)]), (5, None, None, None, None, None, None), (6, 0, "user", "x", "q", None, None), (7, 0, None, None, None, None, None),
            (8, None, None, None, "q", "a", [("user", "m")]), (None, 3, "user", "alone", None, None, None), (2, 4, "user", "more", None, None, None)]
    got = sorted(((r.conv_id, r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, "turn rows", [("user", "hi"), ("assistant", "yo")]), (2, "prompt", [("user", "q"), ("assistant", "a")]), (3, "prompt", [("user", "q"), ("assistant", "")]), (4, "messages", [("user", "")]),
                          (5, None, []), (6, "unclear", []), (7, "turn rows", [("", "")]), (8, "unclear", []), (None, "turn rows", [("user", "alone")]), (2, "turn rows", [("user", "more")])], key=repr)
    one = chat.canonical_turns(spark.createDataFrame(rows, schema).drop("prompt", "response", "messages")).collect()
    assert {r.layout for r in one} == {"turn rows"}


@pytest.mark.parametrize("text", ["sold 10 @ 4.50 each", "3 apples @ 1.20", "price <at> 5.00 each", "arrive (at) 10.30 sharp", "v1 [at] 2.0", "see him at gate dot a lot", "he is at home dot dot dot",
                                  "meet me @ noon . Then we go", "look at line dot matrix printers", "he looked at it dot is", "sit at table . no more", "10 @ 4 . 50", "rows 1 dot 2 dot 3"])
def test_prose_and_prices_are_no_addresses(text):
    assert pii.spans_of(text) == ([], [])


@pytest.mark.parametrize(("text", "kind"), [("192[.]168[.]0[.]1", "ip"), ("192 dot 168 dot 0 dot 1", "ip"), ("one two seven dot zero dot zero dot one", "ip"), ("10(.)0(.)0(.)1", "ip"), ("jane @ ex . com", "email"),
                                            ("jane at example dot com", "email"), ("john.doe{at}example.com", "email"), ("john ( at ) example.com", "email"), ("jane at example dot co dot uk", "email"), ("jane(at)corp(dot)museum", "email"),
                                            ("four two four two - four two four two - four two four two - four two four two", "card")])
def test_disguises_are_found_in_their_place(text, kind):
    for before, after in (("", ""), ("see ", ", ok"), ("é𝒳 ", "\nnext")):
        assert pii.spans_of(before + text + after)[1] == [(kind, len(before), len(before) + len(text))]


def test_numbers_with_disguised_dots_in_long_texts():
    import time

    began = time.process_time()
    for text in ("1 dot " * 50_000, "1 " * 200_000 + "[.]", "one-" * 100_000 + " dot 2", "9" * 300_000 + "[.]1"):
        pii.spans_of(text)
    assert time.process_time() - began < 12


def test_archives_in_stores_that_spark_names_otherwise(spark, tmp_path, monkeypatch):
    assert [warc.library_uri(x) for x in ("s3a://b/x", "s3n://b/x", "s3://b/x", "hdfs://h:8020/x", "file:/x", "file:///x", "/x")] == ["s3://b/x", "s3://b/x", "s3://b/x", "hdfs://h:8020/x", "file:///x", "file:///x", "/x"]
    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file:{tmp_path}")
    got = warc.round_trip(spark, spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "v", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]
