"""Grouped ties and the filter audit against brute force, on skewed and odd tables."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marketloom.llm import audit, queries, ranking
from marketloom.sources.tables import Tables

ROW = "g long, h long, a double, b long, c long, d string"


def brute(rows, most):
    last = lambda v, sign=1: (v is None, 0 if v is None else sign * v)
    out, of = [], {}
    for r in rows:
        of.setdefault(r[:2], []).append(r)
    for own in of.values():
        own.sort(key=lambda r: (last(r[2], -1), last(r[3]), last(r[4])))
        out += [(*r[:5], i + 1, i + 1, sum(x[2:4] == r[2:4] for x in own)) for i, r in enumerate(own[:most])]
    return sorted(out, key=repr)


def skewed(n, seed):
    rng = random.Random(seed)
    one = lambda *v: rng.choice(v)
    return [(one(None, 1, 1, 1, 1, rng.randrange(9)), one(None, 0, 0, 0, 1), one(None, 1.0, 2.0, 2.5), one(None, 1, 2, 3), one(None, rng.randrange(50)), "x") for _ in range(n)]


@pytest.mark.parametrize("n, most, parts, salts", [(0, 2, 3, 4), (1, 2, 1, 4), (900, 2, 13, 4), (900, 7, 40, 64), (300, 1000, 5, 3)])
def test_first_places(spark, n, most, parts, salts):
    rows = skewed(n, n + most)
    df = spark.createDataFrame(rows, ROW).repartition(parts)
    got = ranking.first_places(spark, df.withColumnRenamed("d", "tied"), ["g", "h"], ["a", "b"], ["c"], larger_first=("a",), most=most, salts=salts)
    assert got.columns == ["g", "h", "a", "b", "c", "pos", "place", "tied"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, most)


def test_places_of_a_group_over_many_ranges(spark):
    """One group in sixteen range partitions: every carry but the first counts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(0, 5000, 1, 20).select(F.lit(1).cast("long").alias("g"), (F.col("id") % 7).alias("a"), F.col("id").alias("c"))
        got = ranking.first_places(spark, df, ["g"], ["a"], ["c"], most=60, salts=20).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r) for r in got] == [(1, 0, 7 * i, i + 1, i + 1, 715) for i in range(60)]


def test_places_refuse_clashing_names(spark):
    df = spark.createDataFrame([], "g long, pos long, a long")
    with pytest.raises(ValueError, match="pos"):
        ranking.first_places(spark, df, ["g"], ["a"], ["pos"])
    with pytest.raises(ValueError):
        ranking.first_places(spark, df, ["g"], ["a"], ["a"])


def test_ties_query_on_odd_lines(spark, tmp_path):
    schema = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, tied string"
    rng, rows = random.Random(5), []
    for _ in range(500):
        rows.append((rng.choice([None, 3, rng.randrange(60)]), rng.choice([None, 1, 2]), rng.choice([None, 4, 9, 10]), rng.choice([None, 1, 1, 1, 2]), rng.choice([None, 5, 15, 25]), rng.choice([None, float("nan"), 2.455, 7.0]), rng.choice([None, 0.07, 0.005]), "x", None, "y"))
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sale_lines.parquet")
    shaped = []
    for sale, line, item, vendor, q, amount, d, *_ in rows:
        hot = sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0
        group = (-1, -1, -1) if hot else (vendor, -1 if item is None else item % 5, -1)
        whole = lambda x: None if x is None or x != x else int((100 * x + 0.5) // 1)
        shaped.append((group, (None if q is None else q // 10, whole(d)), (sale, line, q, whole(amount))))
    last = lambda v, sign=1: (v is None, 0 if v is None else sign * v)
    want = []
    for group in {s[0] for s in shaped}:
        own = sorted((s for s in shaped if s[0] == group), key=lambda s: (last(s[1][0], -1), last(s[1][1]), *map(last, s[2])))
        want += [(*group, i + 1, i + 1, *s[2][:3], s[1][1], s[2][3], sum(x[1] == s[1] for x in own)) for i, s in enumerate(own[:2])]
    got = queries.op13_grouped_ties(spark, str(tmp_path)).select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


LONG = "Very long text with more than one block. " * 300
TEXTS = [None, "", " ", "a", "b", "a", "ab", LONG, LONG, LONG + "x", LONG + "y", LONG[:-1] + "z", "x" + LONG[1:], "é" * 64, "é" * 63 + "e", "SHOUT " * 210, "w " * 250, *(f"{'p ' * 70}{i}" for i in range(30)), " ".join(f"w{i}" for i in range(205)), " ".join(f"w{i}" for i in range(200)) + " #", "𝒳" * 600 + "a", "𝒳" * 600 + "b", "𝒳" * 600 + "a"]


def corpus(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice([None, "", "s", "t"]), "mine") for i, t in enumerate(TEXTS * 3)]
    rows += [(None, LONG, "s", "m"), (None, "alone", "t", "m"), (7, LONG, "t", "m"), (7, "other", None, "m"), (3, "a", "s", "m"), (3, "a", "s", "m")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy string"), rows


def failed(rows):
    low = {}
    for i, t, *_ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        bits = (len(w) < 200) | (100 * len(set(w)) < 50 * len(w)) << 1 | (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) << 2 | any(c in "#$%&*|" for c in t) << 3
        out.append(bits | (i is not None and i > low[t]) << 4)
    return out


def test_copies_by_refinement(spark):
    docs, rows = corpus(spark)
    got = audit.copies(Tables(spark), docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("copy_of"))).collect()
    want = [(r[0], bool(f >> 4)) for r, f in zip(rows, failed(rows))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.copy)) for r in got)


def test_blocks_cover_every_text():
    for reach in (0, 1, 63, 64, 65, 575, 576, 577, 10**7):
        at = audit.starts(reach)
        assert len(at) == len([s for s in at if s <= reach]) and (not at or at[-1] - 1 + audit.BLOCK * audit.LONGER ** (len(at) - 1) >= reach)


def test_audit_against_brute_force(spark):
    docs, rows = corpus(spark)
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 120, 2)] + [(None, 1, 1), (4, 1, None), (4, 0, 0), (7, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(spark, docs, table).collect()}
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    bits, want = failed(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(b, r[0] in good, r[0] in toxic) for b, r in zip(bits, rows) if (r[2] or "") == part]
        shapley = dict.fromkeys(range(5), 0)
        for order in itertools.permutations(range(5)):
            seen = 0
            for step, f in enumerate(order):
                hit = [x for x in own if x[0] >> f & 1]
                first = [x for x in hit if not x[0] & seen]
                seen |= 1 << f
                shapley[f] += len(first)
                want[part, "".join("ABCDE"[i] for i in order), step + 1] = [sum(not x[0] & seen for x in own), len(first), len(hit) - len(first), sum(x[0] == 1 << f for x in hit), sum(x[1] for x in first), sum(x[2] for x in first), f]
        for (p, *_), v in want.items():
            if p == part:
                v[6] = shapley[v[6]]
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_an_empty_table(spark):
    docs, _ = corpus(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark, docs.where("false"), none).count() == 0
    assert audit.audit(spark, docs.where("doc_id IS NULL"), none).where("removed + redundant > 0 AND filter_order = 'EABCD' AND step = 1").count() == 0
