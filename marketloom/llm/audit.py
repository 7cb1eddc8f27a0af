"""What each of several filters removes from a corpus, in every order in which they can be applied.

Copies are found by refining a partition of the rows: texts of one length in code points, then of one hash of
the first block, of the next, longer one, and so on; a part of one row is dropped as soon as it comes
about. Only what is left is compared by its full text. Everything else is counts of sets of failed
filters, as the outcome of an order follows from them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import Tables
from .common import BLANKS, likely
from .quality import let

#: Code points of the first block; each next block is that many times longer than the one before it.
BLOCK, LONGER = 64, 8
#: Filters by letter, in the order of their bits.
LETTERS = "ABCDE"


def starts(reach: int) -> list[int]:
    """Where blocks start, from 1, up to the first that starts past `reach` code points."""
    at, size, out = 1, BLOCK, []
    while at <= reach:
        out.append(at)
        at, size = at + size, size * LONGER
    return out


def refined(part: Column, text: Column, block: int) -> Column:
    """The part of a row, once block `block` of its text is known too; a text that ended before it stays in its part."""
    at = starts(10**12)[block]
    size = BLOCK * LONGER**block
    return F.when(F.length(text) >= at, F.xxhash64(part, F.substring(text, at, size))).otherwise(part)


def with_parts(df: DataFrame, text: Column, blocks: int) -> DataFrame:
    """df with part0, by the length, up to part{blocks}, by the length and the hashes of so many blocks."""
    df = df.withColumn("part0", F.xxhash64(F.length(text).cast("long")))
    for k in range(blocks):
        df = df.withColumn(f"part{k + 1}", refined(F.col(f"part{k}"), text, k))
    return df


def repeated(rows: DataFrame, part: str) -> DataFrame:
    """(part) of more than one row."""
    return rows.groupBy(part).agg(F.count("*").alias("_n")).where("_n > 1").select(part)


def copies(tables: Tables, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, …) without text, with boolean `copy`: whether any row with a smaller doc_id has the same text.

    A row without an id is no copy and makes none; rows that share an id and a text are none of each other.
    Texts are shuffled only where a part has several rows, and then once a task and text. Marks
    are found by (doc_id, part), of which no value is hot, however many copies a text has.
    """
    longest = docs.agg(F.max(F.length("text"))).first()[0] or 0
    blocks = len(starts(longest))
    rest = [c for c in docs.columns if c != "text"]
    rows = tables.save(with_parts(docs, F.col("text"), blocks).drop("text"), "parts")
    left = rows.where("doc_id IS NOT NULL").select(*(f"part{k}" for k in range(blocks + 1)))
    kept = []
    for k in range(blocks + 1):  # a round drops what stands alone by then; false hits of the map only stay a round longer
        left = tables.save(likely(left, f"part{k}", repeated(left, f"part{k}"), "_again").where("_again").drop("_again"), f"round{k}")
        kept.append(left)
    final = f"part{blocks}"
    parts = left.select(final).distinct()
    marked = likely(rows, final, parts, "_asked").withColumn("_asked", F.col("_asked") & F.col("doc_id").isNotNull())
    again = likely(with_parts(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), F.col("text"), blocks).select("doc_id", "text", final), final, parts, "_asked")
    first = again.where("_asked").groupBy(final, "text").agg(F.min("doc_id").alias("doc_id")).select(F.col("doc_id").alias("_id"), F.col(final).alias("_part")).distinct()
    asked = marked.where("_asked").join(first, (F.col("doc_id") == F.col("_id")) & (F.col(final) == F.col("_part")), "left").withColumn("copy", F.col("_id").isNull())
    out = marked.where("NOT _asked").withColumn("copy", F.lit(False)).select(*rest, "copy").unionByName(asked.select(*rest, "copy"))
    out = tables.save(out, "copies")
    tables.drop(rows, *kept)
    return out


def default_filters(text: Column) -> Column:
    """The bits of filters A to D that a text fails, A the lowest.

    A: under 200 words. B: fewer distinct words than half of them. C: over a fiftieth of its code points in A to Z. D: any of #$%&*|.
    """
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda failed, k: F.when(failed, 1 << k).otherwise(0)
    of_words = let(words, lambda w: bit(F.size(w) < 200, 0) + bit(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 1))
    return of_words + bit(100 * capitals > 2 * F.length(text), 2) + bit(text.rlike("[#$%&*|]"), 3)


def masks(tables: Tables, docs: DataFrame, labels: DataFrame, filters: Callable[[Column], Column] = default_filters, copy_bit: int = 4) -> DataFrame:
    """(part, mask, docs, good, toxic): rows of docs by source and by the set of filters that they fail.

    docs has doc_id, text and source, labels doc_id, quality and toxic; other columns are not read. A null
    text is empty and a null source the empty string. Where labels has an id several times, one that says
    so is enough. Rows without an id have no label.
    """
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = copies(tables, own.withColumn("bits", filters(F.col("text"))))
    rows = rows.withColumn("mask", F.col("bits") + F.when(F.col("copy"), 1 << copy_bit).otherwise(0))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    joined = rows.where("doc_id IS NOT NULL").join(told.withColumnRenamed("doc_id", "_of"), F.col("doc_id") == F.col("_of"), "left")
    every = joined.select("part", "mask", "_good", "_toxic").unionByName(rows.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("_good"), F.lit(False).alias("_toxic")))
    return every.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.count(F.when(F.col("_good"), 1)).alias("good"), F.count(F.when(F.col("_toxic"), 1)).alias("toxic"))


def orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (part, mask, docs, good, toxic).

    A part has a row for each step of each order of the filters, zeros included. What a step does hangs on its
    filter and on the set of those before it alone; such sums are taken once, and orders only look them up.
    """
    n = len(letters)
    every, share = len(list(permutations(letters))), F.array(*(F.lit(bin(m).count("1")) for m in range(1 << n)))
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("docs", "good", "toxic"))))
    wide = counts.groupBy("part").agg(held.alias("of"))
    total = lambda what, keep: F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(keep(m), F.coalesce(F.try_element_at("of", m)[what], F.lit(0))).otherwise(0))
    steps = [(f, before) for f in range(n) for before in range(1 << n) if not before >> f & 1]
    sets = wide.select("part", "of", F.explode(F.array(*(F.struct(F.lit(1 << f).alias("own"), F.lit(b).alias("earlier")) for f, b in steps))).alias("s")).select("part", "of", "s.own", "s.earlier")
    own, earlier = F.col("own"), F.col("earlier")
    fails, lost = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(earlier) != 0
    first = lambda m: fails(m) & ~lost(m)
    weight = F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(fails(m), F.coalesce(F.try_element_at("of", m)["docs"], F.lit(0)) * (F.lit(every) / F.element_at(share, m + 1)).cast("long")).otherwise(0))
    sums = sets.select(
        "part", "own", "earlier", total("docs", lambda m: ~fails(m) & ~lost(m)).alias("kept"), total("docs", first).alias("removed"), total("docs", lambda m: fails(m) & lost(m)).alias("redundant"),
        total("docs", lambda m: m == own).alias("unique_fails"), total("good", first).alias("good_lost"), total("toxic", first).alias("toxic_lost"), weight.alias("shapley"),
    )
    looked = [(F.lit("".join(letters[i] for i in p)).alias("filter_order"), F.lit(k + 1).alias("step"), 1 << p[k], sum(1 << i for i in p[:k])) for p in permutations(range(n)) for k in range(n)]
    by_set: dict[tuple[int, int], list] = {}
    for name, step, bit, before in looked:
        by_set.setdefault((bit, before), []).append(F.struct(name, step))
    places = F.create_map(*(x for (bit, before), v in by_set.items() for x in (F.lit(bit << n | before), F.array(*v))))
    out = sums.withColumn("p", F.explode(F.element_at(places, F.shiftleft("own", n) + F.col("earlier"))))
    return out.select("part", F.col("p.filter_order").alias("filter_order"), F.col("p.step").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over docs, by source, in all 120 orders; as `orders` returns it. Without documents there are no parts and no rows."""
    tables = Tables(spark)
    return orders(tables.save(masks(tables, docs, labels), "masks"))
