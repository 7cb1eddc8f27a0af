"""What the training-data operators share: batches, saved tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.tables import Tables

#: The bytes that end a word: space, tab, newline, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"


def map_lists(df: DataFrame, fn: Callable[..., tuple], schema: str, rows: int = 256, per_task: bool = False) -> DataFrame:
    """mapInArrow where fn gets the columns of up to `rows` rows as lists and returns lists.

    per_task: fn() makes that function anew for each task, with what it keeps between batches.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn() if per_task else fn
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = each(*(c.to_pylist() for c in batch.slice(at, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(got, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def likely(df: DataFrame, column: str, keys: DataFrame, name: str, bits: int = 27) -> DataFrame:
    """df with a boolean: true for all rows whose column is in keys' only column, and for few others; false for a null.

    Spares an exact join's shuffle most rows. The bitmap that it broadcasts has 2 ** bits bits, 16 MB,
    whatever the input; where keys outgrow it, more rows pass, and the exact join that must follow
    still decides.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    key = keys.columns[0]
    own = keys.select(F.shiftright(slot(key), 15).alias("_bucket"), slot(key).bitwiseAND(F.lit(32767)).alias("_bit"))
    maps = own.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    placed = df.withColumn("_bucket", F.shiftright(slot(column), 15)).withColumn("_bit", slot(column).bitwiseAND(F.lit(32767)).cast("int"))
    met = placed.join(F.broadcast(maps), "_bucket", "left")
    hit = F.expr("shiftright(cast(conv(hex(substring(_map, _bit div 8 + 1, 1)), 16, 10) AS int), _bit % 8) & 1 = 1")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), (F.coalesce(hit, F.lit(False)) & F.col(f"`{column}`").isNotNull()).alias(name))


def likely_in(df: DataFrame, column: str, keys: DataFrame, bits: int = 27) -> DataFrame:
    """Rows of df whose column may be in keys' only column, as `likely` tells."""
    return likely(df, column, keys, "_likely", bits).where("_likely").select(*(F.col(f"`{c}`") for c in df.columns))


def components(tables: Tables, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """A saved table (node, root): the smallest node that each node of edges (u, v) reaches.

    Alternates the two star contractions of Kiveris et al. until the edges stay the same. Every
    round is a group minimum, which Spark sums up before it shuffles, and a join; nothing goes to the
    driver but a count and a check sum.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    down = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def star(e: DataFrame, keep: str) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        linked = e.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return linked.union(least.where("u <> m").select("u", F.col("m").alias("v")))

    now, before = tables.save(down(edges), "edges"), None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        large = down(star(both(now), "v > u"))
        nxt = tables.save(down(star(large, "true")), "edges")
        tables.drop(now)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = tables.save(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "roots")
    tables.drop(now)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


