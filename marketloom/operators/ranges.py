"""One long series over many tasks: rows in ranges of their order, and what each range owes those before it.

A table is sorted into ranges and saved with its range and its place there. A number a range goes to the driver and
comes back as a constant, so that row numbers, running sums and tops, and the row before need no task that sees the series.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import Tables


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df, saved, with _range and _place, its place there from 0; rows are in order from range to range."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = own.select(*df.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    return Tables(df.sparkSession).save(placed, "ranges")


def of_range(values: dict[int, float | int | None], kind: str) -> Column:
    """A constant by range, NULL for what is not told."""
    told = [x for k, v in values.items() if v is not None for x in (F.lit(k).cast("long"), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*told), F.col("_range")) if told else F.lit(None).cast(kind)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with row_id from 0, without gaps, in the order of columns that tell its rows apart."""
    held = in_ranges(df, *order)
    counts = {r["_range"]: r["n"] for r in held.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    ranges = sorted(counts)
    before = dict(zip(ranges, accumulate([0, *(counts[k] for k in ranges)])))
    return held.select((F.col("_place") + of_range(before, "long")).alias("row_id"), *df.columns)


def moved(df: DataFrame, columns: dict[str, str], k: int) -> DataFrame:
    """df with columns {new: old} of the row k before, or -k after; NULL where there is none. row_id is dense."""
    other = df.select((F.col("row_id") + k).alias("_at"), *(F.col(old).alias(f"_{new}") for new, old in columns.items()))
    return df.join(other, F.col("row_id") == F.col("_at"), "left").drop("_at").withColumns({new: F.col(f"_{new}") for new in columns}).drop(*(f"_{new}" for new in columns))


def running(df: DataFrame, value: str) -> DataFrame:
    """df with `total`, the sum of value so far, and `top`, the largest total so far; NULL until a value is known. Rows are in the order of row_id."""
    held = in_ranges(df, "row_id")
    upto = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    within = held.withColumn("_sum", F.sum(value).over(upto))
    ends = within.groupBy("_range").agg(F.max_by("_sum", "_place").alias("sum"), F.max("_sum").alias("top")).orderBy("_range").collect()
    start, tops, total, top = {}, {}, None, None
    for r in ends:
        start[r["_range"]], tops[r["_range"]] = total, top
        if r["sum"] is not None:
            top = max(x for x in (top, (total or 0.0) + r["top"]) if x is not None)
            total = (total or 0.0) + r["sum"]
    before = of_range(start, "double")
    whole = F.when(F.col("_sum").isNotNull() | before.isNotNull(), F.coalesce("_sum", F.lit(0.0)) + F.coalesce(before, F.lit(0.0)))
    out = within.withColumn("total", whole)
    return out.withColumn("top", F.greatest(F.max("total").over(upto), of_range(tops, "double"))).select(*df.columns, "total", "top")


def change(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with name, the value less that of the row before by row_id; NULL on the first row, or where either is."""
    held = in_ranges(df, "row_id")
    ends = held.groupBy("_range").agg(F.max_by(value, "_place").alias("v")).orderBy("_range").collect()
    last = {b["_range"]: a["v"] for a, b in zip(ends, ends[1:])}
    inside = F.lag(value, 1).over(Window.partitionBy("_range").orderBy("_place"))
    before = F.when(F.col("_place") == 0, of_range(last, "double")).otherwise(inside)
    return held.select(*df.columns, (F.col(value) - before).alias(name))
