"""The first places of every group, with the number of rows that tie with each, however large a group is.

A group's rows are dealt to salted subgroups, and a subgroup keeps its own first places: a row that is not
among the first of its subgroup cannot be among those of the group. What is left is sorted by group and
order over range partitions, where a row's position is its place in the partition plus what earlier
partitions hold of the group. Ties come from counts of (group, pair, salt) that are pruned alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import Tables

#: Subgroups that a group is dealt to. Rows of one task go to one of them, so that a task sends no more than `most` rows of a group.
SALTS = 64
#: What the operator adds; columns to be returned may not have these names.
ADDED = ("pos", "place", "tied")


def ordering(names: list[str], larger_first: tuple[str, ...] = ()) -> list[Column]:
    """Ascending, or descending for those named in larger_first; nulls last and equal to each other."""
    return [F.col(n).desc_nulls_last() if n in larger_first else F.col(n).asc_nulls_last() for n in names]


def looked_up(df: DataFrame, by: DataFrame, names: list[str]) -> DataFrame:
    """df with the other columns of `by`, of the row that is equal in all of names, null to null."""
    other = by.withColumnsRenamed({n: f"_of_{n}" for n in names})
    return df.join(other, reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names))).drop(*(f"_of_{n}" for n in names))


def first_places(spark: SparkSession, df: DataFrame, groups: list[str], pair: list[str], then: list[str], larger_first: tuple[str, ...] = (), most: int = 2, salts: int = SALTS) -> DataFrame:
    """(groups, pair, then, pos, place, tied) of the rows of each group with place at most `most`.

    Rows are ordered by pair and then by `then`, ascending but for larger_first, nulls last. pos counts
    from 1, equal rows separately, and place is pos; tied counts the rows of the group with the row's
    pair, returned or not. Null is a group, and a pair, of its own. Rows that are equal in all of `then` are
    told apart by nothing that is returned. Other columns are not read; an empty table gives no rows.
    """
    names = [*groups, *pair, *then]
    if len(set(names)) < len(names) or set(names) & set(ADDED):
        raise ValueError(f"columns must differ from each other and from {', '.join(ADDED)}: {names}")
    tables = Tables(spark)
    order = ordering([*pair, *then], larger_first)
    dealt = df.select(*(F.col(f"`{n}`") for n in names), (F.spark_partition_id() % salts).alias("_salt"))

    local = Window.partitionBy(*groups, "_salt").orderBy(*order)
    left = dealt.withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= most).select(*names)
    in_range = left.repartitionByRange(*ordering(groups), *order).sortWithinPartitions(*ordering(groups), *order)
    numbered = in_range.withColumn("_id", F.monotonically_increasing_id())
    held = tables.save(numbered.select(*names, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "survivors")

    spans = held.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carry", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    placed = looked_up(held, carried, [*groups, "_part"]).select(*names, (F.col("_at") - F.col("_first") + F.col("_carry") + 1).alias("pos"))

    counts = dealt.groupBy(*groups, *pair, "_salt").agg(F.count("*").alias("_rows"))
    # At most `most` - 1 rows come before a row that is returned, and so at most as many pairs: it is among the first of any subgroup.
    best = Window.partitionBy(*groups, "_salt").orderBy(*ordering(pair, larger_first))
    pruned = counts.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    ties = pruned.groupBy(*groups, *pair).agg(F.sum("_rows").alias("tied"))
    return looked_up(placed.where(F.col("pos") <= most), ties, [*groups, *pair]).select(*names, "pos", F.col("pos").alias("place"), "tied")
