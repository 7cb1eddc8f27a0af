"""The component over all earlier rows, from sums of products that are kept and corrected as clip bounds move.

Days are dealt in parts. In a part most earlier values lie between all of its bounds, or beyond all of them on one
side, so that with the bounds left open their products can be summed up once. From part to part only rows that change
sides leave these sums and come back; rows that a bound passes within a part go to it whole. What a part is dealt thus
does not grow with the days before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import sliding
from ..sources.tables import Tables

#: Where a value lies in a part of days: between the bounds, below the lower ones, above the upper ones, or passed by one.
FREE, LOW, HIGH, PASSED = range(4)

#: Loadings closer than this part of the largest count as equal to it.
TIED = 1_000_000

Cuts = tuple[int, int, int, int]


def sides(place: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Where values lie, by their places in the order of all values and the places that the bounds of a part cut at."""
    a, b, c, d = cuts
    return np.where(place < a, LOW, np.where(place >= d, HIGH, np.where((place >= b) & (place < c), FREE, PASSED)))


def cuts_of(ordered: np.ndarray, low: np.ndarray, high: np.ndarray) -> Cuts:
    """Below the first place are values under all lower bounds, from the last on those over all upper ones, between the middle two those that no bound clips."""
    a = int(np.searchsorted(ordered, low.min(), "right"))
    d = max(a, int(np.searchsorted(ordered, high.max(), "left")))
    b = min(max(a, int(np.searchsorted(ordered, low.max(), "left"))), d)
    return a, b, min(max(b, int(np.searchsorted(ordered, high.min(), "right"))), d), d


def moves(x: np.ndarray, low: np.ndarray, high: np.ndarray, days: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, rows, sides) of the values before a part whose side is another than in the part before, or is new and not FREE.

    Only values between old and new cuts are looked at.
    """
    order = np.argsort(x, kind="stable")
    order = order[: len(x) - int(np.isnan(x).sum())]
    ordered, place = x[order], np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(order))
    old: Cuts | None = None
    for start in range(days, len(x), days):
        known = ~np.isnan(low[start : start + days])
        if not known.any():
            continue
        new = cuts_of(ordered, low[start : start + days][known], high[start : start + days][known])
        fresh = np.arange(start - days, start)
        fresh = fresh[~np.isnan(x[fresh])]
        at = place[fresh]
        at = at[sides(at, new) != FREE]
        if old is not None:
            between = np.unique(np.concatenate([np.arange(min(i, j), max(i, j)) for i, j in zip(old, new)]))
            between = between[order[between] < start - days]
            at = np.concatenate([at, between[sides(between, old) != sides(between, new)]])
        if len(at):
            yield start // days, order[at], sides(at, new)
        old = new


def bounds_and_moves(long: DataFrame, q: float, days: int) -> DataFrame:
    """(entity, row_id, col, low, high, part, side): a row with the bounds of each value, without part, and one for each move."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        x = pdf["value"].to_numpy(dtype=float)
        low, high = sliding.earlier_quantiles(x, None, (1 - q, q)).T
        out = [pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "low": low, "high": high})]
        out += [pd.DataFrame({"row_id": rows, "part": part, "side": side}) for part, rows, side in moves(x, low, high, days)]
        got = pd.concat([f.reindex(columns=["row_id", "low", "high", "part", "side"]) for f in out])
        return got.assign(entity=pdf["entity"].iloc[0], col=pdf["col"].iloc[0], part=got["part"].astype("Int64"), side=got["side"].astype("Int32"))

    return long.groupBy("entity", "col").applyInPandas(run, "entity string, row_id long, col int, low double, high double, part long, side int")


def dealt(rows: DataFrame, days: int) -> DataFrame:
    """(entity, part, sign, row_id, x, off, side, low, high): every row once in its own part and then as it enters (1) and leaves (-1) the sums.

    While a bound passes one of its values it goes to each part whole, with sign 0 as in its own part.
    """
    names = ["entity", "part", "sign", "row_id", "x", "off", "side", "low", "high"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                own, side = r.row_id // days, np.zeros(len(r.x), dtype=np.uint8)
                out.append((r.entity, own, 0, r.row_id, r.x, r.off, side.tobytes(), r.low, r.high))
                changed = list(zip(r.parts, r.cols, r.sides))
                starts = sorted({own + 1, *map(int, r.parts)})
                k = 0
                for start, end in zip(starts, [*starts[1:], r.top + 1]):
                    while k < len(changed) and changed[k][0] == start:
                        side[changed[k][1]] = changed[k][2]
                        k += 1
                    if (side == PASSED).any():
                        took = [(p, 0) for p in range(start, end)]
                    else:
                        took = [(p, sign) for p, sign in ((start, 1), (end, -1)) if p <= r.top]
                    out += [(r.entity, p, sign, r.row_id, r.x, r.off, side.tobytes(), None, None) for p, sign in took]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, "entity string, part long, sign int, row_id long, x array<double>, off array<double>, side binary, low array<double>, high array<double>")


def products(pdf: pd.DataFrame) -> pd.DataFrame:
    """A part's change of the sums: products of values with the bounds left open, as (free value, is low, is high, 1)."""
    pdf = pdf.sort_values(["row_id", "sign"])  # sums in one order give one result
    x, off = np.stack(pdf["x"].to_numpy()), pdf["off"].iloc[0]
    side = np.frombuffer(b"".join(pdf["side"]), dtype=np.uint8).reshape(x.shape)
    free = np.where(side == FREE, np.where(np.isnan(x), 0.0, x) - off, 0.0)
    u = np.hstack([free, side == LOW, side == HIGH, np.ones((len(x), 1))])
    got = u.T @ (u * pdf["sign"].to_numpy()[:, None])
    return pd.DataFrame({"entity": pdf["entity"].iloc[:1], "part": pdf["part"].iloc[:1], "g": [got.ravel()]})


def clipped(x: np.ndarray, low: np.ndarray, high: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Values within their bounds, 0 for what is missing, less off."""
    return np.where(np.isnan(x), 0.0, np.clip(x, low, high)) - off


def leading(cov: np.ndarray) -> np.ndarray:
    """The first component's loadings, the largest of them positive; of those as large but for a part in TIED the first.

    Columns that mirror each other load alike with opposite signs, and rounding would choose between them day by day.
    """
    load = np.linalg.eigh(cov)[1][:, -1]
    size = np.abs(load)
    return load * np.sign(load[np.argmax(size >= size.max() * (1 - 1 / TIED))])


def scored(held: pd.DataFrame, rows: pd.DataFrame, days: int, first: int, least: int) -> pd.DataFrame:
    """(entity, row_id, pc1) of a part's own rows, from the sums held before it and the rows that it got whole."""
    rows = rows.sort_values("row_id")
    own = rows["row_id"] // days == rows["part"]
    mine, off = rows[own], rows["off"].iloc[0]
    n, x = len(off), np.stack(mine["x"].to_numpy())
    whole = np.vstack([np.stack(rows[~own]["x"].to_numpy()), x]) if (~own).any() else x
    earlier = len(whole) - len(x)
    g = np.asarray(held["g"].iloc[0]).reshape(3 * n + 1, 3 * n + 1)
    out = np.full(len(x), np.nan)
    for k, (t, low, high) in enumerate(zip(mine["row_id"], mine["low"], mine["high"])):
        on = ~np.isnan(low)
        if t < first or on.sum() < least:
            continue
        a, b = (np.where(on, v - off, 0.0) for v in (low, high))
        filled = np.zeros((n + 1, 3 * n + 1))  # the bounds are filled in from both sides
        at = np.arange(n)
        filled[at, at], filled[at, n + at], filled[at, 2 * n + at], filled[n, 3 * n] = 1.0, a, b, 1.0
        total = filled @ g @ filled.T
        more = clipped(whole[: earlier + k], low, high, off)
        count, mean = total[n, n] + len(more), (total[n, :n] + more.sum(axis=0)) / (total[n, n] + len(more))
        cov = total[:n, :n] + more.T @ more - count * np.outer(mean, mean)
        out[k] = (clipped(x[k], low, high, off) - mean)[on] @ leading(cov[np.ix_(on, on)])
    return pd.DataFrame({"entity": mine["entity"], "row_id": mine["row_id"], "pc1": out})


def expanding_pc1(wide: DataFrame, columns: list[str], first: int, q: float, least: int, days: int) -> DataFrame:
    """(entity, row_id, pc1): each row's score on the component of all rows before it; NaN for the first rows and with too few columns.

    wide has (entity, row_id, columns..), row_id dense from 0 in an entity; rows without an entity have no score. A
    column's bounds are one task. Values count from a column's mean over the first rows, which keeps sums exact.
    """
    spark, n = wide.sparkSession, len(columns)
    tables, tasks = Tables(spark), 2 * spark.sparkContext.defaultParallelism
    values = F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns))
    rows = tables.save(wide.where("entity IS NOT NULL").select("entity", "row_id", values.alias("x")), "rows")
    long = rows.select("entity", "row_id", F.posexplode("x").alias("col", "value"))
    # The number of tasks is stated here and below, as small tables of costly days would be put together in one.
    made = tables.save(bounds_and_moves(long.repartition(tasks, "entity", "col"), q, days), "bounds")
    early = (F.avg(F.when((F.col("row_id") < max(first, 1)) & ~F.isnan(F.col("x")[i]), F.col("x")[i])) for i in range(n))
    entities = rows.groupBy("entity").agg(F.floor(F.max("row_id") / days).alias("top"), F.array(*(F.coalesce(e, F.lit(0.0)) for e in early)).alias("off"))
    moved = made.groupBy("entity", "row_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("part").isNull(), F.struct("col", "low", "high")))).alias("b"),
        F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "col", "side")))).alias("m"),
    )
    each = rows.join(moved, ["entity", "row_id"]).join(entities, "entity")
    each = each.select("entity", "row_id", "top", "x", "off", F.col("b.low"), F.col("b.high"), F.col("m.part").alias("parts"), F.col("m.col").alias("cols"), F.col("m.side").alias("sides"))
    parts = tables.save(dealt(each, days), "dealt")
    change = parts.repartition(tasks, "entity", "part").groupBy("entity", "part").applyInPandas(products, "entity string, part long, g array<double>")
    upto = Window.partitionBy("entity", "pos").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = change.select("entity", "part", F.posexplode("g").alias("pos", "v")).withColumn("v", F.sum("v").over(upto))
    held = sums.groupBy("entity", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "v")))["v"].alias("g"))
    held, whole = (df.repartition(tasks, "entity", "part").groupBy("entity", "part") for df in (held, parts.where("sign = 0")))
    return held.cogroup(whole).applyInPandas(lambda h, r: scored(h, r, days, first, least), "entity string, row_id long, pc1 double")
