"""Frames over a series in constant work a row, and quantiles in the logarithm of the frame.

A series is cut into stretches of rows, and a stretch gets the rows before it that its widest frame reaches back
to, so that one long series is many tasks. row_id is dense within a series. Sums and extremes of a frame come from
two blocks as long as it is: from where it begins to the end of one, and from the start of the next to where
it ends. No sum is longer than that, which keeps it as exact as one of the frame itself.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a stretch; values of a part of a sorted list.
STRETCH, PART = 1 << 16, 512
EPS_Z, EPS_POS = 1e-9, 1e-12

Made = list[tuple[str, np.ndarray]]


def over_series(obs: DataFrame, by: tuple[str, ...], halo: int | None, make: Callable[[str, np.ndarray], Made]) -> DataFrame:
    """(by.., row_id, feature, value) with a row for each series that make(feature, values) gives, named by the feature and a suffix.

    values holds a stretch of the series and up to halo rows before it, NaN for NULL; make gives as many values.
    Without a halo, where a frame begins with the series, a series is one stretch.
    """
    keys = [F.col(c) for c in by]
    own = obs.select(*keys, "row_id", F.col("value").cast("double").alias("value"))
    if halo is None:
        dealt = own.withColumn("_part", F.lit(0).cast("long"))
    else:
        if halo >= STRETCH:
            raise ValueError(f"frames of more than {STRETCH} rows are not supported")
        at = F.floor(F.col("row_id") / STRETCH)
        dealt = own.withColumn("_part", F.explode(F.when(F.pmod("row_id", F.lit(STRETCH)) >= STRETCH - halo, F.array(at, at + 1)).otherwise(F.array(at))))
    dealt = dealt.withColumn("_key", F.xxhash64(*by, "_part"))
    dealt = dealt.repartition("_key").sortWithinPartitions("_key", *by, "_part", "row_id")
    schema = own.withColumn("feature", F.col("feature").cast("string")).select(*(c for c in by if c != "feature"), "row_id", "feature", "value").schema
    arrow = to_arrow_schema(schema)
    others = [c for c in by if c != "feature"]

    def finished(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(run)
        rows = whole.column("row_id").to_numpy()
        feature, part = whole.column("feature")[0].as_py(), whole.column("_part")[0].as_py()
        values = np.array(whole.column("value").to_numpy(zero_copy_only=False), dtype=float)
        kept = rows // STRETCH == part if halo is not None else np.ones(len(rows), dtype=bool)
        if not kept.any():
            return
        ids, n = pa.array(rows[kept]), int(kept.sum())
        fixed = [pa.repeat(whole.column(c)[0], n) for c in others]
        for suffix, v in make(feature, values):
            yield pa.RecordBatch.from_arrays([*fixed, ids, pa.repeat(None if feature is None else feature + suffix, n).cast(pa.string()), pa.array(v[kept], from_pandas=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for b in batches:
            key = b.column("_key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for start, end in zip(cuts, cuts[1:]):
                if end == start:
                    continue
                if open_ and open_[0].column("_key")[0].as_py() != int(key[start]):
                    yield from finished(open_)
                    open_ = []
                open_.append(b.slice(start, end - start))
        if open_:
            yield from finished(open_)

    return dealt.mapInArrow(run, schema)


def blocks(x: np.ndarray, w: int, fill: float) -> np.ndarray:
    """x in rows of w, filled up at its end."""
    return np.concatenate([x, np.full(-len(x) % w, fill)]).reshape(-1, w)


def extreme(x: np.ndarray, w: int, of: np.ufunc, none: float) -> np.ndarray:
    """The extreme of the w values up to each, from the w-th on; before that, none is counted in."""
    b = blocks(np.concatenate([np.full(w - 1, none), x]), w, none)
    from_start, to_end = of.accumulate(b, axis=1).ravel(), of.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(len(x))
    return of(to_end[at], from_start[at + w - 1])


def frames(x: np.ndarray, w: int) -> dict[str, np.ndarray]:
    """mean, std (sample), z and pos of the w values up to each; NaN unless all are there. A frame of one value has z and pos 0."""
    n = len(x)
    have = ~np.isnan(x)
    full = np.zeros(n, dtype=bool)
    seen = np.concatenate([[0], np.cumsum(have)])
    full[w - 1 :] = seen[w:] - seen[: max(0, n - w + 1)] == w
    low, high = (extreme(np.where(have, x, none), w, of, none) for of, none in ((np.minimum, np.inf), (np.maximum, -np.inf)))
    flat = low == high
    b = blocks(np.concatenate([np.zeros(w - 1), np.where(have, x, 0.0)]), w, 0.0)
    there = blocks(np.concatenate([np.zeros(w - 1), have]), w, 0.0)
    off = (b.sum(axis=1) / np.maximum(there.sum(axis=1), 1))[:, None]  # near the frame's mean, so that squares stay small
    start = np.arange(n)
    end, k, aligned = start + w - 1, start // w, start % w == 0
    total = []
    for power in (1, 2):
        head = np.cumsum(((b - off) * there)[:, ::-1] ** power, axis=1)[:, ::-1].ravel()
        tail = np.cumsum(((b[1:] - off[:-1]) * there[1:]) ** power, axis=1).ravel()
        rest = np.zeros(n)
        rest[~aligned] = tail[end[~aligned] - w]
        total.append(head[start] + rest)
    mean = np.where(flat, x, off.ravel()[k] + total[0] / w)
    with np.errstate(invalid="ignore", divide="ignore"):
        std = np.where(flat, 0.0, np.sqrt(np.maximum(total[1] - total[0] ** 2 / w, 0) / (w - 1))) if w > 1 else np.full(n, np.nan)
        out = {"mean": mean, "std": std, "z": (x - mean) / (std + EPS_Z), "pos": (x - low) / (high - low + EPS_POS)}
    return {name: np.where(full, v, np.nan) for name, v in out.items()}


def difference(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], x[1:] - x[:-1]])[: len(x)]


class Ordered:
    """Values in order, in parts of bounded length with a tree of their lengths: one comes, goes or is asked for by its rank without a look at the others."""

    def __init__(self) -> None:
        self.parts: list[list[float]] = []
        self.last: list[float] = []
        self.tree: list[int] = [0]
        self.size = 0

    def grow(self) -> None:
        """The tree anew, as parts have come or gone: node i holds the values of the parts from i less its lowest bit up to i."""
        self.tree = [0, *map(len, self.parts)]
        for i in range(1, len(self.tree)):
            if (above := i + (i & -i)) < len(self.tree):
                self.tree[above] += self.tree[i]

    def count(self, k: int, by: int) -> None:
        self.size += by
        i = k + 1
        while i < len(self.tree):
            self.tree[i] += by
            i += i & -i

    def part_of(self, v: float) -> int:
        return min(bisect_left(self.last, v), len(self.parts) - 1)

    def add(self, v: float) -> None:
        if not self.parts:
            self.parts, self.last, self.size = [[v]], [v], 1
            self.grow()
            return
        k = self.part_of(v)
        part = self.parts[k]
        insort(part, v)
        self.last[k] = part[-1]
        self.count(k, 1)
        if len(part) > 2 * PART:
            self.parts[k : k + 1] = [part[:PART], part[PART:]]
            self.last[k : k + 1] = [part[PART - 1], part[-1]]
            self.grow()

    def drop(self, v: float) -> None:
        k = self.part_of(v)
        part = self.parts[k]
        del part[bisect_left(part, v)]
        self.count(k, -1)
        if part:
            self.last[k] = part[-1]
        else:
            del self.parts[k], self.last[k]
            self.grow()

    def at(self, rank: int) -> float:
        k, step = 0, 1 << (len(self.tree) - 1).bit_length()
        while step := step >> 1:
            if k + step < len(self.tree) and self.tree[k + step] <= rank:
                k += step
                rank -= self.tree[k]
        return self.parts[k][rank]

    def quantile(self, q: float) -> float:
        """Interpolated between the two values around it; NaN without values."""
        if not self.size:
            return float("nan")
        place = (self.size - 1) * q
        low = int(place)
        below = self.at(low)
        return below if place == low else (low + 1 - place) * below + (place - low) * self.at(low + 1)


def earlier_quantiles(x: np.ndarray, w: int | None, qs: tuple[float, ...]) -> np.ndarray:
    """(row, quantile) of the w values before each, or of all of them; NaN counts for nothing."""
    held, out = Ordered(), np.empty((len(x), len(qs)))
    for i, v in enumerate(x.tolist()):
        out[i] = [held.quantile(q) for q in qs]
        if v == v:
            held.add(v)
        if w is not None and i >= w and (old := x[i - w]) == old:
            held.drop(float(old))
    return out


def winsorized(x: np.ndarray, w: int | None, q: float = 0.98) -> np.ndarray:
    """Each value clipped to the quantiles of the w before it, or of all; 0 where it is missing, as it is where none is before it."""
    low, high = earlier_quantiles(x, w, (1 - q, q)).T
    got = np.where(x < low, low, np.where(x > high, high, x))
    return np.where(np.isnan(got), 0.0, got)
