"""Gradient-boosted regression trees on histograms of binned columns.

A tree is grown in rounds. A round needs the histograms of some nodes, sums and counts by column and bin, and
finds each one's best split; of two siblings the smaller is summed up and the other is the difference from their
parent. A node is looked into only once the best-first order, as far as it is known, splits its parent, so
that no more nodes are summed up than a tree of so many leaves can ask for.

`Trees.fit` does a round in one task, for fits whose rows are few. `boosted` does a round as one Spark
aggregation over the rows of all fits, wherever they are: only splits go to the driver and back. Both
find the same trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import Tables

#: Levels of a tree without a limit of its own; trees between two saves of what is left to explain.
DEEPEST, SAVED = 60, 16


class Split(NamedTuple):
    """Bins up to `bin` go left, and missing values where `missing_left` says so; n and total are of the node, left_* of its left part."""

    gain: float
    column: int
    bin: int
    missing_left: bool
    n: int
    total: float
    left_n: int
    left_total: float


class Tree(NamedTuple):
    """Nodes as arrays; a leaf has column -1 and a value."""

    column: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def values(self, codes: np.ndarray) -> np.ndarray:
        """Of each row the value of its leaf."""
        at = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes)) if self.column[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(rows):
            node = at[rows]
            code = codes[rows, self.column[node]]
            at[rows] = np.where(np.where(code == 0, self.missing_left[node], code <= self.bin[node]), self.left[node], self.right[node])
            rows = rows[self.column[at[rows]] >= 0]
        return self.value[at]


def in_bag(row_ids: np.ndarray, draw: int, share: float, seed: int) -> np.ndarray:
    """Whether each row is among the share of a draw, by a hash of its id, so that it is the same wherever the row is."""
    x = row_ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed * 1_000_003 + draw + 1)) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return (x ^ x >> np.uint64(31)) < np.uint64(min(share, 1.0) * (2**64 - 2**11))


@dataclass
class Trees:
    """Settings, and once fitted the cuts of each column, the base and the trees.

    Splits maximise the squared sum over the count, both penalised, of either part; missing values go where
    they gain more, left where it makes no difference. subsample acts only where subsample_freq is
    above 0, and is drawn anew each so many trees; colsample_bytree is drawn for each tree. used
    counts the splits by column.
    """

    n_estimators: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = -1
    min_child_samples: int = 20
    subsample: float = 1.0
    subsample_freq: int = 0
    colsample_bytree: float = 1.0
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    bins: int = 32
    seed: int = 42
    cuts: list[np.ndarray] = field(default_factory=list, repr=False)
    base: float = 0.0
    used: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    made: list[Tree] = field(default_factory=list, repr=False)

    def settings(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("cuts", "base", "used", "made")}

    def quantiles(self) -> list[float]:
        """Where columns are cut, at most: values of the column itself."""
        return [k / self.bins for k in range(1, self.bins)]

    def columns_of(self, tree: int, d: int) -> np.ndarray:
        """Whether each column may serve in a tree."""
        many = max(1, round(d * self.colsample_bytree))
        own = np.zeros(d, dtype=bool)
        own[np.random.default_rng([self.seed, tree]).permutation(d)[:many]] = True
        return own

    def bag(self, row_ids: np.ndarray, tree: int) -> np.ndarray:
        if self.subsample_freq <= 0 or self.subsample >= 1:
            return np.ones(len(row_ids), dtype=bool)
        return in_bag(row_ids, tree // self.subsample_freq, self.subsample, self.seed)

    def coded(self, x: np.ndarray) -> np.ndarray:
        """Bins of the columns, from 1; 0 is a missing value."""
        kind = np.uint8 if self.bins < 255 else np.uint16
        return np.stack([np.where(np.isnan(c), 0, np.searchsorted(cut, c, "left") + 1) for c, cut in zip(x.T, self.cuts)], axis=1).astype(kind) if self.cuts else np.zeros((len(x), 0), kind)

    def value(self, n: int, total: float) -> float:
        return float(np.sign(total) * max(abs(total) - self.lambda_l1, 0) / (n + self.lambda_l2)) if n else 0.0

    def worth(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(total) - self.lambda_l1, 0) ** 2 / np.maximum(n + self.lambda_l2, 1e-300)

    def best_splits(self, total: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> list[Split | None]:
        """Of nodes (node, column, bin from 0, the missing one) each one's best split, None without any gain."""
        least, bins = max(1, self.min_child_samples), total.shape[2] - 1
        zero = np.zeros_like(total[:, :, :1]), np.zeros_like(count[:, :, :1])
        parts = []
        for x, none in ((total, zero[0]), (count, zero[1])):
            upto = np.cumsum(x[:, :, 1:], axis=2)
            right = np.concatenate([none, upto[:, :, :-1]], axis=2)
            parts.append((np.stack([right + x[:, :, :1], right], axis=1), (x[:, :, 0] + (upto[:, :, -1] if bins else 0))[:, None, :, None]))
        (left, whole), (left_n, n) = parts
        ok = (left_n >= least) & (n - left_n >= least) & allowed[None, None, :, None]
        gain = np.where(ok, self.worth(left, left_n) + self.worth(whole - left, n - left_n) - self.worth(whole, n), -np.inf)
        out: list[Split | None] = []
        for k in range(len(total)):
            i = int(np.argmax(gain[k])) if gain[k].size else 0
            if not gain[k].size or not gain[k].flat[i] > 1e-12 * max(1.0, abs(float(whole[k, 0, 0, 0]))):
                out.append(None)
                continue
            side, j, b = np.unravel_index(i, gain[k].shape)
            out.append(Split(float(gain[k].flat[i]), int(j), int(b), side == 0, int(n[k, 0, j, 0]), float(whole[k, 0, j, 0]), int(left_n[k].flat[i]), float(left[k].flat[i])))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, row_ids: np.ndarray | None = None) -> "Trees":
        """Fitted to all rows, here and now."""
        ids = np.arange(len(x)) if row_ids is None else row_ids
        values = [np.sort(c[~np.isnan(c)]) for c in x.T]
        self.cuts = [np.unique(np.quantile(v, self.quantiles(), method="inverted_cdf")) if len(v) else np.zeros(0) for v in values]
        codes, d = self.coded(x), x.shape[1]
        self.base, self.made, self.used = float(y.mean()) if len(y) else 0.0, [], np.zeros(d)
        rest = y - self.base
        for t in range(self.n_estimators):
            own = self.bag(ids, t)
            grown = Growing(self, t, d)
            sums = Sums(codes[own], rest[own], self.bins + 1)
            while todo := grown.todo():
                grown.learn(sums.of(todo, grown))
            tree = grown.tree()
            self.made.append(tree)
            np.add.at(self.used, tree.column[tree.column >= 0], 1)
            if len(tree.column) == 1 and own.all() and tree.value[0] == 0 and not sums.splits_with_all(self):
                break  # no tree to come has a split, or changes what is left
            rest = rest - self.learning_rate * tree.values(codes)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self.coded(x)
        return self.base + self.learning_rate * sum((t.values(codes) for t in self.made), np.zeros(len(x)))


class Growing:
    """A tree that is being grown. The root is node 1, the children of node i are 2 i and 2 i + 1."""

    def __init__(self, model: Trees, number: int, d: int):
        self.model, self.allowed = model, model.columns_of(number, d)
        self.splits: dict[int, Split | None] = {}
        self.whole: tuple[int, float] = (0, 0.0)
        self.depth = model.max_depth if 0 < model.max_depth < DEEPEST else DEEPEST

    def order(self) -> list[int]:
        """Nodes that are split, best first, as far as it is known: what is still unknown can only leave fewer of them."""
        heap = [(-s.gain, 1)] if (s := self.splits.get(1)) else []
        out: list[int] = []
        while heap and len(out) + 1 < self.model.num_leaves:
            _, node = heapq.heappop(heap)
            out.append(node)
            for child in (2 * node, 2 * node + 1):
                if s := self.splits.get(child):
                    heapq.heappush(heap, (-s.gain, child))
        return out

    def facts(self, node: int) -> tuple[int, float]:
        """(rows, sum) of a node whose parent is known."""
        if node == 1:
            return self.whole
        s = self.splits[node // 2]
        return (s.n - s.left_n, s.total - s.left_total) if node % 2 else (s.left_n, s.left_total)

    def todo(self) -> list[int]:
        """Nodes to look into now: the root, or the children of nodes that are split."""
        if 1 not in self.splits:
            return [1]
        new = [c for node in self.order() for c in (2 * node, 2 * node + 1) if c not in self.splits]
        for c in new:  # too few rows, or too deep
            if self.facts(c)[0] < 2 * max(1, self.model.min_child_samples) or c.bit_length() > self.depth:
                self.splits[c] = None
        return [c for c in new if c not in self.splits]

    def learn(self, found: dict[int, Split | None]) -> None:
        self.splits.update(found)

    def summed(self, todo: list[int]) -> list[int]:
        """The nodes to sum up for those of todo: of siblings the one with fewer rows."""
        if todo == [1]:
            return [1]
        return [min((2 * p, 2 * p + 1), key=lambda c: (self.facts(c)[0], c)) for p in sorted({c // 2 for c in todo})]

    def route(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Nodes of rows that are at nodes `at`, one level further down where the node is split."""
        for node in np.unique(at).tolist():
            if s := self.splits.get(node):
                rows = np.flatnonzero(at == node)
                code = codes[rows, s.column]
                at[rows] = 2 * node + np.where(np.where(code == 0, s.missing_left, code <= s.bin), 0, 1)
        return at

    def tree(self) -> Tree:
        split = self.order()
        place = {1: 0}
        for node in split:
            place[2 * node], place[2 * node + 1] = len(place), len(place) + 1
        rows = []
        for node in place:
            s = self.splits.get(node) if node in set(split) else None
            rows.append((s.column, s.bin, s.missing_left, place[2 * node], place[2 * node + 1], 0.0) if s else (-1, 0, False, 0, 0, self.model.value(*self.facts(node))))
        kinds = (np.int32, np.int32, bool, np.int32, np.int32, float)
        return Tree(*(np.array(c, dtype=k) for c, k in zip(zip(*rows), kinds)))


class Sums:
    """Histograms of rows that are all here."""

    def __init__(self, codes: np.ndarray, rest: np.ndarray, width: int):
        self.codes, self.rest, self.width = codes, rest, width
        self.at = np.ones(len(codes), dtype=np.int64)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, todo: list[int], grown: Growing) -> dict[int, Split | None]:
        self.at = self.at if todo == [1] else self.moved(todo, grown)
        direct = grown.summed(todo)
        d = self.codes.shape[1]
        for node, *both in zip(direct, *histograms(self.codes, self.rest, self.at, direct, self.width)):
            self.known[node] = tuple(both)
        if todo == [1]:
            grown.whole = len(self.codes), float(self.rest.sum())
        else:
            for node in direct:
                (total, count), (own, n) = self.known[node // 2], self.known[node]
                left = count - n
                self.known[node ^ 1] = np.where(left > 0, total - own, 0.0), left
        stacked = [np.stack([self.known[c][k] for c in todo]) if d else np.zeros((len(todo), 0, self.width)) for k in (0, 1)]
        return dict(zip(todo, grown.model.best_splits(*stacked, grown.allowed)))

    def splits_with_all(self, model: Trees) -> bool:
        """Whether the root has a split once all columns may serve."""
        total, count = self.known[1]
        return model.best_splits(total[None], count[None], np.ones(len(total), dtype=bool))[0] is not None

    def moved(self, todo: list[int], grown: Growing) -> np.ndarray:
        rows = np.flatnonzero(among(self.at, sorted({c // 2 for c in todo})))
        self.at[rows] = grown.route(self.codes[rows], self.at[rows])
        return self.at


def among(at: np.ndarray, nodes: list[int] | np.ndarray) -> np.ndarray:
    """Whether each row is at one of nodes, which are sorted."""
    nodes = np.asarray(nodes)
    return nodes[np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)] == at


def histograms(codes: np.ndarray, rest: np.ndarray, at: np.ndarray, nodes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, column, bin) sums and counts of the rows that are at nodes."""
    order = np.array(sorted(nodes))
    rows = np.flatnonzero(among(at, order)) if nodes != [1] else np.arange(len(at))
    d = codes.shape[1]
    cell = (np.searchsorted(order, at[rows])[:, None] * d + np.arange(d)) * width + codes[rows]
    shape = len(order), d, width
    total = np.bincount(cell.ravel(), np.repeat(rest[rows], d), int(np.prod(shape))).reshape(shape)
    count = np.bincount(cell.ravel(), minlength=int(np.prod(shape))).reshape(shape)
    by = np.searchsorted(order, nodes)
    return total[by], count[by]


def cut_table(rows: DataFrame, bins: dict[int, int]) -> dict[int, dict[int, np.ndarray]]:
    """The cuts of each fit and column: values at equal shares of the rows, by a sketch of all of them."""
    most = max(bins.values())
    each = rows.select("fit", F.posexplode("x").alias("column", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    out: dict[int, dict[int, np.ndarray]] = {}
    for many in sorted(set(bins.values())):
        own = each.where(F.col("fit").isin([f for f, b in bins.items() if b == many]))
        found = own.groupBy("fit", "column").agg(F.percentile_approx("v", [k / many for k in range(1, many)], 100 * max(most, 100)).alias("cuts"))
        for r in found.collect():
            out.setdefault(r.fit, {})[r.column] = np.unique(r.cuts)
    return out


def boosted(spark: SparkSession, rows: DataFrame, models: dict[int, Trees], d: int) -> dict[int, Trees]:
    """Each fit's model, fitted to its rows of (fit, row_id, x array of d doubles, y); all fits grow together.

    A round of all trees that are being grown is one aggregation, whose tasks add up the rows they hold
    before anything is shuffled. To the driver go cuts and splits, whose number hangs on fits, columns and leaves
    and not on rows. What trees leave to explain is saved each SAVED trees and worked out from there, so that a
    lost executor costs its share of one round. A row without x or y is left out.
    """
    tables = Tables(spark)
    rows = tables.save(rows.where("x IS NOT NULL AND y IS NOT NULL"), "rows")
    means = {r.fit: r.base for r in rows.groupBy("fit").agg(F.avg("y").alias("base")).collect()}
    cuts = cut_table(rows, {f: m.bins for f, m in models.items()})
    out = {}
    for f, m in models.items():
        own = cuts.get(f, {})
        out[f] = replace(m, cuts=[own.get(c, np.zeros(0)) for c in range(d)], base=means.get(f, 0.0), made=[], used=np.zeros(d))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = b.column("fit").to_numpy()
            x = np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], dtype=float).reshape(-1, d)
            y, codes = b.column("y").to_numpy(), [b""] * len(fits)
            base = np.zeros(len(fits))
            for f in np.unique(fits).tolist():
                at = np.flatnonzero(fits == f)
                for i, c in zip(at, out[f].coded(x[at]).astype("<u2")):
                    codes[i] = c.tobytes()
                base[at] = out[f].base
            yield pa.RecordBatch.from_arrays([b.column("fit"), b.column("row_id"), pa.array(codes, pa.binary()), pa.array(y - base)], names=["fit", "row_id", "codes", "rest"])

    kinds = "fit int, row_id long, codes binary, rest double"
    state = tables.save(rows.select(F.col("fit").cast("int").alias("fit"), F.col("row_id").cast("long").alias("row_id"), "x", F.col("y").cast("double").alias("y")).mapInArrow(code, kinds), "coded")
    tables.drop(rows)
    done = {f: False for f in models}
    since: dict[int, list[Tree]] = {f: [] for f in models}
    plain = {f: replace(m, cuts=[], made=[]) for f, m in out.items()}  # what tasks need to know
    for t in range(max((m.n_estimators for m in models.values()), default=0)):
        growing = {f: Growing(m, t, d) for f, m in plain.items() if t < m.n_estimators and not done[f] and f in means}
        if not growing:
            break
        saved: list[DataFrame] = []
        while todo := {f: own for f, g in growing.items() if (own := g.todo())}:
            saved.append(tables.save(level(state, saved, plain, growing, since, todo, t, d), "level"))
            learnt = saved[-1].groupBy("fit", "node").applyInPandas(chooser(plain, growing, d), CHOSEN).collect()
            for r in learnt:
                growing[r.fit].splits[r.node] = Split(r.gain, r.column, r.bin, r.missing_left, r.n, r.total, r.left_n, r.left_total) if r.gain is not None else None
                if r.node == 1:
                    growing[r.fit].whole = r.n, r.total
            for f, nodes in todo.items():  # no row of the bag came there
                for node in nodes:
                    growing[f].splits.setdefault(node, None)
        tables.drop(*saved)
        for f, g in growing.items():
            tree = g.tree()
            out[f].made.append(tree)
            since[f].append(tree)
            np.add.at(out[f].used, tree.column[tree.column >= 0], 1)
            done[f] = len(tree.column) == 1 and out[f].colsample_bytree >= 1 and (out[f].subsample_freq <= 0 or out[f].subsample >= 1)
        if (t + 1) % SAVED == 0:
            before, state = state, tables.save(state.mapInArrow(left_over(plain, since, d), kinds), "rest")
            tables.drop(before)
            since = {f: [] for f in models}
    tables.drop(state)
    return out


def unpacked(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return b.column("fit").to_numpy(), b.column("row_id").to_numpy(), np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype="<u2").reshape(-1, d), np.array(b.column("rest").to_numpy())


def explained(f: int, codes: np.ndarray, rest: np.ndarray, models: dict[int, Trees], since: dict[int, list[Tree]]) -> np.ndarray:
    for tree in since[f]:
        rest = rest - models[f].learning_rate * tree.values(codes)
    return rest


def left_over(models: dict[int, Trees], since: dict[int, list[Tree]], d: int):
    """A map over the coded rows that takes off what the trees since the last save explain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits, _, codes, rest = unpacked(b, d)
            for f in np.unique(fits).tolist():
                at = np.flatnonzero(fits == f)
                rest[at] = explained(f, codes[at], rest[at], models, since)
            yield pa.RecordBatch.from_arrays([b.column("fit"), b.column("row_id"), b.column("codes"), pa.array(rest)], names=["fit", "row_id", "codes", "rest"])

    return run


def level(state: DataFrame, saved: list[DataFrame], models: dict[int, Trees], growing: dict[int, Growing], since: dict[int, list[Tree]], todo: dict[int, list[int]], number: int, d: int) -> DataFrame:
    """(fit, node, cell, s, n): histograms of the nodes to do and of their siblings; a cell is column times width plus bin."""
    direct = {f: growing[f].summed(nodes) for f, nodes in todo.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            fits, ids, codes, rest = unpacked(b, d)
            for f in np.unique(fits).tolist():
                if f not in direct:
                    continue
                at = np.flatnonzero(fits == f)
                at = at[models[f].bag(ids[at], number)]
                own, grown = codes[at], growing[f]
                node = np.ones(len(at), dtype=np.int64)
                for _ in range(max(x.bit_length() for x in direct[f]) - 1):
                    node = grown.route(own, node)
                got = histograms(own, explained(f, own, rest[at], models, since), node, direct[f], models[f].bins + 1)
                sums[f] = [a + g for a, g in zip(sums[f], got)] if f in sums else list(got)
        for f, (total, count) in sums.items():
            k, cell = np.nonzero(count.reshape(len(count), -1))
            yield pa.RecordBatch.from_pydict({"fit": pa.array(np.full(len(k), f, dtype=np.int32)), "node": pa.array(np.array(direct[f], dtype=np.int64)[k]), "cell": pa.array(cell.astype(np.int32)), "s": pa.array(total.reshape(len(count), -1)[k, cell]), "n": pa.array(count.reshape(len(count), -1)[k, cell].astype(np.int64))})

    own = state.mapInArrow(add, "fit int, node long, cell int, s double, n long").groupBy("fit", "node", "cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    if not saved:
        return own
    parents = state.sparkSession.createDataFrame([(f, c // 2, c ^ 1) for f, nodes in direct.items() for c in nodes], "fit int, node long, other long")
    before = saved[0]
    for x in saved[1:]:
        before = before.union(x)
    above = before.join(F.broadcast(parents), ["fit", "node"]).select("fit", F.col("other").alias("node"), "cell", "s", "n")
    less = own.select("fit", F.col("node").bitwiseXOR(F.lit(1)).alias("node"), "cell", -F.col("s"), -F.col("n"))
    return own.union(above.union(less).groupBy("fit", "node", "cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0"))


CHOSEN = "fit int, node long, gain double, column int, bin int, missing_left boolean, n long, total double, left_n long, left_total double"


def chooser(models: dict[int, Trees], growing: dict[int, Growing], d: int):
    """A map over the histogram of one node that gives its best split; without one all but its rows and sum is NULL."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        f, node = int(cells["fit"].iloc[0]), int(cells["node"].iloc[0])
        width = models[f].bins + 1
        total, count = np.zeros(d * width), np.zeros(d * width, dtype=np.int64)
        total[cells["cell"]], count[cells["cell"]] = cells["s"], cells["n"]
        total, count = total.reshape(1, d, width), count.reshape(1, d, width)
        s = models[f].best_splits(total, count, growing[f].allowed)[0]
        row = (f, node, *s) if s else (f, node, None, None, None, None, int(count[0, 0].sum()), float(total[0, 0].sum()), None, None)
        return pd.DataFrame([row], columns=[c.split()[0] for c in CHOSEN.split(", ")]).astype({"column": "Int32", "bin": "Int32", "left_n": "Int64", "missing_left": "boolean"})

    return run
