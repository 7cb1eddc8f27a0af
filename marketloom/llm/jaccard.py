"""N-gram Jaccard join in the metric space of shingle sets, where 1 - J is a distance.

Between unlike texts that distance is 1, so that pivots picked anywhere would put every text into every
window. The join therefore looks for pivots close by:

1. Equal sets are one point.
2. Cells. Shingles fall into classes by their hash. Sets within the distance differ in few shingles, so
   that some class holds the same shingles in both: those of a class are a cell, and a point lies in
   as many cells as it may differ in shingles, and one more. Cells of the fewest shingles are left out.
   An empty class is no cell, as unlike texts share it: its points are dealt into classes anew.
3. Pivots. A cell's smallest point is its pivot; the points of a pivot's cells are its region. Exact
   distances to the pivots link points, and components of links come from them.
4. Windows. Linked points' distances to a pivot differ by r at most, so that a region falls into rings
   of width 2 r that overlap by r. A ring all of one component is done. In a larger one further pivots
   are drawn: each point lives with its nearest one and is replicated where the triangle inequality
   allows a partner on the other side, d(x, q) <= d(x, home) + 2 r. The regions so made are joined the
   same way while that makes them smaller. Then all their pairs are worked out, a pair of blocks a task.

No step gives out all pairs of a region; what leaves a task is links enough to connect it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Tables, components, likely_in, map_lists

#: Points and shingles of a block that one task joins, pivots drawn in a larger region, and rounds of drawing.
SMALL, WEIGHT, PIVOTS, ROUNDS = 800, 1 << 21, 8, 3
#: Words whose hashes a worker remembers before it forgets them all.
KNOWN = 250_000
M = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> M(30))) * M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> M(27))) * M(0x94D049BB133111EB)
    return x ^ (x >> M(31))


@dataclass(frozen=True)
class Join:
    """Shingles of `words` words; sets link where their Jaccard similarity is at least top / bottom."""

    words: int = 3
    top: int = 90
    bottom: int = 100

    def links(self, both: np.ndarray, either: np.ndarray) -> np.ndarray:
        return self.bottom * both >= self.top * either

    def apart(self, n: int) -> int:
        """Shingles at most in which a linked set differs from one of n."""
        return n * (self.bottom - self.top) // self.top

    def classes(self, n: int) -> list[int]:
        """Numbers of classes that a set of n uses: that of its range of sizes, and of the next where a linked set may lie there.

        Ranges end at powers of two. A range's number suits its largest sets with a fifth to spare, so
        that the cells of the fewest shingles can be left out.
        """
        low, high = n.bit_length(), (n * self.bottom // self.top).bit_length()
        return [self.apart((1 << b) - 1) * 6 // 5 + 1 for b in range(low, high + 1)]


_hashes: dict[bytes, int] = {}


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of all its words as one where they are fewer."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(_hashes) > KNOWN:
        _hashes.clear()
    for x in {x for x in w if x not in _hashes}:
        _hashes[x] = xxhash.xxh64_intdigest(x)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * M(0x9E3779B97F4A7C15) + h[i : len(w) - k + 1 + i])
    return np.unique(out)


def cells(s: np.ndarray, join: Join) -> list[int]:
    """Cells of a set: for each number of classes, the fullest apart(n) + 1 classes' contents, hashed.

    Linked sets share all but apart(n) of their classes. Both leave out the same way, least first, so
    that one of the classes shared is kept by both. If that one is empty, it is in both, and the classes
    that its number deals both sets into anew hold a shared one in the same way.
    """
    out: set[int] = set()
    for many in join.classes(len(s)):
        seeds = [M(0)]
        while seeds:
            seed = seeds.pop()
            cls = ((mix(s + seed) if seed else s) % M(many)).astype(np.int64)
            sizes = np.bincount(cls, minlength=many)
            sums = np.zeros(many, np.uint64)
            np.add.at(sums, cls, mix(s))
            keys = mix(sums + mix(np.arange(many).astype(np.uint64) * M(0x9E3779B97F4A7C15) + M(many) + seed))
            kept = np.lexsort((keys, sizes))[-(join.apart(len(s)) + 1) :]
            out.update(keys[kept[sizes[kept] > 0]].view(np.int64).tolist())
            seeds += list(keys[kept[sizes[kept] == 0]])
    return sorted(out)


def overlaps(sets: list[np.ndarray], slice_of: int = 8192) -> np.ndarray:
    """Shingles that each two sets share, from products of a slice of the shingles at a time; one that a single set holds is in no product."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    kept = often[at]
    owner, at = owner[kept], (np.cumsum(often) - 1)[at[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    many = int(often.sum())
    ends = np.searchsorted(at, np.arange(0, many + slice_of, slice_of))
    for i, lo in enumerate(range(0, many, slice_of)):
        here = slice(ends[i], ends[i + 1])
        part = np.zeros((len(sets), min(slice_of, many - lo)), dtype=np.float32)
        part[owner[here], at[here] - lo] = 1
        both += part @ part.T
    return both.astype(np.int64)


def join_block(block: pd.DataFrame, join: Join) -> pd.DataFrame:
    """Edges that connect what a block's pairs link. Of a pair of blocks, pairs within either are left to others."""
    block = block.drop_duplicates("id").sort_values("id")
    ids, side = block["id"].to_numpy(), block["side"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in block["set"]]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.arange(len(ids))
    both = overlaps(sets)
    linked = join.links(both, size[:, None] + size[None, :] - both)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(1))
        if (least == label).all():
            break
        label = least[least]
    far = label != np.arange(len(ids))
    return pd.DataFrame({"u": ids[far], "v": ids[label[far]]})


class Regions:
    """The join's tables: points with their sets, links found so far, and regions still to be joined."""

    def __init__(self, spark: SparkSession, join: Join):
        self.spark, self.join, self.tables = spark, join, Tables(spark)

    def measured(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pairs (x, p, ...) beside the sizes of their sets' intersection and union."""
        names = [c for c in pairs.columns]
        both = pairs.join(sets.select(F.col("id").alias("x"), F.col("set").alias("sx")), "x").join(sets.select(F.col("id").alias("p"), F.col("set").alias("sp")), "p")

        def count(*cols: list) -> tuple:
            *own, sx, sp = cols
            inner = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(sx, sp)]
            return *own, inner, [(len(a) + len(b)) // 8 - n for a, b, n in zip(sx, sp, inner)]

        kinds = ", ".join(f"{c} long" for c in names)
        return map_lists(both.select(*names, "sx", "sp"), count, f"{kinds}, inner long, either long")

    def linked(self) -> F.Column:
        return F.col("inner") * self.join.bottom >= F.col("either") * self.join.top

    def open_regions(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members (region, id) of regions of more than one component, beside their number.

        Two points of which one is the region's pivot have met. In a ring that lacks it, two have not.
        """
        own = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("region", "id", "pivot", F.coalesce("root", "id").alias("root"))
        size = own.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.max("pivot").alias("met")).where("low <> high AND (n > 2 OR NOT met)")
        return own.join(size.select("region", "n"), "region").select("region", "id", "n")

    def small(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Edges within regions that one task joins, or pairs of blocks of larger ones, of SMALL points or WEIGHT shingles on average at most."""
        join = self.join
        weight = members.join(sets.select("id", "size"), "id").groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
        blocks = weight.select("region", F.greatest(F.ceil(F.col("n") / SMALL), F.ceil(F.col("w") / WEIGHT)).cast("long").alias("blocks"))

        def deal(regions: list, ids: list, blocks: list, raw: list) -> tuple:
            out: list[list] = [[] for _ in range(6)]
            for g, i, many, s in zip(regions, ids, blocks, raw):
                own = xxhash.xxh32_intdigest(str(i)) % many
                for other in range(many):
                    for col, y in zip(out, (g, min(own, other), max(own, other), own, i, s)):
                        col.append(y)
            return tuple(out)

        placed = members.select("region", "id").join(blocks, "region").join(sets.select("id", "set"), "id")
        dealt = map_lists(placed.select("region", "id", "blocks", "set"), deal, "region long, p int, q int, side int, id long, set binary", rows=64)
        return dealt.groupBy("region", "p", "q").applyInPandas(lambda b: join_block(b, join), "u long, v long")

    def apart(self, members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Large regions cut by pivots drawn in them: the table of distances, edges found, and the smaller regions' members (region, id, pivot)."""
        draw = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("id", "region"), "id"))
        # Of each region only its smallest hashes are kept before they are numbered.
        few = members.withColumn("h", F.pmod(F.xxhash64("id", "region"), F.lit(1 << 30))).where(F.col("h") * F.col("n") < F.lit((1 << 30) * 8 * PIVOTS))
        pivots = few.select("region", "id", draw.alias("k")).where(F.col("k") <= PIVOTS).select("region", F.col("id").alias("p"))
        pairs = members.select("region", F.col("id").alias("x")).join(pivots, "region")
        met = self.tables.save(self.measured(pairs, sets), "drawn")
        d = (F.col("either") - F.col("inner")) / F.col("either")
        r = (self.join.bottom - self.join.top) / self.join.bottom
        near = met.groupBy("region", "x").agg(F.min(d).alias("home"))
        kept = met.join(near, ["region", "x"]).where(d <= F.col("home") + F.lit(2 * r + 1e-9))
        edges = met.where(self.linked()).where("x <> p").select(F.col("x").alias("u"), F.col("p").alias("v"))
        return met, edges, kept.select(F.xxhash64("region", "p").alias("region"), F.col("x").alias("id"), (F.col("x") == F.col("p")).alias("pivot"))


def jaccard_join(spark: SparkSession, df: DataFrame, join: Join = Join(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) a row of df.

    Texts that are null, empty or blank have no shingles and link with nothing. Rows that share an id
    are one node; where their texts differ, the smallest set of hashes, in byte order, stands for those
    that no other row shares. A null id has a null component and is no other's. Sets are compared by
    64-bit hashes of shingles, whose chance to collide within two texts of 20,000 words is below 1e-10.
    No other column is read. Tables that cut lineage are dropped once they are read no more, but for those
    that the result reads.
    """
    g = Regions(spark, join)
    tables = g.tables
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def points(ids: list, texts: list) -> tuple:
        sets = [shingles(t, join.words) for t in texts]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and i is not None else None for i, s in zip(ids, sets)]
        return ids, [len(s) for s in sets], keys, [cells(s, join) if k and join.apart(len(s)) else [] for k, s in zip(keys, sets)]

    rows = tables.save(map_lists(docs, points, "id long, n long, key binary, cells array<long>"), "points")
    first = tables.save(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep")), "first")
    own = rows.join(first.select(F.col("rep").alias("id"), F.col("key").alias("k2")), "id").where("key = k2")
    dealt = tables.save(own.select(F.explode("cells").alias("cell"), "id"), "cells")
    pivots = tables.save(dealt.groupBy("cell").agg(F.min("id").alias("p"), F.max("id").alias("last")).where("p <> last").select("cell", "p"), "pivots")
    pairs = tables.save(likely_in(dealt, "cell", pivots.select("cell")).join(pivots, "cell").where("id <> p").select(F.col("id").alias("x"), "p").distinct(), "pairs")
    tables.drop(dealt)

    met_ids = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("p").alias("id"))).distinct()
    met_ids = tables.save(met_ids, "met-ids")
    whole = likely_in(docs.where("id IS NOT NULL"), "id", met_ids).join(met_ids, "id").select("id", "text")
    named = map_lists(whole, lambda ids, texts: (ids, [shingles(t, join.words).tobytes() for t in texts]), "id long, set binary")
    named = named.where("octet_length(set) > 0").groupBy("id").agg(F.min("set").alias("set"))
    sets = tables.save(named.select("id", (F.octet_length("set") / 8).cast("long").alias("size"), "set"), "sets")
    met = tables.save(g.measured(pairs, sets), "met")
    edges = tables.save(met.where(g.linked()).select(F.col("x").alias("u"), F.col("p").alias("v")), "links")
    roots = components(tables, edges)

    r = (join.bottom - join.top) / join.bottom * (1 + 1e-9)
    ring = F.floor((F.col("either") - F.col("inner")) / F.col("either") / F.lit(r))
    placed = met.select("p", F.col("x").alias("id"), ring.alias("k")).union(met.select("p", F.col("p").alias("id"), F.lit(0).cast("long").alias("k")).distinct())
    members = placed.select("id", "p", F.explode(F.array("k", F.col("k") - 1)).alias("k")).where("k >= 0").select(F.xxhash64("p", "k").alias("region"), "id", (F.col("id") == F.col("p")).alias("pivot"))
    opened = left = tables.save(g.open_regions(members, roots), "open")
    found, cuts = [], []
    for _ in range(ROUNDS):
        large = left.where(F.col("n") > SMALL)
        before = large.count()
        if not before:
            break
        drawn, more, kept = g.apart(large, sets)
        found.append(tables.save(more, "more"))
        kept = tables.save(kept, "kept")
        cuts += [kept, drawn]
        if kept.count() > 2 * before:  # the windows take in most of the points: they are equally far from all pivots
            break
        cuts.append(now := components(tables, _union([edges, *found])))
        cuts.append(cut := tables.save(g.open_regions(kept, now), "cut"))
        if cut.count() > before:
            break
        found.append(tables.save(g.small(left.where(F.col("n") <= SMALL), sets), "small"))
        left = cut
    found.append(tables.save(g.small(left, sets), "small"))
    old, roots = roots, components(tables, _union([edges, *found]))
    tables.drop(pivots, pairs, met_ids, sets, met, edges, old, opened, *found, *cuts)
    out = rows.select("id", "n", "key").join(first, "key", "left").join(roots, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("u", "v")
    for f in frames[1:]:
        out = out.union(f.select("u", "v"))
    return out

