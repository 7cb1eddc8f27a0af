"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one kept a group.

Equal vectors are one entry with a count. Vectors of one length begin as one cell. A cell that is too
large is parted by centres fitted on a bounded sample of it; an entry lives in the cell of its nearest
centre and visits cells whose border is near: a pair at the threshold differs by a chord, of which a
random direction such as the one across a border sees its share by the root of the dimensions that the
cell's vectors really spread over. Within `reach` such shares of a border an entry visits the other cell; where
dimensions are few that is the exact window, and a large `reach` makes it so everywhere: then no link is lost. Large cells so made are parted again, so
that cells grow with the data and not in size. Entries at home in a cell are compared with each other and
with its visitors, a pair of blocks a task; visitors meet where one of them is at home. README has the
recall measured against all pairs.

A vector is kept once, in the bytes that its column has, with the numbers of its cells: all centres (one for
some `CELL` entries) go to each worker, which places an entry in one pass. Vectors go to the cells by shares
of the pairs of blocks, and what a share wrote is given up before the next, so that the disk needed
grows with the vectors and not with their visits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Tables, components, map_lists

#: Vectors that a cell's centres are fitted on (the expected number), centres that part a cell at most, and entries at home that a cell is meant for.
FIT, CENTRES, CELL = 20_000, 256, 8000
#: Entries of up to WIDE bytes at home in a block, such visitors in a block, entries that are placed at once, levels of parting, chord shares past a border.
BLOCK, VISITORS, WIDE, DEALT, LEVELS, REACH = 8192, 32_768, 1024, 4096, 8, 4.0
#: Bytes that are dealt to pairs of blocks at once, at least and for each byte of entries, and the bytes of an entry beside its vector.
SHARE, PART, BESIDE = 64 << 20, 1.5, 40
#: Entries whose rows have no id are numbered downwards from here.
LAST = (1 << 63) - 1


def unit(v: list | None) -> np.ndarray | None:
    """v at length one in double precision; None for a null, empty, zero or not finite vector."""
    if not v or any(x is None for x in v):
        return None
    x = np.asarray(v, dtype=np.float64)
    top = np.abs(x).max()
    return normed(x[None])[0] if np.isfinite(top) and top > 0 else None


def normed(x: np.ndarray) -> np.ndarray:
    """Rows, finite and not zero, at length one in double precision; a row's result does not hang on the others."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1)
    far = (top <= 1e-100) | (top >= 1e100)
    x[far] /= top[far, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """The unit vectors of vectors of one length in bytes of a numpy kind."""
    return normed(np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1))


def fit_centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from k of the vectors, drawn with a fixed seed; an empty cell keeps its centre."""
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def dimensions_of(x: np.ndarray, centres: np.ndarray) -> float:
    """The dimensions that vectors spread over around their centres, from 1: the participation ratio of the covariance's eigenvalues."""
    total, power = 0.0, np.zeros((x.shape[1], x.shape[1]))
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        off = part - centres[(part @ centres.T).argmax(1)]
        total += float((off * off).sum())
        power += off.T @ off
    return max(1.0, total * total / float((power * power).sum())) if total > 0 else 1.0


def places(x: np.ndarray, at_home: np.ndarray, centres: np.ndarray, dimensions: float, reach: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(entries, cells, at home there). Of two homes near their border, the one of the higher number visits; who visits already goes to every cell near."""
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    margin = min(math.sin(math.acos(threshold)), reach * math.sqrt(2 - 2 * threshold) / math.sqrt(dimensions))
    at = x @ centres.T
    home = at.argmax(1)
    near = at[np.arange(len(x)), home][:, None] - at <= margin * apart[home]
    number = np.arange(len(centres))[None, :]
    near &= (number < home[:, None]) | ~at_home[:, None]
    near[np.arange(len(x)), home] = False
    yield np.flatnonzero(at_home), home[at_home], True
    yield np.flatnonzero(~at_home), home[~at_home], False
    yield *np.nonzero(near), False


def leaves(raw: list[bytes], kind: str, tree: dict, visit: tuple[float, float] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, entries, at home there) of the cells that no centres part: homes alone, or with those that `visit`, (reach, threshold), adds.

    tree has (centres, dimensions, number of the first part) of a parted cell; a vector of b bytes begins in cell -b.
    """
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes).tolist():
        whole = np.flatnonzero(sizes == size)
        if -size not in tree:
            yield -size, whole, np.ones(len(whole), dtype=bool)
            continue
        x = units_of([raw[i] for i in whole], kind)
        todo = [(-size, np.arange(len(whole)), np.ones(len(whole), dtype=bool))]
        while todo:
            cell, rows, home = todo.pop()
            if cell not in tree:
                yield cell, whole[rows], home
                continue
            centres, dimensions, first = tree[cell]
            centres = centres.astype(np.float64)
            met = list(places(x[rows], home, centres, dimensions, *visit)) if visit else [(np.arange(len(rows)), (x[rows] @ centres.T).argmax(1), True)]
            to = np.concatenate([t for _, t, _ in met])
            order = np.argsort(to, kind="stable")
            rows, home = np.concatenate([rows[r] for r, _, _ in met])[order], np.concatenate([np.full(len(t), h) for _, t, h in met])[order]
            ends = np.flatnonzero(np.diff(to[order])) + 1
            todo += [(first + int(t), r, h) for t, r, h in zip(to[order][np.concatenate([[0], ends])], np.split(rows, ends), np.split(home, ends)) if len(r)]


def compare(block: pa.Table, threshold: float, kind: str) -> pa.Table:
    """Links between a block of homes and another block, or within it: counts for each entry, and edges enough to connect what it links.

    All pairs are worked out here, in slices, and none is given out: an entry's edge leads to the
    smallest entry that its links reach within the two blocks. A pair that is further apart in a quarter of
    the dimensions, in single precision, than a link is in all is none; the others are worked out in double.
    """
    block = block.take(np.lexsort((block["id"].to_numpy(), block["side"].to_numpy())))
    x = units_of(block["unit"].to_pylist(), kind)
    ids, w = block["id"].to_numpy(), block["copies"].to_numpy()
    many = int((block["side"].to_numpy() == 0).sum())
    own = block["p"][0] == block["q"][0]
    y, first = (x, 0) if own else (x[many:], many)
    counts, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    some = x[:, : max(1, x.shape[1] // 4)]
    half, one = (some * some).sum(1, keepdims=True) / 2, np.ones((len(x), 1))
    left, right = (np.concatenate(z, axis=1).astype(np.float32) for z in ((some, -half, one), (some, one, -half)))
    for i in range(0, many, 256):
        part = slice(i, min(i + 256, many))
        u, v = np.divmod(np.flatnonzero(left[part] @ right[first:].T >= threshold - 1 - 1e-5), max(1, len(y)))
        if own:
            u, v = u[u + i < v], v[u + i < v]
        if 16 * len(u) > (part.stop - i) * len(y):
            at = x[part] @ y.T
            linked = at[u, v] >= threshold
        else:
            linked = np.concatenate([np.zeros(0, dtype=bool), *(np.einsum("ij,ij->i", x[i + u[j : j + 8192]], y[v[j : j + 8192]]) >= threshold for j in range(0, len(u), 8192))])
        u, v = u[linked] + i, v[linked] + first
        np.add.at(counts, u, w[v])
        np.add.at(counts, v, w[u])
        while len(u):  # links whose ends are not yet known to meet
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[u] != label[v]
            u, v = u[open_], v[open_]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    rows = np.flatnonzero(counts)
    return pa.table({"id": ids[rows], "n": counts[rows], "other": least[label[rows]]})


class Cells:
    """Cells that entries are parted into until these are small, and the links within them; kind is the vectors' numpy kind."""

    def __init__(self, tables: Tables, threshold: float, reach: float, kind: str = "f8"):
        self.tables, self.threshold, self.reach, self.kind, self.made = tables, threshold, reach, kind, []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(self.tables.save(df, name))
        return self.made[-1]

    def shared(self, value):
        """value, in every worker."""
        return self.tables.spark.sparkContext.broadcast(value)

    def centres(self, entries: DataFrame, tree: dict, large: dict[int, int], level: int) -> list:
        """(cell, centres, dimensions) of the large cells, whose numbers of homes are given, from samples of their homes."""
        kind, known = self.kind, self.shared((tree, large))

        def sample(ids: list, draws: list, raw: list) -> tuple:
            tree, large = known.value
            cells = [(cell, i) for cell, rows, _ in leaves(raw, kind, tree) if cell in large for i in rows if draws[i] * large[cell] < FIT]
            return [c for c, _ in cells], [ids[i] for _, i in cells], [raw[i] for _, i in cells]

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("id")
            x = units_of(list(group["unit"]), kind)
            cell = int(group["cell"].iloc[0])
            centres = fit_centres(x, min(len(x), CENTRES, max(2, known.value[1][cell] // CELL))).astype(np.float32)
            return pd.DataFrame({"cell": [cell], "centres": [centres.tobytes()], "dimensions": [dimensions_of(x, centres.astype(np.float64))]})

        draw = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        drawn = map_lists(entries.select("id", draw.alias("draw"), "unit"), sample, "cell int, id long, unit binary", rows=DEALT)
        found = self.save(drawn.groupBy("cell").applyInPandas(fit, "cell int, centres binary, dimensions double"), "centres").collect()
        known.destroy()
        return [(r["cell"], np.frombuffer(r["centres"], dtype=np.float32), r["dimensions"]) for r in found]

    def parted(self, entries: DataFrame) -> DataFrame:
        """Places (cell, n, m, bytes, id, copies, home, unit) of entries (id, copies, unit) in cells that are small, or that parting does not make smaller; n and m are the cell's homes and visitors, bytes those of one."""
        kind, visit, tree, was, width, free = self.kind, (self.reach, self.threshold), {}, {}, {}, 0
        sizes = entries.groupBy((-F.octet_length("unit")).alias("cell")).agg(F.count("*").alias("n"))
        for level in range(LEVELS):
            large = {r["cell"]: r["n"] for r in sizes.where(F.col("n") > 2 * CELL).collect() if r["n"] < 0.9 * was.get(r["cell"], math.inf)}
            if not large:
                break
            for cell, centres, dimensions in self.centres(entries, tree, large, level):
                long = width.get(cell) or -cell // np.dtype(kind).itemsize
                tree[cell] = (centres.reshape(-1, long), dimensions, free)
                parts = range(free, free + len(tree[cell][0]))
                was |= dict.fromkeys(parts, large[cell])
                width |= dict.fromkeys(parts, long)
                free = parts.stop
            known = self.shared(tree)

            def homes(raw: list, known=known) -> tuple:
                cells = np.zeros(len(raw), dtype=np.int32)
                for cell, rows, _ in leaves(raw, kind, known.value):
                    cells[rows] = cell
                return (cells,)

            sizes = map_lists(entries.select("unit"), homes, "cell int", rows=DEALT).groupBy("cell").agg(F.count("*").alias("n"))
        known = self.shared(tree)

        def place(ids: list, copies: list, raw: list) -> tuple:
            homes, visits = np.zeros(len(raw), dtype=np.int32), [[] for _ in raw]
            for cell, rows, home in leaves(raw, kind, known.value, visit):
                homes[rows[home]] = cell
                for i in rows[~home].tolist():
                    visits[i].append(cell)
            return ids, copies, raw, homes, [sorted(v) for v in visits]

        placed = map_lists(entries.select("id", "copies", "unit"), place, "id long, copies long, unit binary, at int, visits array<int>", rows=DEALT)
        placed = self.save(placed, "placed")
        known.destroy()
        homes = placed.groupBy(F.col("at").alias("cell")).agg(F.count("*").alias("n"), F.max(F.octet_length("unit") + BESIDE).alias("bytes"))
        visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"))
        self.sizes = self.save(homes.join(visitors, "cell", "left").select("cell", "n", F.coalesce("m", F.lit(0)).alias("m"), "bytes"), "sizes")
        spread = placed.select("id", "copies", "unit", "at", F.explode(F.concat(F.array("at"), "visits")).alias("cell"))
        return spread.join(F.broadcast(self.sizes), "cell").select("cell", "n", "m", "bytes", "id", "copies", (F.col("cell") == F.col("at")).alias("home"), "unit")

    def links(self, placed: DataFrame) -> DataFrame:
        """(id, n, other) of pairs of blocks: homes go to each pair of home blocks that theirs is in and to each block of visitors, visitors to each home block."""
        threshold, kind = self.threshold, self.kind
        wide = F.greatest(F.lit(1.0), F.col("bytes") / WIDE)
        a, b = F.ceil(F.col("n") * wide / BLOCK), F.ceil(F.col("m") * wide / VISITORS)
        dealt = (F.col("n") * (a + b) + F.col("m") * a) * F.col("bytes")
        whole, once = self.sizes.agg(F.sum(dealt), F.sum(F.col("n") * F.col("bytes"))).first()
        most = max(SHARE, PART * (once or 0))
        shares = math.ceil((whole or 1) / most)
        # a large cell's pairs of blocks go to all shares, a small cell to one
        large = F.col("cell").isin([r["cell"] for r in self.sizes.where(dealt > most / 16).select("cell").collect()] if shares > 1 else [])
        pick = F.xxhash64("id", F.lit(-1))
        own = F.when(F.col("home"), F.pmod(pick, a)).otherwise(a + F.pmod(pick, F.greatest(b, F.lit(1))))
        pairs = lambda some: some.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("home"), a + b).otherwise(a) - 1)).alias("other")).select(
            "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "copies", "unit"
        )
        at, schema = self.tables.path("links"), "id long, n long, other long"
        for i in range(shares):
            mine = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shares)) == i  # noqa: B023, E731
            share = pairs(placed.where(large | mine("cell"))).where(~large | mine("cell", "p", "q"))
            share.groupBy("cell", "p", "q").applyInArrow(lambda block: compare(block, threshold, kind), schema).write.mode("append").option("compression", "zstd").parquet(at)
        links = self.tables.spark.read.schema(schema).parquet(at)
        links.saved_at = at
        return links


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, what a job shuffled leaves the disk with the job's end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def near_duplicates(spark: SparkSession, df: DataFrame, threshold: float = 0.95, reach: float = REACH, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) a row of df.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
    of different lengths do not link. Repeated rows are copies of each other. A null id is no component's
    smallest; where all of a component's are null so is its id, and none of it is kept. Of different
    vectors that share their smallest id each has the links of all. Ids within 2 ** 50 of the largest
    long are reserved.
    """
    with shuffles_dropped(spark):
        return _near_duplicates(spark, df, threshold, reach, id_col, vector)


def _near_duplicates(spark: SparkSession, df: DataFrame, threshold: float, reach: float, id_col: str, vector: str) -> DataFrame:
    tables = Tables(spark)
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = "f4" if single else "f8"

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT):
                some = batch.slice(at, DEALT)
                v, keys, raw = some.column("v"), [None] * some.num_rows, [None] * some.num_rows
                sizes, flat = v.value_lengths(), v.flatten()
                if not v.null_count and not flat.null_count and len(set(sizes.to_pylist())) == 1 and len(flat):
                    groups = [(range(len(v)), flat.to_numpy().reshape(len(v), -1))]
                else:
                    groups = [([i], np.array([x], dtype=kind)) for i, x in enumerate(v.to_pylist()) if x and None not in x]
                for rows, x in groups:
                    top = np.abs(x).max(1)
                    good = np.flatnonzero(np.isfinite(top) & (top > 0))
                    for i, r, u in zip(good.tolist(), x[good], normed(x[good])):
                        keys[rows[i]], raw[rows[i]] = hashlib.blake2b(u.tobytes(), digest_size=16).digest(), r.tobytes()
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "unit"])

    asked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    vectors = tables.save(asked.mapInArrow(units, "id long, key binary, unit binary"), "vectors")
    keys = vectors.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    whole = tables.save(keys.withColumn("id", F.coalesce("id", F.lit(LAST) - F.monotonically_increasing_id())), "entries")
    rows = tables.save(vectors.select("id", "key"), "rows")
    tables.drop(vectors)
    cells = Cells(tables, threshold, reach, kind)
    placed = cells.parted(whole)
    entries = tables.save(whole.drop("unit"), "keys")
    tables.drop(whole)
    links = cells.links(placed)
    tables.drop(*cells.made)
    roots = components(tables, links.where("id <> other").select(F.col("id").alias("u"), F.col("other").alias("v")))
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    by_key = entries.select("key", F.col("id").alias("entry"), "copies").join(counts, F.col("entry") == counts["id"], "left").join(roots, F.col("entry") == roots["node"], "left")
    root = F.coalesce("root", "entry")
    by_key = by_key.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.when(root <= LAST - (1 << 50), root).alias("root"))
    by_key = tables.save(by_key, "groups")
    tables.drop(entries, links, roots)
    out = rows.select("id", F.col("key").alias("own")).join(by_key, F.col("own") == F.col("key"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("root"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
