"""Near-duplicate embeddings by lattice hashing: random projections to eight
dimensions are decoded to points of the lattice E8.

A vector's unit direction is turned by random rotations and cut into pieces of eight
coordinates; each piece is decoded to the lattice point next to it. So many points
together are a cell of one table, and there are several tables. A vector is also shown
in the neighbouring cells in which one of the points is replaced by the lattice point
that comes closest after it. Two vectors meet in a table if one's own cell is among the
other's cells, and a meeting counts if their cosine, in double precision, reaches the
threshold. Each linked pair is counted in one place only, the first of all cells where
they meet.

The more vectors there are, the more points make a cell (and the more tables there are,
for the same recall), so that vectors which are not similar hardly ever meet and what
is done for each does not grow with the table.

Equal vectors are one from the start, with a weight. A crowded cell is dealt out
as pairs of blocks of bounded size; a block pair gives the number of links of each
vector and a star of links for each group, never the pairs. Cells that hold nothing
but vectors which have met in the first table are not looked at again.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .core import broadcast_if_small, partitions, pick, settled, stage

THRESHOLD = 0.95
#: Size of directions in units of the lattice.
SCALE = 4.0
#: Points of a cell -> tables. At the threshold a pair meets in a table with
#: probability 0.71, 0.42, 0.23, 0.12 and 0.06, in one of all with over 0.99.
TABLES = {1: 6, 2: 14, 3: 30, 4: 60, 5: 116}
#: Two unlike directions have the same point with about this probability, ...
MEET = 0.004
#: ... and a vector may meet so many unlike ones in a table, before cells get a point more.
UNLIKE = 0.3
#: Vectors of a block, groups that are compared one by one, pairs compared at a time.
BLOCK, LARGE, PAIRS = 2048, 48, 100_000
#: Rows of block pairs that are compared at a time, at least.
ROWS = 16_384
SMALL = 300_000
NO_KEY = 1 << 62


def points_for(n: int) -> int:
    """Points of a cell for so many different vectors."""
    return next((k for k in TABLES if n * MEET**k * (1 + k) <= UNLIKE), max(TABLES))


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [(i, j, a, b) for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(whole), 8))
    for at, (i, j, a, b) in enumerate(whole):
        out[at, i], out[at, j] = a, b
    half = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.concatenate([out, np.array(half)])


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of the even ones and of those moved by a half."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=8)
def projections(width: int, pieces: int, seed: int = 7) -> np.ndarray:
    """(pieces, width, 8): rows of random rotations, as many as are needed."""
    rng, found = np.random.default_rng(seed), []
    while sum(x.shape[1] for x in found) < 8 * pieces:
        size = max(width, 8)
        found.append(np.linalg.qr(rng.normal(size=(size, size)))[0][:width])
    flat = np.concatenate(found, 1)[:, : 8 * pieces] * np.sqrt(max(width, 8) / 64)
    return np.ascontiguousarray(flat.reshape(width, pieces, 8).transpose(1, 0, 2))


def cells(unit: np.ndarray, points: int, tables: int | None = None, scale: float = SCALE) -> np.ndarray:
    """(n, tables, 1 + points) cell numbers, a vector's own first. Tables, and vectors
    of unlike width, have no number in common."""
    tables = tables or TABLES[points]
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 1 << 62, (len(TABLES) * 8, 1 + max(TABLES.values())), dtype=np.int64) | 1
    near_to = roots().astype(np.float32)
    out = np.empty((len(unit), tables, 1 + points), np.int64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            sums, steps = weights[0, t] * (1 + unit.shape[1]), []
            for j in range(points):
                piece = t * points + j
                y = scale * (unit @ projections(unit.shape[1], TABLES[points] * points)[piece]) + 0.37 * piece % 1
                own = decode(y)
                step = near_to[((y - own).astype(np.float32) @ near_to.T).argmax(1)]
                weight = weights[8 * j : 8 * j + 8, 1 + t]
                sums = sums + np.rint(2 * own).astype(np.int64) @ weight
                steps.append(np.rint(2 * step).astype(np.int64) @ weight)
            out[:, t, 0] = sums
            for j, step in enumerate(steps):
                out[:, t, 1 + j] = sums + step
    return out


def units(batch: pa.Array) -> np.ndarray:
    """Directions in double precision of lists of equal length."""
    v = np.array(batch.to_pylist(), np.float64).reshape(len(batch), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow, no underflow of squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def gathered(n: int, i: np.ndarray, j: np.ndarray, up: np.ndarray | None = None) -> np.ndarray:
    """The least of each group that the pairs (i, j) join; goes on from ``up``."""
    up = np.arange(n) if up is None else up
    while True:
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up[up] != up).any():
            up = up[up]


def all_pairs(starts: np.ndarray, sizes: np.ndarray):
    """Index arrays (i, j) of all pairs inside small groups, a bounded number at a time."""
    for size in np.unique(sizes[(sizes > 1) & (sizes <= LARGE)]):
        x, y = np.triu_indices(size, 1)
        first, step = starts[sizes == size], max(1, PAIRS // len(x))
        for at in range(0, len(first), step):
            some = first[at : at + step, None]
            yield (some + x).ravel(), (some + y).ravel()


def large_pairs(unit: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """The same for large groups, of which matrix products tell the similar pairs."""
    for start, size in zip(starts[sizes > LARGE], sizes[sizes > LARGE]):
        inside = unit[start : start + size]
        step = max(1, 20 * PAIRS // size)
        for at in range(0, size, step):
            x, y = np.nonzero(inside[at : at + step] @ inside[at:].T >= THRESHOLD)
            keep = x < y
            yield start + at + x[keep], start + at + y[keep]


class Jobs:
    """Rows of block pairs in order, all of one width: a link's first meeting is looked
    for, and counted. A vector's cells are computed once for all its rows here."""

    def __init__(self, points: int, unit, ids, job, t, cell, own, part, split, home, weight):
        self.points, self.unit, self.ids, self.job, self.t, self.cell = points, unit, ids, job, t, cell
        self.own, self.part, self.split, self.home, self.weight = own, part, split, home, weight
        self.n, self.up = np.zeros(len(job)), np.arange(len(job))

    def close(self):
        """Index arrays of pairs at the threshold."""
        starts = np.flatnonzero(np.diff(self.job, prepend=-1))
        sizes = np.diff(np.append(starts, len(self.job)))
        for i, j in all_pairs(starts, sizes):
            i, j = self._may_count(i, j)
            near = np.einsum("ij,ij->i", self.unit[i], self.unit[j]) >= THRESHOLD
            yield i[near], j[near]
        for i, j in large_pairs(self.unit, starts, sizes):
            yield self._may_count(i, j)

    def _may_count(self, i, j):
        """Without pairs that do not meet here, that another block pair has, or that
        met in the first table as they have the same own cell there."""
        keep = (self.own[i] | self.own[j]) & (~self.split[i] | (self.part[i] != self.part[j])) & ((self.t[i] == 0) | (self.home[i] != self.home[j]))
        return i[keep], j[keep]

    def _count(self, i, j):
        self.n += np.bincount(i, self.weight[j], len(self.n)) + np.bincount(j, self.weight[i], len(self.n))
        self.up = gathered(len(self.n), i, j, self.up)

    def _settle(self, waiting: list):
        """Counts those of the pairs that meet here first."""
        if not waiting:
            return
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        ids, first_row, place = np.unique(self.ids[np.concatenate([i, j])], return_index=True, return_inverse=True)
        known = cells(self.unit[np.concatenate([i, j])[first_row]], self.points, int(self.t[i].max()) + 1)
        at, to = place[: len(i)], place[len(i) :]
        # most have met in an own cell of both: by the first table where that is so
        own = np.ascontiguousarray(known[:, :, 0].T)
        new = np.ones(len(i), bool)
        for table in range(len(own) - 1):
            left = np.flatnonzero(new & (self.t[i] > table))
            new[left[own[table][at[left]] == own[table][to[left]]]] = False
        i, j, at, to = i[new], j[new], at[new], to[new]
        for low in range(0, len(i), 5_000):
            here = slice(low, low + 5_000)
            a, b = known[at[here]], known[to[here]]
            # by table: the own cell of either, where the other is shown too
            first = (a[:, :, :1] == b).any(2)
            second = (b[:, :, :1] == a).any(2)
            n, t = np.arange(len(a)), self.t[i[here]]
            earlier = ((first | second) & (np.arange(a.shape[1]) < t[:, None])).any(1)
            most = np.iinfo(np.int64).max
            least = np.minimum(np.where(first[n, t], a[n, t, 0], most), np.where(second[n, t], b[n, t, 0], most))
            counted = ~earlier & (least == self.cell[i[here]])
            self._count(i[here][counted], j[here][counted])

    def run(self):
        """(rows, first row of the group of each, number of links) where there are links."""
        waiting, size = [], 0
        for i, j in self.close():
            sure = (self.t[i] == 0) & self.own[i] & self.own[j]
            self._count(i[sure], j[sure])
            if not sure.all():
                waiting.append((i[~sure], j[~sure]))
                size += int((~sure).sum())
            if size > 20 * PAIRS:
                self._settle(waiting)
                size = 0
        self._settle(waiting)
        rows = np.flatnonzero(self.n)
        return rows, self.up[rows], self.n[rows].astype(np.int64)


SHOWN = "id bigint, t int, cell bigint, own boolean, home bigint"


@settled("near-duplicates")
def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each row of ``vectors``: key, n_links (other rows linked to it),
    component_id (the least key that links reach, itself included), kept (whether
    that is its own).

    Rows that are null, zero, empty or hold null, NaN or infinite components link
    with nothing, nor do vectors of unlike length. Repeated rows link with each
    other. A row without key links like any other but gives no name to a component:
    one of such rows alone has a null component_id, and kept is then false. Keys are
    integers below 2**62. An empty table gives no row. Other columns are not looked
    at, whatever their names.
    """
    rows = pick(vectors, key=key, v=vector).select(F.col("key").cast("bigint").alias("key"), F.col("v").cast("array<double>").alias("v"))
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    rows = rows.select("key", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    node = F.coalesce("key", F.col("h1").bitwiseAND(F.lit(NO_KEY - 1)).bitwiseOR(F.lit(NO_KEY)))
    good = rows.where(F.col("v").isNotNull()).withColumn("node", node)
    classes = stage(good.groupBy("h1", "h2").agg(F.min("node").alias("id"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v")), "classes")
    points = points_for(classes.count())
    tables = TABLES[points]

    def show(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                piece = batch.slice(at, 2_000)
                dims = piece.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    some = piece.filter(pa.array(dims == dim))
                    found, times = cells(units(some.column(1)), points), tables * (1 + points)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(some.column(0).to_numpy(), times)),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + points), some.num_rows)),
                        pa.array(found.ravel()),
                        pa.array(np.tile(np.arange(1 + points) == 0, some.num_rows * tables)),
                        pa.array(np.repeat(found[:, 0, 0], times)),
                    ], names=["id", "t", "cell", "own", "home"])

    shown = stage(classes.select("id", "v").mapInArrow(show, SHOWN), "cells")
    sizes = shown.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("owned"), F.min("t").alias("at"), F.min("home").alias("low"), F.max("home").alias("high"))
    sizes = sizes.where("owned AND size > 1 AND (at = 0 OR low < high)")
    sizes = stage(sizes.select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "sizes")
    sizes, _ = broadcast_if_small(sizes, SMALL)
    parted = shown.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    jobs = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    jobs = jobs.select("id", "t", "cell", "own", "home", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    group = ["cell", "low", "high"]
    dealt = jobs.join(classes.select("id", "w", "v"), "id").repartition(partitions(vectors.sparkSession), *group).sortWithinPartitions(*group, "id")

    def compare(batches):
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            if len(held) < ROWS:
                continue
            names = np.stack([held.column(x).to_numpy() for x in group], 1)
            ends = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            if len(ends):  # the last job may go on in the next batch
                yield from whole(held.slice(0, ends[-1]))
                held = held.slice(ends[-1])
        if held is not None and len(held):
            yield from whole(held)

    def whole(table):
        dims = pa.compute.list_value_length(table.column("v")).to_numpy()
        for dim in np.unique(dims):
            data = table.filter(pa.array(dims == dim)).combine_chunks()
            id_, t, cell, home, w, low, high, part = (data.column(x).to_numpy() for x in ("id", "t", "cell", "home", "w", "low", "high", "part"))
            own = data.column("own").to_numpy(zero_copy_only=False).astype(bool)
            names = np.stack([cell, low, high], 1)
            job = np.concatenate([[0], np.cumsum((names[1:] != names[:-1]).any(1))])
            unit = units(data.column("v").combine_chunks())
            rows, to, n = Jobs(points, unit, id_, job, t, cell, own, part, low != high, home, w).run()
            yield pa.RecordBatch.from_arrays([pa.array(id_[rows]), pa.array(id_[to]), pa.array(n)], names=["a", "b", "n"])

    found = stage(dealt.mapInArrow(compare, "a bigint, b bigint, n bigint"), "links")
    counts = found.groupBy(F.col("a").alias("counted")).agg(F.sum("n").alias("n"))
    named = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "of")
    placed = classes.drop("v").join(counts, F.col("id") == F.col("counted"), "left").join(named, F.col("id") == F.col("of"), "left")
    placed = placed.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("key", "h1", "h2", F.col("v").isNotNull().alias("good")).join(placed, ["h1", "h2"], "left")
    component = F.when(~F.col("good"), F.col("key")).when(F.col("component") < NO_KEY, F.col("component"))
    return out.select(
        F.col("key").alias(key),
        F.when(F.col("good"), F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
      WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.b AS component_id, c.b = v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.a = v.vec_id
"""
