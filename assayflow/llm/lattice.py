"""Near-duplicate vectors by lattice hashing in E8, confirmed by cosine.

In each of several tables a vector is projected at random to two blocks of eight numbers, and each block is decoded to
the nearest point of the lattice E8. The two points are the vector's own cell. It also probes the cells near it: those in
which one or both points are replaced by a close neighbour, in the order of the distance that this adds. Two vectors meet
in a cell when both are there and at least one of them owns it.

Equal vectors are one class from the start. Cells with a single class are left out before any vector is moved. Cells with
many are cut into blocks by a hash of the class, and each pair of blocks is one matrix product in one task. Pairs are
never rows: a pair is counted in the first cell in which it meets (both carry their keys, so each cell can tell), and what
leaves a task is one row per class of a block, with its number of links and the smallest class it is joined to.

A pair of cosine 0.95 meets in some table with probability 0.99, one of 0.97 or more with more than 0.999.

Nulls and odd input: vectors that are null, empty, of length zero, or hold a null or non-finite component link with
nothing; vectors are compared with those of their own size only; a null vec_id has no links, a null component, and is
kept; repeated rows are one vector and each get its result; one id with two vectors counts as two vectors; cosines of
exactly the threshold link; very long vectors are handled whole; other columns are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written
from .graph import components

SIMILAR = 0.95
TABLES, PROBES = 8, 4
#: Spread of the projected numbers against the lattice, whose nearest points lie sqrt(2) apart.
SPREAD = 0.6
#: Neighbours of each block's point that probes are made of.
NEAR = 4
#: Classes of a cell that one block holds, on average, and rows of a block multiplied at a time.
BLOCK, STRIP = 1024, 512
_TABLE_BITS = 6


def shortest_points() -> np.ndarray:
    """The 240 points of E8 next to the origin."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            rows.append(np.zeros(8))
            rows[-1][[i, j]] = a, b
    rows += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(rows)


_SHORTEST = shortest_points()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even whole points and the same moved by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _block(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own point and the nearest other points of each row, with the squared distance that each adds."""
    point = nearest_point(x)
    extra = 2 - 2 * ((x - point) @ _SHORTEST.T)
    nearest = np.argsort(extra, axis=1, kind="stable")[:, :NEAR]
    points = np.concatenate([point[:, None], point[:, None] + _SHORTEST[nearest]], axis=1)
    return points, np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(extra, nearest, axis=1)], axis=1)


def _named(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit names of cells (last axis: both points), with the table's number in the lowest bits."""
    name = np.full(points.shape[:-1], table + 1, np.uint64)
    for coordinate in np.moveaxis(np.rint(2 * points).astype(np.int64).view(np.uint64), -1, 0):
        name = (name ^ coordinate) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
        name *= np.uint64(0xBF58476D1CE4E5B9)
        name ^= name >> np.uint64(32)
    return (name & ~np.uint64((1 << _TABLE_BITS) - 1)) | np.uint64(table)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Names of cells: rows x tables x (the own cell, then the probed ones)."""
    out = np.empty((len(unit), tables, probes + 1), np.uint64)
    at = np.arange(len(unit))[:, None]
    for table in range(tables):
        draw = np.random.default_rng((table, unit.shape[1]))
        x = unit @ (draw.standard_normal((unit.shape[1], 16)) * SPREAD) + draw.random(16) * 2
        (one, add_one), (two, add_two) = _block(x[:, :8]), _block(x[:, 8:])
        added = (add_one[:, :, None] + add_two[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(added, axis=1, kind="stable")[:, : probes + 1]
        a, b = np.divmod(best, NEAR + 1)
        out[:, table] = _named(np.concatenate([one[at, a], two[at, b]], axis=-1), table)
    return out


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link, as bytes of their unit vector, with a print of what they are."""
    for batch in batches:
        ids, prints, units = [], [], []
        for name, values in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            own = np.array(values, float)
            scaled = own / np.abs(own).max()
            ids.append(name)
            prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            units.append((scaled / np.sqrt((scaled**2).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(units, pa.binary())], ["id", "print", "v"])


def _keyed(tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.frombuffer(v, float) for v in batch.column("v").to_pylist()]
            keys: list[bytes] = [b""] * len(vectors)
            for width in {len(v) for v in vectors}:
                rows = [n for n, v in enumerate(vectors) if len(v) == width]
                for n, own in zip(rows, cells(np.array([vectors[n] for n in rows]), tables, probes), strict=True):
                    keys[n] = own.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "keys"])

    return run


def _entries(probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("keys").to_pylist()
            keys = np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), -1)
            own = np.arange(keys.shape[1]) % (probes + 1) == 0
            nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes), pa.array(np.tile(own, len(raw)))], ["key", "node", "own"])

    return run


def _meets_here(key: np.uint64, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of key tables (pairs x tables x cells): is ``key`` the first cell in which the pair meets?"""
    table = int(key) & ((1 << _TABLE_BITS) - 1)
    in_b = (a[:, : table + 1, :1] == b[:, : table + 1]).any(axis=2)
    in_a = (b[:, : table + 1, :1] == a[:, : table + 1]).any(axis=2)
    earlier = (in_a[:, :table] | in_b[:, :table]).any(axis=1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.minimum(np.where(in_b[:, table], a[:, table, 0], none), np.where(in_a[:, table], b[:, table, 0], none))
    return ~earlier & (first == key)


def _smallest_joined(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest place that each place of a block reaches over the pairs u, v."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


class _Cell:
    """One pair of blocks of one cell; rows are sorted by class when it is searched."""

    def __init__(self, key: int, i: int, j: int):
        self.key, self.i, self.j, self.rows = np.int64(key).view(np.uint64), i, j, []

    def links(self, tables: int, probes: int, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes with links, how many vectors each is linked with, and the smallest class it is joined to."""
        self.rows.sort(key=lambda r: r[0])
        node = np.array([r[0] for r in self.rows])
        side = np.array([r[1] for r in self.rows])
        own = np.array([r[2] for r in self.rows])
        weight = np.array([r[3] for r in self.rows])
        vectors = np.frombuffer(b"".join(r[4] for r in self.rows)).reshape(len(self.rows), -1)
        keys = np.frombuffer(b"".join(r[5] for r in self.rows), np.uint64).reshape(len(self.rows), tables, probes + 1)
        left, right = np.flatnonzero(side == self.i), np.flatnonzero(side == self.j)
        us, vs = [], []
        for at in range(0, len(left), STRIP):
            strip = left[at : at + STRIP]
            alike = vectors[strip] @ vectors[right].T >= similar
            alike &= own[strip][:, None] | own[right][None, :]
            if self.i == self.j:
                alike &= strip[:, None] < right[None, :]
            x, y = np.nonzero(alike)
            for part in range(0, len(x), 1 << 17):
                a, b = strip[x[part : part + (1 << 17)]], right[y[part : part + (1 << 17)]]
                here = _meets_here(self.key, keys[a], keys[b])
                us.append(a[here])
                vs.append(b[here])
        u, v = (np.concatenate(k) if k else np.empty(0, int) for k in (us, vs))
        counts = np.bincount(u, weight[v], len(node)) + np.bincount(v, weight[u], len(node))
        linked = np.flatnonzero(counts)
        return node[linked], counts[linked].astype(np.int64), node[_smallest_joined(len(node), u, v)[linked]]


def _searched(tables: int, probes: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cell.links(tables, probes, similar)], ["node", "n", "to"])

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "width")), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "side", "own", "weight", "v", "keys")), strict=True)
            for place, row in zip(places, rows, strict=True):
                if cell is None or place != cell.place:
                    if cell:
                        yield found()
                    cell = _Cell(*place[:3])
                    cell.place = place
                cell.rows.append(row)
        if cell:
            yield found()

    return run


def near_copies(vectors: DataFrame, similar: float = SIMILAR, table_count: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    spark = vectors.sparkSession
    tables = Written(spark, "lattice")
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("id"), F.col("`embedding`").cast("array<double>").alias("v"))
    known = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    linkable = F.coalesce(F.col("id").isNotNull() & known & F.exists("v", lambda c: c != 0), F.lit(False))
    usable = rows.filter(linkable).mapInArrow(_unit_rows, "id long, print binary, v binary")
    usable = tables.keep(usable, "usable")

    # one row for each different vector; its number stands for it from here on
    ids = usable.select("print", "id").distinct()
    classes = ids.groupBy("print").agg(F.count("*").alias("weight"), F.min("id").alias("low"))
    firsts = usable.groupBy("print").agg(F.first("v").alias("v"))
    classes = classes.join(firsts, "print").withColumn("node", F.monotonically_increasing_id())
    classes = classes.select("node", "weight", "low", "print", "v")
    schema = "node long, weight long, low long, print binary, v binary, keys binary"
    classes = tables.keep(classes.mapInArrow(_keyed(table_count, probes), schema), "classes")

    entries = classes.select("node", "keys").mapInArrow(_entries(probes), "key long, node long, own boolean")
    # a vector probes no cell twice, so more than one row is more than one class
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).filter("n > 1 AND owners > 0")
    shared = tables.keep(shared.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "shared")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = entries.join(shared, "key").select("key", "node", "own", own.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.join(classes.select("node", "weight", "v", "keys"), "node")
    dealt = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), F.length("v").alias("width"), "node", "side", "own", "weight", "v", "keys")
    dealt = dealt.repartition("key", "i", "j", "width").sortWithinPartitions("key", "i", "j", "width")
    found = tables.keep(dealt.mapInArrow(_searched(table_count, probes, similar), "node long, n long, to long"), "found")

    roots = tables.keep(components(found.filter("node <> to").select(F.col("node").alias("u"), F.col("to").alias("v")).distinct()), "roots")
    placed = classes.select("node", "weight", "low", "print").join(roots.select(F.col("id").alias("node"), "root"), "node", "left")
    placed = placed.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
    placed = placed.select("print", F.coalesce("root", "node").alias("root"), "low", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    placed = tables.keep(placed, "placed")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = placed.join(lowest, "root").select("print", "n_links", "component_id")

    linked = usable.select("id", "print").join(placed, "print").select("id", "n_links", "component_id")
    nothing = rows.filter(~linkable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = linked.unionByName(nothing)
    return result.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
