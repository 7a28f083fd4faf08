"""Lattice hashing of vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import types as T

from assayflow.llm import lattice

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("id", "v", "node", "print", "key", "own", "root", "n_links", "kept")]
)


@pytest.fixture(scope="module")
def vectors_of(spark):
    return lambda rows: spark.createDataFrame([(n, v, 1) + ("x",) * (len(SCHEMA) - 3) for n, v in rows], SCHEMA)


def plainly(rows):
    """Links and components over all pairs of different (id, vector) pairs."""
    usable = sorted({(n, tuple(np.float32(v).astype(float))) for n, v in rows if n is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    top = list(range(len(usable)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    links = [0] * len(usable)
    for i, (_, a) in enumerate(usable):
        for j in range(i):
            b = usable[j][1]
            if len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95:
                links[i] += 1
                links[j] += 1
                top[max(find(i), find(j))] = min(find(i), find(j))
    known = {u: (links[k], usable[find(k)][0]) for k, u in enumerate(usable)}
    out = []
    for n, v in rows:
        key = (n, tuple(np.float32(v).astype(float))) if v and None not in v else None
        count, low = known.get(key, (0, n))
        out.append((n, count, low, n is None or low == n))
    return sorted(out, key=repr)


def near(draw, v, cosine):
    w = draw.standard_normal(len(v))
    v = v / np.linalg.norm(v)
    w -= w @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(6)
    out = []
    for n in range(120):
        v = draw.standard_normal(24)
        out.append(v)
        for _ in range(n % 4):
            out.append(near(draw, v, draw.choice([0.9, 0.97, 0.99])) * draw.choice([0.01, 1, 30]))
    chain = draw.standard_normal(24)
    for _ in range(12):
        chain = near(draw, chain, 0.985)
        out.append(chain)
    hub = draw.standard_normal(24)
    out += [near(draw, hub, 0.99) for _ in range(80)] + [hub] * 25
    order = draw.permutation(len(out))
    rows = [(int(n), [float(x) for x in np.float32(out[k])]) for n, k in enumerate(order)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [None] * 24), (5004, [float("nan")] * 24), (5005, [float("inf")] * 24), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    rows += [(None, rows[0][1]), (None, None), rows[3], rows[3], (rows[3][0], rows[9][1]), (5008, [1e-30] * 24), (5009, [3e37] * 24)]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_all_pairs(vectors_of, rows, monkeypatch, block):
    """Cosines lie clear of the threshold, so every link is found; blocks of a cell change nothing."""
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "STRIP", 5)
    found = sorted((tuple(r) for r in lattice.near_copies(vectors_of(rows)).collect()), key=repr)
    assert found == plainly(rows)


def test_recall_at_the_threshold(vectors_of):
    draw = np.random.default_rng(8)
    rows = []
    for n in range(800):
        v = draw.standard_normal(64)
        rows += [(2 * n, v.tolist()), (2 * n + 1, near(draw, v, 0.9501).tolist())]
    found = lattice.near_copies(vectors_of(rows)).collect()
    assert sum(r["n_links"] for r in found) >= 0.97 * 2 * 800
    assert max(r["n_links"] for r in found) == 1


def test_nothing(vectors_of):
    assert lattice.near_copies(vectors_of([])).collect() == []
    assert [tuple(r) for r in lattice.near_copies(vectors_of([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_nearest_points_of_the_lattice():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((2000, 8)) * 3
    point = lattice.nearest_point(x)
    doubled = np.rint(2 * point).astype(int)
    assert (2 * point == doubled).all() and (doubled % 2 == doubled[:, :1] % 2).all() and (doubled.sum(axis=1) % 4 == 0).all()
    own = ((x - point) ** 2).sum(axis=1)
    around = ((x[:, None] - point[:, None] - lattice.shortest_points()[None]) ** 2).sum(axis=2)
    assert (own <= around.min(axis=1) + 1e-9).all() and own.max() <= 1 + 1e-9
