"""Exact top-k by inner product: ball trees in shards, searched by branch and bound.

Components become whole numbers, so scores are exact. Vectors are dealt to shards of bounded size by a hash of their id;
each shard builds a ball tree, and a query walks it from the child with the larger bound (its product with the centre plus
its length times the radius) and leaves out every ball whose bound lies below the query's k-th score. Each query first
searches one shard; the k-th score it finds there is shared with all other shards as the bound to start from.

Queries stream through a shard in blocks, so a task holds one shard and one block. Equal vectors are one ball of radius 0,
of which only the k + 1 smallest ids can matter.

Nulls and odd input: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a
null id; vectors are compared with those of their own length only; all rows of the query's own id are its own; repeated
rows appear as often as they are there; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

K, SCALE, EVERY = 20, 64, 20
SHARD_ROWS, BLOCK, LEAF = 2048, 1024, 64
_NONE = np.iinfo(np.int64).min


class BallTree:
    """Nested balls over the rows of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        self.ids, self.vectors, self.keep = ids, vectors, keep
        self.root = self._ball(np.arange(len(ids)))

    def _ball(self, rows: np.ndarray) -> tuple:
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
        if (points == points[0]).all():
            kept = rows[np.argsort(self.ids[rows], kind="stable")]
            last = self.ids[kept[min(self.keep, len(kept)) - 1]]
            return points[0], 0.0, kept[self.ids[kept] <= last], None, None
        if len(rows) <= LEAF:
            return centre, radius, rows, None, None
        far = points[((points - centre) ** 2).sum(axis=1).argmax()]
        other = points[((points - far) ** 2).sum(axis=1).argmax()]
        along = points @ (other - far)
        left = along <= np.median(along)
        if left.all():
            left = along < along.max()
        return centre, radius, None, self._ball(rows[left]), self._ball(rows[~left])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (rows of k, best first) of what reaches each query's bound; unused places hold no score."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        best = np.full((len(queries), k), _NONE, np.int64)
        names = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        exact = queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(self.vectors).max(initial=0) < 2.0**53

        def limit(ball: tuple, active: np.ndarray) -> np.ndarray:
            top = queries[active] @ ball[0] + lengths[active] * ball[1]
            return top + 1 + 1e-9 * np.abs(top)

        def visit(ball: tuple, active: np.ndarray, top: np.ndarray) -> None:
            active = active[top >= np.maximum(bound[active], best[active, k - 1])]
            if not len(active):
                return
            rows, left, right = ball[2:]
            if rows is None:
                a, b = limit(left, active), limit(right, active)
                first = a >= b
                for group, one, two, x, y in ((first, left, right, a, b), (~first, right, left, b, a)):
                    visit(one, active[group], x[group])
                    visit(two, active[group], y[group])
                return
            if exact:
                scores = (queries[active] @ self.vectors[rows].T).astype(np.int64)
            else:
                scores = queries[active].astype(np.int64) @ self.vectors[rows].T.astype(np.int64)
            scores[query_ids[active][:, None] == self.ids[rows][None, :]] = _NONE
            scores[scores < bound[active][:, None]] = _NONE
            better = (scores >= np.maximum(best[active, k - 1], _NONE + 1)[:, None]).any(axis=1)
            active, scores = active[better], scores[better]
            all_scores = np.concatenate([best[active], scores], axis=1)
            all_names = np.concatenate([names[active], np.broadcast_to(self.ids[rows], scores.shape)], axis=1)
            order = np.lexsort((all_names, -np.maximum(all_scores, _NONE + 1)), axis=1)[:, :k]
            best[active] = np.take_along_axis(all_scores, order, axis=1)
            names[active] = np.take_along_axis(all_names, order, axis=1)

        everyone = np.arange(len(queries))
        visit(self.root, everyone, limit(self.root, everyone))
        return names, best


def _searched(k: int):
    """Rows sorted by cell: the vectors of a shard first (kind 0), then the queries sent to it (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, tree, asked = None, [], None, []

        def answer() -> pa.RecordBatch:
            ids = np.array([q[0] for q in asked], np.int64)
            bound = np.array([_NONE if q[2] is None else q[2] for q in asked], np.int64)
            names, best = tree.search(ids, np.array([q[1] for q in asked], float), bound, k)
            hit = best > _NONE
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], names.shape)[hit]), pa.array(names[hit]), pa.array(best[hit])], ["query_id", "vec_id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "id", "v", "bound")]
            for shard, kind, name, v, bound in zip(*columns, strict=True):
                at = (shard, len(v))
                if at != cell:
                    if asked:
                        yield answer()
                    cell, rows, tree, asked = at, [], None, []
                if kind == 0:
                    rows.append((name, v))
                    continue
                if not rows:
                    continue
                if tree is None:
                    tree = BallTree(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), k + 1)
                asked.append((name, v, bound))
                if len(asked) >= BLOCK:
                    yield answer()
                    asked = []
        if asked:
            yield answer()

    return run


def whole_numbers(vector: Column) -> Column:
    """floor(scale * x) of each component as a double; null where the vector takes no part."""
    x = vector.cast("array<double>")
    fine = F.size(x) > 0
    fine &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long")))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all vectors for each vector whose id ``every`` divides."""
    spark = vectors.sparkSession
    tables = Written(spark, "topk")
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("id"), whole_numbers(F.col("`embedding`")).alias("v"))
    rows = tables.keep(rows.filter("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    shards = rows.groupBy(F.size("v").alias("width")).agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
    rows = rows.withColumn("width", F.size("v")).join(shards, "width")
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), "width", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("bound"))
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"])
    home = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("shards")).cast("int")

    def answers(sent: DataFrame) -> DataFrame:
        cells = dealt.unionByName(sent).repartition("width", "shard").sortWithinPartitions("width", "shard", "kind")
        return cells.select("shard", "kind", "id", "v", "bound").mapInArrow(_searched(k), "query_id long, vec_id long, score long")

    sent = asked.select(home.alias("shard"), "width", F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("long").alias("bound"))
    first = tables.keep(answers(sent), "first")
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("home"))
    sent = asked.withColumn("home", home).join(bounds, "id", "left")
    sent = sent.select(F.explode(others).alias("shard"), "width", F.lit(1).alias("kind"), "id", "v", "bound")
    found = first.unionByName(answers(sent))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
