"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import Written


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id that ``links`` (u, v) holds; the root is the smallest id that can be reached.

    Alternating large and small stars: each round points neighbours at the smallest id they know of, until a round
    changes nothing and every link goes straight to its root. A hub with very many links matters in the large star only:
    its minimum is written before it is joined, which makes that an ordinary skewed join. After it a document has a link
    for each different minimum of its neighbours, so the small star is a window over few rows. Rounds grow with the
    logarithm of the longest chain, and what tells that a round changed nothing is observed while it is written.
    """
    tables = Written(links.sparkSession, "components")

    def written(pairs: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark"))
        rows = tables.keep(pairs.filter("a <> b").distinct().observe(seen, *marks), name)
        return rows, tuple(seen.get.values())

    now, before = written(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")), "links-0")
    turn = 0
    while True:
        turn += 1
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = tables.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"low-{turn}")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        now, after = written(small, f"links-{turn}")
        tables.drop(f"low-{turn}", f"links-{turn - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
