"""Per-key picks, global order indexes and small-side checks used by many operators.

Picks are aggregates, not windows, wherever one row per key is wanted: partial aggregation keeps
one candidate per key and task, so a key holding a third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key (pass a struct with a unique last field)."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per key; null order fields lose."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows per key. The rank filter becomes a group limit ahead of the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def ranked_top(rows: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """Global top n with its rank: per-task top n and a merge, then a window over n rows only."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def ordered_index(
    rows: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    total: str | None = None,
    index: str = "position",
    running: str = "running",
) -> DataFrame:
    """0-based position, and running sum of ``total``, in a global order inside each ``by`` group.

    One window over everything would put all rows in one task. Here rows are range partitioned
    on (by, order), so even one huge group spreads over many ranges; each range is numbered by
    itself and shifted by what the ranges before it hold. Ranges come from a sample and would
    move between two evaluations, hence the reliable checkpoint before they are used twice.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = [F.col(c).asc_nulls_first() for c in by]
    placed = rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    placed = cut_lineage(placed)
    amount = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    sizes = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))
    # One row per range and group: small however large the table is.
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
    )
    match = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    local = Window.partitionBy("_range", *by).orderBy(*order)
    numbered = (
        placed.withColumn("_i", F.row_number().over(local) - 1)
        .withColumn("_t", F.sum(amount).over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, match)
    )
    extra = [(F.col("_i") + F.col("_n0")).cast("long").alias(index)]
    if total:
        extra.append((F.col("_t") + F.col("_s0")).alias(running))
    return numbered.select(*rows.columns, *extra)


DEALT_BYTES = 2 << 20


def deal(key: str, *tables: DataFrame) -> list[DataFrame]:
    """Tables dealt by one key, into the same number of parts, on which much work is to follow.

    Parts are made for DEALT_BYTES of the largest table as its files and plan tell its size, and neither fewer than the session's nor more than 32
    times as many: adaptive execution would lay them together by what is shuffled, which is little beside what is made of it.
    """
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    parts = min(max(least, size // DEALT_BYTES), 32 * least)
    return [t.repartition(parts, key) for t in tables]


def joined_where_dealt(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` of two tables that are dealt by a part of these keys alone.

    A join on more keys than its tables are dealt by deals them again; a window does not. So both tables are laid in one and each row takes the others
    of its keys from there.
    """
    side = lambda t: F.struct(*[c for c in t.columns if c not in keys])
    known = lambda t: t.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    ours, theirs = known(rows).select(*keys, side(rows).alias("_row")), known(others).select(*keys, side(others).alias("_other"))
    absent = lambda t, c: F.lit(None).cast(t.schema[c].dataType).alias(c)
    both = ours.select("*", absent(theirs, "_other")).union(theirs.select(*keys, absent(ours, "_row"), "_other"))
    met = both.withColumn("_others", F.collect_list("_other").over(Window.partitionBy(*keys)))
    return met.filter(F.col("_row").isNotNull()).select(*keys, "_row.*", F.inline("_others"))


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], overwrite: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Merge by key: ``overwrite`` columns take the new value, ``fill`` columns keep the old
    value only where the new one is null; columns named in neither keep what was stored."""
    old = current.alias("o")
    match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    is_new = F.col("n._seen").isNotNull()
    joined = old.join(incoming.withColumn("_seen", F.lit(True)).alias("n"), match, "full_outer")
    picked = []
    for name in current.columns:
        stored = F.col(f"o.{name}")
        if name not in incoming.columns:
            picked.append(stored.alias(name))
        elif name in keys:
            picked.append(F.coalesce(stored, F.col(f"n.{name}")).alias(name))
        elif name in overwrite:
            picked.append(F.when(is_new, F.col(f"n.{name}")).otherwise(stored).alias(name))
        elif name in fill:
            picked.append(F.coalesce(F.col(f"n.{name}"), stored).alias(name))
        else:
            picked.append(F.coalesce(stored, F.col(f"n.{name}")).alias(name))
    return joined.select(*picked)
