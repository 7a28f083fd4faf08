"""Comparing two extractions of the same documents, and stratified picks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import ordered_index

TOLERANCE = 0.02


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal within a share of the larger figure; two missing figures are equal."""
    near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def match_rows(reference: DataFrame, candidate: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One-to-one pairs of rows with one class and close tonnes, greedy in id order.

    Both inputs hold document_id, row_id, category and tonnes. Rows of a class are first cut
    into runs: where sorted tonnes jump by more than the tolerance no pair can cross. A document
    with very many rows so becomes many small groups, and only a run is walked in order. Rows
    without tonnes agree with each other, so they are paired by their place in id order.
    """
    place = F.row_number().over(Window.partitionBy("document_id", "category").orderBy("row_id"))
    missing = lambda rows, name: rows.filter("tonnes IS NULL").select("document_id", "category", F.col("row_id").alias(name), place.alias("place"))
    unknown = missing(reference, "ref_id").join(missing(candidate, "cand_id"), ["document_id", "category", "place"])
    both = reference.select("document_id", "category", "row_id", "tonnes", F.lit(True).alias("is_ref")).unionByName(
        candidate.select("document_id", "category", "row_id", "tonnes", F.lit(False).alias("is_ref"))
    ).filter("tonnes IS NOT NULL")
    by_size = Window.partitionBy("document_id", "category").orderBy("tonnes", "is_ref", "row_id")
    before = F.lag("tonnes").over(by_size)
    breaks = F.when(before.isNull() | (F.col("tonnes") - before > tolerance * F.greatest(F.abs("tonnes"), F.abs(before), F.lit(1e-9))), 1).otherwise(0)
    runs = both.withColumn("_break", breaks).withColumn(
        "run", F.sum("_break").over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_break")
    # runs, and the walk below, stay where the class's rows were sorted
    whole = Window.partitionBy("document_id", "category", "run")
    mixed = runs.withColumn("_r", F.max("is_ref").over(whole)).withColumn("_c", F.min("is_ref").over(whole)).filter(F.col("_r") & ~F.col("_c"))
    doc = reference.schema["document_id"].dataType.simpleString()
    row = reference.schema["row_id"].dataType.simpleString()

    keys = ["document_id", "category", "run"]
    ordered = mixed.select(*keys, "is_ref", "row_id", "tonnes").sortWithinPartitions(*keys, "row_id")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, wanted, free = None, [], {}
        for batch in batches:
            made = []
            for document, category, run, is_ref, row_id, size in zip(*[batch[c] for c in (*keys, "is_ref", "row_id", "tonnes")]):
                if (document, category, run) != open_key:
                    made += _greedy(open_key, wanted, free, tolerance)
                    open_key, wanted, free = (document, category, run), [], {}
                if is_ref:
                    wanted.append((row_id, size))
                else:
                    free[row_id] = size
            if made:
                yield pd.DataFrame(made, columns=["document_id", "ref_id", "cand_id"])
        made = _greedy(open_key, wanted, free, tolerance)
        if made:
            yield pd.DataFrame(made, columns=["document_id", "ref_id", "cand_id"])

    known = ordered.mapInPandas(pair, f"document_id {doc}, ref_id {row}, cand_id {row}")
    return known.unionByName(unknown.select("document_id", "ref_id", "cand_id"))


def _greedy(key: tuple | None, wanted: list, free: dict, tolerance: float) -> list[tuple]:
    made = []
    for ref_id, size in wanted:
        for cand_id, other in free.items():
            if abs(size - other) <= tolerance * max(abs(size), abs(other), 1e-9):
                made.append((key[0], ref_id, cand_id))
                del free[cand_id]
                break
    return made


def map_agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Shared keys of two figure maps per pair and how many of them agree."""
    shared = F.array_intersect(F.map_keys(left), F.map_keys(right))
    same = F.filter(shared, lambda k: close(F.try_element_at(F.col(left), k), F.try_element_at(F.col(right), k)))
    return pairs.withColumn("shared_keys", F.coalesce(F.size(shared), F.lit(0))).withColumn("agreeing_keys", F.coalesce(F.size(same), F.lit(0)))


def compare_extractions(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows, matches and grade agreement per document."""
    pairs = match_rows(reference, candidate)
    left = reference.select("document_id", F.col("row_id").alias("ref_id"), F.col("grade").alias("ref_grade"))
    right = candidate.select("document_id", F.col("row_id").alias("cand_id"), F.col("grade").alias("cand_grade"))
    graded = map_agreement(pairs.join(left, ["document_id", "ref_id"]).join(right, ["document_id", "cand_id"]), "ref_grade", "cand_grade")
    agreed = graded.groupBy("document_id").agg(F.count("*").alias("matched"), F.sum("agreeing_keys").alias("agreeing"), F.sum("shared_keys").alias("shared"))
    sizes = lambda t, n: t.groupBy("document_id").agg(F.count("*").alias(n))
    joined = sizes(reference, "ref_rows").join(sizes(candidate, "new_rows"), "document_id", "full_outer").join(agreed, "document_id", "left")
    return joined.na.fill(0, ["ref_rows", "new_rows", "matched", "agreeing", "shared"])


def unmatched_rows(candidate: DataFrame, pairs: DataFrame) -> DataFrame:
    return candidate.join(pairs.select("document_id", F.col("cand_id").alias("row_id")), ["document_id", "row_id"], "left_anti")


def set_overlap(reference: DataFrame, candidate: DataFrame, value: str = "name") -> DataFrame:
    """Distinct lower-case values of each side per document and how many they share.

    Counted by grouping on (document, value), so no document's values are gathered.
    """
    mark = lambda t, r: t.select("document_id", F.lower(value).alias("v"), F.lit(r).alias("r"), F.lit(not r).alias("n"))
    per_value = mark(reference, True).unionByName(mark(candidate, False)).groupBy("document_id", "v").agg(F.max("r").alias("r"), F.max("n").alias("n"))
    return per_value.groupBy("document_id").agg(
        F.count_if("r").alias("reference"), F.count_if("n").alias("new"), F.count_if(F.col("r") & F.col("n")).alias("overlap")
    )


def stratified_pick(documents: DataFrame, order: list[Column], wanted: int = 20, by: str = "source") -> DataFrame:
    """Every k-th document of each stratum so that each gives about its share of ``wanted``.

    Positions inside a stratum are distributed, so one dominant stratum is no single task.
    """
    strata = documents.groupBy(by).agg(F.count("*").alias("_size"))
    share = F.floor(F.lit(wanted) / strata.agg(F.count("*")).scalar())
    placed = ordered_index(documents, order, by=[by]).join(strata.withColumn("_share", share), by)
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / F.col("_share")))
    taken = (F.pmod(F.col("position"), step) == 0) & (F.floor(F.col("position") / step) < F.col("_share"))
    return placed.filter(taken).drop("_size", "_share")
