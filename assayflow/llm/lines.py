"""Line deduplication over levelled sorted runs of line digests.

A line's key is the line without white space at its ends and with A-Z in lower case. Documents arrive in batches.
Each batch counts its own keys, merge-anti-joins the runs of keys that are already settled as common, and adds what
is left as a new sorted run. When a level holds ``fan`` runs they are merged into one run of the next level; keys whose
count has reached the threshold move to the settled runs. No level is ever rewritten before it is full, so every
digest is rewritten once per level, and a very common line stops costing anything once it is settled.

Nulls and odd input: every row is a document; a null or empty text is one empty line, which has no key and is never
dropped; a null doc_id stays null, and each row without an id is a document of its own; all rows of one doc_id are one
document in the counts, whether they repeat a text or not, and each of them gets its own result; very long texts are split
whole, inside the row; there are no ties, as a key is common or not; other columns are carried, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Written, ascii_lower, text_of

MIN_DOCS = 10
BATCHES = 3
FAN = 2


def key_of(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(BLANKS))


def row_key(text: str = "text") -> list[Column]:
    """Names a row by its id and text; equal rows share it, which does no harm as they get equal results."""
    return [F.xxhash64("doc_id", text).alias("k1"), F.hash(text, "doc_id").alias("k2")]


def line_digests(docs: DataFrame) -> DataFrame:
    """Per row: its id and row key, and the digest of every line's key, null where the key is empty."""
    digest = lambda key: F.when(key != "", F.unhex(F.md5(key)))
    keys = F.transform(F.split(text_of(), "\n"), key_of)
    held = docs.select(F.col("doc_id").alias("doc"), *row_key(), keys.alias("keys"))
    return held.select("doc", "k1", "k2", F.transform("keys", digest).alias("digests"))


def per_document(digests: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row per document and different digest in it.

    Only the rows of ids that stand in several rows (``repeated``) need a shuffle to be made different; of these a document
    may have any number, as equal digests of an id are combined before and after it.
    """
    each = F.explode(F.array_distinct("digests")).alias("digest")
    alone = digests.join(repeated, "doc", "left_anti").select(each)
    several = digests.join(repeated, "doc", "left_semi").select("doc", each).distinct().select("digest")
    return alone.unionByName(several).filter("digest IS NOT NULL")


class Runs:
    """Sorted runs by level, with the settled ones apart."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan: int = FAN):
        self.tables, self.min_docs, self.fan = Written(spark, "line-runs"), min_docs, fan
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.settled: list[DataFrame] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run-{self.made}"
        return name, self.tables.keep(rows.sortWithinPartitions("digest"), name)

    def add(self, digests: DataFrame) -> None:
        """A batch: one row per document and different digest in it."""
        own = digests.groupBy("digest").agg(F.count("*").alias("docs"))
        if self.settled:
            # counted and written first: an anti-join would else be moved below the count, to one row for every line
            own = self.tables.keep(own, f"batch-{self.made}")
        for run in self.settled:
            own = own.join(run.select("digest").hint("merge"), "digest", "left_anti")
        self._place(0, self._write(own))

    def _place(self, level: int, run: tuple[str, DataFrame]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._merge(runs))

    def _merge(self, runs: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
        rows = runs[0][1]
        for _, more in runs[1:]:
            rows = rows.unionByName(more)
        name, merged = self._write(rows.groupBy("digest").agg(F.sum("docs").alias("docs")))
        self.tables.drop(*[old for old, _ in runs])
        self.settled.append(self._write(merged.filter(F.col("docs") >= self.min_docs))[1])
        return name, merged.filter(F.col("docs") < self.min_docs)

    def common(self) -> DataFrame:
        """Digests that at least ``min_docs`` documents hold, after merging what the levels still keep apart."""
        left = [run for level in self.levels for run in level]
        self.levels = []
        if left:
            self._merge(left)
        rows = self.settled[0].select("digest")
        for more in self.settled[1:]:
            rows = rows.unionByName(more.select("digest"))
        return rows


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, into: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """``docs`` with the number of lines, of dropped lines, and the text that stays, as the columns ``into``."""
    spark, own = docs.sparkSession, docs.columns
    tables = Written(spark, "lines")
    digests = tables.keep(line_digests(docs), "digests")
    runs = Runs(spark, min_docs)
    repeated = tables.keep(digests.filter("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "repeated")
    # all rows of an id are in one batch, as the runs add up what the batches count
    dealt = F.pmod(F.when(F.col("doc").isNull(), F.col("k1")).otherwise(F.xxhash64("doc")), F.lit(batches))
    for batch in range(batches):
        runs.add(per_document(digests.filter(dealt == batch), repeated))
    common = tables.keep(runs.common(), "common")
    runs.tables.drop("")
    each = digests.select("k1", "k2", F.posexplode("digests").alias("place", "digest")).filter("digest IS NOT NULL")
    gone = each.join(common, "digest", "left_semi").groupBy("k1", "k2").agg(F.collect_set("place").alias("gone"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *row_key())
    held = held.join(gone, ["k1", "k2"], "left").select("row", "gone", F.split(text_of(F.col("row").getField("text")), "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    held = held.withColumn("stay", F.when(F.col("gone").isNotNull(), stay))
    kept = F.when(F.col("gone").isNull(), text_of(F.col("row").getField("text"))).otherwise(
        F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    )
    counts = F.struct(F.size("lines").cast("long").alias("n"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("d"), kept.alias("t"))
    # made before the input's own columns come back, whose names may be those used here
    held = held.select("row", counts.alias("made"))
    return held.select(*[F.col("row").getField(c).alias(c) for c in own], *[F.col("made").getField(k).alias(name) for k, name in zip("ndt", into, strict=True)])


def without_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their common lines gone; ``n_chars``, where there, is counted anew."""
    mark = "lines_" + "_".join(docs.columns)[:200]
    names = tuple(f"{mark}_{k}" for k in "ndt")
    rows = drop_common_lines(docs, min_docs, into=names)
    fresh = {"text": F.when(F.col("`text`").isNotNull(), F.col(f"`{names[2]}`")), "n_chars": F.length(F.col(f"`{names[2]}`")).cast("long")}
    return rows.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
