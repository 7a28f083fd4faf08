"""Idempotent landing, fact replacement, work lists and embedding reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .keyed import first_per_key, ordered_index


def land_new(incoming: DataFrame, known: DataFrame, order: Column, hash_column: str = "sha256", hashes: DataFrame | None = None) -> DataFrame:
    """Rows whose (source, external_id) and content hash are both new; inside the batch the
    first row in ``order`` wins per external id, then per hash. ``hashes`` holds the known hashes
    where they are kept apart from the known ids.

    Known keys are removed before the batch is deduplicated, and each dedupe is a map-side
    combining aggregate, so a file repeated very often never gathers in one task.
    """
    keys = ["source", "external_id"]
    fresh = incoming.join(known.select(*keys).distinct(), keys, "left_anti")
    fresh = fresh.join((known if hashes is None else hashes).select(hash_column).distinct(), hash_column, "left_anti")
    per_id = first_per_key(fresh, keys, order)
    return first_per_key(per_id, [hash_column], order)


def with_content_hash(rows: DataFrame, content: str, name: str = "sha256") -> DataFrame:
    return rows.withColumn(name, F.sha2(F.col(content).cast("binary"), 256))


def dedupe_events(events: DataFrame) -> DataFrame:
    """The smallest id per (project, document, type), null types equal; rows without a document
    are left alone."""
    keyed = events.filter(F.col("document_id").isNotNull())
    loose = events.filter(F.col("document_id").isNull())
    return first_per_key(keyed, ["project_id", "document_id", "event_type"], F.col("event_id")).unionByName(loose)


def replacement_plan(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(document_id, table, action, rows) for every table a re-extracted document touches.

    A document whose new extraction is empty everywhere does not appear. ``keep`` means nothing
    new for that table, ``protected`` that a person reviewed a stored row, ``swap`` otherwise.
    """
    counts = None
    for table, rows in new.items():
        part = rows.groupBy("document_id").agg(F.count("*").alias("new_rows")).withColumn("table", F.lit(table))
        counts = part if counts is None else counts.unionByName(part)
    touched = counts.groupBy("document_id").agg(F.max("new_rows").alias("_any")).select("document_id")
    tables = F.array(*[F.lit(t) for t in new])
    grid = touched.select("document_id", F.explode(tables).alias("table"))
    reviewed = None
    for table, rows in old.items():
        part = rows.filter("reviewed").select("document_id", F.lit(table).alias("table")).distinct()
        reviewed = part if reviewed is None else reviewed.unionByName(part)
    staged = grid.join(counts, ["document_id", "table"], "left").join(
        reviewed.withColumn("_protected", F.lit(True)), ["document_id", "table"], "left"
    )
    action = (
        F.when(F.col("new_rows").isNull(), F.lit("keep"))
        .when(F.col("_protected"), F.lit("protected"))
        .otherwise(F.lit("swap"))
    )
    written = F.when(action == "swap", F.col("new_rows")).when(action == "protected", F.lit(-1)).otherwise(F.lit(0))
    return staged.select("document_id", "table", action.alias("action"), written.cast("long").alias("rows"))


def replace_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One fact table after a re-extraction: documents with new rows are swapped unless a stored
    row was reviewed; all other rows stay. Rows without positive tonnage are not written."""
    usable = new.filter(F.col("tonnes") > 0) if "tonnes" in new.columns else new
    protected = old.filter("reviewed").select("document_id").distinct()
    replaced = new.select("document_id").distinct().join(protected, "document_id", "left_anti")
    kept = old.join(replaced, "document_id", "left_anti")
    added = usable.join(protected, "document_id", "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def replace_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of a re-parsed document are replaced."""
    documents = fresh.select("document_id").distinct()
    return stored.join(documents, "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_fact_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Write only the partitions a replacement touches; others on disk are not rewritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


# --- work lists ----------------------------------------------------------------------------------


def new_candidates(results: DataFrame, pending: DataFrame, known: DataFrame) -> DataFrame:
    """Search results to fetch: reference not pending yet, document not stored yet.

    ``results`` holds external_id, download_url and filed; the reference is the link where there
    is one.
    """
    from ..functions.normalize import iso_date

    rows = results.withColumn("external_ref", F.coalesce(F.nullif(F.col("download_url"), F.lit("")), F.col("external_id")))
    rows = rows.filter(F.col("external_ref").isNotNull() & (F.col("external_ref") != ""))
    rows = rows.join(pending.select("external_ref").distinct(), "external_ref", "left_anti")
    rows = rows.join(known.select("external_id").distinct(), "external_id", "left_anti")
    rows = rows.withColumn("filed_date", iso_date("filed"))
    return first_per_key(rows, ["external_ref"], F.struct("external_id", "filed"))


def on_profiles(filings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Filings of listed profiles; no profile passes, and an empty list switches the filter off."""
    listed = profiles.select("profile_number").filter(F.col("profile_number").isNotNull()).distinct()
    switched_on = listed.agg((F.count("*") > 0).alias("on")).scalar()
    marked = filings.join(listed.withColumn("_listed", F.lit(True)), "profile_number", "left")
    keep = F.col("_listed").isNotNull() | F.col("profile_number").isNull() | ~switched_on
    return marked.filter(keep).drop("_listed")


def missing_jobs(filings: DataFrame, jobs: DataFrame, job_type: str = "extract", status: tuple[str, ...] = ("indexed",)) -> DataFrame:
    """Documents in a status without an open or finished job of a type."""
    held = jobs.filter((F.col("job_type") == job_type) & F.col("status").isin("pending", "running", "done")).select("document_id")
    return filings.filter(F.col("status").isin(*status)).join(held, "document_id", "left_anti")


def force_extract(filings: DataFrame, jobs: DataFrame, statuses: tuple[str, ...] = ("indexed", "triaged", "extracted", "failed")) -> DataFrame:
    """Technical filings of projects that could be read in full and are not queued for it."""
    technical = filings.filter(F.col("doc_type").isin(*V.TECHNICAL_TYPES) & F.col("project_id").isNotNull())
    return missing_jobs(technical, jobs.filter(F.col("status") != "done"), "full_extract", statuses)


def prioritized(jobs: DataFrame, watched_filings: DataFrame) -> DataFrame:
    """Open extraction jobs with their place in the queue: forced, watched, newest filing, oldest
    job. The place is a distributed position, so the whole queue never sorts in one task."""
    open_jobs = jobs.filter((F.col("status") == "pending") & F.col("job_type").isin("extract", "full_extract"))
    rows = open_jobs.join(watched_filings.select("document_id", "filed_at", "watched"), "document_id")
    rows = rows.withColumn("forced", F.col("job_type") == "full_extract")
    order = [
        F.col("forced").desc(), F.col("watched").desc(), F.col("filed_at").desc_nulls_last(), F.col("created_at").asc(), F.col("job_id").asc(),
    ]
    return ordered_index(rows, order, index="place")


def latest_checkpoints(runs: DataFrame) -> DataFrame:
    """Newest non-null checkpoint per slice."""
    usable = runs.filter(F.col("checkpoint").isNotNull())
    return usable.groupBy("slice").agg(F.max_by("checkpoint", F.struct("started_at", "run_id")).alias("checkpoint"))


def reuse_embeddings(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks with the stored vector of identical text where there is one.

    The lookup table is reduced to one row per hash before the join, so text repeated across a
    third of all chunks meets exactly one stored row.
    """
    hashed = chunks.withColumn("content_md5", F.md5(F.col("content")))
    table = (
        stored.filter(F.col("embedding").isNotNull())
        .groupBy(F.md5(F.col("content")).alias("content_md5"))
        .agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    )
    joined = hashed.join(table, "content_md5", "left")
    return joined.withColumn("reused", F.col("embedding").isNotNull())
