"""Filing index files with a preamble, archive member paths and file discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ColumnLike, col, strip
from ..functions.text import label_type, plain_name
from ..operators.keyed import first_per_key

# How the two layouts open.
MANIFEST_HEADER = "page,profile_name,profile_number,document"
EXPORT_HEADER = "Profile(s),Document,Submitted date"
MANIFEST_SHAPE = (
    "page string, profile_name string, profile_number string, document string, submitted_date string, "
    "submitted_time string, jurisdiction string, file_size_kb string"
)
EXPORT_SHAPE = "profiles string, document string, submitted string, jurisdiction string, size string"


def read_index(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows of index files in either layout; a file without a known header gives none."""
    files = spark.read.format("text").option("wholetext", True).load(paths)
    return parse_index(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def parse_index(files: DataFrame) -> DataFrame:
    """``files`` holds path and body. Lines after the header are parsed as CSV records."""
    lines = F.split(F.regexp_replace(F.col("body"), "^﻿", ""), r"\r\n|\n|\r")
    rows = files.select("path", F.posexplode(lines).alias("pos", "line"))
    kind = F.when(F.col("line").startswith(MANIFEST_HEADER), F.lit("manifest")).when(F.col("line").startswith(EXPORT_HEADER), F.lit("export"))
    heads = rows.withColumn("kind", kind).filter("kind IS NOT NULL")
    first = first_per_key(heads, ["path"], F.col("pos")).select("path", F.col("pos").alias("head"), "kind")
    body = rows.join(first, "path").filter((F.col("pos") > F.col("head")) & (strip("line") != ""))
    manifest = body.filter("kind = 'manifest'").select("path", "pos", F.from_csv("line", MANIFEST_SHAPE).alias("r"))
    export = body.filter("kind = 'export'").select("path", "pos", F.from_csv("line", EXPORT_SHAPE).alias("r"))
    return _manifest_rows(manifest).unionByName(_export_rows(export))


def _kilobytes(value: ColumnLike):
    digits = F.regexp_extract(F.replace(col(value), F.lit(","), F.lit("")), r"(\d+)", 1)
    return digits.try_cast("bigint")


def _manifest_rows(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    return rows.filter(F.coalesce(r["document"], F.lit("")) != "").select(
        "path", "pos",
        strip(r["profile_name"]).alias("profile_name"), strip(F.coalesce(r["profile_number"], F.lit(""))).alias("profile_number"),
        strip(r["document"]).alias("document"), F.try_to_date(strip(r["submitted_date"]), "yyyy-MM-dd").alias("submitted_date"),
        strip(r["submitted_time"]).alias("submitted_time"), strip(r["jurisdiction"]).alias("jurisdiction"), _kilobytes(r["file_size_kb"]).alias("file_size_kb"),
    )


def _export_rows(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    number = F.regexp_extract(r["profiles"], r"\((\d{5,})\)\s*$", 1)
    name = strip(F.substring_index(F.regexp_replace(r["profiles"], r"\(\d{5,}\)\s*$", ""), " / ", 1))
    words = F.split(strip(r["submitted"]), r"\s+")
    word = lambda n: F.try_element_at(words, F.lit(n))
    day = F.try_to_date(F.concat_ws(" ", word(2), word(3), word(6)), "MMM d yyyy")
    return rows.filter(strip(F.coalesce(r["document"], F.lit(""))) != "").select(
        "path", "pos", name.alias("profile_name"), number.alias("profile_number"), strip(r["document"]).alias("document"), day.alias("submitted_date"),
        word(4).alias("submitted_time"), strip(r["jurisdiction"]).alias("jurisdiction"), _kilobytes(r["size"]).alias("file_size_kb"),
    )


def merge_index(rows: DataFrame) -> DataFrame:
    """The same filing listed in several files counts once; a row with a profile number wins."""
    keyed = rows.withColumn("_name", plain_name("profile_name")).withColumn("_doc", plain_name("document"))
    keys = ["_name", "_doc", "submitted_date", "submitted_time", "file_size_kb"]
    return first_per_key(keyed, keys, F.struct(F.col("profile_number") == "", "path", "pos")).drop("_name", "_doc")


def parse_member(path: ColumnLike):
    """struct(profile_number, company, filing_id, document) of an archive member path."""
    parts = F.filter(F.transform(F.split(col(path), "/"), strip), lambda p: p != "")
    root, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    numbered = root.rlike(r"^\d{5,}\s+.*$")
    middle = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    filing = F.try_element_at(F.filter(middle, lambda p: p.rlike(r"^\d{5,}\s+[A-Z_]+$")), F.lit(1))
    return F.struct(
        F.when(numbered, F.regexp_extract(root, r"^(\d{5,})\s", 1)).otherwise(F.lit("")).alias("profile_number"),
        F.when(numbered, F.regexp_extract(root, r"^\d{5,}\s+(.*)$", 1)).otherwise(root).alias("company"),
        F.coalesce(F.regexp_extract(filing, r"^(\d{5,})", 1), F.lit("")).alias("filing_id"),
        F.regexp_replace(last, r"(?i)\s*\([0-9a-f]{8,}\)$", "").alias("document"),
    )


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder with path, size and first bytes; content stays on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.substring("content", 1, 4).alias("magic"))


def discover_pdfs(files: DataFrame, root: str, include_french: bool = False) -> DataFrame:
    """Report files by magic bytes, with issuer, title and type read from the path."""
    inside = F.regexp_replace(F.col("path"), "^.*?" + "\\Q" + root.rstrip("/") + "\\E" + "/", "")
    parts = F.split(inside, "/")
    name = F.try_element_at(parts, F.lit(-1))
    hidden = F.exists(parts, lambda p: F.lower(p).isin(".ds_store", "__macosx")) | name.startswith(".")
    kept = files.filter((F.hex("magic") == "25504446") & ~hidden)
    if not include_french:
        kept = kept.filter(~F.lower(name).contains("french"))
    top = F.try_element_at(parts, F.lit(1))
    issuer = F.regexp_replace(F.regexp_replace(strip(top), r"^\d+\s+", ""), r"^[ .]+|[ .]+$", "")
    plain = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf\s*\([0-9a-f]+\)$", ".pdf"), r"(?i)\.pdf$", "")
    return kept.select(
        "path", "size_bytes", issuer.alias("issuer"), F.concat_ws(" — ", F.nullif(issuer, F.lit("")), F.nullif(strip(plain), F.lit(""))).alias("title"),
        path_type("path").alias("doc_type"),
    )


def path_type(path: ColumnLike):
    text = F.lower(col(path))
    return (
        F.when(text.rlike("43-101|technical_report|technical report"), F.lit("ni43101"))
        .when(text.contains("material_change"), F.lit("mda"))
        .when(text.rlike("news|press"), F.lit("press_release"))
        .otherwise(label_type(text))
    )
