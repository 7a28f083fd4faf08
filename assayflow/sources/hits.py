"""Search hits: JSON pages to filings, exhibit gate, document class and disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import contains_any, strip

HIT_SHAPE = (
    "hits struct<hits:array<struct<_id:string,_source:struct<ciks:array<string>,display_names:array<string>,"
    "root_forms:array<string>,form:string,file_type:string,file_date:string,sics:array<string>>>>>"
)


def parse_hits(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """One filing per usable hit of each JSON page."""
    others = [c for c in pages.columns if c != payload]
    parsed = pages.select(*others, F.from_json(F.col(payload), HIT_SHAPE)["hits"]["hits"].alias("_hits"))
    exploded = parsed.select(*others, F.posexplode("_hits").alias("hit_no", "h"))
    src = F.col("h._source")
    first = lambda array: F.try_element_at(array, F.lit(1))
    text = lambda c: F.coalesce(c, F.lit(""))
    sics = F.filter(F.transform(src["sics"], lambda s: s.try_cast("int")), lambda s: s.isNotNull())
    usable = F.col("h._id").contains(":") & first(src["ciks"]).isNotNull()
    accession = F.substring_index(F.col("h._id"), ":", 1)
    filename = F.regexp_replace(F.col("h._id"), "^[^:]*:", "")
    hits = exploded.filter(usable).select(
        *others,
        "hit_no",
        accession.alias("accession"),
        filename.alias("filename"),
        first(src["ciks"]).alias("cik"),
        F.when(F.size(src["root_forms"]) > 0, text(first(src["root_forms"]))).otherwise(text(src["form"])).alias("form"),
        strip(text(src["file_type"])).alias("file_type"),
        F.coalesce(first(src["display_names"]), F.nullif(src["form"], F.lit("")), F.lit("EDGAR filing")).alias("title"),
        F.try_to_date(src["file_date"], "yyyy-MM-dd").alias("filed_at"),
        first(sics).alias("sic"),
    )
    return with_ids(hits)


def with_ids(hits: DataFrame) -> DataFrame:
    """External id and archive link of each hit."""
    folder = F.replace(F.col("accession"), F.lit("-"), F.lit(""))
    link = F.concat_ws("/", F.lit(V.ARCHIVE_BASE), F.col("cik").try_cast("bigint").cast("string"), folder, "filename")
    return hits.withColumn("external_id", F.concat_ws(":", "accession", "filename")).withColumn("url", link)


def folded_type(value: Column) -> Column:
    return F.replace(F.upper(strip(value)), F.lit("-"), F.lit(""))


def parse_file_types(raw: str | None) -> tuple[str, ...]:
    """An allowlist as folded prefixes; empty means keep everything."""
    text = V.DEFAULT_EXHIBITS if raw is None else raw
    if text.strip().lower() in ("", V.ALL_EXHIBITS):
        return ()
    return tuple(p.strip().upper().replace("-", "") for p in text.split(",") if p.strip())


def is_technical_exhibit(file_type: Column, filename: Column) -> Column:
    return F.when(file_type != "", file_type.rlike(V.EXHIBIT_TYPE)).otherwise(filename.rlike(V.EXHIBIT_FILE))


def matches_file_types(file_type: Column, filename: Column, allowed: tuple[str, ...]) -> Column:
    """Whole-segment match against the allowlist; an undeclared type is judged by its name."""
    if not allowed:
        return F.lit(True)
    declared = folded_type(file_type)
    whole = F.lit(False)
    for prefix in allowed:
        whole = whole | (declared == prefix) | declared.startswith(prefix + ".")
    undeclared = filename.rlike(V.EXHIBIT_FILE) if "EX96" in allowed else F.lit(False)
    return F.when(declared == "", undeclared).otherwise(whole)


def document_class(form: Column, file_type: Column, filename: Column, override: str | None = None) -> Column:
    if override:
        return F.lit(override)
    root = F.upper(F.coalesce(form, F.lit("")))
    return (
        F.when(is_technical_exhibit(file_type, filename), F.lit("sk1300"))
        .when(contains_any(root, V.ANNUAL_FORMS), F.lit("financials"))
        .when(contains_any(root, V.CURRENT_FORMS), F.lit("press_release"))
        .otherwise(F.lit("sk1300"))
    )


def with_disposition(
    hits: DataFrame, known: DataFrame, allowed: tuple[str, ...], override: str | None = None,
    sic_range: tuple[int, int] = V.SIC_RANGE, hash_column: str | None = None,
) -> DataFrame:
    """What happens to each hit, first rule wins. ``known`` holds external_id and, where content
    hashes are compared, sha256; hits refused by type or code never reach those joins' output."""
    ids = known.filter(F.col("external_id").isNotNull()).select("external_id").distinct().withColumn("_known", F.lit(True))
    rows = hits.join(ids, "external_id", "left")
    dupe = F.lit(False)
    if hash_column:
        hashes = known.filter(F.col("sha256").isNotNull()).select(F.col("sha256").alias(hash_column)).distinct().withColumn("_dupe", F.lit(True))
        rows = rows.join(hashes, hash_column, "left")
        dupe = F.coalesce("_dupe", F.lit(False))
    file_type, filename = F.col("file_type"), F.col("filename")
    technical = F.lit(True) if override else is_technical_exhibit(file_type, filename)
    outside = F.col("sic").isNotNull() & ~F.col("sic").between(*sic_range)
    readable = F.lower(filename).rlike(r"\.(pdf|htm|html)$")
    rule = (
        F.when(~matches_file_types(file_type, filename, allowed), F.lit("skipped_file_type"))
        .when(~technical & outside, F.lit("skipped_sic"))
        .when(~readable, F.lit("skipped_unsupported"))
        .when(F.coalesce("_known", F.lit(False)), F.lit("skipped_known"))
        .when(dupe, F.lit("skipped_dupe"))
        .otherwise(F.lit("ingested"))
    )
    kind = document_class(F.col("form"), file_type, filename, override)
    return rows.withColumn("disposition", rule).withColumn("doc_type", kind).drop("_known", "_dupe")
