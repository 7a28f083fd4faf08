"""Issuer lists, occurrence lists and tolerant search results: many spellings, one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import normalize as N
from ..functions.columns import blank_to_null, contains_any, pick_alias, strip
from ..functions.text import label_type


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as one string map each, headers folded to lower snake case."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return as_records(raw)


def as_records(raw: DataFrame) -> DataFrame:
    pairs = []
    for name in raw.columns:
        pairs += [F.lit(name.replace("﻿", "").strip().lower().replace(" ", "_")), strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))]
    return raw.select(F.create_map(*pairs).alias("record"))


def parse_issuers(records: DataFrame, watched: DataFrame | None = None, mark_mining: bool = True) -> DataFrame:
    """Issuers with the mining mark; rows without a number or a name come back as skipped.

    ``watched`` is a one-column table of lower-case names.
    """
    field = lambda n: pick_alias("record", V.ISSUER_ALIASES[n])
    rows = records.select(*[field(n).alias(n) for n in V.ISSUER_ALIASES])
    rows = rows.withColumn("skipped", F.col("profile_number").isNull() | F.col("name").isNull())
    text = F.lower(F.concat_ws(" ", "name", F.coalesce("industry", F.lit(""))))
    mining = contains_any(text, V.ISSUER_WORDS) | F.coalesce(contains_any(F.lower("industry"), V.INDUSTRY_WORDS), F.lit(False))
    if watched is not None:
        names = watched.toDF("_watch").distinct()
        rows = rows.join(names, F.lower(F.trim("name")) == F.col("_watch"), "left")
        mining = mining | F.col("_watch").isNotNull()
    active = F.coalesce(mining, F.lit(False)) if mark_mining else F.lit(True)
    return rows.withColumn("active", active).drop("_watch")


def list_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(~F.col("skipped")).alias("upserted"), F.count_if(~F.col("skipped") & F.col("active")).alias("mining"), F.count_if("skipped").alias("skipped")
    )


def parse_occurrences(records: DataFrame, source: str) -> DataFrame:
    """Occurrences with checked coordinates; unusable rows come back as skipped."""
    field = lambda n: pick_alias("record", V.OCCURRENCE_ALIASES[n])
    number = lambda n: F.replace(field(n), F.lit(","), F.lit("")).try_cast("double")
    blobs = [F.coalesce(F.try_element_at("record", F.lit(k)), F.lit("")) for k in V.OCCURRENCE_ALIASES["commodities"]]
    split = F.transform(F.split(F.replace(F.concat_ws(",", *blobs), F.lit(";"), F.lit(",")), ","), strip)
    home = F.lit("Canada") if source == "minfile" else F.lit(None).cast("string")
    rows = records.select(
        F.lit(source).alias("source"),
        F.left(F.coalesce(field("external_id"), field("name")), F.lit(80)).alias("external_id"),
        F.left(field("name"), F.lit(240)).alias("name"),
        number("lat").alias("lat"),
        number("lng").alias("lng"),
        F.coalesce(field("country"), home).alias("country"),
        field("region").alias("region"),
        N.commodities(F.filter(split, lambda c: c != "")).alias("commodities"),
    )
    inside = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    return rows.withColumn("skipped", ~F.coalesce(F.col("name").isNotNull() & inside, F.lit(False)))


# --- search results ------------------------------------------------------------------------------


def result_rows(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """The result list of each JSON page under any known key, one nesting level deep.

    A page without such a list gives one row with ``contract_error``.
    """
    others = [c for c in pages.columns if c != payload]
    body = F.col(payload)
    as_list = lambda text: F.from_json(text, "array<string>")
    outer = F.from_json(body, "map<string,string>")
    options = [F.when(strip(body).startswith("["), as_list(body))]
    for key in V.RESULT_LIST_KEYS:
        value = F.try_element_at(outer, F.lit(key))
        options.append(F.when(strip(value).startswith("["), as_list(value)))
        inner = F.when(strip(value).startswith("{"), F.from_json(value, "map<string,string>"))
        for nested in V.RESULT_LIST_KEYS:
            deep = F.try_element_at(inner, F.lit(nested))
            options.append(F.when(strip(deep).startswith("["), as_list(deep)))
    listed = pages.select(*others, F.coalesce(*options).alias("_rows"))
    found = listed.select(*others, F.explode_outer("_rows").alias("row"), F.col("_rows").isNull().alias("_no_list"))
    return found.filter(F.col("row").isNotNull() | F.col("_no_list")).withColumn(
        "contract_error", F.when(F.col("_no_list"), F.lit("no result list"))
    ).drop("_no_list")


def _scalars(text: Column) -> Column:
    """String map with lower-case keys; nested objects and lists read as missing."""
    raw = F.from_json(text, "map<string,string>")
    lowered = F.transform_keys(raw, lambda k, _: F.lower(k))
    return F.map_filter(lowered, lambda _, v: ~F.coalesce(strip(v).rlike(r"^[\[{]"), F.lit(True)))


def parse_results(rows: DataFrame) -> DataFrame:
    """Search results in one shape; a row without a document name is a contract error."""
    raw = F.transform_keys(F.from_json("row", "map<string,string>"), lambda k, _: F.lower(k))
    owner = F.coalesce(*[F.try_element_at(raw, F.lit(k)) for k in ("profile", "issuer", "reportingissuer")])
    staged = rows.withColumn("_m", _scalars(F.col("row"))).withColumn("_owner", owner)
    is_object = strip("_owner").startswith("{")
    staged = staged.withColumn("_o", F.when(is_object, _scalars(F.col("_owner"))))
    field = lambda n, m="_m": pick_alias(m, V.RESULT_ALIASES[n])
    plain_owner = F.when(~is_object, blank_to_null("_owner"))
    profile = F.coalesce(field("profile"), field("profile_inner", "_o"), plain_owner)
    bracket = blank_to_null(F.regexp_extract(profile, r"\(([^()]*)\)[^()]*$", 1))
    name, filed = field("document_name"), field("filed")
    label = F.coalesce(field("label"), name)
    error = F.coalesce(F.col("contract_error"), F.when(name.isNull(), F.lit("no document name")))
    others = [c for c in rows.columns if c not in ("row", "contract_error")]
    return staged.select(
        *others,
        profile.alias("profile_name"),
        F.coalesce(field("number"), field("number_inner", "_o"), bracket).alias("profile_number"),
        name.alias("document_name"),
        F.left(filed, F.lit(10)).alias("filed"),
        field("jurisdiction").alias("jurisdiction"),
        field("download_url").alias("download_url"),
        F.coalesce(field("external_id"), name).alias("external_id"),
        label_type(label).alias("doc_type"),
        label.alias("document_type_label"),
        error.alias("contract_error"),
    )
