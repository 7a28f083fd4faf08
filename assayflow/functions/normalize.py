"""Normalisation and plausibility rules as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .columns import ColumnLike, blank_to_null, col, lookup, squeeze, strip


def token(value: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(col(value)), "[^a-z0-9]+", "")


def commodity(value: ColumnLike) -> Column:
    key = token(value)
    return F.when(key != "", F.coalesce(lookup(V.COMMODITY_SYMBOLS, key), F.left(strip(value), F.lit(12))))


def commodities(values: ColumnLike) -> Column:
    mapped = F.transform(col(values), commodity)
    return F.array_distinct(F.filter(mapped, lambda v: v.isNotNull()))


def stage(value: ColumnLike) -> Column:
    return lookup(V.STAGES, token(value))


def country(value: ColumnLike) -> Column:
    return F.coalesce(lookup(V.COUNTRIES, token(value)), F.left(blank_to_null(value), F.lit(80)))


def study_type(value: ColumnLike) -> Column:
    c = col(value)
    return F.when(c.isNotNull() & (c != ""), F.coalesce(lookup(V.STUDIES, token(c)), F.lit("other")))


def standard(value: ColumnLike) -> Column:
    return lookup(V.STANDARDS, token(value))


def project_key(name: ColumnLike) -> Column:
    words = F.regexp_replace(F.lower(col(name)), rf"\b({V.PROJECT_NOISE})\b", " ")
    return F.trim(F.regexp_replace(words, "[^a-z0-9]+", " "))


def named_like_company(project: ColumnLike, company: ColumnLike) -> Column:
    key = project_key(project)
    return (key != "") & key.eqNullSafe(project_key(company))


def cik(value: ColumnLike) -> Column:
    digits = F.regexp_replace(col(value), r"\D", "")
    return F.when(digits != "", F.right(F.concat(F.lit("0" * 10), digits), F.lit(10)))


def iso_date(value: ColumnLike) -> Column:
    text = F.left(strip(value), F.lit(10))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def currency(value: ColumnLike) -> Column:
    code = F.upper(strip(value))
    return F.when(code.rlike(V.CURRENCY_CODE), code)


def split_category(label: ColumnLike) -> Column:
    """struct(category, domain): the resource class named by a label and what is left of it."""
    text = squeeze(F.lower(col(label)))
    named = F.transform(
        F.regexp_extract_all(text, F.lit(V.CLASS_WORDS), F.lit(1)),
        lambda w: F.when(w == "proved", F.lit("proven")).otherwise(w),
    )
    none = F.array().cast("array<string>")
    pair = F.when(text.rlike(V.COMBINED_MI), F.array(F.lit("measured"), F.lit("indicated"))).otherwise(none)
    reserve = F.when(text.rlike(V.COMBINED_PP), F.array(F.lit("proven"), F.lit("probable"))).otherwise(none)
    found = F.array_sort(F.array_distinct(F.concat(named, pair, reserve)))
    base = (
        F.when(found == F.array(F.lit("indicated"), F.lit("measured")), F.lit("measured+indicated"))
        .when(found == F.array(F.lit("probable"), F.lit("proven")), F.lit("2p"))
        .when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))
    )
    rest = F.regexp_replace(text, V.CATEGORY_NOISE, " ")
    rest = F.regexp_replace(rest, r"\(\s*\)", " ")
    rest = squeeze(F.regexp_replace(rest, V.CATEGORY_EDGES, ""))
    wrapped = rest.startswith("(") & rest.endswith(")") & (F.regexp_count(rest, F.lit(r"\(")) == 1)
    rest = F.when(wrapped, strip(rest.substr(F.lit(2), F.length(rest) - 2))).otherwise(rest)
    return F.struct(
        F.coalesce(base, text).alias("category"),
        F.when(base.isNotNull() & (rest != ""), rest).alias("domain"),
    )


def _unit(key: Column) -> Column:
    return F.substring_index(key, "_", -1)


def _cap(condition: Column, ceiling: float) -> Column:
    """A confidence ceiling that applies only when the condition holds."""
    return F.when(condition, F.lit(ceiling))


def _clamped(confidence: ColumnLike) -> Column:
    given = F.coalesce(col(confidence), F.lit(V.DEFAULT_CONFIDENCE))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))


def _ounces(key: Column, value: Column) -> Column:
    return key.rlike(V.GRADE_KEY) & (_unit(key) == "gpt") & (value >= V.OUNCES_IN_GRADE_MIN)


def tonnes_in_metric(tonnes: ColumnLike, unit: ColumnLike) -> Column:
    factor = lookup(V.TONNAGE_FACTORS, F.lower(strip(unit)))
    return col(tonnes) * F.coalesce(factor, F.lit(1.0))


def clean_grade(grade: ColumnLike) -> Column:
    return F.map_filter(col(grade), lambda k, v: k.rlike(V.GRADE_KEY) & ~_ounces(k, v))


def clean_metal(grade: ColumnLike, metal: ColumnLike) -> Column:
    """Contained metal plus the ounces that were printed in a grade column."""
    kept = F.map_filter(col(metal), lambda k, v: k.rlike(V.METAL_KEY) & (v >= 0))
    stray = F.map_filter(col(grade), _ounces)
    renamed = F.transform_keys(stray, lambda k, _: F.concat(F.regexp_replace(k, "_[^_]*$", ""), F.lit("_oz")))
    added = F.map_filter(renamed, lambda k, _: ~F.array_contains(F.map_keys(kept), k))
    return F.map_concat(kept, added)


def validate_resources(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Split categories, convert tonnage, move stray ounces and lower the confidence of odd rows.

    Labels repeat, so each different one is split once and joined back. ``labels`` holds the categories that occur, where
    they are known beforehand; without it the rows are worked out a second time to find them.
    """
    labels = (rows if labels is None else labels).select(F.col("category").alias("_label")).distinct().withColumn("_split", split_category("_label"))
    empty = F.create_map().cast("map<string,double>")
    grade = F.coalesce(F.col("grade"), empty)
    metal = F.coalesce(F.col("contained_metal"), empty)
    unit = F.lower(strip("tonnage_unit"))
    ceiling = F.create_map(*[F.lit(x) for kv in V.GRADE_CEILINGS.items() for x in kv])
    staged = rows.select(
        *[c for c in rows.columns if c not in ("grade", "contained_metal")],
        grade.alias("grade"),
        metal.alias("contained_metal"),
        tonnes_in_metric("tonnes", "tonnage_unit").alias("_tonnes"),
        (F.col("tonnage_unit").isNotNull() & lookup(V.TONNAGE_FACTORS, unit).isNull()).alias("_odd_unit"),
        F.map_entries(grade).alias("_entries"),
    )
    staged = staged.join(labels, F.col("category").eqNullSafe(F.col("_label")), "left").drop("_label")
    entries = F.col("_entries")
    bad_key = F.exists(entries, lambda e: ~e["key"].rlike(V.GRADE_KEY))
    stray = F.exists(entries, lambda e: _ounces(e["key"], e["value"]))
    outside = F.exists(
        entries,
        lambda e: e["key"].rlike(V.GRADE_KEY)
        & ~_ounces(e["key"], e["value"])
        & ((e["value"] < 0) | (e["value"] > F.try_element_at(ceiling, _unit(e["key"])))),
    )
    impossible = (F.col("_tonnes") <= 0) | (F.col("_tonnes") > V.MAX_TONNES)
    confidence = F.least(
        _clamped("extraction_confidence"),
        _cap(F.col("_odd_unit"), 0.3),
        _cap(impossible, 0.3),
        _cap(~impossible & (F.col("_tonnes") < V.MIN_PLAUSIBLE_TONNES), 0.5),
        _cap(~F.col("_split.category").isin(*V.RESOURCE_CLASSES), 0.3),
        _cap(bad_key, 0.4),
        _cap(stray, 0.5),
        _cap(outside, 0.3),
    )
    changed = {
        "category": F.col("_split.category"),
        "domain": F.coalesce(blank_to_null("domain"), F.col("_split.domain")),
        "tonnes": F.col("_tonnes"),
        "grade": clean_grade("grade"),
        "contained_metal": clean_metal("grade", "contained_metal"),
        "extraction_confidence": confidence,
    }
    kept = [c for c in rows.columns if c != "tonnage_unit"]
    return staged.select(*[changed.get(c, F.col(c)).alias(c) for c in kept])


def in_millions(value: ColumnLike) -> Column:
    c = col(value)
    return F.when(F.abs(c) >= V.MONEY_IN_UNITS_MIN, c / 1e6).otherwise(c)


def money_cap(value: ColumnLike) -> Column:
    size = F.abs(col(value))
    return F.when(size >= V.MONEY_IN_UNITS_MIN, F.lit(0.6)).when(size >= V.MONEY_UNSURE_MIN, F.lit(0.3))


def validate_economics(rows: DataFrame) -> DataFrame:
    """Money to millions, headline-value keys only, impossible rates and lives marked down."""
    npv = F.coalesce(F.col("npv"), F.create_map().cast("map<string,double>"))
    usable = F.map_filter(npv, lambda k, v: k.rlike(V.NPV_KEY) & v.isNotNull())
    npv_caps = F.array_min(F.transform(F.map_values(usable), money_cap))
    confidence = F.least(
        _clamped("extraction_confidence"),
        _cap((F.col("irr_pct") < 0) | (F.col("irr_pct") > V.MAX_IRR_PCT), 0.3),
        _cap(F.col("capex_initial") < 0, 0.3),
        money_cap("capex_initial"),
        _cap(F.exists(F.map_keys(npv), lambda k: ~k.rlike(V.NPV_KEY)), 0.4),
        npv_caps,
        _cap(F.col("mine_life_years") < 0, 0.3),
    )
    changed = {
        "study_type": study_type("study_type"),
        "currency": currency("currency"),
        "capex_initial": in_millions("capex_initial"),
        "npv": F.transform_values(usable, lambda _, v: in_millions(v)),
        "extraction_confidence": confidence,
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns])


def validate_drills(rows: DataFrame) -> DataFrame:
    """Derive a missing interval and mark down intervals that run backwards."""
    width = F.coalesce(F.col("interval_m"), F.abs(F.col("to_m") - F.col("from_m")))
    confidence = F.least(_clamped("extraction_confidence"), _cap(F.col("to_m") < F.col("from_m"), 0.3))
    changed = {"interval_m": width, "extraction_confidence": confidence}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns])


def salvage_resource_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Read extraction JSON: one row per entry with a ``salvage`` state.

    ``kept`` rows cast cleanly; ``salvaged`` rows had only an unusable confidence, which becomes
    the low default; ``dropped`` rows lack a category, a tonnage or a numeric grade.
    """
    shape = (
        "rows array<struct<category:string,domain:string,tonnes:string,tonnage_unit:string,"
        "grade:map<string,string>,contained_metal:map<string,string>,cutoff:string,"
        "standard:string,effective_date:string,extraction_confidence:string>>"
    )
    others = [c for c in payloads.columns if c != payload]
    row = F.col("r")
    number = lambda v: v.try_cast("double")  # noqa: E731 - tiny local alias
    all_numeric = lambda m: F.forall(F.map_values(m), lambda v: number(v).isNotNull())
    usable = (
        row["category"].isNotNull()
        & number(row["tonnes"]).isNotNull()
        & F.coalesce(all_numeric(row["grade"]), F.lit(True))
        & F.coalesce(all_numeric(row["contained_metal"]), F.lit(True))
    )
    given = row["extraction_confidence"]
    state = (
        F.when(~usable, F.lit("dropped"))
        .when(given.isNotNull() & number(given).isNull(), F.lit("salvaged"))
        .otherwise(F.lit("kept"))
    )
    as_numbers = lambda m: F.transform_values(m, lambda _, v: number(v))
    return (
        payloads.select(*others, F.from_json(F.col(payload), shape)["rows"].alias("_rows"))
        .select(*others, F.posexplode("_rows").alias("row_no", "r"))
        .select(
            *others,
            "row_no",
            state.alias("salvage"),
            row["category"].alias("category"),
            row["domain"].alias("domain"),
            number(row["tonnes"]).alias("tonnes"),
            row["tonnage_unit"].alias("tonnage_unit"),
            as_numbers(row["grade"]).alias("grade"),
            as_numbers(row["contained_metal"]).alias("contained_metal"),
            row["cutoff"].alias("cutoff"),
            standard(row["standard"]).alias("standard"),
            iso_date(row["effective_date"]).alias("effective_date"),
            F.when(given.isNull(), F.lit(V.DEFAULT_CONFIDENCE))
            .otherwise(F.coalesce(number(given), F.lit(V.SALVAGED_CONFIDENCE)))
            .alias("extraction_confidence"),
        )
    )


def trusted_documents(rows: DataFrame, threshold: float = V.TRUSTED_CONFIDENCE) -> DataFrame:
    """Keep a document's rows only when every one of them clears the threshold.

    The weakest row per document is a partial aggregate, so a document with very many rows
    never gathers in one task; the rows themselves are only filtered by a left-semi join.
    """
    good = rows.groupBy("document_id").agg(F.min("extraction_confidence").alias("_low"))
    return rows.join(good.filter(F.col("_low") >= threshold), "document_id", "left_semi")
