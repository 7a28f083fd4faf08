"""Scalar analytics on figures: change, contained metal, headline values, grade keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .columns import ColumnLike, col, is_number, map_keys_by_size


def percent_change(previous: ColumnLike, current: ColumnLike) -> Column:
    before, after = col(previous), col(current)
    return (after - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100


def grade_unit(key: ColumnLike) -> Column:
    return F.substring_index(col(key), "_", -1)


def contained_metal(tonnes: ColumnLike, key: ColumnLike, grade: ColumnLike) -> Column:
    """Troy ounces for g/t and ppm, tonnes for %, null for units that do not convert."""
    unit, product = grade_unit(key), col(tonnes) * col(grade)
    return F.when(unit.isin("gpt", "ppm"), product / V.GRAMS_PER_OUNCE).when(unit == "pct", product / 100)


def contained_unit(key: ColumnLike) -> Column:
    unit = grade_unit(key)
    return F.when(unit.isin("gpt", "ppm"), F.lit("oz")).when(unit == "pct", F.lit("t"))


def is_main_grade_key(key: ColumnLike) -> Column:
    return ~col(key).rlike(V.SKIPPED_GRADE_KEY) & contained_unit(key).isNotNull()


def is_main_assay_key(key: ColumnLike) -> Column:
    return ~col(key).contains("Eq_") & contained_unit(key).isNotNull()


def most_common_key(counts: ColumnLike) -> Column:
    """From an array of struct(key, n): the highest n, ties to the smaller key."""
    ordered = F.array_sort(F.transform(col(counts), lambda c: F.struct((-c["n"]).alias("n"), c["key"].alias("key"))))
    return F.try_element_at(ordered, F.lit(1))["key"]


def headline_npv(npv: ColumnLike) -> Column:
    """struct(key, value, basis) of the value a study is quoted by, or null."""
    usable = F.map_filter(col(npv), lambda k, v: (k != "unspecified") & is_number(v))
    keys = map_keys_by_size(usable)
    preferred = [F.when(F.array_contains(keys, F.lit(k)), F.lit(k)) for k in V.HEADLINE_NPV_KEYS]
    any_post_tax = F.try_element_at(F.filter(keys, lambda k: k.startswith("post_tax")), F.lit(1))
    key = F.coalesce(*preferred, any_post_tax, F.try_element_at(keys, F.lit(1)))
    shape = r"^(pre|post)_tax(?:_([\d.]+)pct)?$"
    rate = F.regexp_extract(key, shape, 2)
    basis = F.when(
        key.rlike(shape),
        F.concat(
            F.regexp_extract(key, shape, 1),
            F.lit("-tax, "),
            F.when(rate != "", F.concat(rate, F.lit("%"))).otherwise(F.lit("rate not stated")),
        ),
    ).otherwise(F.lit("basis not stated"))
    picked = F.struct(key.alias("key"), F.try_element_at(usable, key).alias("value"), basis.alias("basis"))
    return F.when(key.isNotNull(), picked)


def first_map_value(mapping: ColumnLike) -> Column:
    usable = F.map_filter(col(mapping), lambda _, v: is_number(v))
    return F.try_element_at(usable, F.try_element_at(map_keys_by_size(usable), F.lit(1)))


def intercept_width(interval: ColumnLike, from_m: ColumnLike, to_m: ColumnLike) -> Column:
    width = F.coalesce(col(interval), col(to_m) - col(from_m))
    return F.when(is_number(width) & (width > 0), width)


def zone_key(domain: ColumnLike) -> Column:
    """A loose zone name: words that drift between filings are dropped; no zone reads total."""
    words = F.regexp_replace(F.lower(F.coalesce(col(domain), F.lit("total"))), rf"\b({V.ZONE_NOISE})\b", " ")
    key = F.trim(F.regexp_replace(words, "[^a-z0-9]+", " "))
    return F.when(key != "", key).otherwise(F.lit("total"))
