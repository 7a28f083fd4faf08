"""Figures as text: column expressions behind the CSV export and the change lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .columns import ColumnLike, col, entries_by_size, is_number, lookup
from .figures import headline_npv


def number(value: ColumnLike, digits: int = 2) -> Column:
    """Thousands separators and at most ``digits`` decimals, without trailing zeros."""
    rounded = F.format_number(F.round(col(value).cast("double"), digits), digits)
    text = F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1") if digits else rounded
    text = F.regexp_replace(text, r"\.$", "")
    return F.when(is_number(col(value).cast("double")), text).otherwise(F.lit(V.DASH))


def tonnes(value: ColumnLike) -> Column:
    v = col(value).cast("double")
    scaled = (
        F.when(v >= 1e9, F.concat(number(v / 1e9), F.lit(" Bt")))
        .when(v >= 1e6, F.concat(number(v / 1e6), F.lit(" Mt")))
        .when(v >= 1e3, F.concat(number(v / 1e3), F.lit(" kt")))
        .otherwise(F.concat(number(v, 0), F.lit(" t")))
    )
    return F.when(is_number(v) & (v > 0), scaled).otherwise(F.lit(V.DASH))


def _joined(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.lit(V.DASH))


def _grade_part(key: Column, value: Column) -> Column:
    metal = F.substring_index(key, "_", 1)
    unit = F.try_element_at(F.split(key, "_"), F.lit(2))
    shown = number(value)
    return (
        F.when(unit == "pct", F.concat(shown, F.lit("% "), metal))
        .when(unit == "gpt", F.concat(shown, F.lit(" g/t "), metal))
        .when(unit == "ppm", F.concat(shown, F.lit(" ppm "), metal))
        .when(unit == "opt", F.concat(shown, F.lit(" oz/t "), metal))
        .when(unit == "mgL", F.concat(shown, F.lit(" mg/L "), metal))
        .otherwise(F.concat(shown, F.lit(" "), F.replace(key, F.lit("_"), F.lit(" "))))
    )


def grade(mapping: ColumnLike) -> Column:
    entries = F.filter(entries_by_size(mapping), lambda e: is_number(e["value"]))
    return _joined(F.transform(entries, lambda e: _grade_part(e["key"], e["value"])))


def money(millions: ColumnLike, currency: ColumnLike) -> Column:
    """Millions of a currency: 1240 USD reads US$1.24B."""
    v, code = col(millions).cast("double"), col(currency)
    size = F.abs(v)
    prefix = F.when(
        code.isNotNull() & (code != ""),
        F.coalesce(lookup(V.CURRENCY_PREFIXES, code), F.concat(code, F.lit(" "))),
    ).otherwise(F.lit("$"))
    sign = F.when(v < 0, F.lit(V.MINUS)).otherwise(F.lit(""))
    amount = (
        F.when(size >= 1000, F.concat(number(size / 1000), F.lit("B")))
        .when(size >= 100, F.concat(number(size, 0), F.lit("M")))
        .otherwise(F.concat(number(size, 1), F.lit("M")))
    )
    return F.when(is_number(v), F.concat(sign, prefix, amount)).otherwise(F.lit(V.DASH))


def npv(mapping: ColumnLike, currency: ColumnLike) -> Column:
    pick = headline_npv(mapping)
    text = F.concat(money(pick["value"], currency), F.lit(" ("), pick["basis"], F.lit(")"))
    return F.coalesce(text, F.lit(V.DASH))


def per_unit(mapping: ColumnLike) -> Column:
    shape = r"^([A-Za-z0-9]+)_usd(?:_per)?_(oz|lb|t|kg)(?:_([a-z]+))?$"

    def part(e: Column) -> Column:
        note = F.regexp_extract(e["key"], shape, 3)
        priced = F.concat(
            F.lit("US$"), number(e["value"]), F.lit("/"), F.regexp_extract(e["key"], shape, 2), F.lit(" "),
            F.regexp_extract(e["key"], shape, 1),
            F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(F.lit("")),
        )
        plain = F.concat(number(e["value"]), F.lit(" ("), F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(")"))
        return F.when(e["key"].rlike(shape), priced).otherwise(plain)

    return _joined(F.transform(F.filter(entries_by_size(mapping), lambda e: is_number(e["value"])), part))


def _scaled(v: Column, unit: Column) -> Column:
    big = lambda text, suffix: F.concat(text, F.lit(suffix))  # noqa: E731 - local shorthand
    return (
        F.when((unit == "oz") & (v >= 1e6), big(number(v / 1e6), " Moz"))
        .when(unit == "oz", big(number(v / 1e3, 0), " koz"))
        .when((unit == "lb") & (v >= 1e9), big(number(v / 1e9), " Blb"))
        .when(unit == "lb", big(number(v / 1e6, 1), " Mlb"))
        .when((unit == "t") & (v >= 1e6), big(number(v / 1e6), " Mt"))
        .when((unit == "t") & (v >= 1e3), big(number(v / 1e3, 1), " kt"))
        .when(unit == "t", big(number(v, 0), " t"))
        .when((unit == "kt") & (v >= 1e3), big(number(v / 1e3), " Mt"))
        .when(unit == "kt", big(number(v, 1), " kt"))
        .otherwise(F.concat(number(v), F.lit(" "), unit))
    )


def contained(mapping: ColumnLike) -> Column:
    entries = F.filter(entries_by_size(mapping), lambda e: is_number(e["value"]) & (e["value"] > 0))

    def part(e: Column) -> Column:
        split = e["key"].rlike("._")
        name = F.when(split, F.regexp_replace(e["key"], "_[^_]*$", "")).otherwise(e["key"])
        unit = F.when(split, F.substring_index(e["key"], "_", -1)).otherwise(F.lit(""))
        return F.concat(_scaled(e["value"], unit), F.lit(" "), name)

    return _joined(F.transform(entries, part))


def age(moment: ColumnLike, as_of: ColumnLike) -> Column:
    """Compact age: 12 min, 5h, 2d."""
    seconds = F.unix_timestamp(col(as_of).cast("timestamp")) - F.unix_timestamp(col(moment).cast("timestamp"))
    minutes = F.greatest(F.lit(0), F.round(seconds / 60).cast("long"))
    hours = F.round(minutes / 60).cast("long")
    text = (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.round(hours / 24).cast("long").cast("string"), F.lit("d")))
    )
    return F.coalesce(text, F.lit(V.DASH))


def iso(value: ColumnLike) -> Column:
    return F.coalesce(F.date_format(col(value).cast("date"), "yyyy-MM-dd"), F.lit(V.DASH))


def short_date(value: ColumnLike) -> Column:
    return F.coalesce(F.date_format(col(value).cast("date"), "MMM d"), F.lit(V.DASH))


def humanize(code: ColumnLike) -> Column:
    words = F.replace(col(code), F.lit("_"), F.lit(" "))
    text = F.concat(F.upper(F.left(words, F.lit(1))), words.substr(F.lit(2), F.length(words)))
    return F.when(col(code).isNotNull() & (col(code) != ""), text).otherwise(F.lit(V.DASH))


def source_label(code: ColumnLike) -> Column:
    return F.coalesce(lookup(V.SOURCE_LABELS, code), humanize(code))


def doc_type_label(code: ColumnLike) -> Column:
    named = F.coalesce(lookup(V.DOC_TYPE_LABELS, code), humanize(code))
    return F.when(col(code).isNotNull() & (col(code) != ""), named).otherwise(F.lit("Filing"))


def study_label(code: ColumnLike) -> Column:
    return F.coalesce(lookup(V.STUDY_LABELS, code), humanize(code))


def stage_label(code: ColumnLike) -> Column:
    studies = {k: v for k, v in V.STUDY_LABELS.items() if k != "other"}
    return F.coalesce(lookup(studies, code), humanize(code))


def category_label(code: ColumnLike) -> Column:
    return F.coalesce(lookup(V.CATEGORY_LABELS, code), humanize(code))


def grade_key_label(key: ColumnLike) -> Column:
    unit = F.substring_index(col(key), "_", -1)
    name = F.regexp_replace(col(key), "_[^_]*$", "")
    shown = F.coalesce(lookup(V.GRADE_UNIT_LABELS, unit), unit)
    return F.when(col(key).contains("_"), F.concat(name, F.lit(" ("), shown, F.lit(")"))).otherwise(col(key))


def tickers(listings: ColumnLike) -> Column:
    """array<struct(exchange, symbol)> as EXCH:SYM, the home exchange left out."""
    named = F.filter(col(listings), lambda t: t["symbol"].isNotNull() & (t["symbol"] != ""))
    foreign = lambda t: t["exchange"].isNotNull() & (t["exchange"] != "") & (t["exchange"] != "US")
    parts = F.transform(
        named,
        lambda t: F.when(foreign(t), F.concat(t["exchange"], F.lit(":"), t["symbol"])).otherwise(t["symbol"]),
    )
    return _joined(parts)
