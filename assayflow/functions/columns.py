"""Small column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: ColumnLike) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(col(value), r"^\s+|\s+$", "")


def squeeze(value: ColumnLike) -> Column:
    return strip(F.regexp_replace(col(value), r"\s+", " "))


def blank_to_null(value: ColumnLike) -> Column:
    text = strip(value)
    return F.when(text != "", text)


def lookup(mapping: Mapping[str, object], key: ColumnLike) -> Column:
    """Constant map lookup; a missing key gives null."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), col(key))


def contains_any(text: ColumnLike, needles: Iterable[str]) -> Column:
    """One alternation instead of a chain of LIKEs; needles are literal text."""
    quoted = "|".join("\\Q" + n + "\\E" for n in needles)
    return col(text).rlike(quoted)


def first_filled(*values: ColumnLike) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def pick_alias(record: ColumnLike, keys: Iterable[str]) -> Column:
    """First non-blank entry of a string map among several key spellings."""
    return first_filled(*[F.try_element_at(col(record), F.lit(k)) for k in keys])


def map_keys_by_size(mapping: ColumnLike) -> Column:
    """Map keys ordered by length and then bytes, the order a JSON object store returns them."""
    sized = F.transform(F.map_keys(col(mapping)), lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(sized), lambda s: s["k"])


def entries_by_size(mapping: ColumnLike) -> Column:
    sized = F.transform(
        F.map_entries(col(mapping)),
        lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")),
    )
    return F.array_sort(sized)


def is_number(value: ColumnLike) -> Column:
    c = col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
