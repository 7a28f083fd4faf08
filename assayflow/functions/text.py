"""Text rules: headings, hints, identifiers in titles, citations, number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .columns import ColumnLike, blank_to_null, col, contains_any, lookup, strip
from .normalize import cik


def without_nuls(value: ColumnLike) -> Column:
    return F.replace(col(value), F.lit("\u0000"), F.lit(""))


def heading(value: ColumnLike) -> Column:
    """The section heading a block opens with, or null when its first line is not one."""
    line = F.regexp_extract(strip(value), r"^([^\r\n]*)", 1)
    found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in V.HEADING_PATTERNS]
    title = F.left(strip(F.coalesce(*found)), F.lit(200))
    return F.when(F.length(line).between(1, V.HEADING_CHARS), title)


def table_block(rows: ColumnLike) -> Column:
    """array<array<string>> as tab-separated lines; rows without any text are dropped."""
    filled = F.filter(col(rows), lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    line = lambda r: F.array_join(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), "\t")
    return F.array_join(F.transform(filled, line), "\n")


def is_low_text(value: ColumnLike) -> Column:
    return F.length(strip(F.coalesce(col(value), F.lit("")))) < V.LOW_TEXT_CHARS


def estimated_tokens(value: ColumnLike) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(value)) / V.CHARS_PER_TOKEN)).cast("long")


def is_contents_page(value: ColumnLike) -> Column:
    """More than a third of the lines end in dot leaders and a page number."""
    lines = F.split(F.regexp_replace(col(value), r"\n$", ""), r"\r\n|\n|\r")
    leaders = F.filter(lines, lambda l: l.rlike(V.TOC_LINE))
    return col(value).rlike(V.TOC_LINE) & (F.size(leaders) * 3 > F.size(lines))


def fingerprint(value: ColumnLike) -> Column:
    head = F.left(col(value), F.lit(500))
    return F.when(head != "", F.sha2(head, 256))


def event_type(doc_type: ColumnLike, title: ColumnLike, summary: ColumnLike) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(summary), F.lit(""))))
    kind = F.lower(F.coalesce(col(doc_type), F.lit("")))
    news = (kind == "mda") | kind.contains("press")
    return (
        F.when(news & contains_any(text, V.DRILL_EVENT_WORDS), F.lit("drill_results"))
        .when(news & contains_any(text, V.FINANCING_EVENT_WORDS), F.lit("financing"))
        .otherwise(F.lit("new_report"))
    )


# --- identifiers -----------------------------------------------------------------------------

_TITLE = r"(?i)^(.+?)(?:\s+\(([A-Z][A-Z0-9.]{0,6})\))?\s*(?:\(CIK\s+(\d+)\))?\s*$"


def title_identity(title: ColumnLike) -> Column:
    """struct(name, ticker, cik) read from a title such as ``Name (TICK) (CIK 0001)``."""
    text = strip(title)
    part = lambda n: blank_to_null(F.regexp_extract(text, _TITLE, n))
    matched = text.rlike(_TITLE)
    return F.struct(
        F.when(matched, part(1)).otherwise(blank_to_null(text)).alias("name"),
        F.when(matched, part(2)).alias("ticker"),
        F.when(matched, cik(part(3))).alias("cik"),
    )


def document_cik(title: ColumnLike, *paths: ColumnLike) -> Column:
    in_title = F.regexp_extract(col(title), r"(?i)CIK\s+(\d{1,10})", 1)
    in_paths = [F.regexp_extract(col(p), r"edgar/(\d{1,10})/", 1) for p in paths]
    return F.coalesce(*[cik(F.nullif(c, F.lit(""))) for c in (in_title, *in_paths)])


def filing_identity(source: ColumnLike, title: ColumnLike, url: ColumnLike) -> Column:
    """struct(name, cik, ticker) a filing row carries reliably; all null when it carries nothing."""
    parts = title_identity(title)
    several = r"^(.*?)\s*\(([A-Z0-9.,\s-]+)\)\s*$"
    listed = parts["name"].rlike(several)
    name = F.when(listed, strip(F.regexp_extract(parts["name"], several, 1))).otherwise(parts["name"])
    first = strip(F.substring_index(F.regexp_extract(parts["name"], several, 2), ",", 1))
    ticker = F.coalesce(parts["ticker"], F.when(listed, first))
    in_url = F.regexp_extract(col(url), r"/edgar/data/(\d{1,10})/", 1)
    number = F.coalesce(parts["cik"], cik(F.nullif(in_url, F.lit(""))))
    complete = (col(source) == "edgar") & number.isNotNull() & (name != "")
    report = r"(?i)^(.+?)\s+[—-]\s+(Technical report|Amended technical report)"
    other = blank_to_null(F.regexp_extract(strip(title), report, 1))
    return F.struct(
        F.when(complete, name).when(col(source) != "edgar", other).alias("name"),
        F.when(complete, number).alias("cik"),
        F.when(complete, ticker).alias("ticker"),
    )


# --- citations ---------------------------------------------------------------------------------

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
CITATION = rf"(?i)\[({_UUID})\s+p\.(\d+)(?:-(\d+))?\]"


def page_label(start: ColumnLike, end: ColumnLike) -> Column:
    first, last = col(start), col(end)
    span = F.concat_ws("-", first.cast("string"), last.cast("string"))
    return (
        F.when(first.isNull(), F.lit("n/a"))
        .when(last.isNotNull() & (last != first), span)
        .otherwise(first.cast("string"))
    )


def citation_label(document_id: ColumnLike, start: ColumnLike, end: ColumnLike) -> Column:
    return F.concat(
        F.lit("["), F.left(col(document_id), F.lit(8)), F.lit(" p."), page_label(start, end), F.lit("]")
    )


def citation_link(document_id: ColumnLike, start: ColumnLike) -> Column:
    page = F.coalesce(col(start), F.lit(1)).cast("string")
    return F.concat(F.lit("/documents/"), col(document_id), F.lit("?page="), page)


def citations(value: ColumnLike) -> Column:
    """array<struct(label, document_id, page_start, page_end)> in order, one per label."""
    pieces = [F.regexp_extract_all(col(value), F.lit(CITATION), F.lit(n)) for n in (1, 2, 3)]
    zipped = F.arrays_zip(pieces[0].alias("d"), pieces[1].alias("a"), pieces[2].alias("b"))

    def cite(z: Column) -> Column:
        start = z["a"].cast("int")
        end = F.coalesce(F.nullif(z["b"], F.lit("")).cast("int"), start)
        return F.struct(
            citation_label(z["d"], start, end).alias("label"),
            z["d"].alias("document_id"), start.alias("page_start"), end.alias("page_end"),
        )

    made = F.transform(zipped, cite)
    labels = F.transform(made, lambda c: c["label"])
    return F.filter(made, lambda c, i: F.array_position(labels, c["label"]) == i + 1)


def citation_labels(value: ColumnLike) -> Column:
    return F.transform(citations(value), lambda c: c["label"])


# --- table cells ------------------------------------------------------------------------------


def cell_number(value: ColumnLike) -> Column:
    """A printed number: separators dropped, parentheses negative, dashes null."""
    text = F.replace(F.replace(strip(value), F.lit("\u00a0"), F.lit(" ")), F.lit(","), F.lit(""))
    found = F.regexp_extract(text, V.CELL_NUMBER, 0)
    plain = F.replace(F.translate(found, " +)\t\n", ""), F.lit("("), F.lit("-"))
    blank = text.isin("", "-", "—", "n/a", "na", "nil")
    return F.when(~blank, plain.try_cast("double"))


def tonnes_factor(header: ColumnLike) -> Column:
    h = col(header)
    return (
        F.when(contains_any(h, ("mt", "million")), F.lit(1e6))
        .when(contains_any(h, ("kt", "thousand")), F.lit(1e3))
        .otherwise(F.lit(1.0))
    )


def header_grade_key(header: ColumnLike) -> Column:
    raw = F.lower(F.regexp_extract(col(header), V.GRADE_HEADER, 1))
    metal = F.coalesce(lookup(V.OXIDES, raw), F.initcap(raw))
    printed = F.lower(F.regexp_extract(col(header), V.GRADE_HEADER, 2))
    unit = F.coalesce(
        lookup(V.HEADER_UNITS, printed),
        F.when(F.upper(metal).isin(*V.GRAM_METALS), F.lit("gpt")).otherwise(F.lit("pct")),
    )
    return F.when(raw != "", F.concat(metal, F.lit("_"), unit))


def row_class(value: ColumnLike) -> Column:
    """The first class word found in a fixed order, so a combined label reads as its first word."""
    text = F.lower(col(value))
    rule = None
    for needle, name in V.ROW_CLASSES:
        rule = F.when(text.contains(needle), F.lit(name)) if rule is None else rule.when(text.contains(needle), F.lit(name))
    return rule


def label_type(label: ColumnLike) -> Column:
    """Document type by the first needle contained in a label."""
    text = F.lower(F.coalesce(col(label), F.lit("")))
    rule = None
    for needle, name in V.LABEL_TYPES:
        rule = F.when(text.contains(needle), F.lit(name)) if rule is None else rule.when(text.contains(needle), F.lit(name))
    return rule.otherwise(F.lit(V.DEFAULT_LABEL_TYPE))


def plain_name(value: ColumnLike) -> Column:
    """A name for matching: former names dropped, letters and digits only."""
    current = F.regexp_replace(col(value), r"(?i)\(formerly [^)]*\)", "")
    return F.trim(F.regexp_replace(F.lower(current), "[^a-z0-9]+", " "))


def profile_digits(value: ColumnLike) -> Column:
    return F.regexp_replace(strip(value), "^0+", "")


def plain_words(value: ColumnLike) -> Column:
    """Letters and digits in lower case, stop words out."""
    raw = F.split(F.lower(col(value)), r"[^a-z0-9]+")
    return F.filter(raw, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def words(value: ColumnLike) -> Column:
    """Search words: plain words after a light plural and suffix rule."""
    return F.transform(plain_words(value), stem)


# Fixed list: common English words that carry no meaning in a search.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its",
    "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "which", "will", "with",
)
STEM_RULES = (("ies$", "y"), ("(ing|ed)$", ""), ("s$", ""))


def stem(word: Column) -> Column:
    """Suffix rules on words longer than four letters; not a full English stemmer."""
    out = word
    for pattern, replacement in STEM_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(F.length(word) > 4, out).otherwise(word)


def matched_title(title: ColumnLike) -> Column:
    return contains_any(F.lower(col(title)), V.TITLE_WORDS)


