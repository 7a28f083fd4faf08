"""HTML tables: cells by a parser inside tasks, everything after that as DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import normalize as N
from ..functions import text as T
from ..functions.columns import contains_any

CELL_SCHEMA = "document_id {key}, table_no int, row_no int, col_no int, is_header boolean, text string"


#: A tag that bears nothing but its name. Pages of such tags alone need no markup rules.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[ \t\r\n]*>")
PLAIN_NAMES = frozenset("html head body table thead tbody tfoot tr td th caption p div span br hr b i u em strong sup sub ul ol li h1 h2 h3 h4 h5 h6".split())
CELLS_PER_BATCH = 50_000


class _Cells(HTMLParser):
    """Collects (table, row, column, is header, text) in reading order, nested tables included."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.tables = 0
        self.open: list[dict] = []

    def read(self, body: str) -> list[tuple]:
        """All cells of one page. Plain pages are cut at their tags, which gives the same calls as the parser."""
        parts = PLAIN_TAG.split(body)
        names = [n.lower() for n in parts[2::3]]
        if "&" in body or "\x00" in body or len(names) != body.count("<") or not PLAIN_NAMES.issuperset(names):
            self.feed(body)
            return self.finish()
        self.handle_data(parts[0])
        for closing, name, text in zip(parts[1::3], names, parts[3::3]):
            if closing:
                self.handle_endtag(name)
            else:
                self.handle_starttag(name, ())
            if text:
                self.handle_data(text)
        return self.finish()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"no": self.tables, "row": -1, "col": -1, "text": None, "head": False})
            self.tables += 1
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1].update(row=self.open[-1]["row"] + 1, col=-1)
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            top = self.open[-1]
            top.update(col=top["col"] + 1, text=[], head=tag == "th")

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table":
            self._end_cell()
            self.open.pop()

    def handle_data(self, data):
        for table in self.open:
            if table["text"] is not None:
                table["text"].append(data)

    def _end_cell(self):
        top = self.open[-1]
        if top["text"] is not None and top["row"] >= 0:
            self.rows.append((top["no"], top["row"], top["col"], top["head"], " ".join(" ".join(top["text"]).split())))
        top["text"] = None

    def finish(self) -> list[tuple]:
        self.close()
        while self.open:
            self._end_cell()
            self.open.pop()
        return self.rows


def html_cells(pages: DataFrame, html: str = "html", tasks: int | None = None) -> DataFrame:
    """Table cells of each page. One page is parsed at a time; nothing crosses pages.

    ``tasks`` spreads few but costly pages over more tasks; large inputs arrive split already.
    """
    schema = CELL_SCHEMA.format(key=pages.schema["document_id"].dataType.simpleString())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            rows: list[tuple] = []
            for document, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(document, *cell) for cell in _Cells().read(body.as_py() or "")]
                if len(rows) >= CELLS_PER_BATCH:
                    yield _batch(rows, names, types)
                    rows = []
            if rows:
                yield _batch(rows, names, types)

    rows = pages.select("document_id", F.col(html).alias("html"))
    rows = rows.repartition(tasks, "document_id") if tasks else rows
    return rows.mapInArrow(parse, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def table_rows(cells: DataFrame) -> DataFrame:
    """One row per table row: its cells in column order and whether it holds a header cell.

    Cells are dealt by document once, which later groups by document keep.
    """
    ordered = F.sort_array(F.collect_list(F.struct("col_no", "text", "is_header")))
    rows = cells.repartition("document_id").groupBy("document_id", "table_no", "row_no").agg(ordered.alias("c"))
    heads = F.filter("c", lambda c: c["is_header"])
    return rows.select(
        "document_id", "table_no", "row_no", F.transform("c", lambda c: c["text"]).alias("cells"), F.transform(heads, lambda c: F.lower(c["text"])).alias("heads")
    )


def table_headers(rows: DataFrame) -> DataFrame:
    """Headers per table: the header cells of the first of three rows that has any, else row one."""
    early = rows.filter(F.col("row_no") < 3)
    marked = F.when(F.size("heads") > 0, F.col("row_no"))
    first = early.groupBy("document_id", "table_no").agg(
        F.min_by("heads", marked).alias("marked"),
        F.min_by(F.transform("cells", lambda c: F.lower(c)), F.col("row_no")).alias("plain"),
    )
    return first.select("document_id", "table_no", F.coalesce("marked", "plain").alias("headers"))


def classified_tables(headers: DataFrame) -> DataFrame:
    joined = F.array_join("headers", " ")
    tonnage = contains_any(joined, ("tonne", "tonnage", "kt", "mt"))
    graded = joined.contains("grade") | joined.rlike(V.GRADE_HEADER)
    classed = contains_any(joined, ("class", "category", "measured", "indicated", "inferred"))
    money = contains_any(joined, ("npv", "irr", "capex", "aisc", "payback"))
    return headers.withColumn("is_resource", tonnage & (graded | classed)).withColumn("is_economics", money)


def resource_rows(cells: DataFrame) -> DataFrame:
    """Resource rows of tables that read as resource tables: class, tonnes, grades.

    The rows of a table stay with its header, so cells are parsed and shuffled once; what a header says is worked out once a table.
    """
    rows = table_rows(cells)
    early = lambda c: F.when(F.col("row_no") < 3, c)
    tables = rows.groupBy("document_id", "table_no").agg(
        F.min_by("heads", early(F.when(F.size("heads") > 0, F.col("row_no")))).alias("marked"),
        F.min_by(F.transform("cells", lambda c: F.lower(c)), early(F.col("row_no"))).alias("plain"),
        F.collect_list(F.when((F.col("row_no") > 0) & (F.size("cells") >= 2), F.struct("row_no", "cells"))).alias("body"),
    )
    tables = tables.select("document_id", "table_no", "body", F.coalesce("marked", "plain").alias("headers"))
    tables = classified_tables(tables.filter("headers IS NOT NULL")).filter("is_resource")
    plain = lambda h: contains_any(h, ("tonne", "tonnage")) | F.trim(h).isin("mt", "kt", "ktns")
    at = F.array_position(F.transform("headers", plain), F.lit(True)).cast("int")
    tables = tables.withColumn("t_at", at).filter("t_at > 0").withColumn("factor", T.tonnes_factor(F.try_element_at("headers", F.col("t_at"))))
    keys = F.transform("headers", lambda h, i: F.struct((i + 1).alias("at"), F.when(i + 1 != F.col("t_at"), T.header_grade_key(h)).alias("key")))
    tables = tables.withColumn("named", F.filter(keys, lambda k: k["key"].isNotNull()))
    body = tables.select("document_id", "table_no", "t_at", "factor", "named", F.explode("body").alias("r"))
    body = body.select("document_id", "table_no", "t_at", "factor", "named", "r.row_no", "r.cells")
    read = F.transform("named", lambda k: F.struct(k["key"].alias("key"), T.cell_number(F.try_element_at("cells", k["at"])).alias("value")))
    body = body.withColumn("read", read).withColumn("usable", F.filter("read", lambda e: e["value"].isNotNull()))
    # A key named by two columns keeps the last one, as a map assignment would.
    rest = lambda i: F.slice("usable", i + 2, F.size("usable"))
    last = F.filter("usable", lambda e, i: ~F.exists(rest(i), lambda later: later["key"] == e["key"]))
    tonnes = T.cell_number(F.try_element_at("cells", F.col("t_at"))) * F.col("factor")
    out = body.select(
        "document_id", "table_no", "row_no", T.row_class(F.array_join("cells", " ")).alias("category"), F.lit(None).cast("string").alias("domain"), tonnes.alias("tonnes"),
        F.lit(None).cast("string").alias("tonnage_unit"), F.map_from_entries(last).alias("grade"), F.create_map().cast("map<string,double>").alias("contained_metal"),
        F.lit(V.TABLE_CONFIDENCE).alias("extraction_confidence"),
    )
    names = F.array(*[F.lit(name) for name in sorted({name for _, name in V.ROW_CLASSES})])
    classes = cells.sparkSession.range(1).select(F.explode(names).alias("category"))
    return N.validate_resources(out.filter(F.col("category").isNotNull() & F.col("tonnes").isNotNull()), classes)


def economics_rows(cells: DataFrame) -> DataFrame:
    """Study figures from two-column rows; the last of repeated labels wins. One row a document,
    only where a value, a rate of return or a capital figure was found."""
    rows = table_rows(cells).filter(F.size("cells") >= 2)
    pairs = rows.select(
        "document_id", F.lower(F.try_element_at("cells", F.lit(1))).alias("key"), F.try_element_at("cells", F.lit(2)).alias("value"), "table_no", "row_no"
    )
    last = pairs.groupBy("document_id", "key").agg(F.max_by("value", F.struct("table_no", "row_no")).alias("value"), F.min(F.struct("table_no", "row_no")).alias("at"))
    key, number = F.col("key"), T.cell_number("value")
    npv = key.contains("npv") & number.isNotNull() & contains_any(key, ("post-tax", "pre-tax", "after-tax"))
    rate = F.regexp_extract(key, r"(\d+(?:\.\d+)?)\s*%", 1)
    basis = F.when(key.contains("pre-tax"), F.lit("pre_tax")).otherwise(F.lit("post_tax"))
    npv_key = F.when(rate != "", F.concat(basis, F.lit("_"), rate, F.lit("pct"))).otherwise(basis)
    kind = (
        F.when(npv, F.lit("npv"))
        .when(F.trim(key).isin("irr", "after-tax irr", "post-tax irr") & number.isNotNull(), F.lit("irr"))
        .when(contains_any(key, ("capex", "initial capital")), F.lit("capex"))
        .when(key.contains("aisc") & number.isNotNull(), F.lit("aisc"))
        .when(key.contains("mine life"), F.lit("life"))
        .when(key.contains("payback"), F.lit("payback"))
        .when(key.contains("currency") & (F.length(F.trim("value")) == 3), F.lit("currency"))
        .when(key.contains("pea"), F.lit("pea"))
        .when(contains_any(key, ("pfs", "pre-feasibility")), F.lit("pfs"))
        .when(key.rlike(r"\bfs\b|feasibility"), F.lit("fs"))
    )
    read = last.withColumn("kind", kind).withColumn("number", number).withColumn("npv_key", npv_key).filter("kind IS NOT NULL")
    latest = lambda k, c: F.max_by(c, F.when(F.col("kind") == k, F.col("at")))
    study = F.max_by("kind", F.when(F.col("kind").isin("pea", "pfs", "fs"), F.col("at")))
    npv_list = F.array_sort(F.collect_list(F.when(F.col("kind") == "npv", F.struct("npv_key", "at", "number"))))
    found = read.groupBy("document_id").agg(
        npv_list.alias("n"), latest("irr", "number").alias("irr_pct"), latest("capex", "number").alias("capex_initial"),
        latest("aisc", "number").alias("_aisc"), latest("life", "number").alias("mine_life_years"), latest("payback", "number").alias("payback_years"),
        F.upper(F.trim(latest("currency", "value"))).alias("currency"), study.alias("study_type"),
    )
    last_npv = F.filter("n", lambda e, i: ~F.coalesce(F.try_element_at(F.col("n"), i + 2)["npv_key"] == e["npv_key"], F.lit(False)))
    shaped = found.select(
        "document_id", "study_type", "currency", F.map_from_entries(F.transform(last_npv, lambda e: F.struct(e["npv_key"].alias("key"), e["number"].alias("value")))).alias("npv"),
        "irr_pct", "capex_initial", F.when(F.col("_aisc").isNotNull(), F.create_map(F.lit("aisc"), F.col("_aisc"))).alias("aisc"),
        "mine_life_years", "payback_years", F.lit(V.TABLE_CONFIDENCE).alias("extraction_confidence"),
    )
    kept = shaped.filter((F.size("npv") > 0) | F.col("irr_pct").isNotNull() | F.col("capex_initial").isNotNull())
    return N.validate_economics(kept)
