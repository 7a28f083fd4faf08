"""Registered source-parsing queries: payloads are built from the driver tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import feeds, hits, html, lists, manifests
from ..functions.text import label_type
from .driver_views import DriverViews, duck_sql
from .registry import query


def _hit_pages(v: DriverViews):
    """Ten hits a page. Some lack a colon in the id, some a cik, some a declared type."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    hit = F.struct(
        F.when(key % 23 == 0, F.concat(F.lit("broken"), text)).otherwise(F.concat(F.lit("000-"), text, F.lit("-26:ex"), F.when(key % 4 == 0, F.lit("-96_")).otherwise(F.lit("_")), text, F.when(key % 7 == 0, F.lit(".txt")).otherwise(F.lit(".htm")))).alias("_id"),
        F.struct(
            F.when(key % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lpad(F.col("o_custkey").cast("string"), 10, "0"))).alias("ciks"),
            F.array(F.concat(F.lit("Filer "), F.col("o_custkey").cast("string"))).alias("display_names"),
            F.when(key % 3 == 0, F.array(F.lit("10-K"))).otherwise(F.array().cast("array<string>")).alias("root_forms"),
            F.when(key % 3 == 1, F.lit("6-K")).otherwise(F.lit("S-1")).alias("form"),
            F.element_at(F.array(F.lit("EX-96.1"), F.lit("EX-99"), F.lit(""), F.lit("ex961")), (key % 4 + 1).cast("int")).alias("file_type"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"),
            F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), (F.col("o_custkey") % 2000).cast("string"))).alias("sics"),
        ).alias("_source"),
    )
    rows = v.table("orders").select((key / 10).cast("long").alias("page"), key.alias("k"), hit.alias("hit"))
    grouped = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "hit"))), lambda s: s["hit"]).alias("hits"))
    return grouped.select("page", F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("payload"))


_HITS = """h AS (SELECT o_orderkey AS k, '000-' || o_orderkey || '-26' AS accession, 'ex' || CASE WHEN o_orderkey % 4 = 0 THEN '-96_' ELSE '_' END || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.htm' END AS filename,
    lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN o_orderkey % 3 = 0 THEN '10-K' WHEN o_orderkey % 3 = 1 THEN '6-K' ELSE 'S-1' END AS form,
    ['EX-96.1','EX-99','','ex961'][CAST(o_orderkey % 4 + 1 AS INT)] AS file_type, 'Filer ' || o_custkey AS title, CAST(o_orderdate AS DATE) AS filed_at,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 2000 AS INT) END AS sic, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/000' || o_orderkey || '26/' || 'ex' || CASE WHEN o_orderkey % 4 = 0 THEN '-96_' ELSE '_' END || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.htm' END AS url
  FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0),
known AS (SELECT accession || ':' || filename AS external_id FROM h WHERE k % 6 = 1),
placed AS (SELECT h.*, accession || ':' || filename AS external_id,
    CASE WHEN NOT (file_type = 'EX-96.1' OR (file_type = '' AND regexp_matches(filename, '(?i)ex-?96'))) THEN 'skipped_file_type'
         WHEN NOT regexp_matches(lower(filename), '\\.(pdf|htm|html)$') THEN 'skipped_unsupported'
         WHEN accession || ':' || filename IN (SELECT external_id FROM known) THEN 'skipped_known' ELSE 'ingested' END AS strict,
    CASE WHEN file_type IN ('EX-96.1','ex961') OR (file_type = '' AND regexp_matches(filename, '(?i)ex-?96')) THEN 'sk1300' WHEN form = '10-K' THEN 'financials' WHEN form = '6-K' THEN 'press_release' ELSE 'sk1300' END AS doc_type FROM h),
open_gate AS (SELECT *, CASE WHEN NOT (file_type IN ('EX-96.1','ex961') OR (file_type = '' AND regexp_matches(filename, '(?i)ex-?96'))) AND sic IS NOT NULL AND sic NOT BETWEEN 1000 AND 1099 THEN 'skipped_sic'
         WHEN NOT regexp_matches(lower(filename), '\\.(pdf|htm|html)$') THEN 'skipped_unsupported' WHEN external_id IN (SELECT external_id FROM known) THEN 'skipped_known' ELSE 'ingested' END AS disposition FROM placed)"""


@query("s01_hits", duck_sql("SELECT external_id, cik, form, file_type, title, filed_at, sic, url FROM placed", ctes=_HITS))
def _(v: DriverViews):
    return hits.parse_hits(_hit_pages(v)).select("external_id", "cik", "form", "file_type", "title", "filed_at", "sic", "url")


def _known_hits(found):
    return found.filter(F.regexp_extract("accession", r"-(\d+)-", 1).cast("long") % 6 == 1).select("external_id")


@query("s02_allowlist", duck_sql("SELECT external_id, strict AS disposition, doc_type FROM placed", ctes=_HITS))
def _(v: DriverViews):
    found = hits.parse_hits(_hit_pages(v))
    return hits.with_disposition(found, _known_hits(found), hits.parse_file_types(None)).select("external_id", "disposition", "doc_type")


@query("s03_dispositions", duck_sql("SELECT disposition, count(*) AS n FROM open_gate GROUP BY 1", ctes=_HITS))
def _(v: DriverViews):
    found = hits.parse_hits(_hit_pages(v))
    return hits.with_disposition(found, _known_hits(found), hits.parse_file_types("all")).groupBy("disposition").agg(F.count("*").alias("n"))


@query(
    "s05_feed_items",
    "SELECT event_id, 'http://wire/' || event_id AS guid, CAST(ts AS DATE) AS filed_at, event_type = 'view' AS on_topic FROM events WHERE user_id % 10 <> 0",
)
def _(v: DriverViews):
    link = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit(" http://wire/"), F.col("event_id").cast("string")))
    title = F.when(F.col("event_type") == "view", F.lit("Gold Drill results")).otherwise(F.lit("Quarterly letter"))
    items = v.table("events").select(
        link.alias("link"), title.alias("title"), F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0500")).alias("pubDate"), F.lit(None).cast("string").alias("guid")
    )
    rows = feeds.on_topic(feeds.parse_items(items))
    return rows.select(F.regexp_extract("guid", r"(\d+)$", 1).cast("long").alias("event_id"), "guid", "filed_at", "on_topic")


@query("s16_topic_counts", "SELECT regexp_matches(lower(text), 'drill|intercept|ni 43-101|sk-1300|resource|reserve|mine|mining|gold|copper|lithium|uranium|nickel') AS on_topic, count(*) AS n FROM documents GROUP BY 1")
def _(v: DriverViews):
    return feeds.topic_counts(v.documents.select(F.col("text").alias("title")))


def _index_files(v: DriverViews):
    """Index files of both layouts, one per customer; odd customers use the export layout."""
    kb = F.floor(F.col("o_totalprice") / 100).cast("long")
    number = F.when(F.col("o_custkey") % 4 != 0, F.lpad(F.col("o_custkey").cast("string"), 9, "0")).otherwise(F.lit(""))
    doc = F.concat(F.lit('"Report, '), F.col("o_orderkey").cast("string"), F.lit('.pdf"'))
    manifest = F.concat_ws(",", F.lit("1"), F.concat(F.lit("Issuer "), "o_custkey"), number, doc, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("10:15:00"), F.lit("Ontario"), kb.cast("string"))
    bracket = F.when(number != "", F.concat(F.lit(" (00"), number, F.lit(")"))).otherwise(F.lit(""))
    export = F.concat_ws(
        ",", F.concat(F.lit("Issuer "), "o_custkey", F.lit(" / Issuer "), "o_custkey", bracket), doc,
        F.concat(F.date_format("o_orderdate", "EEE MMM dd"), F.lit(" 10:15:00 EST "), F.date_format("o_orderdate", "yyyy")), F.lit("Ontario"), F.concat(F.lit('"'), F.format_number(kb, 0), F.lit(' KB"')),
    )
    odd = F.col("o_custkey") % 2 == 1
    rows = v.table("orders").select("o_custkey", odd.alias("odd"), F.when(odd, export).otherwise(manifest).alias("line"), "o_orderkey")
    head = F.when(F.col("odd"), F.lit("Profile(s),Document,Submitted date,Principal jurisdiction,File size")).otherwise(
        F.lit("page,profile_name,profile_number,document,submitted_date,submitted_time_et,principal_jurisdiction,file_size_kb")
    )
    files = rows.groupBy("o_custkey", "odd").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("ls"))
    body = F.concat_ws("\n", F.lit("Search export"), F.lit(""), head, F.array_join(F.transform("ls", lambda s: s["line"]), "\n"))
    return files.select(F.concat(F.lit("file"), "o_custkey").alias("path"), body.alias("body"))


_INDEX = """rows AS (SELECT o_orderkey, 'Issuer ' || o_custkey AS profile_name, CASE WHEN o_custkey % 4 <> 0 THEN CASE WHEN o_custkey % 2 = 1 THEN '00' ELSE '' END || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE '' END AS profile_number,
    'Report, ' || o_orderkey || '.pdf' AS document, CAST(o_orderdate AS DATE) AS submitted_date, '10:15:00' AS submitted_time, CAST(floor(o_totalprice / 100) AS BIGINT) AS file_size_kb FROM orders)"""


@query("s06_index_rows", duck_sql("SELECT profile_name, profile_number, document, submitted_date, submitted_time, file_size_kb FROM rows", ctes=_INDEX))
def _(v: DriverViews):
    rows = manifests.parse_index(_index_files(v))
    return rows.select("profile_name", "profile_number", "document", "submitted_date", "submitted_time", "file_size_kb")


@query("s07_merged_index", duck_sql("SELECT document, profile_number FROM rows", ctes=_INDEX))
def _(v: DriverViews):
    rows = manifests.parse_index(_index_files(v))
    again = rows.withColumns({"path": F.concat(F.lit("copy of "), "path"), "profile_number": F.lit(""), "profile_name": F.upper("profile_name")})
    return manifests.merge_index(again.unionByName(rows)).select("document", "profile_number")


@query(
    "s08_members",
    """SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS profile_number, 'Issuer ' || o_custkey AS company, CASE WHEN o_orderkey % 2 = 0 THEN '065' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') ELSE '' END AS filing_id, 'Doc ' || o_orderkey || '.pdf' AS document FROM orders""",
)
def _(v: DriverViews):
    key = F.col("o_orderkey").cast("string")
    folder = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/065"), F.lpad(key, 6, "0"), F.lit(" TECHNICAL_REPORT/1"))).otherwise(F.lit("/loose"))
    path = F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" Issuer "), "o_custkey", folder, F.lit("/Doc "), key, F.lit(".pdf (0a1b2c3d4e)"))
    return v.table("orders").select("o_orderkey", manifests.parse_member(path).alias("m")).select("o_orderkey", "m.*")


@query(
    "s09_discovery",
    """SELECT doc_id, 'Big Co' AS issuer, CASE WHEN doc_id % 5 = 0 THEN 'press_release' ELSE 'ni43101' END AS doc_type FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND lang <> 'fr'""",
)
def _(v: DriverViews):
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit(".")).otherwise(F.lit("")), F.when(F.col("doc_id") % 5 == 0, F.lit("news ")).otherwise(F.lit("Technical report ")), F.when(F.col("lang") == "fr", F.lit("French ")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".pdf"))
    magic = F.when(F.col("doc_id") % 3 == 0, F.lit("PK..")).otherwise(F.lit("%PDF")).cast("binary")
    files = v.documents.select(F.concat(F.lit("file:/in/000012 Big Co./"), name).alias("path"), F.col("n_chars").alias("size_bytes"), magic.alias("magic"))
    found = manifests.discover_pdfs(files, "/in")
    return found.select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("doc_id"), "issuer", "doc_type")


_LABELS = ("NI 43-101 Report", "Annual Information Form", "PEA summary", "Pre-Feasibility Study", "Feasibility", "News release - French", "MD&A", "Other")
_TYPES = ("ni43101", "financials", "pea", "pfs", "fs", "press_release", "mda", "ni43101")


@query("s10_label_types", "SELECT o_orderkey, " + str(list(_TYPES)) + "[CAST(o_orderkey % 8 + 1 AS INT)] AS doc_type FROM orders")
def _(v: DriverViews):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return v.table("orders").select("o_orderkey", label_type(label).alias("doc_type"))


@query(
    "s11_issuers",
    """SELECT c_custkey, c_custkey % 9 = 0 AS skipped, CASE WHEN c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' THEN true ELSE c_name IN (SELECT c_name FROM customer WHERE c_nationkey = 3) END AS active FROM customer""",
)
def _(v: DriverViews):
    industry = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Metals trading")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("Gold")).otherwise(F.lit(""))
    raw = v.table("customer").select(
        F.col("c_custkey").cast("string").alias("Id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey").cast("string")).alias("Profile Number"), F.col("c_name").alias(" Legal Name"), industry.alias("Sector"),
    )
    watched = v.table("customer").filter("c_nationkey = 3").select(F.lower("c_name"))
    records = lists.as_records(raw)
    rows = lists.parse_issuers(records, watched)
    return rows.select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("c_custkey"), "skipped", "active")


@query(
    "s12_occurrences",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) * 2 AS lat, p_brand AS region, 'Canada' AS country, 'Au|Cu' AS commodities, p_size > 45 OR p_partkey % 8 = 0 AS skipped FROM part""",
)
def _(v: DriverViews):
    raw = v.table("part").select(
        F.col("p_partkey").cast("string").alias("MINFILE Number"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_name")).alias("Site Name"), (F.col("p_size") * 2.0).cast("string").alias("Latitude"),
        F.lit("-1,20.5").alias("Longitude"), F.col("p_brand").alias("Mining Division"), F.lit("gold; Copper").alias("Commod1"), F.lit("Au").alias("commod2"),
    )
    rows = lists.parse_occurrences(lists.as_records(raw), "minfile")
    return rows.select(F.col("external_id").cast("long").alias("p_partkey"), "lat", "region", "country", F.array_join("commodities", "|").alias("commodities"), "skipped")


def _result_pages(v: DriverViews):
    key = F.col("o_orderkey")
    text = key.cast("string")
    head = F.when(key % 4 == 0, F.concat(F.lit('"issuer":{"Name":"Issuer '), text, F.lit('","number":"N'), text, F.lit('"},'))).otherwise(F.concat(F.lit('"profileName":"Issuer '), text, F.lit(" (P"), text, F.lit(')",')))
    name = F.when(key % 9 == 0, F.lit("")).otherwise(F.concat(F.lit('"documentTitle":"Feasibility '), text, F.lit('",')))
    row = F.concat(F.lit("{"), head, name, F.lit('"GUID":"g'), text, F.lit('","filingDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T09:00","fileUrl":"http://f/'), text, F.lit('"}'))
    rows = v.table("orders").select((key / 5).cast("long").alias("page"), key.alias("k"), row.alias("row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda s: s["row"]), ",")
    pages = rows.groupBy("page").agg(joined.alias("rows"))
    body = (
        F.when(F.col("page") % 3 == 0, F.concat(F.lit('{"data":{"items":['), "rows", F.lit("]}}")))
        .when(F.col("page") % 3 == 1, F.concat(F.lit('{"results":['), "rows", F.lit("]}")))
        .otherwise(F.concat(F.lit("["), "rows", F.lit("]")))
    )
    return pages.select("page", F.when(F.col("page") % 50 == 7, F.lit('{"oops":1}')).otherwise(body).alias("payload"))


@query(
    "s13_results",
    """SELECT CASE WHEN k % 4 = 0 THEN 'Issuer ' || k ELSE 'Issuer ' || k || ' (P' || k || ')' END AS profile_name, CASE WHEN k % 4 = 0 THEN 'N' || k ELSE 'P' || k END AS profile_number,
              CASE WHEN k % 9 <> 0 THEN 'Feasibility ' || k END AS document_name, 'g' || k AS external_id, CAST(CAST(d AS DATE) AS VARCHAR) AS filed, 'http://f/' || k AS download_url,
              CASE WHEN k % 9 = 0 THEN 'ni43101' ELSE 'fs' END AS doc_type, CASE WHEN k % 9 = 0 THEN 'no document name' END AS contract_error
       FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM orders WHERE (o_orderkey // 5) % 50 <> 7)
       UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'ni43101', 'no result list' FROM (SELECT DISTINCT o_orderkey // 5 FROM orders WHERE (o_orderkey // 5) % 50 = 7)""",
)
def _(v: DriverViews):
    rows = lists.parse_results(lists.result_rows(_result_pages(v)))
    return rows.select("profile_name", "profile_number", "document_name", "external_id", "filed", "download_url", "doc_type", "contract_error")


@query(
    "s13b_mail_links",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'https://x.sedarplus.ca/f/' || conv_id ELSE 'http://news.example/a' END AS link FROM conversations""",
)
def _(v: DriverViews):
    special = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<a href="https://x.sedarplus.ca/f/'), F.col("conv_id").cast("string"), F.lit('">'))).otherwise(F.lit(""))
    link = feeds.mail_link(F.lit("see http://news.example/a)."), F.col("text"), special)
    return v.table("conversations").select("conv_id", "turn", link.alias("link"))


# --- HTML tables -------------------------------------------------------------------------------------


def _tasks(v: DriverViews) -> int:
    """Pages cost more to parse than their size tells: dealt to a fixed number of tasks, not to one for so many MB."""
    return max(v.spark.sparkContext.defaultParallelism, int(v.spark.conf.get("spark.sql.shuffle.partitions")))


def _html_pages(v: DriverViews):
    """A page per order: one resource table of its lines, one table without a tonnage column."""
    line = F.concat(
        F.lit("<tr><td>"), F.initcap("category"), F.lit("</td><td>"), F.format_number(F.col("tonnes") / 1000, 5), F.lit("</td><td> "),
        F.coalesce(F.try_element_at("grade", F.lit("Au_gpt")).cast("string"), F.lit("n/a")), F.lit("</td><td>"), F.coalesce(F.try_element_at("grade", F.lit("Cu_pct")).cast("string"), F.lit("—")), F.lit("</td></tr>"),
    )
    rows = v.resources.filter("category IN ('measured','indicated','inferred')").select("document_id", "estimate_id", line.alias("line"))
    rows = rows.repartition(_tasks(v), "document_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("estimate_id", "line"))), lambda s: s["line"]), "\n")
    head = F.lit("<html><table><tr><th>Class</th><th>Tonnage (kt)</th><th>Au\n (g/t)</th><th>Cu %</th></tr>")
    tail = F.lit("</table><table><tr><td>Person</td><td>Role</td></tr><tr><td>Measured</td><td>5</td></tr></table></html>")
    return rows.groupBy("document_id").agg(F.concat(head, joined, tail).alias("html"))


_ROWS = "tab AS (SELECT estimate_id, document_id, category, tonnes, au, cu FROM resources WHERE category IN ('measured','indicated','inferred'))"


@query("t10_cells", duck_sql("SELECT document_id, 4 * (count(*) + 1) + 4 AS cells, 2 AS tables FROM tab GROUP BY 1", "resources", ctes=_ROWS))
def _(v: DriverViews):
    cells = html.html_cells(_html_pages(v))
    return cells.groupBy("document_id").agg(F.count("*").alias("cells"), F.count_distinct("table_no").cast("int").alias("tables"))


@query(
    "t14_resource_tables",
    duck_sql("SELECT document_id, category, round(tonnes, 2) AS tonnes, au, cu, CAST(least(0.9, CASE WHEN tonnes <= 0 THEN 0.3 WHEN tonnes < 10000 THEN 0.5 END) AS DOUBLE) AS extraction_confidence FROM tab", "resources", ctes=_ROWS),
)
def _(v: DriverViews):
    rows = html.resource_rows(html.html_cells(_html_pages(v)))
    grade = lambda k, n: F.try_element_at("grade", F.lit(k)).alias(n)
    return rows.select("document_id", "category", F.round("tonnes", 2).alias("tonnes"), grade("Au_gpt", "au"), grade("Cu_pct", "cu"), "extraction_confidence")


@query(
    "t15_economics_tables",
    """SELECT o_orderkey AS document_id, CAST(o_custkey AS DOUBLE) AS npv_5, CASE WHEN o_custkey % 2 = 0 THEN 12.5::DOUBLE END AS irr_pct, CAST(o_orderkey % 90 AS DOUBLE) AS capex_initial, 'USD' AS currency, 'pfs' AS study_type FROM orders""",
)
def _(v: DriverViews):
    pair = lambda k, value: F.concat(F.lit(f"<tr><td>{k}</td><td>"), value, F.lit("</td></tr>"))
    page = F.concat(
        F.lit("<table>"), pair("Post-Tax NPV (5%)", F.lit("1")), pair("Initial capex (US$M)", F.col("o_orderkey").cast("string")),
        F.when(F.col("o_custkey") % 2 == 0, pair("After-tax IRR", F.lit("12.5 %"))).otherwise(F.lit("")), pair("Currency", F.lit(" usd ")), pair("PFS level", F.lit("yes")),
        F.lit("</table><table>"), pair("post-tax npv (5%)", F.format_number("o_custkey", 0)), pair("Initial capex (us$m)", (F.col("o_orderkey") % 90).cast("string")), F.lit("</table>"),
    )
    pages = v.table("orders").select(F.col("o_orderkey").alias("document_id"), page.alias("html"))
    rows = html.economics_rows(html.html_cells(pages, tasks=_tasks(v)))
    return rows.select("document_id", F.try_element_at("npv", F.lit("post_tax_5pct")).alias("npv_5"), "irr_pct", "capex_initial", "currency", "study_type")


@query("t10_page_cells", "SELECT page_id AS document_id, 4::BIGINT AS cells, 2 AS tables, len(url)::BIGINT AS url_length, len(html) - len(replace(html, '<', '')) AS marks FROM pages")
def _(v: DriverViews):
    """The driver's own pages hold no tables, so each gets two around what it has: its address and its number of tags."""
    marks = F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))
    row = lambda a, b: F.concat(F.lit("<table><tr><td>"), a, F.lit("</td><td>"), b.cast("string"), F.lit("</td></tr></table>"))
    page = F.concat("html", row(F.lit("address"), F.length("url")), row(F.lit("tags"), marks))
    cells = html.html_cells(v.table("pages").select(F.col("page_id").alias("document_id"), page.alias("html")))
    second = lambda table: F.max(F.when((F.col("col_no") == 1) & (F.col("table_no") == table), F.col("text"))).cast("long")
    return cells.groupBy("document_id").agg(
        F.count("*").alias("cells"), F.count_distinct("table_no").cast("int").alias("tables"), second(0).alias("url_length"), second(1).alias("marks")
    )
