import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from assayflow.functions.normalize import country, stage
from assayflow.operators import resolve as R
from assayflow.sources import exports, feeds, hits, html, manifests


def hit(_id="0001-26-1:ex99.htm", **source):
    base = dict(ciks=["0001234"], display_names=["Filer"], root_forms=["6-K"], form="6-K", file_type="EX-99.2", file_date="2026-11-17", sics=["3690"])
    base.update(source)
    return {"_id": _id, "_source": base}


def disposition(spark, allowed, override=None, known=()):
    page = spark.createDataFrame([(json.dumps({"hits": {"hits": [hit()]}}),)], "payload string")
    seen = spark.createDataFrame([(k,) for k in known], "external_id string")
    return hits.with_disposition(hits.parse_hits(page), seen, hits.parse_file_types(allowed), override).first()


def test_exhibit_gate(spark):
    known = ["0001-26-1:ex99.htm"]
    assert disposition(spark, "EX-99", "ni43101", known).disposition == "skipped_known"
    assert disposition(spark, "EX-99", None, known).disposition == "skipped_sic"
    assert disposition(spark, None, None, known).disposition == "skipped_file_type"
    row = disposition(spark, "EX-99", "ni43101")
    assert (row.disposition, row.doc_type, row.url) == ("ingested", "ni43101", "https://www.sec.gov/Archives/edgar/data/1234/0001261/ex99.htm")


@pytest.mark.parametrize("declared, name, allowed, kept", [("EX-96.1", "a.htm", "EX-96", True), ("ex961", "a.htm", "EX-96", False), ("", "d-ex96_1.htm", "EX-96", True), ("", "ex99.htm", "EX-99", False), ("CORRESP", "a", "all", True)])
def test_whole_segments(spark, declared, name, allowed, kept):
    row = spark.range(1).select(hits.matches_file_types(F.lit(declared), F.lit(name), hits.parse_file_types(allowed)).alias("k")).first()
    assert row.k is kept


def test_hits_without_id_or_cik_drop(spark):
    page = {"hits": {"hits": [hit("nocolon"), hit(ciks=[]), hit("a:b.pdf", sics=["", "1040"], display_names=[])]}}
    rows = hits.parse_hits(spark.createDataFrame([(json.dumps(page),)], "payload string")).collect()
    assert [(r.external_id, r.sic, r.title) for r in rows] == [("a:b.pdf", 1040, "6-K")]


def test_rss_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title> Gold drill </title><link>http://a/1</link><pubDate>Tue, 17 Nov 2026 23:30:00 -0500</pubDate></item>"
        "<item><title>No link</title></item><item><title>Other</title><link>http://a/2</link><guid>g2</guid><pubDate>Wed, 18 Nov 2026 01:00:00 GMT</pubDate></item></channel></rss>"
    )
    rows = feeds.read_rss(spark, str(tmp_path / "feed.xml")).orderBy("link").collect()
    assert [(r.guid, r.filed_at) for r in rows] == [("http://a/1", date(2026, 11, 17)), ("g2", date(2026, 11, 18))]


MANIFEST = """note,,
page,profile_name,profile_number,document,submitted_date,submitted_time_et,principal_jurisdiction,file_size_kb
1,Alpha Ltd,000052522,"Technical report, NI 43-101.pdf",2026-11-17,15:35:18,Ontario,"22,495"
1,Beta Corp,,Report.pdf,2026-10-01,09:00:00,Quebec,100
"""
EXPORT = """Search results

Profile(s),Document,Submitted date,Principal jurisdiction,File size
Alpha Ltd / Alpha Ltd (000052522),"Technical report, NI 43-101.pdf",Tue Nov 17 15:35:18 EST 2026,Ontario,22495 KB
Beta Corp / Beta Corp (000000077),Report.pdf,Thu Oct 01 09:00:00 EDT 2026,Quebec,100 KB
"""


def test_both_index_layouts_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text(MANIFEST)
    (tmp_path / "b.csv").write_text(EXPORT)
    (tmp_path / "c.csv").write_text("something,else\n1,2\n")
    rows = manifests.read_index(spark, str(tmp_path) + "/*.csv")
    assert rows.count() == 4
    merged = manifests.merge_index(rows).orderBy("profile_name").collect()
    assert [(r.profile_number, r.submitted_date, r.file_size_kb) for r in merged] == [("000052522", date(2026, 11, 17), 22495), ("000000077", date(2026, 10, 1), 100)]


INDEX = "profile_name string, profile_number string, document string, submitted_date date, submitted_time string, file_size_kb long"
FILES = "document_id int, profile_number string, company string, document string, size_bytes long"


def match(spark, index, files):
    made = spark.createDataFrame([(*r[:3], date(2026, 1, r[3]), "10:00", r[4]) for r in index], INDEX)
    got = R.match_files(spark.createDataFrame([(i, *f) for i, f in enumerate(files)], FILES), made)
    return [r.submitted_date.day if r.submitted_date else None for r in got.orderBy("document_id").collect()]


def test_band_match(spark):
    index = [("Alpha Ltd", "0052522", "Doc.pdf", 1, 1000), ("Alpha Ltd", "0052522", "Doc.pdf", 2, 5000), ("Old Name", "77", "Same.pdf", 3, 50), ("New Name", "77", "Same.pdf", 3, 50)]
    files = [
        ("52522", "Alpha", "DOC.pdf", 1001 * 1024), ("52522", "Alpha", "doc.pdf", 5020 * 1024), ("52522", "Alpha", "doc.pdf", 9000 * 1024), ("", "Alpha Ltd (formerly Zed)", "Doc.pdf", 1000 * 1024),
        ("077", "New Name", "Same.pdf", 50 * 1024), ("99", "Alpha Ltd", "Doc.pdf", 1000 * 1024),
    ]
    assert match(spark, index, files) == [1, 2, None, 1, 3, None]
    tie = [("A", "1", "D.pdf", 1, 100), ("A", "1", "D.pdf", 2, 101)]
    assert match(spark, tie, [("1", "A", "D.pdf", 100 * 1024)]) == [None]


def test_band_match_equals_brute_force(spark):
    sizes = [3, 7, 390, 399, 400, 401, 402, 1000, 1004, 5000, 20000, 20100]
    index = [("A", "1", "D.pdf", 1 + i, s) for i, s in enumerate(sizes)]
    probes = [s * 1024 + d * 512 for s in sizes for d in (-60, -4, -1, 0, 3, 4, 5, 50)]
    probes = [p for p in probes if p > 0]
    want = []
    for p in probes:
        near = {i + 1 for i, s in enumerate(sizes) if abs(s - p / 1024) <= max(2.0, 0.005 * s)}
        want.append(near.pop() if len(near) == 1 else None)
    assert match(spark, index, [("1", "A", "D.pdf", p) for p in probes]) == want


PAGE = """<html><body><table><tr><th>Class</th><th>Tonnage (kt)</th><th>Au (g/t)</th><th>Cu %</th></tr>
<tr><td>Measured</td><td>1,200</td><td>1.5</td><td>&mdash;</td></tr><tr><td>Indicated <table><tr><td>nested</td></tr></table></td><td>(5)</td><td>2</td><td>0.4</td></tr>
<tr><td>Notes</td><td>9</td></tr></table><table><tr><td>Class</td><td>Grade</td></tr><tr><td>Measured</td><td>1</td></tr></table></body></html>"""


def test_resource_tables(spark):
    cells = html.html_cells(spark.createDataFrame([("d", PAGE)], "document_id string, html string"))
    rows = html.resource_rows(cells).orderBy("row_no").collect()
    assert [(r.category, r.tonnes, r.grade) for r in rows] == [("measured", 1_200_000.0, {"Au_gpt": 1.5}), ("indicated", -5_000.0, {"Au_gpt": 2.0, "Cu_pct": 0.4})]
    assert rows[1].extraction_confidence == 0.3


def test_economics_tables(spark):
    page = "<table><tr><td>After-Tax NPV (8%)</td><td>1,240</td></tr><tr><td>Post-tax IRR</td><td>22.5%</td></tr><tr><td>Payback</td><td>3.1 years</td></tr><tr><td>PFS</td><td>2026</td></tr></table>"
    row = html.economics_rows(html.html_cells(spark.createDataFrame([("d", page), ("e", "<p>none</p>")], "document_id string, html string"))).collect()
    assert len(row) == 1 and (row[0].npv, row[0].irr_pct, row[0].payback_years, row[0].study_type) == ({"post_tax_8pct": 1240.0}, 22.5, 3.1, "pfs")


def test_csv_export_quotes(spark, tmp_path):
    row = spark.createDataFrame([('He said "hi", twice', "b")], "project string, company string")
    exports.write_csv(row.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines()[1] == '"He said ""hi"", twice",b'


def test_file_discovery(spark, tmp_path):
    folder = tmp_path / "000052522 Alpha Ltd." / "__MACOSX"
    folder.mkdir(parents=True)
    (folder / "x.pdf").write_bytes(b"%PDF-1")
    good = folder.parent
    (good / "Technical report.pdf (0a1b2c)").write_bytes(b"%PDF-1")
    (good / "French report.pdf").write_bytes(b"%PDF-1")
    (good / "fake.pdf").write_bytes(b"hello")
    rows = manifests.discover_pdfs(manifests.read_files(spark, str(tmp_path)), str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].issuer == "Alpha Ltd" and rows[0].doc_type == "ni43101"


def test_vocabularies(spark):
    row = spark.range(1).select(stage(F.lit("")).alias("a"), country(F.lit("  ")).alias("b"), country(F.lit("Peru")).alias("c")).first()
    assert tuple(row) == (None, None, "Peru")


def test_plain_pages_read_as_the_parser_reads_them():
    pieces = ["<table>", "</table>", "<tr>", "<TD >", "</td>", "<th\n>", "</tr>", "a b", "\n", "<p>", "x > y", "<td class='k'>", "&amp;", "<br/>", "<!-- c -->", "<script>", "</script>", "<", "<3"]
    drawn = random.Random(5)
    plain = 0
    for n in range(4000):
        body = "".join(drawn.choices(pieces[:11] if n % 2 else pieces, k=drawn.randint(0, 25)))
        asked = html._Cells()
        asked.feed(body)
        read = html._Cells()
        read.feed = lambda body, feed=read.feed: (feed(body), read.__dict__.update(fed=True))
        assert read.read(body) == asked.finish(), body
        plain += "fed" not in read.__dict__
    assert plain > 1500


def test_resource_rows_parse_each_page_once(spark):
    parsed = spark.sparkContext.accumulator(0)
    page = "<table><tr><th>Class</th><th>Tonnes</th></tr><tr><td>Measured</td><td>{}</td></tr></table>"
    pages = spark.createDataFrame([(n, page.format(n + 20000)) for n in range(5)], "document_id long, html string")

    def seen(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    rows = html.resource_rows(html.html_cells(pages.mapInArrow(seen, pages.schema))).collect()
    assert sorted((r.document_id, r.category, r.tonnes) for r in rows) == [(n, "measured", n + 20000.0) for n in range(5)]
    assert parsed.value == 5
