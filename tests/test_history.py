from datetime import date

import pytest
from pyspark.sql import functions as F

from assayflow.functions import figures, fmt
from assayflow.operators import history as H

RESOURCE = (
    "estimate_id string, project_id string, document_id string, effective_date date, filed_at date, category string, domain string, "
    "tonnes double, grade map<string,double>"
)
D25, D26 = date(2025, 1, 1), date(2026, 1, 1)


def frame(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(
            estimate_id=f"r{i:03d}", project_id="p", document_id="d1", effective_date=D25, filed_at=None, category="indicated", domain=None,
            tonnes=1_000_000.0, grade={"Au_gpt": 1.0},
        )
        base.update(r)
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, RESOURCE)


@pytest.fixture(scope="module")
def filings(spark):
    return spark.createDataFrame([], "document_id string, filed_at date")


def totals(spark, filings, rows, group):
    got = H.category_totals(frame(spark, rows), filings).filter(F.col("grp") == group).collect()
    return got[0] if got else None


def test_a_date_filed_twice_counts_once(spark, filings):
    rows = [dict(document_id="a"), dict(document_id="b"), dict(document_id="b"), dict(document_id="c", effective_date=D26)]
    got = H.estimates(frame(spark, rows), filings).orderBy("estimate_date").collect()
    assert [(r.document_id, r.also_in, r.row_count) for r in got] == [("b", 1, 2), ("c", 0, 1)]


def test_filing_date_stands_in(spark, filings):
    rows = [dict(effective_date=None, filed_at=date(2024, 5, 2)), dict(effective_date=None)]
    got = H.estimates(frame(spark, rows), filings).collect()
    assert [r.estimate_date for r in got] == [date(2024, 5, 2)]


def test_totals_and_zones(spark, filings):
    zones = [
        dict(category="measured+indicated", domain="A", tonnes=2e6, grade={"Au_gpt": 1.0}),
        dict(category="measured+indicated", domain="B", tonnes=2e6, grade={"Au_gpt": 3.0}),
        dict(category="measured", tonnes=1.0),
    ]
    got = totals(spark, filings, zones, "mi")
    assert (got.tonnes, got.grades["Au_gpt"], got.row_count) == (4e6, 2.0, 2)
    assert totals(spark, filings, [*zones, dict(category="measured+indicated", domain="Total", tonnes=4.1e6)], "mi").tonnes == 4.1e6
    assert totals(spark, filings, zones, "reserves") is None
    assert totals(spark, filings, [*zones, dict(category="measured+indicated", domain="Zone B total", tonnes=2e6)], "mi").tonnes == 6e6
    named = [dict(domain="Santa Cruz - Oxide", tonnes=53.0), dict(domain="Santa Cruz - Total", tonnes=274.0), dict(tonnes=7.0)]
    assert totals(spark, filings, named, "mi").tonnes == 274.0


def test_grade_weighs_only_rows_holding_the_key(spark, filings):
    rows = [dict(tonnes=1e6, grade={"Au_gpt": 2.0}), dict(tonnes=3e6, grade={"Cu_pct": 1.0}), dict(tonnes=0.0, grade={"Au_gpt": 99.0})]
    got = totals(spark, filings, rows, "mi")
    assert got.tonnes == 4e6 and got.grades == {"Au_gpt": 2.0, "Cu_pct": 1.0} and got.row_count == 3


def test_contained_metal_and_main_key(spark, filings):
    row = spark.range(1).select(
        figures.contained_metal(F.lit(31103.5), F.lit("Au_gpt"), F.lit(1.0)).alias("oz"),
        figures.contained_metal(F.lit(1000.0), F.lit("Cu_pct"), F.lit(2.0)).alias("t"),
        figures.contained_metal(F.lit(1000.0), F.lit("Li_mgL"), F.lit(2.0)).alias("none"),
    ).first()
    assert (round(row.oz), row.t, row.none) == (1000, 20.0, None)
    keys = H.primary_grade_keys(frame(spark, [dict(grade={"AuEq_gpt": 1.0, "Cu_pct": 1.0}), dict(grade={"Cu_pct": 1.0})])).first()
    assert keys.grade_key == "Cu_pct"


def test_zone_names_match_loosely(spark, filings):
    rows = [
        dict(document_id="a", domain="Konkola Mine, exclusive of reserves", category="measured+indicated", tonnes=5e6),
        dict(document_id="b", domain="Konkola UG", category="measured+indicated", tonnes=5e6, effective_date=D26),
    ]
    table = frame(spark, rows)
    got = H.zone_changes(table, filings).collect()
    assert len(got) == 1 and got[0].state == "changed" and got[0].pct == 0.0 and got[0].label == "Konkola UG"
    matrix = H.zone_matrix(table, filings).first()
    assert (matrix.estimate_2_back, matrix.estimate_1_back, matrix.estimate_3_back) == (5e6, 5e6, None)
    assert H.latest_changes(table, filings).first().change == "M&I tonnes unchanged vs the 2025 estimate"


def delta(spark, filings, rows):
    return H.estimate_deltas(frame(spark, rows), filings).orderBy(F.col("estimate_date").desc()).first()


def test_change_line_and_scope(spark, filings):
    grown = [dict(document_id="a"), dict(document_id="b", tonnes=1.5e6, effective_date=D26)]
    assert delta(spark, filings, grown).change == "M&I +50% tonnes vs the 2025 estimate"
    rows = [
        dict(document_id="a", tonnes=1e6, grade={"Au_gpt": 2.0}), dict(document_id="a", category="inferred", tonnes=5e5),
        dict(document_id="b", tonnes=1.1e6, grade={"Au_gpt": 2.0}, effective_date=D26), dict(document_id="b", category="inferred", tonnes=5e5, effective_date=D26),
    ]
    got = delta(spark, filings, rows)
    assert (round(got.mi_pct), round(got.inferred_pct), round(got.metal_pct), got.scope_change, got.metal_key) == (10, 0, 8, False, "Au_gpt")
    jump = delta(spark, filings, [dict(document_id="a"), dict(document_id="b", tonnes=1.5e7, effective_date=D26)])
    assert jump.scope_change and round(jump.mi_pct) == 1400 and jump.change.endswith("(likely a change in scope; check the report)")


ECON = (
    "study_id string, project_id string, document_id string, study_type string, effective_date date, filed_at date, currency string, "
    "npv map<string,double>, irr_pct double, capex_initial double, aisc map<string,double>, mine_life_years double, payback_years double"
)


def test_study_progression(spark, filings):
    rows = [
        ("1", "p", "a", "pea", D25, None, "USD", {"post_tax_5pct": 10.0}, 5.0, None, None, None, None),
        ("2", "p", "b", "pea", D25, None, "USD", {"post_tax_5pct": 10.0}, 5.0, None, None, None, None),
        ("3", "p", "c", "pfs", D26, None, "USD", {"post_tax_8pct": 20.0}, 6.0, None, None, None, None),
        ("4", "p", "d", "fs", D26, None, "USD", {}, None, None, None, None, 3.0),
    ]
    table = spark.createDataFrame(rows, ECON)
    got = H.study_progression(table, filings).orderBy("study_date").collect()
    assert [r.study_type for r in got] == ["pea", "pfs"]
    changes = {r.metric: r for r in H.study_changes(table, filings).collect()}
    assert not changes["npv"].comparable and changes["npv"].pct is None
    assert changes["irr"].comparable and round(changes["irr"].pct) == 20


def test_headline_value_and_text(spark):
    def pick(mapping):
        table = spark.createDataFrame([(mapping,)], "m map<string,double>")
        return table.select(figures.headline_npv("m").alias("h"), fmt.npv("m", F.lit("USD")).alias("t")).first()

    assert pick({"pre_tax_5pct": 9.0, "post_tax_8pct": 5.0, "post_tax_5pct": 7.0}).h.key == "post_tax_5pct"
    assert pick({"pre_tax_8pct": 9.0, "post_tax_8pct": 5.0}).h.key == "post_tax_8pct"
    assert pick({"post_tax_1.09pct": 257.1}).t == "US$257M (post-tax, 1.09%)"
    assert pick({"unspecified": 71674.0}).t == "—"
    assert pick({"npv": 50.0}).t == "US$50M (basis not stated)"
    assert pick({"post_tax": 50.0}).t == "US$50M (post-tax, rate not stated)"
    assert pick({}).t == "—"


def test_figures_as_text(spark):
    row = spark.range(1).select(
        fmt.money(F.lit(1240), F.lit("USD")).alias("a"), fmt.money(F.lit(235), F.lit("CAD")).alias("b"), fmt.money(F.lit(22.1), F.lit("XYZ")).alias("c"),
        fmt.money(F.lit(-41), F.lit("USD")).alias("d"), fmt.money(F.lit(None), F.lit("USD")).alias("e"),
        fmt.contained(F.create_map(F.lit("Au_oz"), F.lit(1.25e6), F.lit("Cu_lb"), F.lit(2.1e9))).alias("f"),
        fmt.contained(F.create_map(F.lit("LCE_t"), F.lit(450_000.0))).alias("g"), fmt.grade(F.create_map(F.lit("Li_mgL"), F.lit(120.0))).alias("h"),
    ).first()
    assert tuple(row) == ("US$1.24B", "C$235M", "XYZ 22.1M", "−US$41M", "—", "1.25 Moz Au, 2.1 Blb Cu", "450 kt LCE", "120 mg/L Li")


def test_intercepts_rank_by_grade_times_width(spark):
    rows = [
        ("1", "p", "H1", 0.0, 10.0, None, {"Au_gpt": 2.0}), ("2", "p", "H1", 0.0, 3.0, 30.0, {"Au_gpt": 1.0}), ("3", "p", None, 5.0, 5.0, None, {"Au_gpt": 9.0}),
        ("4", "p", None, 0.0, 4.0, None, {"Au_gpt": 3.0}),
    ]
    table = spark.createDataFrame(rows, "drill_id string, project_id string, hole_id string, from_m double, to_m double, interval_m double, assays map<string,double>")
    assert [r.drill_id for r in H.rank_intercepts(table, "Au_gpt").collect()] == ["2", "1", "4"]
    assert [r.drill_id for r in H.rank_intercepts(table, "Au_gpt", per_hole=True).collect()] == ["2", "4"]


def test_one_hot_project_gives_the_same_totals(spark, filings):
    """A third of all rows in one project: totals equal the plain sum."""
    rows = spark.range(30_000).selectExpr(
        "cast(id AS string) AS estimate_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 500 AS string) END AS project_id", "'d' AS document_id",
        "DATE '2025-01-01' AS effective_date", "cast(NULL AS date) AS filed_at", "'inferred' AS category", "cast(NULL AS string) AS domain", "1.0D AS tonnes", "map('Au_gpt', 2.0D) AS grade",
    )
    got = H.category_totals(rows, filings).filter("project_id = 'hot'").first()
    assert (got.tonnes, got.row_count, got.grades["Au_gpt"]) == (10_000.0, 10_000, 2.0)
