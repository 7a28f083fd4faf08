import pytest
from pyspark.sql import functions as F

from assayflow.functions import normalize as N
from assayflow.operators import landing as D

RESOURCE = (
    "category string, domain string, tonnes double, tonnage_unit string, grade map<string,double>, contained_metal map<string,double>, extraction_confidence double"
)


def resource(spark, **changes):
    base = dict(category="indicated", domain=None, tonnes=5e6, tonnage_unit=None, grade={}, contained_metal={}, extraction_confidence=0.9)
    base.update(changes)
    return N.validate_resources(spark.createDataFrame([tuple(base.values())], RESOURCE)).first()


@pytest.mark.parametrize(
    "label, category, domain",
    [
        ("Indicated - total", "indicated", None),
        ("Indicated - Upper Zone (exclusive of reserves)", "indicated", "upper zone (exclusive of reserves)"),
        ("Measured and Indicated", "measured+indicated", None),
        ("M&I", "measured+indicated", None),
        ("Proved", "proven", None),
        ("P+P", "2p", None),
        ("historic estimate", "historic estimate", None),
        ("Measured, Indicated and Inferred", "measured, indicated and inferred", None),
        ("Inferred (open pit)", "inferred", "open pit"),
    ],
)
def test_category_labels(spark, label, category, domain):
    got = spark.range(1).select(N.split_category(F.lit(label)).alias("s")).first().s
    assert (got.category, got.domain) == (category, domain)


def test_tonnage_units_and_caps(spark):
    got = resource(spark, tonnes=89.0, tonnage_unit="short_Mt")
    assert round(got.tonnes) == 80_739_442 and got.extraction_confidence == 0.9
    assert resource(spark, tonnes=25.0, category="inferred").extraction_confidence == 0.5
    assert resource(spark, category="historic estimate").extraction_confidence == 0.3
    assert resource(spark, tonnage_unit="boxes").extraction_confidence == 0.3
    assert resource(spark, tonnes=0.0).extraction_confidence == 0.3
    total = resource(spark, category="Indicated - total", tonnes=417.346, tonnage_unit="Mt")
    assert (total.category, total.domain, round(total.tonnes), total.extraction_confidence) == ("indicated", None, 417_346_000, 0.9)


def test_ounces_in_the_grade_column_move(spark):
    got = resource(spark, tonnes=12e6, grade={"Au_gpt": 1_250_000.0, "Ag_gpt": 30.0})
    assert (got.grade, got.contained_metal, got.extraction_confidence) == ({"Ag_gpt": 30.0}, {"Au_oz": 1_250_000.0}, 0.5)
    kept = resource(spark, tonnes=12e6, grade={"Au_gpt": 900.0}, contained_metal={"Au_oz": 5.0, "bad": 1.0, "Cu_lb": -1.0})
    assert (kept.grade, kept.contained_metal, kept.extraction_confidence) == ({"Au_gpt": 900.0}, {"Au_oz": 5.0}, 0.9)


def economics(spark, **changes):
    base = dict(study_type="PEA", currency="usd", npv={}, irr_pct=None, capex_initial=None, mine_life_years=None, extraction_confidence=0.9)
    base.update(changes)
    schema = "study_type string, currency string, npv map<string,double>, irr_pct double, capex_initial double, mine_life_years double, extraction_confidence double"
    return N.validate_economics(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_money_is_in_millions(spark):
    got = economics(spark, npv={"post_tax_8pct": 235e6}, capex_initial=3.628e9)
    assert (got.npv, got.capex_initial, got.extraction_confidence, got.currency) == ({"post_tax_8pct": 235.0}, 3628.0, 0.6, "USD")
    unsure = economics(spark, capex_initial=325_400.0)
    assert (unsure.capex_initial, unsure.extraction_confidence) == (325_400.0, 0.3)
    keys = economics(spark, npv={"unspecified": 71_674.0, "post_tax_5pct": 41.0})
    assert (keys.npv, keys.extraction_confidence) == ({"post_tax_5pct": 41.0}, 0.4)


FACTS = "document_id string, fact int, reviewed boolean"


def test_an_empty_extraction_never_strips_facts(spark):
    old = spark.createDataFrame([("a", 1, False), ("b", 2, True), ("c", 3, False)], FACTS)
    new = spark.createDataFrame([("a", 9, False), ("b", 9, False)], FACTS)
    got = {(r.document_id, r.fact) for r in D.replace_facts(old, new).collect()}
    assert got == {("a", 9), ("b", 2), ("c", 3)}
    assert D.replace_facts(old, new.limit(0)).count() == 3
    plan = {(r.document_id, r.table): (r.action, r.rows) for r in D.replacement_plan({"x": old, "y": old}, {"x": new, "y": new.filter("document_id = 'a'")}).collect()}
    assert plan == {("a", "x"): ("swap", 1), ("a", "y"): ("swap", 1), ("b", "x"): ("protected", -1), ("b", "y"): ("keep", 0)}


def test_replacing_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, False)], FACTS)
    new = spark.createDataFrame([("a", 9, False), ("a", 8, False)], FACTS)
    once = D.replace_facts(old, new)
    assert sorted(map(tuple, D.replace_facts(once, new).collect())) == sorted(map(tuple, once.collect()))
