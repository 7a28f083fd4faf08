"""Registered queries against their DuckDB text on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entrypoint
from check_oracles import TABLES, rows_of

SAMPLE = (
    "q01_companies q10_screener q10_screener_filtered q18_facets q26_stacked_months q30_dashboard q40_merge_events h01_estimates h14_delta h16_movers "
    "h17_new_studies m01_weekly m05_coverage c02_cost c05_within_cap d06_company d12_match d15_priority d16_band t03_headings t06_select "
    "t17_event_class t18_near_duplicate_flags t19_citations n10_category_split n12_confidence r01_cosine r02_keyword r03_fusion r07_quality v04_verify_resources v07_counts v08_decisions v08_decision_counts v08_bulk_approve v10_queue d04_issuer_upsert d05_occurrence_upsert d06_company_updates q41_guarded_select a02_pending e03_stratified "
    "s01_hits s06_index_rows s13_results t14_resource_tables k04_weeks k04_months k01_landing k02_alert_deliveries k03_source_silence k06_chunk_store e01_match e01_unmatched s15_decision_lines d17_unmatched_files t04_chunks t09_batches f04_money"
).split()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, small, duck, name):
    frame = entrypoint.queries()[name](spark, small)
    got = rows_of(frame.columns, frame.collect())
    result = duck.execute(entrypoint.oracle_sql()[name])
    assert got == rows_of([d[0] for d in result.description], result.fetchall())


def test_entry_has_rows(spark):
    assert entrypoint.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())
