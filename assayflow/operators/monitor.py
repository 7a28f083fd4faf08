"""Calendars, coverage, freshness and queue figures. Every "now" is an argument."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .listing import _one_row, total


def _literal(value: date | datetime):
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def weekly_pulse(filings: DataFrame, as_of: date, weeks: int = 12, sources: tuple[str, ...] = ("sedar", "edgar")) -> DataFrame:
    """Dense Monday weeks with report counts per source.

    Counts are taken per truncated week first, so the calendar joins on equality with a few
    rows instead of a range predicate against every filing.
    """
    monday = as_of - timedelta(days=as_of.weekday())
    first = monday - timedelta(weeks=weeks - 1)
    rows = filings.filter(
        F.col("doc_type").isin(*V.REPORT_TYPES)
        & (F.col("filed_at") >= F.lit(first))
        & (F.col("filed_at") < F.lit(monday + timedelta(weeks=1)))
    )
    counted = rows.groupBy(F.to_date(F.date_trunc("week", "filed_at")).alias("week_start")).agg(
        *[F.count_if(F.col("source") == s).alias(s) for s in sources]
    )
    calendar = _calendar(filings.sparkSession, first, monday, "INTERVAL 7 DAY", "week_start")
    joined = calendar.join(counted, "week_start", "left")
    return joined.select("week_start", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in sources])


def _calendar(spark: SparkSession, first: date, last: date, step: str, name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{first}', DATE '{last}', {step})")).alias(name))


def daily_counts(filings: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    first = as_of - timedelta(days=days - 1)
    rows = filings.filter(F.col("doc_type").isin(*V.REPORT_TYPES) & F.col("filed_at").between(F.lit(first), F.lit(as_of)))
    counted = rows.groupBy(F.col("filed_at").alias("day")).agg(F.count("*").alias("n"))
    joined = _calendar(filings.sparkSession, first, as_of, "INTERVAL 1 DAY", "day").join(counted, "day", "left")
    return joined.select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def prior_week_count(filings: DataFrame, as_of: date) -> DataFrame:
    inside = (F.col("filed_at") >= F.lit(as_of - timedelta(days=13))) & (F.col("filed_at") < F.lit(as_of - timedelta(days=6)))
    return filings.filter(F.col("doc_type").isin(*V.REPORT_TYPES) & inside).agg(F.count("*").alias("n"))


def resource_quality(resources: DataFrame) -> DataFrame:
    return resources.agg(
        F.count("*").alias("total"),
        F.avg("extraction_confidence").alias("avg_confidence"),
        F.count_if(~F.col("reviewed")).alias("unreviewed"),
    )


def data_coverage(filings: DataFrame, resources: DataFrame, economics: DataFrame) -> DataFrame:
    """What stops filings from feeding history: six counts in one row."""
    with_resources = resources.select("document_id").distinct()
    per_project = resources.groupBy("project_id").agg(F.count_distinct("document_id").alias("n"))
    repeated = filings.filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.count("*").alias("n")).filter("n >= 2")
    without = filings.join(with_resources, "document_id", "left_anti")
    bare = without.join(economics.select("document_id"), "document_id", "left_anti")
    backfill = without.join(repeated, "project_id", "left_semi")
    return _one_row(
        filings.sparkSession,
        no_project=total(filings.filter(F.col("project_id").isNull())),
        no_company=total(filings.filter(F.col("company_id").isNull())),
        no_facts=total(bare),
        projects_one_estimate=total(per_project.filter("n = 1")),
        projects_with_history=total(per_project.filter("n >= 2")),
        history_backfill_filings=total(backfill),
    )


def ingestion_status(jobs: DataFrame, as_of: datetime, touched: str = "updated_at") -> DataFrame:
    recent = F.col(touched) >= _literal(as_of - timedelta(minutes=15))
    return jobs.agg(
        F.count_if((F.col("status") == "running") | ((F.col("status") == "done") & recent)).alias("active"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )


def last_by_source(filings: DataFrame) -> DataFrame:
    return filings.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("created_at").alias("last_created"))


def fetch_status(fetches: DataFrame) -> DataFrame:
    return fetches.groupBy("status").agg(F.count("*").alias("total"))


def latest_run(runs: DataFrame, started: str = "started_at") -> DataFrame:
    """The newest run as one row: an aggregate, not a sort of the log."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.col(started)).alias("r")).select("r.*")


def silent_sources(filings: DataFrame, as_of: datetime, hours: int = 24, expected: tuple[str, ...] = ("edgar", "newswire", "sedar")) -> DataFrame:
    """Documents per expected source in the last hours; silent where there are none."""
    recent = filings.filter((F.col("created_at") >= _literal(as_of - timedelta(hours=hours))) & (F.col("created_at") <= _literal(as_of)))
    counted = recent.groupBy("source").agg(F.count("*").alias("n"))
    known = filings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in expected])).alias("source"))
    joined = known.join(counted, "source", "left")
    return joined.select("source", F.coalesce("n", F.lit(0)).cast("long").alias("documents"), F.col("n").isNull().alias("silent"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "pending").groupBy("job_type").agg(F.count("*").alias("depth"))


def pending_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.filter(F.col("status") == "pending").orderBy("created_at", "job_id").limit(limit)


def partial_results(runs: DataFrame, value: str = "docs_found", trailing: int = 7, drop: float = 0.4) -> DataFrame:
    """Runs that found far less than their trailing average. ``runs`` is one row per run and
    mode, a log that stays small; the window still splits by mode."""
    before = Window.partitionBy("mode").orderBy("started_at").rowsBetween(-trailing, -1)
    usual = F.avg(value).over(before)
    return runs.withColumn("usual", usual).withColumn("alarm", F.coalesce(F.col(value) < (1 - drop) * F.col("usual"), F.lit(False)))


def outcome_counts(rows: DataFrame, outcome: str = "outcome", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, outcome).agg(F.count("*").alias("n"))


def briefing_headline(
    filings: DataFrame, watch_events: DataFrame, ledger: DataFrame, as_of: date, month_of: datetime, monthly_cap: float = 80.0
) -> DataFrame:
    """One row: week total and change, twelve-week total, unread counts, spend as a share of cap."""
    from .ledger import spend

    def reports(first: date, last: date) -> DataFrame:
        inside = F.col("filed_at").between(F.lit(first), F.lit(last)) & F.col("doc_type").isin(*V.REPORT_TYPES)
        return total(filings.filter(inside))

    monday = as_of - timedelta(days=as_of.weekday())
    unread = watch_events.filter(F.col("is_new"))
    row = _one_row(
        filings.sparkSession,
        week_total=reports(as_of - timedelta(days=6), as_of),
        prior_total=reports(as_of - timedelta(days=13), as_of - timedelta(days=7)),
        pulse_total=total(
            filings.filter(
                F.col("doc_type").isin(*V.REPORT_TYPES) & F.col("source").isin("sedar", "edgar")
                & F.col("filed_at").between(F.lit(monday - timedelta(weeks=11)), F.lit(monday + timedelta(days=6)))
            )
        ),
        unread=total(unread),
        unread_resources=total(unread.filter(F.col("event_type") == "resource_update")),
        month_spend=spend(ledger, month_of).select("monthly"),
    )
    change = F.col("week_total") - F.col("prior_total")
    share = F.least(F.lit(100.0), F.col("month_spend").cast("double") / monthly_cap * 100)
    return row.withColumn("week_change", change).withColumn("cap_share", share)
