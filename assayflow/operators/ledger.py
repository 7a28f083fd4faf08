"""Call costs, spend caps and the routing of filings to model tiers."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .keyed import ordered_index
from .listing import newer_report_exists, on_watchlist

RATE = "decimal(10,4)"


def _rate_struct(rates: tuple[str, str, str]) -> Column:
    parts = [F.lit(r).cast(RATE).alias(n) for r, n in zip(rates, ("input_rate", "output_rate", "read_rate"))]
    return F.struct(*parts)


def _prefix_rate(name: Column, table: dict[str, tuple[str, str, str]]) -> Column:
    """Longest prefix wins: longer prefixes are tried first in one CASE expression."""
    rule = F.lit(None)
    for prefix in sorted(table, key=len):
        rule = F.when(name.startswith(prefix), _rate_struct(table[prefix])).otherwise(rule)
    return rule


def with_rates(calls: DataFrame, model: str = "model", prompt_tokens: Column | None = None) -> DataFrame:
    """Rates per call. The price list is a constant of a few rows, so it is an expression inside
    the scan's own stage rather than a join."""
    name = F.lower(F.col(model))
    rate = F.coalesce(_prefix_rate(name, V.MODEL_RATES), _rate_struct(V.UNKNOWN_RATE))
    if prompt_tokens is not None:
        long_rate = _prefix_rate(name, V.LONG_PROMPT_RATES)
        rate = F.when((prompt_tokens > V.LONG_PROMPT_TOKENS) & long_rate.isNotNull(), long_rate).otherwise(rate)
    return calls.withColumn("_rate", rate).select("*", "_rate.*").drop("_rate")


def call_cost(calls: DataFrame) -> DataFrame:
    """Cost of each call to six decimals: cache writes dearer, cache reads cheaper, batches half."""
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    priced = with_rates(calls, prompt_tokens=prompt)
    tokens = lambda c: F.col(c).cast("decimal(12,0)")
    amount = (
        tokens("input_tokens") * F.col("input_rate")
        + tokens("cache_write_tokens") * F.col("input_rate") * F.lit(V.CACHE_WRITE_FACTOR).cast("decimal(4,2)")
        + tokens("cache_read_tokens") * F.col("read_rate")
        + tokens("output_tokens") * F.col("output_rate")
    )
    factor = F.when(F.col("batch"), F.lit(V.BATCH_FACTOR)).otherwise(F.lit("1.00")).cast("decimal(4,2)")
    total = (amount.cast("decimal(24,8)") * factor).cast("decimal(28,10)") / F.lit("1000000").cast("decimal(7,0)")
    return priced.withColumn("cost_usd", F.bround(total, 6).cast("decimal(12,6)"))


def estimate_cost(work: DataFrame, chars: str = "n_chars", model: str = "model") -> DataFrame:
    """Cost of a planned run by model: characters over four as tokens, input side only."""
    tokens = F.greatest(F.lit(1), F.floor(F.col(chars) / V.CHARS_PER_TOKEN)).cast("decimal(18,0)")
    priced = with_rates(work, model)
    cost = (tokens * F.col("input_rate") / F.lit("1000000").cast("decimal(7,0)")).cast("decimal(20,8)")
    return priced.groupBy(model).agg(
        F.count("*").alias("documents"), F.sum(tokens).cast("long").alias("tokens"), F.sum(cost).alias("cost_usd")
    )


def _ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def spend(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """Spend of the running day and month; older partitions are pruned by the month filter."""
    month, day = as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0), as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    rows = ledger.filter((F.col("created_at") >= _ntz(month)) & (F.col("created_at") <= _ntz(as_of)))
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("created_at") >= _ntz(day), F.col("cost_usd"))), F.lit(Decimal(0))).alias("daily"),
        F.coalesce(F.sum("cost_usd"), F.lit(Decimal(0))).alias("monthly"),
    )


def cap_verdict(ledger: DataFrame, as_of: datetime, monthly_cap: float = 80.0, daily_alert: float = 15.0) -> DataFrame:
    verdict = (
        F.when(F.col("monthly") >= monthly_cap, F.lit("stop"))
        .when(F.col("daily") >= daily_alert, F.lit("alert"))
        .otherwise(F.lit("ok"))
    )
    return spend(ledger, as_of).withColumn("verdict", verdict)


def run_spend(ledger: DataFrame, since: datetime) -> DataFrame:
    rows = ledger.filter(F.col("created_at") >= _ntz(since))
    return rows.groupBy("purpose").agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))


def within_cap(work: DataFrame, order: list[Column], cost: str, cap: float) -> DataFrame:
    """The part of a work list done before the cap is reached: an item runs while what was spent
    before it stays under the cap. The running sum is global but never sits in one task."""
    indexed = ordered_index(work, order, total=cost)
    return indexed.filter(F.col("running") - F.col(cost) < F.lit(cap))


def cost_by_model(ledger: DataFrame) -> DataFrame:
    """Cost and tokens by model, with the live-tier price of the same tokens."""
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    totals = ledger.groupBy("model").agg(
        F.sum("cost_usd").alias("cost_usd"), F.sum(prompt).alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    live = F.col("prompt_tokens") * F.lit(int(V.LIVE_RATE[0])) + F.col("output_tokens") * F.lit(int(V.LIVE_RATE[1]))
    return totals.withColumn("live_tier_usd", live / 1e6)


# --- routing -----------------------------------------------------------------------------------


def is_backfill(filed_at: Column, as_of: date, months: int = 24) -> Column:
    """Filed before the cut-off; undated filings are live."""
    return F.coalesce(filed_at < F.lit(as_of - timedelta(days=int(months * V.DAYS_PER_MONTH))), F.lit(False))


def with_tier(filings: DataFrame, as_of: date, months: int = 24) -> DataFrame:
    old = is_backfill(F.col("filed_at"), as_of, months)
    return filings.withColumn("tier", F.when(old, F.lit("backfill")).otherwise(F.lit("live")))


def full_extraction(filings: DataFrame, items: DataFrame, as_of: date, months: int = 24, forced: Column | None = None) -> DataFrame:
    """Whether a filing is read in full and why; first rule wins."""
    staged = newer_report_exists(on_watchlist(with_tier(filings, as_of, months), items))
    reason = (
        F.when(forced if forced is not None else F.lit(False), F.lit("forced"))
        .when(F.col("watched"), F.lit("watchlist"))
        .when(F.col("filed_at").isNull(), F.lit("undated"))
        .when(F.col("tier") == "live", F.lit("live"))
        .when(F.col("project_id").isNull() | ~F.col("newer_exists"), F.lit("latest"))
        .otherwise(F.lit("superseded"))
    )
    return staged.withColumn("reason", reason).withColumn("full_extract", reason != "superseded")


def document_outcomes(filings: DataFrame, resource_counts: DataFrame) -> DataFrame:
    """Outcome, next status and emitted events per filing.

    ``filings`` holds full_extract and near_duplicate flags; ``resource_counts`` the number of
    resource and drill rows the extraction produced per document.
    """
    rows = filings.join(resource_counts, "document_id", "left")
    technical = F.coalesce(F.lower("doc_type").isin(*V.TECHNICAL_TYPES), F.lit(False))
    outcome = (
        F.when(~technical, F.lit("not_technical_report"))
        .when(F.col("project_id").isNull(), F.lit("unresolved_project"))
        .when(~F.col("full_extract"), F.lit("deferred_full_extract"))
        .when(F.col("near_duplicate"), F.lit("near_duplicate"))
        .otherwise(F.lit("extracted"))
    )
    staged = rows.withColumn("outcome", outcome)
    triaged = F.col("outcome").isin("unresolved_project", "deferred_full_extract")
    status = F.when(triaged, F.lit("triaged")).otherwise(F.lit("extracted"))
    done = F.col("outcome") == "extracted"
    emitted = F.array_compact(
        F.array(
            F.when(F.col("project_id").isNotNull(), F.col("event_type")),
            F.when(done & (F.coalesce("n_resources", F.lit(0)) > 0), F.lit("resource_update")),
            F.when(done & (F.coalesce("n_drills", F.lit(0)) > 0), F.lit("drill_results")),
        )
    )
    return staged.withColumn("next_status", status).withColumn("emitted", F.array_distinct(emitted))


def emitted_events(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("project_id", "document_id", F.explode("emitted").alias("event_type"), F.col("filed_at").alias("event_date"))
