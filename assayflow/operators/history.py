"""How a project's estimates and studies change over time.

Resource rows are reduced by partial aggregates to one row per (project, date) before any
window runs; a window then only sees as many rows as a project has distinct dates.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import col
from ..functions.figures import (
    contained_metal,
    first_map_value,
    headline_npv,
    intercept_width,
    is_main_assay_key,
    is_main_grade_key,
    most_common_key,
    percent_change,
    zone_key,
)
from .keyed import first_per_key, last_per_key, ranked_top, top_per_key

GROUPS = ("mi", "inferred", "reserves")


def dated_resources(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """Resource rows with the filing date joined in and the date the estimate counts under."""
    dates = filings.select("document_id", "filed_at")
    rows = resources if "filed_at" in resources.columns else resources.join(dates, "document_id", "left")
    rows = rows.withColumn("estimate_date", F.coalesce("effective_date", "filed_at"))
    return rows.filter(F.col("estimate_date").isNotNull())


def category_group(category: Column | str) -> Column:
    c = col(category)
    return (
        F.when(c.isin("measured+indicated", "measured", "indicated"), F.lit("mi"))
        .when(c.isin("2p", "proven", "probable"), F.lit("reserves"))
        .when(c == "inferred", F.lit("inferred"))
        .otherwise(F.lit("other"))
    )


def is_combined(category: Column | str) -> Column:
    return F.coalesce(col(category).isin("measured+indicated", "2p"), F.lit(False))


def is_report_total(domain: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(domain))).rlike(V.REPORT_TOTAL), F.lit(False))


def _measured(resources: DataFrame) -> DataFrame:
    """What totals need of a row, worked out before rows travel; rows that have it already stay."""
    if "entries" in resources.columns:
        return resources
    entry = "struct<key:string,value:double>"
    entries = F.concat(
        F.array(F.lit(None).cast(entry)),
        F.coalesce(F.map_entries("grade"), F.array().cast(f"array<{entry}>")),
    )
    return resources.select(
        "project_id",
        "document_id",
        *[c for c in ("effective_date", "filed_at") if c in resources.columns],
        category_group("category").alias("grp"),
        is_combined("category").alias("combined"),
        is_report_total("domain").alias("is_total"),
        F.when(F.col("tonnes") > 0, F.col("tonnes")).alias("t"),
        entries.alias("entries"),
    )


def _cells(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """Partial totals per (project, date, document, group, combined, total row, grade key).

    Each row is exploded into one entry per grade key plus one with a null key that carries the
    row count and the tonnage, so row counts, tonnes and weighted grades come from one shuffle. Rows are dealt by
    document before they are joined and exploded: the date, the cells and the document are then worked out where the rows are.
    """
    dated = dated_resources(_measured(resources).repartition("document_id"), filings)
    flat = dated.select(
        "project_id", "estimate_date", "document_id", "filed_at", "grp", "combined", "is_total", "t", F.explode("entries").alias("e")
    ).select("*", F.col("e.key").alias("key"), F.col("e.value").alias("g"))
    weighed = F.col("t").isNotNull() & F.col("g").isNotNull()
    return flat.groupBy("project_id", "estimate_date", "document_id", "grp", "combined", "is_total", "key").agg(
        F.count("*").alias("n"),
        F.max("filed_at").alias("filed_at"),
        F.sum("t").alias("t"),
        F.sum(F.when(weighed, F.col("t") * F.col("g"))).alias("gt"),
        F.sum(F.when(weighed, F.col("t"))).alias("gtt"),
    )


def _sum_of(cells: Column, field: str) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.coalesce(c[field].cast("double"), F.lit(0.0)))


def _rows_in(cells: Column) -> Column:
    """Row count of cells: the entries with a null key carry it."""
    plain = F.filter(cells, lambda c: c["key"].isNull())
    return F.aggregate(plain, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])


def _pick_documents(documents: DataFrame) -> DataFrame:
    """The fullest document of each (project, date), then the newest filing, then the smallest id."""
    newest_first = -F.coalesce(F.unix_date("filed_at"), F.lit(-1_000_000_000))
    order = F.struct(-F.col("row_count"), newest_first, F.col("document_id"))
    kept = [c for c in documents.columns if c not in ("project_id", "estimate_date")]
    # documents of a date seldom meet in one task, so they are dealt before they are compared and sorted once
    return (
        documents.repartition("project_id", "estimate_date")
        .groupBy("project_id", "estimate_date")
        .agg(F.min_by(F.struct(*kept), order).alias("d"), (F.count("*") - 1).alias("also_in"))
        .select("project_id", "estimate_date", "d.*", "also_in")
    )


def chosen_documents(dated: DataFrame) -> DataFrame:
    """(project, date) -> the document whose rows make the estimate, and how many restate it."""
    documents = dated.groupBy("project_id", "estimate_date", "document_id").agg(
        F.count("*").alias("row_count"), F.max("filed_at").alias("filed_at")
    )
    return _pick_documents(documents)


def _key_counts(cells: Column) -> Column:
    """struct(key, n) per grade key: in how many rows it is printed."""
    keyed = F.filter(cells, lambda c: c["key"].isNotNull())
    return F.transform(
        F.array_distinct(F.transform(keyed, lambda c: c["key"])),
        lambda k: F.struct(
            k.alias("key"),
            F.aggregate(F.filter(keyed, lambda c: c["key"] == k), F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"),
        ),
    )


def _merged_counts(counts: Column) -> Column:
    """Sum struct(key, n) entries of one array by key."""
    keys = F.array_distinct(F.transform(counts, lambda c: c["key"]))
    return F.transform(
        keys,
        lambda k: F.struct(
            k.alias("key"),
            F.aggregate(F.filter(counts, lambda c: c["key"] == k), F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"),
        ),
    )


def _weighted_grades(cells: Column) -> Column:
    keys = F.array_distinct(F.transform(F.filter(cells, lambda c: c["gtt"] > 0), lambda c: c["key"]))
    of_key = lambda k: F.filter(cells, lambda c: c["key"] == k)
    return F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k.alias("key"), (_sum_of(of_key(k), "gt") / _sum_of(of_key(k), "gtt")).alias("value")))
    )


def estimates(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """One estimate per (project, date): the fullest document wins, refilings are counted.

    Columns: project_id, estimate_date, document_id, also_in, row_count, and for each group
    ``<group>_tonnes``, ``<group>_rows`` and ``<group>_grades``; ``key_counts`` feeds the choice
    of the main grade key. Combined rows beat their parts and a report total beats its zones.

    Rows are first summed to cells (group, combined, total row, grade key); a document then holds
    a handful of them, its cells travel as one array and totals are worked out for the chosen
    document only.
    """
    cells = _cells(resources, filings)
    documents = cells.groupBy("project_id", "estimate_date", "document_id").agg(
        F.collect_list(F.struct("grp", "combined", "is_total", "key", "n", "t", "gt", "gtt")).alias("cells"),
        F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("row_count"),
        F.max("filed_at").alias("filed_at"),
    )
    table = _pick_documents(documents)
    own = {g: F.filter("cells", lambda c: c["grp"] == g) for g in GROUPS}
    table = table.withColumns({f"_{g}": e for g, e in own.items()})
    level = {
        f"_{g}": F.filter(f"_{g}", lambda c: (c["combined"] == F.exists(F.col(f"_{g}"), lambda x: x["combined"])) | F.lit(g == "inferred"))
        for g in GROUPS
    }
    table = table.withColumns(level)
    totals = {g: _rows_in(F.filter(f"_{g}", lambda c: c["is_total"])) for g in GROUPS}
    table = table.withColumns({f"_{g}_wins": (totals[g] > 0) & (totals[g] < _rows_in(F.col(f"_{g}"))) for g in GROUPS})
    table = table.withColumns({f"_{g}": F.filter(f"_{g}", lambda c: ~F.col(f"_{g}_wins") | c["is_total"]) for g in GROUPS})
    table = table.withColumns({f"_{g}_t": _sum_of(F.filter(f"_{g}", lambda c: c["key"].isNull()), "t") for g in GROUPS})
    columns = []
    for g in GROUPS:
        has = F.col(f"_{g}_t") > 0
        columns += [
            F.when(has, F.col(f"_{g}_t")).alias(f"{g}_tonnes"),
            F.when(has, _rows_in(F.col(f"_{g}"))).alias(f"{g}_rows"),
            F.when(has, _weighted_grades(F.col(f"_{g}"))).alias(f"{g}_grades"),
        ]
    return table.select(
        "project_id", "estimate_date", "document_id", "also_in", "row_count", "filed_at", _key_counts(F.col("cells")).alias("key_counts"), *columns
    )


def category_totals(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """Long form of the estimates: one row per (project, date, group) with tonnes."""
    table = estimates(resources, filings)
    groups = F.array(
        *[
            F.struct(
                F.lit(g).alias("grp"),
                F.col(f"{g}_tonnes").alias("tonnes"),
                F.col(f"{g}_rows").alias("row_count"),
                F.col(f"{g}_grades").alias("grades"),
            )
            for g in GROUPS
        ]
    )
    return (
        table.select("project_id", "estimate_date", "document_id", F.explode(groups).alias("t"))
        .select("project_id", "estimate_date", "document_id", "t.*")
        .filter(F.col("tonnes").isNotNull())
    )


def primary_grade_keys(resources: DataFrame) -> DataFrame:
    """The most common convertible grade key per project."""
    return _common_key(resources, "grade", is_main_grade_key, "grade_key")


def main_assay_keys(drills: DataFrame) -> DataFrame:
    return _common_key(drills, "assays", is_main_assay_key, "assay_key")


def _common_key(rows: DataFrame, mapping: str, allowed, name: str) -> DataFrame:
    counted = (
        rows.select("project_id", F.explode(F.map_keys(mapping)).alias("key"))
        .filter(allowed("key"))
        .groupBy("project_id", "key")
        .agg(F.count("*").alias("n"))
    )
    order = F.struct(-F.col("n"), F.col("key"))
    return first_per_key(counted, ["project_id"], order).select(
        "project_id", F.col("key").alias(name), F.col("n").alias("key_rows")
    )


def _estimate_metal(prefix: str, key: Column) -> Column:
    """Contained metal of measured, indicated and inferred tonnes under one grade key."""
    parts = []
    for group in ("mi", "inferred"):
        grade = F.try_element_at(F.col(f"{prefix}{group}_grades"), key)
        parts.append(F.when(grade.isNotNull(), F.coalesce(contained_metal(F.col(f"{prefix}{group}_tonnes"), key, grade), F.lit(0.0))))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def estimate_deltas(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """Each estimate against the one before it, with the scope-change flag and change line."""
    table = estimates(resources, filings)
    carried = ["estimate_date", "mi_tonnes", "inferred_tonnes", "mi_grades", "inferred_grades", "key_counts"]
    by_date = Window.partitionBy("project_id").orderBy("estimate_date")
    paired = table.withColumn("_prev", F.lag(F.struct(*carried)).over(by_date)).select(
        *table.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in carried]
    )
    both = _merged_counts(F.concat("key_counts", F.coalesce("prev_key_counts", F.array().cast("array<struct<key:string,n:bigint>>"))))
    usable = F.filter(both, lambda c: is_main_grade_key(c["key"]))
    keyed = paired.withColumn("metal_key", most_common_key(usable))
    keyed = keyed.withColumn("metal", _estimate_metal("", F.col("metal_key"))).withColumn(
        "prev_metal", _estimate_metal("prev_", F.col("metal_key"))
    )
    deltas = keyed.select(
        *table.columns,
        F.col("prev_estimate_date").alias("prev_date"),
        "metal_key",
        "metal",
        percent_change("prev_mi_tonnes", "mi_tonnes").alias("mi_pct"),
        percent_change("prev_inferred_tonnes", "inferred_tonnes").alias("inferred_pct"),
        percent_change("prev_metal", "metal").alias("metal_pct"),
    )
    swing = F.greatest(*[F.abs(F.col(c)) for c in ("mi_pct", "inferred_pct", "metal_pct")])
    return deltas.withColumn("scope_change", F.coalesce(swing > V.SCOPE_CHANGE_PCT, F.lit(False))).withColumn(
        "change", change_line("mi_pct", "inferred_pct", "prev_date", "scope_change")
    )


def change_line(mi_pct: Column | str, inferred_pct: Column | str, prev_date: Column | str, scope: Column | str) -> Column:
    def part(name: str, pct: Column) -> Column:
        size = F.round(F.abs(pct), 0).cast("long").cast("string")
        sign = F.when(pct > 0, F.lit("+")).otherwise(F.lit(V.MINUS))
        moved = F.concat(F.lit(f"{name} "), sign, size, F.lit("% tonnes"))
        return F.when(F.abs(pct) < 0.5, F.lit(f"{name} tonnes unchanged")).when(pct.isNotNull(), moved)

    parts = F.array_compact(F.array(part("M&I", col(mi_pct)), part("Inferred", col(inferred_pct))))
    tail = F.when(col(scope), F.lit(" (likely a change in scope; check the report)")).otherwise(F.lit(""))
    year = F.date_format(col(prev_date), "yyyy")
    line = F.concat(F.array_join(parts, ", "), F.lit(" vs the "), year, F.lit(" estimate"), tail)
    return F.when((F.size(parts) > 0) & year.isNotNull(), line)


def change_for_documents(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """(project, document) -> change line of the estimate the document reported or restated."""
    dated = dated_resources(resources, filings)
    own = dated.groupBy("project_id", "document_id").agg(F.min("estimate_date").alias("estimate_date"))
    lines = estimate_deltas(resources, filings).select("project_id", "estimate_date", "change")
    return own.join(lines, ["project_id", "estimate_date"], "left").select("project_id", "document_id", "change")


def latest_changes(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """One row per project: the change line of its newest estimate."""
    deltas = estimate_deltas(resources, filings)
    newest = last_per_key(deltas.select("project_id", "estimate_date", "change"), ["project_id"], F.col("estimate_date"))
    return newest


def _zone_estimates(resources: DataFrame, filings: DataFrame, *more: str) -> DataFrame:
    """One row per (project, date) with the zone cells of the document chosen for it, its ``age`` among the project's dates (1 is
    the newest) and their number ``n_estimates``. Projects that are null have none.

    As with the totals, a document's rows are summed to cells first, which travel with it as one array, so rows are shuffled once and joined
    with nothing but their filing. The first row of a cell is the smallest estimate_id.
    """
    rows = resources.filter(F.col("project_id").isNotNull()).select(
        "project_id", "document_id", *[c for c in ("effective_date", "filed_at") if c in resources.columns], "estimate_id", "domain",
        category_group("category").alias("grp"), is_combined("category").alias("combined"), is_report_total("domain").alias("is_total"),
        zone_key("domain").alias("zone"), F.struct("tonnes", *more).alias("row"),
    )
    dated = dated_resources(rows.repartition("document_id"), filings)
    document = ["project_id", "estimate_date", "document_id"]
    named = F.when(F.col("domain").isNotNull(), F.col("estimate_id"))
    cells = dated.groupBy(*document, "grp", "combined", "is_total", "zone").agg(
        F.count("*").alias("n"), F.max("filed_at").alias("filed_at"), F.min("estimate_id").alias("first_id"), F.min_by("row", "estimate_id").alias("row"),
        F.max(named).alias("label_id"), F.max_by("domain", named).alias("label"),
    )
    documents = cells.groupBy(*document).agg(
        F.collect_list(F.struct("grp", "combined", "is_total", "zone", "n", "first_id", "row", "label_id", "label")).alias("cells"),
        F.sum("n").alias("row_count"), F.max("filed_at").alias("filed_at"),
    )
    by_date = Window.partitionBy("project_id").orderBy(F.col("estimate_date").desc())
    return _pick_documents(documents).select(
        "project_id", "estimate_date", "cells", F.row_number().over(by_date).alias("age"),
        F.count("*").over(Window.partitionBy("project_id")).alias("n_estimates"),
    )


def _counted_cells(estimates: DataFrame) -> DataFrame:
    """The cells that count, under the same rules as the totals: combined rows beat their parts and a report total beats its zones."""
    table = estimates
    rows = lambda cells: F.aggregate(cells, F.lit(0).cast("long"), lambda total, c: total + c["n"])
    # step by step, as each step is used more than once in the next
    table = table.withColumns({f"_{g}": F.filter("cells", lambda c: c["grp"] == g) for g in GROUPS})
    table = table.withColumns({f"_{g}_c": F.exists(f"_{g}", lambda c: c["combined"]) for g in GROUPS})
    table = table.withColumns({f"_{g}": F.filter(f"_{g}", lambda c: c["combined"] == F.col(f"_{g}_c")) for g in GROUPS})
    table = table.withColumns({f"_{g}_t": rows(F.filter(f"_{g}", lambda c: c["is_total"])) for g in GROUPS})
    table = table.withColumns({f"_{g}_w": (F.col(f"_{g}_t") > 0) & (F.col(f"_{g}_t") < rows(F.col(f"_{g}"))) for g in GROUPS})
    kept = [F.filter(f"_{g}", lambda c: ~F.col(f"_{g}_w") | c["is_total"]) for g in GROUPS]
    return table.select("project_id", "estimate_date", "age", "n_estimates", F.explode(F.concat(*kept)).alias("c")).select(
        "project_id", "estimate_date", "age", "n_estimates", "c.grp", "c.zone", "c.first_id", "c.row", "c.label_id", "c.label"
    )


def zone_cells(resources: DataFrame, filings: DataFrame) -> DataFrame:
    """Zone x estimate cells, long form: (project, group, zone, date) -> tonnes, grade, label."""
    cells = _counted_cells(_zone_estimates(resources, filings, "grade"))
    return cells.groupBy("project_id", "grp", "zone", "estimate_date").agg(
        F.min_by("row", "first_id").alias("row"), F.max_by("label", "label_id").alias("label")
    ).select("project_id", "grp", "zone", "estimate_date", "row.tonnes", "row.grade", "label")


def zone_matrix(resources: DataFrame, filings: DataFrame, last: int = 4) -> DataFrame:
    """One row per (project, group, zone) with one tonnage column per estimate, newest last.

    The columns are a fixed list (the last n estimates), so no job runs to discover them.
    """
    cells = _counted_cells(_zone_estimates(resources, filings).filter(F.col("age") <= last))
    columns = [F.min_by("row.tonnes", F.when(F.col("age") == r, F.col("first_id"))).alias(f"estimate_{r}_back") for r in range(last, 0, -1)]
    return cells.groupBy("project_id", "grp", "zone").agg(*columns)


def zone_changes(resources: DataFrame, filings: DataFrame, last: int = 4) -> DataFrame:
    """Change of each zone between the two newest estimates: percent, new or not reported."""
    cells = _counted_cells(_zone_estimates(resources, filings).filter(F.col("age") <= last))
    tonnes = lambda age: F.min_by("row.tonnes", F.when(F.col("age") == age, F.col("first_id")))
    both = cells.groupBy("project_id", "grp", "zone").agg(
        F.max(F.col("age") == 1).alias("has_now"), tonnes(1).alias("now"), F.max(F.col("age") == 2).alias("had"), tonnes(2).alias("before"),
        F.max("n_estimates").alias("n_estimates"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.struct(-F.col("age"), F.col("label_id")))).alias("label"),
    )
    state = (
        F.when(F.col("has_now") & F.col("had"), F.lit("changed"))
        .when(F.col("has_now") & (F.col("n_estimates") >= 2), F.lit("new"))
        .when(F.col("had") & ~F.col("has_now"), F.lit("not reported"))
    )
    return both.select(
        "project_id", "grp", "zone",
        F.coalesce("label", F.lit("Total")).alias("label"),
        state.alias("state"),
        percent_change("before", "now").alias("pct"),
    )


# --- studies -----------------------------------------------------------------------------------


def study_progression(economics: DataFrame, filings: DataFrame) -> DataFrame:
    """Studies with a usable figure, one per (project, type, date, headline value), oldest first."""
    return _one_of_equal_studies(_usable_studies(economics, filings))


def _usable_studies(economics: DataFrame, filings: DataFrame) -> DataFrame:
    rows = economics
    if "filed_at" not in rows.columns:
        rows = rows.join(filings.select("document_id", "filed_at"), "document_id", "left")
    rows = rows.withColumn("study_date", F.coalesce("effective_date", "filed_at")).withColumn(
        "headline", headline_npv("npv")
    )
    figures = ("irr_pct", "capex_initial", "mine_life_years")
    rows = rows.filter(F.coalesce("headline.value", *figures).isNotNull())
    return rows.withColumn("npv_value", F.col("headline.value"))


def _one_of_equal_studies(studies: DataFrame) -> DataFrame:
    return first_per_key(studies, ["project_id", "study_type", "study_date", "npv_value"], F.col("study_id"))


METRICS = (("npv", False), ("irr", False), ("capex", True), ("aisc", True), ("mine_life", False), ("payback", True))


def study_changes(economics: DataFrame, filings: DataFrame) -> DataFrame:
    """Newest study against the one before it, one row per metric.

    ``comparable`` is false where tax basis, rate or currency differ; ``better`` reads the sign
    with costs inverted.
    """
    studies = study_progression(economics, filings)
    figures = F.struct(
        F.col("npv_value").alias("npv"),
        F.col("irr_pct").alias("irr"),
        F.col("capex_initial").alias("capex"),
        first_map_value("aisc").alias("aisc"),
        F.col("mine_life_years").alias("mine_life"),
        F.col("payback_years").alias("payback"),
        F.col("headline.key").alias("npv_key"),
        "currency", "study_type", "study_date", "study_id",
    )
    paired = studies.select("project_id", figures.alias("now")).select(
        "project_id",
        "now",
        F.lag("now").over(Window.partitionBy("project_id").orderBy(F.col("now.study_date").asc_nulls_first(), "now.study_id")).alias("before"),
    )
    newest = last_per_key(paired, ["project_id"], F.struct("now.study_date", "now.study_id")).filter("before is not null")
    same_money = F.col("now.currency").eqNullSafe(F.col("before.currency"))
    same_basis = (F.col("now.npv_key") == F.col("before.npv_key")) & same_money
    metrics = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"before.{name}").alias("before"),
                F.col(f"now.{name}").alias("now"),
                F.coalesce(same_basis if name == "npv" else same_money if name == "capex" else F.lit(True), F.lit(False)).alias("comparable"),
                F.lit(inverted).alias("inverted"),
            )
            for name, inverted in METRICS
        ]
    )
    pct = F.when(F.col("m.comparable"), percent_change("m.before", "m.now"))
    return newest.select("project_id", F.explode(metrics).alias("m")).select(
        "project_id", "m.metric", "m.before", "m.now", "m.comparable", pct.alias("pct"),
        F.when(F.col("m.inverted"), F.lit(0.0) - pct).otherwise(pct).alias("improvement"),
    )


def snapshots(resources: DataFrame, economics: DataFrame, filings: DataFrame) -> DataFrame:
    """Latest estimate, latest study and last change per project."""
    deltas = estimate_deltas(resources, filings).select("project_id", "estimate_date", "mi_tonnes", "inferred_tonnes", "change")
    newest = last_per_key(deltas, ["project_id"], F.col("estimate_date"))
    keys = primary_grade_keys(resources).select("project_id", "grade_key")
    usable = _usable_studies(economics, filings).select("project_id", "study_id", "study_type", "study_date", "npv_value")
    studies = last_per_key(_one_of_equal_studies(usable), ["project_id"], F.struct("study_date", "study_id")).drop("study_id")
    return (
        newest.join(keys, "project_id", "full_outer")
        .join(studies, "project_id", "full_outer")
    )


def resource_movers(
    resources: DataFrame, filings: DataFrame, projects: DataFrame, as_of: date,
    days: int = 90, limit: int = 8, commodity: str | None = None, companies: DataFrame | None = None,
) -> DataFrame:
    """Estimates filed in the window, one per project, real changes before scope changes before
    first estimates; inside each class the biggest move, then the newest. With ``companies``, the owner's name too."""
    window = filings.filter(F.col("filed_at") >= F.lit(as_of - timedelta(days=days))).select("document_id")
    # only projects that filed in the window are worked out, and a filing counts under its first estimate
    active = resources.join(window, "document_id", "left_semi").select("project_id").distinct()
    deltas = estimate_deltas(_measured(resources).join(active, "project_id", "left_semi"), filings)
    recent = first_per_key(deltas.join(window, "document_id", "left_semi"), ["project_id", "document_id"], F.col("estimate_date"))
    names = projects.select("project_id", F.col("name").alias("project_name"), "company_id", "commodities")
    if commodity:
        names = names.filter(F.array_contains("commodities", commodity))
    has_delta = F.coalesce("mi_pct", "inferred_pct", "metal_pct").isNotNull()
    # The condition sits in the pick's order (null loses) and not in a filter below it: a filter
    # would be pushed to the window and repeat every change expression there.
    tells = has_delta | F.coalesce("mi_tonnes", "inferred_tonnes").isNotNull()
    newest = last_per_key(recent, ["project_id"], F.when(tells, F.col("estimate_date"))).filter(F.col("estimate_date").isNotNull())
    newest = newest.join(names, "project_id")
    size = F.when(has_delta, F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in ("metal_pct", "mi_pct", "inferred_pct")])).otherwise(F.lit(0.0))
    rank = F.when(~has_delta, F.lit(2)).when(F.col("scope_change"), F.lit(1)).otherwise(F.lit(0))
    scored = newest.withColumn("move_class", rank).withColumn("move_size", size)
    order = [F.col("move_class"), F.col("move_size").desc(), F.col("estimate_date").desc(), F.col("project_id")]
    return _with_owner(ranked_top(scored, order, limit), companies)


def _with_owner(top: DataFrame, companies: DataFrame | None) -> DataFrame:
    """Names are looked up for the few rows of a finished list only."""
    if companies is None:
        return top
    return top.join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")


def new_studies(
    economics: DataFrame, filings: DataFrame, projects: DataFrame, as_of: date,
    days: int = 90, limit: int = 10, commodity: str | None = None, companies: DataFrame | None = None,
) -> DataFrame:
    """Newest study per project when filed in the window, with the previous study and the change
    of its headline value where both are on one basis. With ``companies``, the owner's name too."""
    dated = economics.join(filings.select("document_id", "filed_at"), "document_id")
    recent = dated.filter(F.col("filed_at") >= F.lit(as_of - timedelta(days=days))).select("project_id").distinct()
    names = projects.select("project_id", F.col("name").alias("project_name"), "company_id", "commodities")
    if commodity:
        names = names.filter(F.array_contains("commodities", commodity))
    studies = study_progression(dated.join(recent, "project_id", "left_semi"), filings)
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("npv_value", "irr_pct", "capex_initial", "mine_life_years", "payback_years"))
    studies = studies.withColumn("filled", filled).withColumn(
        "_doc", F.coalesce(F.col("document_id").cast("string"), F.col("study_id").cast("string"))
    )
    first_listed = F.struct(-F.col("filled"), F.coalesce(F.unix_date("study_date"), F.lit(-1_000_000_000)), F.col("study_id"))
    per_document = first_per_key(studies, ["project_id", "_doc"], first_listed)
    by_date = Window.partitionBy("project_id").orderBy(F.col("study_date").asc_nulls_first(), "study_id")
    previous = F.struct("study_type", "study_date", "npv_value", "headline", "currency")
    paired = per_document.withColumn("prev", F.lag(previous).over(by_date))
    latest = last_per_key(paired, ["project_id"], F.struct("study_date", "study_id"))
    latest = latest.filter(F.col("filed_at") >= F.lit(as_of - timedelta(days=days))).join(names, "project_id")
    comparable = (F.col("prev.headline.key") == F.col("headline.key")) & F.col("prev.currency").eqNullSafe(F.col("currency"))
    shown = latest.select(
        "project_id", "project_name", "company_id", "document_id", "study_type", "study_date", "filed_at", "npv_value",
        F.col("prev.study_type").alias("prev_study_type"),
        F.col("prev.npv_value").alias("prev_npv"),
        F.when(comparable, percent_change("prev.npv_value", "npv_value")).alias("npv_pct"),
    )
    return _with_owner(ranked_top(shown, [F.col("filed_at").desc_nulls_last(), F.col("project_id")], limit), companies)


# --- intercepts ----------------------------------------------------------------------------------


def scored_intercepts(drills: DataFrame, key: str | Column) -> DataFrame:
    """Rows with a positive grade under the key and a positive width, scored grade x width."""
    assay = F.lit(key) if isinstance(key, str) else key
    rows = drills.withColumn("width", intercept_width("interval_m", "from_m", "to_m")).withColumn(
        "assay", F.try_element_at(F.col("assays"), assay)
    )
    return rows.filter(F.col("width").isNotNull() & (F.col("assay") > 0)).withColumn(
        "score", F.col("assay") * F.col("width")
    )


#: Buckets of holes in which a bound of the last score of a list is looked for.
HOLE_BUCKETS = 4096


def _best_of_holes(scored: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The best row of each hole that can be among the first ``limit`` holes of its ``by`` group.

    Holes are dealt to buckets by a hash, and a bucket's highest score is one number. Holes of different buckets
    differ, so at least ``limit`` holes reach the ``limit``-th highest bucket, and no row below it is needed. Only the rows
    from there on are shuffled whole. Groups with fewer buckets than ``limit`` have no bound.
    """
    by = list(by)
    rows = scored.withColumn("_hole", F.coalesce(F.col("hole_id"), F.col("drill_id")))
    bucket = F.pmod(F.xxhash64("project_id", "_hole"), F.lit(HOLE_BUCKETS)).alias("_bucket")
    highest = rows.groupBy(*by, bucket).agg(F.max("score").alias("_high"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_high").desc()))
    bounds = highest.withColumn("_n", place).filter(F.col("_n") == limit).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_high").alias("_bound"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    near = rows.join(F.broadcast(bounds), match or F.lit(True), "left").filter(F.col("_bound").isNull() | (F.col("score") >= F.col("_bound")))
    # NaN counts as the highest score, as in a descending order
    order = F.struct(~F.isnan("score"), -F.col("score"), F.col("drill_id"))
    return first_per_key(near.select(*rows.columns), [*by, "project_id", "_hole"], order).drop("_hole")


def rank_intercepts(drills: DataFrame, key: str, limit: int = 8, per_hole: bool = False) -> DataFrame:
    """Best intercepts overall, optionally only the best one of each hole."""
    scored = scored_intercepts(drills, key)
    if per_hole:
        scored = _best_of_holes(scored, limit)
    return ranked_top(scored, [F.col("score").desc(), F.col("drill_id")], limit)


def rank_intercepts_by_key(drills: DataFrame, keys: tuple[str, ...] = ("Au_gpt", "Cu_pct"), limit: int = 8) -> DataFrame:
    """Rankings for several keys side by side, best row per hole."""
    rows = drills.withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    best = _best_of_holes(scored_intercepts(rows, F.col("key")), limit, ("key",))
    return top_per_key(best, ["key"], [F.col("score").desc(), F.col("drill_id")], limit)
