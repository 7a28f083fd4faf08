"""Registered relational queries: screener, lists, facets, counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import listing as L
from .driver_views import AS_OF_FILINGS, DriverViews, duck_sql
from .history_queries import ESTIMATES
from .registry import query

AS_OF = date.fromisoformat(AS_OF_FILINGS)
DAY = f"DATE '{AS_OF_FILINGS}'"
TECH = "('sk1300','ni43101','jorc','pea','pfs','fs')"
REPORTS = "('ni43101','sk1300','pea','pfs','fs')"

_LATEST = """
lr AS (SELECT * FROM resources QUALIFY row_number() OVER (PARTITION BY project_id
         ORDER BY effective_date DESC NULLS LAST, extraction_confidence DESC NULLS LAST, estimate_id DESC) = 1),
le AS (SELECT * FROM economics QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY effective_date DESC NULLS LAST, study_id DESC) = 1)
"""
_SCREEN = """
SELECT p.project_id, p.name, c.name AS company_name, p.country, p.stage, array_to_string(p.commodities, '|') AS commodities,
       lr.category AS resource_category, round(lr.tonnes, 2) AS tonnes, lr.document_id AS resource_document_id, lr.effective_date AS resource_date,
       le.study_type, le.irr_pct, round(le.capex_initial, 6) AS capex_initial, le.currency
FROM projects p LEFT JOIN companies c ON c.company_id = p.company_id
LEFT JOIN lr ON lr.project_id = p.project_id LEFT JOIN le ON le.project_id = p.project_id
WHERE {where} ORDER BY {order} LIMIT 200"""


def _screen(v: DriverViews, **filters):
    rows = L.screener(v.projects, v.companies, v.resources, v.economics, v.filings, **filters)
    return rows.select(
        "project_id", "name", "company_name", "country", "stage", F.array_join("commodities", "|").alias("commodities"),
        "resource_category", F.round("tonnes", 2).alias("tonnes"), "resource_document_id", "resource_date",
        "study_type", "irr_pct", F.round("capex_initial", 6).alias("capex_initial"), "currency",
    )


def _screen_sql(where: str, order: str) -> str:
    return duck_sql(_SCREEN.format(where=where, order=order), "projects", "companies", "resources", "economics", "filings", ctes=_LATEST)


@query("q10_screener", _screen_sql("true", "lr.tonnes DESC NULLS LAST, p.name, p.project_id"))
def _(v: DriverViews):
    return _screen(v)


@query(
    "q10_screener_filtered",
    _screen_sql(
        "list_contains(p.commodities, 'Au') AND p.country ILIKE 'nation_%' AND lr.cu >= 2 AND le.study_type = 'pfs' "
        "AND EXISTS (SELECT 1 FROM filings f WHERE f.project_id = p.project_id AND f.filed_at >= DATE '1999-01-01')",
        "le.irr_pct ASC NULLS LAST, lr.tonnes DESC NULLS LAST, p.name, p.project_id",
    ),
)
def _(v: DriverViews):
    return _screen(
        v, commodity="Au", country="nation_%", study_type="pfs", min_grade_key="Cu_pct", min_grade=2.0,
        filed_since="1999-01-01", sort="irr_pct", direction="asc",
    )


@query("q10_screener_by_date", _screen_sql("p.stage = 'pfs'", "lr.effective_date DESC NULLS LAST, lr.tonnes DESC NULLS LAST, p.name, p.project_id"))
def _(v: DriverViews):
    return _screen(v, stage="pfs", commodity="all", sort="resource_date")


@query(
    "q01_companies",
    duck_sql(
        """SELECT c.company_id, c.name, c.cik, c.hq_country, coalesce(p.n, 0) AS project_count, coalesce(d.n, 0) AS document_count,
                  p.commodities, d.last_filed
           FROM companies c
           LEFT JOIN (SELECT company_id, count(*) AS n FROM projects GROUP BY 1) p0 USING (company_id)
           LEFT JOIN (SELECT company_id, count(DISTINCT project_id) AS n, array_to_string(list_sort(list_distinct(flatten(list(commodities)))), '|') AS commodities
                      FROM projects GROUP BY 1) p USING (company_id)
           LEFT JOIN (SELECT company_id, count(*) AS n, max(filed_at) AS last_filed FROM filings GROUP BY 1) d USING (company_id)
           ORDER BY c.name, c.company_id""",
        "companies", "projects", "filings",
    ),
)
def _(v: DriverViews):
    rows = L.company_list(v.companies, v.projects, v.filings)
    return rows.withColumn("commodities", F.array_join("commodities", "|"))


@query(
    "q03_company_projects",
    duck_sql(
        """SELECT p.project_id, p.name, p.company_id, c.name AS company_name, p.country, p.stage, p.lat, p.lng
           FROM projects p LEFT JOIN companies c USING (company_id)""",
        "projects", "companies",
    ),
)
def _(v: DriverViews):
    return L.project_list(v.projects, v.companies).select(
        "project_id", "name", "company_id", "company_name", "country", "stage", "lat", "lng"
    )


_FILING_COLUMNS = ("document_id", "title", "doc_type", "filed_at", "status", "company_id", "company_name", "project_id", "project_name")
_FILING_SQL = """SELECT d.document_id, d.title, d.doc_type, d.filed_at, d.status, d.company_id, c.name AS company_name, d.project_id, p.name AS project_name
                 FROM filings d LEFT JOIN companies c ON c.company_id = d.company_id LEFT JOIN projects p ON p.project_id = d.project_id """


def _filing_sql(tail: str) -> str:
    return duck_sql(_FILING_SQL + tail, "filings", "companies", "projects")


@query("q04_filings_of_companies", _filing_sql("WHERE d.company_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d.company_id ORDER BY d.filed_at DESC NULLS LAST, d.document_id) <= 50"))
def _(v: DriverViews):
    return L.filings_per_company(v.filings, v.companies, v.projects, limit=50).select(*_FILING_COLUMNS)


@query("q04_filings_of_projects", _filing_sql("WHERE d.project_id IS NOT NULL"))
def _(v: DriverViews):
    return L.named_filings(v.filings.filter("project_id IS NOT NULL"), v.companies, v.projects).select(*_FILING_COLUMNS)


@query("q12_unresolved", _filing_sql("WHERE d.project_id IS NULL ORDER BY d.filed_at DESC NULLS LAST, d.document_id LIMIT 50"))
def _(v: DriverViews):
    return L.unresolved_filings(v.filings, v.companies, v.projects).select(*_FILING_COLUMNS)


@query("q13_recent", _filing_sql("ORDER BY d.filed_at DESC NULLS LAST, d.created_at DESC, d.document_id LIMIT 50"))
def _(v: DriverViews):
    return L.recent_filings(v.filings, v.companies, v.projects).select(*_FILING_COLUMNS)


@query(
    "q15_latest_reports",
    _filing_sql(f"WHERE d.doc_type IN {REPORTS} AND list_contains(p.commodities, 'Cu') ORDER BY d.filed_at DESC NULLS LAST, d.created_at DESC, d.document_id LIMIT 7"),
)
def _(v: DriverViews):
    return L.latest_reports(v.filings, v.companies, v.projects, commodity="Cu").select(*_FILING_COLUMNS)


@query(
    "q19_document_detail",
    duck_sql(
        """SELECT d.document_id, d.title, d.filed_at, c.name AS company_name, p.name AS project_name, coalesce(k.n, 0) AS chunk_count
           FROM filings d LEFT JOIN companies c ON c.company_id = d.company_id LEFT JOIN projects p ON p.project_id = d.project_id
           LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) k ON k.document_id = d.document_id""",
        "filings", "companies", "projects", "chunks",
    ),
)
def _(v: DriverViews):
    rows = L.filing_details(v.filings, v.companies, v.projects, v.chunks)
    return rows.select("document_id", "title", "filed_at", "company_name", "project_name", "chunk_count")


@query(
    "q05_resources",
    duck_sql(
        """SELECT estimate_id, r.project_id, r.document_id, effective_date, category, domain, round(tonnes, 2) AS tonnes, au, cu, reviewed, f.filed_at
           FROM resources r LEFT JOIN filings f ON f.document_id = r.document_id""",
        "resources", "filings",
    ),
)
def _(v: DriverViews):
    g = lambda k, n: F.try_element_at("grade", F.lit(k)).alias(n)
    return L.resources_with_filing(v.resources, v.filings).select(
        "estimate_id", "project_id", "document_id", "effective_date", "category", "domain", F.round("tonnes", 2).alias("tonnes"),
        g("Au_gpt", "au"), g("Cu_pct", "cu"), "reviewed", "filed_at",
    )


@query(
    "q06_economics",
    duck_sql(
        "SELECT study_id, e.project_id, study_type, effective_date, currency, irr_pct, mine_life_years, payback_years, f.filed_at FROM economics e LEFT JOIN filings f ON f.document_id = e.document_id",
        "economics", "filings",
    ),
)
def _(v: DriverViews):
    return L.economics_with_filing(v.economics, v.filings).select(
        "study_id", "project_id", "study_type", "effective_date", "currency", "irr_pct", "mine_life_years", "payback_years", "filed_at"
    )


@query(
    "q07_drills",
    duck_sql(
        "SELECT drill_id, project_id, hole_id, announced_date, from_m, to_m FROM drills QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY announced_date DESC NULLS LAST, hole_id NULLS FIRST, from_m, drill_id) <= 20",
        "drills",
    ),
)
def _(v: DriverViews):
    return L.project_drills(v.drills, limit=20).select("drill_id", "project_id", "hole_id", "announced_date", "from_m", "to_m")


@query(
    "q08_document_facts",
    duck_sql(
        """SELECT document_id, 'resource' AS kind, estimate_id AS fact_id, category AS label, tonnes AS figure, extraction_confidence FROM resources
           UNION ALL SELECT document_id, 'economics', CAST(study_id AS VARCHAR), study_type, irr_pct, extraction_confidence FROM economics
           UNION ALL SELECT document_id, 'drill', drill_id, hole_id, interval_m, extraction_confidence FROM drills""",
        "resources", "economics", "drills",
    ),
)
def _(v: DriverViews):
    return L.document_facts(v.resources, v.economics, v.drills)


@query(
    "q14_highlights",
    duck_sql(
        "SELECT d.drill_id, d.project_id, p.name AS project_name, announced_date, interval_m FROM drills d JOIN projects p USING (project_id) ORDER BY announced_date DESC NULLS LAST, interval_m DESC NULLS LAST, drill_id LIMIT 25",
        "drills", "projects",
    ),
)
def _(v: DriverViews):
    return L.drill_highlights(v.drills, v.projects).select("drill_id", "project_id", "project_name", "announced_date", "interval_m")


@query(
    "q31_recent_intercepts",
    duck_sql(
        f"""SELECT d.drill_id, d.project_id, p.name AS project_name, c.name AS company_name, d.from_m, d.to_m
            FROM drills d JOIN filings f ON f.document_id = d.document_id JOIN projects p ON p.project_id = d.project_id
            LEFT JOIN companies c ON c.company_id = p.company_id WHERE f.filed_at >= {DAY} - 30 AND list_contains(p.commodities, 'Cu')""",
        "drills", "filings", "projects", "companies",
    ),
)
def _(v: DriverViews):
    rows = L.recent_intercepts(v.drills, v.filings, v.projects, v.companies, AS_OF, commodity="Cu")
    return rows.select("drill_id", "project_id", "project_name", "company_name", "from_m", "to_m")


_EVENT = "SELECT e.event_id, e.project_id, p.name AS project_name, c.name AS company_name, e.document_id, e.event_type, e.event_date FROM project_events e JOIN projects p ON p.project_id = e.project_id LEFT JOIN companies c ON c.company_id = p.company_id "
_EVENT_COLUMNS = ("event_id", "project_id", "project_name", "company_name", "document_id", "event_type", "event_date")


@query("q09_company_feed", duck_sql(_EVENT + "WHERE p.company_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.company_id ORDER BY e.event_date DESC NULLS LAST, e.event_id DESC) <= 200", "project_events", "projects", "companies"))
def _(v: DriverViews):
    return L.feed_per_company(v.events, v.projects, v.companies).select(*_EVENT_COLUMNS)


@query("q16_recent_events", duck_sql(_EVENT + "WHERE e.event_type = 'financing' ORDER BY e.event_date DESC NULLS LAST, e.created_at DESC, e.event_id LIMIT 8", "project_events", "projects", "companies"))
def _(v: DriverViews):
    return L.recent_events(v.events, v.projects, v.companies, event_type="financing").select(*_EVENT_COLUMNS)


@query(
    "q40_merge_events",
    duck_sql(
        """SELECT arg_max(event_id, o) AS event_id, arg_max(project_id, o) AS project_id, arg_max(event_date, o) AS event_date,
                  (SELECT string_agg(k, '|' ORDER BY m DESC) FROM (SELECT u.k AS k, max(u.o) AS m FROM (SELECT unnest(list(struct_pack(k := coalesce(event_type, 'event'), o := o))) AS u) GROUP BY 1)) AS types,
                  bool_or(is_new) AS is_new
           FROM (SELECT *, created_at > TIMESTAMP '2024-01-20' AS is_new,
                        CASE WHEN document_id IS NOT NULL THEN 'f|' || project_id || '|' || document_id ELSE 'e|' || event_id END AS entry,
                        struct_pack(a := coalesce(event_date, DATE '0001-01-01'), b := event_id) AS o FROM project_events)
           GROUP BY entry""",
        "project_events",
    ),
)
def _(v: DriverViews):
    seen = v.events.withColumn("is_new", F.col("created_at") > F.lit("2024-01-20").cast("timestamp_ntz"))
    rows = L.merge_events_by_filing(seen)
    return rows.select("event_id", "project_id", "event_date", F.array_join("types", "|").alias("types"), "is_new")


@query(
    "q11_saved_filters",
    duck_sql(
        """SELECT conv_id AS filter_id, CASE WHEN role = 'all' THEN NULL ELSE role END AS stage, CAST(turn AS DOUBLE) AS min_grade,
                  CASE WHEN turn % 2 = 0 THEN 'asc' ELSE 'desc' END AS dir, 'tonnes' AS sort FROM conversations""",
    ),
)
def _(v: DriverViews):
    criteria = F.to_json(
        F.struct(
            F.col("role").alias("stage"), F.lit("all").alias("commodity"), F.col("turn").cast("string").alias("minGrade"),
            F.when(F.col("turn") % 2 == 0, F.lit("asc")).otherwise(F.lit("down")).alias("dir"),
        )
    )
    saved = v.table("conversations").select(F.col("conv_id").alias("filter_id"), criteria.alias("criteria"))
    return L.saved_filters(saved).select("filter_id", "stage", "min_grade", "dir", "sort")


@query(
    "q17_corpus",
    duck_sql(
        """SELECT d.document_id, d.title, d.source, d.status, p.name AS project_name, coalesce(k.n, 0) AS chunk_count
           FROM filings d LEFT JOIN projects p ON p.project_id = d.project_id
           LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) k ON k.document_id = d.document_id
           WHERE (d.title ILIKE '%block 1%' OR p.name ILIKE '%block 1%') AND d.source = 'edgar'
           ORDER BY d.filed_at DESC NULLS LAST, d.document_id LIMIT 500""",
        "filings", "projects", "chunks",
    ),
)
def _(v: DriverViews):
    rows = L.corpus(v.filings, v.projects, v.chunks, search="block 1", source="edgar", status="all")
    return rows.select("document_id", "title", "source", "status", "project_name", "chunk_count")


@query(
    "q18_facets",
    duck_sql(
        """SELECT 'doc_type' AS facet, doc_type AS value, count(*) AS total FROM filings GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM filings GROUP BY 2
           UNION ALL SELECT 'source', source, count(*) FROM filings GROUP BY 2""",
        "filings",
    ),
)
def _(v: DriverViews):
    return L.facets(v.filings)


@query("q20_admin_documents", duck_sql("SELECT document_id, source, doc_type, status, filed_at FROM filings ORDER BY created_at DESC NULLS LAST, document_id LIMIT 200", "filings"))
def _(v: DriverViews):
    rows = v.filings.orderBy(F.col("created_at").desc_nulls_last(), "document_id").limit(200)
    return rows.select("document_id", "source", "doc_type", "status", "filed_at")


@query("q21_source_stats", duck_sql("SELECT source, count(*) AS total, count(*) FILTER (status = 'failed') AS failed FROM filings GROUP BY 1", "filings"))
def _(v: DriverViews):
    return L.source_stats(v.filings)


@query("q21_status", duck_sql("SELECT status, count(*) AS total FROM filings GROUP BY 1", "filings"))
def _(v: DriverViews):
    return L.distribution(v.filings, "status")


@query("q22_stage", duck_sql("SELECT stage, count(*) AS total FROM projects GROUP BY 1", "projects"))
def _(v: DriverViews):
    return L.distribution(v.projects, "stage")


@query("q23_doc_type", duck_sql("SELECT doc_type, count(*) AS total FROM filings GROUP BY 1", "filings"))
def _(v: DriverViews):
    return L.distribution(v.filings, "doc_type")


@query("q24_commodities", duck_sql("SELECT commodity, count(*) AS total FROM (SELECT unnest(commodities) AS commodity FROM projects) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "projects"))
def _(v: DriverViews):
    return L.commodity_distribution(v.projects)


@query("q25_months", duck_sql("SELECT strftime(filed_at, '%Y-%m') AS month, source, count(*) AS total FROM filings WHERE filed_at IS NOT NULL GROUP BY ALL", "filings"))
def _(v: DriverViews):
    return L.filings_by_month(v.filings)


@query(
    "q26_stacked_months",
    duck_sql(
        """, monthly AS (SELECT strftime(filed_at, '%Y-%m') AS month, coalesce(source, 'unknown') AS source, count(*) AS total FROM filings WHERE filed_at IS NOT NULL GROUP BY ALL),
            seen AS (SELECT source, min(month) AS first_month FROM monthly GROUP BY 1),
            grid AS (SELECT m.month, s.source, s.first_month FROM (SELECT DISTINCT month FROM monthly) m CROSS JOIN seen s)
            SELECT month, source, coalesce(total, 0) AS value,
                   CAST(coalesce(sum(coalesce(total, 0)) OVER (PARTITION BY month ORDER BY first_month, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM grid LEFT JOIN monthly USING (month, source)""",
        "filings",
    ),
)
def _(v: DriverViews):
    return L.stacked_months(v.filings)


@query(
    "q27_facet_values",
    duck_sql(
        """SELECT DISTINCT * FROM (SELECT 'commodity' AS facet, unnest(commodities) AS value FROM projects UNION ALL SELECT 'country', country FROM projects
           UNION ALL SELECT 'stage', stage FROM projects UNION ALL SELECT 'study_type', study_type FROM economics) WHERE value IS NOT NULL""",
        "projects", "economics",
    ),
)
def _(v: DriverViews):
    return L.screener_facets(v.projects, v.economics)


@query("q28_grade_keys", duck_sql("SELECT key, total FROM (SELECT 'Au_gpt' AS key, count(au) AS total FROM resources UNION ALL SELECT 'Cu_pct', count(cu) FROM resources) WHERE total >= 5", "resources"))
def _(v: DriverViews):
    return L.grade_key_facet(v.resources)


@query(
    "q29_counts",
    duck_sql(
        "SELECT (SELECT count(*) FROM filings) AS documents, (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM resources) AS resources, (SELECT count(*) FROM drills) AS drills",
        "filings", "companies", "projects", "resources", "drills",
    ),
)
def _(v: DriverViews):
    return L.corpus_counts(v.filings, v.companies, v.projects, v.resources, v.drills)


@query(
    "q30_dashboard",
    duck_sql(
        f"""SELECT (SELECT count(*) FROM filings d LEFT JOIN projects p ON p.project_id = d.project_id WHERE d.doc_type IN {TECH} AND d.filed_at >= {DAY} - 6 AND list_contains(p.commodities, 'Au')) AS reports_7d,
                   (SELECT count(DISTINCT e.document_id) FROM economics e JOIN filings d ON d.document_id = e.document_id JOIN projects p ON p.project_id = e.project_id
                     WHERE d.filed_at >= {DAY} - 90 AND (e.irr_pct IS NOT NULL OR e.has_npv) AND list_contains(p.commodities, 'Au')) AS studies_90d,
                   (SELECT count(DISTINCT r.document_id) FROM resources r JOIN filings d ON d.document_id = r.document_id JOIN projects p ON p.project_id = r.project_id
                     WHERE d.filed_at >= {DAY} - 90 AND list_contains(p.commodities, 'Au')) AS resources_90d""",
        "filings", "projects", "economics", "resources",
    ),
)
def _(v: DriverViews):
    return L.dashboard_counts(v.filings, v.projects, v.resources, v.economics, AS_OF, commodity="Au")


@query(
    "q32_unmatched_occurrences",
    duck_sql("SELECT occurrence_id, name, region FROM occurrences WHERE region IS NULL ORDER BY name, occurrence_id LIMIT 50", "occurrences"),
)
def _(v: DriverViews):
    linked = v.occurrences.withColumn("project_id", F.when(F.col("region").isNotNull(), F.col("occurrence_id")))
    return L.unmatched_occurrences(linked).select("occurrence_id", "name", "region")


@query("q33_map_points", duck_sql("SELECT project_id, name, lat, lng FROM projects WHERE lat IS NOT NULL AND lng IS NOT NULL", "projects"))
def _(v: DriverViews):
    text = v.projects.withColumns({"lat": F.col("lat").cast("string"), "lng": F.coalesce(F.col("lng").cast("string"), F.lit("unknown"))})
    return L.map_points(text).select("project_id", "name", "lat", "lng")


_MIX = f"FROM filings d JOIN projects p ON p.project_id = d.project_id{{join}} WHERE d.filed_at >= {DAY} - 90 AND d.doc_type IN {TECH} "


@query("q34_pipeline", duck_sql("SELECT x.c AS label, count(*) AS total " + _MIX.format(join=", unnest(p.commodities) AS x(c)") + "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "filings", "projects"))
def _(v: DriverViews):
    return L.pipeline_mix(v.filings, v.projects, AS_OF)


@query("q34_pipeline_country", duck_sql("SELECT p.country AS label, count(*) AS total " + _MIX.format(join="") + "AND list_contains(p.commodities, 'Au') AND p.country IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "filings", "projects"))
def _(v: DriverViews):
    return L.pipeline_mix(v.filings, v.projects, AS_OF, commodity="Au")


@query(
    "q35_stage_mix",
    duck_sql(
        f"SELECT p.stage AS label, count(DISTINCT p.project_id) AS total FROM filings d JOIN projects p ON p.project_id = d.project_id WHERE d.filed_at >= {DAY} - 90 AND p.stage IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
        "filings", "projects",
    ),
)
def _(v: DriverViews):
    return L.stage_mix(v.filings, v.projects, AS_OF)


@query(
    "q36_watchlist_items",
    duck_sql(
        "SELECT i.item_id, i.watchlist_id, i.project_id, i.company_id, p.name AS project_name, c.name AS company_name FROM watchlist_items i LEFT JOIN projects p ON p.project_id = i.project_id LEFT JOIN companies c ON c.company_id = i.company_id",
        "watchlist_items", "projects", "companies",
    ),
)
def _(v: DriverViews):
    rows = L.watchlist_entries(v.watchlist_items, v.projects, v.companies)
    return rows.select("item_id", "watchlist_id", "project_id", "company_id", "project_name", "company_name")


@query(
    "q37_on_watchlist",
    duck_sql(
        """SELECT document_id, EXISTS (SELECT 1 FROM watchlist_items i WHERE i.project_id = f.project_id) OR
                  EXISTS (SELECT 1 FROM watchlist_items i WHERE i.company_id = f.company_id) AS watched FROM filings f""",
        "filings", "watchlist_items",
    ),
)
def _(v: DriverViews):
    return L.on_watchlist(v.filings, v.watchlist_items).select("document_id", "watched")


@query(
    "q38_newer_report",
    duck_sql(
        f"SELECT document_id, coalesce(max(filed_at) FILTER (doc_type IN {TECH}) OVER (PARTITION BY project_id) > filed_at, false) AND project_id IS NOT NULL AS newer_exists FROM filings",
        "filings",
    ),
)
def _(v: DriverViews):
    return L.newer_report_exists(v.filings).select("document_id", "newer_exists")


@query(
    "q41_guarded_select",
    duck_sql(
        "SELECT stage, count(*) AS n, count(DISTINCT company_id) AS companies FROM projects WHERE country IS NOT NULL GROUP BY stage ORDER BY stage NULLS FIRST LIMIT 50", "projects"
    ),
)
def _(v: DriverViews):
    text = "SELECT stage, count(*) AS n, count(DISTINCT company_id) AS companies FROM v_projects WHERE country IS NOT NULL GROUP BY stage ORDER BY stage;"
    return L.guarded_select(v.spark, text, {"v_projects": v.projects})


@query(
    "q09_project_feed_with_change",
    duck_sql(
        """SELECT e.event_id, e.project_id, e.document_id, e.event_type, e.event_date, x.change
           FROM project_events e JOIN projects p ON p.project_id = e.project_id
           LEFT JOIN (SELECT d.project_id, d.document_id, l.change FROM
                        (SELECT project_id, document_id, min(estimate_date) AS estimate_date FROM dated GROUP BY ALL) d
                        LEFT JOIN lines l USING (project_id, estimate_date)) x ON x.project_id = e.project_id AND x.document_id = e.document_id""",
        "project_events", "projects", "resources", "filings", ctes=ESTIMATES,
    ),
)
def _(v: DriverViews):
    rows = L.event_feed(v.events, v.projects, v.companies, resources=v.resources, filings=v.filings)
    return rows.select("event_id", "project_id", "document_id", "event_type", "event_date", "change")
